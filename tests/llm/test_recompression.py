"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyframe.llm import recompression


def plain_runs(words):
    """(start, length, period) of every run: for each period the stretches of equal words, smallest period first."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        start = None
        for i in range(len(words) - p + 1):
            same = i + p < len(words) and words[i] == words[i + p]
            if same and start is None:
                start = i
            if not same and start is not None:
                length = i - start + p
                if length >= max(12, 2 * p):
                    found.setdefault((start, length), p)
                start = None
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(key, text):
    words = (text or "").encode().split()
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def odd_words(seed, number):
    rng = random.Random(seed)
    out = []
    for _ in range(number):
        n, letters = rng.randint(0, 90), rng.choice([1, 2, 3, 5, 30])
        words = [rng.randint(1, letters) for _ in range(n)]
        if n > 3 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        out.append(np.array(words, np.int64))
    return out


@pytest.mark.parametrize("step", [5, 1_000_000])
def test_runs_equal_a_plain_search(monkeypatch, step):
    monkeypatch.setattr(recompression, "STEP", step)
    for seed in range(60):
        texts = odd_words(seed, 5)
        for words, runs in zip(texts, recompression.block_runs(texts)):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(words.tolist())


def test_known_words():
    a, b = recompression.block_runs([np.array([1] * 12), np.array([1, 2] * 6 + [1, 3])])
    assert a.tolist() == [[0, 12, 1]] and b.tolist() == [[0, 13, 2]]
    fibonacci = [1], [1, 2]
    while len(fibonacci[1]) < 300:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    words = fibonacci[1]
    assert [tuple(r) for r in recompression.block_runs([np.array(words)])[0].tolist()] == plain_runs(words)


@pytest.mark.parametrize("backward", [False, True])
def test_extensions_of_every_two_places(backward):
    rng = np.random.default_rng(3)
    for letters in (1, 2, 4):
        words = rng.integers(1, letters + 1, 40)
        symbols = np.concatenate([[0], words, [0]])
        levels = recompression.build_grammar(symbols)
        if backward:
            levels, symbols = recompression.reversed_grammar(levels), symbols[::-1]
        x, y = np.triu_indices(40, 1)
        got = recompression.common_extension(levels, x + 1, y + 1)
        for i, j, n in zip(x + 1, y + 1, got):
            plain = next(k for k in range(60) if symbols[j + k] == 0 or symbols[i + k] != symbols[j + k])
            assert n == plain


def test_grammar_ends_in_one_symbol_a_text():
    words = np.random.default_rng(1).integers(1, 5, 5_000)
    levels = recompression.build_grammar(np.concatenate([[0], words, [0], words[:7], [0]]))
    assert len(levels[-1].symbols) == 5 and len(levels) < 80


def test_query_equals_the_plain_rows(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = recompression.op11_recompression(spark, folder).select(*COLUMNS).collect()
    short = {r["doc_id"]: r["text"] for r in docs if len((r["text"] or "").split()) <= 2_000}
    got = sorted(tuple(r) for r in rows if r["doc_id"] in short)
    assert len(rows) == len(docs) and len(got) > 150
    assert got == sorted(plain_row(k, t) for k, t in short.items())


def test_odd_texts(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = recompression.op11_recompression(spark, odd_dir).select(*COLUMNS).collect()
    short = [r for r in docs if len((r["text"] or "").split()) <= 2_000]
    want = sorted((plain_row(*r) for r in short), key=str)
    kept = [r for r in rows if r["n_runs"] == 0 or (r["length"] or 0) <= 2_000]
    assert sorted((tuple(r) for r in kept), key=str) == want
    long = [r for r in rows if (r["length"] or 0) > 2_000]  # 5,000 times the same six words, in two rows
    assert [(r["start"], r["length"], r["period"], r["exponent_milli"]) for r in long] == [(0, 30_000, 6, 5_000_000)] * 2


def test_clashing_name(spark):
    with pytest.raises(ValueError):
        recompression.find_runs(spark.createDataFrame([("a", 1)], "text string, runs int"))


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = [(i, "a b c " * (i % 9) + f"x{i} y") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = recompression.find_runs(df).collect()
    monkeypatch.setattr(recompression, "BLOCK_WORDS", 7)
    assert recompression.find_runs(df.repartition(5)).orderBy("doc_id").collect() == sorted(whole)
