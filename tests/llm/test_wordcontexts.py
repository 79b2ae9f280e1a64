"""Scores by all contexts, against dictionaries of every context in one process."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import suffixtree, wordcontexts

TABLES = "/root/testdata/sf0.001"


def brute_scores(texts, train, bits):
    """(base, score) of each text; a state holds the shares of its paying next words, and what is left."""
    split = [[*(t or "").encode().lower().split(), None] for t in texts]
    counts = Counter(w for s, learn in zip(split, train) if learn for w in s)
    tokens = sum(counts.values()) + len(counts) + 1
    after = {1: defaultdict(Counter), 2: defaultdict(Counter)}
    for s, learn in zip(split, train):
        line = [None, *s]
        for i in range(1, len(line)) if learn else ():
            after[1][line[i - 1]][line[i]] += 1
            if i > 1:
                after[2][line[i - 2], line[i - 1]][line[i]] += 1
    root = lambda w: math.log10((counts[w] + 1) / tokens)

    def states(nexts, parent):
        out = {}
        for context, met in nexts.items():
            n = sum(met.values())
            rows = {w: (k, math.log10((k - 0.5) / n), parent(context, w)) for w, k in met.items()}
            rows = {w: r for w, r in rows.items() if r[0] * (r[1] - r[2]) > bits * math.log10(2)}
            left, free = 1 - sum(10**r[1] for r in rows.values()), 1 - sum(10**r[2] for r in rows.values())
            if rows and left > 0 and free > 1e-9:
                rest = math.log10(left / free)
                saved = sum(r[0] * (r[1] - r[2]) for r in rows.values()) + (n - sum(r[0] for r in rows.values())) * rest
                if saved > bits * math.log10(2) * (len(rows) + 1):
                    out[context] = rest, {w: r[1] for w, r in rows.items()}
        return out

    single = states(after[1], lambda _, w: root(w))

    def one(b, w):
        rest, kept = single.get(b, (0.0, {}))
        return kept.get(w, rest + root(w))

    double = states(after[2], lambda ab, w: one(ab[1], w))
    found = []
    for s in split:
        line, total = [None, *s], 0.0
        for i in range(1, len(line)):
            rest, kept = double.get((line[i - 2], line[i - 1]), (0.0, {})) if i > 1 else (0.0, {})
            total += kept.get(line[i], rest + one(line[i - 1], line[i]))
        found.append((sum(map(root, s)), total))
    return found, single, double


@pytest.mark.parametrize("range_tokens, block_tokens", [(1_000_000, 500_000), (700, 900)])
def test_scores_are_those_of_every_context(spark, monkeypatch, range_tokens, block_tokens):
    monkeypatch.setattr(wordcontexts, "BLOCK_TOKENS", block_tokens)
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").repartition(3)
    rows = sorted((r["doc_id"], r["text"], r["t"]) for r in docs.select("*", (~suffixtree.held_out(F.col("doc_id"))).alias("t")).collect())
    wanted, single, double = brute_scores([r[1] for r in rows], [r[2] for r in rows], wordcontexts.BITS)
    assert single and double
    found, _ = wordcontexts.score_texts(docs, ~suffixtree.held_out(F.col("doc_id")), range_tokens=range_tokens)
    got = {r["key"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for (key, _, _), (base, score) in zip(rows, wanted):
        assert got[key]["base_score"] == pytest.approx(base, rel=1e-9)
        assert got[key]["score"] == pytest.approx(score, rel=1e-9)


def test_a_context_is_a_state_however_small_its_share(spark, tmp_path):
    """Three copies of a rare passage in 400,000 tokens: below any share of the corpus, yet they save bits."""
    common = " ".join(f"w{i % 97}" for i in range(2_000))
    passage = " ".join(f"rare{i}" for i in range(40))
    rows = [(i, common) for i in range(200)] + [(1_000 + i, passage) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in suffixtree.op2_suffix_tree(spark, str(tmp_path)).collect()}
    assert sum(not found[1_000 + i]["held_out"] for i in range(5)) >= 3
    assert found[1_000]["train_tokens"] > 300_000
    assert found[1_000]["score"] > found[1_000]["base_score"] + 100


def test_tables_that_are_not_read_again_are_removed(spark, tmp_path, monkeypatch):
    from tallyframe.plans import sizing

    monkeypatch.setattr(sizing, "_base_folder", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(i, f"a b c{i % 3} d", i % 7 != 2) for i in range(60)], "doc_id long, text string, learn boolean")
    found, _ = wordcontexts.score_texts(docs, docs["learn"])
    assert found.count() == 60
    assert len(list(tmp_path.glob("stage-*"))) == 2  # the blocks with their numbers, and the answers
