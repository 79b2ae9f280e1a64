"""The operators against brute force, exact round trips and held-out accuracy on small inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyframe.llm import common, mixing, orderhash, pieces, quality, secret_spans, simhash, suffixtree, toxicity, transducer, warc

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def odd_strings(number, letters, length, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(length))) for _ in range(number)]


# Archives ---------------------------------------------------------------------------------------

def archive_rows():
    same = "<p>" + "copy " * 50
    rows = [(i, f"http://h/{i}", f"<html>{i} {'é' * (i % 50)}</html>" * (1 + i % 7)) for i in range(300)]
    rows += [(500 + i, f"http://c/{i}", same) for i in range(40)] + [(900, None, "tiny"), (901, "u", "tiny"), (902, "v", None)]
    return rows


def files_of(folder):
    import os

    return {n: open(f"{folder}/data/{n}", "rb").read() for n in sorted(os.listdir(f"{folder}/data")) if n.endswith(".gz")}


def test_archives_are_the_same_for_any_partitions_and_roll(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 4_000)
    monkeypatch.setattr(warc, "SHARD_BYTES", 15_000)
    rows = archive_rows()
    found = []
    for turn, parts in enumerate((1, 5)):
        random.Random(turn).shuffle(rows)
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        manifest = warc.write_archives(pages, f"file://{tmp_path}/{turn}")
        files = files_of(f"{tmp_path}/{turn}")
        listed = {r["file"]: (r["size"], r["sha256"]) for r in manifest.collect()}
        assert listed == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}
        found.append(files)
    assert found[0] == found[1]
    assert len({n.split("-")[1] for n in found[0]}) > 1 and any(n.split("-")[2] != "00000.warc.gz" for n in found[0])
    back = {r["page_id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}/0").collect()}
    for page_id, url, html in archive_rows():
        r, payload = back[page_id], (html or "").encode()
        copy = 500 < page_id < 540
        assert (r["record_type"], r["refers_to"]) == (("revisit", 500) if copy else ("response", None))
        assert r["payload"] is None if copy else bytes(r["payload"]) == payload
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())


def test_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame(archive_rows(), "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/a")
    (tmp_path / "a/data/shard-00000009-00000.warc.gz").write_bytes(b"left over")
    with pytest.raises(ValueError, match="manifest"):
        warc.read_archives(spark, f"file://{tmp_path}/a")


# Suffix tree ------------------------------------------------------------------------------------

def corpus():
    rng = random.Random(4)
    words = ["the", "cat", "sat", "on", "mat", "Dog", "ran", "far"]
    return [" ".join(rng.choice(["the cat sat on the mat", "Dog ran far", rng.choice(words), f"rare{i}"]) for _ in range(12)) for i in range(120)]


def test_scores_equal_a_plain_walk_and_sum_to_one(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    tree, counts = suffixtree.learn(df.where("doc_id < 100").select("text"), word_share=0.004, next_share=0.002)
    assert tree.single and tree.double
    counted = Counter(w for t in rows[:100] for w in t.encode().lower().split())
    assert {r["word"].encode(): r["c"] for r in counts.collect()} == counted
    total, distinct = sum(counted.values()) + 100, len(counted) + 1
    assert (tree.total, tree.distinct) == (total, distinct)
    ids = {w: i + 1 for i, w in enumerate(tree.words)}
    rare = len(tree.words) + 1

    def root(word):
        return math.log10((counted.get(word, 0) + 1) / (total + distinct + 1))

    def walk(text):
        words = [*text.encode().lower().split(), None]
        out, before = 0.0, [0]
        for w in words:
            at = 0 if w is None else ids.get(w, rare)
            state = tree.double.get(before[-2] * tree.size + before[-1]) if len(before) > 1 else None
            state = state if state is not None else tree.single.get(before[-1], 0)
            while state and state * tree.size + at not in tree.entries:
                out += tree.rest[state]
                state = tree.parent[state]
            out += tree.entries[state * tree.size + at] if state else (math.log10(101 / (total + distinct + 1)) if w is None else root(w))
            before.append(at)
        return out

    scored = {r["key"]: r for r in suffixtree.score(df, tree, counts).collect()}
    for i, text in enumerate(rows):
        words = text.encode().lower().split()
        assert scored[i]["score"] == pytest.approx(walk(text), rel=1e-9)
        assert scored[i]["base_score"] == pytest.approx(sum(map(root, words)) + math.log10(101 / (total + distinct + 1)), rel=1e-9)
        assert (scored[i]["n_tokens"], scored[i]["n_known"]) == (len(words) + 1, sum(w in counted for w in words) + 1)
    others = 10 ** root(None) + sum(10 ** root(w) for w in counted if w not in ids)
    for state in range(len(tree.rest)):
        left, at = 0.0, state
        while at:
            left, at = left + tree.rest[at], tree.parent[at]
        known = sum(10 ** tree.log10(state, w) for w in range(rare))
        assert known + others * 10**left == pytest.approx(1, abs=1e-9)
    held = range(100, 120)
    assert sum(scored[i]["score"] for i in held) > sum(scored[i]["base_score"] for i in held)


# Mixing -----------------------------------------------------------------------------------------

def test_knapsack_finds_the_nearest_sum():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size, have = rng.integers(0, 12, 4), rng.integers(0, 4, 4)
        budget = int(rng.integers(0, 60))
        got = mixing.knapsack(size, have, budget)
        sums = [sum(a * b for a, b in zip(size, x)) for x in itertools.product(*[range(h + 1) for h in have])]
        assert (got <= have).all() and int((got * size).sum()) == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("scale", [1, 1000])
def test_lengths_meet_large_budgets(monkeypatch, scale):
    monkeypatch.setattr(mixing, "PROGRAM_WORDS", 500)
    lengths, counts = np.array([0, 1, 7, 50, 333]), np.array([5, 9, 20, 40, 30]) * scale
    for share in (0.0, 0.1, 0.5, 0.99, 1.0):
        budget = int((lengths * counts).sum() * share)
        got = mixing.fit_lengths(lengths, counts, budget)
        assert (got <= counts).all() and (lengths * got).sum() == budget


def shares(sizes):
    """Targets by sharing again until none is above twice its size."""
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    left, open_names, out = 1.5 * sum(sizes.values()), list(names), {}
    while open_names:
        level = left / sum(weight[k] for k in open_names)
        full = [k for k in open_names if level * weight[k] >= 2 * sizes[k]]
        if not full:
            return out | {k: level * weight[k] for k in open_names}
        for k in full:
            out[k] = 2.0 * sizes[k]
            left -= out[k]
            open_names.remove(k)
    return out


def test_mix_meets_its_targets_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PICK_ROWS", 20)
    rng = random.Random(3)
    names = ["b", "a", "ä", None, "Z", "tiny"]
    rows = [(i, rng.choice(names[:5]) if i % 3 else "a", 5 if i % 2 else rng.randrange(40)) for i in range(900)] + [(901, "tiny", 1), (902, "none", 0)]
    df = spark.createDataFrame(rows, "key long, source string, size long")
    got = {r["key"]: r for r in mixing.mix(df, ["key"]).collect()}
    again = {r["key"]: r["copies"] for r in mixing.mix(df.repartition(7), ["key"]).collect()}
    assert {k: r["copies"] for k, r in got.items()} == again
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = shares(sizes)
    for s in sizes:
        mine = [r for r in got.values() if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[s]) and mine[0]["source_size"] == sizes[s]
        assert all(0 <= r["copies"] <= 2 for r in mine)
        assert abs(sum(r["size"] * r["copies"] for r in mine) - want[s]) <= 1


# Secrets ----------------------------------------------------------------------------------------

def plain_spans(text):
    kinds = [("assign", secret_spans.ASSIGN, 2, 8), ("access", secret_spans.ACCESS, 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    return [(k, m.start(), m.end()) for k, p, g, n in kinds for m in p.finditer(text) if len(m.group(g)) >= n]


def test_fixed_patterns():
    found = odd_strings(3000, ["password", "TOKEN", "api_key", "=", ": ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", " ", "é", "x", "\n"], 14)
    for text in [*found, "token=apikey:abcdefghij", "AKIAAKIA" + "A" * 11, "f" * 31, "ſecret=abcdefghijk"]:
        assert secret_spans.base_spans(text) == plain_spans(text)


def test_decoding_finds_the_best_path_of_the_whole_text():
    rng = np.random.default_rng(6)
    for _ in range(150):
        score, moves = rng.normal(0, 1, (7, 3)) - [0, 1, 1], rng.normal(0, 1, (3, 3))
        moves[0, 2] = secret_spans.NEVER
        best = max(itertools.product(range(3), repeat=7), key=lambda p: sum(moves[a, b] for a, b in zip((0, *p), (*p, 0))) + sum(score[i, t] for i, t in enumerate(p)))
        spans = []
        for i, t in enumerate(best):
            if t == 1:
                spans.append((i, i + 1))
            elif t == 2:
                spans[-1] = (spans[-1][0], i + 1)
        assert secret_spans.decode(score, moves) == spans


def test_gradient_of_the_field():
    rng = np.random.default_rng(1)
    score, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    tags, real = np.array([[0, 1, 2, 0], [0, 0, 1, 0]]), np.array([[1, 1, 1, 1], [1, 1, 1, 0]], bool)

    def loss(score, moves):
        out = 0.0
        for n, length in enumerate(real.sum(axis=1)):
            value = lambda p: sum(moves[a, b] for a, b in zip((0, *p), p)) + sum(score[n, i, t] for i, t in enumerate(p))  # noqa: B023, E731
            out += math.log(sum(math.exp(value(p)) for p in itertools.product(range(3), repeat=int(length)))) - value(tags[n, :length].tolist())
        return out

    by_tag, by_move = secret_spans.gradient(score, moves, tags, real)
    for spot in itertools.product(range(2), range(4), range(3)):
        step = np.zeros_like(score)
        step[spot] = 1e-5
        assert by_tag[spot] == pytest.approx((loss(score + step, moves) - loss(score - step, moves)) / 2e-5, abs=1e-6)
    for spot in itertools.product(range(3), range(3)):
        step = np.zeros_like(moves)
        step[spot] = 1e-5
        assert by_move[spot] == pytest.approx((loss(score, moves + step) - loss(score, moves - step)) / 2e-5, abs=1e-6)


def test_the_field_finds_held_out_secrets_and_masks_them(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma.", "delta,", "of", "The"]) for _ in range(n))
    secret = lambda: rng.choice(['password=', 'token = "', "secret: "]) + "".join(rng.choice("0123456789abcdef") for _ in range(24))
    train = [f"{words(30)} {secret()} {words(30)}" for _ in range(120)] + [words(60) for _ in range(60)]
    model = secret_spans.train(train)
    memo = secret_spans.Tokens(model[0])
    bare = [f"{words(20)} pwd = {''.join(rng.choice('0123456789abcdef') for _ in range(24))} {words(20)}" for _ in range(50)]
    assert sum(bool(secret_spans.field_spans(t, memo, model[1])) for t in bare) >= 40
    assert not any(secret_spans.field_spans(words(60), memo, model[1]) for _ in range(50))
    rows = spark.createDataFrame([(1, "é " + train[0]), (2, "clean"), (3, None)], "doc_id long, text string")
    found = secret_spans.scan(rows, model)
    masked = {r[0]: r[1] for r in found.select("doc_id", secret_spans.mask(F.col("text"), F.col("spans"))).collect()}
    assert "[SECRET]" in masked[1] and secret_spans.base_spans(masked[1]) == []
    assert masked[2] == "clean" and masked[3] is None


# SimHash ----------------------------------------------------------------------------------------

def plain_print(text, width=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, linked):
    root = list(range(len(items)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(items)), 2):
        if linked(items[i], items[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(items))]


def test_simhash_query_against_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in simhash.op5_simhash(spark, TABLES).collect()}
    ids = sorted(texts)
    prints = [plain_print(texts[i]) for i in ids]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    for i, p, r in zip(ids, prints, roots):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{p:016x}", ids[r])


@pytest.mark.parametrize("tau, parts", [(3, 4), (3, 3), (5, 4), (2, 2)])
def test_links_lose_none(spark, tau, parts):
    rng = random.Random(tau * 10 + parts)
    base = [rng.getrandbits(64) for _ in range(12)]
    near = {b ^ sum(1 << x for x in rng.sample(range(24), rng.randrange(7))) for b in base for _ in range(25)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in near)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), tau, parts).collect()}
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b) for a, b in itertools.combinations(values, 2) if bits(a, b) <= tau}


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(40)] + [(5000, 4999), (7, 7)]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["vertex"])
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(1000, 1041)), [4999, 5000]]


def test_one_of_each_group_stays(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(4000)}" for _ in range(300)]
    near = [*words[:150], "changed", *words[151:]]
    rows = [(9, " ".join(words)), (3, " ".join(words)), (4, " ".join(near)), (None, " ".join(words)), (5, " ".join(rng.choice(words) for _ in range(300))),
            (6, ""), (7, None), (8, "unlike all others")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_per_group(df, ["doc_id", "text"]).collect()) == [3, 5, 6, 8]


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def plain_firsts(rows):
    """The least key of each group that links of similarity >= 0.8 form."""
    sets = [plain_set(t) for _, t in rows]
    roots = plain_components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    return sorted({min(k for (k, _), other in zip(rows, roots) if other == r) for r in roots})


def edited(rng, words, edits):
    """The words with single words replaced at even distances; each takes five shingles."""
    out = list(words)
    for at in range(edits):
        out[(at * len(words)) // edits + rng.randrange(3)] = f"new{rng.randrange(10**6)}"
    return out


def test_near_copies_of_least_similarity_are_found(spark):
    rng = random.Random(11)
    rows = []
    for pair in range(150):  # 5 to 7 replaced words of 300 take the similarity to 0.79 to 0.85
        words = [f"w{rng.randrange(2000)}" for _ in range(300)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(edited(rng, words, 5 + pair % 3)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in simhash.one_per_group(df, ["doc_id", "text"]).collect())
    assert got == plain_firsts(rows)


def test_near_copies_do_not_hang_on_one_leader(spark):
    rng = random.Random(13)
    rows = []
    words = [f"w{i}" for i in range(200)]
    for _ in range(30):  # all share their word set; only each two are near copies
        rng.shuffle(words)
        near = [*words[:100], words[101], words[100], *words[102:]]
        rows += [" ".join(words), " ".join(near)]
    for _ in range(3):  # many texts that are less similar than 0.8, some more
        base = [f"v{rng.randrange(2000)}" for _ in range(300)]
        rows += [" ".join(edited(rng, base, rng.randrange(2, 6))) for _ in range(40)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in simhash.one_per_group(df, ["doc_id", "text"]).collect())
    assert got == plain_firsts(rows)


def test_texts_alike_below_the_limit_make_few_pairs(spark, monkeypatch):
    rng = random.Random(17)
    base = [f"v{rng.randrange(2000)}" for _ in range(150)]
    rows = list(enumerate(" ".join(edited(rng, base, rng.randrange(1, 9))) for _ in range(150)))
    made, stored = [], simhash.checkpointed

    def counted(df):
        out = stored(df)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "checkpointed", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in simhash.one_per_group(df, ["doc_id", "text"]).collect())
    assert got == plain_firsts(rows) and len(got) > 50
    assert max(made) <= 3 * len(rows)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 30, 900, 20_000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[size // 8 :], rng.integers(0, 1 << 63, size // 5).astype(np.uint64)]))
        bits = sum(int(x).bit_count() for x in simhash.parities(a) ^ simhash.parities(b))
        assert bits <= len(np.setxor1d(a, b)) and simhash.parities(a).tolist() == simhash.parities(a[::-1].copy()).tolist()


# Token counts and pieces ------------------------------------------------------------------------

STRANGE = ["", " ", "  ", "x'll 'll 're're don't 'tis it''s '", " <|endoftext|> a<|endoftext|><|endoftext|>b", "a" * 3000, " " * 60, "\x00a\x85 z\n\n", "ⅷ²3 日本語🙂", "?!' 's"]


def test_token_counts_equal_the_library(texts):
    path = public_tokenizers.path(transducer.MODEL)
    counter, library = transducer.TokenCounter(*transducer.read_model(path)), Tokenizer.from_file(path)
    every = STRANGE + odd_strings(1500, "abcdehtinosr  '.,é日🙂\n1\t0²_`“", 80) + list(texts.values())
    want = [len(e.ids) for e in library.encode_batch(every, add_special_tokens=False)]
    assert counter.count(every).tolist() == want
    counter.states_limit, counter.limit = 50, 20  # forgetting changes nothing
    assert counter.count(every[:300]).tolist() == want[:300]


def test_chunk_maps_do_not_depend_on_chunks(monkeypatch):
    counter = transducer.TokenCounter(*transducer.read_model(public_tokenizers.path(transducer.MODEL)))
    lines = odd_strings(200, "ab '1 \n.re", 90, seed=5)
    want = counter.count(lines).tolist()
    for size in (1, 3, 64):
        monkeypatch.setattr(transducer, "CHUNK", size)
        assert counter.count(lines).tolist() == want


def test_pieces_equal_the_library(texts):
    path = public_tokenizers.path(pieces.MODEL)
    encoder, library = pieces.Encoder(*pieces.read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in STRANGE + odd_strings(1500, "abcdehtinosr  ▁.é日🙂\n1", 80) + ["▁a ▁ b", "the" * 200, "y" + " " * 40 + "z"] + list(texts.values())[:60]:
        ids = encoder.encode(text).tolist()
        assert ids == library.encode(text)
        assert encoder.decode(ids) == library.decode(ids)
        if "▁" not in text:
            assert encoder.decode(ids) == text


def test_commits_do_not_depend_on_the_stride(monkeypatch):
    encoder = pieces.Encoder(*pieces.read_model(public_tokenizers.path(pieces.MODEL)))
    lines = ["▁" + s for s in odd_strings(200, "abcdehtinosr.é1", 300, seed=9)]
    want = [encoder.stream(s) for s in lines]
    for stride in (1, 7):
        monkeypatch.setattr(pieces, "STRIDE", stride)
        assert [encoder.stream(s) for s in lines] == want


# Quality ----------------------------------------------------------------------------------------

def test_statistics_against_a_plain_count(spark, texts):
    more = ["", "a a a a a", "x y z x y z", "l\nl\n\n \nl\n m", "#$ %| <a>\t&", "a b c d a b c", "p q\x0br\x0cs\rt"]
    every = [*texts.values(), *more, None]
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    for r in quality.add_statistics(df).collect():
        text = every[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        runs = list(zip(words, words[1:], words[2:]))
        often = Counter(runs)
        repeats = {i + k for i, x in enumerate(runs) if often[x] > 1 for k in range(3)}
        assert tuple(r)[1:] == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeats))


def test_outliers_are_rejected_and_clean_rows_kept(spark):
    rng = np.random.default_rng(3)
    rows, bad = [], set()
    for i in range(900):
        words = ["".join(rng.choice(list("abcdefg"), rng.integers(2, 9))) for _ in range(int(rng.integers(60, 400)))]
        if i % 11 == 0:
            bad.add(i)
            words = [w if k % 2 else "|" for k, w in enumerate(words)]
        rows.append((i, " ".join(words), "en" if i % 2 else None, "big" if i % 3 else f"s{i % 30}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["key"]: r for r in quality.rate(df).collect()}
    assert {k for k, r in got.items() if not r["kept"]} == bad
    again = {r["key"]: r["distance"] for r in quality.rate(df.repartition(7)).collect()}
    assert {k: r["distance"] for k, r in got.items()} == pytest.approx(again, abs=1e-5)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([("g", *map(float, r)) for r in data], "group string, " + ", ".join(f"{v} double" for v in quality.VALUES))
    got = [r[0] for r in df.join(quality.spread_of(["group"], df), "group").select(*[quality.distance()]).collect()]
    middle = data - data.mean(axis=0)
    spread = np.cov(data.T, bias=True) * quality.CONSISTENT + np.diag(np.square(quality.FLOORS))
    assert sorted(got) == pytest.approx(sorted(np.einsum("ni,ij,nj->n", middle, np.linalg.inv(spread), middle)), rel=1e-5)


# Toxicity ---------------------------------------------------------------------------------------

def test_held_out_accuracy_of_the_classifier():
    rng = random.Random(1)
    plain = lambda: [rng.choice("abcdefghij") * rng.randrange(2, 5) + rng.choice("klmnop") for _ in range(rng.randrange(5, 80))]
    def one(bad):
        words = plain()
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "vilest", "rotten"]))
        return " ".join(words)

    labels = [i % 4 == 0 for i in range(1200)]
    lines = [one(y) for y in labels]
    net = toxicity.train(lines[:800], [int(y) for y in labels[:800]], 0.25)
    memo = toxicity.WordBuckets()
    scores = toxicity.score_in_blocks(net, (toxicity.word_ids(t, memo) for t in lines[800:]))
    assert np.mean((scores >= 0.5) == np.array(labels[800:])) > 0.97
    # A text is scored alike whatever stands beside it.
    alone = [toxicity.score_docs(net, [toxicity.word_ids(t, memo)])[0] for t in lines[800:820]]
    assert alone == pytest.approx(list(scores[:20]), abs=1e-5)


def test_thresholds_by_language(spark):
    rows = [(i, "en" if i % 2 else "de", (i % 10) / 10) for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    scored = spark.createDataFrame(rows, "key long, language string, score double")
    cut = {"en": 0.6, "de": 0.8}
    labels = spark.createDataFrame([(k, int(s >= cut[lang])) for k, lang, s in rows], "doc_id long, toxic int")
    got = {r["language"]: r["threshold"] for r in toxicity.language_thresholds(scored, labels).collect()}
    wrong = sum((s >= got[lang]) != (s >= cut[lang]) for _, lang, s in rows)
    assert wrong == 0


# Order MinHash ----------------------------------------------------------------------------------

def plain_signature(text, factors):
    items, place = orderhash.numbered_kmers(text)
    short = (items >> np.uint64(32)).astype(np.uint32)
    out = []
    for f in factors:
        value = short * f
        least = sorted(range(len(items)), key=lambda i: (value[i], items[i]))[: orderhash.PICKED]
        total = np.zeros(1, np.uint64)
        for i in sorted(least, key=lambda i: place[i]):
            total = orderhash._mix(total * np.uint64(0x9E3779B97F4A7C15) + items[i])
        out.append(int(total[0] >> np.uint64(32)))
    return out


def test_signatures_against_a_full_sort(texts):
    factors = orderhash.round_factors(16)
    for text in [*list(texts.values())[:12], "abcabcabc" * 30, "short", "x" * 500, "é日🙂" * 40]:
        if len(orderhash.numbered_kmers(text)[0]) >= orderhash.PICKED:
            assert orderhash.signature(text, factors).tolist() == plain_signature(text, factors)


def test_kmers_are_numbered_by_occurrence():
    items, place = orderhash.numbered_kmers("abcdefgh" * 3)
    assert len(set(items.tolist())) == len(items) == 17 and sorted(place.tolist()) == list(range(17))
    assert set(orderhash.numbered_kmers("abcdefgh")[0].tolist()) <= set(items.tolist())


def test_likeness_follows_edits():
    factors = orderhash.round_factors()
    text = " ".join(odd_strings(200, "abcdefghij", 9, seed=3))
    own = orderhash.signature(text, factors)
    near = [orderhash.likeness(own, orderhash.signature(text[: len(text) - k], factors)) for k in (0, 40, 300, len(text) - 9)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3]
    moved = text[len(text) // 2 :] + text[: len(text) // 2]
    assert orderhash.likeness(own, orderhash.signature(moved, factors)) < 0.8


def test_each_document_meets_the_next(spark, texts, docs, monkeypatch):
    monkeypatch.setattr(orderhash, "RANGE_CHARS", 20_000)
    got = {r["doc_id"]: r for r in orderhash.fingerprints(docs).collect()}
    ids = sorted(texts, reverse=True)
    for i, k in enumerate(ids):
        after = texts[ids[(i + 1) % len(ids)]]
        third = len(texts[k]) // 3
        changed = texts[k][: len(texts[k]) - third] + after[:third]
        assert got[k]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[k]["n_chars"] == len(texts[k])
    same = {}
    for k, r in got.items():
        assert same.setdefault(texts[k], r["fingerprint"]) == r["fingerprint"]


# Pipeline ---------------------------------------------------------------------------------------

def test_pipeline_catches_planted_rows(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, TABLES)
    assert kept.columns == corpus_pipeline.COLUMNS
    left = {r["doc_id"] for r in kept.collect()}
    clean = [k for k, y in labels.items() if y == 0]
    assert sum(k in left for k in clean) >= 0.95 * len(clean)
    deduped = corpus_pipeline.drop_near_copies(spark, docs, TABLES).collect()
    assert len({r["text"] for r in deduped}) == len(deduped)
    masked = corpus_pipeline.mask_secrets(spark, docs, TABLES)
    assert masked.count() == docs.count() and not any(secret_spans.base_spans(r["text"] or "") for r in masked.collect())
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, TABLES).collect())
    assert max(mixed.values()) <= 2
    last = corpus_pipeline.encode_pieces(spark, docs, TABLES).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(list(r["ids"]) == library.encode(by_id[r["doc_id"]]) for r in last)


def test_near_fingerprints_are_compared_without_a_common_band(spark, monkeypatch):
    monkeypatch.setattr(simhash, "band_keys", lambda sets: np.array([simhash._turned(x[:1] + np.arange(simhash.BANDS, dtype=np.uint64), 1) * np.uint64(len(x)) for x in sets]))
    words = "a b c d e f g h i".split()
    prints = lambda some: int(simhash.majority(simhash.shingle_set(" ".join(some))))
    last = next(w for w in map(str, range(100_000)) if (prints(words) ^ prints([*words, w])).bit_count() <= simhash.TAU)  # similarity 5/6
    rows = [(2, " ".join([*words, last])), (1, " ".join(words)), (3, "j k l m n o p")]
    kept = simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"])
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert "SortMergeJoin" in kept._jdf.queryExecution().toString()
