"""Phrase mining against a plain count of all phrases."""

import os
import random
import re
import urllib.parse
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyframe.llm import collocations

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) by counting every phrase."""
    f, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n, frequent = totals[lang], {p: a for p, a in counts.items() if a >= least}
        scored = []
        for p, a in frequent.items():
            if len(p) == 1:
                continue
            longer = [q for q, c in frequent.items() if len(q) > len(p) and 100 * c >= 100 * a]
            if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def mined(df, **how):
    top = how.pop("top", collocations.TOP)
    return sorted(tuple(r) for r in collocations.top_phrases(collocations.mine_phrases(df, **how), top).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["Red", "green", "BLUE", "sky", "É", "naïve", "x y", "日本"]
    out = []
    for i in range(260):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n", "!"]) for _ in range(rng.randrange(60)))
        out.append((("en", "de", None, "und")[i % 4], text + " New york city hall" * (i % 5) + "; the end of it" * (i % 3 == 0)))
    return out + [("en", None), (None, ""), ("en", " \n.;")] + out[:7]


def test_phrases_equal_a_plain_count(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    assert mined(df, least=12) == plain(rows, 12, 5, 2_000)
    assert mined(df, least=12, top=3) == plain(rows, 12, 5, 3)
    assert mined(df, least=2, longest=3) == plain(rows, 2, 3, 2_000)


def test_blocks_and_partitions_do_not_matter(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 40)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert mined(df, least=12) == plain(rows, 12, 5, 2_000)


def test_without_broadcast_joins(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert mined(spark.createDataFrame(rows, "lang string, text string"), least=12) == plain(rows, 12, 5, 2_000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlaps_count_and_the_parts_of_a_longer_phrase_go(spark):
    df = spark.createDataFrame([("en", "a a a a a a"), ("en", "p q r. " * 5)], "lang string, text string")
    assert [r[2] for r in mined(df, least=5)] == ["p q r", "a a"]
    assert [r[2] for r in mined(df, least=6)] == []


def test_no_frequent_phrase_and_no_rows(spark):
    assert mined(spark.createDataFrame([("en", "a b c d")], "lang string, text string")) == []
    assert mined(spark.createDataFrame([], "lang string, text string")) == []


def test_scores_pass_64_bits(spark):
    big = spark.createDataFrame([(4 * 10**14, 2 * 10**15, 4 * 10**14, 10**15)], "a long, n long, l long, r long")
    score = collocations.score(*(collocations.F.col(c) for c in ("a", "n", "l", "r")))
    assert big.select(score.alias("s")).first()["s"] == 2_000


def test_pieces():
    assert collocations.pieces_of("A b,,C\td e\x0cF É") == [[b"a", b"b"], [b"c", "d e".encode()], [b"f", "É".encode()]]


def test_query_equals_its_sql_on_odd_rows(spark, odd_dir):
    import duckdb

    rows = collocations.op13_setm(spark, odd_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd_dir}/documents.parquet/*.parquet')")
    want = con.execute(collocations.OP13_SQL)
    assert [c[0] for c in want.description] == rows.columns
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want.fetchall()) != []


def test_spent_stage_tables_are_deleted_and_words_meet_no_join(spark, rows, monkeypatch):
    made, stored = [], collocations.checkpointed

    def noted(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = stored(df)
        made.append((out.columns, [urllib.parse.urlparse(f).path for f in out.inputFiles()], plan))
        return out

    monkeypatch.setattr(collocations, "checkpointed", noted)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert mined(df, least=12) == plain(rows, 12, 5, 2_000)
    spent = [files for columns, files, _ in made if "block" in columns]
    assert len(spent) > 4 and not any(os.path.exists(f) for files in spent for f in files)
    assert not any("Join" in plan for columns, _, plan in made if "word" in columns)


def test_places_take_little_room_and_come_back():
    places = np.arange(100_000) + np.repeat(np.arange(5_000), 20)
    codes = np.random.default_rng(5).zipf(1.3, 100_000) % 40_000
    for numbers in (places, codes, places[:1], codes[:0], np.array([3, 3, 3]), np.array([2**31 - 1, 0])):
        assert collocations.unpack(collocations.pack(numbers), len(numbers)).tolist() == numbers.tolist()
    assert len(collocations.pack(places)) < 5_000
