"""Chunked JSON arrays against the json module, with cuts at every byte."""

import json
import random

import numpy as np
import pytest

from tallyframe.sources import json_array

RECORDS = [
    {"id": 1, "t": 'brace } and { quote " and \\ end\\\\'}, {"id": 2, "t": "[]{},:"}, {"id": 3, "t": "é 日本 🙂"}, {"id": 4, "t": None},
    {"id": 5, "t": "\\\"\\\\\"{"}, {"id": 6, "t": "", "more": {"a": [1, {"b": "}"}], "c": []}}, {"id": 7, "t": "x" * 90},
]
KIND = "id long, t string"


def expected(records):
    return sorted((r["id"], r["t"]) for r in records)


def read(spark, path, chunk):
    return [tuple(r) for r in json_array.read_json_array(spark, str(path), KIND, chunk).collect()]


def test_states_compose_at_every_cut():
    text = json.dumps(RECORDS, ensure_ascii=False, indent=1).encode()
    whole, end = json_array.scan(np.frombuffer(text, np.uint8), json_array.OUTSIDE)
    assert whole.sum() == 0 and end == json_array.OUTSIDE
    for cut in range(len(text) + 1):
        first, state = json_array.scan(np.frombuffer(text[:cut], np.uint8), json_array.OUTSIDE)
        second, end = json_array.scan(np.frombuffer(text[cut:], np.uint8), state)
        assert end == json_array.OUTSIDE and np.array_equal(np.concatenate([first, second]), whole)


def test_elements_at_every_cut():
    text = json.dumps(RECORDS).encode()
    for cut in range(1, len(text)):
        first, state = json_array.scan(np.frombuffer(text[:cut], np.uint8), json_array.OUTSIDE)
        left, rest = json_array.elements(text[:cut], json_array.OUTSIDE, 0, cut)
        right, _ = json_array.elements(text[cut:], state, int(first.sum()), len(text))
        open_ = [] if rest is None else json_array.elements(text[rest:], json_array.OUTSIDE, 1, 1)[0]
        assert [json.loads(e) for e in left + open_ + right] == RECORDS


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_files_and_chunks(spark, tmp_path, monkeypatch, chunk, indent):
    monkeypatch.setattr(json_array, "TAIL_BYTES", 5)
    (tmp_path / "a.json").write_text(json.dumps(RECORDS, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text("  [ ]\n")
    (tmp_path / "c.json").write_text(json.dumps([RECORDS[0], 5, "x{", None, RECORDS[1]]))
    (tmp_path / "d.json").write_text("")
    got = read(spark, tmp_path, chunk)
    key = lambda r: (r[0], str(r[1]))
    assert sorted(got, key=key) == sorted([(r["id"], r["t"]) for r in RECORDS + RECORDS[:2]], key=key)


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    records = [{"id": i, "t": "".join(rng.choice('ab{}[]"\\,: é') for _ in range(rng.randrange(40)))} for i in range(5_000)]
    (tmp_path / "a.json").write_text(json.dumps(records))
    rows = json_array.read_json_array(spark, str(tmp_path), KIND, 20_000)
    assert sorted(tuple(r) for r in rows.collect()) == expected(records)
    assert rows.rdd.getNumPartitions() > 10


def test_written_arrays_come_back(spark, tmp_path):
    df = spark.createDataFrame(expected(RECORDS[:3]), KIND).repartition(5)
    json_array.write_json_arrays(df, str(tmp_path / "out"))
    assert sorted(read(spark, tmp_path / "out", 30)) == expected(RECORDS[:3])
    assert all(json.loads(p.read_text()) is not None for p in (tmp_path / "out").glob("part-*"))
