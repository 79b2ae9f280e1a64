"""Every operator and the pipeline on null, empty, tied, repeated and very long rows, and on empty tables."""

import pytest

import corpus_pipeline
from tallyframe.llm.queries import QUERIES


@pytest.mark.parametrize("name", [q for q in QUERIES if q != "op13_setm"])  # that one has no row per document
def test_odd_rows(name, spark, odd_dir):
    table, key = ("pages", "page_id") if name == "op1_warc" else ("documents", "doc_id")
    want = sorted(str(r[0]) for r in spark.read.parquet(f"{odd_dir}/{table}.parquet").select(key).collect())
    rows = QUERIES[name](spark, odd_dir).collect()
    assert sorted(str(r[key]) for r in rows) == want


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_table(name, spark, empty_dir):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_pipeline_on_odd_rows(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == corpus_pipeline.COLUMNS, name
        out.collect()
    rows = corpus_pipeline.run(spark, odd_dir).collect()
    assert all(r["n_pieces"] == len(r["ids"]) for r in rows)


def test_pipeline_on_an_empty_table(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
