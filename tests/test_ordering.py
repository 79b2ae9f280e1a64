"""Ordered operators across bucket edges, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ordered, select
from tallyframe.plans import ordering, quantiles


def table(spark, n=400, groups=1, share=0.5, seed=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": rng.permutation(n) * 3, "g": np.arange(n) % groups, "v": rng.normal(size=n)})
    pdf.loc[rng.random(n) < share, "v"] = np.nan
    df = spark.createDataFrame(pdf)
    return pdf.sort_values("id"), df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("buckets", [1, 7, 60])
def test_positions(spark, buckets):
    pdf, df = table(spark)
    got = ordering.with_position(df, "id", buckets=buckets).select("id", "position").toPandas().sort_values("id")
    assert got["position"].tolist() == list(range(len(pdf)))
    assert got["id"].tolist() == pdf["id"].tolist()


def test_rows_at_and_slices(spark):
    pdf, df = table(spark)
    assert {r["id"] for r in select.rows_at(df, "id", [0, 3, 399], buckets=9).collect()} == set(pdf["id"].iloc[[0, 3, 399]])
    assert select.row_at(df, "id", -1).first()["id"] == pdf["id"].iloc[-1]
    assert [r["id"] for r in select.slice_half_open(df, "id", 2, 5).collect()] == pdf["id"].iloc[2:5].tolist()


def test_far_positions(spark, monkeypatch):
    monkeypatch.setattr(select, "HEAP_ROWS", 10)
    pdf, df = table(spark)
    assert select.row_at(df, "id", 300).first()["id"] == pdf["id"].iloc[300]
    assert select.row_at(df, "id", -300).first()["id"] == pdf["id"].iloc[-300]
    assert select.row_at(df, "id", 5).first()["id"] == pdf["id"].iloc[5]
    got = {r["id"] for r in select.slice_half_open(df, "id", 50, 90).collect()}
    assert got == set(pdf["id"].iloc[50:90])


@pytest.mark.parametrize("buckets", [1, 12])
@pytest.mark.parametrize("groups", [1, 3])
@pytest.mark.parametrize("share", [0.4, 0.97])  # long null runs leave whole buckets empty
def test_linear_matches_pandas(spark, buckets, groups, share):
    pdf, df = table(spark, groups=groups, share=share)
    want = pdf.set_index("id").groupby("g")["v"].transform(lambda s: s.interpolate(method="linear"))
    out = ordered.interpolate(df, "v", "id", ["g"], buckets=buckets)
    got = out.toPandas().set_index("id")["v"].reindex(want.index)
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float), rtol=1e-12)


@pytest.mark.parametrize("method", ["quadratic", "cubic"])
def test_curves_do_not_depend_on_buckets(spark, method):
    _, df = table(spark, share=0.7)
    one, many = (
        ordered.interpolate(df, "v", "id", method=method, buckets=b).toPandas().set_index("id")["v"].sort_index()
        for b in (1, 25)
    )
    np.testing.assert_allclose(one.to_numpy(dtype=float), many.to_numpy(dtype=float), rtol=1e-12)


def test_quadratic_is_exact_on_a_parabola(spark):
    rows = [(i, float(3 * i * i - 2 * i + 1) if i % 4 else None) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id int, v double")
    out = ordered.interpolate(df, "v", "id", method="quadratic", buckets=6).where("v is not null").collect()
    assert len(out) == 59
    assert all(abs(r["v"] - (3 * r["id"] ** 2 - 2 * r["id"] + 1)) < 1e-8 for r in out)


def test_pct_change_after_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 10.0)], "id int, v double")
    got = [r["pct_change"] for r in ordered.pct_change(df, "v", "id", buckets=3).orderBy("id").collect()]
    assert got == [None, None, 1.0]


def test_average_rank_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"v": np.where(rng.random(500) < 0.4, 7, rng.integers(0, 60, 500))})
    got = ordered.average_rank(spark.createDataFrame(pdf), "v", buckets=5).toPandas()
    want = dict(zip(pdf["v"], pdf["v"].rank()))
    assert len(got) == 500
    assert all(want[v] == r for v, r in zip(got["v"], got["average_rank"]))


def test_text_order_is_refused(spark):
    with pytest.raises(TypeError):
        ordering.with_position(spark.createDataFrame([("a",)], "k string"), "k", buckets=2)


@pytest.mark.parametrize("n", [5, 1500])
def test_head_per_group_keeps_the_first_rows(spark, n):
    df = spark.range(6000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")))
    got = select.head_per_group(df, ["g"], "id", n).toPandas()
    want = df.toPandas().sort_values("id").groupby("g").head(n)
    assert sorted(got["id"]) == sorted(want["id"])


@pytest.mark.parametrize("kind", ["long", "double", "timestamp_ntz", "string"])
def test_only_kept_rows_reach_the_window_of_a_large_head(spark, monkeypatch, kind):
    """A hot group of 20,000 rows at n = 5,000; text keys are trimmed in salted parts instead."""
    key = F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")) if kind == "string" else F.col("id")
    if kind == "timestamp_ntz":
        key = F.timestamp_add("SECOND", F.col("id"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, "cold").otherwise(None).alias("g"),
        (key if kind in ("string", "timestamp_ntz") else key.cast(kind)).alias("k"), "id")
    seen = []
    real = select._first_rows
    monkeypatch.setattr(select, "_first_rows", lambda rows, by, order, n: seen.append(rows.count()) or real(rows, by, order, n))
    got = select.head_per_group(df, ["g"], "k", 5_000).toPandas()
    want = df.toPandas().dropna(subset=["g"]).sort_values("id").groupby("g").head(5_000)
    assert sorted(got["id"]) == sorted(want["id"]) and len(got) == 10_000
    assert kind == "string" or seen == [10_000]


def test_large_heads_of_tied_null_and_short_groups(spark):
    rows = [("tied", 1.0, i) for i in range(2_000)] + [("short", float(i), i) for i in range(7)] + [("null", None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, k double, id long")
    got = select.head_per_group(df, ["g"], "k", 1_200).groupBy("g").count().collect()
    assert sorted(tuple(r) for r in got) == [("null", 3), ("short", 7), ("tied", 1_200)]


def test_nth_values_with_narrowed_brackets(spark):
    df = spark.range(40_000).select((F.col("id") % 4).alias("g"), (F.col("id") * 7919 % 40_009).cast("double").alias("v"))
    got = {r["g"]: r["nth"] for r in quantiles.nth_values(df, ["g"], "v", 3_000, few_rows=500).collect()}
    want = df.toPandas().sort_values("v").groupby("g").nth(2_999).set_index("g")["v"].to_dict()
    assert got == want


@pytest.mark.parametrize("method", ordered.METHODS)
@pytest.mark.parametrize("buckets", [1, 6])
def test_rows_tied_in_the_order_follow_their_other_columns(spark, method, buckets):
    """Twelve rows share each time, known and unknown ones: no two of them may be neighbours at distance 0."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": np.arange(600), "t": rng.permutation(600) // 12, "v": rng.normal(size=600)})
    pdf.loc[rng.random(600) < 0.5, "v"] = np.nan
    pdf["place"] = pdf.sort_values(["t", "id"]).assign(place=range(600))["place"]
    df = spark.createDataFrame(pdf).repartition(7, "v").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    want = ordered.interpolate(df, "v", "place", method=method, buckets=1).toPandas().sort_values("id")
    got = ordered.interpolate(df.drop("place"), "v", "t", method=method, buckets=buckets).toPandas().sort_values("id")
    np.testing.assert_allclose(got["v"].to_numpy(float), want["v"].to_numpy(float), rtol=1e-9)


def test_large_tables_are_cut_into_more_buckets_than_asked_for(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 40)
    pdf, df = table(spark)
    rows, n = ordering.place_rows(df, "id", buckets=2)
    assert n == 10 and max(r["count"] for r in rows.groupBy("__bucket").count().collect()) <= 60
    assert rows.toPandas().sort_values("id")["position"].tolist() == list(range(len(pdf)))
