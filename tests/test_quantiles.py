"""The counting search for exact quantiles against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.plans import fitting, quantiles
from tallyframe.plans.sizing import checkpointed

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
WANTED = {f"q{i}": ("v", p) for i, p in enumerate(PROBS)}


def few(monkeypatch, rows):
    """Narrow every bracket of more rows."""
    monkeypatch.setattr(quantiles.refined_quantiles, "__defaults__", (None, rows))


def count_scans(monkeypatch):
    """A list that grows with each aggregate over the table."""
    scans = []
    real = quantiles.hold_small
    monkeypatch.setattr(quantiles, "hold_small", lambda df: scans.append(1) or real(df))
    return scans


def samples():
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(5000) < 0.34, 3.25, rng.normal(size=5000))
    return {
        "even": rng.random(5000),
        "heavy_tail": np.exp(rng.normal(0, 12, 5000)),
        "hot_value": hot,
        "cluster": np.where(rng.random(5000) < 0.5, 1 + rng.random(5000) * 1e-9, rng.random(5000) * 1e9),
        "negative": -np.exp(rng.normal(0, 4, 5000)),
        "powers": 10.0 ** np.linspace(-300, 300, 5000),
        "tiny": np.concatenate([rng.random(2500) * 1e-310, -rng.random(2500) * 1e-310]),
        "infinite": np.concatenate([np.full(10, -np.inf), rng.normal(size=4980), np.full(10, np.inf)]),
        "constant": np.full(500, 2.5),
        "one": np.array([4.0]),
        "two": np.array([4.0, 9.0]),
    }


def between(ordered, p):
    """Linear interpolation; equal neighbours, infinite ones too, need none."""
    at = p * (len(ordered) - 1)
    low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
    return low if low == high else low + (high - low) * (at - np.floor(at))


@pytest.mark.parametrize("kind", list(samples()))
def test_against_numpy(spark, monkeypatch, kind):
    values = samples()[kind]
    few(monkeypatch, 50)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = fitting.fit(df, {"n": F.count("v")}, WANTED)
    want = [between(np.sort(values), p) for p in PROBS]
    assert got["n"] == len(values)
    assert [got[k] for k in WANTED] == pytest.approx(list(want), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("held", [True, False])
def test_groups_with_a_hot_group(spark, monkeypatch, held):
    rng = np.random.default_rng(3)
    group = np.where(rng.random(6000) < 0.6, "hot", rng.choice(list("abcde"), 6000))
    pdf = pd.DataFrame({"g": group, "v": rng.normal(size=6000), "w": rng.integers(0, 9, 6000).astype(float)})
    pdf.loc[::17, "v"] = None
    if not held:  # as with more groups than the driver may hold
        monkeypatch.setattr(quantiles, "hold_small", lambda df, limit=0: (checkpointed(df), False))
        monkeypatch.setattr(fitting, "hold_small", lambda df, limit=0: (checkpointed(df), False))
    few(monkeypatch, 200)
    df = spark.createDataFrame(pdf)
    df = df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    wanted = {"v1": ("v", 0.25), "v2": ("v", 0.5), "w2": ("w", 0.5)}
    got = fitting.fit_by(df, ["g"], {"n": F.count("*")}, wanted).toPandas().set_index("g").sort_index()
    groups = pdf.groupby("g")
    assert got["n"].to_dict() == groups.size().to_dict()
    for name, (c, p) in wanted.items():
        assert got[name].to_dict() == pytest.approx(groups[c].quantile(p).to_dict(), rel=1e-12)


def test_all_null_and_empty(spark):
    empty = spark.createDataFrame([], "v double")
    nulls = spark.createDataFrame([(None,), (None,)], "v double")
    for df in (empty, nulls):
        assert fitting.fit(df, quantiles=WANTED) == dict.fromkeys(WANTED)


@pytest.mark.parametrize("kind", list(samples()))
def test_two_scans_on_ordinary_data(spark, monkeypatch, kind):
    values = samples()[kind]
    scans = count_scans(monkeypatch)
    fitting.fit(spark.createDataFrame(pd.DataFrame({"v": values})), {"n": F.count("v")}, WANTED)
    assert len(scans) == 2


def test_three_scans_on_hostile_data(spark, monkeypatch):
    values = np.concatenate([10.0 ** np.linspace(-300, 300, 3000), 1 + np.arange(3000) * 2.0**-52, [np.inf, np.nan]])
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(3)
    scans = count_scans(monkeypatch)
    few(monkeypatch, 60)
    got = fitting.fit(df, quantiles={"mid": ("v", 0.5), "low": ("v", 0.0), "top": ("v", 1.0)})
    ordered = np.sort(values)  # NaN last
    assert got["low"] == ordered[0] and np.isnan(got["top"])
    assert got["mid"] == pytest.approx(between(ordered, 0.5), rel=1e-15)
    assert len(scans) <= 3


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    """Brackets of no width around the wrong ranks still end in the exact values."""
    values = samples()["even"]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    real = quantiles.Search.brackets

    def wrong(self, sketched=True):
        columns = real(self, sketched)
        if not sketched:
            return columns
        return [f"0.5D AS {c.rsplit(' ', 1)[1]}" if " AS __lo" in c or " AS __hi" in c else c for c in columns]

    monkeypatch.setattr(quantiles.Search, "brackets", wrong)
    scans = count_scans(monkeypatch)
    got = fitting.fit(df, quantiles=WANTED)
    assert [got[k] for k in WANTED] == pytest.approx([between(np.sort(values), p) for p in PROBS], rel=1e-12)
    assert len(scans) == 3


def test_nan_is_the_greatest(spark):
    values = np.concatenate([np.full(4000, np.nan), np.arange(6000.0), [np.inf]])
    got = fitting.fit(spark.createDataFrame([(float(v),) for v in values], "v double"), quantiles={"a": ("v", 0.3), "b": ("v", 0.7), "c": ("v", 0.6)})
    assert got["a"] == 3000.0 and np.isnan(got["b"]) and got["c"] == np.inf


def test_many_groups(spark, monkeypatch):
    df = spark.range(60_000).select((F.col("id") % 20_001).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    df = df.union(spark.range(20_000).select(F.lit(5).cast("long"), F.lit(3.0)))  # one hot group
    got = fitting.fit_by(df, ["g"], {"n": F.count("*")}, {"m": ("v", 0.5)})
    want = df.groupBy("g").agg(F.percentile("v", 0.5).alias("w"))
    assert got.join(want, "g").where("m <> w").count() == 0
    assert got.count() == 20_001


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_hot_key_is_dealt_out(spark, how):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(-1)).when(F.col("id") % 5 != 0, F.col("id") % 20_001).alias("g"), F.col("id").alias("v"))
    stats = rows.na.drop().groupBy("g").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    joined = fitting.join_stats(rows, stats, ["g"], how, limit=100, hot_rows=1_000)
    plain = rows.join(stats, "g", how)
    assert joined.columns == plain.columns
    total = lambda df: df.agg(F.count("*"), F.sum("v"), F.sum(F.col("s") % 1009), F.sum("n")).first()
    assert total(joined) == total(plain)
    spread = joined.groupBy("g", F.spark_partition_id().alias("p")).count().where("g = -1").collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 25_000
