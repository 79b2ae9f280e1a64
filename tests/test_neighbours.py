"""Nearest-row imputation and rank correlation against brute force."""

import numpy as np
import pandas as pd
import pytest

from tallyframe.operators import correlate, impute
from tallyframe.operators.clean import nan_to_null
from tallyframe.plans import spacetree


def brute_knn(pdf, columns, k):
    x, d = pdf[columns].to_numpy(dtype=float), len(columns)
    keep = ~np.isnan(x).all(axis=1)
    x, ids = x[keep], pdf["id"].to_numpy()[keep]
    out = x.copy()
    for i in range(len(x)):
        for c in np.flatnonzero(np.isnan(x[i])):
            shared = ~np.isnan(x) & ~np.isnan(x[i])
            gap = np.where(shared, (x - x[i]) ** 2, 0.0)
            square = gap[:, 0]
            for j in range(1, d):
                square = square + gap[:, j]
            n = shared.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                far = float(d) / n * square
            ok = np.flatnonzero((n > 0) & ~np.isnan(x[:, c]))
            best = sorted(ok, key=lambda j: (far[j], ids[j]))[:k]
            out[i, c] = x[best, c].mean() if best else np.nanmean(x[:, c])
    return dict(zip(ids, map(tuple, out)))


def points(kind):
    rng = np.random.default_rng(11)
    n = 300
    if kind == "even":
        x = rng.random((n, 3)) * [1, 10, 100]
    elif kind == "dense_spot":  # a third of the rows crowd one place, a few lie far away
        x = rng.random((n, 3)) * 1000
        x[: n // 3] = 5 + rng.random((n // 3, 3)) * 1e-4
        x[-3:] = 1e6 + rng.random((3, 3))
    else:  # repeated points
        x = rng.integers(0, 3, (n, 3)).astype(float)
    x[rng.random((n, 3)) < 0.2] = np.nan
    return pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(n))


@pytest.mark.parametrize("kind", ["even", "dense_spot", "repeated"])
def test_knn_matches_brute_force(spark, kind):
    pdf = points(kind)
    df = nan_to_null(spark.createDataFrame(pdf))
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in impute.knn_impute(df, ["a", "b", "c"], "id", 4, leaf_rows=10).collect()}
    want = brute_knn(pdf, ["a", "b", "c"], 4)
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, rel=1e-9)


def test_knn_with_ten_columns_of_random_nulls(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(250, 10))
    x[:2] *= 1e6
    x[rng.random(x.shape) < 0.12] = np.nan
    names = list("abcdefghij")
    pdf = pd.DataFrame(x, columns=names).assign(id=np.arange(len(x)))
    df = nan_to_null(spark.createDataFrame(pdf))
    got = {r["id"]: tuple(r[c] for c in names) for r in impute.knn_impute(df, names, "id", 3, leaf_rows=8).collect()}
    want = brute_knn(pdf, names, 3)
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, rel=1e-9)


@pytest.mark.parametrize("kind", ["spread", "hot", "far"])
def test_tree_leaves_are_bounded(spark, kind):
    """Every point is in one leaf, inside its box; hot values and far rows leave no large leaf."""
    rng = np.random.default_rng(3)
    x = rng.random((6_000, 2))
    if kind == "hot":
        x[:4_000, 0] = 0.5
    if kind == "far":
        x[:6] *= 1e9
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(len(x)), mask="11")
    placed, levels = spacetree.grow(spark.createDataFrame(pdf), ["a", "b"], "mask", 40)
    got = placed.toPandas()
    assert sorted(got["id"]) == list(range(6_000))
    boxes = {r["__node"]: r for level in levels for r in level.where("__leaf").collect()}
    for node, part in got.groupby("__node"):
        box = boxes.pop(node)
        assert len(part) == box["__n"] <= 40
        assert (part[["a", "b"]].min().to_numpy() == box["__lo"]).all()
        assert (part[["a", "b"]].max().to_numpy() == box["__hi"]).all()
    assert not boxes and len(levels) <= 6


def test_knn_counts_nan_as_missing_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.5, float("nan")), (3, 9.0, 7.0)], "id int, a double, b double")
    got = {r["id"]: r["b"] for r in impute.knn_impute(df, ["a", "b"], "id", 1).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: 7.0}
    assert impute.knn_impute(df.where("id > 9"), ["a", "b"], "id", 1).collect() == []


def test_knn_without_comparable_donor_takes_the_mean(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0), (3, None, 6.0), (4, None, None)], "id int, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in impute.knn_impute(df, ["a", "b"], "id", 2).collect()}
    assert got == {1: (1.0, 5.0), 2: (1.0, 4.0), 3: (1.0, 6.0)}


def brute_tau(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (dx * dy).sum() / np.sqrt((dx**2).sum() * (dy**2).sum())


@pytest.mark.parametrize("task_rows", [10**6, 60, 7])
@pytest.mark.parametrize("kind", ["smooth", "ties", "hot"])
def test_kendall_matches_all_pairs(spark, task_rows, kind):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 400))
    y = y + 0.5 * x
    if kind == "ties":
        x, y = np.round(x), np.round(y * 2)
    if kind == "hot":
        x[rng.random(400) < 0.35] = 0.125
        y[rng.random(400) < 0.35] = -0.5
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert correlate.corr_kendall(df, "x", "y", task_rows) == pytest.approx(brute_tau(x, y), rel=1e-12)


@pytest.mark.parametrize("buckets", [1, 6])
def test_spearman_matches_pandas(spark, buckets):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": rng.integers(0, 40, 500).astype(float), "y": rng.normal(size=500)})
    pdf["y"] += pdf["x"] / 10
    pdf.loc[::9, "y"] = None
    want = pdf.dropna()["x"].rank().corr(pdf.dropna()["y"].rank())
    got = correlate.corr_spearman(nan_to_null(spark.createDataFrame(pdf)), "x", "y", buckets)
    assert got == pytest.approx(want, rel=1e-12)


def test_correlation_of_too_few_rows_is_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "x double, y double")
    assert [correlate.corr_pair(df, "x", "y", m) for m in correlate.METHODS] == [None, None, None]
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert correlate.corr_pair(flat, "x", "y", "kendall") is None
    assert correlate.corr_pair(flat, "x", "y", "spearman") is None
