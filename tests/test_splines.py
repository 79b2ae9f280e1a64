"""Whole-column splines against dense solvers."""

import numpy as np
import pandas as pd
import pytest

from tallyframe.operators import ordered, splines
from tallyframe.operators.clean import nan_to_null


def dense(x, y, at, method):
    """The curve as a sum of powers and truncated powers, by one dense system."""
    degree = {"quadratic": 2, "cubic": 3}[method]
    knots = x[2:-2] if degree == 3 else ((x[1:] + x[:-1]) / 2)[1:-1]
    scale = x[-1] - x[0]

    def basis(t):
        t = (np.asarray(t) - x[0]) / scale
        powers = [t**i for i in range(degree + 1)]
        return np.stack(powers + [np.clip(t - (k - x[0]) / scale, 0, None) ** degree for k in knots], axis=1)

    out = basis(at) @ np.linalg.solve(basis(x), y)
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)


def slopes(x, y, method):
    """All slopes by one dense solve."""
    n, h = len(x), np.diff(x)
    s, k = np.diff(y) / h, {"quadratic": 3, "cubic": 2}[method]
    m, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = 1 / h[i - 1], k * (1 / h[i - 1] + 1 / h[i]), 1 / h[i]
        r[i] = (k + 1) * (s[i - 1] / h[i - 1] + s[i] / h[i])
    if method == "quadratic":
        m[0, :2], m[-1, -2:], r[0], r[-1] = 1, 1, 2 * s[0], 2 * s[-1]
    else:
        a, b = h[0] + h[1], h[-1] + h[-2]
        m[0, :2], r[0] = (h[1], a), ((h[0] + 2 * a) * h[1] * s[0] + h[0] ** 2 * s[1]) / a
        m[-1, -2:], r[-1] = (b, h[-2]), ((h[-1] + 2 * b) * h[-2] * s[-1] + h[-1] ** 2 * s[-2]) / b
    return np.linalg.solve(m, r)


def table(n, seed, hole=0.4):
    rng = np.random.default_rng(seed)
    v = np.cumsum(rng.normal(size=n))
    v[rng.random(n) < hole] = np.nan
    v[:2] = v[-1:] = np.nan
    return pd.DataFrame({"t": np.arange(n) * 3 + 7, "v": v})


@pytest.mark.parametrize("method", ["quadratic", "cubic"])
@pytest.mark.parametrize("buckets", [1, 4])
def test_spline_is_the_smooth_curve_through_all_points(spark, method, buckets):
    pdf = table(30, 5)
    df = nan_to_null(spark.createDataFrame(pdf))
    got = splines.spline(df, "v", "t", method=method, buckets=buckets).orderBy("t").toPandas()["v"].to_numpy(float)
    known, at = pdf["v"].notna().to_numpy(), np.arange(30.0)
    np.testing.assert_allclose(got, dense(at[known], pdf["v"][known].to_numpy(), at, method), rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("method", ["quadratic", "cubic"])
@pytest.mark.parametrize("buckets", [1, 4, 50])
def test_slopes_in_buckets_solve_the_whole_system(spark, method, buckets):
    pdf = table(1_000, 8)
    df = nan_to_null(spark.createDataFrame(pdf))
    rows, n = splines.place_rows(df, "t", (), buckets, "__x")
    rows = rows.withColumn("__x", rows["__x"].cast("double")).withColumnRenamed("v", "__y").where("__y is not null")
    got = splines._slopes(rows.select("__bucket", "__x", "__y"), [], n, method).orderBy("__x").toPandas()
    known = pdf["v"].notna().to_numpy()
    want = slopes(np.flatnonzero(known).astype(float), pdf["v"][known].to_numpy(), method)
    np.testing.assert_allclose(got["__slope"], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("method", ["quadratic", "cubic"])
@pytest.mark.parametrize("buckets", [1, 5])
def test_groups_are_solved_apart_and_small_ones_left(spark, method, buckets):
    parts = [table(40, 1).assign(g="a"), table(25, 2).assign(g=None), table(9, 3, 0).assign(g="c")]
    parts[2].loc[splines.LEAST[method] + 1 :, "v"] = np.nan  # one known value too few
    pdf = pd.concat(parts, ignore_index=True)
    pdf["t"] = np.arange(len(pdf)) * 2
    df = nan_to_null(spark.createDataFrame(pdf, "t long, v double, g string"))
    out = splines.spline(df, "v", "t", ["g"], method, buckets, "filled").orderBy("t").toPandas()
    assert list(out.columns) == ["t", "v", "g", "filled"] and len(out) == len(pdf)
    at = 0
    for part in parts:
        got = out["filled"].to_numpy(float)[at : at + len(part)]
        at += len(part)
        known = part["v"].notna().to_numpy()
        if known.sum() < splines.LEAST[method]:
            np.testing.assert_array_equal(got, part["v"])
            continue
        x = np.arange(len(part), dtype=float)
        np.testing.assert_allclose(got, dense(x[known], part["v"][known].to_numpy(), x, method), rtol=1e-5, atol=1e-5)


def test_empty_table_and_unknown_method(spark):
    df = spark.createDataFrame([], "t long, v double")
    assert splines.spline(df, "v", "t").collect() == []
    with pytest.raises(ValueError):
        splines.spline(df, "v", "t", method="linear")


@pytest.mark.parametrize("method", ordered.METHODS)
def test_interpolate_keeps_groups_with_a_null_key(spark, method):
    pdf = pd.concat([table(40, 1).assign(g="a"), table(25, 2).assign(g=None)], ignore_index=True)
    pdf["t"] = np.arange(len(pdf)) * 2
    df = nan_to_null(spark.createDataFrame(pdf, "t long, v double, g string"))
    whole, cut = (ordered.interpolate(df, "v", "t", ["g"], method, n).orderBy("t").toPandas() for n in (1, 5))
    assert len(whole) == len(cut) == len(pdf)
    np.testing.assert_allclose(cut["v"], whole["v"], rtol=1e-9)


@pytest.mark.parametrize("method", ["quadratic", "cubic"])
@pytest.mark.parametrize("buckets", [1, 6])
def test_splines_through_rows_tied_in_the_order(spark, method, buckets):
    """Twelve rows share each time, known and unknown ones: they follow each other by id."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": np.arange(600), "t": rng.permutation(600) // 12, "v": rng.normal(size=600)})
    pdf.loc[rng.random(600) < 0.5, "v"] = np.nan
    pdf["place"] = pdf.sort_values(["t", "id"]).assign(place=range(600))["place"]
    df = nan_to_null(spark.createDataFrame(pdf).repartition(7, "v"))
    want = splines.spline(df, "v", "place", method=method, buckets=1).toPandas().sort_values("id")
    got = splines.spline(df.drop("place"), "v", "t", method=method, buckets=buckets).toPandas().sort_values("id")
    np.testing.assert_allclose(got["v"].to_numpy(float), want["v"].to_numpy(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("method", ["quadratic", "cubic"])
@pytest.mark.parametrize("buckets", [1, 4])
def test_no_worker_eliminates_more_than_a_stretch(spark, monkeypatch, method, buckets):
    real = splines._eliminate

    def bounded(keys):
        solve = real(keys)

        def checked(part: pd.DataFrame) -> pd.DataFrame:
            if len(part) > 64:
                raise ValueError(f"{len(part)} lines in one call")
            return solve(part)

        return checked

    monkeypatch.setattr(splines, "STRETCH_ROWS", 64, raising=False)
    monkeypatch.setattr(splines, "_eliminate", bounded)
    pdf = table(1_000, 8)
    rows, n = splines.place_rows(nan_to_null(spark.createDataFrame(pdf)), "t", (), buckets, "__x")
    rows = rows.withColumn("__x", rows["__x"].cast("double")).withColumnRenamed("v", "__y").where("__y is not null")
    got = splines._slopes(rows.select("__bucket", "__x", "__y"), [], n, method).orderBy("__x").toPandas()
    known = pdf["v"].notna().to_numpy()
    want = slopes(np.flatnonzero(known).astype(float), pdf["v"][known].to_numpy(), method)
    np.testing.assert_allclose(got["__slope"], want, rtol=1e-9, atol=1e-9)
