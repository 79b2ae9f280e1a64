"""Tall-skinny least squares against numpy on ordinary and degenerate features."""

import math

import numpy as np
import pandas as pd
import pytest

from tallyframe.operators import model


def columns(kind, n=400):
    rng = np.random.default_rng(11)
    a, b, c = rng.normal(size=(3, n))
    y = 2 + 3 * a - b + rng.normal(size=n)
    made = {
        "plain": {"a": a, "b": b},
        "double": {"a": a, "b": 2 * a},
        "sum": {"a": a, "b": b, "c": a + b},
        "constant": {"a": a, "b": np.full(n, 7.0)},
        "zero": {"a": a, "b": np.zeros(n)},
        "units": {"a": a * 1e8, "b": b * 1e-6, "c": c + 1e5},
        "twice": {"a": a, "b": a, "c": a},
    }[kind]
    return pd.DataFrame({**made, "y": y})


def plain(pdf, features):
    """(params, errors, rank) by the pseudo-inverse, on columns of equal length where none depends on others."""
    x = np.column_stack([np.ones(len(pdf)), *[pdf[c] for c in features]])
    lengths = np.maximum(np.linalg.norm(x, axis=0), 1e-300)
    rank = np.linalg.matrix_rank(x / lengths)
    if rank == x.shape[1]:
        inverse = np.linalg.pinv(x / lengths) / lengths[:, None]
    else:
        u, s, v = np.linalg.svd(x, full_matrices=False)
        inverse = (v[:rank].T / s[:rank]) @ u[:, :rank].T
    params = inverse @ pdf["y"].to_numpy()
    rest = pdf["y"] - x @ params
    return params, np.sqrt((rest**2).sum() / (len(pdf) - rank) * np.diag(inverse @ inverse.T)), rank


@pytest.mark.parametrize("kind", ["plain", "double", "sum", "constant", "zero", "units", "twice"])
@pytest.mark.parametrize("parts", [1, 9])
def test_parameters_and_errors(spark, monkeypatch, kind, parts):
    monkeypatch.setattr(model, "FAN_IN", 2)
    pdf = columns(kind)
    features = [c for c in pdf.columns if c != "y"]
    fitted = model.ols_fit(spark.createDataFrame(pdf).repartition(parts), "y", features)
    params, errors, rank = plain(pdf, features)
    assert fitted.rank == rank and fitted.n == len(pdf) and fitted.freedom == len(pdf) - rank
    assert fitted.params == pytest.approx(params.tolist(), rel=1e-9, abs=1e-9)
    assert fitted.std_errors == pytest.approx(errors.tolist(), rel=1e-9, abs=1e-9)


def test_reports_on_collinear_features(spark):
    pdf = columns("double")
    fitted = model.ols_fit(spark.createDataFrame(pdf), "y", ["a", "b"])
    report = {r["name"]: r["value"] for r in model.ols_summary(fitted).collect()}
    alone = {r["name"]: r["value"] for r in model.ols_summary(model.ols_fit(spark.createDataFrame(pdf), "y", ["a"])).collect()}
    assert math.isinf(report.pop("condition_number")) and alone.pop("condition_number") < 10
    assert report == pytest.approx(alone, rel=1e-9)
    rows = {r["feature"]: r for r in model.ols_coefficients(fitted).collect()}
    assert rows["b"]["coefficient"] == pytest.approx(2 * rows["a"]["coefficient"]) and rows["a"]["p_value"] < 1e-6


def test_few_rows_and_no_rows(spark):
    two = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "a double, y double")
    fitted = model.ols_fit(two, "y", ["a"])
    assert fitted.params == pytest.approx([-1, 2]) and fitted.freedom == 0
    assert all(math.isnan(r["t"]) for r in model.ols_coefficients(fitted).collect())
    with pytest.raises(ValueError):
        model.ols_fit(two.limit(0), "y", ["a"])
    nulls = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, y double")
    with pytest.raises(ValueError):
        model.ols_fit(nulls, "y", ["a"])


def test_null_values_take_the_mean(spark):
    rows = [(float(i), None if i % 5 == 0 else 2.0 * i + 1) for i in range(60)]
    fitted = model.ols_fit(spark.createDataFrame(rows, "a double, y double"), "y", ["a"])
    pdf = pd.DataFrame(rows, columns=["a", "y"])
    pdf["y"] = pdf["y"].fillna(pdf["y"].mean())
    assert fitted.params == pytest.approx(plain(pdf, ["a"])[0].tolist())
