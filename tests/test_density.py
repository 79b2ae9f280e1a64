"""The kernel density against plain sums over all rows."""

import numpy as np
import pandas as pd
import pytest

from tallyframe.operators import aggregate


def plain(values, points):
    band = values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min(), values.max(), points)
    return x, np.exp(-(((x[:, None] - values) / band) ** 2) / 2).sum(axis=1) / (len(values) * band * np.sqrt(2 * np.pi)), band


SAMPLES = {
    "normal": lambda r: r.normal(size=3000),
    "far_outlier": lambda r: np.append(r.normal(size=3000), 1e9),
    "skewed": lambda r: np.exp(r.normal(0, 2, 3000)),
    "two_values": lambda r: np.repeat([3.0, 8.0], [5, 900]),
}


@pytest.mark.parametrize("kind", list(SAMPLES))
@pytest.mark.parametrize("points", [2, 50])
def test_curve(spark, kind, points):
    values = SAMPLES[kind](np.random.default_rng(4))
    x, density, band = plain(values, points)
    got = aggregate.density_curve(spark.createDataFrame(pd.DataFrame({"v": values})), "v", points).orderBy("point").toPandas()
    assert got["x"].to_numpy() == pytest.approx(x)
    assert np.abs(got["density"].to_numpy() - density).max() <= 1e-9 / (band * np.sqrt(2 * np.pi)) + 1e-15


def test_an_outlier_does_not_blur_the_rest(spark):
    """The grid point at the rows keeps their whole density, whatever the range."""
    values = np.append(np.zeros(1000) + np.arange(1000) % 2, 1e7)
    x, density, _ = plain(values, 20)
    got = aggregate.density_curve(spark.createDataFrame(pd.DataFrame({"v": values})), "v", 20).orderBy("point").toPandas()
    assert got["density"][0] == pytest.approx(density[0], rel=1e-8)


def test_no_spread_and_nulls(spark):
    assert aggregate.density_curve(spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double"), "v").count() == 0
    assert aggregate.density_curve(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"), "v").count() == 0
    with_null = aggregate.density_curve(spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double"), "v", 3).orderBy("point").toPandas()
    assert with_null["density"].to_numpy() == pytest.approx(plain(np.array([1.0, 2.0]), 3)[1])
