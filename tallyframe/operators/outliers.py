"""Outlier bounds, summaries and treatments (1.5 times the quartile range)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scalar import clip, shifted_log
from tallyframe.operators.select import filter_outside_bounds, top_k
from tallyframe.plans.fitting import fit, fit_by, join_stats
from tallyframe.plans.sizing import small_table

_QUARTILES = (("q1", 0.25), ("q3", 0.75))


def _bounds() -> dict[str, Column]:
    iqr = F.col("q3") - F.col("q1")
    return {
        "iqr": iqr,
        "lower_bound": F.col("q1") - 1.5 * iqr,
        "upper_bound": F.col("q3") + 1.5 * iqr,
    }


def fit_bounds(df: DataFrame, column: str) -> tuple[float, float]:
    """The lower and upper outlier bound as numbers."""
    s = fit(df.select(column), quantiles={n: (column, p) for n, p in _QUARTILES})
    if s["q1"] is None:
        return float("-inf"), float("inf")
    reach = 1.5 * (s["q3"] - s["q1"])
    return s["q1"] - reach, s["q3"] + reach


def iqr_bounds(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, quartile range and outlier bounds, per group if ``by``."""
    needed, wanted = df.select(*by, column), {n: (column, p) for n, p in _QUARTILES}
    if by:
        stats = fit_by(needed, by, {"n": F.count("*")}, wanted).drop("n")
    else:
        s = fit(needed, quantiles=wanted)
        stats = small_table(df.sparkSession, [(s["q1"], s["q3"])], "q1 double, q3 double")
    return stats.withColumns(_bounds())


def outlier_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Outlier count, percent of the non-null rows, bounds and extreme outliers."""
    c, by = F.col(column), list(by)
    if by:
        df = df.na.drop(subset=by)
        stats = iqr_bounds(df, column, by).select(*by, "lower_bound", "upper_bound")
        linked = join_stats(df.select(*by, column), stats, by)
    else:
        low, high = fit_bounds(df, column)
        linked = df.select(column).withColumns({"lower_bound": F.lit(low), "upper_bound": F.lit(high)})
    out = F.when((c < F.col("lower_bound")) | (c > F.col("upper_bound")), c)
    counted = linked.groupBy(*by, "lower_bound", "upper_bound").agg(
        F.count(out).alias("n_outliers"),
        F.count(c).alias("__values"),
        F.min(out).alias("min_outlier"),
        F.max(out).alias("max_outlier"),
    )
    percent = F.try_divide(F.col("n_outliers") * 100.0, F.col("__values"))
    return counted.select(
        *by, "n_outliers", percent.alias("outlier_percent"), "lower_bound", "upper_bound", "min_outlier", "max_outlier"
    )


def top_outliers(df: DataFrame, column: str, k: int = 10, tie: str | None = None) -> DataFrame:
    """The k largest outliers; the bounds are literals that prune the scan."""
    return top_k(filter_outside_bounds(df, column, *fit_bounds(df, column)), column, k, tie)


def cap_outliers(df: DataFrame, column: str) -> DataFrame:
    low, high = fit_bounds(df, column)
    return df.withColumn(column, clip(F.col(column).cast("double"), low, high))


def log_transform(df: DataFrame, column: str) -> DataFrame:
    """Natural log, shifted first when the smallest value is not positive."""
    low = fit(df, {"low": F.min(column)})["low"]
    return df.withColumn(column, shifted_log(F.col(column), low))


def _replace(df: DataFrame, column: str, low: float, high: float, for_low, for_high) -> DataFrame:
    c = F.col(column).cast("double")
    new = F.when(c < F.lit(low), F.lit(for_low)).when(c > F.lit(high), F.lit(for_high)).otherwise(c)
    return df.withColumn(column, new)


def replace_outliers_mean(df: DataFrame, column: str) -> DataFrame:
    """Outliers become the mean of the values within the bounds."""
    low, high = fit_bounds(df, column)
    inside = df.where(F.col(column).between(F.lit(low), F.lit(high)))
    centre = fit(inside, {"m": F.avg(column)})["m"]
    return _replace(df, column, low, high, centre, centre)


def replace_outliers_median(df: DataFrame, column: str) -> DataFrame:
    """Outliers become the median of all values."""
    return _replace_by_quantiles(df, column, 0.5, 0.5)


def replace_outliers_percentile(df: DataFrame, column: str, low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Low outliers become the 10th percentile, high ones the 90th."""
    return _replace_by_quantiles(df, column, low, high)


def _replace_by_quantiles(df: DataFrame, column: str, p_low: float, p_high: float) -> DataFrame:
    wanted = {"q1": 0.25, "q3": 0.75, "low": p_low, "high": p_high}
    s = fit(df.select(column), quantiles={n: (column, p) for n, p in wanted.items()})
    if s["q1"] is None:
        return df
    reach = 1.5 * (s["q3"] - s["q1"])
    return _replace(df, column, s["q1"] - reach, s["q3"] + reach, s["low"], s["high"])
