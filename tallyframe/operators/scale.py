"""Column scaling by fitted statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scalar import shifted_log
from tallyframe.operators.aggregate import describe
from tallyframe.plans.fitting import fit

DESCRIPTIONS = {
    "standard": "z-score: mean 0 and standard deviation 1",
    "minmax": "range scaling into 0 to 1",
    "robust": "centred by the median and divided by the quartile range",
    "log": "natural logarithm, shifted where a column is not positive",
}


def _affine(df: DataFrame, fitted: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(x - centre) / width per column; a zero width divides by 1."""
    return df.withColumns(
        {
            c: (F.col(c).cast("double") - F.lit(centre).cast("double")) / F.lit(width or 1.0)
            for c, (centre, width) in fitted.items()
        }
    )


def scale_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and population standard deviation 1."""
    exprs = {f"{c}|m": F.avg(c) for c in columns} | {f"{c}|s": F.stddev_pop(c) for c in columns}
    s = fit(df, exprs)
    return _affine(df, {c: (s[f"{c}|m"], s[f"{c}|s"]) for c in columns})


def scale_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest value 0 and largest 1; a constant column becomes 0."""
    d = {c: F.col(c).cast("double") for c in columns}
    s = fit(df, {f"{c}|lo": F.min(d[c]) for c in columns} | {f"{c}|w": F.max(d[c]) - F.min(d[c]) for c in columns})
    return _affine(df, {c: (s[f"{c}|lo"], s[f"{c}|w"]) for c in columns})


def scale_robust(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median 0 and quartile range 1, from exact quartiles."""
    wanted = {f"{c}|{n}": (c, p) for c in columns for n, p in (("m", 0.5), ("q1", 0.25), ("q3", 0.75))}
    s = fit(df.select(*columns), quantiles=wanted)
    width = {c: None if s[f"{c}|q1"] is None else s[f"{c}|q3"] - s[f"{c}|q1"] for c in columns}
    return _affine(df, {c: (s[f"{c}|m"], width[c]) for c in columns})


def scale_log(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    s = fit(df, {c: F.min(c) for c in columns})
    return df.withColumns({c: shifted_log(F.col(c), s[c]) for c in columns})


_SCALERS = {"standard": scale_standard, "minmax": scale_minmax, "robust": scale_robust, "log": scale_log}


def scale_columns(df: DataFrame, columns: Sequence[str], method: str = "standard") -> tuple[DataFrame, str]:
    """The table with the columns scaled, and a text about the method."""
    if method not in _SCALERS:
        raise ValueError(f"unknown method {method!r}; choose from {tuple(_SCALERS)}")
    return _SCALERS[method](df, columns), DESCRIPTIONS[method]


def scale_report(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Statistics of the columns after scaling, tagged by method."""
    scaled, _ = scale_columns(df, columns, method)
    return describe(scaled, columns).withColumn("method", F.lit(method))
