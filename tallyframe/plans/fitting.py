"""Fit statistics in one aggregate, then use them as literals or a checked join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.quantiles import Quantiles, refined_quantiles
from tallyframe.plans.sizing import BROADCAST_ROWS, hold_small


def fit(df: DataFrame, exprs: Mapping[str, Column] | None = None, quantiles: Quantiles | None = None) -> dict:
    """One row of table-level statistics as a dict.

    ``quantiles`` maps a result name to ``(column, p)``; the values are exact
    and interpolate linearly (see :mod:`tallyframe.plans.quantiles`).
    """
    exprs, quantiles = dict(exprs or {}), dict(quantiles or {})
    if quantiles:
        return refined_quantiles(df, [], quantiles, exprs).first().asDict()
    return df.agg(*[e.alias(name) for name, e in exprs.items()]).first().asDict() if exprs else {}


def fit_by(df: DataFrame, by: Sequence[str], exprs: Mapping[str, Column], quantiles: Quantiles | None = None) -> DataFrame:
    """One row of statistics per group; rows with a null key are left out."""
    exprs, quantiles = dict(exprs), dict(quantiles or {})
    df = df.na.drop(subset=list(by))
    if quantiles:
        return refined_quantiles(df, by, quantiles, exprs)
    return df.groupBy(*by).agg(*[e.alias(n) for n, e in (exprs or {"__rows": F.count("*")}).items()])


#: A key with more rows is dealt over several tasks when its statistics cannot be broadcast.
HOT_ROWS = 1_000_000


def join_stats(
    df: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "inner", limit: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attach group statistics to the rows they describe; ``stats`` has one row per key.

    The statistics are read up to ``limit + 1`` rows.  When they end before
    that, the rows just read are the whole table and are broadcast, so the fact
    side is not shuffled.  Beyond the limit the join shuffles by key.  Adaptive
    execution does not split a hot key that is grouped again later, so keys
    with more than ``hot_rows`` rows are salted here, and only their statistics
    are repeated, once per salt.
    """
    held, bounded = hold_small(stats, limit)
    if bounded:
        return df.join(F.broadcast(held), list(on), how)
    counts = df.groupBy(*on).agg(F.count("*").alias("__rows")).where(F.col("__rows") > hot_rows)
    parts = F.ceil(F.col("__rows") / hot_rows).cast("int").alias("__parts")
    hot, few = hold_small(counts.na.drop(subset=list(on)).select(*on, parts), limit)
    if few:
        hot = F.broadcast(hot)
    without = F.concat(*[F.col(c).isNull().cast("string") for c in on]).contains("true")
    # Rows that cannot match are dealt out as well; the salt depends on the row alone, so a retry deals alike.
    salt = F.pmod(F.xxhash64(*df.columns), F.coalesce("__parts", F.when(without, 256), F.lit(1))).cast("int")
    salted = df.join(hot, list(on), "left").withColumn("__salt", salt).drop("__parts")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)).alias("__salt")
    repeated = held.join(hot, list(on), "left").select(*held.columns, salts)
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")
