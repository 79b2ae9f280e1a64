"""Filling missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.aggregate import mode
from tallyframe.plans.fitting import fit
from tallyframe.plans.sizing import checkpointed
from tallyframe.plans.spacetree import LEAF_ROWS, grow, nearest


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    s = fit(df, {c: F.avg(c) for c in columns})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(s[c])) for c in columns})


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    s = fit(df.select(*columns), quantiles={c: (c, 0.5) for c in columns})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(s[c])) for c in columns})


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the most frequent value; works on text."""
    found = {c: mode(df, c).first()[0] for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in found.items() if v is not None})


# --- nearest rows ----------------------------------------------------------


def knn_impute(
    df: DataFrame, columns: Sequence[str], row_id: str, k: int = 5, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Fill nulls with the mean over the k nearest rows that have the value.

    The distance of two rows is ``sqrt(d / shared * sum of squares)`` over the
    columns both have; ties go to the lower id.  Rows without any value are
    dropped, and a cell without a comparable donor gets the column mean.  NaN
    counts as missing; other values must be finite.

    The search is exact.  Donors stand in k-d trees, one for each set of known
    columns (:mod:`tallyframe.plans.spacetree`), and each open cell opens only
    leaves that can hold one of its k nearest.  Leaves have at most
    ``leaf_rows`` points, wherever the rows crowd and however far some lie.
    """
    columns = list(columns)
    d = len(columns)
    known = F.concat(*[F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in columns])
    rows = df.select(
        F.col(row_id).alias("__id"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]
    ).withColumn("__mask", known).where(F.col("__mask").contains("1"))
    full = "1" * d
    stats = fit(rows, {c: F.avg(c) for c in columns})

    open_rows = rows.where(F.col("__mask") != full)
    # Rows with the same known values have the same neighbours: each point is searched once.
    points = checkpointed(open_rows.groupBy("__mask", *columns).agg(F.min("__id").alias("__id")))
    asked = fit(points, {c: F.count(c) for c in columns} | {"__n": F.count("*")})
    # Donors that agree wherever a seeker knows a value tie for all, so the k lowest ids stand for them.
    seen_columns = [c for c in columns if asked[c]]
    donors = _lowest(rows, ["__mask", *seen_columns], "__id", k)
    weights = [asked[c] / max(asked["__n"], 1) for c in columns]
    donors, levels = grow(checkpointed(donors), columns, "__mask", max(leaf_rows, k), weights)

    # Which trees a seeker meets: those that share a column with it.  Each mask is the name of a root.
    masks = levels[0].select(F.col("__node").alias("__mask"))
    known_at = F.array(*[F.when(F.substring("__mask", i + 1, 1) == "1", i) for i in range(d)])
    places = F.explode(F.filter(known_at, lambda i: i.isNotNull())).alias("__place")
    seen = masks.where(F.col("__mask") != full).select("__mask", places)
    given = masks.select(F.col("__mask").alias("__node"), places)
    roots = seen.join(given, "__place").select("__mask", "__node").distinct()

    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(columns)]),
                       lambda i: i.isNotNull())
    seekers = points.select("*", F.explode(missing).alias("__target"))
    value = F.get(F.array(*[F.col(f"__d_{i}") for i in range(d)]), F.col("__target"))
    accept = F.get("__hi", F.col("__target")).isNotNull()
    met = nearest(
        seekers, ["__id", "__target"], roots, donors.withColumnRenamed("__id", "__donor"), levels, columns,
        value, accept, "__donor", k,
    )
    wide = met.groupBy("__id").agg(
        *[F.avg(F.when(F.col("__target") == i, F.col("__value"))).alias(f"__new{i}") for i in range(d)]
    )
    answers = points.join(wide, "__id").select(
        F.col("__mask").alias("__m"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(columns)],
        *[f"__new{i}" for i in range(d)],
    )
    same = F.col("__mask") == F.col("__m")
    for i, c in enumerate(columns):
        same = same & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    filled = open_rows.join(answers, same, "left").withColumns(
        {c: F.coalesce(F.col(c), F.col(f"__new{i}")) for i, c in enumerate(columns)}
    )
    done = rows.where(F.col("__mask") == full)
    out = done.select("__id", *columns).unionByName(filled.select("__id", *columns))
    return out.select(
        F.col("__id").alias(row_id), *[F.coalesce(F.col(c), F.lit(stats[c])).alias(c) for c in columns]
    )


def _lowest(rows: DataFrame, by: Sequence[str], order: str, k: int) -> DataFrame:
    """Up to k rows with the lowest ``order`` per point; tasks trim their rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
