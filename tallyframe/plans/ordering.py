"""Ordered scans that never put a whole table, or a hot group, in one task.

The order key is cut into buckets of about equal row counts by a quantile
sketch.  Windows run inside (group, bucket); what a bucket needs from outside
(an offset, or the nearest known rows) comes from a summary with one row per
(group, bucket).  The key must be a non-null number or time with few rows to a
value, because all rows with one key value fall into one bucket; positions put
tied rows in the order of their other columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.plans.fitting import join_stats

ROWS_PER_BUCKET = 1_000_000
BUCKET = "__bucket"


def key_value(df: DataFrame, column: str) -> Column:
    """The order key as a double that grows with the key."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(column).cast("timestamp_ntz")).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    raise TypeError(f"order column {column!r} must be a number or a time, not {kind.simpleString()}")


def bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets is not None:
        return max(1, buckets)
    return max(1, math.ceil(df.count() / ROWS_PER_BUCKET))


def with_buckets(df: DataFrame, order: str, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Add the bucket number of each row; also return how many there can be."""
    wanted = bucket_count(df, buckets)
    if wanted > 1:
        keyed = df.withColumn("__key", key_value(df, order))
        probs = [i / wanted for i in range(1, wanted)]
        cuts = sorted(set(keyed.approxQuantile("__key", probs, 1 / (4 * wanted))))
        if cuts:
            splits = [-math.inf, *cuts, math.inf]
            cut = Bucketizer(splits=splits, inputCol="__key", outputCol=BUCKET).transform(keyed)
            return cut.drop("__key").withColumn(BUCKET, F.col(BUCKET).cast("int")), len(cuts) + 1
    return df.withColumn(BUCKET, F.lit(0)), 1


def _sorts(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sorts(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sorts(f.dataType) for f in kind)
    return isinstance(
        kind,
        (T.NumericType, T.StringType, T.CharType, T.VarcharType, T.BinaryType, T.BooleanType, T.DatetimeType),
    )


def total_order(df: DataFrame, order: str) -> list[Column]:
    """``order``, then all other columns that sort: every evaluation puts rows tied in ``order`` alike."""
    return [F.col(order), *[F.col(f"`{f.name}`") for f in df.schema if f.name != order and _sorts(f.dataType)]]


def place_rows(
    df: DataFrame, order: str, by: Sequence[str] = (), buckets: int | None = None, name: str = "position"
) -> tuple[DataFrame, int]:
    """Add bucket and 0-based position in ``order`` (per group if ``by``).

    No two rows of a group share a position: what looks along the rows should
    follow the position, as ``order`` may have ties.  A table of more than
    ROWS_PER_BUCKET rows for each of ``buckets`` is cut into more of them.
    """
    by = list(by)
    if buckets is None or buckets > 1:
        buckets = max(buckets or 1, bucket_count(df, None))
    cut, n = with_buckets(df, order, buckets)
    local = F.row_number().over(Window.partitionBy(*by, BUCKET).orderBy(*total_order(df, order))) - 1
    if n == 1:
        return cut.withColumn(name, local.cast("long")), n
    sizes = cut.groupBy(*by, BUCKET).agg(F.count("*").alias("__size"))
    # One row per (group, bucket), a millionth of the rows.
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, BUCKET, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    out = join_stats(cut, offsets, [*by, BUCKET]).withColumn(name, (local + F.col("__offset")).cast("long"))
    return out.drop("__offset"), n


def with_position(
    df: DataFrame, order: str, by: Sequence[str] = (), buckets: int | None = None, name: str = "position"
) -> DataFrame:
    return place_rows(df, order, by, buckets, name)[0].drop(BUCKET)


def with_guests(
    df: DataFrame, order: str, by: Sequence[str], known: Column, carry: Sequence[str], depth: int = 1
) -> DataFrame:
    """Lend every (group, bucket) its nearest known rows from outside.

    ``df`` carries the bucket column.  Each bucket receives copies, flagged by
    ``__guest``, of up to ``depth`` (1 or 2) last known rows before it and
    first known rows after it, so a plain window inside the bucket sees the
    neighbours a window over the whole group would see.  Guests hold the order
    key and the ``carry`` columns; their other columns are null.
    """
    by = list(by)
    cell = [*by, BUCKET]
    body = list(dict.fromkeys([order, *carry]))
    numbers = range(1, depth + 1)

    if depth == 1:
        # Column by column, so that the aggregate hashes fixed-width buffers instead of sorting.
        place = F.when(known, F.col(order))
        picks = {"__last1": F.max_by, "__first1": F.min_by}
        outer = df.groupBy(*cell).agg(
            *[f(c, place).alias(f"{tag}_{i}") for tag, f in picks.items() for i, c in enumerate(body)]
        )
        table = outer.select(
            *cell,
            *[
                F.when(
                    F.col(f"{tag}_0").isNotNull(),
                    F.struct(*[F.col(f"{tag}_{i}").alias(c) for i, c in enumerate(body)]),
                ).alias(tag)
                for tag in picks
            ],
        )
    else:
        row = F.when(known, F.struct(*[F.col(c) for c in body]))
        rows = df.select(*cell, F.col(order).alias("__o"), row.alias("__row"))

        def edge(direction: Column, tag: str) -> DataFrame:
            """The outermost known rows; each task trims its groups before the shuffle."""
            w = Window.partitionBy(*cell).orderBy(direction)
            ranked = rows.where(F.col("__row").isNotNull()).withColumn("__r", F.row_number().over(w))
            return ranked.where(F.col("__r") <= depth).groupBy(*cell).agg(
                *[F.max(F.when(F.col("__r") == i, F.col("__row"))).alias(f"{tag}{i}") for i in numbers]
            )

        cells = rows.groupBy(*cell).agg(F.count("*").alias("__size"))
        table = cells.join(edge(F.col("__o").desc(), "__last"), cell, "left")
        table = table.join(edge(F.col("__o"), "__first"), cell, "left")

    lent = []
    for tag, direction in (("__last", F.col(BUCKET)), ("__first", F.col(BUCKET).desc())):
        earlier = Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
        if depth == 2:
            table = table.withColumn(
                f"{tag}2", F.coalesce(F.col(f"{tag}2"), F.last(f"{tag}1", ignorenulls=True).over(earlier))
            )
        held = F.when(F.col(f"{tag}1").isNotNull(), F.array(*[F.col(f"{tag}{i}") for i in numbers]))
        table = table.withColumn(f"{tag}p", held)
        table = table.withColumn(f"{tag}c", F.last(f"{tag}p", ignorenulls=True).over(earlier))
        lent.append(F.coalesce(F.col(f"{tag}c"), F.array().cast(table.schema[f"{tag}p"].dataType)))
    guests = (
        table.select(*cell, F.explode(F.concat(*lent)).alias("__row"))
        .where(F.col("__row").isNotNull())
        .select(*cell, *[F.col("__row")[c].alias(c) for c in body], F.lit(True).alias("__guest"))
    )
    return df.withColumn("__guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)
