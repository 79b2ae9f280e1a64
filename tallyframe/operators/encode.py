"""Encodings of text columns."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.plans.fitting import join_stats
from tallyframe.plans.sizing import BROADCAST_ROWS, checkpointed

#: One column per value stops being a table beyond this many values.
MAX_ONE_HOT = 1_000


def label_codes(
    df: DataFrame, column: str, null_label: str | None = None, few: int = BROADCAST_ROWS
) -> DataFrame:
    """Distinct (value, code), codes 0..n-1 in alphabetical order.

    Few values are numbered in one window.  Many are sorted across tasks, and
    the running id of each sorted partition is shifted by the rows before it.
    """
    value = F.col(column) if null_label is None else F.coalesce(F.col(column), F.lit(null_label))
    values = df.select(value.alias("value")).where(F.col("value").isNotNull()).distinct()
    if values.limit(few + 1).count() <= few:
        return values.withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("long"))
    return _sorted_codes(values)


def _sorted_codes(values: DataFrame) -> DataFrame:
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    # The checkpoint fixes which rows each sorted partition holds.
    placed = checkpointed(values.orderBy("value").withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.select("value", part.alias("__part"), row.alias("__row"))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    linked = join_stats(placed, offsets, ["__part"])
    return linked.select("value", (F.col("__row") + F.col("__offset")).cast("long").alias("code"))


def label_encode(df: DataFrame, column: str, null_label: str | None = None) -> DataFrame:
    """The rows with a ``code`` column for the value of ``column``."""
    value = F.col(column) if null_label is None else F.coalesce(F.col(column), F.lit(null_label))
    codes = label_codes(df, column, null_label)
    return join_stats(df.withColumn("value", value), codes, ["value"], "left").select(*df.columns, "code")


def one_hot_values(df: DataFrame, column: str, limit: int = MAX_ONE_HOT) -> list[str]:
    values = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"column {column!r} has more than {limit} values; use one_hot_vectors")
    return sorted(values)


def one_hot_encode(df: DataFrame, column: str, limit: int = MAX_ONE_HOT) -> DataFrame:
    """One 0/1 column ``column_value`` per value, none dropped."""
    c = F.col(column)

    def flag(value) -> Column:
        return F.coalesce(c == F.lit(value), F.lit(False)).cast("double")

    return df.withColumns({f"{column}_{v}": flag(v) for v in one_hot_values(df, column, limit)})


def one_hot_vectors(df: DataFrame, column: str, name: str = "one_hot") -> DataFrame:
    """The same encoding as a sparse vector, for any number of values."""
    coded = label_encode(df, column)
    encoder = OneHotEncoder(inputCol="code", outputCol=name, dropLast=False)
    return encoder.fit(coded).transform(coded).drop("code")


def one_hot_totals(df: DataFrame, column: str) -> DataFrame:
    """Column sums of the one-hot table, without building it."""
    rows = df.where(F.col(column).isNotNull())
    return rows.groupBy(F.concat(F.lit(f"{column}_"), F.col(column)).alias("feature")).agg(
        F.count("*").cast("double").alias("total")
    )
