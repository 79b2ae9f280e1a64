"""Operators that look along a row order: changes, interpolation, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.plans.fitting import join_stats
from tallyframe.plans.ordering import BUCKET, place_rows, with_buckets, with_guests
from tallyframe.plans.sizing import checkpointed


def with_previous(
    df: DataFrame, column: str, order: str, by: Sequence[str] = (), buckets: int | None = None,
    name: str = "previous",
) -> DataFrame:
    """Add the value of ``column`` in the row before, null for the first row."""
    rows, n = with_buckets(df, order, buckets)
    if n > 1:
        rows = with_guests(rows, order, by, F.lit(True), [column])
    w = Window.partitionBy(*by, BUCKET).orderBy(order)
    rows = rows.withColumn(name, F.lag(column).over(w))
    return rows.select(*df.columns, name) if n == 1 else rows.where(~F.col("__guest")).select(*df.columns, name)


def pct_change(
    df: DataFrame, column: str, order: str, by: Sequence[str] = (), buckets: int | None = None,
    name: str = "pct_change",
) -> DataFrame:
    """(value - previous) / previous; null for the first row and after a zero."""
    rows = with_previous(df, column, order, by, buckets, "__previous")
    change = F.try_divide((F.col(column) - F.col("__previous")).cast("double"), F.col("__previous").cast("double"))
    return rows.withColumn(name, change).drop("__previous")


METHODS = ("linear", "quadratic", "cubic")


def interpolate(
    df: DataFrame, column: str, order: str, by: Sequence[str] = (), method: str = "linear",
    buckets: int | None = None, name: str | None = None,
) -> DataFrame:
    """Fill nulls from known neighbours, with equal steps between rows.

    ``linear``     between the neighbours; leading nulls stay, trailing nulls
                   repeat the last value.
    ``quadratic``  the parabola through two known rows before and one after
                   (one before and two after at the start); null outside.
    ``cubic``      a Catmull-Rom piece on two known rows either side; outside
                   the known range the line through the two nearest rows.

    Rows tied in ``order`` follow each other in the order of their other columns.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose from {METHODS}")
    name = name or column
    depth = 1 if method == "linear" else 2
    rows = df
    if by:  # as one text, which is never null, so that a null key is a group like any other
        rows, by = df.withColumn("__by", F.to_json(F.struct(*by))), ["__by"]
    rows, n = place_rows(rows, order, by, buckets, "__pos")
    if n > 1:
        rows = with_guests(rows, "__pos", by, F.col(column).isNotNull(), [column], depth)
    v, at = F.col(column).cast("double"), F.col("__pos").cast("double")
    cell = Window.partitionBy(*by, BUCKET)
    up, down = cell.orderBy("__pos"), cell.orderBy(F.col("__pos").desc())

    def near(direction) -> Column:
        """Nearest known row in one direction, with the known row beyond it."""
        point = F.when(v.isNotNull(), F.struct(at.alias("x"), v.alias("y")))
        if depth == 2:
            beyond = F.last(point, ignorenulls=True).over(direction.rowsBetween(Window.unboundedPreceding, -1))
            point = F.when(v.isNotNull(), F.struct(at.alias("x"), v.alias("y"), beyond.alias("far")))
        return point

    rows = rows.withColumns({"__up": near(up), "__down": near(down)})
    to_here = (Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "__l": F.last("__up", ignorenulls=True).over(up.rowsBetween(*to_here)),
            "__r": F.last("__down", ignorenulls=True).over(down.rowsBetween(*to_here)),
        }
    )
    if n > 1:
        rows = rows.where(~F.col("__guest"))
    left, right = F.col("__l"), F.col("__r")
    formula = {"linear": _linear, "quadratic": _quadratic, "cubic": _cubic}[method]
    rows = rows.withColumn("__filled", F.coalesce(v, formula(at, left, right)))
    kept = [c for c in df.columns if c != name]
    return rows.select(*kept, F.col("__filled").alias(name)).select(*dict.fromkeys([*df.columns, name]))


def _line(at: Column, a: Column, b: Column) -> Column:
    return a["y"] + (b["y"] - a["y"]) * (at - a["x"]) / (b["x"] - a["x"])


def _linear(at: Column, left: Column, right: Column) -> Column:
    return F.when(left.isNull(), None).when(right.isNull(), left["y"]).otherwise(_line(at, left, right))


def _parabola(at: Column, *points: Column) -> Column:
    total = F.lit(0.0)
    for i, p in enumerate(points):
        term = p["y"]
        for j, q in enumerate(points):
            if i != j:
                term = term * (at - q["x"]) / (p["x"] - q["x"])
        total = total + term
    return total


def _quadratic(at: Column, left: Column, right: Column) -> Column:
    inside = left.isNotNull() & right.isNotNull()
    return (
        F.when(inside & left["far"].isNotNull(), _parabola(at, left["far"], left, right))
        .when(inside & right["far"].isNotNull(), _parabola(at, left, right, right["far"]))
        .when(inside, _line(at, left, right))
    )


def _cubic(at: Column, left: Column, right: Column) -> Column:
    def slope(a: Column, b: Column) -> Column:
        return (b["y"] - a["y"]) / (b["x"] - a["x"])

    def outside(p: Column) -> Column:
        return F.when(p["far"].isNull(), p["y"]).otherwise(_line(at, p, p["far"]))

    gap = right["x"] - left["x"]
    s = (at - left["x"]) / gap
    chord = slope(left, right)
    leave = F.when(left["far"].isNull(), chord).otherwise(slope(left["far"], right))
    arrive = F.when(right["far"].isNull(), chord).otherwise(slope(left, right["far"]))
    curve = (
        left["y"] * (2 * s * s * s - 3 * s * s + 1)
        + leave * gap * (s * s * s - 2 * s * s + s)
        + right["y"] * (3 * s * s - 2 * s * s * s)
        + arrive * gap * (s * s * s - s * s)
    )
    return F.when(left.isNull(), outside(right)).when(right.isNull(), outside(left)).otherwise(curve)


def value_ranks(counted: DataFrame, column: str, weight: str, buckets: int | None = None) -> DataFrame:
    """Average rank of each distinct value; ``counted`` has one row per value.

    Ranks start at 1 and tied rows share the mean of their places.
    """
    counted = checkpointed(counted)  # read several times below
    rows, n = with_buckets(counted, column, buckets)
    upto = F.sum(weight).over(Window.partitionBy(BUCKET).orderBy(column))
    if n > 1:
        sums = rows.groupBy(BUCKET).agg(F.sum(weight).alias("__sum"))
        before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
        sums = sums.select(BUCKET, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
        rows = join_stats(rows, sums, [BUCKET])
        upto = upto + F.col("__offset")
    rank = upto - F.col(weight) + (F.col(weight) + 1) / 2
    return rows.select(column, rank.cast("double").alias("average_rank"))


def average_rank(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """The rows with the average rank of their value; null values have none.

    Ranks are found on distinct values, so ties of any size cost one row.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    return df.join(value_ranks(counted, column, "__n", buckets), column, "left").select(*df.columns, "average_rank")
