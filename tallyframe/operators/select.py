"""Filters, positional access, sorting and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.plans.fitting import join_stats
from tallyframe.plans.ordering import key_value, with_position
from tallyframe.plans.quantiles import nth_values

#: Up to this many rows per group Spark limits groups before the shuffle itself.
GROUP_LIMIT = 1_000
SALTS = 64
#: Up to this position a bounded heap per task finds a row; beyond it rows are numbered.
HEAP_ROWS = 10_000


# --- filters ---------------------------------------------------------------

def filter_year_and_levels(
    df: DataFrame, time: str, first_year: int, last_year: int, level: str, levels: Sequence
) -> DataFrame:
    """Rows of the years (inclusive) with a level in the list.

    The years become a range on the time itself, which reaches the scan.
    """
    t = F.col(time)
    start = F.lit(f"{first_year:04d}-01-01 00:00:00").cast("timestamp_ntz")
    end = F.lit(f"{last_year + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    return df.where((t >= start) & (t < end) & F.col(level).isin(*levels))


def filter_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def filter_and_project(df: DataFrame, condition: Column, columns: Sequence[str]) -> DataFrame:
    return df.where(condition).select(*columns)


def filter_in_list(df: DataFrame, column: str, values: Sequence, columns: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(*values)).select(*columns)


def filter_outside_bounds(df: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    """Rows below or above the bounds; a null is neither."""
    return df.where((F.col(column) < F.lit(lower)) | (F.col(column) > F.lit(upper)))


# --- positional access -----------------------------------------------------

def row_at(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n-th row (from 0) in ``order``; -1 is the last."""
    if -HEAP_ROWS <= n < 0:
        return df.orderBy(F.col(order).desc()).offset(-n - 1).limit(1)
    if 0 <= n <= HEAP_ROWS:
        return df.orderBy(order).offset(n).limit(1)
    return rows_at(df, order, [n if n >= 0 else df.count() + n])


def rows_at(df: DataFrame, order: str, positions: Sequence[int], buckets: int | None = None) -> DataFrame:
    """Rows at the given positions (from 0, or from the end if negative) in ``order``, anywhere in the table.

    A position outside the table raises, as in a list.
    """
    number = df.count()
    outside = [p for p in positions if not -number <= p < number]
    if outside:
        raise IndexError(f"positions {outside} are outside a table of {number} rows")
    positions = [p % number for p in positions]
    numbered = with_position(df, order, buckets=buckets)
    return numbered.where(F.col("position").isin(*positions)).drop("position")


def rows_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows at the positions where the condition holds: simply the filter."""
    return df.where(condition)


def slice_inclusive(df: DataFrame, index: str, first, last) -> DataFrame:
    """Index labels from ``first`` to ``last``, both kept."""
    return df.where(F.col(index).between(F.lit(first), F.lit(last)))


def slice_half_open(df: DataFrame, order: str, start: int, stop: int) -> DataFrame:
    """Positions ``start`` (kept) to ``stop`` (not kept) in ``order``."""
    if stop > HEAP_ROWS:
        numbered = with_position(df, order)
        return numbered.where(F.col("position").between(start, stop - 1)).drop("position")
    rows = df.orderBy(order)
    return (rows.offset(start) if start else rows).limit(stop - start)


# --- sorting and top-k -----------------------------------------------------

def sort_desc(df: DataFrame, column: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), F.col(tie))


def sort_table(df: DataFrame, columns: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    return df.orderBy(*columns, ascending=ascending)


def sort_pairs_desc(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.orderBy(F.col(first).desc(), F.col(second).desc())


def head(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)


def top_k(df: DataFrame, column: str, k: int, tie: str | None = None, largest: bool = True) -> DataFrame:
    """The k extreme rows; planned as a bounded heap per task, not a sort."""
    key = F.col(column).desc_nulls_last() if largest else F.col(column).asc_nulls_last()
    return df.orderBy(key, *([F.col(tie)] if tie else [])).limit(k)


def head_per_group(df: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    """The first n rows of each group in ``order``; null keys are left out.

    For small n Spark trims every group before the shuffle.  For larger n the
    n-th key of each group is found by counting, and only rows up to it are
    shuffled, so a hot group never reaches one task whole.  Keys that are
    neither numbers nor times are trimmed inside salted parts of each group.
    """
    rows = df.na.drop(subset=list(by))
    if n > GROUP_LIMIT:
        kind = df.schema[order].dataType
        if isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            keyed = rows.withColumn("__key", key_value(rows, order))
            bound = nth_values(keyed.select(*by, "__key"), by, "__key", n)
            # Rows without a key come first in the order.
            near = join_stats(keyed, bound, list(by)).where(F.col("__key").isNull() | (F.col("__key") <= F.col("nth")))
            rows = near.select(*df.columns)
        else:
            rows = rows.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(SALTS)))
            rows = _first_rows(rows, [*by, "__salt"], order, n).drop("__salt")
    return _first_rows(rows, by, order, n)


def _first_rows(df: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")
