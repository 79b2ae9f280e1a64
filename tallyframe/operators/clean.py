"""Typing, null handling, projections and updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.plans.fitting import join_stats

_FRACTIONS = (T.DoubleType, T.FloatType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, so that one rule for missing values holds everywhere."""
    fractions = [f.name for f in df.schema.fields if isinstance(f.dataType, _FRACTIONS)]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in fractions})


def columns_by_kind(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``numeric``, ``text``, ``time`` or ``bool`` columns; reads no data."""
    types = {
        "numeric": T.NumericType,
        "text": T.StringType,
        "time": (T.TimestampType, T.TimestampNTZType, T.DateType),
        "bool": T.BooleanType,
    }[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def parse_timestamp_lenient(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to local time; text that is not a time becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in columns})


def parse_timestamp_strict(df: DataFrame, column: str, formats: Sequence[str] = ()) -> DataFrame:
    """Text in one of several formats to local time; other text raises."""
    c = F.col(column)
    tries = [c.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    parsed = F.coalesce(*tries)
    wrong = F.raise_error(F.concat(F.lit(f"column {column} is not a time: "), c)).cast("timestamp_ntz")
    return df.withColumn(column, F.when(c.isNotNull() & parsed.isNull(), wrong).otherwise(parsed))


def text_cast(df: DataFrame, columns: Sequence[str] | None = None, null_label: str | None = "nan") -> DataFrame:
    """Columns as text; NULL becomes the label, or stays NULL if it is None."""
    columns = columns_by_kind(df, "text") if columns is None else columns
    out = {c: F.col(f"`{c}`").cast("string") for c in columns}
    if null_label is not None:
        out = {c: F.coalesce(e, F.lit(null_label)) for c, e in out.items()}
    return df.withColumns(out)


def drop_null_any(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(columns))


def drop_null_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(how="all", subset=list(columns))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


# --- projections -----------------------------------------------------------

def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def select_by_position(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Columns by position; negative positions count from the end."""
    return df.select(*[df.columns[i] for i in positions])


def drop_column(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def with_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns))


# --- updates and appends ---------------------------------------------------

def update_where(df: DataFrame, condition: Column, column: str, value) -> DataFrame:
    """The table with ``column`` set to ``value`` where the condition holds."""
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def _check_status(status: str, allowed: Sequence[str]) -> None:
    if status not in allowed:
        raise ValueError(f"unknown status {status!r}; expected one of {tuple(allowed)}")


def update_status_by_id(
    df: DataFrame, row_id, status: str, allowed: Sequence[str], id_column: str = "id", status_column: str = "status"
) -> tuple[DataFrame, DataFrame]:
    """The updated table and its changed row (no row for an unknown id)."""
    _check_status(status, allowed)
    hit = F.col(id_column) == F.lit(row_id)
    updated = update_where(df, hit, status_column, status)
    return updated, updated.where(hit)


def update_statuses(
    df: DataFrame, updates: DataFrame, allowed: Sequence[str], id_column: str = "id", status_column: str = "status"
) -> DataFrame:
    """Batch form: ``updates`` has one row (id, status) per changed id.

    A status outside ``allowed``, or two updates of one id, raise when the table is computed.
    """
    new = F.col("__status")
    status = F.col("__status")
    one = updates.groupBy(id_column).agg(F.max(status_column).alias("__status"), F.count("*").alias("__n"))
    checked = one.select(
        id_column,
        F.when(F.col("__n") > 1, F.raise_error(F.lit("two updates of one id")).cast("string"))
        .when(status.isin(*allowed), status)
        .otherwise(F.raise_error(F.lit("unknown status")).cast("string"))
        .alias("__status"),
    )
    joined = join_stats(df, checked, [id_column], "left")
    return joined.withColumn(status_column, F.coalesce(new, F.col(status_column))).select(*df.columns)


def append_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Stack tables with the same columns; duplicates stay."""
    return first.unionByName(second)


def append_order(df: DataFrame, record: Sequence) -> tuple[DataFrame, DataFrame]:
    """The table with one more row, and that row as a table."""
    if not isinstance(record, (list, tuple)):
        raise TypeError("a record must be a list of values")
    if len(record) != len(df.columns):
        raise ValueError(f"a record must have {len(df.columns)} fields, not {len(record)}")
    row = df.sparkSession.createDataFrame([tuple(record)], df.schema, verifySchema=True)
    return df.unionByName(row), row


def distinct_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).dropDuplicates()
