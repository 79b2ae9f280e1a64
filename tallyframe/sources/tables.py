"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.scalar import minutes_between
from tallyframe.operators.clean import nan_to_null, parse_timestamp_lenient, parse_timestamp_strict, text_cast
from tallyframe.operators.select import head_per_group
from tallyframe.sources.schemas import ACCIDENTS


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """CSV with a header row and quoted text; a blank field is null.

    A missing path raises ``PATH_NOT_FOUND`` when the plan is analysed.
    Columns are matched to the header by name, so their order may differ.
    """
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return nan_to_null(reader.options(**{"escape": '"', "nanValue": "NaN"} | options).csv(path))


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """A JSON array of objects per file, or (splittable) one object per line."""
    return nan_to_null(spark.read.schema(schema).option("multiLine", not lines).json(path))


def literal_table(spark: SparkSession, rows: Sequence, schema: T.StructType) -> DataFrame:
    """Rows written in code; arity and types are checked against the schema."""
    return spark.createDataFrame(list(rows), schema, verifySchema=True)


def write_csv_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """A directory of CSV part files, each with a header, written in parallel."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Parquet, the default sink; partition big tables by year to prune scans."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


@contextmanager
def cached_input(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table for several passes and release it afterwards."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def prepare_events(
    df: DataFrame, start: str = "Start_Time", end: str = "End_Time", duration: str = "Duration",
    null_label: str | None = None,
) -> DataFrame:
    """Parse both times, derive the duration in minutes, and label null text."""
    df = parse_timestamp_lenient(df, [start, end])
    df = df.withColumn(duration, minutes_between(F.col(start), F.col(end)))
    return text_cast(df, null_label=null_label) if null_label is not None else df


def load_events(
    spark: SparkSession, path: str, schema: T.StructType = ACCIDENTS, null_label: str | None = None, **names: str
) -> DataFrame:
    """The event table as one lazy plan: read, parse, derive, label."""
    return prepare_events(read_csv_table(spark, path, schema), null_label=null_label, **names)


def file_order(df: DataFrame, name: str = "row_order") -> DataFrame:
    """Add a sortable column that follows the order of rows in the files.

    File splits are not scheduled in file order, so the split position leads
    and the running id only orders rows inside one split.
    """
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(name),
    )


def first_per_year(df: DataFrame, time: str, order: str, per_year: int = 1000) -> DataFrame:
    """The first rows of each year in ``order``; rows without a time are left out."""
    dated = df.withColumn("__year", F.year(time))
    return head_per_group(dated, ["__year"], order, per_year).drop("__year")


def sample_job(
    spark: SparkSession, source: str, target: str, per_year: int = 1000,
    schema: T.StructType = ACCIDENTS, time: str = "Start_Time", formats: Sequence[str] = (),
) -> None:
    """Read a CSV table, keep the first rows of each year, write CSV."""
    plain = spark.read.schema(schema).option("header", True).option("escape", '"').csv(source)
    rows = parse_timestamp_strict(file_order(plain), time, formats)
    sample = first_per_year(rows, time, "row_order", per_year)
    write_csv_table(sample.drop("row_order"), target)
