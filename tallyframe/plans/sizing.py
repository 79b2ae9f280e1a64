"""Small tables that are known to be small, and stage tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: At most this many fitted group rows are held by the driver and broadcast.
BROADCAST_ROWS = 10_000
#: Spark's setting that removes the shuffle files of a statement at its end.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_table(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """A few driver-held rows as a local relation, whose size Catalyst knows."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    records = [r.asDict(recursive=True) if isinstance(r, Row) else dict(zip(schema.names, r)) for r in rows]
    # Zoned times arrive as local time without a zone; Arrow would read that as UTC.
    zoned = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
    for record in records:
        record.update({c: record[c].astimezone() for c in zoned if record[c] is not None})
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)


def hold_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` as a local relation if it has at most ``limit`` rows, else as a stage table.

    One job reads up to ``limit + 1`` rows; ending earlier proves the bound.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return checkpointed(df), False
    return small_table(df.sparkSession, rows, df.schema), True


def _base_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.conf.get("spark.master", "")
    if master.startswith("local") and not master.startswith("local-cluster"):
        return tempfile.mkdtemp(prefix="tallyframe-")  # driver and executors are one process
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder all executors share."""
    return f"{_base_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in this block remove their shuffle files when they end, which else stay until the driver collects its garbage."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def checkpointed(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Cut the lineage: the rows as a table in the shared folder.

    The table survives the loss of any executor.  Unlike an RDD checkpoint it is
    computed once, reads by column, and tells Catalyst its size.  The shuffles
    that led to it are removed, as nothing reads them again.  ``file_rows`` bounds
    the rows of a file, so that many tasks can read a table that few tasks wrote.
    """
    path = shared_folder(df.sparkSession, "stage")
    with shuffles_removed(df.sparkSession):
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*stages: DataFrame) -> None:
    """Delete stage tables that ``checkpointed`` returned and that nothing reads any more."""
    for stage in stages:
        context = stage.sparkSession.sparkContext
        names = context._jvm.org.apache.hadoop.fs.Path
        for folder in {file.rsplit("/", 1)[0] for file in stage.inputFiles()}:
            if not folder.rsplit("/", 1)[-1].startswith("stage-"):
                raise ValueError(f"{folder} is no stage table")
            path = names(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
