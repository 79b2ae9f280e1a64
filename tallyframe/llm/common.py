"""Helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import math
import pickle
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.plans.sizing import checkpointed, removed, shared_folder  # noqa: F401

#: A word is a run of characters outside space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def by_value(module: str) -> None:
    """Ship the functions of a module inside the task, so that workers need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that the tasks of a Python worker share; a worker holds one, so a later stage frees what an earlier one kept."""
    holder = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if getattr(holder, "name", None) != name:
        holder.name, holder.held = None, None
        holder.held = make()
        holder.name = name
    return holder.held


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def key_text_crc(column: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """Apply ``work`` to each Arrow batch (at most 64 MB by Spark's own batch limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def made_in_a_task(df: DataFrame, work: Callable[[list[tuple]], object]) -> object:
    """What ``work`` makes of all rows of ``df``, a bounded sample, in one task: the driver gets the result and never holds the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns))]
        made = pickle.dumps(work(rows), protocol=5)
        body = len(made).to_bytes(8, "little") + pa.compress(made, codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["made"])

    found = df.repartition(1).mapInArrow(run, "made binary").collect()
    if not found:  # Spark leaves out the task of a table that it knows to be empty
        return work([])
    body = found[0]["made"]
    return pickle.loads(pa.decompress(memoryview(body)[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True))


def with_row(df: DataFrame, columns: list[str], name: str = "__row") -> DataFrame:
    """The rows as a stage table with a row number that stays the same whenever it is read again."""
    picked = df.select(*[F.col(f"`{c}`") for c in columns])
    return checkpointed(picked.withColumn(name, F.monotonically_increasing_id()))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of the undirected ``edges`` (a, b), both long.

    Each round maps every vertex to the neighbour (or itself) of least hash, a
    hash that differs by round, and relabels the edges; the vertices left shrink
    by a constant factor, so long chains end after few rounds as well.  Both
    sides of each join are stored tables, so adaptive execution can split a hub.
    """
    spark = edges.sparkSession
    edges = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    for turn in range(200):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("v"))).alias("near"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("v"))
        parent = checkpointed(near.select("a", F.least("near", own)["v"].alias("p")))
        moved = (
            edges.join(parent, "a").select(F.col("p").alias("x"), F.col("b").alias("a"))
            .join(parent, "a").select("x", F.col("p").alias("y")).where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        if labels is None:
            labels = parent.select(F.col("a").alias("vertex"), F.col("p").alias("root"))
        else:
            step = labels.join(parent.withColumnRenamed("a", "root"), "root", "left")
            labels = checkpointed(step.select("vertex", F.coalesce("p", "root").alias("root")))
        edges = checkpointed(moved)
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return spark.createDataFrame([], "vertex long, root long")
    return labels


def split_points(df: DataFrame, key: str, weight: str, target: int, bins: int = 4096) -> list[int]:
    """Ascending cuts of the integer ``key`` so that each range weighs about ``target``.

    The weights are counted exactly in equal-width bins and heavy bins are
    counted again in finer ones, so the cuts depend on the rows alone, not on
    their partitions.  A range is heavier than the target only where a single
    key is.  A key k belongs to the range with the number of cuts <= k.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(weight).cast("long").alias("w")).where("k is not null")
    low, high = rows.agg(F.min("k"), F.max("k")).first()
    if low is None:
        return []

    def count(start: int, stop: int) -> list[tuple[int, int, int]]:
        """(first key, width, weight) of the bins of [start, stop)."""
        width = max(1, -(-(stop - start) // bins))
        number = F.expr(f"cast((cast(k as decimal(20,0)) - {start}) div {width} as int)")
        inside = rows.where((F.col("k") >= start) & (F.col("k") <= stop - 1))
        found = sorted((r[0], r[1]) for r in inside.groupBy(number.alias("bin")).agg(F.sum("w")).collect())
        return [(start + b * width, width, w) for b, w in found]

    cells, open_bins = [], [(low, high - low + 1, None)]
    while open_bins:
        start, width, _ = open_bins.pop()
        for cell in count(start, start + width):
            (open_bins if cell[2] > target and cell[1] > 1 and cell[1] < width else cells).append(cell)
    cuts, held = [], 0
    for start, _, weight_here in sorted(cells):
        if held and held + weight_here > target:
            cuts.append(start)
            held = 0
        held += weight_here
    return cuts


def with_range(df: DataFrame, key: str, cuts: list[int], name: str) -> DataFrame:
    """Add the number of cuts <= key; rows with a null key get ``len(cuts) + 1``."""
    points = sorted({float(c) for c in cuts})
    splits = [-math.inf, *points, math.inf] if points else [-math.inf, 0.0, math.inf]
    keyed = df.withColumn("__key", F.col(f"`{key}`").cast("double"))
    cut = Bucketizer(splits=splits, inputCol="__key", outputCol=name, handleInvalid="keep").transform(keyed)
    number = F.col(name).cast("int") if points else F.when(F.col("__key").isNull(), 1).otherwise(0)
    return cut.withColumn(name, number).drop("__key")


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans, bit 0 first, as unsigned integers."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8").reshape(bits.shape[:-1])
