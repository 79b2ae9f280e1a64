"""Large JSON arrays read in parallel.

Spark's own reader takes a file that is one JSON array as a single record.
Here a file is cut into chunks of bytes.  Whether a chunk starts inside a
string, and how deep, depends on all bytes before it, so a first scan gives for
each chunk a map from its state at the start to that at the end; the maps of a
file, one row per chunk, are composed in order; then every chunk is read again
from its known state and gives the elements that begin in it, reading on where
the last one ends in a later chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.plans.shipping import by_value

by_value(__name__)

CHUNK_BYTES = 32 << 20
#: Bytes read at a time behind a chunk until its last element ends.
TAIL_BYTES = 1 << 20
#: Outside strings, inside one, inside one just after a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
OPENING, CLOSING = b"[{", b"]}"


def _open(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:"):]
    files, path = pyarrow.fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def scan(text: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(change of depth at each byte outside strings, state behind the last byte) of bytes that start in ``state``."""
    n = len(text)
    slash = text == 0x5C
    # A byte is escaped if an odd number of backslashes stands before it; a pending one counts as the first.
    last_plain = np.maximum.accumulate(np.where(slash, -1, np.arange(n))) if n else np.zeros(0, np.int64)
    run = np.arange(n) - last_plain  # backslashes up to here, for those that are one
    run = np.where(slash, run + ((state == ESCAPED) & (last_plain < 0)), 0)
    escaped = np.concatenate([[state == ESCAPED], run[:-1] % 2 == 1])[:n]
    quote = (text == 0x22) & ~escaped
    inside_after = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1
    inside = np.concatenate([[state != OUTSIDE], inside_after[:-1]])[:n]
    step = np.isin(text, np.frombuffer(OPENING, np.uint8)).astype(np.int64) - np.isin(text, np.frombuffer(CLOSING, np.uint8))
    step[inside] = 0
    if not n:
        return step, state
    end = OUTSIDE if not inside_after[-1] else ESCAPED if slash[-1] and run[-1] % 2 == 1 else INSIDE
    return step, end


def chunk_maps(chunks: DataFrame) -> DataFrame:
    """(file, start, stop, to, deeper): for each state at the start the state and the change of depth at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop"))):
                with _open(uri) as file:
                    text = np.frombuffer(file.read_at(stop - start, start), np.uint8)
                found = [scan(text, state) for state in (OUTSIDE, INSIDE, ESCAPED)]
                yield pa.RecordBatch.from_pylist(
                    [{"file": uri, "start": start, "stop": stop, "to": [e for _, e in found], "deeper": [int(s.sum()) for s, _ in found]}],
                    pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("to", pa.list_(pa.int32())), ("deeper", pa.list_(pa.int64()))]))

    return chunks.mapInArrow(run, "file string, start long, stop long, to array<int>, deeper array<long>")


def composed(maps: DataFrame) -> DataFrame:
    """(file, start, stop, state, depth) at the start of every chunk; one row per chunk of a file meets in a task."""

    def of_file(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        state, depth, out = OUTSIDE, 0, []
        for uri, start, stop, to, deeper in rows.itertuples(index=False):
            out.append((uri, start, stop, state, depth))
            state, depth = int(to[state]), depth + int(deeper[state])
        return pd.DataFrame(out, columns=["file", "start", "stop", "state", "depth"])

    return maps.groupBy("file").applyInPandas(of_file, "file string, start long, stop long, state int, depth long")


def elements(text: bytes, state: int, depth: int, limit: int) -> tuple[list[bytes], int | None]:
    """(objects that begin before ``limit`` and end in the text, start of one that does not)."""
    step, _ = scan(np.frombuffer(text, np.uint8), state)
    level = depth + np.cumsum(step)
    begins = np.flatnonzero((step == 1) & (level == 2))
    ends = np.flatnonzero((step == -1) & (level == 1))
    begins = begins[begins < limit]
    ends = ends[np.searchsorted(ends, begins[0]) :] if len(begins) else ends[:0]
    whole = min(len(begins), len(ends))
    found = [text[b : e + 1] for b, e in zip(begins[:whole].tolist(), ends[:whole].tolist())]
    return found, int(begins[whole]) if whole < len(begins) else None


def chunk_elements(placed: DataFrame) -> DataFrame:
    """(value): the text of every element that begins in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, stop, state, depth in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop", "state", "depth"))):
                with _open(uri) as file:
                    size, text = file.size(), file.read_at(stop - start, start)
                    found, rest = elements(text, state, depth, stop - start)
                    if rest is not None:  # the last one goes on behind the chunk
                        tail, at = text[rest:], stop
                        while at < size:
                            tail += file.read_at(min(TAIL_BYTES, size - at), at)
                            at = min(at + TAIL_BYTES, size)
                            more, open_ = elements(tail, OUTSIDE, 1, 1)
                            if open_ is None:
                                found += more
                                break
                for a in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([f.decode("utf-8", "replace") for f in found[a : a + 10_000]], pa.string())], ["value"])

    return placed.mapInArrow(run, "value string")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The objects of files that each are one JSON array, as rows of ``schema``.

    Elements that are not objects or arrays are passed over, and so is an element that
    the end of the file cuts off; an object that does not parse has null fields.
    Files are UTF-8.  An empty array gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk_bytes).cast("long")))
    chunks = files.select("file", "length", starts.alias("start")).select(
        "file", "start", F.least(F.col("start") + chunk_bytes, F.col("length")).alias("stop"))
    spread = chunks.repartition(max(1, chunks.count()), "file", "start")
    placed = composed(chunk_maps(spread))
    placed = placed.repartition(spread.rdd.getNumPartitions(), "file", "start")
    return chunk_elements(placed).select(F.from_json("value", schema).alias("row")).select("row.*")


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Each partition as a file that is one JSON array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([held + ","])], ["value"])
                held = ("[" if held is None else "") + value
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if held is None else held + "]"])], ["value"])

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(run, "value string").write.text(path)
