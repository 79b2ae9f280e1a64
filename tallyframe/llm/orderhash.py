"""Document fingerprints by Order MinHash, whose likeness follows edit distance.

The k-mers of a text are numbered by occurrence.  Each of ROUNDS hash orders
selects the PICKED least numbered k-mers; these stay in text order and the
tuple is hashed.  Two texts agree on a round if they select the same k-mers in
the same order, so moved text counts as changed, unlike with plain MinHash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import by_value, split_points, text_or_empty, with_range

by_value(__name__)

KMER = 8
PICKED = 2
ROUNDS = 64
SEED = 3
#: Low bits of a k-mer's hash that give way to its place while sorting.
PLACE_BITS = 22
#: K-mers of one block, and expected candidates of a round.
BLOCK = 8_192
CANDIDATES = 12
#: Characters of one range of documents; ranges grow where there would be more than MOST_RANGES.
RANGE_CHARS = 4_000_000
MOST_RANGES = 10_000
#: Ranges of the documents without an id.
NULL_RANGES = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered_kmers(text: str, k: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """(hash of k-mer and occurrence number, place in the text); a shorter text is one k-mer, an empty one none."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width, run = 1, codes + np.uint64(1)
    hashes = None
    left, at = min(k, n), 0
    while left:  # runs of 1, 2, 4, ... characters, put together to the width wanted
        if left & 1:
            part = run[at : at + n - min(k, n) + 1]
            hashes = part if hashes is None else _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + part)
            at += width
        left >>= 1
        if left:
            run = _mix(run[:-width] * np.uint64(0xD6E8FEB86659FD93) + run[width:])
            width *= 2
    low = np.uint64((1 << PLACE_BITS) - 1)
    mixed = _mix(hashes) & ~low  # the same bits at every length, so that equal k-mers meet
    if len(mixed) <= 1 << PLACE_BITS:
        order = np.sort(mixed | np.arange(len(mixed), dtype=np.uint64))
        kmer, place = order & ~low, (order & low).astype(np.int64)
    else:
        place = np.argsort(mixed, kind="stable")
        kmer = mixed[place]
    fresh = np.concatenate([[True], kmer[1:] != kmer[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(kmer)), 0))
    return _mix(kmer + (np.arange(len(kmer)) - first).astype(np.uint64)), place


def round_factors(rounds: int = ROUNDS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 31, rounds, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(text: str, factors: np.ndarray) -> np.ndarray:
    """One number per round; equal texts have equal signatures."""
    items, place = numbered_kmers(text)
    n, rounds = len(items), len(factors)
    if n < PICKED:
        whole = _mix(items.sum(keepdims=True) + np.uint64(n))
        return np.repeat(whole, rounds).astype(np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    wanted = CANDIDATES
    while True:
        limit = np.uint32(0xFFFFFFFF if wanted >= n else int(wanted / n * 0xFFFFFFFF))
        turns, spots, values = [], [], []
        for at in range(0, n, BLOCK):
            block = short[None, at : at + BLOCK] * factors[:, None]
            hit = np.flatnonzero(block <= limit)
            turn, spot = np.divmod(hit, block.shape[1])
            turns.append(turn), spots.append(spot + at), values.append(block.ravel()[hit])
        turn, spot, value = np.concatenate(turns), np.concatenate(spots), np.concatenate(values)
        per_turn = np.bincount(turn, minlength=rounds)
        if per_turn.min() >= PICKED:
            break
        wanted *= 4
    order = np.lexsort((items[spot], value, turn))
    starts = np.concatenate([[0], np.cumsum(per_turn)[:-1]])
    least = spot[order[starts[:, None] + np.arange(PICKED)]]
    least = np.take_along_axis(least, np.argsort(place[least], axis=1), axis=1)
    out = np.zeros(rounds, np.uint64)
    for c in range(PICKED):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + items[least[:, c]])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hex_of(signed: np.ndarray) -> str:
    return signed.astype(">u4").tobytes().hex()


def edited(text: str, other: str) -> str:
    """The text with its last third replaced by the start of another."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


# Each document with the next one ----------------------------------------------------------------

def in_descending_ranges(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows (key, text) as partitions of descending keys; each ends with the row that follows it, marked as guest.

    Keys are cut into ranges of about equal text; null keys come after all
    others, by hash.  Rows of one key are ordered by hash and text.  Only one
    row per range reaches the driver.
    """
    rows = df.select("key", "text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("twin"))
    weighed = rows.select("key", F.length("text").cast("long").alias("size"))
    total = weighed.agg(F.sum("size")).first()[0] or 0
    cuts = split_points(weighed, "key", "size", max(RANGE_CHARS, total // MOST_RANGES))
    placed = with_range(rows, "key", cuts, "range")
    ranges = max(len({float(c) for c in cuts}), 0) + 1
    by_hash = F.shiftright("twin", 57).cast("int") + ranges  # null keys: 64 ranges after the others
    placed = placed.withColumn("range", F.when(F.col("key").isNull(), by_hash).otherwise(ranges - 1 - F.col("range")))
    heads = placed.groupBy("range").agg(F.max("key").alias("key"), F.min(F.when(F.col("key").isNull(), F.col("twin"))).alias("twin"))
    heads = sorted(heads.collect(), key=lambda r: r["range"])  # at most MOST_RANGES + NULL_RANGES rows
    if not heads:
        return placed.withColumn("guest", F.lit(False)), 1
    before = [heads[i - 1]["range"] for i in range(len(heads))]
    number = {r: i for i, r in enumerate(sorted(h["range"] for h in heads))}
    spark = df.sparkSession
    follows = spark.createDataFrame(
        [(h["key"], h["twin"], b) for h, b in zip(heads, before)], "h_key long, h_twin long, h_range int")
    same = F.col("key").cast("long").eqNullSafe(F.col("h_key")) & (F.col("key").isNotNull() | (F.col("twin") == F.col("h_twin")))
    guests = rows.join(F.broadcast(follows), same).select("key", "text", "twin", F.col("h_range").alias("range"), F.lit(True).alias("guest"))
    both = placed.select("key", "text", "twin", "range", F.lit(False).alias("guest")).union(guests)
    dense = F.create_map(*[F.lit(x) for r, i in number.items() for x in (r, i)])[F.col("range")] if len(number) < ranges + NULL_RANGES else None
    at = F.col("range") if dense is None else dense
    parts = len(number)
    return both.withColumn("at", at).repartitionById(parts, F.col("at")).sortWithinPartitions(
        "guest", F.col("key").desc_nulls_last(), "twin", "text").drop("at"), parts


def fingerprints(df: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likeness to each other and to the next document's.

    The next document is the one of next lower key; the last is followed by the
    first, so a single document follows itself.  A null text is empty; repeated
    rows follow each other; an empty table gives no rows.
    """
    narrow = df.select(F.col(f"`{key_col}`").alias("key"), text_or_empty(text_col).alias("text"))
    ordered, _ = in_descending_ranges(narrow)
    factors = round_factors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False
        for batch in batches:
            out = []
            for key, text, guest in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("key", "text", "guest"))):
                if done:
                    break
                own = signature(text, factors)
                if held is not None:
                    k, before, signed = held
                    changed = edited(before, text)
                    new = signature(changed, factors)
                    out.append((k, len(before), hashlib.sha256(changed.encode()).hexdigest(), hex_of(signed), hex_of(new),
                                likeness(signed, new), likeness(signed, own)))
                held, done = (key, text, own), guest
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out))], NAMES)

    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, kind)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op10_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{folder}/documents.parquet"))
