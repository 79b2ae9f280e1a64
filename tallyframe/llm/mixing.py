"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length.  A source whose target passes its size
takes every document once; what is left of the target is fitted by a bounded
knapsack over the lengths, and documents are then picked within each length by
a seeded hash.  No document is taken more than twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import by_value, checkpointed, text_or_empty, word_count

by_value(__name__)

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: A source takes at most so many times its size.
MOST = 2
SEED = 20_240
#: Words of the budget that the dynamic program sees, and rows of one picking window.
PROGRAM_WORDS = 1 << 14
PICK_ROWS = 4_096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target), a stored table, for rows of (source, size).

    Sources are numbered in code-point order, null last, and weigh ``weights``
    in turn.  A source above ``MOST`` times its size stops there and the rest is
    shared again.  Each round is one aggregate over the sources; only its two
    sums reach the driver.  A source without words has target 0.
    """
    totals = checkpointed(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ordered = checkpointed(
        totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}  # one row per partition
    before, seen = {}, 0
    for p in sorted(counts):
        before[p] = seen
        seen += counts[p]
    if not before:
        return totals.withColumn("target", F.lit(0.0))
    start = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)])[part]
    turn = (start + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))) % len(weights)
    weighed = checkpointed(ordered.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).alias("weight")))
    budget = weighed.agg(F.sum("source_size")).first()[0] * share
    level, full = 0.0, None
    while True:
        stopped = F.col("weight") * F.lit(level) >= MOST * F.col("source_size")
        row = weighed.agg(
            F.sum(F.when(stopped, MOST * F.col("source_size"))).alias("held"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("open"), F.sum(stopped.cast("long")).alias("n")).first()
        if full is not None and row["n"] == full or not row["open"]:
            break
        full, level = row["n"], (budget - (row["held"] or 0)) / row["open"]
    target = F.least(F.col("weight") * F.lit(level), (MOST * F.col("source_size")).cast("double"))
    return checkpointed(weighed.select("source", "source_size", target.alias("target")))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the words come nearest to ``budget`` from below.

    Every length first gives its even share, rounded down, of all but the last
    PROGRAM_WORDS of the budget.  Then lengths from the longest on give more
    until twice as many words are left, which an exact bounded knapsack over the
    remaining documents, short ones among them, fills.
    """
    order = np.argsort(-lengths)
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    out = np.zeros(len(size), dtype=np.int64)
    live = size > 0
    whole = int((size * have).sum())
    if whole == 0 or budget <= 0:
        return out
    if budget >= whole:
        out[order] = np.where(live, have, 0)
        return out
    even = max(0, budget - PROGRAM_WORDS)
    pick = np.array([int(h) * even // whole if s else 0 for s, h in zip(size.tolist(), have.tolist())], dtype=np.int64)
    reserve = 0
    for i in np.flatnonzero(live)[::-1]:  # short documents stay free, so that the program can fill small gaps
        back = min(int(pick[i]), max(1, PROGRAM_WORDS // (8 * int(size[i]))))
        pick[i] -= back
        reserve += back * int(size[i])
        if reserve >= PROGRAM_WORDS:
            break
    left = budget - int((size * pick).sum())
    for i in np.flatnonzero(live):
        if left <= 2 * PROGRAM_WORDS:
            break
        more = min(int(have[i] - pick[i]), (left - 2 * PROGRAM_WORDS) // int(size[i]))
        pick[i] += more
        left -= more * int(size[i])
    pick += knapsack(size, have - pick, left)
    out[order] = pick
    return out


def knapsack(size: np.ndarray, have: np.ndarray, budget: int) -> np.ndarray:
    """Counts 0..have of each size with the greatest sum <= budget.

    Reachable sums are bits of an integer.  A length enters as bundles of
    1, 2, 4, ... documents; the sums reached before each bundle are kept for the
    way back.  The program stops as soon as the budget itself is reached.
    """
    limit = (1 << (budget + 1)) - 1
    reached, steps = 1, []
    for i in np.flatnonzero((size > 0) & (size <= budget) & (have > 0)):
        left, bundle = min(int(have[i]), budget // int(size[i])), 1
        while left > 0 and not reached >> budget & 1:
            n = min(bundle, left)
            grown = (reached | reached << n * int(size[i])) & limit
            if grown != reached:
                steps.append((int(i), n, reached))
                reached = grown
            left, bundle = left - n, bundle * 2
        if reached >> budget & 1:
            break
    total = reached.bit_length() - 1
    out = np.zeros(len(size), dtype=np.int64)
    for i, n, before in reversed(steps):
        if not before >> total & 1:
            total -= n * int(size[i])
            out[i] += n
    return out


def plan_lengths(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, every, extra): all documents are taken ``every`` times and ``extra`` of that size once more.

    One task holds the lengths of one source: at most sqrt(2 * words) rows.
    """
    joined = classes.join(targets, classes["source"].eqNullSafe(targets["source"])).select(
        classes["source"], "size", "n", "source_size", "target")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        words, wanted = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        every = min(MOST, int(wanted // words)) if words else 0
        budget = int(round(wanted)) - every * words
        extra = fit_lengths(group["size"].to_numpy(), group["n"].to_numpy(), budget) if every < MOST else 0
        return pd.DataFrame({"source": group["source"], "size": group["size"], "n": group["n"], "every": every, "extra": extra})

    return joined.groupBy("source").applyInPandas(work, "source string, size long, n long, every int, extra long")


def mix(rows: DataFrame, key: list[str], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(key columns, source, size, source_size, target, copies) for a stored table of (key columns, source, size).

    Within a source and length the documents of least seeded hash of the key are
    picked.  A length met very often is cut into hash slices whose counts tell
    how many each slice gives, so that no window holds a hot length.  Repeated
    rows are separate documents, a null source is a source of its own, an empty
    table gives no rows.
    """
    targets = source_targets(rows.select("source", "size"), weights, share)
    classes = checkpointed(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    plan = checkpointed(plan_lengths(classes, targets).select(
        F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "every", "extra"))
    same = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))
    hashed = rows.join(plan, same).withColumn("hash", F.xxhash64(*key, F.lit(seed)))
    slices = F.ceil(F.col("n") / PICK_ROWS)
    sliced = checkpointed(hashed.withColumn("slice", F.pmod(F.shiftright("hash", 20), slices)).drop("p_source", "p_size"))
    held = sliced.where(f"n > {PICK_ROWS}").groupBy("source", "size", "slice").agg(F.count("*").alias("in_slice"))
    upto = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(held.select(
        F.col("source").alias("s_source"), F.col("size").alias("s_size"), F.col("slice").alias("s_slice"),
        F.coalesce(F.sum("in_slice").over(upto), F.lit(0)).alias("before")))
    there = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("slice") == F.col("s_slice"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("hash", *key))
    picked = sliced.join(starts, there, "left").withColumn("__rank", rank + F.coalesce("before", F.lit(0)))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    copies = F.col("every") + (F.col("__rank") <= F.col("extra")).cast("int")
    return picked.withColumn("copies", copies).join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        *key, "source", "size", "source_size", "target", "copies")


def sized(docs: DataFrame, key_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(key, twin, source, size) per document, without its text; ``twin`` orders documents that share a key."""
    text = text_or_empty(text_col)
    return docs.select(F.col(f"`{key_col}`").alias("key"), F.xxhash64(text).alias("twin"),
                       F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"))


def taken(size: Column, copies: Column) -> Column:
    return (size * copies).cast("long")


def repeat_rows(df: DataFrame, copies: Column, columns: list[str]) -> DataFrame:
    """Each row as often as ``copies`` says."""
    return df.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*columns)


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = checkpointed(sized(spark.read.parquet(f"{folder}/documents.parquet")))
    mixed = mix(rows, ["key", "twin"])
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                        taken(F.col("size"), F.col("copies")).alias("taken"), "copies")
