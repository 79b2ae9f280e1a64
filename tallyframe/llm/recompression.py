"""Periodic runs of words, found by recompression and grammar LCE queries.

The words of a block of texts become the lowest level of a run-length grammar.
Rounds alternate between block compression, where a repeated symbol becomes one
symbol of its count, and pair compression, where symbols are dealt into a left
and a right class and each left symbol followed by a right one becomes one
symbol.  Equal stretches of words get equal symbols apart from their edges, so
the longest common extension of two places is found by walking both up the
levels until their symbols differ and down again to the first unequal word.

A run of period p and length >= max(12, 2 p) holds a pair (i, i + p) of equal
words with i on the grid of multiples of max(p, 12 - p).  Summed over all p the
grid has O(n log n) places.  Each such pair is extended both ways by the
grammar, and the extent is a run if it is long enough.  No suffix array is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import SPACE, by_value, text_or_empty

by_value(__name__)

#: A run has at least so many words, and at least twice its period.
LEAST_WORDS = 12
#: Words of the texts that share one grammar; a longer text has its own.
BLOCK_WORDS = 200_000
#: Grid places looked at in one step.
STEP = 1_000_000
SEED = 11
#: The symbol before, between and after texts.
EDGE = 0


class Level:
    """One level of the grammar, read in one direction.

    ``symbols[x]`` stands for a stretch of the level below that starts at
    ``down[x]``.  ``up[x]`` is the place of x in the level above, ``first[x]``
    tells whether x starts the symbol above, and ``left`` counts the places from
    x to the end of its block (None if the level above joins pairs).
    """

    __slots__ = ("symbols", "up", "first", "left", "down")

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.up, self.first, self.left, self.down = symbols, None, None, None, None


def compress_blocks(symbols: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(next symbols, starts of their stretches, names used) after joining equal neighbours; None if there are none."""
    fresh = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (symbols[1:] == EDGE)])
    starts = np.flatnonzero(fresh)
    if len(starts) == len(symbols):
        return None
    sizes = np.diff(np.append(starts, len(symbols)))
    above = symbols[starts].copy()
    many = sizes > 1
    _, code = np.unique(above[many] * (int(sizes.max()) + 1) + sizes[many], return_inverse=True)
    above[many] = names + code
    return above, starts, names + int(code.max()) + 1


def compress_pairs(symbols: np.ndarray, names: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int]:
    """The same after joining each symbol of the left class with a following one of the right class."""
    right = rng.integers(0, 2, names, dtype=np.int8)[symbols].astype(bool)
    inner = (symbols[:-1] != EDGE) & (symbols[1:] != EDGE) & (right[:-1] != right[1:])
    joined = inner & right[1:]
    if 2 * np.count_nonzero(joined) < np.count_nonzero(inner):
        joined = inner & right[:-1]  # the classes change sides
    starts = np.flatnonzero(np.concatenate([[True], ~joined]))
    above = symbols[starts].copy()
    pairs = np.flatnonzero(joined)
    if not len(pairs):
        return above, starts, names
    _, code = np.unique(symbols[pairs] * names + symbols[pairs + 1], return_inverse=True)
    above[np.searchsorted(starts, pairs)] = names + code
    return above, starts, names + int(code.max()) + 1


def build_grammar(symbols: np.ndarray, seed: int = SEED) -> list[Level]:
    """Levels from the words up to one symbol per text; ``symbols`` begin and end with EDGE."""
    rng = np.random.default_rng(seed)
    names = int(symbols.max(initial=0)) + 1
    levels = [Level(symbols.astype(np.int64))]
    blocks = True
    while True:
        low = levels[-1]
        if not ((low.symbols[1:] != EDGE) & (low.symbols[:-1] != EDGE)).any():
            return levels
        step = compress_blocks(low.symbols, names) if blocks else compress_pairs(low.symbols, names, rng)
        if step is not None and len(step[1]) < len(low.symbols):
            above, starts, names = step
            low.first = np.zeros(len(low.symbols), bool)
            low.first[starts] = True
            low.up = np.cumsum(low.first) - 1
            if blocks:
                ends = np.append(starts[1:], len(low.symbols))
                low.left = ends[low.up] - np.arange(len(low.symbols))
            levels.append(Level(above))
            levels[-1].down = starts
        blocks = not blocks


def reversed_grammar(levels: list[Level]) -> list[Level]:
    """The same grammar read from right to left."""
    out = []
    for at, level in enumerate(levels):
        back = Level(level.symbols[::-1])
        size = len(level.symbols)
        if level.up is not None:
            back.up = len(levels[at + 1].symbols) - 1 - level.up[::-1]
            back.first = np.append(level.first[1:], True)[::-1]  # the last of a stretch comes first
            if level.left is not None:
                back.left = (np.arange(size) - levels[at + 1].down[level.up] + 1)[::-1]
        if level.down is not None:
            below = len(levels[at - 1].symbols)
            back.down = (below - np.append(level.down[1:], below))[::-1]
        out.append(back)
    return out


def common_extension(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols of the lowest level are equal from the places x and y on, x <> y in one text."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    begin = x.copy()
    stopped: list[np.ndarray] = []  # by level, the queries whose symbols differ there
    alive = np.arange(len(x))
    for level in levels[:-1]:
        a, b = x[alive], y[alive]
        same = level.symbols[a] == level.symbols[b]
        even = level.first[a] & level.first[b]
        # At the edge of a stretch both may go up; elsewhere the rest of the stretch is compared here.
        ended = ~even & ~same
        inside = ~even & same
        if inside.any():
            if level.left is None:
                ahead = inside.astype(np.int64)
            else:
                rest_a, rest_b = level.left[a], level.left[b]
                ahead = np.where(inside, np.minimum(rest_a, rest_b), 0)
                ended |= inside & (rest_a != rest_b)
            a, b = a + ahead, b + ahead
            x[alive], y[alive] = a, b
        stopped.append(alive[ended])
        going = ~ended
        alive = alive[going]
        x[alive], y[alive] = level.up[a[going]], level.up[b[going]]
    falling = alive
    for at in range(len(levels) - 2, -1, -1):
        low, high = levels[at], levels[at + 1]
        a, b = high.down[x[falling]], high.down[y[falling]]
        ahead = (low.symbols[a] == low.symbols[b]).astype(np.int64)
        if low.left is not None:
            ahead *= np.minimum(low.left[a], low.left[b])
        x[falling], y[falling] = a + ahead, b + ahead
        falling = np.concatenate([falling, stopped[at]])
    return x - begin


def grid_pairs(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place i, period p) of grid pairs with equal words i and i + p, a bounded number at a time."""
    n = len(words)
    periods = np.arange(1, n // 2 + 1)
    gaps = np.maximum(periods, LEAST_WORDS - periods)
    upto = np.cumsum(-(-(n - periods) // gaps))
    start = 0
    while start < len(periods):
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + STEP, "right")))
        counts = np.diff(upto[start:stop], prepend=done)
        p = np.repeat(periods[start:stop], counts)
        i = (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * np.repeat(gaps[start:stop], counts)
        equal = words[i] == words[i + p]
        yield i[equal], p[equal]
        start = stop


def block_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each text of word numbers (from 1) as rows (start, length, period), by start and period."""
    runs = [np.zeros((0, 3), np.int64) for _ in texts]
    long_enough = [t for t in range(len(texts)) if len(texts[t]) >= LEAST_WORDS]
    if not long_enough:
        return runs
    parts, offsets, at = [np.array([EDGE])], np.zeros(len(texts), np.int64), 1
    for t in long_enough:
        offsets[t] = at
        parts += [texts[t], np.array([EDGE])]
        at += len(texts[t]) + 1
    levels = build_grammar(np.concatenate(parts))
    backward = reversed_grammar(levels)
    held: list[tuple[np.ndarray, ...]] = []
    found: dict[int, list[np.ndarray]] = {}

    def extend() -> None:
        if not held:
            return
        text, i, p = (np.concatenate(c) for c in zip(*held))
        held.clear()
        base = offsets[text]
        ahead = common_extension(levels, base + i, base + i + p)
        behind = common_extension(backward, at - (base + i), at - (base + i + p))
        length = ahead + behind + p
        keep = length >= np.maximum(LEAST_WORDS, 2 * p)
        text, start, length, p = text[keep], (i - behind)[keep], length[keep], p[keep]
        # Of the periods of one extent the smallest divides the others.
        order = np.lexsort((p, length, start, text))
        rows = np.column_stack([text, start, length, p])[order]
        if len(rows):
            rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])]
            cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            for some in np.split(rows, cuts):
                found.setdefault(int(some[0, 0]), []).append(some[:, 1:])

    waiting = 0
    for t in long_enough:
        for i, p in grid_pairs(texts[t]):
            if len(i):
                held.append((np.full(len(i), t), i, p))
                waiting += len(i)
                if waiting >= STEP:
                    extend()
                    waiting = 0
    extend()
    for t, some in found.items():
        rows = np.concatenate(some)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
        runs[t] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return runs


def covered(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words any run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def find_runs(df: DataFrame, text_col: str = "text", runs_name: str = "runs", collapsed_name: str = "collapsed") -> DataFrame:
    """All columns of ``df``, the periodic runs of the words of its text, and the text without their repeats.

    ``runs`` is an array of (start, length, period) by start, then period: the
    maximal stretches of words of smallest period q and at least max(12, 2 q)
    words.  ``collapsed`` joins by one space the words that no run holds after
    its first q words.  A null or empty text has no runs and an empty collapsed
    text; rows are independent, so repeated rows repeat and an empty table stays
    empty.  A column that already has one of the two names raises ValueError.
    """
    clash = {runs_name, collapsed_name} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    place = df.columns.index(text_col)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        every, collapsed = [], []
        numbers: dict[bytes, int] = {}
        waiting: list[tuple[list[bytes], np.ndarray]] = []
        size = 0

        def flush() -> None:
            for (words, codes), runs in zip(waiting, block_runs([codes for _, codes in waiting])):
                every.append(runs)
                if len(runs):
                    words = [words[k] for k in np.flatnonzero(~covered(runs, len(codes)))]
                collapsed.append(b" ".join(words).decode())
            waiting.clear()
            numbers.clear()

        for text in batch.column(place):
            words = (text.as_py() or "").encode().split()
            if size and size + len(words) > BLOCK_WORDS:
                flush()
                size = 0
            codes = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int64, len(words))
            waiting.append((words, codes))
            size += len(words)
        flush()
        ends = np.cumsum([0, *map(len, every)]).astype(np.int32)
        rows = np.concatenate(every) if every else np.zeros((0, 3), np.int64)
        lists = pa.ListArray.from_arrays(
            pa.array(ends), pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(run_type)))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, lists, pa.array(collapsed, pa.string())], [*batch.schema.names, runs_name, collapsed_name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    one = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    kind = T.StructType([*df.schema.fields, T.StructField(runs_name, T.ArrayType(one)), T.StructField(collapsed_name, T.StringType())])
    return df.mapInArrow(run, kind)


def with_planted_runs(text: Column, key: Column) -> Column:
    """The text with a planted run where crc32 of the key's text is divisible by 10; a null key plants none."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(words, i)), " ")).otherwise("")

    # A one-element array holds the words, so that the split runs once.
    words = F.array(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))
    return F.when(h % 10 == 0, F.element_at(F.transform(words, planted), 1)).otherwise(text)


def op11_recompression(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every whole document after planting, the longest one, and digests of all runs and of the text without repeats.

    A null text is empty; a null doc_id plants no run; repeated rows repeat.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", text_or_empty().alias("text"))
    planted = docs.select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(planted).drop("text")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
