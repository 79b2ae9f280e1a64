"""Correlation: Pearson, Spearman, Kendall, and least-squares lines."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.clean import columns_by_kind
from tallyframe.operators.ordered import value_ranks
from tallyframe.plans.fitting import fit
from tallyframe.plans.sizing import checkpointed, small_table

#: Counting functions travel with the task, so that workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

METHODS = ("pearson", "spearman", "kendall")
#: A Kendall counting task gets about this many distinct pairs.
KENDALL_ROWS = 500_000
KENDALL_BUCKETS = 1_000


def corr_pair(df: DataFrame, x: str, y: str, method: str = "pearson") -> float | None:
    """Correlation of two columns over the rows that have both."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose from {METHODS}")
    if method == "pearson":
        return fit(df, {"r": F.corr(F.col(x).cast("double"), F.col(y).cast("double"))})["r"]
    return corr_spearman(df, x, y) if method == "spearman" else corr_kendall(df, x, y)


def corr_lower_triangle(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """(x, y, r) for the pairs below the diagonal; the default is all numeric columns."""
    columns = list(columns or columns_by_kind(df, "numeric"))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    if method == "pearson":  # every pair in one aggregate
        found = fit(df, {f"{a}|{b}": F.corr(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs})
        rows = [(a, b, found[f"{a}|{b}"]) for a, b in pairs]
    else:
        rows = [(a, b, corr_pair(df, a, b, method)) for a, b in pairs]
    return small_table(df.sparkSession, rows, "x string, y string, r double")


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """(x, y, r) for every ordered pair; each pair is computed once."""
    columns = list(columns or columns_by_kind(df, "numeric"))
    below = corr_lower_triangle(df, columns, method)
    above = below.select(F.col("y").alias("x"), F.col("x").alias("y"), "r")
    ones = small_table(df.sparkSession, [(c, c, 1.0) for c in columns], below.schema)
    return below.unionByName(above).unionByName(ones)


def _both(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()


def _distinct_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return _both(df, x, y).groupBy("x", "y").agg(F.count("*").alias("n"))


def corr_spearman(df: DataFrame, x: str, y: str, buckets: int | None = None) -> float | None:
    """Pearson correlation of average ranks, on counted distinct pairs.

    Each rank table has one row per value, and the pairs that meet it are
    already counted, so a value that fills a third of the rows stays small.
    """
    rows = _both(df, x, y)
    n_all = rows.count()
    if n_all < 2:
        return None
    pairs = _distinct_pairs(df, x, y)
    for side in ("x", "y"):
        counted = rows.groupBy(side).agg(F.count("*").alias("w"))
        ranks = value_ranks(counted, side, "w", buckets).withColumnRenamed("average_rank", f"r{side}")
        pairs = pairs.join(ranks, side)
    centre = F.lit((n_all + 1) / 2)  # average ranks always have this mean
    a, b, n = F.col("rx") - centre, F.col("ry") - centre, F.col("n")
    m = fit(pairs, {"xy": F.sum(n * a * b), "xx": F.sum(n * a * a), "yy": F.sum(n * b * b)})
    below = math.sqrt(m["xx"] * m["yy"])
    return m["xy"] / below if below else None


def _ordered_weight(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Concordant minus discordant weight over pairs that differ in x and y.

    Two y codes first differ at one bit.  Per bit, rows that agree above it
    form blocks, and running sums along x count the rows before each row that
    fall on the other side of the bit.
    """
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order].astype("float64")
    codes = np.unique(y[order], return_inverse=True)[1].astype("int64")
    total = 0.0
    for bit in range(int(codes.max(initial=0)).bit_length()):
        block = codes >> (bit + 1)
        by_block = np.argsort(block, kind="stable")
        b, xs, ws = block[by_block], x[by_block], w[by_block]
        high = (codes[by_block] >> bit & 1).astype(bool)
        new_block = np.r_[True, b[1:] != b[:-1]]
        new_run = new_block | np.r_[True, xs[1:] != xs[:-1]]
        here = np.arange(len(b))
        block_start = np.maximum.accumulate(np.where(new_block, here, 0))
        run_start = np.maximum.accumulate(np.where(new_run, here, 0))
        for side, sign in ((high, 1.0), (~high, -1.0)):
            other = np.r_[0.0, np.cumsum(np.where(side, 0.0, ws))]
            total += sign * float(np.sum(ws[side] * (other[run_start] - other[block_start])[side]))
    return total


def _count_ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    s = _ordered_weight(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy())
    return pd.DataFrame({"s": [s]})


def _side_buckets(pairs: DataFrame, side: str, wanted: int) -> tuple[DataFrame, list[float]]:
    """Bucket one side by its quantiles; a value filling several buckets gets its own."""
    cuts = pairs.approxQuantile(side, [i / wanted for i in range(1, wanted)], 1 / (4 * wanted))
    alone = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    edges = sorted({*cuts, *[math.nextafter(a, math.inf) for a in alone]})
    splits = [-math.inf, *edges, math.inf]
    out = Bucketizer(splits=splits, inputCol=side, outputCol=f"b{side}").transform(pairs)
    return out, [float(edges.index(a) + 1) for a in alone]


def corr_kendall(df: DataFrame, x: str, y: str, task_rows: int = KENDALL_ROWS) -> float | None:
    """Kendall's tau-b, exact, without forming pairs of rows.

    Equal rows collapse to counted distinct pairs.  Both columns are cut into
    buckets; two rows are then compared in exactly one place: by their buckets
    when both differ (a bounded table of bucket counts), inside their shared x
    bucket, or inside their shared y bucket.  Each such piece is a sort-based
    count over about ``task_rows`` rows.
    """
    pairs = checkpointed(_distinct_pairs(df, x, y))
    m = fit(pairs, {"rows": F.count("*"), "n": F.sum("n")})
    if not m["n"] or m["n"] < 2:
        return None

    def tied(side: str) -> float:
        t = F.col("t").cast("double")
        counted = pairs.groupBy(side).agg(F.sum("n").alias("t"))
        return fit(counted, {"s": F.sum(t * (t - 1) / 2)})["s"]

    wanted = min(KENDALL_BUCKETS, math.ceil(m["rows"] / task_rows))
    if wanted <= 1:
        pieces = pairs.select(F.lit("all").alias("piece"), "x", "y", "n")
    else:
        cut, alone_x = _side_buckets(pairs, "x", wanted)
        cut, alone_y = _side_buckets(cut, "y", wanted)

        def piece(tag: str, key: Column | None) -> Column:
            return F.lit(tag) if key is None else F.concat(F.lit(tag), key.cast("string"))

        coarse = cut.groupBy("bx", "by").agg(F.sum("n").alias("n")).select(
            piece("both", None).alias("piece"), F.col("bx").alias("x"), F.col("by").alias("y"), "n"
        )
        # A bucket of one x value has no ordered pair inside; the same for y.
        same_x = cut.where(~F.col("bx").isin(alone_x)).select(piece("x", F.col("bx")).alias("piece"), "x", "y", "n")
        same_y = (
            cut.where(~F.col("by").isin(alone_y))
            .groupBy("bx", "by", "y")
            .agg(F.sum("n").alias("n"))
            .select(piece("y", F.col("by")).alias("piece"), F.col("bx").alias("x"), "y", "n")
        )
        pieces = coarse.unionByName(same_x).unionByName(same_y)
    signed = pieces.groupBy("piece").applyInPandas(_count_ordered, "s double")
    s = fit(signed, {"s": F.sum("s")})["s"]
    every = m["n"] * (m["n"] - 1) / 2
    below = math.sqrt((every - tied("x")) * (every - tied("y")))
    return s / below if below else None


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x."""
    b, a = F.col(y).cast("double"), F.col(x).cast("double")
    return df.agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
        F.regr_count(b, a).alias("n"),
    )
