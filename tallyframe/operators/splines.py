"""Splines through all known values of a column, solved in buckets of rows.

The slopes of the spline at its known points solve a tridiagonal system over
the whole group.  The known points are cut into stretches of at most
STRETCH_ROWS places; each stretch eliminates its own lines and states its slopes
as ``p + q * (last slope before) + s * (first slope after)``.  The first and
last line of every stretch form a small system, one row per stretch, and its
answer is put back into all lines of the stretch.  No worker holds more than a
stretch of lines, or one summary row per stretch of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.plans.fitting import join_stats
from tallyframe.plans.ordering import BUCKET, place_rows, with_guests
from tallyframe.plans.sizing import checkpointed

#: Known values a group must have for each method.
LEAST = {"quadratic": 3, "cubic": 4}
#: Places of a stretch, which one call on a worker eliminates.
STRETCH_ROWS = 65_536
STRETCH = "__stretch"


def spline(
    df: DataFrame, column: str, order: str, by: Sequence[str] = (), method: str = "cubic",
    buckets: int | None = None, name: str | None = None,
) -> DataFrame:
    """Fill nulls by one smooth curve through all known values, with equal steps between rows.

    ``cubic``      twice differentiable, a knot at every known row but the
                   second and the last but one.
    ``quadratic``  once differentiable, a knot midway between known rows except
                   in the first and the last gap.

    Nulls before the first and after the last known value stay null, and so do
    those of groups with fewer than four (cubic) or three (quadratic) known
    values.  Rows tied in ``order`` follow each other in the order of their other
    columns; known values stay as they are, as double.
    """
    if method not in LEAST:
        raise ValueError(f"unknown method {method!r}; choose from {tuple(LEAST)}")
    name = name or column
    rows = df
    if by:  # as one text, which is never null, so that a null key is a group like any other
        rows, by = df.withColumn("__by", F.to_json(F.struct(*by))), ["__by"]
    rows, n = place_rows(rows, order, by, buckets, "__x")
    rows = rows.withColumns({"__x": F.col("__x").cast("double"), "__y": F.col(column).cast("double")})
    slopes = _slopes(rows.where(F.col("__y").isNotNull()).select(*by, BUCKET, "__x", "__y"), by, n, method)

    # Rows meet their own slope by place, nulls the known rows on both sides.
    keyed = [*by, BUCKET, "__x"]
    same = _same(rows, slopes, keyed)
    named = slopes.select(*[F.col(c).alias(f"__k_{i}") for i, c in enumerate(keyed)], "__slope")
    rows = rows.join(named, same, "left").drop(*[f"__k_{i}" for i in range(len(keyed))])
    if n > 1:
        rows = with_guests(rows, "__x", by, F.col("__y").isNotNull(), ["__y", "__slope"])
    point = F.when(F.col("__y").isNotNull(), F.struct("__x", "__y", "__slope"))
    cell = Window.partitionBy(*by, BUCKET)
    to_here = (Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "__l": F.last(point, ignorenulls=True).over(cell.orderBy("__x").rowsBetween(*to_here)),
            "__r": F.last(point, ignorenulls=True).over(cell.orderBy(F.col("__x").desc()).rowsBetween(*to_here)),
        }
    )
    if n > 1:
        rows = rows.where(~F.col("__guest"))
    filled = F.coalesce(F.col("__y"), _value(F.col("__x"), F.col("__l"), F.col("__r"), method))
    rows = rows.withColumn("__filled", filled)
    kept = [c for c in df.columns if c != name]
    return rows.select(*kept, F.col("__filled").alias(name)).select(*dict.fromkeys([*df.columns, name]))


def _same(rows: DataFrame, slopes: DataFrame, keyed: Sequence[str]) -> Column:
    same = F.lit(True)
    for i, c in enumerate(keyed):
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{i}"))
    return same


def _value(x: Column, a: Column, b: Column, method: str) -> Column:
    h = b["__x"] - a["__x"]
    chord = (b["__y"] - a["__y"]) / h
    da, db = a["__slope"], b["__slope"]
    t, back = x - a["__x"], x - b["__x"]
    if method == "cubic":
        s = t / h
        return a["__y"] + t * (da + s * (3 * chord - 2 * da - db + s * (da + db - 2 * chord)))
    rise = a["__y"] + t * (da + t * (4 * chord - 3 * da - db) / (2 * h))
    fall = b["__y"] + back * (db + back * (3 * db + da - 4 * chord) / (2 * h))
    return F.when(2 * t <= h, rise).otherwise(fall)


def _slopes(known: DataFrame, by: Sequence[str], n: int, method: str) -> DataFrame:
    """The slope at every known point: ``by``, bucket, ``__x``, ``__slope``."""
    rows = known
    if n > 1:
        rows = with_guests(rows, "__x", by, F.lit(True), ["__y"], 2)
    w = Window.partitionBy(*by, BUCKET).orderBy("__x")
    near = {f"__{c}{k:+d}": (F.lag if k < 0 else F.lead)(f"__{c}", abs(k)).over(w) for c in "xy" for k in (-2, -1, 1, 2)}
    rows = rows.withColumns(near)
    if n > 1:
        rows = rows.where(~F.col("__guest"))
    lines = rows.withColumn("__line", F.explode(F.array(_line(method)))).select(*by, BUCKET, "__x", "__line.*")
    lines = lines.withColumn(STRETCH, F.floor(F.col("__x") / STRETCH_ROWS).cast("long"))

    keys = [*by, BUCKET, STRETCH]
    parts = T.StructType(
        [*[lines.schema[c] for c in keys], *[T.StructField(c, T.DoubleType()) for c in ("__x", "__p", "__q", "__s")]]
    )
    solved = checkpointed(lines.groupBy(*keys).applyInPandas(_eliminate(keys), parts))
    ends = solved.groupBy(*keys).agg(
        *[f(c, "__x").alias(f"{c}_{tag}") for c in ("__p", "__q", "__s") for f, tag in ((F.min_by, "f"), (F.max_by, "l"))]
    )
    edge = T.StructType(
        [*[lines.schema[c] for c in keys], T.StructField("__before", T.DoubleType()), T.StructField("__after", T.DoubleType())]
    )
    # One row per (group, bucket, stretch).
    edges = checkpointed(ends.groupBy(*by).applyInPandas(_meet(keys), edge))
    named = edges.select(*[F.col(c).alias(f"__k_{i}") for i, c in enumerate(keys)], "__before", "__after")
    slope = F.col("__p") + F.col("__q") * F.col("__before") + F.col("__s") * F.col("__after")
    return solved.join(named, _same(solved, named, keys)).select(*by, BUCKET, "__x", slope.alias("__slope"))


def _line(method: str) -> Column:
    """The equation of one slope: ``a * before + b * own + c * after = r``.

    Groups with too few points get the equation ``own = null``.
    """
    x, y = F.col("__x"), F.col("__y")
    xm, xp, ym, yp = F.col("__x-1"), F.col("__x+1"), F.col("__y-1"), F.col("__y+1")
    hm, hp = x - xm, xp - x
    sm, sp = (y - ym) / hm, (yp - y) / hp
    k = {"quadratic": 3, "cubic": 2}[method]

    def line(a, b, c, r) -> Column:
        made = [(v if isinstance(v, Column) else F.lit(float(v))).alias(t) for t, v in zip(("a", "b", "c", "r"), (a, b, c, r))]
        return F.struct(*made)

    inner = line(1 / hm, k * (1 / hm + 1 / hp), 1 / hp, (k + 1) * (sm / hm + sp / hp))
    if method == "quadratic":
        first, last = line(0, 1, 1, 2 * sp), line(1, 1, 0, 2 * sm)
    low, high = xm.isNull(), xp.isNull()
    few = (low & high) | (low & F.col("__x+2").isNull()) | (high & F.col("__x-2").isNull())
    if method == "cubic":  # three points: the middle one has no second neighbour, and its null spreads
        few = few | (F.col("__x+2").isNull() & F.col("__x-2").isNull())
        h2, h3 = F.col("__x+2") - xp, xm - F.col("__x-2")
        s2, s3 = (F.col("__y+2") - yp) / h2, (ym - F.col("__y-2")) / h3
        wide, back = hp + h2, hm + h3
        first = line(0, h2, wide, ((hp + 2 * wide) * h2 * sp + hp * hp * s2) / wide)
        last = line(back, h3, 0, ((hm + 2 * back) * h3 * sm + hm * hm * s3) / back)
    lone = line(0, 1, 0, F.lit(None).cast("double"))
    return F.when(few, lone).when(low, first).when(high, last).otherwise(inner)


def _eliminate(keys: Sequence[str]):
    keys = list(keys)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__x", kind="stable")
        a, b, c, r = (part[t].to_numpy(float).tolist() for t in "abcr")
        n = len(a)
        # Right-hand sides: the value, the slope before the stretch, the slope after it.
        p, q, s, up = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        pp = qq = uu = 0.0
        for i in range(n):
            lead = a[i]
            pivot = b[i] - lead * uu if i else b[i]
            pp = (r[i] - lead * pp) / pivot if i else r[i] / pivot
            qq = -lead * (qq if i else 1.0) / pivot
            uu = c[i] / pivot
            p[i], q[i], up[i] = pp, qq, uu
        s[-1], up[-1] = -up[-1], 0.0
        for i in range(n - 2, -1, -1):
            u = up[i]
            p[i] -= u * p[i + 1]
            q[i] -= u * q[i + 1]
            s[i] = -u * s[i + 1]
        return part[keys].assign(**{"__x": part["__x"], "__p": p, "__q": q, "__s": s})

    return solve


def _meet(keys: Sequence[str]):
    keys = list(keys)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([BUCKET, STRETCH], kind="stable")
        lines = part[["__p_f", "__q_f", "__s_f", "__p_l", "__q_l", "__s_l"]].to_numpy(float)
        n = len(lines)
        # Each stretch's first and last slope as alpha + beta * (first slope after it).
        firsts, lasts = np.zeros((n, 2)), np.zeros((n, 2))
        alpha, beta = 0.0, 0.0
        for i, (pf, qf, sf, pl, ql, sl) in enumerate(lines):
            firsts[i] = np.array([pf + qf * alpha, sf]) / (1 - qf * beta)
            lasts[i] = pl + ql * (alpha + beta * firsts[i, 0]), sl + ql * beta * firsts[i, 1]
            alpha, beta = lasts[i]
        before, after = np.zeros(n), np.zeros(n)
        coming = 0.0
        for i in range(n - 1, -1, -1):
            after[i] = coming
            if i + 1 < n:
                before[i + 1] = lasts[i, 0] + lasts[i, 1] * coming
            coming = firsts[i, 0] + firsts[i, 1] * coming
        return part[keys].assign(__before=before, __after=after)

    return solve
