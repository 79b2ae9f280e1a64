"""A k-d tree over points with unknown values, as Spark tables.

Points are held apart by which columns they know (their mask), so distances
inside one root are plain scaled sums of squares.  Each level cuts every node
of more than ``leaf_rows`` points along its widest column as weighed by the caller, at quantiles of the
node, into up to ``2 * FAN - 1`` children; values equal to a cut are a child
of their own, so a value that many points share never stops the cutting.  One
aggregate and one checked join per level; no node is ever held by the driver
beyond the bound of a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.plans.fitting import join_stats
from tallyframe.plans.sizing import checkpointed, hold_small

#: A node is cut at up to FAN - 1 of its quantiles.
FAN = 64
#: Nodes of at most this many points are leaves.
LEAF_ROWS = 256

UP, NODE = "__up", "__node"


def grow(
    points: DataFrame, columns: Sequence[str], mask: str, leaf_rows: int = LEAF_ROWS,
    weights: Sequence[float] | None = None,
) -> tuple[DataFrame, list]:
    """The points with their leaf in ``__node``, and one table of nodes per level.

    ``weights`` say how much the width of each column counts (all alike if not
    given); a column of weight zero, which no search looks at, is never cut.

    A node table holds ``__up`` (the parent; null for roots), ``__node``, the
    count ``__n`` and the box ``__lo``, ``__hi`` (arrays, null where the column
    is unknown).  More than ``leaf_rows`` points that are equal in all columns of
    some weight make one larger leaf.
    """
    weights = [1.0] * len(columns) if weights is None else list(weights)
    rows = points.withColumns({UP: F.lit(None).cast("string"), NODE: F.col(mask)})
    probs = [i / FAN for i in range(1, FAN)]
    settled, levels = [], []
    while True:
        stats = rows.groupBy(UP, NODE).agg(
            F.count("*").alias("__n"),
            F.array(*[F.min(c) for c in columns]).alias("__lo"),
            F.array(*[F.max(c) for c in columns]).alias("__hi"),
            F.array(
                *[F.percentile_approx(c, probs, 4 * FAN) if w else F.array().cast("array<double>")
                  for c, w in zip(columns, weights)]
            ).alias("__quantiles"),
        )
        spans = [
            F.coalesce((F.get("__hi", F.lit(i)) - F.get("__lo", F.lit(i))) * w, F.lit(0.0)) if w else F.lit(0.0)
            for i, w in enumerate(weights)
        ]
        stats = checkpointed(
            stats.withColumn("__spans", F.array(*spans))
            .withColumn("__cut", (F.col("__n") > leaf_rows) & (F.array_max("__spans") > 0))
        )
        levels.append(stats.select(UP, NODE, "__n", "__lo", "__hi", (~F.col("__cut")).alias("__leaf")))
        axis = (F.array_position("__spans", F.array_max("__spans")) - 1).cast("int")
        stride = F.greatest(F.lit(1), F.floor(F.lit(FAN * leaf_rows) / F.col("__n"))).cast("int")
        cuts = F.filter(F.get("__quantiles", axis), lambda c, i: (i + 1) % F.col("__stride") == 0)
        plan = (
            stats.where("__cut").withColumn("__stride", F.least(stride, F.lit(FAN // 2)))
            .select(NODE, axis.alias("__axis"), F.array_distinct(cuts).alias("__cuts"))
        )
        if plan.isEmpty():
            return _all([*settled, rows.drop(UP)]), levels
        v = F.get(F.array(*columns), F.col("__axis"))
        # Bound once by a lambda, so that the value is not looked up again for every cut.
        child = F.transform(
            F.array(v),
            lambda x: F.size(F.filter("__cuts", lambda c: c < x)) + F.size(F.filter("__cuts", lambda c: c <= x)),
        )
        path = F.concat_ws(".", NODE, F.get(child, F.lit(0)).cast("string"))
        moved = join_stats(rows.drop(UP), plan, [NODE], "left").withColumn(
            "__next", F.when(F.col("__cuts").isNotNull(), path)
        )
        moved = checkpointed(moved.drop("__axis", "__cuts"))
        settled.append(moved.where(F.col("__next").isNull()).drop("__next"))
        rows = moved.where(F.col("__next").isNotNull()).select(
            *points.columns, F.col(NODE).alias(UP), F.col("__next").alias(NODE)
        )


def _all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def scaled_square(gaps: Sequence[Column]) -> Column:
    """``d / shared * sum of squares`` over the gaps that are known."""
    square, shared = F.lit(0.0), F.lit(0)
    for g in gaps:
        square = square + F.coalesce(g * g, F.lit(0.0))
        shared = shared + F.when(g.isNotNull(), F.lit(1)).otherwise(F.lit(0))
    return F.lit(float(len(gaps))) / shared * square


def nearest(
    seekers: DataFrame, key: Sequence[str], roots: DataFrame, donors: DataFrame, levels: Sequence[DataFrame],
    columns: Sequence[str], value: Column, accept: Column, order: str, k: int,
) -> DataFrame:
    """The k nearest donors of each seeker, ties to the lower ``order``: ``key``, ``__far``, ``order``, ``value``.

    ``roots`` names the trees each ``__mask`` of a seeker meets (``__mask``,
    ``__node``).  ``accept`` tells from a node's box (``__lo``, ``__hi``) whether
    all its donors serve the seeker.  The walk goes down level by level: a node
    stays while its nearest corner is within the k-th least farthest corner.
    Then the nearest leaves are opened, and of the others only those that begin
    within the k-th distance found there.
    """
    key = list(key)
    body = [*key, *columns]

    def corners(far: bool) -> Column:
        gaps = []
        for i, c in enumerate(columns):
            below, above = F.get("__lo", F.lit(i)) - F.col(c), F.col(c) - F.get("__hi", F.lit(i))
            gap = F.greatest(F.abs(below), F.abs(above)) if far else F.greatest(below, above, F.lit(0.0))
            gaps.append(F.when(F.col(c).isNotNull() & F.get("__lo", F.lit(i)).isNotNull(), gap))
        return scaled_square(gaps)

    kept = [*body, NODE, "__n", "__leaf", "__low", "__high"]
    every = Window.partitionBy(*key)
    by_high = every.orderBy("__high", NODE).rowsBetween(Window.unboundedPreceding, 0)
    by_low = every.orderBy("__low", NODE).rowsBetween(Window.unboundedPreceding, -1)
    no_limit = F.lit(float("inf"))

    frontier = None
    for depth, level in enumerate(levels):
        if depth == 0:
            table, few = hold_small(roots.join(level.drop(UP), NODE))
            met = seekers.join(F.broadcast(table) if few else table, "__mask")
        else:
            table, few = hold_small(level)
            steps = frontier.where(~F.col("__leaf")).select(*body, F.col(NODE).alias(UP))
            met = steps.join(F.broadcast(table) if few else table, UP)
        met = met.where(accept).withColumns({"__low": corners(False), "__high": corners(True)}).select(*kept)
        if frontier is not None:
            met = met.unionByName(frontier.where("__leaf"))
        met = met.withColumn("__sum", F.sum("__n").over(by_high))
        reach = F.min(F.when(F.col("__sum") >= k, F.col("__high"))).over(every)
        met = met.withColumn("__reach", F.coalesce(reach, no_limit)).where(F.col("__low") <= F.col("__reach"))
        frontier = checkpointed(met.select(*kept))

    leaves = frontier.withColumn("__first", F.coalesce(F.sum("__n").over(by_low), F.lit(0)) < k)
    pick = Window.partitionBy(*key).orderBy("__far", order)
    offers = donors.select(
        NODE, order, *[F.col(c).alias(f"__d_{i}") for i, c in enumerate(columns)]
    )
    far = scaled_square([F.col(c) - F.col(f"__d_{i}") for i, c in enumerate(columns)])

    def opened(some: DataFrame) -> DataFrame:
        return some.join(offers, NODE).select(*key, order, far.alias("__far"), value.alias("__value"))

    def best(met: DataFrame) -> DataFrame:
        return met.withColumn("__r", F.row_number().over(pick)).where(F.col("__r") <= k)

    first = checkpointed(best(opened(leaves.where("__first"))))
    bound = first.groupBy(*key).agg(F.count("*").alias("__hits"), F.max("__far").alias("__reach"))
    bound = bound.select(*key, F.when(F.col("__hits") >= k, F.col("__reach")).otherwise(no_limit).alias("__reach"))
    rest = leaves.where(~F.col("__first")).join(bound, key).where(F.col("__low") <= F.col("__reach"))
    return best(first.drop("__r").unionByName(opened(rest))).drop("__r")
