"""Exact interpolated quantiles in two scans, without holding a column in one task.

The built-in ``percentile`` keeps every distinct value of a group in one hash
map, on each task and again in the final one.  Here a sketch is the index of an
exact search:

1. The first scan aggregates a mergeable quantile sketch per (group, column),
   beside any other statistics.  The sketch gives each wanted rank a bracket of
   two values, three times as wide as the sketch's rank error at 99 % confidence.
2. The second scan counts rows by the stretch between brackets that they fall
   into, and by value inside the brackets.  The running counts tell exactly
   which value holds a rank, or that a bracket missed it.

A bracket that holds more than FEW_ROWS rows, where brackets are a 130th of a
group, is first narrowed by a sketch of the rows inside it, one more scan for
every factor of a hundred.  Where a bracket missed its rank the search starts
again from all rows.  All counts combine before their shuffle, so a value that
fills a third of the table moves as one row per task.  NaN is the greatest value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.plans.sizing import hold_small

#: A bracket with at most so many rows is ranked by its distinct values.
FEW_ROWS = 1_000_000
#: Size of a sketch, and its rank error at 99 % confidence.
SKETCH = 4_096
RANK_ERROR = 2.296 / SKETCH**0.9021
#: Half width of a bracket in ranks.
SLACK = 3 * RANK_ERROR
#: Steps of the ranks by which a bracket is narrowed, and how often that is tried.
GRID = 500
NARROWINGS = 8

Quantiles = Mapping[str, tuple[str, float]]


def quantile_columns(quantiles: Quantiles) -> list[str]:
    return sorted({c for c, _ in quantiles.values()})


def _number(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else f"double('{'-' if x < 0 else ''}Infinity')"


def _value(column: str) -> str:
    return f"cast(`{column.replace('`', '``')}` AS double)"


class Search:
    """The wanted places: each has a column, and in the state of a group its ranks, bracket and rows inside.

    Expressions are SQL text, because one text is one call to the JVM.
    """

    def __init__(self, quantiles: Quantiles):
        self.columns = quantile_columns(quantiles)
        self.places = sorted({(self.columns.index(c), float(p)) for c, p in quantiles.values()})
        self.bounds = [f"__{tag}{j}" for j in range(len(self.places)) for tag in ("lo", "hi")]
        self.ranks = [f"__{tag}{j}" for j in range(len(self.places)) for tag in ("at", "to")]
        self.counts = [f"__n{i}" for i in range(len(self.columns))]

    def of(self, column: int) -> list[int]:
        return [j for j, (i, _) in enumerate(self.places) if i == column]

    def first_scan(self) -> list[Column]:
        out = []
        for i, c in enumerate(self.columns):
            v = _value(c)
            out += [F.expr(f"count({v}) AS __n{i}"),
                    F.expr(f"kll_sketch_agg_double(CASE WHEN isnan({v}) THEN double('Infinity') ELSE {v} END, {SKETCH}) AS __k{i}")]
        return out

    def brackets(self, sketched: bool = True) -> list[str]:
        """The state of every place; a group too small for its sketch to matter, or any without one, looks at all values."""
        out = []
        for j, (i, p) in enumerate(self.places):
            n = f"__n{i}"
            all_values = f"({n} <= {int(2 / RANK_ERROR)})" if sketched else "true"
            for tag, rank, end in (("lo", p - SLACK, -math.inf), ("hi", p + SLACK, math.inf)):
                near = f"kll_sketch_get_quantile_double(__k{i}, {_number(rank)})" if sketched and 0 < rank < 1 else _number(end)
                out.append(f"CASE WHEN {all_values} THEN {_number(end)} ELSE {near} END AS __{tag}{j}")
            place = f"({_number(p)} * ({n} - 1))"
            out += [f"floor({place}) AS __at{j}", f"ceil({place}) AS __to{j}",
                    f"CASE WHEN {all_values} THEN {n} ELSE ceil({n} * {_number(min(1.0, 2 * SLACK))}) END AS __size{j}"]
        return out


def _attached(df: DataFrame, by: Sequence[str], state: DataFrame, search: Search) -> tuple[DataFrame, dict[str, str]]:
    """The rows with their group's brackets, as columns or, for a single group, as literals."""
    narrow = [F.col(f"`{c}`") for c in dict.fromkeys([*by, *search.columns])]
    if not by:
        row = state.select(*search.bounds).first()
        return df.select(*narrow), {c: _number(row[c]) for c in search.bounds}
    from tallyframe.plans.fitting import join_stats  # which in turn fits with this module

    return join_stats(df.select(*narrow), state.select(*by, *search.bounds), list(by)), {c: c for c in search.bounds}


def _narrowed(df: DataFrame, by: Sequence[str], state: DataFrame, search: Search, few_rows: int) -> DataFrame:
    """The state after sketching the rows inside brackets that hold too many; one scan a round."""
    many = range(len(search.places))
    for _ in range(NARROWINGS):
        sizes = [f"__size{j}" for j in many]
        if state.where(f"greatest(0, {', '.join(sizes)}) > {few_rows}").isEmpty():
            break
        rows, at = _attached(df, by, state, search)
        aggregates = []
        for j, (i, _) in enumerate(search.places):
            v, lo, hi = _value(search.columns[i]), at[f"__lo{j}"], at[f"__hi{j}"]
            inside = f"({v} >= {lo} AND {v} <= {hi} AND NOT isnan({v}))"
            aggregates += [f"count_if({v} < {lo}) AS __b{j}", f"count_if({inside}) AS __c{j}",
                           f"kll_sketch_agg_double(CASE WHEN {inside} THEN {v} END, {SKETCH}) AS __k{j}"]
        found = rows.groupBy(*by).agg(*[F.expr(e) for e in aggregates])
        both = state.join(found, list(by)) if by else state.crossJoin(found)  # one row each
        grid = ", ".join(_number(g / GRID) for g in range(GRID + 1))
        changed = []
        for j in many:
            held = f"(__at{j} >= __b{j} AND __to{j} - __b{j} < __c{j} AND __c{j} > {few_rows})"
            first = f"cast(floor((__at{j} - __b{j}) / __c{j} * {GRID}) AS int) - 1"
            last = f"cast(ceil((__to{j} - __b{j} + 1) / __c{j} * {GRID}) AS int) + 1"
            steps = f"kll_sketch_get_quantile_double(__k{j}, array({grid}))"
            lo = f"CASE WHEN {held} AND {first} > 0 THEN get({steps}, {first}) ELSE __lo{j} END"
            hi = f"CASE WHEN {held} AND {last} < {GRID} THEN get({steps}, {last}) ELSE __hi{j} END"
            # What cannot be narrowed further, or missed, counts as narrow.
            size = f"CASE WHEN {held} AND {lo} < {hi} THEN ceil(__c{j} * ({last} - {first}) / {GRID}) ELSE 0 END"
            changed += [f"{lo} AS __lo{j}", f"{hi} AS __hi{j}", f"{size} AS __size{j}"]
        kept = [f"`{c}`" for c in state.columns if c not in (*search.bounds, *sizes)]
        state = hold_small(both.selectExpr(*kept, *changed))[0]
    return state


def _ranked(df: DataFrame, by: Sequence[str], state: DataFrame, search: Search) -> DataFrame:
    """(by, column, value, previous count, count so far) of the values and stretches that hold a wanted rank."""
    rows, at = _attached(df, by, state, search)
    cells = []
    for i, c in enumerate(search.columns):
        v, own = _value(c), search.of(i)
        ends = [at[f"__{tag}{j}"] for j in own for tag in ("lo", "hi")]
        stretch = " + ".join(f"cast({v} > {e} AS int) + cast({v} >= {e} AS int)" for e in ends)
        inside = " OR ".join([f"isnan({v})", *[f"{v} >= {at[f'__lo{j}']} AND {v} <= {at[f'__hi{j}']}" for j in own]])
        cells.append(f"named_struct('__c', {i}, '__s', {stretch}, '__v', CASE WHEN {inside} THEN {v} END)")
    long = rows.select(*by, F.expr(f"inline(array({', '.join(cells)}))"))
    counted = long.where("__s IS NOT NULL").groupBy(*by, "__c", "__s", "__v").agg(F.count("*").alias("__m"))
    # Inside brackets at most FEW_ROWS values of a (group, column) are ranked, outside one row per stretch.
    upto = F.sum("__m").over(Window.partitionBy(*by, "__c").orderBy("__s", "__v"))
    ordered = counted.withColumn("__cum", upto).withColumn("__prev", F.col("__cum") - F.col("__m"))
    if by:
        ordered, rank = ordered.join(state.select(*by, *search.ranks), list(by)), {c: c for c in search.ranks}
    else:
        rank = state.select(*search.ranks).first().asDict()
    wanted = " OR ".join(
        f"__c = {i} AND __prev <= {rank[r]} AND __cum > {rank[r]}"
        for j, (i, _) in enumerate(search.places) for r in (f"__at{j}", f"__to{j}") if rank[r] is not None)
    return hold_small(ordered.where(wanted or "false").select(*by, "__c", "__v", "__prev", "__cum"))[0]


def refined_quantiles(
    df: DataFrame, by: Sequence[str], quantiles: Quantiles, exprs: Mapping[str, Column] | None = None, few_rows: int = FEW_ROWS
) -> DataFrame:
    """Columns ``by``, the aggregates ``exprs`` and one exact quantile per name; null where a group has no value."""
    by, exprs, search = list(by), dict(exprs or {}), Search(quantiles)
    names = [f"`{c}`" for c in (*by, *exprs)]
    aggregates = [e.alias(n) for n, e in exprs.items()] + search.first_scan()
    scanned = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    state, bounded = hold_small(scanned.selectExpr(*names, *search.counts, *search.brackets()))
    for attempt in range(2):
        hits = _ranked(df, by, _narrowed(df, by, state, search, few_rows), search)
        if attempt or hits.where("__v IS NULL").isEmpty():
            break
        state = state.selectExpr(*names, *search.counts, *search.brackets(sketched=False))

    picks = []
    for j, (i, _) in enumerate(search.places):
        for side, rank in (("low", "at"), ("high", "to")):
            picks.append(F.expr(f"max(CASE WHEN __c = {i} AND __prev <= __{rank}{j} AND __cum > __{rank}{j} THEN __v END) AS __{side}{j}"))
    side = state.selectExpr(*names, *search.counts, *search.ranks)
    # One row per group and a few hits each; without keys every hit belongs to the one row.
    joined = side.join(F.broadcast(hits) if bounded else hits, list(by), "left") if by else side.join(hits, F.lit(True), "left")
    out = []
    for name, (c, p) in quantiles.items():
        i = search.columns.index(c)
        j = search.places.index((i, float(p)))
        place = f"({_number(p)} * (__n{i} - 1))"
        # Equal neighbours need no line between them, which infinite ones do not have.
        line = f"__low{j} + (__high{j} - __low{j}) * ({place} - floor({place}))"
        out.append(F.expr(f"CASE WHEN __low{j} = __high{j} THEN __low{j} ELSE {line} END").alias(name))
    picked = joined.groupBy(*[F.col(n) for n in (*names, *search.counts)]).agg(*picks)
    return picked.select(*[F.col(n) for n in names], *out)


def nth_values(df: DataFrame, by: Sequence[str], column: str, n: int, few_rows: int = FEW_ROWS) -> DataFrame:
    """(by, nth): the n-th smallest value of ``column`` per group, or the greatest of a smaller group; null without values.

    The search is that of the quantiles, only that the rank is given and not
    its share of the rows: one scan counts the groups, further ones narrow the
    brackets of groups with more than ``few_rows`` rows, the last one ranks.
    """
    by, search = list(by), Search({"nth": (column, 0.0)})
    counted = df.groupBy(*by).agg(F.expr(f"count({_value(column)}) AS __n0"))
    place = f"least({int(n)}, __n0) - 1"
    ends = [f"{_number(-math.inf)} AS __lo0", f"{_number(math.inf)} AS __hi0", f"{place} AS __at0", f"{place} AS __to0", "__n0 AS __size0"]
    state, _ = hold_small(counted.selectExpr(*[f"`{c}`" for c in by], "__n0", *ends))
    for attempt in range(2):
        hits = _ranked(df, by, _narrowed(df, by, state, search, few_rows) if attempt == 0 else state, search)
        if hits.where("__v IS NULL").isEmpty():
            break
    return state.select(*by).join(hits.select(*by, F.col("__v").alias("nth")), by, "left")
