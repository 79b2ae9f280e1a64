"""Whole-table aggregates, profiles, histograms and box-plot numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.clean import columns_by_kind
from tallyframe.plans.fitting import fit, fit_by, join_stats
from tallyframe.plans.ordering import key_value
from tallyframe.plans.sizing import small_table


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


# --- single numbers --------------------------------------------------------

def row_count(df: DataFrame) -> DataFrame:
    """Rows and columns of the table."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def column_count(df: DataFrame) -> int:
    return len(df.columns)


def total(df: DataFrame, column: str) -> DataFrame:
    """Sum; 0 when there is nothing to add."""
    kind = "double" if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else "long"
    return df.agg(F.coalesce(F.sum(column), F.lit(0).cast(kind)).alias("total"))


def mean(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def minimum(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("minimum"))


def maximum(df: DataFrame, column: str, floor=None) -> DataFrame:
    """Largest value; with ``floor`` the result never falls below it."""
    top = F.max(column)
    return df.agg((top if floor is None else F.greatest(top, F.lit(floor))).alias("maximum"))


def conditional_sum(df: DataFrame, condition: Column, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).alias("total"))


def row_of_max(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """The whole row with the largest value, of any type; the lowest id wins a tie."""
    return _extreme(df, F.max, column, row_id)


def row_of_min(df: DataFrame, column: str, row_id: str) -> DataFrame:
    return _extreme(df, F.min, column, row_id)


def _extreme(df: DataFrame, pick, column: str, row_id: str) -> DataFrame:
    top = fit(df, {"top": pick(_q(column))})["top"]
    hit = _q(column) == F.lit(top) if top is not None else F.lit(False)
    best = df.where(hit).agg(F.min_by(F.struct(*[_q(c) for c in df.columns]), _q(row_id)).alias("r"))
    return best.where(F.col("r").isNotNull()).select("r.*")


def any_match(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("any_match"))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Sample standard deviation and variance; null for a single row."""
    return df.agg(
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("std", F.stddev_samp), ("var", F.var_samp))]
    )


def quantile(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles, one row per probability."""
    found = fit(df, quantiles={f"q{i}": (column, p) for i, p in enumerate(probs)})
    rows = [(float(p), found[f"q{i}"]) for i, p in enumerate(probs)]
    return small_table(df.sparkSession, rows, "p double, value double")


def quantile_sketch(df: DataFrame, column: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """The cheap option: one pass, rank error at most 1/accuracy."""
    pairs = F.arrays_zip(
        F.array(*[F.lit(float(p)) for p in probs]).alias("p"),
        F.percentile_approx(column, list(probs), accuracy).alias("value"),
    )
    return df.agg(pairs.alias("z")).select(F.inline("z").alias("p", "value"))


def median(df: DataFrame, column: str) -> DataFrame:
    found = fit(df, quantiles={"median": (column, 0.5)})
    return small_table(df.sparkSession, [(found["median"],)], "median double")


def mode(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null value; the smallest wins a tie.

    Values are counted in a shuffle of their own, so no task holds them all.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(column).alias("v")))["v"].alias("mode")
    return counted.groupBy(*by).agg(best) if by else counted.agg(best)


# --- profiles --------------------------------------------------------------

def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent of rows per column, from one aggregate."""
    columns = list(columns or df.columns)
    counted = df.agg(F.count("*").alias("__rows"), *[F.count(_q(c)).alias(c) for c in columns])
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col("__rows") - _q(c)).alias("nulls"),
            F.round(F.try_divide((F.col("__rows") - _q(c)) * 100.0, F.col("__rows")), 2).alias("null_percent"),
        )
        for c in columns
    ]
    return counted.select(F.inline(F.array(*entries)))


def columns_with_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return null_profile(df, columns).where(F.col("nulls") > 0).select("column")


def column_profile(df: DataFrame) -> DataFrame:
    """Column, type, nulls and percent; the type comes from the schema."""
    kinds = F.lit("")
    for name, kind in df.dtypes:
        kinds = F.when(F.col("column") == name, F.lit(kind)).otherwise(kinds)
    return null_profile(df).withColumn("type", kinds).select("column", "type", "nulls", "null_percent")


def distinct_count(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values of each column, from one plan."""
    columns = list(columns or df.columns)
    count = F.approx_count_distinct if approximate else F.count_distinct
    counted = df.agg(*[count(_q(c)).alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("column"), _q(c).alias("n_distinct")) for c in columns]
    return counted.select(F.inline(F.array(*entries)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values including null, in no particular order."""
    return df.select(column).distinct()


_QUARTILES = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns, one row each."""
    columns = list(columns or columns_by_kind(df, "numeric"))
    plain = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    exprs = {f"{c}|{n}": f(_q(c)) for c in columns for n, f in plain.items()}
    quartiles = {f"{c}|{n}": (c, p) for c in columns for n, p in _QUARTILES}
    row = fit(df.select(*[_q(c) for c in columns]), exprs, quartiles)
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    rows = [
        (c, row[f"{c}|count"], *[None if row[f"{c}|{n}"] is None else float(row[f"{c}|{n}"]) for n in names[1:]])
        for c in columns
    ]
    schema = "column string, count long, " + ", ".join(f"`{n}` double" for n in names[1:])
    return small_table(df.sparkSession, rows, schema)


def describe_times(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, min, quartiles and max of time columns, as times."""
    columns = list(columns or columns_by_kind(df, "time"))
    micros = df.select(*[key_value(df, c).alias(c) for c in columns])
    numbers = describe(micros, columns).drop("std")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    back = {
        c: F.timestamp_add("MICROSECOND", F.round(F.col(c)).cast("long"), epoch)
        for c in numbers.columns
        if c not in ("column", "count")
    }
    return numbers.withColumns(back)


def before_after(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """The same statistics before and after a treatment, tagged by ``stage``."""
    stages = ("before", "after")
    both = [d.select(*[_q(column).cast("double").alias(t) if t == s else F.lit(None).cast("double").alias(t) for t in stages])
            for d, s in zip((before, after), stages)]
    described = describe(both[0].unionByName(both[1]), list(stages))  # one search over both
    return described.withColumnRenamed("column", "stage").select(
        F.lit(column).alias("column"), *[c for c in described.columns if c != "column"], "stage")


# --- histogram and density -------------------------------------------------

def _auto_bins(n: int, low: float, high: float, iqr: float) -> int:
    """Bin count of the narrower of the Sturges and Freedman-Diaconis widths."""
    span = high - low
    if n == 0 or span == 0:
        return 1
    width = span / (math.log2(n) + 1)
    spread = 2 * iqr / n ** (1 / 3)
    return max(1, math.ceil(span / (min(width, spread) if spread > 0 else width)))


def _fit_bins(df: DataFrame, column: str, bins: int | None) -> tuple[int, float, float] | None:
    c = F.col(column).cast("double")
    edges = {"low": F.min(c), "high": F.max(c), "n": F.count(c)}
    quartiles = {} if bins else {"q1": (column, 0.25), "q3": (column, 0.75)}
    s = fit(df.select(column), edges, quartiles)
    if not s["n"]:
        return None
    bins = bins or _auto_bins(s["n"], s["low"], s["high"], s["q3"] - s["q1"])
    low, high = s["low"], s["high"]
    if low == high:  # a constant column gets a unit range around its value
        low, high = low - 0.5, high + 0.5
    return bins, low, (high - low) / bins


def bin_number(column: str, low: float, width: float, bins: int) -> Column:
    """Equal-width bin, the last one closed on both sides."""
    place = F.floor((F.col(column).cast("double") - F.lit(low)) / F.lit(width))
    return F.least(place, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int | None = 10) -> DataFrame:
    """Counts per equal-width bin with its edges, bins without rows included; ``bins=None`` chooses the number.

    A column without values has no bins.
    """
    fitted = _fit_bins(df, column, bins)
    if fitted is None:
        return small_table(df.sparkSession, [], "bin int, left double, right double, n long")
    bins, low, width = fitted
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(bin_number(column, low, width, bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    left = F.lit(low) + F.col("bin") * F.lit(width)
    return every.join(counted, "bin", "left").select(
        "bin", left.alias("left"), (left + F.lit(width)).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))


#: Bins of a bandwidth, and the bandwidths beyond which a kernel counts as zero (it is below 2e-14 there).
BINS_PER_BAND = 10
KERNEL_REACH = 8
#: Terms of a bin's expansion; with distances up to a twentieth of a bandwidth the rest is below 1e-9 of a kernel's peak.
KERNEL_TERMS = 6


def density_curve(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density with the Scott bandwidth on an even grid, within 1e-9 of a kernel's peak.

    Rows are summed in bins of a tenth of the bandwidth, wherever the range
    ends: each occupied bin keeps the sums of the first powers of the distances
    to its centre, from which its kernels expand in Hermite polynomials.  A bin
    meets only the grid points within KERNEL_REACH bandwidths.  Nulls are left
    out; a column without spread, or with NaN or infinity, has no curve.
    """
    c = F.col(f"`{column}`").cast("double")
    s = fit(df, {"low": F.min(c), "high": F.max(c), "n": F.count(c), "std": F.stddev_samp(c)})
    if not s["std"] or not math.isfinite(s["std"]):
        return small_table(df.sparkSession, [], "point int, x double, density double")
    band = s["std"] * s["n"] ** -0.2
    width, step = band / BINS_PER_BAND, (s["high"] - s["low"]) / (points - 1)
    low = F.lit(s["low"])
    placed = df.where(c.isNotNull()).select(c.alias("__v"), F.floor((c - low) / F.lit(width)).alias("bin"))
    centre = low + (F.col("bin") + 0.5) * F.lit(width)
    away = (F.col("__v") - centre) / F.lit(band)
    powers = [F.count("*").cast("double"), *[F.sum(F.pow(away, F.lit(m))) for m in range(1, KERNEL_TERMS)]]
    bins = placed.groupBy("bin").agg(*[e.alias(f"s{m}") for m, e in enumerate(powers)]).withColumn("centre", centre)
    reach = F.lit(band * (KERNEL_REACH + 1))
    first = F.greatest(F.ceil((F.col("centre") - reach - low) / F.lit(step)), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("centre") + reach - low) / F.lit(step)), F.lit(points - 1)).cast("int")
    met = bins.withColumns({"first": first, "last": last}).where("first <= last").withColumn("point", F.explode(F.sequence("first", "last")))
    z = (low + F.col("point") * F.lit(step) - F.col("centre")) / F.lit(band)
    met = met.withColumn("z", z)
    hermite = [F.lit(1.0), F.col("z")]
    while len(hermite) < KERNEL_TERMS:
        m = len(hermite)
        hermite.append(F.col("z") * hermite[-1] - F.lit(m - 1.0) * hermite[-2])
    kernel = sum((F.col(f"s{m}") / F.lit(float(math.factorial(m))) * h for m, h in enumerate(hermite)), F.lit(0.0))
    sums = met.groupBy("point").agg(F.sum(kernel * F.exp(-F.col("z") * F.col("z") / 2)).alias("sum"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    scale = s["n"] * band * math.sqrt(2 * math.pi)
    return grid.join(sums, "point", "left").select(
        "point", (low + F.col("point") * F.lit(step)).alias("x"), (F.coalesce("sum", F.lit(0.0)) / F.lit(scale)).alias("density"))


# --- box plot --------------------------------------------------------------

def boxplot_stats(
    df: DataFrame, column: str, by: Sequence[str] = (), share_of: str = "rows"
) -> DataFrame:
    """Quartiles, bounds, whiskers and outliers, per group if ``by`` is given.

    ``share_of`` is ``rows`` or ``values``: what the outlier percent divides by.
    """
    by = list(by)
    if by:
        df = df.na.drop(subset=by)
    c = F.col(column)
    exprs = {"min": F.min(c), "max": F.max(c), "n_rows": F.count("*"), "n_values": F.count(c)}
    counts = ("n_rows", "n_values")
    quartiles = {"q1": (column, 0.25), "median": (column, 0.5), "q3": (column, 0.75)}
    needed = df.select(*by, column)
    if by:
        stats = fit_by(needed, by, exprs, quartiles)
        linked = join_stats(needed, stats, by)
    else:
        s = fit(needed, exprs, quartiles)
        linked = needed.withColumns({k: F.lit(v).cast("long" if k in counts else "double") for k, v in s.items()})
    iqr = F.col("q3") - F.col("q1")
    lower, upper = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = c.between(lower, upper)
    fixed = ["n_rows", "n_values", "min", "q1", "median", "q3", "max"]
    counted = linked.groupBy(*by, *fixed).agg(
        F.min(F.when(inside, c)).alias("whisker_low"),
        F.max(F.when(inside, c)).alias("whisker_high"),
        F.count(F.when((c < lower) | (c > upper), c)).alias("n_outliers"),
    )
    base = F.col("n_rows" if share_of == "rows" else "n_values")
    return counted.select(
        *by, "n_rows", "min", "q1", "median", "q3", "max", iqr.alias("iqr"), lower.alias("lower_bound"),
        upper.alias("upper_bound"), "whisker_low", "whisker_high", "n_outliers",
        (F.col("n_outliers") * 100.0 / base).alias("outlier_percent"),
    )
