"""Group-by summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scalar import stable_bucket, weekday, words
from tallyframe.plans.fitting import fit_by, join_stats

AGGREGATES: dict[str, Callable[[str], Column]] = {
    "count": F.count,
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
}

PARTS: dict[str, Callable[[Column], Column]] = {
    "hour": F.hour,
    "weekday": weekday,
    "month": F.month,
    "year": F.year,
}


def group_many(df: DataFrame, by: Sequence[str], aggregates: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several keys, columns and functions named by text; columns ``col_function``.

    Functions: count (non-null), mean, sum, min, max, median, std, var.  The
    sum of nothing is 0.  Rows with a null key are left out.
    """
    exprs, quantiles = {}, {}
    for column, functions in aggregates.items():
        for name in functions:
            if name == "median":
                quantiles[f"{column}_{name}"] = (column, 0.5)
            elif name == "sum":
                exprs[f"{column}_{name}"] = F.coalesce(F.sum(column), F.lit(0))
            elif name in AGGREGATES:
                exprs[f"{column}_{name}"] = AGGREGATES[name](column)
            else:
                raise ValueError(f"unknown aggregate {name!r}; choose from {[*AGGREGATES, 'median']}")
    return fit_by(df.select(*dict.fromkeys([*by, *aggregates])), by, exprs, quantiles)


def group_one(df: DataFrame, by: str, function: str, column: str | None = None) -> DataFrame:
    """One key and one function, largest result first; ``count`` counts rows."""
    if function == "count":
        out = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("result"))
    else:
        named = group_many(df, [by], {column: [function]})
        out = named.withColumnRenamed(f"{column}_{function}", "result")
    return out.orderBy(F.col("result").desc(), F.col(by))


def group_sum(df: DataFrame, by: str, column: str) -> DataFrame:
    return group_many(df, [by], {column: ["sum"]})


def group_mean(df: DataFrame, by: str, column: str) -> DataFrame:
    return group_many(df, [by], {column: ["mean"]})


def group_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    return group_many(df, [by], {column: ["sum", "mean", "max"]})


def rows_of_extreme(df: DataFrame, by: str, column: str, row_id: str, largest: bool = True) -> DataFrame:
    """The full row with the extreme value in each group; the lowest id wins a tie.

    The extreme values are found first with a hash aggregate over two columns;
    only rows that reach them are then compared whole.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(column).isNotNull())
    extremes = rows.groupBy(by).agg((F.max if largest else F.min)(column).alias("__extreme"))
    top = join_stats(rows, extremes, [by]).where(F.col(column) == F.col("__extreme"))
    best = F.min_by(F.struct(*df.columns), F.col(row_id))
    return top.groupBy(by).agg(best.alias("__row")).select("__row.*")


def pick_per_group(df: DataFrame, by: str, column: str, row_id: str, keep: Sequence[str]) -> DataFrame:
    """Chosen columns of the row with the largest value in each group."""
    return rows_of_extreme(df.select(*dict.fromkeys([by, column, row_id, *keep])), by, column, row_id).select(
        by, *keep
    )


def reduce_per_group(df: DataFrame, by: Sequence[str], reductions: Mapping[str, Column]) -> DataFrame:
    """A user-defined reduction per group, written as aggregate columns.

    An aggregate combines before the shuffle, so a hot group is reduced where
    it is read; a Python function would need the whole group in one task.
    """
    rows = df.na.drop(subset=list(by))
    return rows.groupBy(*by).agg(*[e.alias(n) for n, e in reductions.items()])


def region_summary(
    df: DataFrame, region: str, row_id: str, means: Mapping[str, str]
) -> DataFrame:
    """Rows per region and the means of some columns (``{output: column}``), largest region first."""
    out = (
        df.where(F.col(region).isNotNull())
        .groupBy(region)
        .agg(F.count(row_id).alias("n"), *[F.avg(c).alias(name) for name, c in means.items()])
    )
    return out.orderBy(F.col("n").desc(), F.col(region))


def city_summary(df: DataFrame, city: str, row_id: str, means: Mapping[str, str]) -> DataFrame:
    """As :func:`region_summary`, with a city key and one more mean."""
    return region_summary(df, city, row_id, means)


def time_bucket_counts(df: DataFrame, time: str, part: str) -> DataFrame:
    """Rows per hour, weekday (Monday 0), month or year."""
    bucket = PARTS[part](F.col(time))
    return df.where(F.col(time).isNotNull()).groupBy(bucket.alias(part)).agg(F.count("*").alias("n"))


def collect_points(
    df: DataFrame, time: str, part: str, row_id: str, lat: str, lng: str, chunk_rows: int = 10_000
) -> DataFrame:
    """Per time bucket the lists of coordinates, whole but in chunks.

    A bucket with more than ``chunk_rows`` points is spread by a digest of the
    row id over as many rows as it needs, so no list grows with the table.
    """
    rows = df.where(F.col(time).isNotNull()).select(
        PARTS[part](F.col(time)).alias(part), F.col(row_id).alias("__id"), F.col(lat).alias("lat"), F.col(lng).alias("lng")
    )
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    chunks = max(1, -(-most // chunk_rows))
    chunk = stable_bucket(F.col("__id"), chunks) if chunks > 1 else F.lit(0)
    points = F.array_sort(F.collect_list(F.struct("__id", "lat", "lng")))
    return (
        rows.groupBy(part, chunk.alias("chunk"))
        .agg(F.count("*").alias("n"), points.alias("__p"))
        .select(part, "chunk", "n", F.col("__p.lat").alias("lats"), F.col("__p.lng").alias("lngs"))
    )


def value_counts(df: DataFrame, column: str, by_value: bool = False) -> DataFrame:
    """Rows per non-null value, most frequent first or in value order."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return out.orderBy(column) if by_value else out.orderBy(F.col("n").desc(), F.col(column))


def value_shares(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """Percent of the non-null rows per value."""
    n_all = df.select(F.count(column)).first()[0]
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.round(F.col("n") * 100.0 / F.lit(max(n_all, 1)), digits))


# Words that are never reported.
STOP_WORDS = ("the", "and", "to", "a")


def word_count(
    df: DataFrame, text: str, more_than: int = 1000, stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """Words by frequency, then by word, both descending; null text counts as ``none``."""
    word = F.explode(words(F.coalesce(F.col(text), F.lit("none")))).alias("word")
    counted = df.select(word).groupBy("word").agg(F.count("*").alias("n"))
    kept = counted.where((F.col("n") > more_than) & ~F.col("word").isin(*stop_words))
    return kept.orderBy(F.col("n").desc(), F.col("word").desc())
