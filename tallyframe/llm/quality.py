"""Quality rules: fixed limits, and robust multivariate outliers per language and source.

Statistics of each text become five transformed values.  For each language and
source the minimum-covariance-determinant estimate is sought by concentration
steps: the three quarters of the rows nearest to the current centre give the
next centre and covariance.  The start with the least determinant wins, one
reweighting follows, and texts beyond a Mahalanobis distance are rejected.

Everything is DataFrame functions.  A step reads the narrow table of values and
two small aggregates per group; nearness is counted in steps of a logarithmic
distance, so the three quarters are found without sorting a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import SPACE, checkpointed, text_or_empty

VALUES = ("v_length", "v_word", "v_symbols", "v_lines", "v_repeats")
#: Least standard deviation of each value, so that a group of equal texts rejects no ordinary one.
FLOORS = (0.6, 0.4, 0.08, 0.08, 0.12)
KEPT_SHARE = 0.75
STEPS = 4
#: Distances are counted in so many steps per doubling.
FINE = 32
#: Chi-square points of five values: 0.975 for the reweighting, and the limit of rejection (about one in ten million).
REWEIGHT = 12.833
LIMIT = 41.0
#: Makes the covariance of the nearest three quarters of a normal sample consistent (0.75 / P(chi2 of 7 <= 6.626)).
CONSISTENT = 1.412
#: Smaller groups are pooled by language, smaller languages all together.
LEAST_ROWS = 60


def statistics(text: Column) -> dict[str, Column]:
    """Columns that need only the text."""
    return {"text": text, "words": F.array_remove(F.split(text, SPACE + "+", -1), "")}


def add_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` but the text, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    A null text is empty and all its numbers are 0.
    """
    others = [c for c in df.columns if c != text_col]
    named = [F.col(f"`{c}`") for c in others]
    text = text_or_empty(text_col)
    rows = df.select(*named, *[c.alias(f"__{n}") for n, c in statistics(text).items()])
    visible = F.filter(F.split("__text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    count = F.size("__words")
    # A word holds no space, so the joined window tells its three words.
    window = lambda w, i: F.struct(
        F.concat_ws(" ", w, F.get("__words", i + 1), F.get("__words", i + 2)).alias("w"), i.alias("i"))
    windows = F.sort_array(F.transform(F.slice("__words", 1, F.greatest(count - 2, F.lit(0))), window))
    rows = rows.select(*named, count.cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
                       F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), visible.alias("__lines"), windows.alias("__windows"))
    more = F.greatest(F.size("__windows") - 1, F.lit(0))
    same = F.zip_with(F.slice("__windows", 1, more), F.slice("__windows", 2, more), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    found = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    rows = rows.select(*named, "n_words", "word_chars", "n_symbols",
                       (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), found.alias("__found"))
    rest = F.greatest(F.size("__found") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("__found", 1, rest), F.slice("__found", 2, rest), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, b: a + b) + F.when(F.size("__found") > 0, 3).otherwise(0)
    return rows.select(*named, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    """Logarithm of the length, mean word, and square roots of shares, which spread evenly."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    out = [F.log(n), F.col("word_chars") / n, F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(c, 6).alias(name) for c, name in zip(out, VALUES)]


def with_groups(rows: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Add the group of each row: language and source, or the language, or all, the first of these with enough rows."""
    fine = F.to_json(F.struct(F.col(f"`{lang_col}`").cast("string").alias("l"), F.col(f"`{source_col}`").cast("string").alias("s")))
    coarse = F.to_json(F.struct(F.col(f"`{lang_col}`").cast("string").alias("l")))
    keyed = rows.withColumns({"fine": fine, "coarse": coarse})
    per_fine = checkpointed(keyed.where("not failed").groupBy("coarse", "fine").agg(F.count("*").alias("n")))
    small = per_fine.where(F.col("n") < LEAST_ROWS).groupBy("coarse").agg(F.sum("n").alias("pool"))
    named = per_fine.join(small, "coarse", "left").select(
        "fine", F.when(F.col("n") >= LEAST_ROWS, F.col("fine")).when(F.col("pool") >= LEAST_ROWS, F.col("coarse")).otherwise("all").alias("group"))
    return checkpointed(keyed).join(checkpointed(named), "fine", "left").drop("fine", "coarse")


def spread_of(group: list[str], rows: DataFrame) -> DataFrame:
    """Mean and covariance, with the least deviations added, of the rows of each group."""
    size = len(VALUES)
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(VALUES)]
    sums += [F.sum(F.col(VALUES[i]) * F.col(VALUES[j])).alias(f"p{i}{j}") for i in range(size) for j in range(i + 1)]
    got = rows.groupBy(*group).agg(F.count("*").alias("n"), *sums)
    mean = [F.round(F.col(f"s{i}") / F.col("n"), 9).alias(f"m{i}") for i in range(size)]

    def cell(i: int, j: int) -> Column:
        value = F.col(f"p{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")
        value = F.round(value * CONSISTENT, 9)
        return (F.greatest(value, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else value).alias(f"c{i}{j}")

    return whitened(got.select(*group, *mean, *[cell(i, j) for i in range(size) for j in range(i + 1)]), group)


def whitened(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, m0.., w00..w44, det): the inverse of the Cholesky factor of c, and the logarithm of its determinant."""
    size = len(VALUES)
    for j in range(size):
        total = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        rows = rows.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - total, F.lit(1e-9))))
        below = {f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}")
                 for i in range(j + 1, size)}
        rows = rows.withColumns(below) if below else rows
    for i in range(size):
        line = {f"w{i}{j}": -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}") for j in range(i)}
        rows = rows.withColumns(line | {f"w{i}{i}": 1 / F.col(f"l{i}{i}")})
    det = F.round(2 * sum((F.log(f"l{i}{i}") for i in range(1, size)), F.log("l00")), 9).alias("det")
    return checkpointed(rows.select(*group, *[f"m{i}" for i in range(size)], *[f"w{i}{j}" for i in range(size) for j in range(i + 1)], det))


def distance() -> Column:
    """Squared Mahalanobis distance of the values from the joined centre."""
    size = len(VALUES)
    lines = [sum((F.col(f"w{i}{j}") * (F.col(VALUES[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(size)]
    return sum((line * line for line in lines), F.lit(0.0))


def quartile_start(rows: DataFrame) -> DataFrame:
    """A centre at the medians and deviations from the quartiles of each value alone, counted in steps of 1/1000."""
    value = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(v) * 1000).cast("long").alias("x")) for i, v in enumerate(VALUES)]))
    cells = rows.select("group", value.alias("v")).groupBy("group", "v.i", "v.x").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("group", "i").orderBy("x")
    ranked = cells.select("group", "i", "x", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy("group", "i")).alias("n"))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("n"), F.col("x"))) / 1000
    points = ranked.groupBy("group", "i").agg(at(0.5).alias("median"), ((at(0.75) - at(0.25)) / 1.349).alias("scale"))
    one = lambda name, i: F.max(F.when(F.col("i") == i, F.col(name)))
    size = len(VALUES)
    wide = points.groupBy("group").agg(
        *[one("median", i).alias(f"m{i}") for i in range(size)], *[(one("scale", i) * one("scale", i) + FLOORS[i] ** 2).alias(f"c{i}{i}") for i in range(size)])
    flat = wide.withColumns({f"c{i}{j}": F.lit(0.0) for i in range(size) for j in range(i)} | {"start": F.lit(0)})
    return whitened(flat, ["group", "start"])


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The reweighted minimum-covariance-determinant estimate of each group of (group, values), a stored table."""
    plain = spread_of(["group"], rows).withColumn("start", F.lit(1))
    current = quartile_start(rows).unionByName(plain)
    by = ["group", "start"]
    for _ in range(steps):
        near = rows.join(current, "group").withColumn("cell", F.floor(F.log2(distance() + 1e-9) * FINE).cast("int"))
        cells = near.groupBy(*by, "cell").agg(F.count("*").alias("n"))
        whole = F.sum("n").over(Window.partitionBy(*by))
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("cell"))
        cut = cells.select(*by, "cell", upto.alias("upto"), whole.alias("whole")).where(F.col("upto") >= KEPT_SHARE * F.col("whole"))
        cut = checkpointed(cut.groupBy(*by).agg(F.min("cell").alias("most")))
        current = spread_of(by, near.join(cut, by).where("cell <= most"))
    least = current.groupBy("group").agg(F.min(F.struct("det", "start")).alias("best"))
    best = checkpointed(current.join(least, "group").where(F.col("start") == F.col("best.start")).drop("best", "start"))
    return spread_of(["group"], rows.join(best, "group").where(distance() <= REWEIGHT))


def rate(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(key, the five statistics, base_failed, distance, kept) per row.

    Only rows that pass the fixed limits shape the estimates.  Null languages
    and sources are values of their own, small groups are pooled, repeated rows
    count each, an empty table gives no rows.
    """
    narrow = docs.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"),
                         F.col(f"`{text_col}`").alias("text"))
    counted = add_statistics(narrow).withColumn("failed", base_failed())
    rows = checkpointed(counted.select("*", *transformed()))
    grouped = checkpointed(with_groups(rows, "lang", "source"))
    found = estimates(grouped.where("not failed").select("group", *VALUES))
    rated = grouped.join(found, "group", "left").withColumn("distance", F.round(distance(), 6))
    kept = ~F.col("failed") & F.coalesce(F.col("distance") <= LIMIT, F.lit(True))
    return rated.select("key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").alias("base_failed"), "distance", kept.alias("kept"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    rated = rate(spark.read.parquet(f"{folder}/documents.parquet"))
    return rated.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "distance")
