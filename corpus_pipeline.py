"""The training-data pipeline: five stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir).  All but the last return the columns of
documents; the last returns piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import mixing, pieces, secret_spans, simhash, toxicity
from tallyframe.plans.sizing import checkpointed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The stages train networks and walk fingerprint graphs, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold of their language (0.5 where it has none).

    Null and empty texts score as no words; a null language is one of its own.
    """
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    _, cuts, net = toxicity.classify(docs, labels)
    scored = toxicity.score(docs, net, "__score").withColumn("language", toxicity.language_of("lang"))
    below = F.col("__score") < F.coalesce("threshold", F.lit(0.5))
    return scored.join(cuts, "language", "left").where(below).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near copies."""
    return simhash.one_per_group(docs, COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a sign and ``n_chars`` counted again where one was."""
    docs = docs.select(*COLUMNS)
    found = secret_spans.scan(docs, secret_spans.fit(docs), "__spans")
    text = secret_spans.mask(F.col("text"), F.col("__spans"))
    masked = found.withColumn("text", text)
    changed = F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    The texts meet their numbers of copies by a sort-merge join at every size.
    """
    numbered = docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id())
    rows = checkpointed(numbered)
    sizes = checkpointed(rows.select("__row", F.xxhash64("doc_id", "text").alias("twin"), "source", mixing.word_count(
        mixing.text_or_empty()).alias("size")))
    mixed = mixing.mix(sizes, ["twin", "__row"]).select("__row", "copies").where("copies > 0")
    return mixing.repeat_rows(rows.join(checkpointed(mixed).hint("merge"), "__row"), F.col("copies"), COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids): the piece ids of every text; a null text has none."""
    found = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
