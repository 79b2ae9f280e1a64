"""Toxicity by a convolutional text classifier with hashed word embeddings, trained in numpy.

Words are hashed into an embedding table; filters of several widths slide over
the word vectors, each filter keeps its maximum over the whole text, and a
logistic layer turns the maxima into a score.  Thresholds are calibrated per
language on the labelled rows that were also open to training.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import by_value, checkpointed, key_text_crc, made_in_a_task, map_batches, text_or_empty, worker_cache

by_value(__name__)

#: At most this many labelled rows of each class train the network.
SAMPLE_PER_CLASS = 2_000
BUCKETS = 1 << 18
#: A word's vector is the sum of its own and that of its first bytes, which inflected forms share.
STEM_BYTES = 4
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Steps of training, rounded up to whole epochs.
STEPS = 1_000
#: Buckets met in fewer training texts stay zero, so that no text is learnt by its rare words.
MIN_DOCS = 3
#: Every so many-th training text only tells which epoch generalises best.
CHECK_EVERY = 6
BATCH_DOCS = 32
#: Share of buckets hidden in a training step, so that a text's other telling words are learnt as well.
DROPPED = 0.5
RATE = 0.01
SEED = 7
#: Words of one numpy call when scoring.
BLOCK_WORDS = 200_000
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")


class WordBuckets(dict):
    """Buckets of a word and of its first bytes; forgets everything when it holds ``limit`` words."""

    limit = 500_000

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self.limit:
            self.clear()
        start = b"^" + word[:STEM_BYTES]
        both = self[word] = tuple(1 + zlib.crc32(x) % (BUCKETS - 1) for x in (word, start))
        return both


def word_ids(text: str | None, memo: WordBuckets) -> np.ndarray:
    """[word, 2] bucket numbers; bucket 0 is the empty word, the only one of an empty text."""
    words = TOKEN.findall((text or "").encode().lower())
    return np.array([memo[w] for w in words] or [(0, 0)], dtype=np.int32)


@dataclass
class Network:
    embed: np.ndarray  # BUCKETS x DIM, zero where words of fewer than MIN_DOCS training texts fell
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    shift: list[np.ndarray]  # per width: FILTERS
    weights: np.ndarray
    bias: float


def pooled(net: Network, docs: list[np.ndarray], back: bool = False):
    """Rectified maxima [doc, width * FILTERS], and for training what led to them.

    Empty words stand between texts and no filter starts at them, so that none sees two texts.
    """
    gap = max(WIDTHS) - 1
    lengths = np.array([len(d) + gap for d in docs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pad = np.zeros((gap, 2), dtype=np.int32)
    ids = np.concatenate([x for d in docs for x in (d, pad)] + [pad])
    vectors = net.embed[ids[:, 0]] + net.embed[ids[:, 1]]
    number = int(lengths.sum())
    ends = starts + lengths
    between = np.concatenate([ends - 1 - k for k in range(gap)])
    tops, spots = [], []
    for width, kernel, shift in zip(WIDTHS, net.filters, net.shift):
        seen = vectors[:number] @ kernel[0]
        for o in range(1, width):
            seen += vectors[o : o + number] @ kernel[o]
        seen += shift
        seen[between] = -np.inf
        top = np.maximum.reduceat(seen, starts, axis=0)
        tops.append(top)
        if back:
            hit = seen == np.repeat(top, lengths, axis=0)
            order = np.where(hit, np.arange(number)[:, None], number)
            spots.append(np.minimum.reduceat(order, starts, axis=0))
    out = np.concatenate(tops, axis=1)
    return (np.maximum(out, 0), out > 0, ids, vectors, spots) if back else np.maximum(out, 0)


def score_docs(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    logits = pooled(net, docs) @ net.weights + net.bias
    return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))


def score_in_blocks(net: Network, docs: Iterable[np.ndarray]) -> np.ndarray:
    """Scores of any number of texts, about BLOCK_WORDS words at a time."""
    scores, held, words = [np.zeros(0)], [], 0
    for doc in docs:
        held.append(doc)
        words += len(doc)
        if words >= BLOCK_WORDS:
            scores.append(score_docs(net, held))
            held, words = [], 0
    if held:
        scores.append(score_docs(net, held))
    return np.concatenate(scores)


def train(texts: list[str], labels: list[int], prior: float) -> Network:
    """Adam on the log loss; ``prior`` is the share of label 1 among all training labels."""
    rng = np.random.default_rng(SEED)
    memo = WordBuckets()
    memo.limit = 50_000  # few, and not kept while training
    docs = [word_ids(t, memo) for t in texts]
    del memo
    y = np.array(labels, dtype=np.float32)
    apart = {d.tobytes(): d for d in docs}.values()  # a copied text counts once
    seen, in_docs = np.unique(np.concatenate([np.unique(d) for d in apart] or [np.zeros(1, np.int32)]), return_counts=True)
    used = seen[in_docs >= MIN_DOCS]
    embed = np.zeros((BUCKETS, DIM), np.float32)
    embed[used] = rng.normal(0, 0.3, (len(used), DIM)).astype(np.float32)
    embed[0] = 0
    net = Network(
        embed, [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0,
    )
    if len(docs) == 0 or y.min() == y.max():
        net.weights[:] = 0
        net.bias = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
        return net
    state: dict[str, list] = {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, step: int) -> None:
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    squares = np.zeros(BUCKETS, np.float32)  # Adagrad for the embeddings: only rows at a maximum change
    bias = np.zeros(1, np.float32)
    checks = np.arange(len(docs)) % CHECK_EVERY == CHECK_EVERY - 1
    if len(set(y[checks].tolist())) < 2:
        checks[:] = False
    step, best = 0, (np.inf, net)
    frozen = np.ones(BUCKETS, bool)
    frozen[used] = False
    frozen[0] = True
    epochs = -(-STEPS * BATCH_DOCS // max(1, int((~checks).sum())))
    for _ in range(min(epochs, 30)):
        order = rng.permutation(np.flatnonzero(~checks))
        for at in range(0, len(order), BATCH_DOCS):
            pick = order[at : at + BATCH_DOCS]
            step += 1
            lost = rng.random(BUCKETS, dtype=np.float32) < DROPPED
            top, live, ids, vectors, spots = pooled(net, [np.where(lost[docs[i]], 0, docs[i]) for i in pick], back=True)
            p = 1 / (1 + np.exp(-np.clip(top @ net.weights + bias[0], -30, 30)))
            slope = ((p - y[pick]) / len(pick)).astype(np.float32)
            down = slope[:, None] * net.weights[None, :] * live
            moved, pushes = [], []
            for k, (width, kernel) in enumerate(zip(WIDTHS, net.filters)):
                part = down[:, k * FILTERS : (k + 1) * FILTERS]
                for o in range(width):
                    at_top = spots[k] + o  # doc x filter
                    grad = (vectors[at_top] * part[:, :, None]).sum(axis=0).T + 1e-4 * kernel[o]
                    moved.append(ids[at_top].reshape(-1, 2))
                    pushes.append((part[:, :, None] * kernel[o].T[None]).reshape(-1, DIM))
                    adam(f"k{k}.{o}", kernel[o], grad, step)
                adam(f"s{k}", net.shift[k], part.sum(axis=0), step)
            adam("w", net.weights, top.T @ slope + 1e-3 * net.weights, step)
            adam("b", bias, slope.sum(keepdims=True), step)
            hit, push = np.concatenate(moved), np.concatenate(pushes)
            rows, inverse = np.unique(hit, return_inverse=True)
            grads = np.zeros((len(rows), DIM), np.float32)
            inverse = inverse.reshape(hit.shape)
            np.add.at(grads, inverse[:, 0], push)
            np.add.at(grads, inverse[:, 1], push)
            rows, grads = rows[~frozen[rows]], grads[~frozen[rows]]
            squares[rows] += (grads * grads).mean(axis=1)
            net.embed[rows] -= 0.05 * grads / (np.sqrt(squares[rows])[:, None] + 1e-6)
        net.bias = float(bias[0])
        if checks.any():
            p = np.clip(score_in_blocks(net, [docs[i] for i in np.flatnonzero(checks)]), 1e-6, 1 - 1e-6)
            loss = -np.mean(np.where(y[checks] == 1, np.log(p), np.log(1 - p)))
            if loss < best[0]:
                best = (loss, copy.deepcopy(net))
    if checks.any():
        net = best[1]
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    # The classes were sampled, so the intercept moves back to their true odds.
    net.bias = float(net.bias + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


# On tables --------------------------------------------------------------------------------------

def held_out(key: Column) -> Column:
    return F.coalesce(key_text_crc(key, 5) == 0, F.lit(False))


def training_labels(labels: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, toxic), one row per key; keys held out, null keys and null labels are left out."""
    rows = labels.select(F.col(f"`{key_col}`").alias("key"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("key is not null and toxic is not null").where(~held_out(F.col("key")))
    return rows.groupBy("key").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text",
        per_class: int = SAMPLE_PER_CLASS) -> Network:
    """Train on the ``per_class`` labelled keys of least hash in each class, in one task; whole texts, read once."""
    known = checkpointed(training_labels(labels, key_col))
    n, ones = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    picked = [
        known.where(F.col("toxic") == c).orderBy(F.xxhash64("key"), "key").limit(per_class) for c in (0, 1)
    ]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class rows
    rows = docs.select(F.col(f"`{key_col}`").alias("key"), text_or_empty(text_col).alias("text")).join(sample, "key")
    prior = (ones or 0) / max(n, 1)

    def work(rows: list[tuple]) -> list:
        rows = sorted(rows, key=lambda r: r[:2])
        net = train([text for _, text, _ in rows], [toxic for _, _, toxic in rows], prior)
        return [getattr(net, f.name) for f in fields(Network)]

    return Network(*made_in_a_task(rows.select("key", "text", "toxic"), work))


def score(df: DataFrame, net: Network, name: str = "score", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and the score; a null text is empty, an empty text gets the score of no words."""
    at = df.columns.index(text_col)
    parts = [getattr(net, f.name) for f in fields(Network)]
    shared = df.sparkSession.sparkContext.broadcast(parts)  # BUCKETS x DIM floats, whatever the input

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo, model = worker_cache("toxicity_words", WordBuckets), Network(*shared.value)
        scores = score_in_blocks(model, (word_ids(t, memo) for t in batch.column(at).to_pylist()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])

    return map_batches(df, work, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def language_thresholds(scored: DataFrame, labels: DataFrame, key_col: str = "doc_id", steps: int = 1000) -> DataFrame:
    """(language, threshold): the cut of best F1 on all training labels of a language.

    ``scored`` has key, language and score.  Cuts start at 0.5: a language may
    ask for more evidence, not for less.  Of equally good cuts the least is
    taken; a language without both classes has no row.
    """
    known = scored.join(training_labels(labels, key_col), "key")
    cells = known.groupBy("language", F.floor(F.col("score") * steps).cast("int").alias("cell")).agg(
        F.sum((F.col("toxic") == 1).cast("long")).alias("bad"), F.sum((F.col("toxic") == 0).cast("long")).alias("good"))
    cuts = cells.select("language", "cell", "bad", "good").union(  # the score 0.5 itself is always tried
        cells.select("language").distinct().select("language", F.lit(steps // 2), F.lit(0), F.lit(0)))
    cuts = cuts.groupBy("language", "cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    above = Window.partitionBy("language").orderBy(F.col("cell").desc())
    whole = Window.partitionBy("language")
    rated = cuts.select(
        "language", "cell", F.sum("bad").over(above).alias("hit"), F.sum("good").over(above).alias("wrong"),
        F.sum("bad").over(whole).alias("bad"), F.sum("good").over(whole).alias("good"),
    ).where(f"bad > 0 and good > 0 and cell >= {steps // 2}")
    f1 = F.round(2 * F.col("hit") / (F.col("bad") + F.col("hit") + F.col("wrong")), 9)
    best = F.max(F.struct(f1, -F.col("cell"), F.col("cell"))).alias("best")
    return rated.groupBy("language").agg(best).select("language", (F.col("best.cell") / steps).alias("threshold"))


def language_of(column: str = "lang") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def classify(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", per_class: int = SAMPLE_PER_CLASS) -> tuple[DataFrame, DataFrame, Network]:
    """Scores (key, language, score) as a stored table, the thresholds by language, and the network."""
    net = fit(docs, labels, key_col, text_col, per_class)
    narrow = docs.select(F.col(f"`{key_col}`").alias("key"), language_of(lang_col).alias("language"),
                         F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = checkpointed(score(narrow, net).drop("text"))
    return scored, checkpointed(language_thresholds(scored, labels, key_col)), net


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document; threshold and flagged follow the language, predicted the fixed 0.5."""
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored, cuts, _ = classify(docs, labels)
    threshold = F.coalesce("threshold", F.lit(0.5))
    return scored.join(cuts, "language", "left").select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"),
    )
