"""Language-model scores by a probabilistic suffix tree over words.

Contexts of one and two words become states if they are met often enough and
their next-word distribution diverges from that of their suffix by more than
the bits it takes to keep it.  Next-word counts are discounted; what is left
goes to the suffix state's distribution over the other words, down to the
smoothed word counts at the root.  Each word is scored in the longest suffix
state of what stands before it.

Frequent words, states and next words are bounded by the least share of the
corpus that they must have (at most 1 / share of each), so they are sent to all
tasks.  All other words are counted and looked up by joins and grow with the
corpus; their probabilities come from the root.

``learn`` and ``score`` are this bounded form, for a tree that the driver holds.
The query takes ``wordcontexts``, which tries every context.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import by_value, checkpointed, key_text_crc, map_batches
from tallyframe.llm.wordcontexts import score_texts

by_value(__name__)

#: Least share of all tokens of a frequent word, and of a context with its next word.
WORD_SHARE = 1e-6
NEXT_SHARE = 1e-5
DISCOUNT = 0.5
#: Bits that a state must save per next word that it keeps.
BITS = 24.0


class Numbers(dict):
    """Number of each frequent word: 0 is the end (and what stands before a text), the last one all other words."""

    def __missing__(self, word: bytes) -> int:
        return self[b""]

    @classmethod
    def of(cls, words: list[bytes]) -> Numbers:
        numbers = cls({w: i + 1 for i, w in enumerate(words)})
        numbers[b""] = len(words) + 1  # no word is empty
        return numbers


def held_out(key: Column) -> Column:
    return F.coalesce(key_text_crc(key, 7) == 2, F.lit(False))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of the column text, as a stored table."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = Counter(chain.from_iterable(map(split_words, batch.column(0).to_pylist())))
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "c"])

    return checkpointed(map_batches(texts, work, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))


def number_texts(texts: list, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words with an end after each text, place of each end)."""
    split = [split_words(t) for t in texts]
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    out = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, len(out) - len(ends))
    return out, ends


def before(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each place and the one before that; 0 before a text, -1 where there is none even there."""
    one = np.concatenate([[0], ids[:-1]])
    two = np.concatenate([[-1], one[:-1]])
    first = np.concatenate([[0], ends[:-1] + 1])
    one[first] = 0
    two[first] = -1
    two[first[first < ends] + 1] = 0
    return one, two


def frequent_pairs(texts: DataFrame, model, least: int, contexts: np.ndarray | None) -> list[tuple[int, int]]:
    """(key, count) of contexts with their next word that are met at least ``least`` times.

    Without ``contexts`` they are single words; with them, the word pairs whose
    keys are given, sorted.  Every pair of a task is summed before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, worth = model.value
        numbers = Numbers.of(words)
        size, rare = len(words) + 2, len(words) + 1
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = number_texts(batch.column(0).to_pylist(), numbers)
            one, two = before(ids, ends)
            good = worth[ids] & worth[one]
            if contexts is None:
                keys = one[good] * size + ids[good]
            else:
                good &= two >= 0
                pair = two[good] * size + one[good]
                at = np.searchsorted(contexts, pair)
                met = contexts[np.minimum(at, len(contexts) - 1)] == pair
                keys = at[met] * size + ids[good][met]
            keys, counts = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    if contexts is not None and not len(contexts):
        return []
    summed = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return sorted((r[0], r[1]) for r in summed.where(F.col("n") >= least).collect())  # at most 1 / NEXT_SHARE rows


class Tree:
    """States in numpy: state 0 is the root, then single words, then word pairs."""

    def __init__(self, words: list[bytes], counts: np.ndarray, texts: int, total: int, distinct: int):
        self.words, self.size = words, len(words) + 2
        self.total, self.distinct = total, distinct
        root = np.concatenate([[texts], counts, [0]]).astype(float)
        self.known = root > 0
        self.root = np.log10((root + 1) / (total + distinct + 1))  # the last entry is not used: other words are looked up
        self.rest, self.parent = [0.0], [0]  # log10 of what is left per unit of the parent's other words
        self.single: dict[int, int] = {}
        self.double: dict[int, int] = {}
        self.entries: dict[int, float] = {}

    def log10(self, state: int, word: int) -> float:
        out = 0.0
        while state:
            known = self.entries.get(state * self.size + word)
            if known is not None:
                return out + known
            out += self.rest[state]
            state = self.parent[state]
        return out + float(self.root[word])

    def try_state(self, parent: int, met: int, nexts: list[tuple[int, int]]) -> int | None:
        """A state met ``met`` times with (next word, count) pairs, if it saves enough bits; its number."""
        before = np.array([self.log10(parent, w) for w, _ in nexts])
        counts = np.array([n for _, n in nexts], float)
        own = (counts - DISCOUNT) / met
        left, free = 1 - own.sum(), 1 - (10.0**before).sum()
        if left <= 0 or free <= 1e-9:
            return None
        rest = np.log10(left / free)
        saved = (counts * (np.log10(own) - before)).sum() + max(met - counts.sum(), 0) * rest
        if saved / np.log10(2) <= BITS * (len(nexts) + 1):
            return None
        state = len(self.rest)
        self.rest.append(float(rest))
        self.parent.append(parent)
        self.entries.update((state * self.size + w, float(p)) for (w, _), p in zip(nexts, np.log10(own)))
        return state

    def grow(self, pairs: list[tuple[int, int]], context: np.ndarray | None, met, places: dict[int, int]) -> None:
        """Try one state per context; ``pairs`` are sorted, so the next words of a context stand together."""
        groups: dict[int, list[tuple[int, int]]] = {}
        for key, n in pairs:
            groups.setdefault(key // self.size, []).append((key % self.size, n))
        for at, nexts in groups.items():
            key = at if context is None else int(context[at])
            parent = 0 if context is None else self.single.get(key % self.size, 0)
            state = self.try_state(parent, met(at), nexts)
            if state is not None:
                places[key] = state

    def arrays(self) -> tuple:
        pick = lambda d, kind: (np.array(sorted(d), np.int64), np.array([d[k] for k in sorted(d)], kind))
        return (self.words, self.root, self.known, np.array(self.rest), np.array(self.parent), pick(self.single, np.int64),
                pick(self.double, np.int64), pick(self.entries, np.float64))


def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether there was one) of keys in a sorted table."""
    known, values = table
    if not len(known):
        return np.full(len(keys), missing, values.dtype), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return np.where(hit, values[at], missing), hit


def place_scores(ids: np.ndarray, ends: np.ndarray, tree: tuple) -> np.ndarray:
    """log10 probability of each place; a word that is not frequent only gets what its states leave to the root."""
    _, root, _, rest, parent, single, double, entries = tree
    size = len(root)
    one, two = before(ids, ends)
    state, _ = find(single, one, 0)
    longer, hit = find(double, np.where(two >= 0, two * size + one, -1), 0)
    state = np.where(hit, longer, state)
    out, open_places = np.zeros(len(ids)), np.flatnonzero(state)
    frequent = ids < size - 1
    done = np.zeros(len(ids), bool)
    while len(open_places):
        value, hit = find(entries, state[open_places] * size + ids[open_places], 0.0)
        hit &= frequent[open_places]
        out[open_places] += np.where(hit, value, rest[state[open_places]])
        done[open_places[hit]] = True
        open_places = open_places[~hit]
        state[open_places] = parent[state[open_places]]
        open_places = open_places[state[open_places] > 0]
    at_root = ~done & frequent
    out[at_root] += root[ids[at_root]]
    return out


def learn(texts: DataFrame, word_share: float = WORD_SHARE, next_share: float = NEXT_SHARE) -> tuple[Tree, DataFrame]:
    """The tree of a one-column table of texts, and the stored counts (word, c) of all its words."""
    spark = texts.sparkSession
    counts = word_counts(texts)
    number = texts.count()
    words_total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = words_total + number
    distinct += number > 0
    often = counts.where(F.col("c") >= word_share * total).collect()  # at most 1 / word_share rows
    often.sort(key=lambda r: (-r["c"], r["word"]))
    words = [r["word"].encode() for r in often]
    c = np.array([r["c"] for r in often], np.int64)
    tree = Tree(words, c, number, total, distinct)
    least = max(2, int(np.ceil(next_share * total)))
    worth = np.concatenate([[True], c >= least, [False]])
    model = spark.sparkContext.broadcast((words, worth))
    pairs = frequent_pairs(texts, model, least, None)
    met = np.concatenate([[number], c, [0]])
    tree.grow(pairs, None, lambda at: int(met[at]), tree.single)
    contexts = np.array([k for k, _ in pairs if k % tree.size], np.int64)  # nothing follows an end
    times = [n for k, n in pairs if k % tree.size]
    tree.grow(frequent_pairs(texts, model, least, contexts), contexts, lambda at: times[at], tree.double)
    return tree, counts


def score(df: DataFrame, tree: Tree, counts: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) per row.

    A null or empty text is one end.  The base is the smoothed word count of
    each token.  Repeated rows are scored each, an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(tree.arrays())
    rows = df.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"),
                     F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shared.value
        numbers, root, known = Numbers.of(arrays[0]), arrays[1], arrays[2]
        rare = len(root) - 1
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            ids, ends = number_texts(texts, numbers)
            first = np.concatenate([[0], ends[:-1] + 1])
            scores = np.add.reduceat(place_scores(ids, ends, arrays), first)
            base = np.add.reduceat(np.where(ids < rare, root[ids], 0.0), first)
            seen = np.add.reduceat(known[ids].astype(np.int64), first)
            others = [Counter(w for w in split_words(t) if w not in numbers) for t in texts]
            cuts = pa.array(np.cumsum([0, *map(len, others)]), pa.int32())
            words = pa.array([w for o in others for w in o], pa.binary()).cast(pa.string())
            times = pa.array([n for o in others for n in o.values()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array(ends - first + 1), pa.array(seen), pa.array(base), pa.array(scores),
                 pa.ListArray.from_arrays(cuts, words), pa.ListArray.from_arrays(cuts, times)],
                ["row", "key", "n_tokens", "n_known", "base", "score", "words", "times"])

    kind = f"row long, key {df.schema[key_col].dataType.simpleString()}, n_tokens long, n_known long, base double, score double, words array<string>, times array<long>"
    stage = checkpointed(rows.mapInArrow(run, kind))
    spread = stage.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    # No frequent word is among them, so no key of this join is hot.
    looked = spread.join(counts, "word", "left")
    value = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(tree.total + tree.distinct + 1)))
    sums = looked.groupBy("row").agg(F.sum(value).alias("value"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("met"))
    return stage.drop("words", "times").join(sums, "row", "left").select(
        "key", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("value", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("value", F.lit(0.0))).alias("score"))


def op2_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every whole document, by states from every context of the documents learned from."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found, tokens = score_texts(docs, ~held_out(F.col("doc_id")))
    return found.select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
