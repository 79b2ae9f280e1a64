"""Suffix-tree scores where every context of the corpus is tried as a state.

Texts are packed into blocks of numbered words.  A place is a triple: the word
there, the one before it and the one before that.  Each block deals its distinct
triples over ranges of contexts as packed columns; a range sums them over all
blocks, so it knows every next word of its contexts, decides by the bits that
they save which contexts are states and which next words they keep, and answers
each block with what they make of its triples, in the block's order.
Words are counted and numbered in the same way, by ranges of their checksums.

Nothing is left out for being rare: a next word is kept where it saves more
bits than it costs, a state where its next words pay for it as well.  Not dealt
is only what cannot change a score: a context met once saves at most the
logarithm of the number of tokens, which is less than a state costs.  Contexts
that end in one word meet in one range.  A word of more tokens than a range
holds is dealt by the word before it instead; its own next words are counted
ahead by Spark, and its state is sent to each of its ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import by_value, checkpointed, removed, text_or_empty

by_value(__name__)

DISCOUNT = 0.5
#: Bits that a kept next word costs, and a state besides.
BITS = 24.0
#: Tokens of a block and of a range.
BLOCK_TOKENS = 1_000_000
RANGE_TOKENS = 1_000_000
#: Numbers of the end of a text, which also stands before it, of every next word that is not learned, and of every next
#: word that the whole corpus holds once: which one it is changes no count and no score.
END, UNKNOWN, ONE = range(3)
EXCHANGE = "block long, bucket int, body binary"


def pack(*columns: np.ndarray) -> bytes:
    """Columns as one compressed block; integers (not negative) in as few bytes as they need, all by byte planes."""
    parts = []
    for column in columns:
        if column.dtype.kind != "f":
            column = column.astype(np.min_scalar_type(int(column.max())) if len(column) else np.uint8)
        width = column.dtype.itemsize
        parts += [np.array([len(column), width, column.dtype.kind == "f"], "<u8").tobytes(),
                  np.ascontiguousarray(np.ascontiguousarray(column).view(np.uint8).reshape(-1, width).T).tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(body: bytes) -> list[np.ndarray]:
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        size, width, real = (int(x) for x in np.frombuffer(raw, "<u8", 3, at))
        planes = np.frombuffer(raw, np.uint8, width * size, at + 24).reshape(width, size)
        column = np.ascontiguousarray(planes.T).view("<f8" if real else f"<u{width}").ravel()
        out.append(column if real else column.astype(np.int64))
        at += 24 + width * size
    return out


class Codes(dict):
    """Number of each word of a block in order of first sight; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self) + 1
        return at


def word_blocks(docs: DataFrame) -> DataFrame:
    """Stage table of the blocks of (key, text, train): keys, numbers of tokens and of learned texts, codes, words with their learned counts.

    Codes follow the words' checksums, so that a range of words is a stretch of codes.
    """
    kind = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema["key"].dataType)), T.StructField("size", T.LongType()),
        T.StructField("texts", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        codes, held, lengths, train = Codes(), [], [], []
        keys: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            number += 1
            sizes, learn = np.array(lengths, np.int64), np.array(train, bool)
            words = list(codes)
            order = np.argsort(checksums(words), kind="stable")
            code = np.zeros(len(words) + 1, np.int64)
            code[order + 1] = np.arange(1, len(words) + 1)
            flat = code[np.concatenate(held)]
            counts = [np.bincount(some, minlength=len(words) + 1)[1:] for some in (flat[np.repeat(learn, sizes)], flat)]
            one = pa.concat_arrays(keys)
            out = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one), pa.array([len(flat)], pa.int64()),
                 pa.array([int(learn.sum())], pa.int64()), pa.array([pack(sizes, learn.astype(np.uint8), flat)], pa.binary()),
                 pa.array([pack_words([words[i] for i in order.tolist()], *counts)], pa.binary())], kind.names)
            codes.clear()
            for some in (held, lengths, train, keys):
                some.clear()
            return out

        size = 0
        for batch in batches:
            key, text, learn = (batch.column(batch.schema.names.index(c)) for c in ("key", "text", "train"))
            for i in range(batch.num_rows):
                words = text[i].as_py().encode().lower().split()
                held.append(np.array([*map(codes.__getitem__, words), END], np.int32))
                lengths.append(len(words) + 1)
                train.append(learn[i].as_py())
                keys.append(key.slice(i, 1))
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield flush()
                    size = 0
        if lengths:
            yield flush()

    return checkpointed(docs.mapInArrow(run, kind))


def checksums(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def pack_words(words: list[bytes], learned: np.ndarray, every: np.ndarray) -> bytes:
    return pack(learned, every, np.frombuffer(b"\n".join(words), np.uint8))


def unpack_words(body: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    learned, every, letters = unpack(body)
    return letters.astype(np.uint8).tobytes().split(b"\n") if len(learned) else [], learned, every


def numbered_words(blocks: DataFrame, ranges: int, often: int) -> DataFrame:
    """Stage table of EXCHANGE: for each block and range of words, the words' numbers in the range, their learned counts and whether they occur once.

    A row of each range without a block sums its counts and learned words and lists its words of more than ``often``.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, learned, every = unpack_words(body.as_py())
                part = checksums(words) * ranges >> 32
                cuts = np.flatnonzero(np.diff(part, prepend=-1, append=ranges)).tolist()
                out = [(number, int(part[a]), pack_words(words[a:b], learned[a:b], every[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
                if out:
                    yield exchange(out)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        bucket, numbers = int(frame["bucket"].iloc[0]), Codes()
        found, times = [], []
        for body in frame["body"]:
            words, *counts = unpack_words(body)
            found.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            times.append(counts)
        total, every = (np.bincount(np.concatenate(found), np.concatenate([t[i] for t in times])).astype(np.int64) for i in (0, 1))
        hot = np.flatnonzero(total > often)
        sums = pack(np.array([total.sum()]), np.array([(total > 0).sum()]), word_id(hot, ranges, bucket), total[hot])
        rows = [*zip(frame["block"], [pack(f, total[f], every[f] == 1) for f in found]), (-1, sums)]
        return pd.DataFrame([(block, bucket, body) for block, body in rows], columns=["block", "bucket", "body"])

    dealt = blocks.select("block", "words").mapInArrow(deal, EXCHANGE)
    return checkpointed(dealt.groupBy("bucket").applyInPandas(answer, EXCHANGE))


def word_id(number: np.ndarray, ranges: int, bucket: int) -> np.ndarray:
    return (number + 2) * ranges + bucket


def exchange(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    blocks, buckets, bodies = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(bodies, pa.binary())], ["block", "bucket", "body"])


class Block:
    """A block's places: ``b``, ``a``, ``c`` of each distinct triple as codes (``a`` is the number of codes where none stands there),
    ``n`` learned occurrences, ``place`` the triple of each place of ``dealt``; ``ids`` and ``counts`` by code, the most frequent first."""

    def __init__(self, body: bytes, hits: list[dict], texts: int, tokens: int, ranges: int):
        self.lengths, train, codes = unpack(body)
        found = [(hit["bucket"], *unpack(hit["body"])) for hit in sorted(hits or [], key=lambda hit: hit["bucket"])]
        ids = np.concatenate([[END, UNKNOWN, ONE], *(word_id(at, ranges, bucket) for bucket, at, _, _ in found)]).astype(np.int64)
        counts = np.concatenate([[texts, 0, 1], *(count for _, _, count, _ in found)]).astype(np.int64)
        once = np.concatenate([[0, 0, 0], *(single for *_, single in found)]).astype(bool)
        order = np.lexsort((ids, -counts))
        self.ids, self.counts, size = ids[order], counts[order], len(ids)
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        as_next = np.where(self.counts == 0, rank[UNKNOWN], np.where(once[order] & (self.counts == 1), rank[ONE], np.arange(size)))
        self.codes = codes = rank[np.where(codes > 0, codes + 2, END)]
        self.first = first = np.cumsum(self.lengths) - self.lengths
        before = np.roll(codes, 1)
        before[first] = rank[END]
        earlier = np.roll(before, 1)
        earlier[first] = size
        # A context met once saves at most log2(tokens) bits over the word counts, log2(tokens * count of its last word) over that word's state.
        enough = 2.0 ** (2 * BITS)
        rare = np.append(self.counts <= 1, True)
        earlier[rare[earlier] & (self.counts[before] <= enough / tokens)] = size
        self.dealt = np.flatnonzero(~rare[before] | (tokens > enough))
        before, earlier, after = before[self.dealt], earlier[self.dealt], as_next[codes[self.dealt]]
        context, by_place = np.unique(before * (size + 1) + earlier, return_inverse=True)
        triple, self.place = np.unique(by_place * size + after, return_inverse=True)
        self.b, self.a = np.divmod(context[triple // size], size + 1) if len(triple) else (triple, triple)
        self.c = triple % size
        self.n = np.bincount(self.place, np.repeat(train, self.lengths)[self.dealt], len(triple)).astype(np.int64)

    def ranges(self, hot: dict[int, int], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(range, its triples) of the ranges that get any: by b, and by the word before it as well where b is hot; ``hot`` holds the parts of hot words."""
        known = np.append(self.ids, -1)
        salt = np.zeros(len(self.b), np.int64)
        for word, parts in hot.items():
            here = np.flatnonzero(self.ids[self.b] == word)
            salt[here] = mix(known[self.a[here]] + 1) % parts
        bucket = bucket_of(self.ids[self.b], salt, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        for start, stop in zip(cuts[:-1], cuts[1:]):
            yield int(bucket[order[start]]), order[start:stop]


def log_share(n: np.ndarray, met: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log10((n - DISCOUNT) / met)


def pack_answer(n: np.ndarray, met: np.ndarray, left: np.ndarray) -> bytes:
    """By triple: its count in the state that keeps it, if any, how often a state of two words was met, and what states on the way leave (few values)."""
    known, number = np.unique(left, return_inverse=True)
    return pack(known, number, n.astype(np.int64), met.astype(np.int64))


def triple_values(answer: bytes, met: np.ndarray, root: np.ndarray) -> np.ndarray:
    """log10 of the probabilities of triples whose last context word is met ``met`` times and whose word has ``root``."""
    known, number, n, double = unpack(answer)
    return np.where(n > 0, log_share(n, np.where(double > 0, double, met)), root) + known[number]


def mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def bucket_of(ids: np.ndarray, salt: np.ndarray, buckets: int) -> np.ndarray:
    return mix(mix(ids) ^ salt) % buckets


def choose(group: np.ndarray, n: np.ndarray, words: np.ndarray, before: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which next words pay, how often each word of a row is met, which groups are states, and the log10 of what a state leaves per unit of its suffix.

    Each row is a next word met ``n`` times in its group, with log10 ``before`` in
    the group's suffix, or ``n`` words met once where ``words`` is ONE; a group is met ``met`` times.
    """
    bit = np.log10(2)
    many = np.where(words == ONE, n, 1.0)
    n = np.where(words == ONE, np.minimum(n, 1.0), n)
    own = log_share(n, met[group])
    gain = np.where(n > 0, n * (own - before), 0.0)
    pays = gain > BITS * bit
    total = lambda values: np.bincount(group[pays], (values * many)[pays], len(met))
    number, counted = total(np.ones(len(n))), total(n)
    left, free = 1 - total(10.0**own), 1 - total(10.0**before)
    fits = (number > 0) & (left > 0) & (free > 1e-9)
    rest = np.log10(np.where(fits, left, 1.0) / np.where(fits, free, 1.0))
    saved = total(gain) + np.maximum(met - counted, 0) * rest
    return pays, n, fits & (saved > BITS * bit * (number + 1)), rest


def hot_states(held: DataFrame, read, hot: dict[int, int], tokens: int, buckets: int) -> DataFrame:
    """Rows of EXCHANGE without a block: the state of each hot word that is one, for each range of the word.

    A task holds the distinct next words of one word, at most the vocabulary.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read(batches):
            some = np.isin(block.ids[block.b], list(hot)) & (block.n > 0)
            columns = [pa.array(x[some]) for x in (block.ids[block.b], block.ids[block.c], block.n, block.counts[block.c], block.counts[block.b])]
            yield pa.RecordBatch.from_arrays(columns, ["b", "c", "n", "count", "met"])

    def state(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c")
        word, met = int(frame["b"].iloc[0]), frame["met"].to_numpy()[:1].astype(float)
        before = np.log10((frame["count"].to_numpy() + 1) / tokens)
        pays, n, kept, rest = choose(np.zeros(len(frame), np.int64), frame["n"].to_numpy().astype(float), frame["c"].to_numpy(), before, met)
        if not kept[0]:
            return pd.DataFrame({"block": [], "bucket": [], "body": []})
        body = pack(np.array([word]), rest, frame["c"].to_numpy()[pays], n[pays].astype(np.int64))
        ranges = np.unique(bucket_of(np.array([word]), np.arange(hot[word]), buckets))
        return pd.DataFrame({"block": -1, "bucket": ranges, "body": [body] * len(ranges)})

    counted = held.mapInArrow(pairs, "b long, c long, n long, count long, met long").groupBy("b", "c").agg(
        F.sum("n").alias("n"), F.max("count").alias("count"), F.max("met").alias("met"))
    return counted.groupBy("b").applyInPandas(state, EXCHANGE)


def range_answers(frame: pd.DataFrame, hot: dict[int, int], tokens: int) -> pd.DataFrame:
    """Rows of EXCHANGE: for each block, what states make of the triples that it dealt to this range."""
    sent = frame[frame["block"] >= 0]
    rows = [unpack(body) for body in sent["body"]]
    for row in rows:
        row[0] = np.cumsum(row[0] >> 1 ^ -(row[0] & 1))
        row[1] = np.cumsum(np.append(row[1][:1], -row[1][1:]))  # the most frequent comes first
    if not rows:
        return pd.DataFrame({"block": [], "bucket": [], "body": []})
    ids, at = np.unique(np.concatenate([r[0] for r in rows]), return_index=True)
    counts = np.concatenate([r[1] for r in rows])[at]
    size = len(ids)
    known = [np.append(np.searchsorted(ids, r[0]), size) for r in rows]
    b, a, c = (np.concatenate([k[r[i]] for k, r in zip(known, rows)]) for i in (2, 3, 4))
    contexts, context = np.unique(b * (size + 1) + a, return_inverse=True)
    triples, triple = np.unique(context * size + c, return_inverse=True)
    n = np.bincount(triple, np.concatenate([r[5] for r in rows]), len(triples))
    context, c = np.divmod(triples, size)
    b, a = np.divmod(contexts, size + 1)
    # States of one word, over the pairs of a word and its next one.
    pairs, pair = np.unique(b[context] * size + c, return_inverse=True)
    suffix, follows = np.divmod(pairs, size)
    root = np.log10((counts + 1) / tokens)
    times = np.bincount(pair, n, len(pairs))
    pays, single, kept, rest = choose(suffix, times, ids[follows], root[follows], np.bincount(suffix, times, size))
    kept &= ~np.isin(ids, list(hot))  # only a part of their pairs is here
    single = np.where(kept[suffix] & pays, single, 0)
    left = np.where(kept[suffix] & ~pays, rest[suffix], 0.0)
    for body in frame["body"][frame["block"] < 0]:
        word, open_share, words, shares = unpack(body)
        here = np.flatnonzero(ids[suffix] == word[0])
        spot = np.minimum(np.searchsorted(words, ids[follows[here]]), len(words) - 1)
        hit = words[spot] == ids[follows[here]]
        single[here], left[here] = np.where(hit, shares[spot], 0), np.where(hit, 0.0, open_share[0])
    value = np.where(single > 0, log_share(single, counts[suffix]), root[follows]) + left
    # States of two words; where no word stands in the second place there is none.
    met = np.bincount(context, n, len(contexts))
    pays, n, kept, rest = choose(context, n, ids[c], value[pair], met)
    kept &= a < size
    held = kept[context] & pays
    n = np.where(held, n, single[pair])
    met = np.where(held, met[context], 0)
    left = np.where(held, 0.0, left[pair] + np.where(kept, rest, 0.0)[context])
    cuts = np.cumsum([len(r[2]) for r in rows])[:-1]
    bodies = [pack_answer(n[t], met[t], left[t]) for t in np.split(triple, cuts)]
    return pd.DataFrame({"block": sent["block"].to_numpy(), "bucket": sent["bucket"].to_numpy(), "body": bodies})


def score_texts(df: DataFrame, train, key_col: str = "doc_id", text_col: str = "text", range_tokens: int = RANGE_TOKENS) -> tuple[DataFrame, int]:
    """((key, n_tokens, n_known, base_score, score) of every row, number of learned tokens).

    The texts of the rows where the column ``train`` holds are learned from.  A null or
    empty text is one end.  The base is the smoothed word count of each token.
    Repeated rows are scored each, an empty table gives no rows.
    """
    docs = df.select(F.col(f"`{key_col}`").alias("key"), text_or_empty(text_col).alias("text"), train.alias("train"))
    blocks = word_blocks(docs)
    size, texts = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "texts")]).first()
    buckets = max(1, -(-size // range_tokens))
    numbered = numbered_words(blocks, buckets, range_tokens)
    sums = [unpack(r["body"]) for r in numbered.where("block < 0").select("body").collect()]  # one for each range
    total, distinct = (sum(int(x[i][0]) for x in sums) for i in (0, 1))
    total += texts
    tokens = total + distinct + (texts > 0) + 1
    hot = {w: -(-c // range_tokens) for x in sums for w, c in zip(x[2].tolist(), x[3].tolist())}  # at most one for each range
    if texts > range_tokens:
        hot[END] = -(-texts // range_tokens)
    hits = numbered.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias("hits"))  # the words of one block
    # Stored, as two steps read it; what is stored already takes no more room.
    held = checkpointed(blocks.select("block", "keys", "body").join(hits, "block", "left"))
    removed(blocks, numbered)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        for batch in batches:
            for body, found in zip(*(batch.column(batch.schema.names.index(c)) for c in ("body", "hits"))):
                yield Block(body.as_py(), found.as_py(), texts, tokens, buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in zip(batch.column(batch.schema.names.index("block")).to_pylist(), read(iter([batch]))):
                out, nothing = [], len(block.ids)
                for bucket, some in block.ranges(hot, buckets):
                    b, a, c = block.b[some], block.a[some], block.c[some]
                    used = np.zeros(nothing + 1, bool)
                    used[b] = used[a] = used[c] = True
                    used[nothing] = False
                    code = np.cumsum(used) - used  # no word in the second place gets the number of the words used
                    steps = np.diff(block.ids[used[:-1]], prepend=0)  # ascending among words of one count
                    steps = steps << 1 ^ steps >> 63
                    out.append((number, bucket, pack(steps, np.abs(np.diff(block.counts[used[:-1]], prepend=0)), code[b], code[a], code[c], block.n[some])))
                if out:
                    yield exchange(out)

    dealt = held.select("block", "body", "hits").mapInArrow(deal, EXCHANGE)
    if hot:
        dealt = dealt.unionByName(hot_states(held.select("body", "hits"), read, hot, tokens, buckets))
    answered = checkpointed(dealt.groupBy("bucket").applyInPandas(lambda frame: range_answers(frame, hot, tokens), EXCHANGE))
    found = answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias("found"))  # the places of one block

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.names.index(name))  # noqa: B023, E731
            for keys, answers, block in zip(column("keys"), column("found"), read(iter([batch]))):
                bodies = {x["bucket"]: x["body"] for x in answers.as_py() or []}
                root, known = np.log10((block.counts + 1) / tokens), block.counts > 0
                value = np.empty(len(block.b))
                for bucket, some in block.ranges(hot, buckets):
                    value[some] = triple_values(bodies[bucket], block.counts[block.b[some]], root[block.c[some]])
                score = root[block.codes]
                score[block.dealt] = value[block.place]
                add = lambda values: pa.array(np.add.reduceat(values, block.first))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(block.lengths), add(known[block.codes].astype(np.int64)), add(root[block.codes]), add(score)],
                    ["key", "n_tokens", "n_known", "base_score", "score"])

    kind = f"key {docs.schema['key'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    return held.join(found, "block", "left").select("keys", "found", "body", "hits").mapInArrow(finish, kind), total
