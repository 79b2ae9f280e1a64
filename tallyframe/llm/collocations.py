"""Phrase collocations by set-oriented relational mining over occurrence relations.

The relation of length k holds the occurrences of all frequent phrases of k
words, sorted by piece and position.  The next length comes from merge-joining
it with itself on the same piece and the adjacent position: a phrase of k + 1
words is the pair of the phrases of k words that start at a place and at the
next one, and it can only be frequent if both are.  The pairs are counted over
all rows, and the joined relation is semi-joined with the frequent ones before
the next length is tried.

Occurrences are stored in blocks of one group's texts, as two sorted packed
columns (place, number of the phrase); the places of a block skip one number
between pieces, so adjacent places are always in one piece.  The merge-join runs
inside the blocks, while counts, frequent phrases and the semi-join are Spark
tables.  No table of words or phrases is assumed small: Catalyst broadcasts one
only where its stored size allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import by_value, checkpointed, removed, text_or_empty

by_value(__name__)

#: Occurrences of a frequent phrase.
LEAST = 100
#: Words of the longest phrase.
LONGEST = 5
#: Phrases reported per group.
TOP = 2_000
#: Words of a block of texts.
BLOCK_WORDS = 1_000_000
#: Parts of a group whose best phrases are picked before the group's.
SALTS = 64
#: Capital letters become small ones, the characters that part pieces a new line, tabs a space.
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")

RELATION = "block long, size int, places binary, codes binary, names array<long>"


def pack(numbers: np.ndarray) -> bytes:
    """Compressed byte planes; ascending numbers as their differences."""
    numbers = numbers.astype("<i4")
    steps = np.diff(numbers, prepend=np.int32(0)).astype("<i4")
    ascending = bool((steps >= 0).all())
    planes = (steps if ascending else numbers).view(np.uint8).reshape(-1, 4).T
    return bytes([ascending]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, size: int) -> np.ndarray:
    if size == 0:
        return np.zeros(0, "<i4")
    planes = np.frombuffer(pa.decompress(memoryview(packed)[1:], size * 4, codec="zstd", asbytes=True), np.uint8).reshape(4, size)
    numbers = np.ascontiguousarray(planes.T).view("<i4").ravel()
    return np.cumsum(numbers, dtype="<i4") if packed[0] else numbers


def pieces_of(text: str) -> list[list[bytes]]:
    """The words of each piece that has any."""
    split = (piece.split(b" ") for piece in text.encode().translate(LETTERS).split(b"\n"))
    return [words for words in ([w for w in piece if w] for piece in split) if words]


class Block:
    """Words of texts of one group: their places and numbers in order of first sight."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.codes: list[int] = []
        self.lengths: list[int] = []

    def add(self, text: str) -> int:
        numbers, before = self.numbers, len(self.codes)
        for words in pieces_of(text):
            self.codes += [numbers.setdefault(w, len(numbers)) for w in words]
            self.lengths.append(len(words))
        return len(self.codes) - before

    def row(self) -> tuple[int, bytes, bytes, list[bytes], np.ndarray]:
        """(size, places, codes, words, their counts)"""
        codes = np.array(self.codes, np.int64)
        places = np.arange(len(codes)) + np.repeat(np.arange(len(self.lengths)), self.lengths)
        return len(codes), pack(places), pack(codes), list(self.numbers), np.bincount(codes, minlength=len(self.numbers))


def word_blocks(docs: DataFrame) -> DataFrame:
    """(block, lang, size, places, codes, words, counts) of (lang, text), a stage table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        open_blocks: dict[str, Block] = {}
        held = 0

        def out(lang: str) -> pa.RecordBatch:
            nonlocal number
            size, places, codes, words, counts = open_blocks.pop(lang).row()
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([size], pa.int32()), pa.array([places]), pa.array([codes]),
                 pa.array([[w.decode() for w in words]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                ["block", "lang", "size", "places", "codes", "words", "counts"])

        for batch in batches:
            names = batch.schema.names
            for lang, text in zip(batch.column(names.index("lang")), batch.column(names.index("text"))):
                lang = lang.as_py()
                block = open_blocks.setdefault(lang, Block())
                held += block.add(text.as_py())
                if held >= BLOCK_WORDS:  # the fullest block goes, so that many groups need no more memory than one
                    fullest = max(open_blocks, key=lambda g: len(open_blocks[g].codes))
                    held -= len(open_blocks[fullest].codes)
                    yield out(fullest)
        for lang in list(open_blocks):
            yield out(lang)

    kind = "block long, lang string, size int, places binary, codes binary, words array<string>, counts array<long>"
    return checkpointed(docs.mapInArrow(run, kind).where("size > 0"))


def relation_batch(rows: list[tuple]) -> pa.RecordBatch:
    blocks, sizes, places, codes, names = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(places, pa.binary()), pa.array(codes, pa.binary()),
         pa.array(names, pa.list_(pa.int64()))], ["block", "size", "places", "codes", "names"])


def frequent_words(blocks: DataFrame, least: int) -> DataFrame:
    """(block, code, a, id, lang, word): the words with at least ``least`` occurrences, for every block that has them.

    A stage table; one row of each word names its lang and word, the others hold
    null there.  Blocks hold a word once, so even the most frequent one has one
    row per block, and the shuffle that counts words also marks them.
    """
    word = Window.partitionBy("lang", "word")
    both = F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))
    rows = blocks.select("block", "lang", F.posexplode(both).alias("code", "hit")).select("block", "lang", "code", "hit.word", "hit.n")
    # Numbered behind the shuffle, which the window shares; the stage table fixes the numbers.
    rows = rows.repartition("lang", "word").withColumn("row", F.monotonically_increasing_id())
    counted = rows.select("*", F.sum("n").over(word).alias("a"), F.min("row").over(word).alias("id")).where(F.col("a") >= least)
    return checkpointed(counted.select("block", "code", "a", "id", *[F.when(F.col("row") == F.col("id"), F.col(c)).alias(c) for c in ("lang", "word")]))


def word_relation(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The relation of length 1: the blocks without the words that are not frequent."""
    hits = words.groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("hits"))  # at most the words of one block

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, size, places, codes, hits, width in zip(*(batch.column(i) for i in range(6))):
                size = size.as_py()
                old, names = (hits.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                fresh = np.full(width.as_py(), -1, np.int64)
                fresh[old] = np.arange(len(old))
                codes = fresh[unpack(codes.as_py(), size)]
                keep = codes >= 0
                yield relation_batch([(block.as_py(), int(keep.sum()), pack(unpack(places.as_py(), size)[keep]), pack(codes[keep]), names)])

    narrow = blocks.select("block", "size", "places", "codes", F.size("words").alias("width"))  # the words stay where they are
    both = narrow.join(hits, "block").select("block", "size", "places", "codes", "hits", "width")
    return checkpointed(both.mapInArrow(work, RELATION))


def merge_join(size: int, places: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, code there, code at the next place) of the occurrences that have an adjacent one."""
    at, code = unpack(places, size), unpack(codes, size).astype(np.int64)
    hit = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[hit], code[hit], code[hit + 1]


def pair_counts(relation: DataFrame) -> DataFrame:
    """(block, left, right, n): the distinct adjacent pairs of each block with their counts there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, size, places, codes, names in zip(*(batch.column(i) for i in range(5))):
                _, left, right = merge_join(size.as_py(), places.as_py(), codes.as_py())
                names = names.values.to_numpy()
                pairs, n = np.unique(left * len(names) + right, return_counts=True)
                if len(pairs):
                    first, second = np.divmod(pairs, len(names))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pairs), block.as_py())), pa.array(names[first]), pa.array(names[second]), pa.array(n)],
                        ["block", "left", "right", "n"])

    return relation.mapInArrow(work, "block long, left long, right long, n long")


def frequent_pairs(relation: DataFrame, least: int) -> DataFrame:
    """(block, left, right, a, id): the pairs with at least ``least`` occurrences over all blocks, for every block that has them.

    A stage table.  Blocks hold a pair once, so even the most frequent pair has one row per block.
    """
    pair = Window.partitionBy("left", "right")
    # Numbered behind the shuffle, which the window shares; the stage table fixes the numbers.
    rows = pair_counts(relation).repartition("left", "right").withColumn("row", F.monotonically_increasing_id())
    counted = rows.select("block", "left", "right", F.sum("n").over(pair).alias("a"), F.min("row").over(pair).alias("id"))
    return checkpointed(counted.where(F.col("a") >= least))


def extended(relation: DataFrame, pairs: DataFrame) -> DataFrame:
    """The relation of the next length: the merge-join of the relation with itself, semi-joined with the frequent pairs."""
    hits = pairs.groupBy("block").agg(F.collect_list(F.struct("left", "right", "id")).alias("hits"))  # at most the pairs of one block

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, size, places, codes, names, hits in zip(*(batch.column(i) for i in range(6))):
                at, left, right = merge_join(size.as_py(), places.as_py(), codes.as_py())
                names = names.values.to_numpy()
                order = np.argsort(names)
                first, second, ids = (hits.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                code = [order[np.searchsorted(names, side, sorter=order)] for side in (first, second)]
                keys = code[0] * len(names) + code[1]
                by_key = np.argsort(keys)
                wanted = left * len(names) + right
                spot = np.minimum(np.searchsorted(keys, wanted, sorter=by_key), len(keys) - 1)
                keep = keys[by_key[spot]] == wanted
                yield relation_batch([(block.as_py(), int(keep.sum()), pack(at[keep]), pack(by_key[spot][keep]), ids)])

    return checkpointed(relation.join(hits, "block").select(*relation.columns, "hits").mapInArrow(work, RELATION))


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)); the products have 38 digits."""
    a, n, left, right, thousand = (c.cast("decimal(38,0)") for c in (a, n, left, right, F.lit(1000)))
    return F.call_function("div", a * n * thousand, left * right)


def mine_phrases(df: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the scored phrases of 2 to ``longest`` words with at least ``least`` occurrences.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut,
    ``n`` all words of the group; the score is floor(1000 a n / (l r)) in exact
    arithmetic.  A phrase that lies in a longer one of as many occurrences is
    dropped.  A null text has no words, a null group counts as ``und``, repeated
    rows count again, and an empty table gives no rows.  Other columns are not read.
    Stage tables are deleted when the next length is made.
    """
    docs = df.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    blocks = word_blocks(docs)
    totals = checkpointed(blocks.groupBy("lang").agg(F.sum(F.col("size").cast("long")).alias("n")))
    words = frequent_words(blocks, least)
    phrases = checkpointed(words.where("word is not null").select("id", "lang", "word", "a"))
    relation = word_relation(blocks, words)
    removed(blocks, words)
    # pre and suf count the first and the last 1, 2, ... words of the phrase.
    held = phrases.select("id", "lang", F.array("word").alias("words"), F.array("a").alias("pre"), F.array("a").alias("suf"))
    found = []
    for length in range(2, longest + 1):
        pairs = frequent_pairs(relation, least)
        if pairs.isEmpty():
            break
        frequent = pairs.groupBy("id").agg(*[F.max(c).alias(c) for c in ("left", "right", "a")])
        left = held.select(F.col("id").alias("left"), "lang", F.col("words").alias("w"), F.col("pre").alias("p"))
        right = held.select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"), F.col("suf").alias("s"))
        here = frequent.join(left, "left").join(right, "right")
        here = checkpointed(here.select(
            "id", "lang", "left", "right", "a", F.array_append("w", F.col("last")).alias("words"),
            F.array_append("p", F.col("a")).alias("pre"), F.array_append("s", F.col("a")).alias("suf")))
        if found:  # phrases that this length holds as often
            ends = [here.where(F.col("a") >= F.element_at(counted, length - 1)).select(F.col(side).alias("id"))
                    for side, counted in (("left", "pre"), ("right", "suf"))]
            found[-1] = found[-1].join(ends[0].union(ends[1]), "id", "left_anti")
        found.append(here)
        spent = relation
        if length < longest:
            relation = extended(relation, pairs)
        removed(spent, pairs)
        held = here
    if not found:
        return df.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    every = found[0]
    for some in found[1:]:
        every = every.unionByName(some)
    def scored(k: Column) -> Column:
        first, rest = F.get("pre", k - 1), F.get("suf", F.size("words") - k - 1)
        return F.struct(score(F.col("a"), F.col("n"), first, rest).alias("score"), k.alias("k"), first.alias("l"), rest.alias("r"))

    lowest = F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), scored))
    best = every.join(totals, "lang").withColumn("best", lowest)
    return best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")


def top_phrases(phrases: DataFrame, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """The first ``top`` phrases of each group with their rank; each part of a group is trimmed before the group meets."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    trimmed = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    trimmed = trimmed.where(F.col("rank") <= top).drop("part", "rank")
    ranked = trimmed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_setm(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best collocations of each language over every whole document."""
    return top_phrases(mine_phrases(spark.read.parquet(f"{folder}/documents.parquet")))


def _sql() -> str:
    def phrase(first: int, last: int) -> str:
        return " || ' ' || ".join(f"w{i}" for i in range(first, last + 1))

    after = ", ".join(f"lead(word, {i}) OVER p AS w{i + 1}" for i in range(1, LONGEST))
    lengths = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, {phrase(1, k)} AS phrase, count(*) AS a FROM placed WHERE w{k} IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}"
        for k in range(1, LONGEST + 1))
    return rf"""WITH texts AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
      pieces AS (SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece,
        generate_subscripts(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), 1) AS part FROM texts),
      words AS (SELECT doc, lang, part, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) AS word,
        generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) AS place FROM pieces),
      placed AS (SELECT lang, word AS w1, {after} FROM words WINDOW p AS (PARTITION BY doc, part ORDER BY place)),
      totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
      f AS ({lengths}),
      cut AS (SELECT c.lang, c.k, c.phrase, c.a, i, array_to_string(string_split(c.phrase, ' ')[:i], ' ') AS first,
        array_to_string(string_split(c.phrase, ' ')[i + 1:], ' ') AS rest FROM f c, range(1, {LONGEST}) r(i) WHERE i < c.k),
      scored AS (SELECT cut.*, x.a AS l, y.a AS r, n, (1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS score
        FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest
        JOIN totals ON totals.lang = cut.lang),
      best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
      kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = b.lang AND g.k > b.k AND 100 * g.a >= 100 * b.a
        AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM kept QUALIFY rank <= {TOP}"""


OP13_SQL = _sql()
