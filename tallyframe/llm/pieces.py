"""SentencePiece encoding and decoding by a streaming Viterbi over the piece lattice.

The boundaries of a text are the states, the pieces its arcs.  An arc survives
at a boundary if it may follow the arc that survives at its start: merging the
two pieces' characters by the model's scores must give these two pieces again.
Merges on one side of a boundary never depend on the other side, so exactly one
arc survives at each boundary, and the surviving path is the model's own
segmentation.  Only boundaries within the longest piece can still be used;
ids are committed up to the boundary on which all their paths agree.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import by_value, map_batches, text_or_empty, worker_cache

by_value(__name__)

MODEL = "piece_bpe_32k.model"
SPACE_SIGN = "▁"
#: Pieces hold a space sign only at their start or throughout, so paths always agree before such a sign.
SEGMENT = re.compile(f"{SPACE_SIGN}*[^{SPACE_SIGN}]+|{SPACE_SIGN}+")
#: Segments up to this length are remembered.
REMEMBERED = 40
#: Characters before a boundary whose pieces are remembered together.
TAIL = 3
#: First characters of a segment whose arcs are remembered together.
HEAD = 5
#: Characters between two attempts to commit.
STRIDE = 64


def read_model(path: str) -> tuple[list[str], list[float], list[int]]:
    """(pieces, scores, kinds) by id; kind 0 is an ordinary piece, 1 a byte, 2 any other."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    kind = lambda i: 1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0
    return [sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], [kind(i) for i in ids]


def raw_pieces(pieces: list[str], kinds: list[int]) -> list[bytes]:
    """The bytes that each id decodes to."""
    return [b"" if k == 2 else bytes([int(p[3:5], 16)]) if k == 1 else p.encode() for p, k in zip(pieces, kinds)]


class Encoder(dict):
    """Packed ids of each remembered segment; also the lattice's arcs and what may follow what."""

    limit = 400_000  # segments, half of them from before the last ones met
    pairs = 400_000
    tail_limit = 50_000
    head_limit = 30_000

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 0}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = [0] * 256
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == 1:
                self.bytes[int(p[3:5], 16)] = i
        self.raw = raw_pieces(pieces, kinds)
        self.size, self.names, self.lone = len(pieces), [*pieces, ""], {}
        self.first = len(pieces)  # stands before the first boundary
        self.trie: dict = {}  # pieces by their characters from the last to the first: (id or -1, longer ones)
        for piece in sorted(self.ids, key=len):
            level = self.trie
            for c in piece[:0:-1]:
                level = level.setdefault(c, (-1, {}))[1]
            old = level.get(piece[0])
            level[piece[0]] = self.ids[piece], old[1] if old else {}
        self.tails: dict = {}
        self.heads: dict[str, tuple[list[int], list[int]]] = {}
        self.follows: dict[int, bool] = {}  # by the two arcs' numbers as one

    def merged(self, text: str) -> list[str]:
        """Merge the characters of a short text: the best score first, then the leftmost."""
        parts, scores, none = list(text), self.scores, float("-inf")
        gains = [scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == none:
                break
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = scores.get(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = scores.get(parts[i] + parts[i + 1], none)
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        return self.merged(left + right) == ([left, right] if left else [right])

    def number(self, character: str) -> int:
        """Arc number of a character that is no piece; it becomes its bytes."""
        at = self.lone.get(character)
        if at is None:
            at = self.lone[character] = len(self.names)
            self.names.append(character)
        return at

    def arcs_of(self, tail: str) -> tuple[tuple[tuple[int, int], ...], dict]:
        """(length, arc) of the pieces that end a tail, the longest first, and the trie's level behind it if it goes on; remembered."""
        ends, level = [], self.trie
        for c in reversed(tail):
            node = level.get(c)
            if node is None:
                level = {}
                break
            ends.append(node[0])
            level = node[1]
        found = [(k + 1, arc) for k, arc in enumerate(ends) if arc >= 0]
        if not found or found[0][0] > 1:
            found.insert(0, (1, self.number(tail[-1])))
        if len(self.tails) >= self.tail_limit:
            self.tails.clear()
        held = self.tails[tail] = tuple(reversed(found)), level if len(tail) == TAIL else {}
        return held

    def longer(self, text: str, at: int, base: int, level: dict) -> tuple[tuple[int, int], ...]:
        """(length, arc) of the pieces longer than the tail of ``text`` that starts at ``at``, the longest first."""
        found, length = (), TAIL
        while at > base:
            at -= 1
            length += 1
            node = level.get(text[at])
            if node is None:
                break
            arc, level = node
            if arc >= 0:
                found = ((length, arc), *found)
        return found

    def stream(self, text: str) -> list[int]:
        """Ids of a segment, read once from the left; only a window of arcs is held."""
        out: list[int] = []
        base, starts, arcs = 0, [0], [self.first]  # of boundary base + k: start and number of its surviving arc
        follows, known_of, tail_of = self.follows, self.follows.get, self.tails.get
        for end in range(1, len(text) + 1):
            at = end - TAIL
            held = tail_of(tail := text[at if at > base else base : end])
            if held is None:
                held = self.arcs_of(tail)
            ends, level = held
            if level and at > base:  # longer pieces come first
                ends = self.longer(text, at, base, level) + ends
            for length, arc in ends:
                start = end - length
                key = arcs[start - base] << 32 | arc
                known = known_of(key)
                if known is None:
                    if len(follows) >= self.pairs:
                        follows.clear()
                    known = follows[key] = self.may_follow(self.names[key >> 32], self.names[arc])
                if known:
                    starts.append(start)
                    arcs.append(arc)
                    break
            if end % STRIDE == 0 and end - base >= STRIDE:
                open_ends = set(range(max(base, end - self.longest + 1), end + 1))
                while len(open_ends) > 1:  # walk the latest path back until all paths are on one boundary
                    latest = max(open_ends)
                    open_ends.remove(latest)
                    open_ends.add(starts[latest - base])
                meet = open_ends.pop()
                out += self.path(starts, arcs, meet, base)
                starts, arcs, base = starts[meet - base :], arcs[meet - base :], meet
        return out + self.path(starts, arcs, len(text), base)

    def whole(self, text: str) -> list[int]:
        """Ids of a segment too short to commit before its end.

        What survives at a boundary depends on the characters before it alone, so segments share the arcs of their first HEAD characters.
        """
        head = text[:HEAD]
        held = self.heads.get(head)
        if held is None:
            if len(self.heads) >= self.head_limit:
                self.heads.clear()
            held = self.heads[head] = self.walk(head, [0], [self.first])
        if len(text) > HEAD:
            held = self.walk(text, held[0].copy(), held[1].copy())
        return self.path(*held, len(text), 0)

    def walk(self, text: str, starts: list[int], arcs: list[int]) -> tuple[list[int], list[int]]:
        """The starts and arcs of all boundaries of ``text``, which are given up to one of them; as in ``stream``."""
        follows, known_of, tail_of = self.follows, self.follows.get, self.tails.get
        for end in range(len(starts), len(text) + 1):
            at = end - TAIL
            held = tail_of(tail := text[at:end] if at > 0 else text[:end])
            if held is None:
                held = self.arcs_of(tail)
            ends, level = held
            if level and at > 0:  # longer pieces come first
                ends = self.longer(text, at, 0, level) + ends
            for length, arc in ends:
                start = end - length
                key = arcs[start] << 32 | arc
                known = known_of(key)
                if known is None:
                    if len(follows) >= self.pairs:
                        follows.clear()
                    known = follows[key] = self.may_follow(self.names[key >> 32], self.names[arc])
                if known:
                    starts.append(start)
                    arcs.append(arc)
                    break
        return starts, arcs

    def path(self, starts: list[int], arcs: list[int], end: int, base: int) -> list[int]:
        out = []
        while end > base:
            arc = arcs[end - base]
            if arc < self.size:
                out.append(arc)
            else:
                out += [self.bytes[b] for b in reversed(self.names[arc].encode())]
            end = starts[end - base]
        return out[::-1]

    def __missing__(self, segment: str) -> bytes:
        found = self.old.get(segment)
        if found is None:
            found = array("i", self.whole(segment) if len(segment) < STRIDE else self.stream(segment)).tobytes()
        if len(segment) <= REMEMBERED:
            if len(self) >= self.limit // 2:  # what is met again outlives what is met once
                self.old = self.copy()
                self.clear()
            self[segment] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; an empty text has none.  The model puts a space sign in front and keeps all spaces."""
        if not text:
            return np.zeros(0, np.int32)
        line = SPACE_SIGN + text.replace(" ", SPACE_SIGN)
        return np.frombuffer(b"".join(map(self.__getitem__, SEGMENT.findall(line))), "<i4")

    def decode(self, ids: list[int]) -> str:
        return decode_bytes(b"".join(map(self.raw.__getitem__, ids)))


def decode_bytes(raw: bytes) -> str:
    """The text of the bytes of ids: they join into characters, the first space sign goes, the others become spaces."""
    text = raw.decode("utf-8", "replace")
    return (text[1:] if text.startswith(SPACE_SIGN) else text).replace(SPACE_SIGN, " ")


def decode_lists(lists: pa.ListArray, raw: list[bytes]) -> list[str]:
    """The text of each list of ids; the bytes of all lists stand in one Arrow buffer, without an object for each id."""
    flat = lists.flatten()  # a null list has no values
    ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
    sizes = np.fromiter(map(len, raw), np.int32)
    cuts = np.cumsum(sizes[flat.to_numpy()], dtype=np.int64)
    cuts = np.concatenate([[0], cuts])[ends].tolist()
    data = pa.array(raw, pa.binary()).take(flat).buffers()[2]
    return [decode_bytes(data.slice(a, b - a).to_pybytes()) if b > a else "" for a, b in zip(cuts, cuts[1:])]


def encode(df: DataFrame, path: str | None = None, name: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and the piece ids of the text; a null or empty text has no ids.

    Rows are independent: repeated rows repeat, an empty table stays empty.
    """
    at = df.columns.index(text_col)
    path = path or public_tokenizers.path(MODEL)
    shared = df.sparkSession.sparkContext.broadcast(read_model(path))  # as large as the vocabulary file

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo = worker_cache(f"pieces_{path}", lambda: Encoder(*shared.value))
        found = [memo.encode(t or "") for t in batch.column(at).to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    return map_batches(df, work, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str | None = None, name: str = "decoded", ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and the text of the ids; null ids give an empty text."""
    at = df.columns.index(ids_col)
    path = path or public_tokenizers.path(MODEL)
    pieces, _, kinds = read_model(path)
    shared = df.sparkSession.sparkContext.broadcast(raw_pieces(pieces, kinds))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = decode_lists(batch.column(at), shared.value)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return map_batches(df, work, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text as a count and a digest, and whether decoding gives the text back.

    A text that holds the space sign itself decodes to a space there, as in the library.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", text_or_empty().alias("text"))
    both = decode(encode(docs))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(listed, 256).alias("ids_sha256"),
                       (F.col("decoded") == F.col("text")).alias("round_trip"))
