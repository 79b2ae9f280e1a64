"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers are chained.  The first reads character classes
and marks where a pre-token starts.  It has a few states, so a chunk of text is
a map from state to state; the maps of all chunks are composed by a parallel
prefix scan, which gives every chunk its entry state.

The second reads the bytes of a pre-token; each transition carries the number
of tokens it adds.  Its states are sets of boundaries at which a token may
still start, each with the token that ends there and its count.  A token
survives at a boundary if merging it with the token before it gives both back;
exactly one does.  States are compiled when they are first met.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallyframe.llm.common import by_value, map_batches, text_or_empty, worker_cache

by_value(__name__)

MODEL = "byte_bpe_50k.json"
CHUNK = 512
LIMIT = 512
#: Characters of one numpy pass.
PASS_CHARS = 4_000_000

# Symbols of the first transducer.  A space or other blank is told apart by whether a visible character follows,
# an apostrophe by how many letters of a contraction follow.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_LAST, SPACE, BLANK_LAST, BLANK, END = range(10)
# Its states: nothing open, a run of letters, of numbers, of others, an open space, a run of blanks, letters owed.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, OPEN_SPACE, IN_BLANKS, OWES_ONE, OWES_TWO = range(8)
#: The white space of the pre-token pattern.
BLANKS = (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def boundary_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token starts) at symbol * 8 + state."""
    nexts, starts = np.zeros((10, 8), np.uint8), np.ones((10, 8), bool)
    for state in range(8):
        joins = state == OPEN_SPACE
        for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            nexts[symbol, state], starts[symbol, state] = run, not (joins or state == run)
        for symbol, owed in ((SHORT, OWES_ONE), (LONG, OWES_TWO)):
            inside = joins or state == IN_OTHERS  # no contraction: the apostrophe goes on with what is open
            nexts[symbol, state], starts[symbol, state] = (IN_OTHERS, False) if inside else (owed, True)
        nexts[SPACE_LAST, state], nexts[BLANK_LAST, state] = OPEN_SPACE, START
        for symbol in (SPACE, BLANK):
            nexts[symbol, state], starts[symbol, state] = IN_BLANKS, state != IN_BLANKS
        nexts[END, state] = START
    nexts[LETTER, OWES_TWO], starts[LETTER, OWES_TWO] = OWES_ONE, False
    nexts[LETTER, OWES_ONE], starts[LETTER, OWES_ONE] = START, False
    return nexts.ravel(), starts.ravel()


def character_classes(newer: dict[int, int]) -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE or BLANK for each code point; ``newer`` holds those Python does not know."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[list(newer)] = list(newer.values())
    table[list(BLANKS)] = BLANK
    table[0x20] = SPACE
    return table


def symbols_of(codes: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of the characters; ``ends`` are the places after each text, which hold END."""
    symbols = classes[codes]
    symbols[ends] = END
    seen = np.append(symbols[1:] <= OTHER, False)  # a visible character follows
    out = symbols.copy()
    out[(symbols == SPACE) & seen] = SPACE_LAST
    out[(symbols == BLANK) & seen] = BLANK_LAST
    at = np.flatnonzero(codes[:-2] == ord("'"))
    one, two = codes[at + 1], codes[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    out[at[short]], out[at[long & ~short]] = SHORT, LONG
    return out


def starts_of(symbols: np.ndarray, machine: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where pre-tokens start, by chunk maps and their prefix scan; every text ends with END."""
    nexts, starts = machine
    count = -(-len(symbols) // CHUNK)
    grid = np.full(count * CHUNK, END, np.int32)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(count, CHUNK).T) * 8
    maps = np.tile(np.arange(8, dtype=np.uint8), (count, 1))
    for row in grid:
        maps = nexts[row[:, None] + maps]
    reach = 1
    while reach < count:  # after each turn a map covers twice as many chunks
        later = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.int32)
    out = np.zeros((CHUNK, count), bool)
    for i, row in enumerate(grid):
        at = row + state
        out[i] = starts[at]
        state = nexts[at].astype(np.int32)
    return out.T.ravel()[: len(symbols)]


def byte_letters() -> dict[str, int]:
    """The byte behind each letter in which a byte-level vocabulary is written."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def newer_classes(path: str) -> dict[int, int]:
    """Classes of the code points that Python's Unicode does not assign but the tokenizer library's may."""
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def apart(codes: list[int], before: str) -> list[int]:
        starts = {span[0] for _, span in split("".join(before + chr(c) for c in codes))}
        return [c for i, c in enumerate(codes) if 2 * i + 1 in starts]

    found = apart([c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"], "!")
    return dict.fromkeys(found, LETTER) | dict.fromkeys(apart(found, "a"), NUMBER)


def read_model(path: str) -> tuple[list[bytes], list[tuple[bytes, bytes]], list[str], dict[int, int]]:
    """(tokens by id, merges by rank, special tokens, classes of newer characters)."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    letters = byte_letters()
    raw = lambda text: bytes(letters[c] for c in text)
    vocab = data["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    tokens = [raw(t) for t in sorted(vocab, key=vocab.get)]
    return tokens, [(raw(a), raw(b)) for a, b in merges], [t["content"] for t in data["added_tokens"]], newer_classes(path)


class TokenCounter(dict):
    """Number of tokens of each pre-token, by the second transducer."""

    limit = 400_000
    states_limit = 200_000

    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]], special: list[str], newer: dict[int, int]):
        super().__init__()
        self.special = special
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.tokens = [*tokens, b""]
        self.open = {t[:k] for t in tokens for k in range(1, len(t))}  # bytes that begin a longer token
        self.follows: dict[tuple[int, int], bool] = {}
        self.machine = boundary_machine()
        self.classes = character_classes(newer)
        self.restart()

    def restart(self) -> None:
        # A state: the open bytes, and (length, token that ends before them, its count less the current count) per start.
        first = (b"", ((0, len(self.tokens) - 1, 0),))
        self.states, self.numbers, self.moves = [first], {first: 0}, {}

    def merged(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == len(self.ranks):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) >= 2 * self.limit:
                self.follows.clear()
            pair = [self.tokens[left], self.tokens[right]] if self.tokens[left] else [self.tokens[right]]
            known = self.follows[left, right] = self.merged(b"".join(pair)) == pair
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens added) of a transition that was not met before."""
        data, starts = self.states[state]
        data += bytes([byte])
        for length, before, count in starts:  # the longest first
            token = self.ids.get(data[len(data) - length - 1 :])
            if token is not None and self.may_follow(before, token):
                added = count + 1
                break
        else:
            raise ValueError(f"no token ends after {data!r}")
        alive = [(length + 1, before, count - added) for length, before, count in starts if data[len(data) - length - 1 :] in self.open]
        alive.append((0, token, 0))
        key = data[len(data) - alive[0][0] :], tuple(alive)
        at = self.numbers.get(key)
        if at is None:
            at = self.numbers[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = at, added
        return at, added

    def __missing__(self, pretoken: str) -> int:
        if len(self.states) > self.states_limit:
            self.restart()
        moves, state, total = self.moves, 0, 0
        for byte in pretoken.encode():
            move = moves.get(state << 8 | byte)
            state, added = move if move is not None else self.compile(state, byte)
            total += added
        if len(self) >= self.limit:
            self.clear()
        if len(pretoken) <= 64:
            self[pretoken] = total
        return total

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings inside a text are one token each."""
        owners, parts, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = [text]
            for special in self.special:
                pieces = [x for p in pieces for x in p.split(special)]
            total[i] += len(pieces) - 1
            owners += [i] * len(pieces)
            parts += pieces
        at = 0
        while at < len(parts):
            stop, size = at, 0
            while stop < len(parts) and (stop == at or size + len(parts[stop]) < PASS_CHARS):
                size += len(parts[stop]) + 1
                stop += 1
            np.add.at(total, owners[at:stop], self.count_pass(parts[at:stop]))
            at = stop
        return total

    def count_pass(self, parts: list[str]) -> np.ndarray:
        line = "\n".join(parts) + "\n"
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        padded = np.concatenate([codes, np.zeros(2, np.uint32)])
        symbols = symbols_of(padded, ends, self.classes)[: len(codes)]
        places = np.flatnonzero(starts_of(symbols, self.machine))
        cuts = places.tolist()
        words = [line[a:b] for a, b in zip(cuts, [*cuts[1:], len(line)])]
        counts = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        counts[symbols[places] == END] = 0
        sums = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(sums[np.searchsorted(places, ends)], prepend=0)


def count_tokens(df: DataFrame, path: str | None = None, name: str = "n_tokens", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and the number of tokens of the text; a null or empty text has none.

    Rows are independent: repeated rows repeat, an empty table stays empty.
    """
    at = df.columns.index(text_col)
    path = path or public_tokenizers.path(MODEL)
    shared = df.sparkSession.sparkContext.broadcast(read_model(path))  # as large as the vocabulary file

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = worker_cache(f"counter_{path}", lambda: TokenCounter(*shared.value))
        counts = counter.count([t or "" for t in batch.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], [*batch.schema.names, name])

    return map_batches(df, work, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", text_or_empty().alias("text"))
    sized = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return count_tokens(sized).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
