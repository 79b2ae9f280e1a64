"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags every token of a text as O (outside), B (a secret begins) or I
(inside).  Its features are the token's shape, the neighbouring tokens and the
kind of text around it.  It is trained in numpy on a bounded sample of texts,
labelled by the fixed patterns, and decoded by Viterbi.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import by_value, made_in_a_task, map_batches, text_or_empty, worker_cache

by_value(__name__)

# Fixed patterns (their values are given by the task), and the least length of what each must match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
STARTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
HINT = r"(?i)AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(password|passwd|secret|token|api_?key)[\"']? *[:=]"
KINDS = ("assign", "access", "hex", "crf")

#: Training texts: at most so many with a pattern's hint, and so many of any kind, least hash of the key first.
SAMPLE_HINTED = 1_500
SAMPLE_OTHER = 500
#: Tokens kept on both sides of a labelled token in training, and windows of plain text per training text.
AROUND = 20
PLAIN_WINDOWS = 3
EPOCHS = 6
SEED = 11

DIGIT = re.compile(r"\d")
RUN = re.compile(r"\d+|[A-Z]+|[^\W\dA-Z_]+|[\W_]+")
SIGN = re.compile("[=:]")
#: Signs around a token that say nothing about it.
EDGES = "\"'`.,;!?()[]{}<>"
TOKEN = re.compile(r"\S+")  # the same tokens as str.split()
O, B, I = range(3)  # noqa: E741
NEVER = -1e4


def _hits(text: str) -> tuple[bool, bool, bool]:
    """Whether a text can hold an assign, an access and a hex match; cheap tests that miss none."""
    low = text.lower()
    return any(w in low for w in STARTS), "AKIA" in text, max(map(len, text.split()), default=0) >= 32


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    assign, access, long_word = _hits(text)
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if assign else []
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if access else []
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)] if long_word else []
    return out


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secret values themselves, as training labels."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out + [m.span() for m in HEX.finditer(text)])


# Features ---------------------------------------------------------------------------------------

def shape(token: str) -> tuple[int, ...]:
    """What the token looks like without outer signs: size, case, digits, turns between kinds of characters, variety, hexadecimal, kind."""
    core = token.strip(EDGES) or token
    size = len(core)
    case = 0 if core.islower() else 1 if core.istitle() else 2 if core.isupper() else 3
    hexed = int(size >= 8 and not core.strip("0123456789abcdef"))
    variety = 4 * len(set(core)) // size
    if core.isalpha():
        return min(size, 40) // 4, case, 0, 0, variety, hexed, 1
    digits = len(DIGIT.findall(core))
    turns = len(RUN.findall(core))
    kind = 4 if "=" in core or ":" in core else 2
    return min(size, 40) // 4, case, 1 + 4 * digits // size, min(turns, 12) // 2, variety, hexed, 3 if size == 1 else kind


def short_word(token: str) -> str:
    """The word, or what stands before an equals sign or colon in it, where that is short and has no digit."""
    core = token.strip(EDGES) or token
    if not core.isalpha():
        core = SIGN.split(core, maxsplit=1)[0].strip(EDGES) or core
    return "" if len(core) > 12 or DIGIT.search(core) else core.lower()


def own_names(look: tuple[int, ...], word: str) -> list[str]:
    size, case, digits, turns, variety, hexed, kind = look
    names = [f"size{size}.{digits}", f"case{case}.{digits}.{size > 1}", f"turns{turns}.{size > 1}", f"variety{variety}.{size}",
             f"hex{hexed}.{size}", f"kind{kind}.{size > 1}"]
    return names + ["word." + word] * bool(word)


def near_names(side: str, look: tuple[int, ...], word: str) -> list[str]:
    names = [f"{side}.size{look[0] // 2}.{look[6]}", f"{side}.hex{look[5]}"]
    return names + [f"{side}.word.{word}"] * bool(word)


def file_names(text: str, tokens: int) -> list[str]:
    """The kind of text: its length, and how often it assigns."""
    signs = text.count("=") + text.count(":") + text.count('"')
    return [f"file.tokens{min(int(math.log2(tokens + 1)), 14) // 3}", f"file.signs{min(20 * signs // max(tokens, 1), 5)}"]


# Training ---------------------------------------------------------------------------------------

def labelled_windows(text: str, rng: np.random.Generator) -> list[tuple[list[list[str]], list[int]]]:
    """(feature names, tags) of the tokens around each secret value, and of some plain stretches."""
    found = list(TOKEN.finditer(text))
    if not found:
        return []
    tags = [O] * len(found)
    spans, at = value_spans(text), 0
    last = None
    for i, m in enumerate(found):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at < len(spans) and spans[at][0] < m.end():
            tags[i] = I if last == at else B
            last = at
        else:
            last = None
    file = file_names(text, len(found))
    looks = [None] * len(found)

    def look(i: int) -> tuple[tuple[int, ...], str]:
        if looks[i] is None:
            looks[i] = shape(found[i][0]), short_word(found[i][0])
        return looks[i]

    centres = [i for i, t in enumerate(tags) if t == B] + [int(x) for x in rng.integers(0, len(found), PLAIN_WINDOWS)]
    out = []
    for c in centres:
        low, high = max(0, c - AROUND), min(len(found), c + AROUND + 1)
        rows = []
        for i in range(low, high):
            before = near_names("before", *look(i - 1)) if i else ["before.start"]
            after = near_names("after", *look(i + 1)) if i + 1 < len(found) else ["after.end"]
            rows.append(own_names(*look(i)) + before + after + file)
        out.append((rows, tags[low:high]))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(score: np.ndarray, moves: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed tags [window, token, tag] and moves [from, to]; a window starts after O."""
    windows, length, _ = score.shape
    forward = np.full_like(score, NEVER)
    forward[:, 0] = score[:, 0] + moves[O]
    for t in range(1, length):
        step = _logsum(forward[:, t - 1, :, None] + moves[None], 1) + score[:, t]
        forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
    backward = np.zeros_like(score)
    for t in range(length - 2, -1, -1):
        step = _logsum(moves[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(real[:, t + 1, None], step, backward[:, t + 1])
    total = _logsum(forward[:, -1], 1)
    seen = np.eye(3)[tags]
    by_tag = (np.exp(forward + backward - total[:, None, None]) - seen) * real[..., None]
    pair = forward[:, :-1, :, None] + moves[None, None] + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
    pair = np.exp(np.minimum(pair, 0)) * real[:, 1:, None, None]
    by_move = pair.sum(axis=(0, 1)) - np.einsum("nta,ntb,nt->ab", seen[:, :-1], seen[:, 1:], real[:, 1:].astype(float))
    by_move[O] += (np.exp(forward[:, 0] + backward[:, 0] - total[:, None]) - seen[:, 0]).sum(axis=0)
    return by_tag, by_move


def train(texts: list[str]) -> tuple[dict[str, tuple[float, ...]], np.ndarray]:
    """(weights by feature, one per tag; moves [from, to]) of greatest conditional likelihood, by Adagrad with weight decay."""
    rng = np.random.default_rng(SEED)
    windows, seen = [], {}  # names become numbers text by text, so that the names of all windows are never held
    for text in texts:
        for rows, tags in labelled_windows(text, rng):
            windows.append(([np.array([seen.setdefault(n, len(seen)) for n in r], np.int32) for r in rows], tags))
    often = np.zeros(len(seen), np.int64)
    for rows, _ in windows:
        np.add.at(often, np.concatenate(rows), 1)
    names = {n: i for i, n in enumerate(sorted(n for n, k in seen.items() if often[k] >= 3))}
    none = len(names)
    number = np.array([names.get(n, -1) for n in seen], np.int32)
    del seen
    weights, moves = np.zeros((none + 1, 3)), np.zeros((3, 3))
    moves[O, I] = NEVER
    if not any(t != O for _, marks in windows for t in marks):
        moves[:, 1:] = NEVER  # nothing to learn from: every token is outside
        return {}, moves
    length = 2 * AROUND + 1
    most = max(len(r) for rows, _ in windows for r in rows)
    slots = np.full((len(windows), length, most), none, np.int32)
    tags = np.zeros((len(windows), length), dtype=np.int64)
    real = np.zeros((len(windows), length), dtype=bool)
    for n, (rows, marks) in enumerate(windows):
        for t, r in enumerate(rows):
            known = number[r]
            known = known[known >= 0]
            slots[n, t, : len(known)] = known
        tags[n, : len(marks)] = marks
        real[n, : len(marks)] = True
    del windows
    weight_sum, move_sum = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(slots))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            score = weights[slots[pick]].sum(axis=2)
            by_tag, by_move = gradient(score, moves, tags[pick], real[pick])
            down = np.zeros_like(weights)
            flat = slots[pick].reshape(-1, most)
            for k in range(3):
                down[:, k] = np.bincount(flat.ravel(), np.repeat(by_tag.reshape(-1, 3)[:, k], most), none + 1)
            down = down / len(pick) + 1e-4 * weights
            weight_sum += down * down
            weights -= 0.2 * down / np.sqrt(weight_sum)
            weights[none] = 0
            by_move = by_move / len(pick)
            move_sum += by_move * by_move
            moves -= 0.2 * by_move / np.sqrt(move_sum)
            moves[O, I] = NEVER
    return {n: tuple(weights[i].tolist()) for n, i in names.items()}, moves


# Decoding ---------------------------------------------------------------------------------------

class Tokens(dict):
    """Row number of each token; tokens of one look share a row of scores as itself, as the one before, as the one after.

    Forgets its tokens when it holds ``limit`` of them; there are few rows, as words unknown to the field leave only their looks.
    """

    limit = 300_000

    def __init__(self, weights: dict[str, tuple[float, ...]]):
        super().__init__()
        self.weights, self.numbers, self.rows = weights, {}, np.zeros((1024, 9))
        self.words = {n.rsplit(".", 1)[-1] for n in weights if "word." in n}

    def total(self, names: list[str]) -> np.ndarray:
        return np.sum([self.weights[n] for n in names if n in self.weights] or [(0.0, 0.0, 0.0)], axis=0)

    def __missing__(self, token: str) -> int:
        word = short_word(token)
        key = shape(token), word if word in self.words else ""
        at = self.numbers.get(key)
        if at is None:
            at = self.numbers[key] = len(self.numbers)
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at] = np.concatenate([self.total(n) for n in (own_names(*key), near_names("before", *key), near_names("after", *key))])
        self[token] = at
        return at


def viterbi(score: np.ndarray, moves: list[list[float]]) -> list[int]:
    """Best tags of a stretch between two tokens that are outside."""
    best, back = [moves[O][s] + float(score[0, s]) for s in range(3)], []
    for row in score[1:].tolist():
        steps = [max(range(3), key=lambda a: best[a] + moves[a][s]) for s in range(3)]  # noqa: B023
        best = [best[steps[s]] + moves[steps[s]][s] + row[s] for s in range(3)]
        back.append(steps)
    tag = max(range(3), key=lambda s: best[s] + moves[s][O])
    tags = [tag]
    for steps in reversed(back):
        tag = steps[tag]
        tags.append(tag)
    return tags[::-1]


def decode(score: np.ndarray, moves: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) token of every secret of the best tag sequence.

    A token can only be inside a secret if some stretch around it gains over O
    even with the best moves; all others are outside, so Viterbi runs over the
    few stretches left and finds the best path of the whole text.
    """
    gain_in = max(moves[a, s] for a in range(3) for s in (B, I)) - moves[O, O]
    gain_out = max(0.0, max(moves[B, O], moves[I, O]) - moves[O, O])
    gain = score[:, 1:].max(axis=1) - score[:, 0] + gain_in + gain_out
    if not (gain > 0).any():
        return []
    total = np.concatenate([[0.0], np.cumsum(gain, dtype=np.float64)])
    low = np.minimum.accumulate(total)[:-1]
    high = np.maximum.accumulate(total[::-1])[::-1][1:]
    may = np.concatenate([[False], high - low > 0, [False]])
    edges = np.flatnonzero(may[1:] != may[:-1])
    steps, out = moves.tolist(), []
    for a, b in zip(edges[::2], edges[1::2]):
        for i, tag in enumerate(viterbi(score[a:b], steps), int(a)):
            if tag == B:
                out.append((i, i + 1))
            elif tag == I:
                out[-1] = (out[-1][0], i + 1)
    return out


def field_spans(text: str, memo: Tokens, moves: np.ndarray) -> list[tuple[int, int]]:
    words = text.split()
    if not words:
        return []
    if len(memo) > memo.limit:
        memo.clear()
    ids = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    rows = memo.rows
    score = rows[ids, 0:3]
    score[1:] += rows[ids[:-1], 3:6]
    score[:-1] += rows[ids[1:], 6:9]
    score[0] += memo.total(["before.start"])
    score[-1] += memo.total(["after.end"])
    score += memo.total(file_names(text, len(words)))
    found = decode(score, moves)
    if not found:
        return []
    places = [m.span() for m in TOKEN.finditer(text)]
    out = []
    for a, b in found:
        low, high = places[a][0], places[b - 1][1]
        core = text[low:high].strip(EDGES)
        low += text[low:high].index(core)
        out.append((low, low + len(core)))
    return [(a, b) for a, b in out if b > a]


def all_spans(text: str, memo: Tokens, moves: np.ndarray) -> list[tuple[str, int, int]]:
    """Pattern spans, and the field's spans that touch none of them, by start and kind."""
    base = base_spans(text)
    added = [("crf", a, b) for a, b in field_spans(text, memo, moves) if all(b <= s or a >= e for _, s, e in base)]
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# On tables --------------------------------------------------------------------------------------

SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def fit(df: DataFrame, key_col: str = "doc_id", text_col: str = "text",
        hinted: int = SAMPLE_HINTED, other: int = SAMPLE_OTHER) -> tuple[dict, np.ndarray]:
    """Train, in one task, on at most ``hinted`` keys whose texts hint at a pattern and ``other`` keys of any kind."""
    rows = df.select(F.col(f"`{key_col}`").alias("key"), text_or_empty(text_col).alias("text")).where("key is not null")
    order = [F.xxhash64("key"), F.col("key")]
    keys = rows.where(F.col("text").rlike(HINT)).select("key").orderBy(*order).limit(hinted)
    keys = keys.union(rows.select("key").orderBy(*order).limit(other)).distinct()
    texts = rows.join(F.broadcast(keys), "key").select("text")
    return made_in_a_task(texts, lambda found: train(sorted(text for text, in found)))


def scan(df: DataFrame, model: tuple[dict, np.ndarray], name: str = "spans", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and the spans of each text, in code points with the end exclusive.

    A null or empty text has none.  Nothing depends on other rows, so repeated
    rows repeat their spans and an empty table stays empty.
    """
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample
    shared_id = zlib.crc32(repr(model).encode())
    kind = T.StructType([T.StructField(name, SPAN_TYPE)])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, moves = shared.value
        memo = worker_cache(f"secret_tokens_{shared_id}", lambda: Tokens(weights))
        spans = [[dict(zip(("kind", "start", "end"), s)) for s in all_spans(t or "", memo, moves)] for t in batch.column(at).to_pylist()]
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, item)], [*batch.schema.names, name])

    return map_batches(df, work, T.StructType([*df.schema.fields, *kind.fields]))


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def mask(text: Column, spans: Column, sign: str = "[SECRET]") -> Column:
    """The text with each stretch covered by spans replaced by ``sign``; spans are ordered by start."""
    state = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        plain = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.when(fresh, F.concat(acc["parts"], F.array(plain, F.lit(sign)))).otherwise(acc["parts"]).alias("parts"),
            F.greatest(acc["at"], s["end"]).alias("at"))

    joined = F.aggregate(spans, state, step, lambda acc: F.concat(F.concat_ws("", acc["parts"]), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = scan(narrow, fit(narrow)).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
