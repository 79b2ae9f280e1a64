"""Near-duplicate groups by SimHash, searched by the generalised pigeonhole principle.

The 64 fingerprint bits are put into parts of correlated bits.  If the part
thresholds T_i of a query (-1: part not probed) add up to ``tau - parts + 1``,
every fingerprint within ``tau`` bits is within T_i bits on at least one part.
For each fingerprint a dynamic program picks the thresholds of least estimated
cost from counts of part values over all fingerprints; it probes the index with
all values within its thresholds, and every candidate is verified on all bits.

Values of a part are counted in blocks of at most 16 bits, so the counts that
are sent to the tasks are bounded (64/16 blocks of 65,536 counts) at any size.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import by_value, checkpointed, components, map_batches, pack_bits, with_row

by_value(__name__)

SEED = 42
WIDTH = 3
TAU = 3
PARTS = 4


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, or of all words if there are fewer."""
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[width:])], dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """A bit is set if more than half of the hashes set it."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        some = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return pack_bits(counts * 2 > len(hashes))


def fingerprint_text(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode().lower().split()
    return int(majority(shingle_hashes(words, width))) if words else 0


def add_fingerprint(df: DataFrame, name: str, width: int, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and the fingerprint of the text as a signed long.

    A null text is empty; a text without words has fingerprint 0; fewer words
    than ``width`` make one shingle.
    """
    at = df.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint_text(t, width) for t in batch.column(at).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, name])

    return map_batches(df, work, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def hex_print(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# The index --------------------------------------------------------------------------------------

def _as_bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_pairs(prints: DataFrame) -> tuple[np.ndarray, int]:
    """How often two bits are set together, over all fingerprints (64 x 64), and the number of fingerprints."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = _as_bits(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
        both = np.rint(bits.T @ bits).astype(np.int64).ravel()
        cells = np.append(np.arange(4096), 4096)
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.append(both, len(bits)))], ["cell", "n"])

    rows = map_batches(prints, work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(4097)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out[:4096].reshape(64, 64), int(out[4096])


def group_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Parts of about equal width; each grows from one bit by the bit that correlates most with it."""
    share = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs((both / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, groups = list(range(64)), []
    for i in range(parts):
        size = 64 // parts + (i < 64 % parts)
        first = max(free, key=lambda b: (tie[b, free].max(initial=0), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def part_values(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))


def blocks_of(groups: list[list[int]]) -> list[tuple[int, int, list[int]]]:
    """(part, shift inside the part, bits), each at most 16 bits."""
    out = []
    for part, group in enumerate(groups):
        pieces = -(-len(group) // 16)
        cuts = [round(len(group) * k / pieces) for k in range(pieces + 1)]
        out += [(part, a, group[a:b]) for a, b in zip(cuts, cuts[1:])]
    return out


def value_counts(prints: DataFrame, blocks: list[tuple[int, int, list[int]]]) -> list[np.ndarray]:
    """For each block, the number of fingerprints with each value; at most 65,536 counts a block."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = _as_bits(batch.column(0).to_numpy().view(np.uint64))
        keys = np.concatenate([part_values(bits, b) + (k << 16) for k, (_, _, b) in enumerate(blocks)])
        keys, counts = np.unique(keys, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    # As columns: the driver holds no object for each count.
    found = map_batches(prints, work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = (found[c].to_numpy() for c in ("key", "n"))
    out = [np.zeros(1 << len(b)) for _, _, b in blocks]
    for at, counts in enumerate(out):
        here = keys >> 16 == at
        counts[keys[here] & 0xFFFF] = n[here]
    return out


def within(counts: np.ndarray, most: int) -> np.ndarray:
    """[d, v]: how many fingerprints differ from block value v in exactly d bits (d <= most)."""
    out = np.zeros((most + 1, len(counts)))
    out[0] = counts
    for bit in range(len(counts).bit_length() - 1):
        flipped = out[:, np.arange(len(counts)) ^ (1 << bit)]
        out[1:] = out[1:] + flipped[:-1]
    return out


def near_counts(block_counts: list[np.ndarray], tau: int) -> list[np.ndarray]:
    return [within(c, tau).astype(np.float32) for c in block_counts]


def estimates(bits: np.ndarray, groups, blocks, near: list[np.ndarray], total: int, tau: int) -> np.ndarray:
    """[part, t, row]: estimated candidates of threshold t; blocks of one part are taken as independent."""
    out = np.zeros((len(groups), tau + 1, len(bits)))
    for part in range(len(groups)):
        exact = None
        for (p, _, b), counts in zip(blocks, near):
            if p == part:
                here = counts[:, part_values(bits, b)].astype(float)
                if exact is None:
                    exact = here
                else:
                    exact = np.stack([sum(exact[i] * here[d - i] for i in range(d + 1)) / max(total, 1) for d in range(tau + 1)])
        out[part] = np.cumsum(exact, axis=0)
    return out


def choose_thresholds(costs: np.ndarray, tau: int) -> np.ndarray:
    """[part, row] thresholds in -1..tau that add up to ``tau - parts + 1`` at least cost."""
    parts, _, rows = costs.shape
    most = tau + 1  # thresholds are counted from -1, so their sum of steps is tau + 1
    full = np.concatenate([np.zeros((parts, 1, rows)), costs], axis=1)
    best = np.full((parts + 1, most + 1, rows), np.inf)
    best[0, 0] = 0
    taken = np.zeros((parts + 1, most + 1, rows), dtype=np.int8)
    for p in range(parts):
        for used in range(most + 1):
            for step in range(used + 1):
                cost = best[p, used - step] + full[p, step]
                better = cost < best[p + 1, used]
                best[p + 1, used][better] = cost[better]
                taken[p + 1, used][better] = step
    out = np.zeros((parts, rows), dtype=np.int64)
    left = np.full(rows, most)
    for p in range(parts, 0, -1):
        step = taken[p, left, np.arange(rows)]
        out[p - 1] = step - 1
        left = left - step
    return out


def flips(width: int, most: int) -> list[np.ndarray]:
    """Masks of exactly d set bits, for d = 0..most."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), d)], dtype=np.int64) for d in range(most + 1)]


def links(prints: DataFrame, tau: int = TAU, parts: int = PARTS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints in column ``fp`` that differ in 1..tau bits.

    ``prints`` holds each fingerprint once and should be a stored table; it is
    read three times.  No bucket or candidate is dropped.  Where it has a column
    ``cluster`` (long), only pairs of different clusters are looked for.
    """
    cluster = F.col("cluster") if "cluster" in prints.columns else F.col("fp")
    prints = prints.select("fp", cluster.alias("cluster"))
    both, total = bit_pairs(prints)
    groups = group_bits(both, total, parts)
    blocks = blocks_of(groups)
    counts = value_counts(prints, blocks)
    model = prints.sparkSession.sparkContext.broadcast(near_counts(counts, tau))
    masks = [flips(len(g), tau) for g in groups]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, cluster = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bits = _as_bits(own.view(np.uint64))
        costs = estimates(bits, groups, blocks, model.value, total, tau)
        for part, by_count in enumerate(masks):  # a probe costs about as much as a candidate
            costs[part] += np.cumsum([len(m) for m in by_count])[:, None]
        chosen = choose_thresholds(costs, tau)
        keys, fps, clusters, asks = [], [], [], []
        for part, group in enumerate(groups):
            base = np.int64(part) << 58
            values = part_values(bits, group)
            keys.append(values | base), fps.append(own), clusters.append(cluster), asks.append(np.zeros(len(own), bool))
            for d, mask in enumerate(masks[part]):
                rows = np.flatnonzero(chosen[part] >= d)
                keys.append((values[rows, None] ^ mask[None, :]).ravel() | base)
                fps.append(np.repeat(own[rows], len(mask)))
                clusters.append(np.repeat(cluster[rows], len(mask)))
                asks.append(np.ones(len(rows) * len(mask), bool))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, fps, clusters, asks)], ["key", "fp", "cluster", "ask"])

    rows = checkpointed(map_batches(prints, work, "key long, fp long, cluster long, ask boolean"))
    index = rows.where("not ask").select("key", F.col("fp").alias("b"), F.col("cluster").alias("cb"))
    probes = rows.where("ask").select("key", F.col("fp").alias("a"), F.col("cluster").alias("ca"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    return probes.join(index, (probes["key"] == index["key"]) & (F.col("ca") != F.col("cb")) & near).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def with_cluster(prints: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Add the root of each vertex as its cluster; a vertex without links is its own."""
    named = roots.select(F.col("vertex").alias(key), F.col("root").alias("cluster"))
    return checkpointed(prints.join(named, key, "left").withColumn("cluster", F.coalesce("cluster", key)))


def near_duplicates(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    tau: int = TAU, parts: int = PARTS) -> DataFrame:
    """(key, fp, component_id) per row: the least key among the rows that chains of links reach.

    Equal texts share a fingerprint and so a component.  Rows with a null key
    take part; a component of null keys only has a null id.  Repeated rows each
    get a row, an empty table gives none, other columns are ignored.
    """
    narrow = df.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = checkpointed(add_fingerprint(narrow, "fp", width).select("key", "fp"))
    return rows.join(print_groups(rows, tau, parts).select("fp", "component_id"), "fp")


def print_groups(rows: DataFrame, tau: int, parts: int) -> DataFrame:
    """(fp, component_id) as a stored table, for rows of (key, fp).

    Fingerprints one bit apart, at most 64 for each, are linked first.  Within
    the clusters that they form no further pair is needed, so a dense group
    costs few links and not its square.
    """
    prints = checkpointed(rows.groupBy("fp").agg(F.min("key").alias("least")))
    single = checkpointed(links(prints, 1, 2))
    clusters = with_cluster(prints, components(single), "fp")
    roots = components(single.union(links(clusters, tau, parts))).withColumnRenamed("vertex", "fp")
    rooted = checkpointed(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return checkpointed(rooted.join(least, "root").select("fp", "component_id"))


# One document of each group -----------------------------------------------------------------------

SHINGLE = 5
#: Texts of similarity 0.8 share one of the band keys with probability 1 - (1 - 0.8 ** BAND_ROWS) ** BANDS = 0.9998.
BANDS = 28
BAND_ROWS = 6
#: SimHash fingerprints of the distinct shingles.
TURNS = 4
#: Shingle sets of Jaccard similarity 0.8 have cosine 8/9, so a bit differs with chance acos(8/9)/pi: mean 39 bits of 256.
_TURN = float(np.arccos(8 / 9)) / float(np.pi)
#: Mean and six standard deviations; from FILTER_FROM shingles on, pairs beyond are not compared further.
LOOSE_BITS = round(64 * TURNS * _TURN + 6 * (64 * TURNS * _TURN * (1 - _TURN)) ** 0.5)
FILTER_FROM = 100
#: Bits of the parities of a shingle set, for the pairs that no round has linked.
PARITY_BITS = 1024
#: Rounds that compare each text with the nearest leader of its bands before all open pairs are compared; they end when one links nothing.
ROUNDS = 4

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 31, BANDS * BAND_ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)


def _turned(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another hash of each hash; turn 0 leaves it."""
    if not turn:
        return hashes
    out = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * turn)
    return (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the five-word shingles, sorted; none for a text without words."""
    words = (text or "").encode().lower().split()
    return np.unique(shingle_hashes(words, SHINGLE)) if words else np.array([], np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """[set, band]: a hash of BAND_ROWS min-hashes; sets must not be empty."""
    out = np.empty((len(sets), BANDS), np.uint64)
    done = 0
    while done < len(sets):
        size, stop = 0, done
        while stop < len(sets) and (stop == done or size + len(sets[stop]) <= 200_000):
            size += len(sets[stop])
            stop += 1
        some = sets[done:stop]
        values = (np.concatenate(some) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, some[:-1])])
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for i in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
                least = np.minimum.reduceat(values * _FACTORS[i] + _SHIFTS[i], starts)
                key = _turned(key ^ least.astype(np.uint64), 1)
            out[done:stop, band] = key
        done = stop
    return out


def shingle_prints(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, key, text_id, n, s, bands) of (__row, __key, text): rows of one shingle set share the text_id.

    n counts the shingles, s are TURNS fingerprints of them, bands the keys of the bands.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        sets = [shingle_set(t) for t in batch.column(names.index(text_col)).to_pylist()]
        ids = [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets]
        prints = [[int(majority(_turned(x, t)).view(np.int64)) for t in range(TURNS)] if len(x) else [0] * TURNS for x in sets]
        full = np.flatnonzero([len(x) for x in sets])
        keys = band_keys([sets[i] for i in full]).view(np.int64)
        cuts = np.cumsum([0, *(BANDS * (len(x) > 0) for x in sets)])
        return pa.RecordBatch.from_arrays(
            [batch.column(names.index("__row")), batch.column(names.index("__key")), pa.array(np.array(ids, np.uint64).view(np.int64)),
             pa.array([len(x) for x in sets], pa.int64()), pa.array(prints, pa.list_(pa.int64())),
             pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys.ravel()))],
            ["row", "key", "text_id", "n", "s", "bands"])

    many = T.ArrayType(T.LongType())
    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", docs.schema["__key"].dataType),
                         T.StructField("text_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s", many), T.StructField("bands", many)])
    return map_batches(docs, work, kind)


def add_shingles(df: DataFrame, text_col: str) -> DataFrame:
    """(text_id, shingles) of (text_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        sets = [shingle_set(t).view(np.int64) for t in batch.column(names.index(text_col)).to_pylist()]
        cuts = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(sets)))
        return pa.RecordBatch.from_arrays([batch.column(names.index("text_id")), lists], ["text_id", "shingles"])

    return map_batches(df, work, "text_id long, shingles array<long>")


def bits_apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.s")[t].bitwiseXOR(F.col(f"{b}.s")[t])) for t in range(TURNS)), F.lit(0))


def may_be_similar(a: str, b: str) -> Column:
    """Sizes that allow similarity 0.8 and fingerprints within LOOSE_BITS, of the structs ``a`` and ``b`` with n and s."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 5 >= large * 4) & ((small < FILTER_FROM) | (bits_apart(a, b) <= LOOSE_BITS))


def parities(shingles: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits as integers; a bit tells whether an odd number of shingles fall to it."""
    counts = np.bincount((shingles.view(np.uint64) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return pack_bits((counts % 2 == 1).reshape(-1, 64))


def add_parities(sets: DataFrame) -> DataFrame:
    """(text_id, odd) of (text_id, shingles)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        odd = [parities(x.values.to_numpy()).view(np.int64).tolist() for x in batch.column(names.index("shingles"))]
        return pa.RecordBatch.from_arrays([batch.column(names.index("text_id")), pa.array(odd, pa.list_(pa.int64()))], ["text_id", "odd"])

    return map_batches(sets, work, "text_id long, odd array<long>")


def parities_allow(a: str, b: str) -> Column:
    """False only for sets of similarity below 0.8, of the structs ``a`` and ``b`` with n and odd.

    A shingle that one set alone has turns one bit, so the sets differ in at
    least as many shingles as bits; at similarity 0.8 they differ in a ninth of
    their sizes' sum at most.
    """
    bits = sum((F.bit_count(F.col(f"{a}.odd")[k].bitwiseXOR(F.col(f"{b}.odd")[k])) for k in range(PARITY_BITS // 64)), F.lit(0))
    return bits * 9 <= F.col(f"{a}.n") + F.col(f"{b}.n")


def simhash_links(texts: DataFrame) -> DataFrame:
    """(a, b): each text with the least text_id that chains of fingerprints within TAU bits reach.

    ``texts`` is a stored table (text_id, s); the first fingerprint of s counts.
    """
    rows = checkpointed(texts.select(F.col("text_id").alias("key"), F.col("s")[0].alias("fp")))
    groups = print_groups(rows, TAU, PARTS)
    return checkpointed(rows.join(groups, "fp").where("key <> component_id").select(F.col("key").alias("a"), F.col("component_id").alias("b")))


def similar_texts(cells: DataFrame, sets: DataFrame, near: DataFrame) -> DataFrame:
    """(vertex, root) of the texts that links of shingle similarity >= 0.8 reach.

    ``cells`` is a stored table (text_id, n, s, band), ``sets`` one of (text_id,
    shingles), ``near`` one of pairs (a, b) to compare first.  Rounds compare each text with one leader, so a dense group costs
    few pairs.  After them every pair of a band in different clusters is compared, by
    its parities first: texts that are alike but less than 0.8 leave next to no row.
    """
    sides = [sets.select(F.col("text_id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab"]

    def verified(pairs: DataFrame) -> DataFrame:
        held = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        both = held.join(sides[0], "a").join(sides[1], "b")
        shared = F.size(F.array_intersect("of_a", "of_b"))
        return checkpointed(both.where(shared * 9 >= (F.size("of_a") + F.size("of_b")) * 4).select("a", "b"))

    def place(roots: DataFrame | None) -> DataFrame:
        """(band, x): x is the text with its cluster."""
        cluster = F.col("text_id")
        rows = cells
        if roots is not None:
            rows = cells.join(roots.withColumnRenamed("vertex", "text_id"), "text_id", "left")
            cluster = F.coalesce("root", "text_id")
        return checkpointed(rows.select("band", F.struct("text_id", "n", "s", cluster.alias("cluster")).alias("x")))

    edges = verified(near)
    roots = components(edges)
    for turn in range(ROUNDS):
        placed = place(roots)
        leads = placed.groupBy("band").agg(F.min(F.struct(F.xxhash64("x.text_id", F.lit(turn)).alias("h"), "x")).alias("lead"))
        met = placed.join(checkpointed(leads), "band").where(F.col("x.cluster") != F.col("lead.x.cluster"))
        met = met.where(may_be_similar("x", "lead.x"))
        chosen = met.groupBy("x.text_id").agg(F.min(F.struct(bits_apart("x", "lead.x").alias("bits"), "lead.h", F.col("lead.x.text_id").alias("b"))).alias("to"))
        found = verified(chosen.select(F.col("text_id").alias("a"), F.col("to.b").alias("b")))
        if found.isEmpty():
            break
        edges = checkpointed(edges.union(found))
        roots = components(edges)
    # Of two texts of different clusters, one at least is outside the cluster that has most texts of their band.
    placed = place(roots)
    sizes = placed.groupBy("band", F.col("x.cluster").alias("cluster")).agg(F.count("*").alias("texts"))
    main = checkpointed(sizes.groupBy("band").agg(F.max(F.struct("texts", "cluster"))["cluster"].alias("main"), F.count("*").alias("clusters")).where("clusters > 1"))
    open_cells = checkpointed(placed.join(main, "band"))
    open_texts = open_cells.select(F.col("x.text_id").alias("text_id")).distinct()
    odd = checkpointed(add_parities(sets.join(open_texts, "text_id", "left_semi")).withColumnRenamed("text_id", "id"))
    open_cells = checkpointed(open_cells.join(odd, F.col("x.text_id") == F.col("id")).select("band", "main", F.struct("x.*", "odd").alias("x")))
    outside = open_cells.where(F.col("x.cluster") != F.col("main")).select("band", F.col("x").alias("y"))
    apart = F.col("x.cluster") != F.col("y.cluster")
    alike = may_be_similar("x", "y") & parities_allow("x", "y")
    left = open_cells.join(outside, (open_cells["band"] == outside["band"]) & apart & alike)
    last = verified(left.select(F.col("x.text_id").alias("a"), F.col("y.text_id").alias("b")))
    return checkpointed(components(edges.union(last)))


def one_per_group(docs: DataFrame, columns: list[str], key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with only the row of least key of each group of near copies.

    Two texts are linked if their sets of five-word shingles have Jaccard
    similarity 0.8 or more, counted exactly for texts whose SimHash fingerprints
    are chained to one text within TAU bits and for texts that share a band of
    min-hashes.  Equal sets are one group, null and empty texts too; a null key
    comes last in a group.
    Rows of texts, which no size makes small, meet by a sort-merge join throughout.
    """
    rows = with_row(docs, columns)
    keyed = rows.withColumn("__key", F.col(f"`{key_col}`")).select(F.col(f"`{text_col}`"), "__row", "__key")
    printed = checkpointed(shingle_prints(keyed, text_col))
    texts = checkpointed(printed.groupBy("text_id").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.first("bands").alias("bands"), F.min("row").alias("__row")))
    every = texts.select("text_id", "n", "s", F.explode("bands").alias("band"))
    shared = checkpointed(every.groupBy("band").agg(F.count("*").alias("texts")).where("texts > 1").select("band"))
    cells = checkpointed(every.join(shared, "band"))
    near = simhash_links(texts)
    compared = cells.select("text_id").union(near.select("a")).union(near.select("b")).distinct()
    met = texts.join(compared, "text_id", "left_semi").select("text_id", "__row")
    sets = checkpointed(add_shingles(rows.select("__row", F.col(f"`{text_col}`")).join(met.hint("merge"), "__row").select("text_id", F.col(f"`{text_col}`")), text_col))
    roots = similar_texts(cells, sets, near).withColumnRenamed("vertex", "text_id")
    placed = checkpointed(printed.select("row", "key", "text_id").join(roots, "text_id", "left").withColumn("root", F.coalesce("root", "text_id")))
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "row"))
    kept = checkpointed(placed.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("__row")))
    return rows.join(kept.hint("merge"), "__row", "left_semi").select(*columns)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = near_duplicates(docs)
    return found.select(F.col("key").alias("doc_id"), hex_print(F.col("fp")).alias("fingerprint"), "component_id")
