"""Near-duplicate detection with b-bit MinHash, confirmed on full shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes), HASHES minima of it, the low BITS bits of each
   minimum packed into a signature, and band keys of the full minima. Texts with equal sets are one class from here on.
2. Band buckets of two classes or more give candidates. In each bucket all classes are compared with one: the
   one that shares the fullest buckets overall, which in a group of edited copies is the copy nearest to all.
   Signatures are compared by counting bits; the estimate is corrected for the chance agreement of low bits.
   Candidates within MARGIN of the threshold are confirmed by intersecting the full sets.
3. Links join classes into components (smallest label, with pointer jumping).
4. Buckets that still hold more than one component are searched in full: within a bucket every pair of classes of
   different components is compared by signature, and the likely ones by their full sets, on the spot; only links
   that join two components leave the bucket. A pair that shares several bands is looked at in the first. Buckets over
   BUCKET rows or ITEMS shingles are first refined by a second band key; those still larger are dealt out in pairs of blocks.

Band keys: the most rows a band with which a pair at the threshold shares fewer than two bands less often than MISS. Two, as the
pairs of a large bucket are looked for by a second band: what that leaves unfound is within MISS as well.

Rows: null and empty texts and texts without a word have an empty set and no links; texts shorter than a shingle
have one shingle, all their words; rows that share a doc_id are told apart by their texts; doc_id is a whole number, a null one
(and the least long, which stands for it) counts as the smallest; repeated rows get a result each; other columns are left out,
whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, reclaim, small_batches
from lodestone.operators.components import components

HASHES, BITS, MISS = 128, 4, 2e-6
#: Five standard deviations of the estimate.
MARGIN = 0.17
#: Rows, and shingles, that one task may hold of a bucket.
BUCKET, ITEMS = 2048, 1 << 21
_WORDS = HASHES * BITS // 64
_NONE = -(1 << 63)

_rng = np.random.default_rng(20_24)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) | 1
_A = _rng.integers(0, 1 << 63, HASHES, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, np.uint64)
_C = _rng.integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def rows_per_band(threshold: float) -> int:
    """Minima in a band key."""

    def missed(r: int) -> float:
        """The chance that a pair at the threshold shares no band or only one."""
        p, n = threshold**r, HASHES // r
        return (1 - p) ** n + n * p * (1 - p) ** (n - 1)

    return max(r for r in range(1, 17) if r == 1 or missed(r) <= MISS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of _BASE and of its inverse, n of them at least."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z in lower case, and where each text's words start (one more than texts)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    power, inverse = _power_tables(len(raw) + 1)
    gap = _GAP[raw]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOW[raw] * power[: len(raw)], out=sums[1:])
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[::2], edge[1::2]
    word = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _C[60])
    return word, np.searchsorted(start, np.concatenate([[0], ends]))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, all texts at once."""
    word, at = word_hashes(texts)
    n = max(0, len(word) - width + 1)
    shingle = np.zeros(n, np.uint64)
    for j in range(width if n else 0):
        shingle += word[j : j + n] * _C[j]
    shingle = _mix(shingle)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            out.append(np.unique(shingle[a : b - width + 1]))
        elif b > a:
            out.append(_mix((word[a:b] * _C[: b - a]).sum(keepdims=True, dtype=np.uint64) + _C[61 + (b - a) % 2] * np.uint64(b - a)))
        else:
            out.append(shingle[:0])
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set (none of them empty), a row a set."""
    out = np.empty((len(sets), HASHES), np.uint64)
    k = 0
    while k < len(sets):
        e, n = k, 0
        while e < len(sets) and (e == k or n + len(sets[e]) <= 16_384):
            n += len(sets[e])
            e += 1
        u = np.concatenate(sets[k:e])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[k : e - 1]], dtype=np.int64)])
        for j in range(HASHES):
            out[k:e, j] = np.minimum.reduceat((u ^ _B[j]) * _A[j], starts)
        k = e
    return out


def signatures(m: np.ndarray) -> np.ndarray:
    """BITS low bits (above the weakest) of each minimum, packed: a row of 64-bit words a set."""
    low = (m >> np.uint64(20)) & np.uint64((1 << BITS) - 1)
    lanes = low.reshape(len(m), _WORDS, 64 // BITS)
    return (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)


def band_keys(m: np.ndarray, rows: int) -> np.ndarray:
    n = HASHES // rows
    parts = m[:, : n * rows].reshape(len(m), n, rows)
    return _mix((parts * _C[:rows]).sum(2, dtype=np.uint64) + _C[62] * (np.arange(n, dtype=np.uint64) + np.uint64(1)))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _groups(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    k = 0
    while k < len(texts):
        e, n = k, 0
        while e < len(texts) and (e == k or n + len(texts[e]) < most):
            n += len(texts[e])
            e += 1
        yield k, e
        k = e


def sketches(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """d (doc_id, null as the smallest), t (hash of the text), n (shingles), k (digest of the set), s (signature words), keys (bands)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _utf8(b.column(2))
            for x, y in _groups(texts):
                sets = shingle_sets(texts[x:y], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                m = minima([sets[i] for i in full]) if full else np.zeros((0, HASHES), np.uint64)
                sig, keys = iter(signatures(m).view(np.int64).tolist()), iter(band_keys(m, rows).view(np.int64).tolist())
                has = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if h else None for s, h in zip(sets, has)], pa.binary()), pa.array([next(sig) if h else None for h in has], pa.list_(pa.int64())), pa.array([next(keys) if h else None for h in has], pa.list_(pa.int64()))],
                    ["d", "t", "n", "k", "s", "keys"],
                )

    return _named(docs).mapInArrow(run, "d long, t long, n long, k binary, s array<long>, keys array<long>")


def _named(docs: DataFrame) -> DataFrame:
    """d, t, text: what a document is known by, its id (null as the smallest) and a hash of its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("d"), F.xxhash64("text").alias("t"), "text")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two signatures, corrected for chance agreement."""
    different = F.lit(0)
    for i in range(_WORDS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in (1, 2)[: BITS // 2]:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        different = different + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    return ((1 - different / HASHES) - chance) / (1 - chance)


def _items(need: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """v, items: the full sets of the nodes in need (v)."""
    small_batches(docs.sparkSession)
    named = need.join(nodes.select("v", "d", "t"), "v")
    texts = _named(docs).join(named, ["d", "t"]).dropDuplicates(["d", "t"]).select("v", "text")  # rows that repeat both are equal

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = _utf8(b.column(1))
            for x, y in _groups(raw):
                got = pa.array([s.tobytes() for s in shingle_sets(raw[x:y], width)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), got], ["v", "items"])

    return cut(texts.mapInArrow(sets, "v binary, items binary"))


def _confirm(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose full sets are similar enough."""
    both = pairs.join(items.select(F.col("v").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("v").alias("b"), F.col("items").alias("y")), "b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.select("a", "b", "x", "y").mapInArrow(similar, "a binary, b binary"))


def _search(rows: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) between roots of different components in groups g, enough to join all that are linked.

    rows: g, side (0: both sides, 1 and 2: only against each other), band, band2 (-1: none), v, root, n, s, keys, items.
    """

    def group(t: pa.Table) -> pa.Table:
        matrix = lambda c: t.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)
        sig, keys, items = matrix("s"), matrix("keys"), t.column("items").to_pylist()
        n, side = t.column("n").to_numpy(), t.column("side").to_numpy()
        band, band2 = t.column("band")[0].as_py(), t.column("band2")[0].as_py()
        names, root = np.unique(np.array([x.hex() for x in t.column("root").to_pylist()]), return_inverse=True)
        whole = side.max() == 0
        left = np.flatnonzero(root != np.bincount(root).argmax()) if whole else np.flatnonzero(side == 1)
        right = np.arange(len(n)) if whole else np.flatnonzero(side == 2)
        ones, links = np.uint64(0x1111111111111111), []
        for i in left:  # those outside the largest component, against all: each pair has such a side
            other = right[(root[right] != root[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            x = sig[other] ^ sig[i]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            agree = 1 - np.bitwise_count(x & ones).sum(1) / HASHES
            other = other[(agree - 2.0**-BITS) / (1 - 2.0**-BITS) >= least]
            same = keys[other] == keys[i]
            first = same.argmax(1) == band
            if band2 >= 0:
                same[:, band] = False
                first &= same.argmax(1) == band2
            mine = np.frombuffer(items[i], np.uint64)
            for j in other[first]:
                if root[i] != root[j]:
                    shared = len(np.intersect1d(mine, np.frombuffer(items[j], np.uint64), assume_unique=True))
                    if 100 * shared >= percent * (n[i] + n[j] - shared):
                        a, b = sorted((root[i], root[j]))
                        links.append((a, b))
                        root[root == b] = a
        return pa.table({"a": pa.array([bytes.fromhex(names[a]) for a, _ in links], pa.binary()), "b": pa.array([bytes.fromhex(names[b]) for _, b in links], pa.binary())})

    return rows.groupBy("g").applyInArrow(group, "a binary, b binary").distinct()


def _grouped(rest: DataFrame, nodes: DataFrame) -> DataFrame:
    """g, side, band, band2, v, root of the buckets (h, band, v, root) with several components; at most about 2 * BUCKET rows a g."""
    load = F.ceil(F.greatest(F.count("*") / BUCKET, F.sum("n") / ITEMS)).cast("int").alias("m")  # tasks' worth of rows
    mixed = lambda df, *key: df.groupBy(*key).agg(load, F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").drop("r0", "r1")
    buckets = cut(rest.join(mixed(rest, "h"), "h"))
    none = F.lit(-1).alias("band2")
    small = buckets.where("m = 1").select(F.xxhash64("h").alias("g"), F.lit(0).alias("side"), "band", none, "v", "root")
    large = buckets.where("m > 1").select("h", "band", "v", "n", "root")
    if large.isEmpty():
        return small
    finer = large.join(nodes.select("v", F.posexplode("keys").alias("band2", "h2")), "v").where("h != h2")
    finer = cut(finer.join(mixed(finer, "h", "h2"), ["h", "h2"]).where("band < band2"))
    fine = finer.where("m = 1").select(F.xxhash64("h", "h2").alias("g"), F.lit(0).alias("side"), "band", "band2", "v", "root")
    huge = finer.where("m > 1").withColumnRenamed("m", "blocks")
    huge = huge.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    blocks = huge.select(F.xxhash64("h", "h2", low, high).alias("g"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "band", "band2", "v", "root")
    return small.unionByName(fine).unionByName(blocks)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (it is its own), text_hash (xxhash64
    of the text) and leader: of the texts of a component exactly one is, and with it all rows that repeat it and its id.

    Documents are linked when their sets share percent of the shingles of both together.
    """
    rows = rows_per_band(percent / 100)
    least = percent / 100 - MARGIN
    docs = docs.select("doc_id", "text")
    found = cut(sketches(docs, width, rows))
    sets = found.where("n > 0").groupBy("k").agg(F.min(F.struct("d", "t")).alias("m"), F.first("n").alias("n"), F.first("s").alias("s"), F.first("keys").alias("keys")).select("k", "m.d", "m.t", "n", "s", "keys")
    # a node's name starts with its doc_id, so that the smallest name has the smallest doc_id
    name = F.unhex(F.concat(F.lpad(F.hex(F.col("d").bitwiseXOR(F.lit(_NONE))), 16, "0"), F.hex("k")))
    nodes = cut(sets.withColumn("v", name))

    rows_ = nodes.select("v", "n", F.posexplode("keys").alias("band", "h"))
    shared = rows_.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    buckets = cut(rows_.join(shared, "h"))
    reclaim(docs.sparkSession)
    central = buckets.groupBy("v").agg(F.sum(F.log2("m")).alias("weight"))
    ranked = buckets.join(central, "v")
    leaders = ranked.groupBy("h").agg(F.max_by("v", F.struct("weight", "v")).alias("a"))
    pairs = buckets.select("h", "v").join(leaders, "h").where("a != v").select(F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("v").alias(x), F.col("n").alias("n" + x), F.col("s").alias("s" + x))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(likeness(F.col("sa"), F.col("sb")) >= least)
    # one pass over the texts for both searches: of the nodes that share a band with another
    items = _items(buckets.select("v").distinct(), nodes, docs, width)
    reclaim(docs.sparkSession)
    links = _confirm(pairs.select("a", "b"), items, percent)
    roots = components(links).toDF("v", "root")

    rest = buckets.where("m > 2").select("h", "band", "v", "n").join(roots, "v", "left")  # buckets of two are done
    groups = cut(_grouped(rest.withColumn("root", F.coalesce("root", "v")), nodes))
    further = _search(groups.join(nodes.select("v", "n", "s", "keys"), "v").join(items, "v"), least, percent)
    again = components(cut(further)).toDF("root", "end")
    reclaim(docs.sparkSession)
    roots = roots.join(again, "root", "full_outer")  # a class without links is its own root
    roots = roots.select(F.coalesce("v", "root").alias("v"), F.coalesce("end", "root").alias("root"))

    named = nodes.join(roots, "v", "left").select("k", F.col("d").alias("d0"), F.col("t").alias("t0"), F.coalesce(F.col("v") == F.col("root"), F.lit(True)).alias("first"), F.coalesce("root", "v").alias("root"))
    smallest = F.conv(F.hex(F.substring("root", 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_NONE))
    leads = F.coalesce(F.col("first") & (F.col("d") == F.col("d0")) & (F.col("t") == F.col("t0")), F.lit(True))
    out = found.select("d", "t", "n", "k").join(named, "k", "left").select("d", "t", "n", F.coalesce(smallest, "d").alias("c"), leads.alias("leader"))
    true_id = lambda x: F.when(F.col(x) != _NONE, F.col(x))
    return out.select(true_id("d").alias("doc_id"), F.col("n").alias("n_shingles"), true_id("c").alias("component_id"), (F.col("d") == F.col("c")).alias("kept"), F.col("t").alias("text_hash"), "leader")
