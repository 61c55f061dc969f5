"""Operator 2, near-duplicates by HyperMinHash.

A document's distinct 5-word shingles are hashed to 64 bits. The first 7 bits choose one of 128 buckets; the
smallest of a bucket is stored as a 16-bit register: the leading zeros of the other 57 bits (6 bits) and the
10 bits after the first one (the mantissa). An empty bucket borrows the register of the filled bucket that
comes first in its own fixed permutation, so short texts have full signatures too. Registers are banded by
4; documents with an equal band are candidates. A pair's registers give its Jaccard index, corrected for
chance collisions; pairs that are estimated more than six standard deviations under the threshold go (none with a
set of fewer than ``TINY`` shingles, whose estimates scatter more), and the rest are compared on their full sets.

Two large sets at the threshold share no band with probability (1 - 0.75**4)**32 = 5e-6, less above it. Sets of fewer shingles
than buckets fill some of these only, so their registers depend on each other and the bands lose more: 1e-4 of the pairs of
4 and 3 shingles. These sets get a second signature of the hashes mixed anew, whose bands are 32 more chances.

No group is compared pair by pair as a whole:
1. Documents with one and the same set are one class (known by a 128-bit digest of the sorted set).
2. In each bucket of each band, one class is the hub; star pairs (hub, member) are compared, in chunks.
3. Links give components (large-star/small-star rounds). A bucket that lies within one component is done.
4. In each other bucket, members outside its main component are compared with all its members, in blocks of
   ``BLOCK``; only pairs of different components, and only in the first band that both share. So every
   candidate pair is either compared or known to be in one component already: no link is lost for speed.
Nothing is collected on the driver.

Edge cases: texts without words (null too) have n_shingles 0 and stand alone. Fewer than 5 words are one
shingle. Repeated rows are separate documents of one class. A null doc_id takes part; it is never the
smallest of a component that has other ids. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, maybe_among, slices

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
BUCKET_BITS, ZERO_BITS, MANTISSA_BITS, ROWS = 7, 6, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
#: Bands of both signatures, of which the second is for sets smaller than BUCKETS; sets under TINY aren't estimated.
ALL_BANDS, TINY = 2 * BANDS, 16
BLOCK, CHUNK = 512, 256
#: Two different smallest hashes have equal leading zeros with probability about 0.4 and then an equal mantissa by chance.
COLLISION = 0.4 / (1 << MANTISSA_BITS)
LEAST = NUMERATOR / DENOMINATOR - 6 * (NUMERATOR / DENOMINATOR * (1 - NUMERATOR / DENOMINATOR) / BUCKETS) ** 0.5
_BORROW = np.argsort(np.argsort(np.random.default_rng(97).random((BUCKETS, BUCKETS)), axis=1), axis=1).astype(np.uint8)
_EDGES = (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    """Words and their 64-bit hashes, as far as seen; emptied when it grows large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_WORDS = _Words()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            x = w[k : len(w) - n + 1 + k] * _ODD[k]
            h = (h ^ x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def registers(h: np.ndarray) -> np.ndarray:
    """The 128 registers of a sorted, non-empty set."""
    at = np.searchsorted(h, _EDGES)
    filled = np.append(at[1:], len(h)) > at
    rest = h[np.minimum(at, len(h) - 1)] << np.uint64(BUCKET_BITS)
    # the leading zeros from the exponent of a float; the top 53 bits suffice
    _, exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, (1 << ZERO_BITS) - 1)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
    if not filled.all():
        own = np.flatnonzero(filled)
        empty = np.flatnonzero(~filled)
        out[empty] = out[own[_BORROW[np.ix_(empty, own)].argmin(1)]]
    return out


def second(h: np.ndarray) -> np.ndarray:
    """The registers of a set's hashes mixed anew."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB)
    return registers(np.sort(x ^ (x >> np.uint64(32))))


def estimate(equal: np.ndarray) -> np.ndarray:
    """The Jaccard index from the number of equal registers, corrected for collisions."""
    return (equal / BUCKETS - COLLISION) / (1 - COLLISION)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (128-bit digest of the set, null if empty), sig (registers) and more (those of a small set mixed anew) of each row of docs."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, fp, sig, more = [], [], [], []
            for t in b.column(1).to_pylist():
                h = shingles(t)
                n.append(len(h))
                fp.append(_digest(h) if len(h) else None)
                sig.append(registers(h).tobytes() if len(h) else None)
                more.append(second(h).tobytes() if 0 < len(h) < BUCKETS else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (fp, sig, more))], ["doc_id", "n_shingles", "fp", "sig", "more"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type}, n_shingles long, fp binary, sig binary, more binary")


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of rows with an equal ``key`` of a stream that is sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(key)[0].as_py() != k[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def _links(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Which of the pairs (rows of two indexes) are links, by the full sets."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros(len(pairs), bool)
    maybe = np.flatnonzero(DENOMINATOR * np.minimum(*sizes[pairs.T]) >= NUMERATOR * np.maximum(*sizes[pairs.T]))
    if len(maybe) <= 4 * len(sets):
        for i in maybe:
            out[i] = _linked(sets[pairs[i, 0]], sets[pairs[i, 1]])
        return out
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        common += m @ m.T
    c = common[pairs[maybe, 0], pairs[maybe, 1]].astype(np.int64)
    out[maybe] = DENOMINATOR * c >= NUMERATOR * (sizes[pairs[maybe, 0]] + sizes[pairs[maybe, 1]] - c)
    return out


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links: no more than n - 1 of them say what all say."""
    up, out = list(range(n)), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[x] = y
            out.append((a, b))
    return out


def _verified(tasks: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The links (a, b: digests) among the pairs of ``tasks`` (task, members: array of digests, pairs: bytes of index pairs).

    Each task gets its members' whole texts; their sets are made anew and compared.
    """
    member = tasks.select("task", "pairs", F.posexplode("members").alias("nth", "fp"))
    member = member.withColumn("pairs", F.when(F.col("nth") == 0, F.col("pairs")))
    wanted = checkpoint(member.join(classes.select("fp", "rep"), "fp"))
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    text = maybe_among(text, "doc_id", wanted.select("rep").distinct()).filter("maybe").drop("maybe")  # other texts aren't moved
    # a doc_id that is there twice brings a text with another digest too; it is left out below
    rows = wanted.join(text, wanted["rep"].eqNullSafe(text["doc_id"])).select("task", "nth", "fp", "pairs", "text")
    rows = rows.repartition("task").sortWithinPartitions("task", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, "task"):
            sets, names, pairs = {}, {}, b""
            for nth, fp, p, t in zip(*(g.column(c).to_pylist() for c in ("nth", "fp", "pairs", "text")), strict=True):
                pairs = p or pairs
                if nth not in sets:
                    h = shingles(t)
                    if _digest(h) == fp:
                        sets[nth], names[nth] = h, fp
            n = max(names, default=-1) + 1
            each = np.frombuffer(pairs, np.uint16).reshape(-1, 2).astype(np.int64)
            each = each[_links([sets.get(i, np.zeros(0, np.uint64)) for i in range(n)], each)] if n else each[:0]
            if found := _forest(n, each):
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in found], pa.binary()), pa.array([names[j] for _, j in found], pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (a, b); root is the smallest node of the component. Large-star/small-star rounds."""
    low = lambda df: df.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = checkpoint(low(edges)), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        down = low(large)
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = checkpoint(low(small))
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """The estimate for each row of two columns of signatures."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, BUCKETS) for s in (a, b))
    return pd.Series(estimate((x == y).sum(1)))


def _stars(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Tasks of star pairs: each hub with up to CHUNK members of its buckets that may be linked to it."""
    pairs = buckets.filter("handle != hub").groupBy("hub", "handle").agg(F.max("n").alias("n"))
    own = classes.select("handle", "fp", "sig", F.col("n_shingles").alias("size"))
    other = own.select(F.col("handle").alias("hub"), F.col("fp").alias("hub_fp"), F.col("sig").alias("hub_sig"), F.col("size").alias("hub_size"))
    near = pairs.join(own, "handle").join(other, "hub")
    near = near.filter(DENOMINATOR * F.least("size", "hub_size") >= NUMERATOR * F.greatest("size", "hub_size")).filter((F.least("size", "hub_size") < TINY) | (F.pandas_udf(_jaccard, "double")("sig", "hub_sig") >= LEAST))
    chunk = F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)))
    grouped = near.groupBy("hub_fp", chunk.alias("chunk")).agg(F.sort_array(F.collect_set("fp")).alias("members"))  # about CHUNK of them

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for hub, chunk, members in zip(*(b.column(c).to_pylist() for c in ("hub_fp", "chunk", "members")), strict=True):
                for lo in range(0, len(members), 2 * CHUNK):
                    part = members[lo : lo + 2 * CHUNK]
                    pairs = np.stack([np.zeros(len(part), np.uint16), np.arange(1, len(part) + 1, dtype=np.uint16)], 1)
                    out.append((f"{hub.hex()}:{chunk}:{lo}", [hub, *part], pairs.tobytes()))
            yield _tasks(out)

    return grouped.mapInArrow(packed, "task string, members array<binary>, pairs binary")


def _tasks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"task": t, "members": m, "pairs": p} for t, m, p in rows], schema=pa.schema([("task", pa.string()), ("members", pa.list_(pa.binary())), ("pairs", pa.binary())]))


def _blocks(buckets: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Tasks of the pairs of different components in buckets that reach beyond one component."""
    root = classes.select("handle", "fp").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("handle", F.coalesce("root", "fp").alias("root"))
    rows = buckets.select("key", "handle").join(root, "handle")
    by_root = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("roots")).filter("roots > 1 and all > 2")
    open_ = open_.select("key", F.col("main.root").alias("main"), F.ceil(F.col("all") / BLOCK).alias("a_blocks"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("b_blocks"))
    rows = rows.join(open_, "key").join(classes.select("handle", "fp", "sig", "n_shingles"), "handle")
    place = F.abs(F.xxhash64("fp") % F.lit(1 << 40))
    whole = rows.withColumns({"a": place % F.col("a_blocks"), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_blocks") - 1)), "side": F.lit(0)})
    other = rows.filter("root != main").withColumns({"b": place % F.col("b_blocks"), "a": F.explode(F.sequence(F.lit(0).cast("long"), F.col("a_blocks") - 1)), "side": F.lit(1)})
    columns = [F.concat_ws(":", "key", "a", "b").alias("task"), "side", (F.col("root") != F.col("main")).alias("outside"), "key", "fp", "root", "sig", "n_shingles"]
    both = whole.select(*columns).unionByName(other.select(*columns)).repartition("task").sortWithinPartitions("task", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, "task"):
            side, size = g.column("side").to_numpy(), g.column("n_shingles").to_numpy()
            fps, roots_ = np.array(g.column("fp").to_pylist(), object), np.array(g.column("root").to_pylist(), object)
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            band = g.column("key")[0].as_py() % ALL_BANDS
            outside = g.column("outside").to_numpy(zero_copy_only=False)
            number = {r: i for i, r in enumerate(dict.fromkeys(roots_))}
            kind = np.array([number[r] for r in roots_])
            pairs = []
            for y in right:
                x = left[(kind[left] != kind[y]) & (DENOMINATOR * np.minimum(size[left], size[y]) >= NUMERATOR * np.maximum(size[left], size[y]))]
                if not len(x):
                    continue
                same = sig[x] == sig[y]
                bands = same.reshape(len(x), BANDS, ROWS).all(2)
                # in the first band that both share, or in those of the second signature if there is none; two outsiders
                # meet twice, on either side, and are taken once
                first = (bands.argmax(1) == band) & bands.any(1) if band < BANDS else ~bands.any(1)
                ok = first & ((estimate(same.sum(1)) >= LEAST) | (np.minimum(size[x], size[y]) < TINY))
                ok &= ~outside[x] | (fps[x] < fps[y]).astype(bool)
                pairs += [(i, y) for i in x[ok]]
            if pairs:
                each = np.array(pairs)
                used = np.unique(each)
                yield _tasks([(g.column("task")[0].as_py(), fps[used].tolist(), np.searchsorted(used, each).astype(np.uint16).tobytes())])

    return both.mapInArrow(run, "task string, members array<binary>, pairs binary")


def near_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    signed = checkpoint(signatures(docs))
    full = signed.filter("fp is not null")
    classes = full.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("more").alias("more"))
    # A handle stands for a class while candidates are sought: two classes with one handle would only be two candidates.
    classes = checkpoint(classes.withColumn("handle", F.xxhash64("fp")))
    part = lambda b: F.substring("sig" if b < BANDS else "more", 2 * ROWS * (b % BANDS) + 1, 2 * ROWS)
    key = lambda b: F.shiftleft(F.xxhash64(F.lit(b), part(b)), ALL_BANDS.bit_length() - 1).bitwiseOR(F.lit(b).cast("long"))
    small = F.when(F.col("more").isNotNull(), F.array(*map(key, range(BANDS, ALL_BANDS)))).otherwise(F.array().cast("array<bigint>"))
    bands = classes.select("handle", F.explode(F.concat(F.array(*map(key, range(BANDS))), small)).alias("key"))
    order = F.col("handle").bitwiseXOR(F.col("key"))  # another hub in each bucket
    hubs = bands.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("first").bitwiseXOR(F.col("key")).alias("hub"), "n")
    buckets = checkpoint(bands.join(hubs, "key"))
    links = checkpoint(_verified(_stars(buckets, classes), classes, docs))
    roots = components(links)
    more = checkpoint(_verified(_blocks(buckets, classes, roots), classes, docs))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = named.join(smallest, "root").select("fp", "component_id")
    out = full.select("doc_id", "n_shingles", "fp").join(of, "fp").drop("fp")
    alone = signed.filter("fp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component those with its smallest doc_id."""
    verdict = checkpoint(near_components(docs).groupBy(F.col("doc_id").alias("__near_id")).agg(F.max("kept").alias("kept")))
    gone = verdict.filter("not kept").select("__near_id")
    # only rows that may have to go are moved to be compared
    marked = maybe_among(docs.withColumnRenamed("maybe", "__near_maybe"), "doc_id", gone)
    doubtful = marked.filter("maybe")
    stay = doubtful.join(gone, doubtful["doc_id"].eqNullSafe(gone["__near_id"]), "left_anti")
    return marked.filter("not maybe").unionByName(stay).drop("maybe").withColumnRenamed("__near_maybe", "maybe")
