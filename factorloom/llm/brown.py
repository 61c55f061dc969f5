"""Operator 7, language-model scores of a class-based bigram model whose classes come from exchange clustering.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). Words start in classes by frequency (the most frequent
have one each) or hash; in each round every word moves to the class that gives the training tokens the
highest likelihood, as far as first derivatives tell, given all words' classes of the round before. All
training tokens and all words take part.

How it runs: documents are packed into chunks of about ``CHUNK`` tokens: the hashes of the chunk's
distinct words, sorted, and the tokens as numbers of these. Chunks are written once, as a table bucketed by
their id, and never moved again.
The vocabulary is dealt into buckets by the first bits of the words' hashes (so each chunk's words of a bucket are
one slice), enough of them that each is small. A chunk asks the buckets for its words' counts and classes, and
sends them the contexts of its words, all in packed arrays; no table of the vocabulary is ever in one place. Frequent words are asked for by
every chunk, so each bucket is dealt again by salts of the chunks, at most about ``SALTED`` chunks each: what chunks
send is combined for each bucket and salt first, then by bucket, and answers go back the same way.
Only the class-to-class counts (``CLASSES`` squared) are gathered on the driver.

A round is kept only if the likelihood of the training tokens rises (``likelihood``, from the class-to-class counts). All
words move at once; after a round that didn't help, only every other word may move, in turns.

Words are told apart by 64-bit hashes. The model's events are the known words, the end, and "unknown", like the base's: P(unknown | class)
is the share of training tokens that are words seen once (Good-Turing); all else is scaled by the rest.

Edge cases: a null text counts as empty: one token, the end. Held-out rows take no part in training. A null
doc_id counts as the text "" in the fold rule. Repeated rows count as often as they occur. An empty table
gives no rows; with no training rows all tokens are unknown, N = V = 0, and base_score follows its formula. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fold, shared_dir, slices

CHUNK, CLASSES, ROUNDS, BUCKET, SALTED = 1_000_000, 64, 3, 100_000, 20_000
END, END_CLASS, PULL = 1, 0, 4.0
_U8, _I32, _I64, _U64 = np.uint8, np.int32, np.int64, np.uint64


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


class _Numbers(dict):
    """Words and their numbers in order of appearance."""

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk, n_words, words (sorted 64-bit hashes), doc_ids, train, lengths and tokens (numbers of words) of packed documents."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, id_arrow = TaskContext.get().partitionId(), 0, None

        def packed() -> pa.RecordBatch:
            words = np.fromiter((END if w is None else xxhash.xxh3_64_intdigest(w) for w in seen), _U64, len(seen))
            order = np.argsort(words)
            rank = np.empty(len(order), _I32)
            rank[order] = np.arange(len(order), dtype=_I32)
            # two words with one hash share a number
            same = np.flatnonzero(np.append(True, words[order][1:] != words[order][:-1]))
            rank = (np.searchsorted(same, rank, "right") - 1).astype(_I32)
            row = [pa.array([f"{task}-{n}"]), pa.array([len(same)], pa.int64()), pa.array([words[order][same].tobytes()], pa.binary()), pa.array([ids], pa.list_(id_arrow)), pa.array([train], pa.list_(pa.bool_())), pa.array([_pack(np.array([len(t) for t in tokens], _I32))], pa.binary()), pa.array([_pack(rank[np.concatenate(tokens)])], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["chunk", "n_words", "words", "doc_ids", "train", "lengths", "tokens"])

        seen, ids, train, tokens, total = _Numbers({None: 0}), [], [], [], 0
        for b in slices(batches):
            id_arrow = b.schema.field(0).type
            for i, kept, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = (t or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
                w.append(None)
                ids.append(i)
                train.append(kept)
                tokens.append(np.fromiter(map(seen.__getitem__, w), _I32, len(w)))
                total += len(w)
                if total >= size:
                    yield packed()
                    seen, ids, train, tokens, total, n = _Numbers({None: 0}), [], [], [], 0, n + 1
        if ids:
            yield packed()

    rows = docs.select("doc_id", (fold("doc_id") != 1).alias("train"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"chunk string, n_words long, words binary, doc_ids array<{id_type}>, train array<boolean>, lengths binary, tokens binary")


def _stored(df: DataFrame, parts: int, name: str) -> DataFrame:
    """df as the table ``name`` in the shared folder, bucketed by chunk: joins by chunk then move the other side only."""
    df.write.bucketBy(parts, "chunk").option("path", f"{shared_dir(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def _slices(words: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's words begin, and the end."""
    return np.append(np.searchsorted(words, np.arange(1 << bits, dtype=_U64) << _U64(64 - bits)), len(words))


def _training(lengths: np.ndarray, tokens: np.ndarray, train: list) -> np.ndarray:
    return tokens[np.repeat(np.array(train, bool), lengths)]


def _salt(chunk: str, salts: int) -> int:
    return zlib.crc32(chunk.encode()) % salts


def _requests(packed: DataFrame, bits: int, salts: int) -> DataFrame:
    """bucket, salt, chunk, words, counts (of training tokens) of each chunk's slice in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, w, train, lengths, tokens in zip(*(b.column(c).to_pylist() for c in ("chunk", "words", "train", "lengths", "tokens")), strict=True):
                words = np.frombuffer(w, _U64)
                counts = np.bincount(_training(_unpack(lengths, _I32), _unpack(tokens, _I32), train), minlength=len(words)).astype(_I64)
                at = _slices(words, bits)
                some = np.flatnonzero(at[1:] > at[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([_salt(chunk, salts)] * len(some), pa.int64()), pa.array([chunk] * len(some)), pa.array([words[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()), pa.array([_pack(counts[at[k] : at[k + 1]]) for k in some], pa.binary())], ["bucket", "salt", "chunk", "words", "counts"])

    return packed.select("chunk", "words", "train", "lengths", "tokens").mapInArrow(run, "bucket long, salt long, chunk string, words binary, counts binary")


def _by(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[list[dict]]:
    """The rows of each key of a stream that is sorted by it."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and any(held[0][k] != r[k] for k in key):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _merged(rows: list[dict], counts: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All words of the rows, their counts, and where each row's words are among them."""
    every, place = np.unique(np.concatenate([np.frombuffer(r["words"], _U64) for r in rows]), return_inverse=True)
    total = np.zeros(len(every), _I64)
    np.add.at(total, place, np.concatenate([_unpack(r[counts], _I64) for r in rows]))
    return every, total, np.split(place.astype(_I32), np.cumsum([len(r["words"]) // 8 for r in rows])[:-1])


_TABLE = "bucket long, salt long, chunk string, words binary, data binary"


def _table(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["bucket", "salt", "chunk", "words", "data"])


def _partial(requests: DataFrame) -> DataFrame:
    """For each bucket and salt a row with chunk null: words, counts; for each chunk in it a row with the places of its words among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, "bucket", "salt"):
            every, counts, places = _merged(rows, "counts")
            key = rows[0]["bucket"], rows[0]["salt"]
            yield _table([(*key, None, every.tobytes(), _pack(counts))] + [(*key, r["chunk"], None, _pack(x)) for r, x in zip(rows, places, strict=True)])

    return requests.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "chunk").mapInArrow(run, _TABLE)


def _vocabulary(parts: DataFrame) -> DataFrame:
    """For each bucket a row with salt null: words, counts; for each salt in it a row with the places of its words among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, "bucket"):
            every, counts, places = _merged(rows, "data")
            yield _table([(rows[0]["bucket"], None, None, every.tobytes(), _pack(counts))] + [(r["bucket"], r["salt"], None, None, _pack(x)) for r, x in zip(rows, places, strict=True)])

    return parts.repartition("bucket").sortWithinPartitions("bucket", "salt").mapInArrow(run, _TABLE)


def _statistics(owners: DataFrame) -> dict:
    """N, V, words seen once, and the most frequent words' (count, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, d in zip(b.column("words").to_pylist(), b.column("data").to_pylist(), strict=True):
                words, counts = np.frombuffer(w, _U64), _unpack(d, _I64)
                top = np.lexsort((words, -counts))[: CLASSES // 2]
                yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())]), pa.array([int((counts > 0).sum())]), pa.array([int((counts == 1).sum())]), pa.array([words[top].astype(_I64).tolist()], pa.list_(pa.int64())), pa.array([counts[top].tolist()], pa.list_(pa.int64()))], ["n", "v", "once", "words", "counts"])

    found = owners.select("words", "data").mapInArrow(run, "n long, v long, once long, words array<long>, counts array<long>")
    each = checkpoint(found)
    n, v, once = each.agg(F.sum("n"), F.sum("v"), F.sum("once")).first()
    top = each.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts").filter((F.col("counts") > 0) & (F.col("words") != END)).orderBy(F.desc("counts"), "words").limit(CLASSES // 2 - 1).collect()
    return {"n": n or 0, "v": v or 0, "once": once or 0, "top": [int(r["words"]) & (2**64 - 1) for r in top]}


def _first_classes(owners: DataFrame, top: list[int]) -> DataFrame:
    """bucket and classes (a byte a word): the end, the most frequent words, and half of the classes by hash."""
    half = CLASSES // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w in b.column("words").to_pylist():
                words = np.frombuffer(w, _U64)
                c = (half + (words >> _U64(7)) % _U64(CLASSES - half)).astype(_U8)
                for k, h in enumerate([END, *top]):
                    i = np.searchsorted(words, _U64(h))
                    if i < len(words) and words[i] == h:
                        c[i] = k
                out.append(c.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("bucket"), pa.array(out, pa.binary())], ["bucket", "classes"])

    return owners.select("bucket", "words").mapInArrow(run, "bucket long, classes binary")


def _taken(rows: DataFrame, columns: list[str]) -> DataFrame:
    """columns, classes and counts of rows (data, classes, counts): those at the places ``data``."""
    schema = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [_unpack(d, _I32) for d in b.column("data").to_pylist()]
            cls = [np.frombuffer(c, _U8)[i].tobytes() for c, i in zip(b.column("classes").to_pylist(), at, strict=True)]
            counts = [c and _pack(_unpack(c, _I64)[i]) for c, i in zip(b.column("counts").to_pylist(), at, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(cls, pa.binary()), pa.array(counts, pa.binary())], [*columns, "classes", "counts"])

    return rows.select(*columns, "data", "classes", "counts").mapInArrow(run, ", ".join([*(f"{c} {schema[c]}" for c in columns), "classes binary", "counts binary"]))


def _answers(places: DataFrame, ties: DataFrame, owners: DataFrame, classes: DataFrame, with_counts: bool) -> DataFrame:
    """chunk and parts: (bucket, classes, counts) of its words, as the buckets know them. A count of 0 has class CLASSES."""

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = [np.where(_unpack(n, _I64) > 0, np.frombuffer(c, _U8), CLASSES).astype(_U8).tobytes() for n, c in zip(b.column("counts").to_pylist(), b.column("classes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("bucket"), pa.array(cls, pa.binary()), b.column("counts") if with_counts else pa.array([None] * b.num_rows, pa.binary())], ["bucket", "classes", "counts"])

    known = owners.select("bucket", F.col("data").alias("counts")).join(classes, "bucket").select("bucket", "classes", "counts").mapInArrow(unseen, "bucket long, classes binary, counts binary")
    salted = _taken(ties.join(known, "bucket"), ["bucket", "salt"])
    found = _taken(places.join(salted.hint("shuffle_hash"), ["bucket", "salt"]), ["chunk", "bucket"])
    return found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "classes", "counts"))).alias("parts"))  # one for each bucket at most


def _classes_of(parts: list) -> np.ndarray:
    return np.frombuffer(b"".join(p["classes"] for p in parts), _U8)


def _pairs(packed: DataFrame, answers: DataFrame) -> np.ndarray:
    """How often each class follows each class in the training tokens."""
    k = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, _I64)
        for b in batches:
            for train, lengths, tokens, parts in zip(*(b.column(c).to_pylist() for c in ("train", "lengths", "tokens", "parts")), strict=True):
                c = _classes_of(parts)[_training(_unpack(lengths, _I32), _unpack(tokens, _I32), train)].astype(_I64)
                if len(c):
                    total += np.bincount(np.append(END_CLASS, c[:-1]) * k + c, minlength=k * k)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["cell", "n"])

    cells = packed.select("chunk", "train", "lengths", "tokens").join(answers.hint("shuffle_hash"), "chunk").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(k * k, np.float64)
    for r in cells:  # at most (CLASSES + 1) squared
        out[r["cell"]] = r["n"]
    return out.reshape(k, k)


def _contexts(packed: DataFrame, answers: DataFrame, bits: int, salts: int) -> DataFrame:
    """bucket, salt, chunk, and for the words of the slice: how many contexts, which (class before, or CLASSES + class after), how often."""
    width = 2 * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, w, train, lengths, tokens, parts in zip(*(b.column(c).to_pylist() for c in ("chunk", "words", "train", "lengths", "tokens", "parts")), strict=True):
                words, t = np.frombuffer(w, _U64), _training(_unpack(lengths, _I32), _unpack(tokens, _I32), train).astype(_I64)
                c = _classes_of(parts)[t].astype(_I64)
                key = np.concatenate([t * width + np.append(END_CLASS, c[:-1]), t[:-1] * width + CLASSES + c[1:]]) if len(t) else t
                key, n = np.unique(key, return_counts=True)
                of = key // width
                at = _slices(words, bits)
                cut = np.searchsorted(of, at)
                some = np.flatnonzero(cut[1:] > cut[:-1])
                each = np.bincount(of, minlength=len(words))
                blobs = [[_pack(each[at[k] : at[k + 1]].astype(_U8)) for k in some], [_pack((key[cut[k] : cut[k + 1]] % width).astype(_U8)) for k in some], [_pack(n[cut[k] : cut[k + 1]].astype(_I32)) for k in some]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([_salt(chunk, salts)] * len(some), pa.int64()), pa.array([chunk] * len(some)), *(pa.array(x, pa.binary()) for x in blobs)], ["bucket", "salt", "chunk", "each", "which", "often"])

    rows = packed.select("chunk", "words", "train", "lengths", "tokens").join(answers.hint("shuffle_hash"), "chunk")
    return rows.mapInArrow(run, "bucket long, salt long, chunk string, each binary, which binary, often binary")


def _blank(*names: str) -> list:
    return [F.lit(None).cast("binary").alias(x) for x in names]


def _salted_contexts(contexts: DataFrame, places: DataFrame) -> DataFrame:
    """bucket, salt, keys (word of the salt's * 2 CLASSES + context, ascending), often: the contexts of all chunks of a bucket and salt."""
    rows = places.select("bucket", "salt", "chunk", F.lit(1).alias("kind"), "data", *_blank("each", "which", "often")).unionByName(
        contexts.select("bucket", "salt", "chunk", F.lit(2).alias("kind"), *_blank("data"), "each", "which", "often"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by(batches, "bucket", "salt"):
            key, often, place = [], [], None
            for r in group:
                if r["kind"] == 1:
                    place = _unpack(r["data"], _I32).astype(_I64)
                else:
                    key.append(np.repeat(place, _unpack(r["each"], _U8)) * (2 * CLASSES) + _unpack(r["which"], _U8))
                    often.append(_unpack(r["often"], _I32))
            if key:
                k, at = np.unique(np.concatenate(key), return_inverse=True)
                n = np.bincount(at, np.concatenate(often), len(k)).astype(_I64)
                yield pa.RecordBatch.from_arrays([pa.array([group[0]["bucket"]], pa.int64()), pa.array([group[0]["salt"]], pa.int64()), pa.array([_pack(np.diff(k, prepend=0))], pa.binary()), pa.array([_pack(n)], pa.binary())], ["bucket", "salt", "keys", "often"])

    return rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "chunk", "kind").mapInArrow(run, "bucket long, salt long, keys binary, often binary")


def _exchange(contexts: DataFrame, ties: DataFrame, owners: DataFrame, classes: DataFrame, pairs: np.ndarray, turn: int | None = None) -> DataFrame:
    """bucket and the classes after one round: each word (with ``turn``, those whose hash is of that parity) in the class with the highest gain."""
    n = pairs[:CLASSES, :CLASSES]
    log_n = np.log(np.maximum(n.sum(0), 0.5)).astype(np.float32)
    gain = np.concatenate([np.log(n + 0.1), np.log(n.T + 0.1)]).astype(np.float32)  # rows: contexts before and after; columns: classes to move to
    rows = ties.select("bucket", "salt", F.lit(1).alias("kind"), "data", *_blank("words", "keys", "often", "classes")).unionByName(
        contexts.select("bucket", "salt", F.lit(2).alias("kind"), *_blank("data", "words"), "keys", "often", *_blank("classes"))).unionByName(
        owners.join(classes, "bucket").select("bucket", F.lit(-1).cast("long").alias("salt"), F.lit(0).alias("kind"), "data", "words", *_blank("keys", "often"), "classes"))
    width = 2 * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by(batches, "bucket"):
            counts, words, cls = _unpack(group[0]["data"], _I64), np.frombuffer(group[0]["words"], _U64), np.frombuffer(group[0]["classes"], _U8)
            key, often, place = [np.zeros(0, _I64)], [np.zeros(0, _I64)], None
            for r in group[1:]:
                if r["kind"] == 1:
                    place = _unpack(r["data"], _I32).astype(_I64)
                else:
                    k = np.cumsum(_unpack(r["keys"], _I64))
                    key.append(place[k // width] * width + k % width)
                    often.append(_unpack(r["often"], _I64))
            k, o = np.concatenate(key), np.concatenate(often)
            order = np.argsort(k, kind="stable")
            k, o = k[order], o[order].astype(np.float32)
            may = (counts > 0) & (cls != END_CLASS)
            if turn is not None:
                may &= (words >> _U64(5)) % _U64(2) == turn
            new = cls.copy()
            for lo in range(0, len(counts), 8192):
                hi = min(lo + 8192, len(counts))
                i, j = np.searchsorted(k, [lo * width, hi * width])
                m = np.bincount(k[i:j] - lo * width, o[i:j], (hi - lo) * width).reshape(hi - lo, width).astype(np.float32)
                score = m @ gain - 2 * counts[lo:hi, None].astype(np.float32) * log_n
                score[:, END_CLASS] = -np.inf
                new[lo:hi] = np.where(may[lo:hi], score.argmax(1).astype(_U8), cls[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array([group[0]["bucket"]], pa.int64()), pa.array([new.tobytes()], pa.binary())], ["bucket", "classes"])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "salt", "kind").mapInArrow(run, "bucket long, classes binary")


def likelihood(pairs: np.ndarray) -> float:
    """The part of the training tokens' log likelihood that depends on the classes."""
    n = pairs[:CLASSES, :CLASSES]
    xlogx = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return xlogx(n) - xlogx(n.sum(0)) - xlogx(n.sum(1))


def transitions(pairs: np.ndarray, once: int, n: int) -> np.ndarray:
    """log10 P(class | class before), the last column for unknown words; rows of classes that were never seen fall back to the classes' shares."""
    k = CLASSES
    seen = pairs[:k, :k]
    share = (seen.sum(0) + 1e-9) / (seen.sum() + k * 1e-9)
    before = seen.sum(1, keepdims=True)
    p = (seen + PULL * share) / (before + PULL)
    unknown = min(0.5, max(once, 0.5) / max(n, 1))
    p = np.hstack([p * (1 - unknown), np.full((k, 1), unknown)])
    return np.log10(np.vstack([p, np.append(share * (1 - unknown), unknown)]))  # after an unknown word: the shares


@dataclass
class Fitted:
    """The packed documents with what is known of their words, the class-to-class counts, N, V and words seen once, and the likelihood after each round."""

    packed: DataFrame
    answers: DataFrame
    pairs: np.ndarray
    facts: dict
    rounds: list[float]
    table: str

    def close(self) -> None:
        """Takes the chunks out of the catalog; their files stay in the checkpoint folder like all else there."""
        self.packed.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def fit(docs: DataFrame, size: int = CHUNK, rounds: int = ROUNDS, salted: int = SALTED) -> Fitted:
    """The model of docs (doc_id, text), learned from its training rows."""
    spark = docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"factorloom_chunks_{uuid.uuid4().hex}"
    packed = _stored(chunks(docs, size), parts, name)
    asked, n_chunks = packed.agg(F.sum("n_words"), F.count("*")).first()
    bits, salts = max(8, int((asked or 0) / BUCKET).bit_length()), max(1, -(-n_chunks // salted))
    partial = checkpoint(_partial(_requests(packed, bits, salts)))
    places = partial.filter("chunk is not null").select("bucket", "salt", "chunk", "data")
    table = checkpoint(_vocabulary(partial.filter("chunk is null").select("bucket", "salt", "words", "data")))
    owners, ties = table.filter("salt is null").select("bucket", "words", "data"), table.filter("salt is not null").select("bucket", "salt", "data")
    facts = _statistics(owners)
    classes = checkpoint(_first_classes(owners, facts["top"]))
    answers = checkpoint(_answers(places, ties, owners, classes, rounds == 0))
    pairs, history, turn = _pairs(packed, answers), [], None
    history.append(likelihood(pairs))
    for k in range(rounds):
        contexts = checkpoint(_salted_contexts(_contexts(packed, answers, bits, salts), places))
        moved = checkpoint(_exchange(contexts, ties, owners, classes, pairs, turn))
        asked_again = checkpoint(_answers(places, ties, owners, moved, k == rounds - 1))
        pairs_then = _pairs(packed, asked_again)
        history.append(likelihood(pairs_then))
        if history[-1] > max(history[:-1]):
            classes, answers, pairs = moved, asked_again, pairs_then
        turn = None if history[-1] > max(history[:-1]) and turn is None else k % 2
    if rounds and pairs is not pairs_then:  # the last round was not kept: its answers alone have counts
        answers = checkpoint(_answers(places, ties, owners, classes, True))
    return Fitted(packed, answers, pairs, facts, history, name)


def score(docs: DataFrame, size: int = CHUNK, rounds: int = ROUNDS, salted: int = SALTED, model: Fitted | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    model = model or fit(docs, size, rounds, salted)
    pairs, n, v = model.pairs, model.facts["n"], model.facts["v"]
    move = transitions(pairs, model.facts["once"], n)
    totals = np.append(np.log10(np.maximum(pairs[:CLASSES, :CLASSES].sum(0), 1.0)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, train, lengths, tokens, answer in zip(*(b.column(c) if c == "doc_ids" else b.column(c).to_pylist() for c in ("doc_ids", "train", "lengths", "tokens", "parts")), strict=True):
                lengths, t = _unpack(lengths, _I32).astype(_I64), _unpack(tokens, _I32)
                cls, counts = _classes_of(answer), np.concatenate([_unpack(p["counts"], _I64) for p in answer])
                base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
                emit = np.where(counts > 0, np.log10(np.maximum(counts, 1)) - totals[cls], 0.0)
                c = cls[t]
                before = np.append(END_CLASS, c[:-1])  # each document's last token is the end, so the next one follows it
                at = np.cumsum(lengths) - lengths
                total = lambda x, at=at: np.add.reduceat(x, at)
                m = len(lengths)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array([not x for x in train], pa.bool_()), pa.array(lengths, pa.int64()), pa.array(total((counts > 0)[t].astype(_I64)), pa.int64()), pa.array(np.full(m, n, _I64)), pa.array(total(base[t])), pa.array(total(move[before, c] + emit[t]))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = model.packed.select("chunk", "doc_ids", "train", "lengths", "tokens").join(model.answers.hint("shuffle_hash"), "chunk")
    out = checkpoint(rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    model.close()
    return out
