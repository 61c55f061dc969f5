"""Operator 13, alignment of two tokenizers: a dictionary of groups of ids.

A text (with a space before it) is encoded by a byte-level BPE (A) and by a piece BPE (B). The byte offsets where tokens of
both end cut the tokens into groups; all pairs of an A and a B token in a group are links. Groups are few compared
with their occurrences, so everything about links is done once for a distinct group:

1. Each document gives its distinct groups with how often each occurs. This is written to the shared folder.
2. The documents of each distinct group are counted, and its links expanded, once. A pair's count is the sum of the
   documents of the groups that hold it, less what is counted twice: a document in which k groups hold the pair
   reports k - 1 for it. So counts of documents are exact though no document's links are expanded and shuffled.
3. A group's sums over its links are made once and joined back to the documents by group. Groups with more than 1 in
   ``HOT`` of all (document, group) rows are at most ``HOT`` in number; they are broadcast and their rows
   added up where they lie. So no key of the shuffled rest has a large share.

Encoding is by chunks: the text is cut before each single space between characters that aren't white space. No piece of
A's splitting pattern and no piece of B's vocabulary crosses there (checked when B's file is read; without that whole
texts are taken), so chunks are encoded alone, each distinct one once for as long as a task's dictionary keeps it.

Token bytes: A's entry byte-level decoded; B's piece in UTF-8 with U+2581 as a space, <0xHH> as the byte HH. A text whose
joined A or B bytes differ from space + text has no tokens.

Edge cases: null and empty texts have no tokens: zeros, and "" for the groups. Special tokens' strings in texts are plain
text. Repeated rows are documents of their own and each returned. An empty table gives no rows. Ties for an A id's
highest count all count. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .bpe import default_path as a_path
from .common import portions, shared_dir

#: Groups with a larger share than one in so many rows are broadcast: so there are at most so many.
HOT = 1 << 16
#: With more entries or characters than these a task's dictionary of chunks is begun anew before the next document.
CHUNKS, CHARACTERS = 400_000, 48_000_000


#: A space that has white space or an end beside it.
BESIDE = re.compile(r"\A\s|\s\Z|\s | \s")


def b_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunks(text: str) -> list[str]:
    """space + text, cut before each single space between two characters that aren't white space."""
    out = text.split(" ")
    if BESIDE.search(text):
        joined: list[str] = []
        for k, p in enumerate(out):
            if k and not (p and not p[0].isspace() and out[k - 1] and not out[k - 1][-1].isspace()):
                joined[-1] += " " + p
            else:
                joined.append(p)
        out = joined
    return out


class Aligner:
    """The groups of chunks, with a bounded dictionary of them."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece

        self.a = codec(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = self.a.lengths.tolist(), [len(x) for x in self.b_bytes]
        self.sizes_b = np.array(self.b_lengths, np.int64)
        self.decimals = [str(i) for i in range(max(len(self.a.bytes), len(self.b_bytes)))]
        self.cuts = not any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.b_bytes)
        self.begin()

    def begin(self) -> None:
        self.said: dict[str, str | None] = {}  # chunk: its groups in the contract's form, None if the bytes differ
        self.links: dict[str, tuple[int, int, tuple[int, ...]]] = {}  # group: A tokens, B tokens, distinct pairs
        self.held = 0

    def learn(self, missing: list[str]) -> None:
        """Chunks that neither begin nor end with white space are encoded together, as a text of their own, and the others alone."""
        apart = [c for c in missing if not c or c[0].isspace() or c[-1].isspace()] if self.cuts else missing
        alone = set(apart)
        if together := [c for c in missing if c not in alone]:
            found = self.groups_of(together)
            if found is None:  # some bytes differ
                apart = missing
            else:
                self.said.update(zip(together, found, strict=True))
                self.held += sum(map(len, together)) + sum(map(len, found))
        for c in apart:
            a, b = self.a.core.encode_ordinary(" " + c), self.b.encode(c, num_threads=1)
            self.said[c] = found = self.cut(a, b) if self.same(a, b, (" " + c).encode()) else None
            self.held += len(c) + len(found or "")

    def same(self, a: list[int], b: list[int], whole: bytes) -> bool:
        return b"".join(map(self.a.bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole

    def groups_of(self, many: list[str]) -> list[str] | None:
        """The groups of each of many chunks, from one encoding of all; None if bytes differ or a chunk's end is no end of tokens of both."""
        text = " ".join(many)
        a, b = self.a.core.encode_ordinary(" " + text), self.b.encode(text, num_threads=1)
        if not self.same(a, b, (" " + text).encode()):
            return None
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.sizes_b[b])
        at = np.zeros(ends_a[-1] + 1, bool)
        at[ends_a] = True
        cuts = ends_b[at[ends_b]]
        cuts = cuts[np.append(np.diff(cuts) > 0, True)]  # pieces without bytes end where the one before does
        last = np.cumsum([len(c.encode()) + 1 for c in many])
        upto = np.searchsorted(cuts, last)
        if not np.array_equal(cuts[upto], last):
            return None
        i, j = np.searchsorted(ends_a, cuts, "right").tolist(), np.searchsorted(ends_b, cuts, "right").tolist()
        x, y = list(map(self.decimals.__getitem__, a)), list(map(self.decimals.__getitem__, b))
        groups = [x[p] + "|" + y[q] if r - p == 1 == t - q else ",".join(x[p:r]) + "|" + ",".join(y[q:t]) for p, r, q, t in zip([0, *i], i, [0, *j], j, strict=False)]
        upto = (upto + 1).tolist()
        return [";".join(groups[p:r]) for p, r in zip([0, *upto], upto, strict=False)]

    def cut(self, a: list[int], b: list[int]) -> str:
        """The groups of two encodings of the same bytes."""
        if len(a) == 1 == len(b):
            return f"{a[0]}|{b[0]}"
        out, na, nb, i, j = [], len(a), len(b), 0, 0
        la, lb = self.a_lengths, self.b_lengths
        while i < na:
            p, q, at, bt = i, j, la[a[i]], lb[b[j]]
            i, j = i + 1, j + 1
            while at != bt:
                if at < bt:
                    at += la[a[i]]
                    i += 1
                else:
                    bt += lb[b[j]]
                    j += 1
            while j < nb and not lb[b[j]]:  # pieces without bytes belong to what precedes them
                j += 1
            out.append(f"{a[p]}|{b[q]}" if i - p == 1 == j - q else ",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
        return ";".join(out)

    def of(self, group: str) -> tuple[int, int, tuple[int, ...]]:
        """How many A and B tokens, and the distinct pairs as A << 32 | B."""
        if (known := self.links.get(group)) is None:
            a, b = (x.split(",") for x in group.split("|"))
            pairs = tuple({int(x) << 32 | int(y) for x in set(a) for y in set(b)})
            known = len(a), len(b), pairs
            if len(pairs) <= 64:
                self.links[group] = known
        return known


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """One for each process."""
    if (a_file, b_file) not in _ALIGNERS:
        _ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNERS[a_file, b_file]


def _parts(x: Aligner, texts: list[str | None]) -> list[list[str]]:
    """The chunks of each text, all of which x then knows."""
    if len(x.said) > CHUNKS or x.held > CHARACTERS:
        x.begin()
    out = [(chunks(t) if x.cuts else [t]) if t else [] for t in texts]
    if missing := list(dict.fromkeys(c for c in chain.from_iterable(out) if c not in x.said)):
        x.learn(missing)
    return out


def _document(x: Aligner, parts: list[str]) -> tuple:
    """n_a, n_b, n_groups, n_links, groups_sha256, distinct groups, how often each, pairs of several groups, in how many more."""
    none = (0, 0, 0, 0, "", [], [], [], [])
    if not parts:
        return none
    count = Counter(parts)
    said = list(map(x.said.__getitem__, parts))
    if None in said:
        return none
    often: dict[str, int] = defaultdict(int)
    for c, k in count.items():
        for g in x.said[c].split(";"):
            often[g] += k
    n_a = n_b = n_links = 0
    pairs = []
    for g, k in often.items():
        a, b, p = x.of(g)
        n_a, n_b, n_links = n_a + k * a, n_b + k * b, n_links + k * a * b
        pairs.append(p)
    more = [(p, k - 1) for p, k in Counter(chain.from_iterable(pairs)).items() if k > 1]
    return n_a, n_b, sum(often.values()), n_links, hashlib.sha256(";".join(said).encode()).hexdigest(), list(often), list(often.values()), [p for p, _ in more], [k for _, k in more]


FIELDS = [
    ("n_a", "long", pa.int64()), ("n_b", "long", pa.int64()), ("n_groups", "long", pa.int64()), ("n_links", "long", pa.int64()), ("groups_sha256", "string", pa.string()),
    ("groups", "array<string>", pa.list_(pa.string())), ("often", "array<long>", pa.list_(pa.int64())), ("pairs", "array<long>", pa.list_(pa.int64())), ("more", "array<long>", pa.list_(pa.int64())),
]


def document_groups(docs: DataFrame, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """doc_id, the counts and digest of each row of docs (doc_id, text), its distinct groups and how often they occur, and its pairs that several groups hold."""
    files = a_file or a_path(), b_file or b_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = aligner(*files)
        for batch in batches:
            for b in portions(batch, 1):
                values = list(zip(*(_document(x, parts) for parts in _parts(x, b.column(1).to_pylist())), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(v), f[2]) for v, f in zip(values, FIELDS, strict=True))], ["doc_id", *(f[0] for f in FIELDS)])

    texts = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t, _ in FIELDS))


def _expanded(groups: DataFrame) -> DataFrame:
    """group, docs, a, b, times: a row for each distinct pair of each group, and how often the group links it."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, right = (Counter(map(int, x.split(","))) for x in g.split("|"))
                for a, k in left.items():
                    rows += [(g, n, a, b, k * m) for b, m in right.items()]
                    if len(rows) > 50_000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

    return groups.mapInArrow(expand, "group string, docs long, a int, b int, times long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["group", "docs", "a", "b", "times"])


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def pair_counts(expanded: DataFrame, documents: DataFrame) -> DataFrame:
    """a, b, n: the documents that link each pair; ``documents`` has pairs that several groups hold, and in how many more."""
    twice = documents.select(F.explode(F.arrays_zip("pairs", "more")).alias("x")).select(F.shiftright("x.pairs", 32).cast("int").alias("a"), F.col("x.pairs").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), (-F.col("x.more")).alias("n"))
    return expanded.select("a", "b", F.col("docs").alias("n")).unionByName(twice).groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text).

    The intermediate tables stay in a folder of this call under the shared folder, as the result is read from them.
    """
    folder = f"{shared_dir(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
    # the numbers are written with the rows, so they are the rows' own
    table = _written(document_groups(docs, a_file, b_file).withColumn("row", F.monotonically_increasing_id()), folder, "documents")
    counted = table.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("docs"))
    links = _written(_expanded(counted), folder, "links")
    counts = _written(pair_counts(links, table.select("pairs", "more")), folder, "pairs")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most A's vocabulary
    judged = counts.join(F.broadcast(best), "a").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    sums = links.join(judged, ["a", "b"]).groupBy("group").agg(F.first("docs").alias("docs"), F.sum(F.col("times") * F.col("best")).alias("best"), F.sum(F.col("times") * F.col("n")).alias("counted"))
    sums = _written(sums, folder, "sums")
    rows_in_all = sums.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]  # one number
    hot = F.broadcast(sums.filter(F.col("docs") * HOT > rows_in_all).select("group", "best", "counted"))
    rare = sums.filter(F.col("docs") * HOT <= rows_in_all).select("group", "best", "counted")
    each = table.select("row", F.explode(F.arrays_zip("groups", "often")).alias("x")).select("row", F.col("x.groups").alias("group"), F.col("x.often").alias("often"))
    added = lambda df: df.select("row", (F.col("often") * F.col("best")).alias("best"), (F.col("often") * F.col("counted")).alias("counted"))
    parts = added(each.join(hot, "group")).unionByName(added(each.join(hot, "group", "left_anti").join(rare, "group")))
    by_row = parts.groupBy("row").agg(F.sum("best").alias("best"), F.sum("counted").alias("counted"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    own = table.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return own.join(by_row, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("best").alias("n_best"), zero("counted").alias("count_sum"), "groups_sha256")
