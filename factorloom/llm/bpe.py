"""Operator 1, byte-level BPE encoding and decoding by tree concatenation.

Texts of up to ``spread`` characters are encoded as they are. A longer text is halved until no leaf has
more than ``leaf`` characters; the leaves are rows, which tasks encode in parallel. Then neighbours are
joined pair by pair up the tree. At each join the text around the seam is encoded anew, in a window that
grows on both sides until its ends agree exactly with what both sides have there:

* Where the text can be cut in any context (``_cut_ok``: a change of character class that no piece of the
  splitting pattern crosses), the window reaches from such a place on the left to one on the right.
* Within a long run that nothing splits, both halves' pieces are parts of one piece. There the window
  counts tokens; it agrees once its first and last two tokens are those of the two sides. A sequence of
  BPE tokens is the encoding of its bytes if each neighbouring pair is, so the joined sequence is exact.

Special tokens of the tokenizer file divide a text before anything else, as in the tokenizers library.

Edge cases: a null text counts as empty: 0 tokens, the digests of "". Repeated rows are each returned (equal
long rows are encoded once). An empty table gives no rows. Extra columns are ignored. Unpaired surrogates
can't occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed value: the splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, SPREAD = 16384, 32768


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        stands = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        ranks = {bytes(stands[c] for c in t): i for t, i in d["model"]["vocab"].items() if t not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes[i] = t
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.decimals = [str(i) for i in range(len(self.bytes))]

    def encode(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special="all", disallowed_special=())

    def piece(self, data: bytes) -> list[int]:
        """data as one piece, not split."""
        return self.core._encode_single_piece(data)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        """n_tokens, sha256 of the decimal ids, sha256 of the decoded text."""
        return len(ids), hashlib.sha256(",".join(map(self.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _kind(c: str) -> str:
    """L letter, N number, s white space, o other: the classes of the splitting pattern."""
    if c.isspace() and not "\x1c" <= c <= "\x1f":  # Python counts these four as space, the pattern doesn't
        return "s"
    return k if (k := unicodedata.category(c)[0]) in "LN" else "o"


def _cut_ok(text: str, i: int) -> bool:
    """No piece crosses i, whatever stands farther left or right."""
    a, b = _kind(text[i - 1]), _kind(text[i])
    return a != b and a != "s" and not (text[i - 1] == "'" and b == "L")


def leaves(text: str, special: dict[str, int], leaf: int = LEAF) -> list[tuple[str, bool]]:
    """The halves of halves of text, in order, and whether each begins after or with a special token (or the text)."""
    out: list[tuple[str, bool]] = []

    def halve(s: str, first: bool) -> None:
        if len(s) <= leaf:
            out.append((s, first))
        else:
            halve(s[: len(s) // 2], first)
            halve(s[len(s) // 2 :], False)

    at = 0
    while True:
        found = [(i, -len(s), s) for s in special if (i := text.find(s, at)) >= 0]
        i, _, s = min(found, default=(len(text), 0, ""))
        if i > at:
            halve(text[at:i], True)
        if not s:
            return out or [("", True)]
        out.append((s, True))
        at = i + len(s)


def join(c: Codec, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray, window: int = 64) -> np.ndarray:
    """The ids of text[lo:hi], from those of text[lo:mid] and text[mid:hi]."""
    while True:
        a, b = max(lo, mid - window), min(hi, mid + window)
        a = next((i for i in range(a, max(lo, mid - 2 * window), -1) if i == lo or _cut_ok(text, i)), lo if mid - 2 * window <= lo else None)
        b = next((i for i in range(b, min(hi, mid + 2 * window)) if i == hi or _cut_ok(text, i)), hi if mid + 2 * window >= hi else None)
        if a is not None and b is not None:
            break
        if mid - window > lo and mid + window < hi and len({_kind(x) for x in text[mid - window : mid + window]}) == 1:
            return _join_run(c, left, right, _run(text, lo, mid, hi))
        window *= 2
    middle = c.core.encode_ordinary(text[a:b])
    ends = np.cumsum(c.lengths[left])
    n = int(np.searchsorted(ends, len(text[lo:a].encode()), "right"))
    starts = np.cumsum(c.lengths[right])
    m = int(np.searchsorted(starts, len(text[mid:b].encode()), "left")) + 1 if b > mid else 0
    agree = (n == 0 or ends[n - 1] == len(text[lo:a].encode())) and (m == 0 or starts[m - 1] == len(text[mid:b].encode()))
    if not agree:  # a cut isn't a token's end on its side: a wider window
        return join(c, text, lo, mid, hi, left, right, 2 * window)
    return np.concatenate([left[:n], np.array(middle, np.int32), right[m:]])


def _run(text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
    """Bytes of the run around mid that are in the last piece of the left and in the first piece of the right."""
    kind, a, b = _kind(text[mid]), mid, mid
    while a > lo and _kind(text[a - 1]) == kind:
        a -= 1
    while b < hi and _kind(text[b]) == kind:
        b += 1
    if kind == "s" and b < hi:
        b -= 1  # the last space before other text is not in the run's piece
    if kind == "L" and a > lo and text[a - 1] == "'":
        a += 2  # 's, 'll and so on may be a piece of their own
    return len(text[a:mid].encode()), len(text[mid:b].encode())


def _join_run(c: Codec, left: np.ndarray, right: np.ndarray, run: tuple[int, int]) -> np.ndarray:
    k = 8
    # tokens that lie in the run: those whose bytes, counted from the seam, fit in it
    most_l = int(np.searchsorted(np.cumsum(c.lengths[left[::-1]]), run[0], "right"))
    most_r = int(np.searchsorted(np.cumsum(c.lengths[right]), run[1], "right"))
    while True:
        i, j = min(k, most_l), min(k, most_r)
        tail, head = left[len(left) - i :], right[:j]
        new = np.array(c.piece(b"".join(c.bytes[t] for t in [*tail, *head])), np.int32)
        left_ok = i > 2 and np.array_equal(new[:2], tail[:2])
        right_ok = j > 2 and np.array_equal(new[-2:], head[-2:])
        # at the run's ends the piece begins or ends, so nothing needs to agree there
        if (left_ok or i == most_l) and (right_ok or j == most_r):
            return np.concatenate([left[: len(left) - i], new, right[j:]])
        k *= 2


def tree(c: Codec, parts: list[tuple[str, bool, np.ndarray]]) -> np.ndarray:
    """The ids of the whole text from (leaf, begins anew, ids of the leaf), joined pair by pair."""
    text = "".join(p for p, _, _ in parts)
    nodes, at = [], 0
    for p, first, ids in parts:
        nodes.append((at, at + len(p), first, np.asarray(ids, np.int32)))
        at += len(p)
    while len(nodes) > 1:
        up = []
        for k in range(0, len(nodes) - 1, 2):
            (lo, mid, first, left), (_, hi, hard, right) = nodes[k : k + 2]
            if hard or lo == mid or mid == hi:
                up.append((lo, hi, first, np.concatenate([left, right])))
            else:
                # a special token within the left side bounds what belongs together
                start = max([lo, *(s for s, f in _begins(parts) if lo < s < mid and f)])
                skip = _tokens_before(c, left, text[lo:start])
                end = min([hi, *(s for s, f in _begins(parts) if mid < s < hi and f)])
                stop = _tokens_before(c, right, text[mid:end])
                up.append((lo, hi, first, np.concatenate([left[:skip], join(c, text, start, mid, end, left[skip:], right[:stop]), right[stop:]])))
        nodes = up + nodes[len(nodes) - len(nodes) % 2 :]
    return nodes[0][3]


def _begins(parts: list[tuple[str, bool, np.ndarray]]) -> Iterator[tuple[int, bool]]:
    at = 0
    for p, first, _ in parts:
        yield at, first
        at += len(p)


def _tokens_before(c: Codec, ids: np.ndarray, text: str) -> int:
    return int(np.searchsorted(np.cumsum(c.lengths[ids]), len(text.encode()), "right")) if text else 0


def _long_ids(docs: DataFrame, path: str, leaf: int, spread: int, id_type: str, fields: str, row) -> DataFrame:
    """The long texts' results; ``row`` makes the values of ``fields`` of ids."""
    text = F.col("text").cast("string")
    long = docs.filter(F.length(text) > spread).select("doc_id", text.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = codec(path).special
        for b in slices(batches, 16):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = leaves(t, special, leaf)
                key = hashlib.sha256(t.encode()).digest()
                yield pa.RecordBatch.from_pylist([{"doc_id": i, "text_key": key, "part": k, "begins": first, "leaf": p} for k, (p, first) in enumerate(parts)], schema=_arrow(b.schema.field(0).type))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = pa.array([np.array(c.encode(t), np.int32).tobytes() for t in b.column("leaf").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        ids = tree(codec(path), [(p, bool(f), np.frombuffer(x, np.int32)) for p, f, x in zip(pdf["leaf"], pdf["begins"], pdf["ids"], strict=True)])
        values, names = row(ids), [f.split()[0] for f in fields.split(", ")]
        n = int(pdf["copies"].iloc[0])
        return pd.DataFrame({"doc_id": [None if pd.isna(pdf["doc_id"].iloc[0]) else pdf["doc_id"].iloc[0]] * n} | {k: [v] * n for k, v in zip(names, values, strict=True)})

    key = f"doc_id {id_type}, text_key binary"
    cut_rows = long.mapInArrow(cut, f"{key}, part int, begins boolean, leaf string")
    # the shuffle by leaf spreads the work, and leaves of repeated rows become one
    spread_rows = cut_rows.groupBy("doc_id", "text_key", "part", "begins").agg(F.first("leaf").alias("leaf"), F.count("*").alias("copies"))
    encoded = spread_rows.mapInArrow(encode, f"{key}, part int, begins boolean, leaf string, copies long, ids binary")
    return encoded.groupBy("doc_id", "text_key").applyInPandas(merge, f"doc_id {id_type}, {fields}")


def _arrow(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("text_key", pa.binary()), ("part", pa.int32()), ("begins", pa.bool_()), ("leaf", pa.string())])


def _each(docs: DataFrame, path: str, leaf: int, spread: int, fields: str, row) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    short = docs.select("doc_id", text.alias("text")).filter(F.length("text") <= spread)
    names = ["doc_id", *(f.split()[0] for f in fields.split(", "))]
    types = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[f.split()[1]] for f in fields.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches):
            if part.num_rows:
                values = [row(c.encode(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(zip(*values, strict=True), types, strict=True))], names)

    whole = short.mapInArrow(encode, f"doc_id {id_type}, {fields}")
    return whole.unionByName(_long_ids(docs, path, leaf, spread, id_type, fields, row))


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs (doc_id, text)."""
    return _each(docs, path or default_path(), leaf, spread, "ids array<int>", lambda ids: ([int(i) for i in ids],))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of encoded (doc_id, ids); bytes that aren't UTF-8 become U+FFFD; null ids an empty text."""
    path = path or default_path()

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(text, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs; ids stay in the task that made them."""
    where = path or default_path()
    return _each(docs, where, leaf, spread, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids: codec(where).digests(ids if isinstance(ids, list) else ids.tolist()))
