"""Operator 11, periodic runs of words: Lyndon words and rolling-hash extensions, no suffix array.

A run is a stretch of words with smallest period q, of at least max(6, 4 * q) words, that no neighbour extends with the
same period. By the runs theorem each run has, under an order of the words or under its reverse, a Lyndon word of length
q that begins in its first period and is the longest Lyndon word there. So, for each order, a stack is scanned
from right to left: it gives at each word the next smaller suffix and with it the longest Lyndon word. Suffixes are
compared word by word at first, then by the longest common extension: binary search over rolling hashes, whose answer is
verified on the words themselves. Places verified for a distance are kept, so that a stretch is verified once for a
distance, not once for each comparison. A candidate (start, period) is extended both ways in the same manner.

Numbers stand for words within one document only, so equal numbers are equal words. A document needs memory in
proportion to its words, and n log n time.

Edge cases: a null text has no words and no runs. Repeated rows are each returned. An empty table gives no rows. A null
doc_id counts as an empty text where a rule (the planting below) hashes it. Ties between greatest runs go to the
smallest start, then period. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import portions

#: Fixed values of the contract: fewest words of a run, and fewest periods.
LEAST, PERIODS = 6, 4
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, so powers never vanish modulo 2**64


class Extender:
    """Longest common extensions of the suffixes and prefixes of one sequence of numbers."""

    def __init__(self, s: list[int]):
        self.s, self.n = s, len(s)
        self.sums: list[int] | None = None
        self.verified: dict[int, tuple[int, int]] = {}  # distance d: s[a:b] equals s[a + d:b + d] and goes no farther right

    def _hashes(self) -> None:
        v = np.array(self.s, np.uint64)
        v = (v + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        powers = np.ones(self.n + 1, np.uint64)
        powers[1:] = BASE
        powers = np.cumprod(powers)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(v * powers[:-1], out=sums[1:])
        self.sums, self.powers = sums.tolist(), powers.tolist()

    def _alike(self, i: int, j: int, size: int) -> bool:
        """The hashes of s[i:i + size] and s[j:j + size] agree; i < j."""
        h = self.sums
        return (h[i + size] - h[i]) * self.powers[j - i] & MASK == (h[j + size] - h[j]) & MASK

    def right(self, i: int, j: int) -> int:
        """How many words s[i:] and s[j:] have in common; i < j."""
        s, n, d = self.s, self.n, j - i
        for k in range(min(4, n - j)):
            if s[i + k] != s[j + k]:
                return k
        a, b = self.verified.get(d, (n, -1))
        if a <= i <= b:
            return b - i
        if i < a <= b and i + 64 >= a and s[i:a] == s[j : a + d]:
            self.verified[d] = (i, b)
            return b - i
        if self.sums is None:
            self._hashes()
        lo, step = min(4, n - j), 8
        while lo + step <= n - j and self._alike(i, j, lo + step):
            lo, step = lo + step, 2 * step
        hi = min(lo + step, n - j + 1)  # hi words don't agree
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self._alike(i, j, mid) else (lo, mid)
        if i < a <= b <= i + lo and s[i:a] == s[j : a + d]:  # up to what was verified before
            lo = b - i
        elif s[i : i + lo] != s[j : j + lo]:  # hashes collided
            lo = next(k for k in range(lo) if s[i + k] != s[j + k])
        self.verified[d] = (i, i + lo)
        return lo

    def left(self, i: int, j: int) -> int:
        """How many words s[:i] and s[:j] have in common at their ends; i < j."""
        s = self.s
        if self.sums is None:
            self._hashes()
        lo, hi = 0, i + 1
        step = 8
        while lo + step <= i and self._alike(i - lo - step, j - lo - step, lo + step):
            lo, step = lo + step, 2 * step
        hi = min(lo + step, i + 1)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self._alike(i - mid, j - mid, mid) else (lo, mid)
        if s[i - lo : i] != s[j - lo : j]:
            lo = next(k for k in range(lo) if s[i - 1 - k] != s[j - 1 - k])
        return lo


def lyndon(s: list[int], common) -> list[int]:
    """The length of the longest Lyndon word at each place; a suffix that another begins with is the smaller one."""
    n, out, stack = len(s), [0] * len(s), []
    pop, push = stack.pop, stack.append
    for i in range(n - 1, -1, -1):
        v = s[i]
        while stack:
            j = stack[-1]
            w = s[j]
            if w < v:
                break
            if w == v:
                k = common(i, j)
                if j + k == n or s[j + k] < s[i + k]:
                    break
            pop()
        out[i] = (stack[-1] if stack else n) - i
        push(i)
    return out


def find_runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the sequence, by start, then period."""
    n = len(s)
    if n < LEAST:
        return []
    ext, a = Extender(s), np.array(s, np.int64)
    at = np.arange(n)
    found: set[tuple[int, int, int]] = set()
    for order in (s, (-a).tolist()):
        p = np.array(lyndon(order, ext.right), np.int64)
        # a Lyndon word that begins in the first period of a run has two more periods behind it
        fits = at + 3 * p <= n
        i, q = at[fits], p[fits]
        for offset in (lambda q: 0, lambda q: q, lambda q: 2 * q - 1, lambda q: q // 2):  # cheap ones of the words that must agree
            same = a[i + offset(q)] == a[i + offset(q) + q]
            i, q = i[same], q[same]
        known: dict[int, tuple[int, int]] = {}  # period: the latest run or what was tried, in which later places needn't be tried
        for k, d in zip(i.tolist(), q.tolist(), strict=True):
            if d in known and known[d][0] <= k and k + d <= known[d][1]:
                continue
            start, end = k - ext.left(k, k + d), k + d + ext.right(k, k + d)
            known[d] = (start, end)
            if end - start >= max(LEAST, PERIODS * d):
                found.add((start, end - start, d))
    return sorted(found)


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # of bytes, split() takes [\x20\x09-\x0D] as white space


def numbers(found: list[bytes]) -> list[int]:
    known = dict.fromkeys(found)
    known = dict(zip(known, range(len(known)), strict=True))
    return list(map(known.__getitem__, found))


def planted(found: list, doc_id) -> list:
    """The contract's planted runs: for a tenth of all ids the words from a place on repeat those there, with some period."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(found)
    if h % 10 or not n:
        return found
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return found[:a] + [found[a + k % p] for k in range(n - a)]


def collapsed(found: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(found)
    edges = np.zeros(len(found) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join(compress(found, (np.cumsum(edges[:-1]) == 0).tolist()))


def _each(docs: DataFrame, fields: list[tuple[str, str, pa.DataType]], row) -> DataFrame:
    """doc_id and fields, of which row(doc_id, text) gives the values."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in portions(batch, 1):
                values = [row(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(v), f[2]) for v, f in zip(zip(*values, strict=True), fields, strict=True))], ["doc_id", *(f[0] for f in fields)])

    texts = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} {t}" for n, t, _ in fields))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and runs (array of start, length, period, in words) of each row of docs (doc_id, text)."""
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def row(_, text):
        return ([dict(zip(("start", "length", "period"), r, strict=True)) for r in find_runs(numbers(words(text)))],)

    return _each(docs, [("runs", "array<struct<start:long,length:long,period:long>>", pa.list_(one))], row)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: runs of the words with the planted ones, the greatest run, digests of all runs and of the collapsed text."""

    def row(doc_id, text):
        found = planted(words(text), doc_id)
        runs = find_runs(numbers(found))
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        return len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(found, runs)).hexdigest()

    fields = [(n, "long", pa.int64()) for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [(n, "string", pa.string()) for n in ("runs_sha256", "collapsed_sha256")]
    return _each(docs, fields, row)
