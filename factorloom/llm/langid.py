"""Operator 4, language identification in two levels: the language family first, then within the family
one-versus-one linear support vector machines between its languages.

Features are hashed character 1- to 3-grams of the whole text, lower-cased, with one space for whatever
isn't a letter; counts are square-rooted and scaled to length 1. The machines are fitted (averaged Pegasos
in numpy, over sparse rows) on a bounded sample: at most ``per_lang`` labelled rows of each language and
``sample_rows`` in all, chosen by a hash, never from the held-out fold. Of more than ``max_langs`` languages those with the most labelled
rows are learned (ties: by code), so there are at most max_langs * (max_langs - 1) / 2 machines. A prediction sees the text alone.

Edge cases: a null text, or one without any letter, is ``und`` with score 0. Rows with a null lang are
predicted but not learned from. A null doc_id counts as the text "" in the fold rule (held out). Repeated
rows are each returned. If nothing can be learned from (an empty table, no labels), all rows are ``und``.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, slices

#: Families of languages by code. A code that isn't here is in the family "other".
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("es", "fr", "it", "pt", "ca", "gl", "ro"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "sinitic": ("zh",),
}
#: LEAST: where the machines are so unsure, a text is in no known language.
DIM, PER_LANG, SAMPLE_ROWS, SEED, LEAST = 8192, 400, 8000, 7, 0.25
#: Most languages that are learned.
MAX_LANGS = 64


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.split("-")[0].lower() in members), "other")


_LETTER = np.frombuffer(bytes(chr(i).isalpha() if not 0xD800 <= i < 0xE000 else 0 for i in range(0x10000)), np.uint8)


def features(text: str | None) -> np.ndarray | None:
    """The vector of a text; None if it has no letter."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    high = x >= 0x10000
    letter = _LETTER[np.where(high, 0, x)] > 0
    if high.any():
        letter[high] = [chr(c).isalpha() for c in x[high]]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of other characters stands for all up to the next letter
    x = np.where(letter, x, 32)[keep].astype(np.uint32)
    x = np.concatenate([np.array([32], np.uint32), x, np.array([32], np.uint32)])
    mul, shift = np.uint32(0x9E3779B1), np.uint32(32 - DIM.bit_length() + 1)
    one = x * np.uint32(0x01000193)
    two = (x[:-1] * np.uint32(0x85EBCA6B)) ^ (x[1:] + np.uint32(0x165667B1))
    three = (two[:-1] * np.uint32(0xC2B2AE35)) ^ x[2:]
    counts = np.bincount((np.concatenate([one, two, three]) * mul) >> shift, minlength=DIM)
    v = np.sqrt(counts.astype(np.float32))
    return v / np.sqrt(np.square(v).sum())


@dataclass
class Model:
    """Weights (a row each, the bias last) of the family machines (one against the rest) and of the pairs of each family."""

    families: list[str]
    family_w: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    pair_w: dict[str, np.ndarray]

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        squash = lambda m: 1.0 / (1.0 + np.exp(-3.0 * m))
        margins = self.family_w @ np.append(v, np.float32(1)) if len(self.families) > 1 else np.array([10.0])
        f = self.families[int(np.argmax(margins))]
        score, names = float(squash(margins.max())), self.members[f]
        if len(names) == 1:
            return names[0], score
        m = self.pair_w[f] @ np.append(v, np.float32(1))
        votes, least = np.zeros(len(names)), np.full(len(names), np.inf)
        for (a, b), x in zip(self.pairs[f], m, strict=True):
            votes[a if x > 0 else b] += 1 + min(abs(x), 1) * 1e-3
            least[a], least[b] = min(least[a], x), min(least[b], -x)
        k = int(np.argmax(votes))
        return names[k], score * float(squash(least[k]))


def svm(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = 12, lam: float = 1e-4, seed: int = SEED) -> np.ndarray:
    """Weights and, last, the bias of the linear machine that tells the sparse ``rows`` with y = 1 from those with y = -1:
    averaged Pegasos over small batches, classes weighed evenly. Row r holds val[ptr[r]:ptr[r + 1]] at idx[...]."""
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, t, rng = np.zeros(DIM + 1), np.zeros(DIM + 1), 0, np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for b in (order[i : i + 32] for i in range(0, len(rows), 32)):
            t += 1
            rate = 1.0 / (lam * (t + 1000))
            r = rows[b]
            at = np.concatenate([np.arange(ptr[k], ptr[k + 1]) for k in r])
            of, i, v = np.repeat(np.arange(len(b)), ptr[r + 1] - ptr[r]), idx[at], val[at]
            margin = np.bincount(of, v * w[i], len(b)) + w[DIM]
            push = rate / len(b) * y[b] * cost[b] * (y[b] * margin < 1)
            w *= 1 - rate * lam
            w[:DIM] += np.bincount(i, v * push[of], DIM)
            w[DIM] += push.sum()
            if epoch >= epochs // 2:
                mean += w
    return mean / max(1, t - t // epochs * (epochs // 2))


def fit(rows: list[tuple[str, bytes, bytes]]) -> Model | None:
    """A model from (lang, places as uint16, values as float32) of the vectors; None without any."""
    if not rows:
        return None
    langs = sorted({lang for lang, _, _ in rows})
    ptr = np.cumsum([0, *(len(i) // 2 for _, i, _ in rows)])
    idx, val = np.frombuffer(b"".join(i for _, i, _ in rows), np.uint16).astype(np.int32), np.frombuffer(b"".join(v for _, _, v in rows), np.float32)
    of = np.array([lang for lang, _, _ in rows])
    members = {f: [n for n in langs if family(n) == f] for f in sorted(set(map(family, langs)))}
    kinds, every = np.array([family(n) for n in of]), np.arange(len(of))
    fams = list(members)
    family_w = np.stack([svm(ptr, idx, val, every, np.where(kinds == f, 1.0, -1.0)) for f in fams]) if len(fams) > 1 else np.zeros((1, DIM + 1))
    pairs = {f: list(combinations(range(len(m)), 2)) for f, m in members.items()}
    pair_w = {}
    for f, m in members.items():
        ws = []
        for a, b in pairs[f]:
            rows_ab = np.flatnonzero((of == m[a]) | (of == m[b]))
            ws.append(svm(ptr, idx, val, rows_ab, np.where(of[rows_ab] == m[a], 1.0, -1.0)))
        pair_w[f] = np.stack(ws) if ws else np.zeros((0, DIM + 1))
    return Model(fams, family_w, members, pairs, pair_w)


def train(docs: DataFrame, per_lang: int = PER_LANG, sample_rows: int = SAMPLE_ROWS, max_langs: int = MAX_LANGS) -> Model | None:
    """Fitted on at most ``per_lang`` rows of each of at most ``max_langs`` languages and about ``sample_rows`` in all, outside the held-out fold.

    The rows with the lowest hashes of doc_id and text are taken, copies once; their vectors, of at most ``DIM`` numbers
    each, are made by the executors, so no text comes to the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 0)).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not counts:
        return None
    per_lang = max(1, min(per_lang, sample_rows // len(counts)))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.3 * per_lang / n + 20 / n)))), F.col("lang"))
    hashed = known.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))).filter(F.col("h") <= share * float(1 << 40))
    once = hashed.groupBy("lang", "h").agg(F.min("text").alias("text"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # of about 1.3 * per_lang rows a language
    chosen = once.withColumn("no", least).filter(F.col("no") <= per_lang).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(lang, np.flatnonzero(v).astype(np.uint16), v) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (v := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.string()), pa.array([i.tobytes() for _, i, _ in found], pa.binary()), pa.array([v[i].tobytes() for _, i, v in found], pa.binary())], ["lang", "idx", "val"])

    rows = chosen.mapInArrow(run, "lang string, idx binary, val binary").collect()
    return fit(sorted((r["lang"], bytes(r["idx"]), bytes(r["val"])) for r in rows))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t in b.column(2).to_pylist():
                v = features(t) if model else None
                out.append(("und", 0.0) if v is None else model.predict(v))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Train on docs and predict all of its rows."""
    return predict(docs, train(docs, per_lang))


def keep_known(docs: DataFrame, per_lang: int = PER_LANG, least: float = LEAST, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text is in one of ``languages`` (None: in any that was learned) with a score of at least ``least``.

    Where nothing could be learned, the rows whose text has a letter.
    """
    model = train(docs, per_lang)
    schema = docs.schema
    at = docs.columns.index("text")

    def good(v: np.ndarray | None) -> bool:
        if v is None or model is None:
            return v is not None
        lang, score = model.predict(v)
        return score >= least and (languages is None or lang in languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([good(features(t)) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
