"""Operator 8, exact deduplication by skew-safe combining. DataFrame functions only.

Texts are equal when identical without white space. Three combining stages, each of which groups by the
full content beside its digest: (1) map-side partial aggregation drops copies within a task, (2) groups
merge by (digest, salt, content), (3) the winners of each salt merge by (digest, content).

A digest is salted when it has more than ``max(hot_rows, n / 1000)`` rows. There can be at most 1000 such
digests, so the list of hot digests is small whatever the input, and is broadcast. All other groups are
complete after stage 2 and take part in one shuffle only.

Edge cases: a null text counts as empty, and all empty texts form one group. A null doc_id is kept as a
row and loses ties against any other id. Repeated rows are each returned and each counted. An empty table
gives no rows. Extra columns are ignored. Digest collisions are resolved by content (tested with a weak
digest): a digest with several contents is joined on the content as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, strip_spaces


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c.cast("binary"), 256))


def _normal(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.length(text).alias("size"), strip_spaces(text).alias("content"))
    return rows.withColumn("digest", digest(F.col("content")))


def _ranked(size: str = "size") -> Column:
    """Greatest for the row that stays: most code points, then the smallest doc_id, null last."""
    return F.struct(size, F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not(F.col("doc_id").cast("long")).alias("low_id"))


def classes(docs: DataFrame, salts: int = 32, hot_rows: int = 1000, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame]:
    """One row per digest: (digest, best, group_size, variants), and the hot digests. ``variants`` counts the contents.

    What is moved with its text is moved once; only the winners of salts of hot digests are moved again.
    """
    rows = _normal(docs, digest)
    hot_rows = max(hot_rows, docs.count() // 1000)
    hot = checkpoint(rows.groupBy("digest").count().filter(F.col("count") > hot_rows).select("digest", F.lit(True).alias("hot")))
    flagged = rows.join(F.broadcast(hot), "digest", "left")
    best = F.max(_ranked()).alias("best")
    plain = flagged.filter("hot is null").groupBy("digest", "content").agg(best, F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts))
    salted = flagged.filter("hot").withColumn("salt", salt).groupBy("digest", "salt", "content").agg(best, F.count("*").alias("n"))
    merged = salted.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    by_digest = [F.max("best").alias("best"), F.sum("n").alias("group_size"), F.count("*").alias("variants")]
    return plain.groupBy("digest").agg(*by_digest).unionByName(merged.groupBy("digest").agg(*by_digest)), hot


def exact_dedup(docs: DataFrame, salts: int = 32, hot_rows: int = 1000, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the doc_id of the row with the most code points in its original text, then the smallest doc_id.
    """
    found, hot = classes(docs, salts, hot_rows, digest)
    found = checkpoint(found)
    rows = _normal(docs, digest)
    sha = F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256")
    keep = F.bitwise_not("best.low_id").alias("keep_id")
    plain = found.filter("variants = 1").select("digest", keep, "group_size")
    flagged = rows.select("doc_id", "digest", sha).join(F.broadcast(hot), "digest", "left")
    few = plain.join(F.broadcast(hot), "digest", "left_semi")  # at most 1000 rows
    parts = [
        flagged.filter("hot is null").drop("hot").join(plain, "digest"),
        flagged.filter("hot").drop("hot").join(F.broadcast(few), "digest"),
    ]
    collided = found.filter("variants > 1").select("digest")
    if not collided.isEmpty():  # never seen with SHA-256: their contents are told apart
        theirs = rows.join(collided, "digest", "left_semi")
        each = theirs.groupBy("digest", "content").agg(F.max(_ranked()).alias("best"), F.count("*").alias("group_size"))
        parts.append(theirs.select("doc_id", "digest", "content", sha).join(each.select("digest", "content", keep, "group_size"), ["digest", "content"]).drop("content"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame, salts: int = 32, hot_rows: int = 1000) -> DataFrame:
    """The rows of docs that stay, all columns. Of rows with one doc_id and equal texts the longest original stays, once."""
    verdict = exact_dedup(docs, salts, hot_rows).filter("kept").groupBy(F.col("doc_id").alias("__dedup_id"), F.col("text_sha256").alias("__dedup_sha")).agg(F.count("*").alias("__dedup_n"))
    verdict = checkpoint(verdict)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(strip_spaces(text).cast("binary"), 256)
    kept = docs.join(verdict, docs["doc_id"].eqNullSafe(verdict["__dedup_id"]) & (sha == verdict["__dedup_sha"]))
    if not verdict.filter("__dedup_n > 1").isEmpty():
        first = Window.partitionBy("__dedup_id", "__dedup_sha").orderBy(F.length(text).desc())
        kept = kept.withColumn("__dedup_nth", F.row_number().over(first)).filter("__dedup_nth = 1").drop("__dedup_nth")
    return kept.drop("__dedup_id", "__dedup_sha", "__dedup_n")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
g AS (SELECT content, count(*) AS group_size, max(size) AS most FROM d GROUP BY content),
k AS (SELECT g.content, any_value(g.group_size) AS group_size, min(d.doc_id) AS keep_id
      FROM g JOIN d ON d.content = g.content AND d.size = g.most GROUP BY g.content)
SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, sha256(d.content) AS text_sha256
FROM d JOIN k ON d.content = k.content
"""
