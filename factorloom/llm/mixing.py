"""Operator 9, mixing sources to target weights by blocks.

The words of a source, document after document, are packed into blocks of fixed length: ``BLOCK`` words, or a
hundredth of the source's target where that is less, so that a whole number of blocks comes near any target. A source's
quota is its target in blocks. The mix has as many slots as all quotas; ``SHARD`` slots are an output shard.
Each slot draws a place in the line of all quotas and with it a source, so a shard's source counts are
multinomial with the quotas as weights. Draws of a source beyond its quota go on to the sources that drew too few, in order,
so the totals are the quotas exactly. Slot number i of a source maps to the block at i mod B of its
pseudorandom permutation number i div B (a Feistel network with cycle walking), so no block is taken more than
once more than any other, and none more than ``most`` times. Blocks and document pieces are joined by block index.

Nothing depends on how many sources, slots or rows there are: sources are a table, ranked and summed in ranges
(``running``); the target level is found by resharing over that table until no source is above its cap; which source a
draw belongs to is the last quota that begins before it in its cell of ``CELL`` places. Where a document's words begin
in its source's stream is a prefix sum in two steps: within one of sqrt(rows) hash buckets, and over the buckets
of a source. Windows over a source have a row for each of its cells or buckets.

Edge cases: a null text has size 0; documents of size 0 take 0. A null source is a source, the last one.
Repeated rows are separate documents; equal ones are counted before they are placed, and told apart again by their
places, so many of them are no hot group in ``mix``. In ``mixed_documents`` the rows that agree in doc_id, source and whole text
meet in one task. An empty table gives no rows. Extra columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpoint

#: Fixed values of the contract: weights of the sources by code point, repeating; most times a word is taken.
WEIGHTS, MOST = (5, 2, 1), 3
BLOCK, SHARD, CELL, SEED = 64, 4096, 65536, 20240229


def _hash(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit mixer of x under key."""
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def permute(i: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where the pseudorandom permutation ``key`` of range(size) puts each i; i, size and key are arrays of one length."""
    size, key = np.asarray(size, np.uint64), np.asarray(key, np.uint64)
    bits = np.frexp((size - np.uint64(1)).astype(np.float64))[1]  # at least the bits of size - 1
    half = np.maximum(1, (bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = np.array(i, np.uint64), np.arange(len(i))
    while len(left):
        h, m, k = half[left], mask[left], key[left] * np.uint64(31)
        a, b = out[left] >> h, out[left] & m
        for r in range(4):
            a, b = b, a ^ (_hash(b, k + np.uint64(r)) & m)
        out[left] = (a << h) | b
        left = left[out[left] >= size[left]]  # outside: walk on
    return out.astype(np.int64)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with ``pos``, the number of rows before a row by ``order``, and for each of ``sums`` the sum over these rows.

    Rows are dealt into ranges of the order; one row a range (as many as shuffle partitions) passes the driver.
    """
    rows = checkpoint(df.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    names = ["pos", *sums]
    parts = rows.groupBy("_part").agg(F.count("*").alias("pos"), *(F.sum(f"_{k}").alias(k) for k in sums)).orderBy("_part").collect()
    total, before = [0] * len(names), []
    for r in parts:
        before.append((r["_part"], *total))
        total = [t + (r[n] or 0) for t, n in zip(total, names, strict=True)]
    starts = df.sparkSession.createDataFrame(before, ", ".join(["_part int", *(f"_from_{n} long" for n in names)]))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(starts), "_part")
    out = out.withColumns({"pos": F.count("*").over(w) + F.col("_from_pos"), **{k: F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)) + F.col(f"_from_{k}") for k in sums}})
    return out.drop("_part", *(f"_{k}" for k in sums), *(f"_from_{n}" for n in names))


def sources(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, rank (by code point, null last), source_size, target of the rows (source, size); a row a source.

    The level (words a unit of weight) is raised by what capped sources leave until none is newly above its cap. That
    is Newton's method on a concave sum of straight pieces, so the passes are few however many sources there are.
    """
    sums = sizes.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum("size").alias("source_size"))
    ranked = running(sums, [F.col("source").asc_nulls_last()], {}).withColumnRenamed("pos", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = checkpoint(ranked.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * most}))
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * level
        r = ranked.agg(F.sum("source_size").alias("size"), F.sum(F.when(above, F.col("cap"))).alias("cap"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count_if(above).alias("n")).first()
        if r["n"] == capped:
            break
        capped = r["n"]
        level = ((r["size"] or 0) - (r["cap"] or 0)) / r["weight"] if r["weight"] else 0.0
    return ranked.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def packed(known: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``sources`` with length (words of a block), blocks, quota (blocks to take, repeats counted) and start (all quotas before)."""
    length = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("target") / 100))).cast("long")
    rows = known.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    whole = F.col("target") >= F.col("source_size") * most  # at its cap: all of it, as often as can be
    rows = rows.withColumn("quota", F.when(whole, F.col("blocks") * most).otherwise(F.least(F.round(F.col("target") / F.col("length")).cast("long"), F.col("blocks") * most)))
    return running(rows, [F.col("rank")], {"start": F.col("quota")}).drop("pos")


def _owners(points: DataFrame, spans: DataFrame, cell: int = CELL) -> DataFrame:
    """points (place, ...) with cell, rank and begin of the span (rank, begin, n) that each place is in."""
    cells = F.explode(F.sequence(F.expr(f"begin div {cell}"), F.expr(f"(begin + n - 1) div {cell}")))
    marks = spans.filter("n > 0").select("rank", "begin", cells.alias("cell"))
    marks = marks.withColumns({"place": F.greatest(F.col("begin"), F.col("cell") * cell), "point": F.lit(False)})
    every = points.withColumns({"cell": F.expr(f"place div {cell}"), "point": F.lit(True)}).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("cell").orderBy("place", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("rank", "begin")}).filter("point").drop("point")


def slots(known: DataFrame, shard: int = SHARD, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """The mix: shard, slot, rank (of the source), epoch, block. ``known`` is what ``packed`` makes."""
    spark = known.sparkSession
    n = known.agg(F.sum("quota")).first()[0] or 0
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, n // 1_000_000)))
    drawn = spark.range(0, n, 1, tasks).select(F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n, 1))).alias("place"))
    owned = _owners(drawn, known.select("rank", F.col("start").alias("begin"), F.col("quota").alias("n")), cell)
    number = F.row_number().over(Window.partitionBy("cell", "rank").orderBy("place", "slot"))
    owned = checkpoint(owned.select("slot", "rank", "cell", (number - 1).cast("long").alias("number")))
    cells = owned.groupBy("rank", "cell").agg(F.count("*").alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(Window.partitionBy("rank").orderBy("cell")) - F.col("n"))
    made = cells.groupBy("rank").agg(F.sum("n").alias("drawn"))
    fate = known.select("rank", "quota", "blocks").join(made.hint("merge"), "rank", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    fate = checkpoint(running(fate, [F.col("rank")], {"over": F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), "lack": F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))}).drop("pos"))
    cells = cells.join(fate.hint("merge"), "rank").select("rank", "cell", "before", "quota", "blocks", "over")
    numbered = owned.join(cells.hint("merge"), ["rank", "cell"]).withColumn("i", F.col("before") + F.col("number"))
    kept = numbered.filter("i < quota").select("slot", "rank", "i", "blocks")
    spare = numbered.filter("i >= quota").select("slot", (F.col("over") + F.col("i") - F.col("quota")).alias("place"))
    short = fate.filter("quota > drawn")
    moved = _owners(spare, short.select("rank", F.col("lack").alias("begin"), (F.col("quota") - F.col("drawn")).alias("n")), cell)
    moved = moved.join(short.select("rank", "drawn", "blocks").hint("merge"), "rank").select("slot", "rank", (F.col("drawn") + F.col("place") - F.col("begin")).alias("i"), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot, rank, i, blocks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "rank", "i", "blocks"))
            epoch = i // np.maximum(blocks, 1)
            key = _hash(rank.astype(np.uint64), np.uint64(seed)) + epoch.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot // shard, slot % shard, rank, epoch, permute(i % np.maximum(blocks, 1), blocks, key))], ["shard", "slot", "rank", "epoch", "block"])

    return kept.unionByName(moved).mapInArrow(run, "shard long, slot long, rank long, epoch long, block long")


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key (a hash of the text) and copies (rows that agree in all of these) of docs; the text is read here only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("key"))
    return checkpoint(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")))


def placed(counted: DataFrame) -> DataFrame:
    """A row for each copy: what ``_counted`` made, copy (its number) and at (words of its source before it)."""
    n = max(1, int(counted.count() ** 0.5))
    rows = counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(n)))
    words = F.col("size") * F.col("copies")
    totals = rows.groupBy("source", "bucket").agg(F.sum(words).alias("total"))
    starts = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("total").over(Window.partitionBy("source").orderBy("bucket")) - F.col("total")).alias("start"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum(words).over(within))
    rows = rows.join(starts.hint("merge"), rows["source"].eqNullSafe(starts["s"]) & (rows["bucket"] == starts["b"])).withColumn("first", F.col("start") + F.col("upto") - words)
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 65536"))))  # arrays of copies stay short
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("lot") * 65536, F.least(F.col("copies"), (F.col("lot") + 1) * 65536) - 1)))
    return rows.select("doc_id", "source", "size", "key", "copy", (F.col("first") + F.col("copy") * F.col("size")).alias("at"))


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each block that a document has words in: block, words (how many), first (word of the document)."""
    last = F.when(F.col("size") > 0, F.sequence(F.expr("at div length"), F.expr("(at + size - 1) div length")))
    out = rows.withColumn("block", F.explode_outer(last))
    lo, hi = F.greatest(F.col("at"), F.col("block") * F.col("length")), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    return out.withColumns({"words": hi - lo, "first": lo - F.col("at")})


def _plan(docs: DataFrame, weights: tuple, most: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The placed documents with what is known of their sources, and the slots."""
    counted = _counted(docs)
    known = checkpoint(packed(sources(counted.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, most), block, most))
    k = known.select(F.col("source").alias("s"), "rank", "source_size", "target", "length")
    rows = placed(counted)
    return rows.join(k, rows["source"].eqNullSafe(k["s"])).drop("s"), slots(known, SHARD, seed)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken."""
    rows, drawn = _plan(docs, weights, most, block, seed)
    times = drawn.groupBy("rank", "block").agg(F.count("*").alias("times"))
    # the plan can't know how many blocks the drawing makes: without the hint it would broadcast them
    taken = _pieces(rows).join(times.hint("merge"), ["rank", "block"], "left").withColumn("n", F.coalesce(F.col("times") * F.col("words"), F.lit(0)))
    key = ["doc_id", "rank", "key", "copy", "size", "source_size", "target"]
    return taken.groupBy(*key).agg(F.sum("n").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them, same columns: a row for each document and round (epoch) that takes any of its words.

    A row whose document is taken whole keeps its text; of others the taken words stay, in their order, with
    single spaces between. ``n_chars``, where there is such a column, is the new length. Documents without words don't appear.
    The texts are moved once, to the plan of their pieces, which is made of narrow rows.
    """
    rows, drawn = _plan(docs, weights, most, block, seed)
    parts = _pieces(rows.filter("size > 0")).join(drawn.select("rank", "block", "epoch").hint("merge"), ["rank", "block"]).groupBy("doc_id", "source", "key", "copy", "size", "epoch").agg(
        F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"))  # at most size / length + 2 of them
    plan = parts.groupBy(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("key").alias("h")).agg(F.first("size").alias("size"), F.collect_list(F.struct("copy", "words", "parts")).alias("rounds"))
    columns = docs.columns
    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), {"_d": F.col("doc_id"), "_s": F.col("source").cast("string")}
    whole = docs.select(*(F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(columns)), *(v.alias(k) for k, v in key.items()), F.xxhash64(text).alias("_h"))
    whole = whole.withColumn("_copy", F.row_number().over(Window.partitionBy("_d", "_s", "_h").orderBy("_d")) - 1)
    out = whole.join(plan.hint("merge"), whole["_d"].eqNullSafe(plan["d"]) & whole["_s"].eqNullSafe(plan["s"]) & (whole["_h"] == plan["h"]))
    out = out.withColumn("_round", F.explode(F.filter("rounds", lambda r: r["copy"] == F.col("_copy"))))
    text = F.col(f"_keep{columns.index('text')}").cast("string")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(F.col("_round")["parts"], lambda x: F.slice(words, (x["first"] + 1).cast("int"), x["words"].cast("int")))), " ")
    out = out.withColumn("_text", F.when(F.col("_round")["words"] == F.col("size"), text).otherwise(cut))

    def column(i: int, c: str) -> Column:
        if c == "text":
            return F.col("_text").alias(c)
        return F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col(f"_keep{i}").alias(c)

    return out.select(*(column(i, c) for i, c in enumerate(columns)))
