"""What the operators share: reading documents, durable checkpoints, the fold rule."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir of the session.

    Only where the session names none and has a local master (tests, one machine) a temporary folder is made and set.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = tempfile.mkdtemp(prefix="factorloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, with its lineage cut: lost executors don't lose it.

    Shuffle files and older checkpoints that only the cut lineage referred to are deleted when the driver's JVM collects
    garbage. It may go without for many rounds of a loop, and their files would pile up; so it is asked to.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    spark.sparkContext._jvm.System.gc()
    return out


def fold(doc_id: str | Column, k: int = 5) -> Column:
    """crc32 of the doc_id as text, modulo k; a null doc_id counts as an empty text, so 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def strip_spaces(c: Column) -> Column:
    """c without any character of [\x20\x09-\x0D]; byte-wise replace is much faster than a regex here."""
    for s in SPACES:
        c = F.replace(c, F.lit(s), F.lit(""))
    return c


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches, rows: int = 256):
    """Arrow batches in small pieces: what is made of a whole batch as Python objects can be many times its size."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def portions(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 1 << 20):
    """An Arrow batch in pieces of at most ``rows`` rows and, beyond one row, ``size`` bytes in a column of texts or binaries."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        fits = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, "right"))
        hi = min(max(fits, lo + 1), lo + rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


#: Bits of the filter below: at most 2**24 / 64 rows are broadcast, however many keys there are.
FILTER_BITS = 1 << 24


def maybe_among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df with ``maybe``: false only where its ``column`` is surely not in the one column of ``keys`` (null is a key like others).

    A bitmap of fixed size over hashes of the keys is joined by broadcast. With very many keys more rows
    are "maybe"; none is ever wrongly false. So a shuffle join need only move the rows that are true.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    k = keys.select(place(keys.columns[0]).alias("p"))
    words = k.groupBy(F.floor(F.col("p") / 64).alias("__filter_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("__filter_bits"))
    out = df.withColumn("__filter_place", place(column)).withColumn("__filter_word", F.floor(F.col("__filter_place") / 64)).join(F.broadcast(words), "__filter_word", "left")
    hit = F.expr("shiftrightunsigned(__filter_bits, cast(__filter_place % 64 as int)) & 1L") == 1
    return out.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("__filter_word", "__filter_bits", "__filter_place")
