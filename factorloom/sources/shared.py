"""The folder that all machines of a session share, tables kept in it, and how many tasks rows are dealt to."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Rows that a task of a deal gets, about: more rows make more tasks, so what a task sorts doesn't grow with the tables.
ROWS = 500_000
#: To more tasks than this, what a task sends is sorted in its memory (spark.shuffle.sort.bypassMergeThreshold).
UNSORTED = 200


def tasks(spark: SparkSession, rows: int, scanned: bool = False) -> tuple[int, ...]:
    """What ``repartition`` takes before its keys: a number of tasks, where the session's would get more than ROWS each; else nothing.

    Rows that come straight from files are ``scanned``: in large splits, which would be sorted as they are sent to more than UNSORTED tasks.
    They go to no more than these, unless each then got over four times ROWS.
    """
    usual, need = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)
    if scanned:
        need = max(min(max(need, usual), UNSORTED), -(-need // 4))
        return (need,) if need != usual else ()
    return (need,) if need > usual else ()


def deal(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df, of about so many rows, dealt by keys to the tasks they need; as it is where the session's number does (or rows aren't known), as what follows deals it."""
    n = tasks(df.sparkSession, rows or 0)
    return df.repartition(*n, *keys) if n else df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the checkpoint folder set on its context.

    Only with a local master that names neither (tests, one machine) a temporary folder is made and set.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = tempfile.mkdtemp(prefix="factorloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def keep(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder: what starts from it doesn't compute it again, nor do lost executors lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
