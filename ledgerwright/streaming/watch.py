"""Watching a directory: settled files, and an idempotent batch per trigger."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import delete, exists, listed, put

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
STATE = "path string, mtime timestamp, size long, quiet boolean, ready boolean"
_log = logging.getLogger(__name__)


def settled(observations: DataFrame) -> DataFrame:
    """When each path is ready: the first poll at which time and size are as at the poll before.

    ``observations``: poll int, path, mtime, size. A path missing from a poll starts
    anew; a path that changes after it was ready is ready again later.
    """
    w = Window.partitionBy("path").orderBy("poll")
    same = (F.lag("poll").over(w) == F.col("poll") - 1) & F.lag("mtime").over(w).eqNullSafe(F.col("mtime")) & F.lag("size").over(w).eqNullSafe(F.col("size"))
    marked = observations.withColumn("same", F.coalesce(same, F.lit(False)))
    first = marked.withColumn("before", F.coalesce(F.lag("same").over(w), F.lit(False))).where("same and not before")
    return first.select("path", "poll", "mtime", "size")


def next_state(before: DataFrame, seen: DataFrame, first: bool = False) -> DataFrame:
    """STATE after a poll: ``quiet`` where time and size are as before, ``ready`` where that is so for the first time.

    ``seen``: path, mtime, size. Paths that are gone leave the state. On the ``first`` poll
    every file there is ready at once.
    """
    old = before.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.col("quiet").alias("_q"))
    both = seen.join(old, "path", "left")
    quiet = F.lit(True) if first else F.coalesce(F.col("_s").isNotNull() & F.col("mtime").eqNullSafe(F.col("_m")) & (F.col("size") == F.col("_s")), F.lit(False))
    return both.withColumn("quiet", quiet).withColumn("ready", F.col("quiet") & (F.lit(first) | ~F.coalesce("_q", F.lit(False)))).select("path", "mtime", "size", "quiet", "ready")


def snapshot(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, mtime, size of the files there now; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return raw.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def poll(spark: SparkSession, path: str, states: str, number: int, each: Callable[[DataFrame, int], None], recursive: bool = True) -> int:
    """One round: files that have settled go to ``each``; the number of them.

    The state of round n is a table made from round n - 1, so a round that is run again
    finds the same files. An error in ``each`` is logged and the timers start anew: the
    next round waits for files to settle once more, and hands them over again.
    """
    found = [int(n) for n in listed(spark, states) if n.isdigit() and int(n) < number and exists(spark, f"{states}/{n}/DONE")]
    before = spark.read.parquet(f"{states}/{max(found)}/table") if found else spark.createDataFrame([], STATE)
    here = f"{states}/{number}"
    next_state(before, snapshot(spark, path, recursive), first=not found).write.mode("overwrite").parquet(f"{here}/table")
    ready = spark.read.schema(STATE).parquet(f"{here}/table").where("ready").select("path")
    n = ready.count()
    if n:
        try:
            raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
            each(raw.join(ready, "path", "left_semi"), number)
        except Exception:
            _log.exception("round %d failed; its files are tried again", number)
            spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{here}/table")
            n = 0
    put(spark, f"{here}/DONE", b"")
    for old in sorted(found)[:-1]:
        delete(spark, f"{states}/{old}")
    return n


def watch_settled(spark: SparkSession, path: str, each: Callable[[DataFrame, int], None], states: str, seconds: float = 5, recursive: bool = True):
    """A streaming query that polls ``path`` every ``seconds``: all files first, then those that have settled.

    ``each(files, round)`` gets rows of binaryFile and should merge by content hash.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, k: poll(spark, path, states, k, each, recursive) and None)
    return writer.option("checkpointLocation", f"{states}/ticks").trigger(processingTime=f"{seconds} seconds").start()


def watch(spark: SparkSession, path: str, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 5, once: bool = False):
    """Calls ``each(files, batch_id)`` for new files; producers should rename finished files into the directory.

    ``each`` should merge by content hash, so that a repeated batch changes nothing.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(path)
    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def book_into(spark: SparkSession, state: str, **settings) -> Callable[[DataFrame, int], None]:
    """An ``each`` that books files into the ledger saved under ``state``; run twice on the same files it changes nothing."""
    from ..plans.batch import run_batch
    from ..plans.sinks import drop_old_states, load_state, save_state
    from ..sources.files import named_files, read_views

    def each(raw: DataFrame, _: int) -> None:
        ledger, issues = load_state(spark, state) or (None, None)
        cfg = {"cfg": settings["cfg"]} if "cfg" in settings else {}
        views = read_views(named_files(raw), *cfg.values(), engine=settings.get("engine"))
        done = run_batch(spark, views, ledger, issues, **{k: v for k, v in settings.items() if k != "engine"})
        save_state(done.ledger, done.issues, state)
        drop_old_states(spark, state)

    return each
