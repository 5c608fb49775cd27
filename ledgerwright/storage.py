"""Tables in the folder that driver and executors share, and small file operations through Hadoop's file systems."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch on the way to Python workers while a table is written; rows can be long texts or sets.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without it gets a temp folder; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"ledgerwright-{os.getpid()}")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written whole and then put in its place."""
    fs, p = _path(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def write_parts(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: lineage ends here. ``sweep`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_parts(df, path)
    _left.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of one operator run. On leaving the block all are deleted but those marked by ``keep``."""

    def __init__(self, spark: SparkSession):
        self.spark, self._mine, self._kept = spark, [], set()

    def __enter__(self):
        return self

    def written(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        out = written(df, name)
        self._mine.append(_left[-1])
        if keep:
            self._kept.add(_left[-1][1])
        return out

    def last(self) -> str:
        """The path of the table written last."""
        return self._mine[-1][1]

    def __exit__(self, *_):
        for entry in self._mine:
            if entry[1] not in self._kept:
                delete(*entry)
                _left.remove(entry)


def sweep() -> None:
    """Deletes the tables written so far; frames that read them are of no use after it. Runs when Python ends."""
    while _left:
        spark, path = _left.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, S110  (the session may be gone)
            pass


atexit.register(sweep)
