"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import Scratch, written

__all__ = ["SPACE", "Memo", "Scratch", "chunks", "few_files", "table", "written"]

#: ASCII white space of the text contracts: space and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_files(df: DataFrame, most: int = 32) -> DataFrame:
    """``df``, a plain Parquet table, or that many of its files, evenly spaced, if it has more: for samples that need not read the table."""
    files = sorted(df.inputFiles())
    if len(files) <= most:
        return df
    return df.sparkSession.read.schema(df.schema).parquet(*(files[k * len(files) // most] for k in range(most)))


class Memo(dict):
    """A bounded memo: ``make(key)`` on a miss, everything forgotten at ``limit`` entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def chunks(it, size: int):
    """Record batches cut to at most ``size`` rows."""
    for batch in it:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
