"""WARC records and a Merkle fixity audit of two replicas (native expressions).

``warc_records`` renders rows as WARC/1.0 resource records with their place in the
archive file (ordered by key). ``merkle_leaves`` hashes each record with its offset
range; ``merkle_levels`` hashes ``fanout`` neighbouring nodes, in the order of offsets,
into a node of the next level, up to one root per file. ``audit`` compares the roots of
two replicas and descends: on each level only children of nodes that differ are
compared, down to the records. Each level is written once, and so is each list of
differing nodes.

Files are dealt by a hash of the key, about ``file_records`` records to a file, so no
file holds more of a skewed key range than of any other; records with equal keys are
ordered by their hashes.

Cases: null url or html counts as empty, a null key is a key of its own that comes
first; empty html gives a record with an empty block; repeated rows are records of
their own; records that one replica lacks differ from there to the end of the file; an
empty table has no files; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FANOUT = 16


def record_bytes(key: Column, url: Column, html: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """One WARC/1.0 record: header lines, an empty line, the block and two line ends."""
    block = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    name = F.sha2(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))), 256)
    uuid = F.concat_ws("-", *(F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"),
        uuid,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), block, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def warc_records(df: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``key`` long and ``record`` binary for every row."""
    return df.select(F.col(key_col).cast("long").alias("key"), record_bytes(F.col(key_col), F.col(url_col), F.col(html_col)).alias("record"))


def file_count(records: DataFrame, file_records: int = 1024) -> int:
    return max(1, -(-records.select("key").count() // file_records))


def merkle_leaves(records: DataFrame, files: int) -> DataFrame:
    """file, leaf, offset, length, key, record_hash, hash of every record; the hash covers the offset range too."""
    name = F.pmod(F.xxhash64(F.coalesce("key", F.lit(-1)), F.when(F.col("key").isNull(), F.col("record_hash"))), F.lit(files)).cast("int")
    slim = records.select("key", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("record_hash")).withColumn("file", name)
    order = Window.partitionBy("file").orderBy(F.col("key").asc_nulls_first(), "record_hash")
    placed = slim.withColumn("leaf", F.row_number().over(order) - 1).withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return placed.withColumn("hash", F.sha2(F.concat_ws(":", "offset", "length", "record_hash"), 256)).select("file", "leaf", "offset", "length", "key", "record_hash", "hash")


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: file, leaf (number of the node) and hash of each ``fanout`` neighbours in order."""
    child = F.struct("leaf", "hash")
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(child)), lambda x: x["hash"]))
    return nodes.groupBy("file", F.floor(F.col("leaf") / fanout).cast("int").alias("parent")).agg(F.sha2(joined, 256).alias("hash")).withColumnRenamed("parent", "leaf")


def merkle_levels(leaves: DataFrame, largest: int, fanout: int, tables: Scratch) -> list[DataFrame]:
    """Levels from the leaves to the roots for files of at most ``largest`` records, each a written table."""
    levels = [leaves.select("file", "leaf", "hash")]
    while largest > 1:
        levels.append(tables.written(parents(levels[-1], fanout), "warc-level"))
        largest = -(-largest // fanout)
    return levels


def differing(x: DataFrame, y: DataFrame, within: DataFrame | None, fanout: int) -> DataFrame:
    """Nodes (file, leaf) of one level whose hashes differ or that one side lacks; only children of ``within`` are looked at."""
    if within is not None:
        branch = within.select("file", F.col("leaf").alias("up"))
        x, y = (s.withColumn("up", F.floor(F.col("leaf") / fanout).cast("int")).join(branch, ["file", "up"], "left_semi").drop("up") for s in (x, y))
    both = x.withColumnRenamed("hash", "hx").join(y.withColumnRenamed("hash", "hy"), ["file", "leaf"], "full")
    return both.where(~F.col("hx").eqNullSafe(F.col("hy"))).select("file", "leaf")


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves of replica ``a`` with ``intact``: whether replica ``b`` has the same record at the same place.

    ``a`` and ``b`` are results of ``merkle_leaves`` and should be written tables.
    Records that only ``b`` has come with null key and hash. The result is a written table.
    """
    with Scratch(a.sparkSession) as tables:
        largest = a.select("leaf").unionByName(b.select("leaf")).agg(F.max("leaf")).first()[0]
        sides = [merkle_levels(x, -1 if largest is None else largest + 1, fanout, tables) for x in (a, b)]
        bad = None
        for x, y in reversed([*zip(*sides, strict=True)]):
            bad = tables.written(differing(x, y, bad, fanout), "warc-differing")
        marked = bad.withColumn("damaged", F.lit(True))
        return tables.written(a.join(marked, ["file", "leaf"], "full").withColumn("intact", F.col("damaged").isNull()).drop("damaged"), "warc-audit", keep=True)
