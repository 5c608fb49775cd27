"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of a fixed number of rows (the only thing shipped to the
executors, so its size is bounded by the block, not by the table); each block's result is
written before the next begins, and the quantised vectors are written once. For each
block every candidate is scored against every query. Round by round, each partition returns a
histogram per query over the interval that still holds the kth value; the summed
histograms give the bin of the kth value, which is the next interval, until it is one
score wide. The last pass keeps scores above the kth value and, among those equal to
it, each partition's k smallest ids, which holds every winner however many ties there
are. A final window ranks a few rows per query.

Cases: vectors that are null, empty or hold null or non-finite components, and rows
with a null id, take no part; vectors of another dimension than the query's do not
meet it; fewer candidates than k give all; ties go to the smaller id; rows that repeat
an id are all candidates, except for a query of that id, and the id is asked once with
its smallest vector; an empty table gives no rows; extra columns are ignored. Scores are
exact: in double precision where the vectors' bound allows it, else in whole numbers of
any length; a score beyond a long counts whole in the ranking and is shown as the
smallest or largest long. A quantised component beyond 2^62 either way is taken as that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks

BINS = 512
_LEAST, _MOST = -(2**63), 2**63 - 1


def quantized(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """``vec_id``, ``q`` array<long>: floor(scale * x) of each usable vector."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
    fine &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(2.0**62)), F.lit(-(2.0**62))))).alias("q"))


def _matrix(column: pa.Array, dim: int, kind: type):
    """The rows of ``dim`` components as a matrix of ``kind`` (float or object, that is whole numbers), and their positions."""
    sizes = np.asarray(column.value_lengths())
    at = np.flatnonzero(sizes == dim)
    if len(at) != len(sizes):
        column = column.take(pa.array(at))
    flat = column.flatten()
    return (np.array(flat.to_pylist(), object) if kind is object else flat.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim), at


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 1024) -> DataFrame:
    """``query_id``, ``rank`` int, ``vec_id``, ``score`` long: each query's ``k`` highest integer inner products."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    with Scratch(spark) as tables:
        cand = tables.written(quantized(df, id_col, vec_col), "topk-vectors")
        asked = tables.written(quantized(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("q").alias("q")), "topk-queries")
        biggest = cand.groupBy(F.size("q").alias("dim")).agg(F.max(F.greatest(F.array_max("q"), -F.array_min("q"))).alias("top"))
        tops = {r["dim"]: r["top"] for r in biggest.collect()}  # a row for each length of vectors
        paths: list[str] = []
        edge = None
        while True:  # a block of queries at a time, in the order of ids
            rows = (asked if edge is None else asked.where(F.col("vec_id") > edge)).orderBy("vec_id").limit(block).collect()
            by_dim: dict[int, list] = {}
            for r in rows:
                by_dim.setdefault(len(r["q"]), []).append(r)
            for dim, some in sorted(by_dim.items()):
                part = _block(cand, np.array([r["vec_id"] for r in some]), [r["q"] for r in some], k, dim, tops.get(dim, 0))
                tables.written(part, "topk-block", keep=True)
                paths.append(tables.last())
            if len(rows) < block:
                break
            edge = rows[-1]["vec_id"]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _block(cand: DataFrame, ids: np.ndarray, vectors: list, k: int, dim: int, top: int) -> DataFrame:
    n = len(ids)
    most = [sum(map(abs, v)) for v in vectors]
    kind = np.float64 if max(most, default=0) * top < 2**53 else object
    whole = np.int64 if kind is np.float64 else object
    q = np.array(vectors, kind)
    low = np.array([-m * top for m in most], whole)
    width = np.maximum(1, -(-(1 - 2 * low) // BINS))  # of a bin; BINS bins from low on hold every score
    span = width * BINS  # of the interval
    left = np.full(n, k, np.int64)  # rank of the kth value within the interval
    none = -(2 * max(most, default=0) * top + 1)  # below every score
    kth, open_ = np.full(n, none, whole), np.ones(n, bool)

    def scored(batches):
        for batch in chunks(batches, 2048):
            x, at = _matrix(batch.column(1), dim, kind)
            if len(x):
                own = batch.column(0).to_numpy()[at]
                yield own, (q @ x.T).astype(whole)

    while open_.any():
        lo, wide, size, live = low.copy(), width.copy(), span.copy(), np.flatnonzero(open_)

        def histogram(batches, lo=lo, wide=wide, size=size, live=live):
            total = np.zeros((len(live), BINS), np.int64)
            for own, s in scored(batches):
                over = s[live] - lo[live, None]
                b = over // wide[live, None]
                b[(ids[live, None] == own[None, :]) | (over < 0) | (over >= size[live, None])] = BINS
                b = b.astype(np.int64)
                flat = (b + np.arange(len(live))[:, None] * (BINS + 1)).ravel()
                total += np.bincount(flat, minlength=len(live) * (BINS + 1)).reshape(len(live), BINS + 1)[:, :BINS]
            at, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(live[at].astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[at, b])], names=["i", "b", "n"])

        # at most (queries of a block) x BINS rows reach the driver
        hist = np.zeros((n, BINS), np.int64)
        for r in cand.mapInArrow(histogram, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toLocalIterator():
            hist[r["i"], r["b"]] = r["n"]
        above = hist[:, ::-1].cumsum(axis=1)[:, ::-1]  # scores in this bin or a higher one
        for i in live:
            if above[i, 0] < left[i]:  # fewer candidates than k: all of them
                open_[i] = False
                continue
            b = int(np.flatnonzero(above[i] >= left[i])[-1])
            left[i] -= above[i, b + 1] if b + 1 < BINS else 0
            low[i] += b * width[i]
            if width[i] == 1:
                kth[i], open_[i] = low[i], False
            else:
                span[i], width[i] = width[i], -(-width[i] // BINS)

    def shown(values):
        return pa.array([min(max(int(v), _LEAST), _MOST) for v in values] if kind is object else values, pa.int64())

    def winners(batches):
        ties: list[np.ndarray] = [np.empty(0, np.int64)] * n
        for own, s in scored(batches):
            s[ids[:, None] == own[None, :]] = none - 1
            i, j = np.nonzero(s > kth[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j]), shown(s[i, j]), pa.array([str(v) for v in s[i, j]], pa.string()) if kind is object else pa.nulls(len(i), pa.string())], names=names)
            for i in np.flatnonzero((s == kth[:, None]).any(axis=1) & (kth > none)):
                ties[i] = np.sort(np.concatenate([ties[i], own[s[i] == kth[i]]]))[:k]
        i = np.repeat(np.arange(n), [len(t) for t in ties])
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(np.concatenate(ties)), shown(kth[i]), pa.array([str(v) for v in kth[i]], pa.string()) if kind is object else pa.nulls(len(i), pa.string())], names=names)

    names = ["query_id", "vec_id", "score", "digits"]
    best = cand.mapInArrow(winners, "query_id long, vec_id long, score long, digits string")
    # whole numbers of any length are ranked by sign, length and digits
    minus = F.startswith("digits", F.lit("-"))
    long_order = [F.when(minus, -F.length("digits")).otherwise(F.length("digits")).desc(), F.when(minus, None).otherwise(F.col("digits")).desc(), F.when(minus, F.col("digits")).asc()]
    order = [F.desc("score")] if kind is np.float64 else long_order
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
