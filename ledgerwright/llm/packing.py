"""Packing token sequences by minimum bin slack.

Each document's ids (with the end token) give as many full windows as they fill;
the rest is one tail shorter than a window. Tails wait in a bounded buffer. A window
takes the longest tail, then a bitset of reachable sums over the multiset of waiting
lengths finds the selection that comes closest to the room left, and backtracking
over the bitset's history gives how many of each length it uses. The tails that wait at
the end of a partition are packed the same way down to the last two windows, which are
laid end to end and cut: full windows first, then windows whose lengths are powers of
two, which need no padding.

There is no shuffle: a partition packs its own rows, memory is bounded by the buffer,
and a lost task repeats with the same result because a sequence's number is the
partition's number and a count.

Cases: a null text is empty and consists of the end token alone; null ids and
repeated rows are packed row by row; an empty table gives no rows; extra columns are
not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import rank_encoder
from .common import chunks


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that their sum is as close below ``room`` as any selection's.

    Bit s of ``reach`` says that some selection of the copies seen so far sums to s.
    """
    mask, reach, history = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            grown = reach | (reach << length & mask)
            if grown == reach:
                break
            history.append((reach, length))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    left, taken = reach.bit_length() - 1, {}
    for before, length in reversed(history):
        if not before >> left & 1:
            taken[length] = taken.get(length, 0) + 1
            left -= length
    return taken


class Packer:
    """Packs the pieces of one partition; ``rows`` of (key, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first: int, buffer: int):
        self.capacity, self.sequence, self.buffer = capacity, first, buffer
        self.tails: dict[int, list] = {}
        self.n, self.rows = 0, []

    def add(self, key, ids: np.ndarray) -> None:
        total, cap = len(ids), self.capacity
        for start in range(0, total - total % cap, cap):
            self._emit([(key, start, ids[start : start + cap], total)])
        if tail := total % cap:
            self.tails.setdefault(tail, []).append((key, total - tail, ids[total - tail :].copy(), total))
            self.n += 1
            if self.n >= self.buffer:
                while self.n > self.buffer // 2:
                    self._window()

    def _emit(self, pieces) -> None:
        at = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, ids, total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def _take(self, length: int):
        waiting = self.tails[length]
        piece = waiting.pop()
        if not waiting:
            del self.tails[length]
        self.n -= 1
        return piece

    def _window(self) -> None:
        longest = max(self.tails)
        pieces = [self._take(longest)]
        for length, count in fill(self.capacity - longest, {k: len(v) for k, v in self.tails.items()}).items():
            pieces += [self._take(length) for _ in range(count)]
        self._emit(pieces)

    def finish(self) -> None:
        """Packs down to two windows of waiting tails, then cuts these."""
        while sum(k * len(v) for k, v in self.tails.items()) > 2 * self.capacity:
            self._window()
        rest = [self._take(k) for k in sorted(self.tails, reverse=True) for _ in range(len(self.tails[k]))]
        total = sum(len(p[2]) for p in rest)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if (total % self.capacity) >> b & 1]
        at, used = 0, 0
        for size in sizes:
            pieces = []
            while size:
                key, start, ids, n = rest[at]
                part = ids[used : used + size]
                pieces.append((key, start + used, part, n))
                size, used = size - len(part), used + len(part)
                if used == len(ids):
                    at, used = at + 1, 0
            self._emit(pieces)

    def drain(self):
        rows, self.rows = self.rows, []
        return rows


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, buffer: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ``ids`` (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``buffer`` is the number of tails that wait for a fitting window.
    """

    def run(batches):
        bpe = rank_encoder(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33, buffer)
        id_type = None

        def out(rows):
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                key, start, ids, total, seq, offset = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, id_type), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())],
                    names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        for batch in chunks(batches, 200):
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(key, np.append(bpe.encode(text), np.uint32(end_id)).astype("<u4", copy=False))
            yield from out(packer.drain())
        packer.finish()
        yield from out(packer.drain())

    long = T.LongType()
    schema = T.StructType([df.schema[id_col], *(T.StructField(c, long) for c in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(c, long) for c in ("doc_tokens", "sequence_id", "offset"))])
    return df.select(id_col, text_col).mapInArrow(run, schema)
