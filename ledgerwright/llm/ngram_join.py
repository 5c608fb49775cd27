"""Jaccard join of word-shingle sets by parity sketches.

A set's parity sketch is a string of 2^40 bits in which each shingle flips one bit, so two
sets' sketches differ in at most as many bits as the sets differ in shingles. Two sets of
sizes a and b with Jaccard similarity of at least 3/4 differ in at most D = (a + b) // 7.

Candidates, by pigeonhole within size bands: the sketch is cut into pieces of equal
length, more than D of them, so at most D pieces differ. Bands grow by a factor of four, the
number of pieces belongs to the band of the larger set, and sets near an edge take part in
two bands. Sketches are sparse; a piece is known by a 64-bit code of the places of its one
bits, and only pieces that are not zero are looked at. A set shows the first D + 1 of them in
a global order (frequent codes of a bounded sample last, then by code): two sets whose
pieces differ in no more than D share one of these, whatever the order. A set with no more
than D pieces that are not zero shows all, and, for others of that kind, the first D + 1 of
its sketch cut into single bits. So no link is lost.

Screening: the sketch folded to a few bits per shingle still bounds the difference from
below; candidates whose folded sketches have a Hamming distance over D are dropped, the
others are verified on the whole sets.

Sets that show the same code form a group. Groups are streamed in range partitions, so a
code that very many sets show is dealt over as many tasks as its rows need: in each the
smallest member is compared with the others, and these smallest with each other. The
links found are joined to components. Members of a group that are still in different
components are compared among themselves where their sizes fit (by buckets of size, each
member in two), in blocks of bounded size: first each with its nearest, which joins most of
what belongs together, then, over the components left, all.

Equal sets are one class, known by the set's 128-bit hash: one member shows codes for
each input task, and the smallest id stands for all in pairs, groups and sketches.

Cases: null and empty texts, and texts of white space, have empty sets and are linked
with nothing; texts of one to four words have one shingle; rows with a null id come
back with a null component and are linked with nothing; rows that share an id are one
node with the links of all; repeated rows come back repeated; extra columns are not
carried; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks
from .components import connected_components

WORDS, SKETCH_BITS = 5, 40
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Members of a group that are compared in one block, share of rows that are sampled for the order, and frequent codes kept of it.
GROUP_BLOCK, ORDER_SHARE, ORDER_KEPT = 1024, 0.12, 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles."""
    words = text.encode().lower().split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, WORDS)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _M1 + w[k : n - size + 1 + k]
    h = _mixed(h)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def most_apart(n: int, m: int) -> int:
    """The largest symmetric difference of linked sets of sizes n and m."""
    return (n + m) // 7


def _band(n: int) -> int:
    return (n.bit_length() - 1) // 2  # sizes from 4^s to 4^(s+1) - 1


def sketch(u: np.ndarray) -> np.ndarray:
    """The places (40 bits, sorted) of the one bits of a set's parity sketch."""
    places = u >> np.uint64(64 - SKETCH_BITS)
    starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(u) else np.empty(0, np.int64)
    if len(starts) == len(u):
        return places
    return places[starts][np.diff(np.r_[starts, len(u)]) % 2 == 1]


def _pieces(band: int) -> int:
    return max(16, 4 ** (band + 1) * 2 // 5)


def piece_codes(places: np.ndarray, band: int) -> np.ndarray:
    """Codes of the pieces of a sketch that are not zero: the XOR of their bits' codes, mixed with piece and band."""
    piece = places * np.uint64(_pieces(band)) >> np.uint64(SKETCH_BITS)
    starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    bits = np.bitwise_xor.reduceat(_mixed(places + _M1), starts)
    return _mixed(bits + piece[starts] * _M1 + np.uint64((band + 1) * int(_M3) % 2**64))


def shown(u: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The codes that a set shows (uint64); ``frequent`` is sorted."""
    places, n = sketch(u), len(u)
    if not len(places):
        return places
    own, most, out = _band(n), n * 4 // 3, []
    for band in {own, _band(most)}:
        d = most_apart(n, min(most, 4 ** (band + 1) - 1))
        p = piece_codes(places, band)
        if len(p) <= d:
            single = np.sort(_mixed(places ^ _M2))
            out += [p, _mixed(single[: most_apart(n, most) + 1])]
            continue
        if len(frequent):
            often = frequent[np.searchsorted(frequent, p).clip(max=len(frequent) - 1)] == p
            rare = p[~often]
            if len(rare) <= d:
                out.append(rare)
                p, d = p[often], d - len(rare)
            else:
                p = rare
        out.append(np.partition(p, d)[: d + 1])
    return np.concatenate(out)


def bit_sketch(u: np.ndarray) -> np.ndarray:
    """The sketch folded to two bits (four below 256 shingles) for each of the set's size rounded up to a power of four."""
    band = _band(max(1, len(u)))
    bits = max(64, (4 if band <= 3 else 2) * 4 ** (band + 1))
    ones = np.bincount((sketch(u) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8))


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A folded sketch with fewer bits: the XOR of its parts (places are taken modulo the size)."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union."""
    n, m = len(a), len(b)
    if not n or not m or 4 * min(n, m) < 3 * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 4 * common >= 3 * (n + m - common)


def _sets(docs: DataFrame, path_schema: str, make):
    def run(batches):
        for batch in chunks(batches, 500):
            yield from make(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    return docs.mapInArrow(run, path_schema)


def _batch(names: str, types, rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names.split())


def _classes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """id, n, d1, d2, sketch, shown of every row: the set's size, 128-bit hash, bit sketch and packed signatures.

    A class shows its signatures by its first row in a task; the others have null.
    """

    def run(batches):
        seen: set[bytes] = set()
        for batch in chunks(batches, 500):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u = shingle_set(text)
                digest, packed = xxhash.xxh3_128_digest(u.tobytes()), None
                if doc is not None and len(u) and digest not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(digest)
                    packed = shown(u, frequent).tobytes()
                out.append((doc, len(u), *struct.unpack(">qq", digest), bit_sketch(u).tobytes(), packed))
            yield _batch("id n d1 d2 sketch shown", [pa.int64()] * 4 + [pa.binary()] * 2, out)

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, sketch binary, shown binary")


def _signatures(classes: DataFrame) -> DataFrame:
    """sig, node: a row for each signature."""

    def run(batches):
        for batch in chunks(batches, 1000):
            packed = batch.column(1).to_pylist()
            counts = [len(x) // 8 for x in packed]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), counts))], names=["sig", "node"])

    return classes.where("shown is not null").select("id", "shown").mapInArrow(run, "sig long, node long")


def _groups(signatures: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of each group's smallest member with the others, and the members (sig, id) that may yet have a partner.

    Rows are range-partitioned by code and member and streamed. The smallest member that a
    task sees of a code stands for those in the task; of a code that goes on in other tasks
    (the first or last of a task may) these are compared with the smallest of all.
    """

    def run(batches):
        sig, pivot, count, first = None, None, 0, True

        def edge():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((sig, pa.int64()), (pivot, pa.int64()), (pivot, pa.int64()), (True, pa.bool_()))], names=["sig", "pivot", "node", "edge"])

        for batch in batches:
            s, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(s):
                continue
            new = np.r_[sig is None or s[0] != sig, s[1:] != s[:-1]]
            starts = np.flatnonzero(new)
            if first and sig is not None and len(starts):
                yield edge()  # the first code of the task is over
                first = False
            pivots = np.r_[node[starts], 0 if pivot is None else pivot][np.cumsum(new) - 1]  # -1: the run before goes on
            if first and len(starts) > 1:
                sig, pivot = s[0], pivots[0]
                yield edge()
                first = False
            sig, pivot = int(s[-1]), int(pivots[-1])
            at = np.flatnonzero(pivots != node)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(pivots[at]), pa.array(node[at]), pa.array(np.zeros(len(at), bool))], names=["sig", "pivot", "node", "edge"])
        if sig is not None:
            yield edge()

    streamed = signatures.repartitionByRange("sig", "node").sortWithinPartitions("sig", "node")
    rows = tables.written(streamed.mapInArrow(run, "sig long, pivot long, node long, edge boolean"), "join-groups")
    inner = rows.where("not edge").select("sig", "pivot", "node")
    edges = rows.where("edge").select("sig", "node").distinct()  # two rows of a task at most
    over = edges.groupBy("sig").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("k")).where("k > 1")
    across = edges.join(F.broadcast(over), "sig").select("sig", "pivot", "node")
    pairs = inner.select(F.col("pivot").alias("a"), F.col("node").alias("b")).union(across.where("node <> pivot").select("pivot", "node")).distinct()
    return pairs, inner.select("sig", F.col("node").alias("id")).union(across.select("sig", "node"))


def _of_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``nodes`` (id); broadcast only where the counted ids are few."""
    n = nodes.count()
    side = F.broadcast(nodes) if n <= 1_000_000 else nodes
    return docs.join(side, "id", "left_semi").select("id", "text")


def _near(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether sizes and bit sketches allow a link."""
    if 4 * min(n, m) < 3 * max(n, m):
        return False
    size = min(len(a), len(b))
    x, y = (fold(np.frombuffer(s, np.uint8), size) for s in (a, b))
    return int(np.bitwise_count(x ^ y).sum()) <= most_apart(n, m)


def _plausible(reps: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class representatives that sizes and bit sketches don't exclude; sizes come first, they are narrow."""

    def sized(x):
        return reps.select(F.col("id").alias(x), F.struct(F.col("rep").alias("id"), "n").alias(f"s{x}"))

    def side(x):
        return sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def run(batches):
        for batch in chunks(batches, 5000):
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            ok = [_near(*v) for v in zip(x, n, y, m, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    fitting = pairs.join(sized("b"), "b").join(sized("a"), "a").where("sa.id <> sb.id and 4 * least(sa.n, sb.n) >= 3 * greatest(sa.n, sb.n)")
    fitting = fitting.select(F.least("sa", "sb").alias("x"), F.greatest("sa", "sb").alias("y"))
    fitting = fitting.select(F.col("x.id").alias("a"), F.col("x.n").alias("na"), F.col("y.id").alias("b"), F.col("y.n").alias("nb")).distinct()
    drawn = fitting.join(side("b"), ["b", "nb"]).join(side("a"), ["a", "na"])
    return drawn.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, tables: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are linked, checked on the whole sets."""

    def make(rows):
        got = {(doc, shingle_set(text).tobytes()) for doc, text in rows}
        yield _batch("id u", [pa.int64(), pa.binary()], sorted(got))

    nodes = tables.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "join-nodes")
    sets = tables.written(_sets(_of_nodes(docs, nodes), "id long, u binary", make), "join-sets")
    left = sets.select(F.col("id").alias("a"), F.col("u").alias("ua"))
    right = sets.select(F.col("id").alias("b"), F.col("u").alias("ub"))

    def check(batches):
        for batch in chunks(batches, 500):
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ua", "ub").mapInArrow(check, "a long, b long")


def cross_pairs(held: list[tuple], between: bool, nearest: bool = False) -> set[tuple[int, int]]:
    """Pairs of members (id, component, cell, n, sketch) in different components that the sketches don't exclude.

    ``between``: only pairs from two cells. ``nearest``: one partner for each member, of
    the smallest distance.
    """
    best: dict[int, tuple] = {}
    most = max(Counter(h[1] for h in held).items(), key=lambda x: (x[1], -x[0]))[0] if nearest else None
    out: set[tuple[int, int]] = set()
    by_size: dict[int, list[tuple]] = {}
    for h in held:
        by_size.setdefault(len(h[4]), []).append(h)
    sides = []
    for size, rows in sorted(by_size.items()):
        bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), size)
        sides.append((size, bits, *(np.array([r[k] for r in rows]) for k in range(4))))
    for i, (size, bits, ids, comps, cells, ns) in enumerate(sides):
        for j, (other, more, ids2, comps2, cells2, ns2) in enumerate(sides[i:]):
            folded = np.bitwise_xor.reduce(more.reshape(len(more), other // size, size), axis=1)
            for r in range(len(ids)):
                at = np.flatnonzero((comps2 != comps[r]) & (4 * np.minimum(ns2, ns[r]) >= 3 * np.maximum(ns2, ns[r])) & ((cells2 != cells[r]) | (not between)))
                if j == 0:
                    at = at[at > r]
                if len(at):
                    apart = np.bitwise_count(folded[at] ^ bits[r]).sum(axis=1, dtype=np.int64)
                    fits = apart <= (ns2[at] + ns[r]) // 7
                    at, apart = at[fits], apart[fits]
                    if not nearest:
                        out.update((min(int(ids[r]), x), max(int(ids[r]), x)) for x in ids2[at].tolist())
                    elif len(at):
                        k = int(apart.argmin())
                        best[int(ids[r])] = min(best.get(int(ids[r]), (1 << 60, 0)), (int(apart[k]), int(ids2[at[k]])))
                        for x, d in zip(ids2[at].tolist(), apart.tolist(), strict=True):
                            if d < best.get(x, (1 << 60, 0))[0]:
                                best[x] = (d, int(ids[r]))
    if nearest:  # the largest component waits for the others to choose
        out = {(min(h[0], best[h[0]][1]), max(h[0], best[h[0]][1])) for h in held if h[1] != most and h[0] in best}
    return out


def _cross_pairs(sketches: DataFrame, members: DataFrame, nearest: bool) -> DataFrame:
    """``cross_pairs`` of the members (sig, id, c, n) of each group; large groups are dealt to cells, and pairs of cells to tasks.

    Rows (sig, a, b); a group whose pairs have all come out before has one row without a pair.
    """
    sized = members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).cast("int").alias("k"))
    dealt = members.join(sized, "sig").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    cells = dealt.select("sig", "id", "c", "n", "cell", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    cells = cells.select("sig", F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"), "id", "c", "n", "cell")
    full = cells.join(sketches.select("id", "n", "sketch"), ["id", "n"]).select("sig", "x", "y", "id", "c", "cell", "n", "sketch")

    def run(batches):
        key, held, sent = None, [], set()

        def pairs():
            if len({h[1] for h in held}) < 2 or not (found := cross_pairs(held, key[1] != key[2], nearest)):
                return _batch("sig a b", [pa.int64()] * 3, [])
            if len(sent) > 100_000:
                sent.clear()
            new = sorted(found - sent) or [(None, None)]
            sent.update(found)
            return _batch("sig a b", [pa.int64()] * 3, [(key[0], *x) for x in new])

        for batch in chunks(batches, 2000):
            for *k, doc, c, cell, n, sketch in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != key:
                    if held:
                        yield pairs()
                    key, held = k, []
                held.append((doc, c, cell, n, sketch))
        if held:
            yield pairs()

    return full.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(run, "sig long, a long, b long")


def _codes(docs: DataFrame) -> DataFrame:
    """sig: the codes that the classes of ``docs`` show where none is frequent.

    In one step, not by ``_classes`` and ``_signatures``: a second Python worker for each
    task would stay, with its memory, until the join ends.
    """

    def run(batches):
        none, seen = np.empty(0, np.uint64), set()
        for batch in chunks(batches, 500):
            out = [none]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u = shingle_set(text)
                digest = xxhash.xxh3_128_digest(u.tobytes())
                if doc is not None and len(u) and digest not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(digest)
                    out.append(shown(u, none))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["sig"])

    return docs.mapInArrow(run, "sig long")


def _frequent(docs: DataFrame) -> np.ndarray:
    """Codes shown three times or more by a sample of ORDER_SHARE of the rows; they only come last in the order."""
    few = docs.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(ORDER_SHARE * 1_000_000))
    rows = _codes(few).groupBy("sig").count().where("count > 2").orderBy(F.desc("count"), "sig").limit(ORDER_KEPT).collect()
    return np.sort(np.array([r["sig"] for r in rows], np.int64).view(np.uint64))


def _labelled(frame: DataFrame, found: DataFrame, col: str, out: str) -> DataFrame:
    return frame.join(found.select(F.col("id").alias(col), F.col("component").alias(out)), col, "left").withColumn(out, F.coalesce(out, col))


def size_bucket(n: Column) -> Column:
    """The power of 4/3 that a size reaches: sizes that fit each other are in the same bucket or in the next."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")


def _mixed_members(groups: DataFrame, nodes: DataFrame, split: bool, tables: Scratch) -> DataFrame:
    """sig, id, c, n: members (sig, id) of the groups that hold several components.

    ``nodes`` has id, n, rep, c; the representative of a class stands for its members.
    With ``split`` a group is cut by size: a member goes to the part of its bucket and to
    the next, so two that fit are together in one. Of groups with the same members one is kept.
    """
    members = groups.join(nodes, "id").select("sig", F.col("rep").alias("id"), "c", "n")
    if split:  # groups of one component are left out before rows are copied
        members = tables.written(members, "join-grouped")
        several = members.groupBy("sig").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("sig")
        bucket = size_bucket(F.col("n"))
        members = members.join(several, "sig", "left_semi").withColumn("part", F.explode(F.array(bucket, bucket + 1))).select(F.xxhash64("sig", "part").alias("sig"), "id", "c", "n")
    members = tables.written(members.distinct(), "join-labelled")
    prints = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"f{k}") for k in (1, 2)]
    mixed = members.groupBy("sig").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("k"), *prints).where("x < y")
    one = mixed.groupBy("k", "f1", "f2").agg(F.min("sig").alias("sig")).select("sig")
    return members.join(one, "sig", "left_semi")


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` long and ``component_id`` long of every row, as a written table."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with Scratch(df.sparkSession) as tables:
        classes = tables.written(_classes(docs, _frequent(docs)), "join-classes")
        pairs, groups = _groups(_signatures(classes), tables)
        filled = classes.where("n > 0 and id is not null")
        sketches = tables.written(filled.groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), "join-sketches")
        reps = filled.select("id", "n", "d1", "d2").join(sketches.select("d1", "d2", F.col("id").alias("rep")), ["d1", "d2"])
        reps = tables.written(reps.select("id", "n", "rep").distinct(), "join-reps")
        same = reps.where("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
        likely = tables.written(_plausible(reps, sketches, pairs).distinct(), "join-likely")
        links = tables.written(same.union(_verified(docs, likely, tables)), "join-links")
        found = connected_components(links, tables)
        for nearest in (True, False):
            nodes = _labelled(reps, found, "id", "c")
            members = tables.written(_mixed_members(groups, nodes, nearest, tables), "join-members")
            crossed = tables.written(_cross_pairs(sketches, members, nearest), "join-crossed")
            more = tables.written(crossed.where("a is not null").select("a", "b").distinct().join(likely, ["a", "b"], "left_anti"), "join-likely")
            if more.limit(1).count():
                links = tables.written(_verified(docs, more, tables), "join-links").union(found.select(F.col("component").alias("a"), F.col("id").alias("b")))
                found = connected_components(links, tables)
                likely = likely.union(more)
            groups = members.join(crossed.select("sig").distinct(), "sig", "left_semi").select("sig", "id")
        out = _labelled(classes, found, "id", "component_id")
        return tables.written(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast("long")), "join-components", keep=True)
