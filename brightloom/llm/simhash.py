"""Near-duplicates by SimHash with bit-sliced comparison.

Fingerprint: the distinct words of five bytes or more and the distinct pairs of
neighbouring words of the whole text are features; their signed count sketch is
projected on 256 random directions, whose signs are the fingerprint. Two texts
are near-duplicates if their fingerprints differ in at most `radius` bits; at 52
of 256 that is a cosine of 0.80.

Candidates: equal fingerprints are one point. Each of `tables` bucket keys takes
`key_bits` bits of the fingerprint, chosen at random once; points that share a
bucket are compared. Both are parameters and depend on nothing else, so whether a
pair is found depends on the pair alone, not on what else the corpus holds. A pair
at b of 256 bits is found with probability 1 - (1 - (1 - b/256)^key_bits)^tables
at least: 1.00 at 26 bits, 0.99 at 42 and 0.91 at the radius of 52. Buckets grow with
the corpus: the comparisons of 14 bits are cheap to some 10^8 points; beyond that
more bits (and tables for the same recall) cost less.

Comparison: a bucket's points are laid down in blocks of 64 as bit planes, one
64-bit word for each bit of the fingerprint. A query is compared with the 64
points of a block at once: differing bits go plane by plane through carry-save
adders into bit-sliced counters, and every 32 planes the blocks in which all
points exceed the radius are abandoned.

No bucket is cut, and none is one task's alone: the points of a bucket of more than
`cell` are dealt to cells, and each pair of cells is a unit of work of its own. In
a large unit all points are first compared with blocks of 64 pivots; points that
these join already are not compared with one another again, so a template that
thousands of documents share costs little more than its length.

Groups are connected components of the pairs; a bucket sends only a spanning
forest of its pairs, so groups of thousands send a line each, and components are
found by alternating large-star and small-star steps, each a grouping with
map-side minima and a join, so that no node's neighbours meet in one task.

Defined results: rows with null doc_id, and texts without any word (null, empty,
only punctuation), are compared with nothing and stay; repeated rows of one
doc_id are one document and stay or go together; of a group, the smallest
doc_id stays; very long texts are read whole; an empty table gives no pairs;
further columns are carried along, with whatever names (but `__gone`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.bytehash import chunked, mix, words
from brightloom.llm.common import cut, sized

BITS = 256
RADIUS = 52
SKETCH = 2048
LONG_WORD = 5
KEY_BITS = 14
TABLES = 56
#: Points of a bucket that are one unit of work.
CELL = 1 << 18
#: From so many points on, pivots come before all pairs.
PIVOT_LEAST = 2048
#: A round of pivots that joins a smaller share of the points is the last.
PIVOT_SHARE = 0.05
ROWS = 1 << 15
STEP = 32


def projection() -> np.ndarray:
    return np.random.default_rng(20240229).choice(np.array([-1, 1], dtype=np.float32), (SKETCH, BITS))


def fingerprints(texts: list[str | None], directions: np.ndarray) -> list[bytes | None]:
    """BITS bits for each text that has a word."""
    out: list[bytes | None] = [None] * len(texts)
    held: list[int] = []
    sketches: list[np.ndarray] = []

    def flush() -> None:
        if held:
            bits = np.packbits(np.stack(sketches).astype(np.float32) @ directions > 0, axis=1, bitorder="little")
            for i, b in zip(held, bits):
                out[i] = b.tobytes()
            held.clear()
            sketches.clear()

    for first, _, buf, starts in chunked(texts):
        start, length, h = words(buf)
        edges = np.searchsorted(start, starts)
        pairs = mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15)) if len(h) > 1 else h[:0]
        long = length >= LONG_WORD
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a == b:
                continue
            own = h[a:b]
            some = own[long[a:b]]
            f = np.unique(np.concatenate([some if len(some) else own, pairs[a : b - 1]]))
            sketches.append(np.bincount((f & np.uint64(SKETCH - 1)).astype(np.int64), weights=1.0 - 2.0 * (f >> np.uint64(63)).astype(np.float64), minlength=SKETCH))
            held.append(first + k)
            if len(held) == 128:
                flush()
    flush()
    return out


def fingerprint(text: Column) -> Column:
    """Binary column with the fingerprint of each text."""
    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        directions = projection()
        for texts in batches:
            yield pd.Series(fingerprints(list(texts), directions), dtype=object)

    return of(text)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; a set's label is its smallest member."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def unpacked(fps: np.ndarray) -> np.ndarray:
    """BITS rows with a bit of each fingerprint."""
    return np.ascontiguousarray(np.unpackbits(fps, axis=1, bitorder="little").T)


class Blocks:
    """Points as bit planes: point i is in lane[i] of block[i]."""

    def __init__(self, fps: np.ndarray, block: np.ndarray, lane: np.ndarray, blocks: int) -> None:
        self.planes = np.empty((BITS, blocks), dtype=np.uint64)
        for a in range(0, BITS, 32):  # a part of the bits at a time, to save memory
            part = np.zeros((blocks, 64, 32), dtype=np.uint8)
            part[block, lane] = np.unpackbits(fps[:, a // 8 : a // 8 + 4], axis=1, bitorder="little")
            self.planes[a : a + 32] = np.packbits(part, axis=1, bitorder="little").transpose(2, 0, 1).copy().view("<u8")[:, :, 0]

    def near(self, bits: np.ndarray, query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, lane) of the points of block[row], among lanes[row], within the radius of query[row], a column of bits."""
        rows = np.arange(len(query))
        count: list[np.ndarray] = []

        def add(word: np.ndarray, level: int) -> None:
            while level < len(count):
                count[level], word = count[level] ^ word, count[level] & word
                level += 1
                if not word.any():
                    return
            count.append(word)

        def differing(j: int) -> np.ndarray:
            return self.planes[j].take(block) ^ (np.uint64(0) - bits[j].take(query).astype(np.uint64))

        def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ab = a ^ b
            return ab ^ c, (a & b) | (ab & c)

        for at in range(0, BITS, STEP):
            ones = twos = np.zeros(len(query), dtype=np.uint64)
            for j in range(at, at + STEP, 4):
                ones, t1 = carry_save(ones, differing(j), differing(j + 1))
                ones, t2 = carry_save(ones, differing(j + 2), differing(j + 3))
                twos, fours = carry_save(twos, t1, t2)
                add(fours, 2) if len(count) >= 2 else (count.extend([np.zeros_like(ones), np.zeros_like(ones)]), add(fours, 2))
            add(ones, 0)
            add(twos, 1)
            if at + STEP <= radius:
                continue
            over, same = np.zeros(len(query), dtype=np.uint64), np.full(len(query), ~np.uint64(0))
            for level in reversed(range(max(len(count), radius.bit_length()))):
                c = count[level] if level < len(count) else np.zeros_like(over)
                if radius >> level & 1:
                    same = same & c
                else:
                    over, same = over | (same & c), same & ~c
            lanes = lanes & ~over
            alive = lanes != 0
            if not alive.any():
                return rows[:0], rows[:0]
            if alive.sum() < 0.8 * len(alive):
                rows, query, block, lanes, count = rows[alive], query[alive], block[alive], lanes[alive], [c[alive] for c in count]
        r, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), 8), axis=1, bitorder="little"))
        return rows[r], lane


def joined_by_pivots(fps: np.ndarray, radius: int) -> np.ndarray:
    """Labels of points that some pivots, each within the radius, join; all others have their own."""
    label = np.arange(len(fps))
    loose = label.copy()
    while len(loose) >= PIVOT_LEAST:
        pivots = loose[np.linspace(0, len(loose) - 1, 64).astype(np.int64)]
        block = Blocks(fps[pivots], np.zeros(64, dtype=np.int64), np.arange(64), 1)
        for at in range(0, len(fps), ROWS):
            bits = unpacked(fps[at : at + ROWS])
            n = bits.shape[1]
            row, lane = block.near(bits, np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, ~np.uint64(0)), radius)
            unite(label, at + row, pivots[lane])
        alone = np.bincount(label, minlength=len(label))[label[loose]] == 1
        still = np.setdiff1d(loose[alone], pivots)
        if len(still) > (1 - PIVOT_SHARE) * len(loose):
            break
        loose = still
    return label


def spanning(ids: np.ndarray, fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of points in one bucket within the radius.

    fps: n x BITS/8 bytes; rows of one bucket are neighbours.
    """
    n = len(ids)
    if not n:
        return ids, ids
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.concatenate([first, [n]]))
    start = np.arange(n)  # of the run of points that are joined already
    for a, size in zip(first[sizes >= PIVOT_LEAST], sizes[sizes >= PIVOT_LEAST]):
        own = slice(a, a + size)
        label = joined_by_pivots(fps[own], radius)
        # joined points side by side, the most of them first
        order = np.lexsort((label, -np.bincount(label, minlength=size)[label]))
        ids, fps = ids.copy(), fps.copy()
        ids[own], fps[own], label = ids[own][order], fps[own][order], label[order]
        begins = np.concatenate([[True], label[1:] != label[:-1]])
        start[own] = a + np.maximum.accumulate(np.where(begins, np.arange(size), 0))
    label = start.copy()
    bucket_start = np.repeat(first, sizes)
    place = np.arange(n) - bucket_start
    blocks = -(-sizes // 64)
    base = np.repeat(np.cumsum(blocks) - blocks, sizes)
    planes = Blocks(fps, base + place // 64, place % 64, int(blocks.sum()))
    before = start - bucket_start  # each point is compared with these first ones of its bucket
    count, rest = -(-before // 64), before % 64
    ends = np.cumsum(count)
    done = 0
    while done < n:
        sent = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, sent + ROWS, side="right")))
        some = np.arange(done, upto)
        query = np.repeat(some, count[some])
        if len(query):
            nth = np.arange(len(query)) - np.repeat(ends[some] - count[some] - sent, count[some])
            lanes = np.where((nth == count[query] - 1) & (rest[query] > 0), (np.uint64(1) << rest[query].astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
            row, lane = planes.near(unpacked(fps[done:upto]), query - done, base[query] + nth, lanes, radius)
            unite(label, query[row], bucket_start[query[row]] + 64 * nth[row] + lane)
        done = upto
    moved = np.flatnonzero(label != np.arange(n))
    return ids[label[moved]], ids[moved]


POINT = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.binary())])
COUNT = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def packed_fps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)


def forest(points: DataFrame, radius: int, key_bits: int = KEY_BITS, tables: int = TABLES, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between points (doc_id, fp) within the radius that share a bucket."""
    rng = np.random.default_rng(5)
    chosen = np.stack([rng.choice(BITS, key_bits, replace=False) for _ in range(tables)])

    def keys(fps: np.ndarray) -> Iterator[np.ndarray]:
        bits = unpacked(fps)
        for t in range(tables):
            key = np.full(len(fps), t, dtype=np.int64)
            for j in chosen[t]:
                key = key * 2 + bits[j]
            yield key

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for key in keys(packed_fps(batch.column("fp"))):
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("doc_id"), batch.column("fp")], schema=POINT)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for key in keys(packed_fps(batch.column("fp"))):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(key, return_counts=True)], schema=COUNT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def settle(last: bool) -> pa.RecordBatch:
            nonlocal held, rows
            bucket, ids, fps = (np.concatenate(x) for x in zip(*held))
            whole = len(bucket) if last else int(np.searchsorted(bucket, bucket[-1]))
            a, b = spanning(ids[:whole], fps[:whole], bucket[:whole], radius)
            held, rows = [(bucket[whole:], ids[whole:], fps[whole:])], len(bucket) - whole
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=EDGE)

        due = ROWS
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("bucket").to_numpy(), batch.column("doc_id").to_numpy(), packed_fps(batch.column("fp"))))
                rows += batch.num_rows
                if rows >= due:
                    yield settle(False)
                    due = max(ROWS, 2 * rows)  # a unit larger than ROWS is held until it ends
        if rows:
            yield settle(True)

    points = points.select("doc_id", "fp")
    large = cut(points.mapInArrow(sizes, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > cell).select("bucket", F.ceil(F.col("n") / cell).cast("int").alias("cells")))
    many = large.count()
    keyed = points.mapInArrow(spread, "bucket long, doc_id long, fp binary")
    if many:
        keyed = keyed.join(sized(large, many), "bucket", "left")
        own = F.pmod(F.xxhash64("doc_id"), F.col("cells"))
        # a point meets its own cell and any other in the unit of both; a unit of one cell alone is not needed
        units = F.transform(F.filter(F.sequence(F.lit(0), F.col("cells") - 1), lambda c: c != own), lambda c: F.xxhash64("bucket", F.least(c, own), F.greatest(c, own)))
        keyed = keyed.select(F.explode(F.when(F.col("cells").isNull(), F.array("bucket")).otherwise(units)).alias("bucket"), "doc_id", "fp")
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, keep_id) for each node of the edges (a, b) but the smallest of its component."""
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs (u, v): each u with its neighbours; m is the smallest of u and them
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        pairs = pairs.join(least, "u")
        if large:
            return pairs.where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
        return pairs.select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).where("a <> b")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = state(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        edges = star(both, large=True).distinct()
        edges = cut(star(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), large=False).distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("keep_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, key_bits: int = KEY_BITS, tables: int = TABLES, cell: int = CELL) -> DataFrame:
    """(doc_id, keep_id) for each document that is in a group but not its smallest."""
    fps = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("fp"))
    # before the cut this filter would move below the projection, and each text be fingerprinted twice
    fps = cut(fps).where(F.col("fp").isNotNull())
    points = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    same = fps.join(points.withColumnRenamed("doc_id", "a"), "fp").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    return components(same.unionByName(forest(points, radius, key_bits, tables, cell)))


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without all but the smallest document of each group."""
    gone = cut(near_duplicates(docs, radius).select(F.col("doc_id").alias("__gone")))
    return docs.join(sized(gone, gone.count()), docs["doc_id"] == gone["__gone"], "left_anti")
