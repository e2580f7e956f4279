"""Sum-of-squares online packing of documents into fixed training windows.

Documents arrive in the order of their ids within a shard. A document longer
than a window fills whole windows of its own first; what remains (at least one
token, less than a window) goes to the open window whose fill level h minimises
the sum over levels of N(h)^2, where N(h) counts the partially filled windows at
level h. That sum changes by 2(N(h+s) - N(h) + 1) when s tokens go to a window
at level h, by 2N(s) + 1 for a new window, and a window that becomes full counts
no more, so one pass over the level array finds the best level. Ties go to the
fullest window, and among windows at one level to the one opened first.

The algorithm is sequential, so the corpus is cut by a hash into shards of about
`shard_docs` documents, packed independently; a shard's windows do not depend on
the number of tasks. Rows that are alike in id and text are counted before anything
is shuffled, and their copies are dealt to shards in lots of `LOT`, so neither one
id, nor null ids, nor one text fills a shard. Only (doc_id, a hash, tokens, copies)
is shuffled; the open windows of a shard fit in a level array.

Tokens are the pre-tokens of TOKEN: runs of letters or digits, or single other
characters that are no white space.

Defined results: documents with null or blank text have no tokens and are in no
window; very long ones fill windows of their own; a null doc_id is packed like
any other, after all ids of its shard; repeated rows are packed as often as they
occur; documents of one shard and id are taken by their tokens, then by the hash
of their text; an empty table gives no rows; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_TOKENS = 2048
SHARD_DOCS = 8192
#: Copies of one row that go to one shard together.
LOT = 256
#: Tasks that pack, at most, for each task that the session shuffles to.
TASKS = 8
TOKEN = r"[\p{L}\p{M}\p{N}_]++|[^\s\p{L}\p{M}\p{N}_]"
ARROW = pa.schema([("shard", pa.int32()), ("window_id", pa.int64()), ("doc_id", pa.int64()), ("start_token", pa.int64()), ("n_tokens", pa.int32()), ("at", pa.int32())])
SCHEMA = "shard int, window_id long, doc_id long, start_token long, n_tokens int, at int"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


class Packer:
    """The windows of one shard."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[deque[int]] = [deque() for _ in range(capacity + 1)]
        self.windows = 0

    def new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for `size` tokens, 1 to capacity."""
        c, n = self.capacity, self.n
        level = 0
        if size < c:
            # change of the sum for a window at level h = 1 .. c - size; n[c] stays 0
            there = n[1 : c - size + 1]
            change = 2 * (n[size + 1 : c + 1] - there + 1)
            change[-1] -= 1  # it becomes full: (N - 1)^2 - N^2 alone
            change = np.where(there > 0, change, np.iinfo(np.int64).max)
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * n[size] + 1:
                level = best + 1
        window = self.open[level].popleft() if level else self.new()
        if level:
            n[level] -= 1
        if level + size < c:
            n[level + size] += 1
            self.open[level + size].append(window)
        return window, level

    def add(self, tokens: int) -> Iterator[tuple[int, int, int, int]]:
        """Pieces (window, first token, tokens, offset in the window) of a document."""
        start = 0
        while tokens - start >= self.capacity:
            yield self.new(), start, self.capacity, 0
            start += self.capacity
        if tokens > start:
            window, at = self.place(tokens - start)
            yield window, start, tokens - start, at


def pack(docs: DataFrame, window_tokens: int = WINDOW_TOKENS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pieces of documents in windows: SCHEMA.

    The windows of a shard are numbered from 0; `at` is where in the window the
    piece begins, `start_token` where in the document.
    """
    shards = max(1, -(-docs.count() // shard_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, current = Packer(window_tokens), None
        for batch in batches:
            out = []
            for shard, doc, tokens, copies in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "tokens", "copies"))):
                if shard != current:
                    packer, current = Packer(window_tokens), shard
                for _ in range(copies):
                    out += [(shard, w, doc, s, n, at) for w, s, n, at in packer.add(tokens)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind.type) for c, kind in zip(zip(*out), ARROW)] if out else [pa.array([], kind.type) for kind in ARROW], schema=ARROW)

    own = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text"), token_count(F.col("text")).alias("tokens")]
    rows = docs.select(*own).where("tokens > 0").groupBy("doc_id", "text", "tokens").agg(F.count(F.lit(1)).alias("copies"))
    lots = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / LOT)))).withColumn("copies", F.least(F.lit(LOT), F.col("copies") - F.col("lot") * LOT).cast("int"))
    lots = lots.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("doc_id", "text"), "text", "lot"), F.lit(shards)).cast("int"))
    tasks = min(shards, TASKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a number, so that small shards are not put together
    ordered = lots.repartition(tasks, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "tokens", "text", "lot")
    return ordered.select("shard", "doc_id", "tokens", "copies").mapInArrow(run, SCHEMA)
