"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be met with up to k = floor(n * error_rate) edits.
Cut into k + 1 pieces, at least one piece of every such occurrence is untouched,
so an Aho-Corasick automaton over all pieces finds every candidate in one pass
over a text. A hit fixes the diagonal on which the item would lie; diagonals
closer than k belong to one candidate, whose window is verified with Myers'
bit-parallel distance. The search is exact: every occurrence within k is
reported, or overlaps one of the same item that is reported and at least as
close. Of occurrences of one item that overlap, the closest counts, and among
equally close ones the first; all others are reported, however many.

Texts and items are compared lower-cased, with runs of characters that are no
letter, digit or underscore as one space. Distances and positions are in
characters of that form. An item too short for any edit (k = 0) is met only as
whole words, so "cat" is not in "concatenate".

The items are written to the shared folder in files of about `chunk_chars`
characters, which the workers read; a worker keeps the automaton that it built
for its later tasks. More items than one file holds are searched for in several
passes over the texts, so that no automaton outgrows an executor. No item reaches
the driver.

Defined results: null and blank texts or items match nothing, a null doc_id or
item_id is carried through, repeated rows (of items, too) are reported as often
as they occur, empty tables give no rows, very long texts are searched whole;
further columns, whatever their names, are ignored by `contaminated` and kept by
`decontaminate`.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import kept, place, run_dir

ERROR_RATE = 0.05
CHUNK_CHARS = 16_000_000
HITS = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"

_NO_WORD = re.compile(r"\W+")


def normalise(text: str) -> str:
    return _NO_WORD.sub(" ", text.lower()).strip()


def myers(pattern: str, text: str) -> Iterator[tuple[int, int]]:
    """For each end in text (1 ..), the least distance of pattern to a substring that ends there."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        eq[c] |= 1 << i
    pv, mv, score = mask, 0, m
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        yield score, j


class Spans:
    """Disjoint spans, in order."""

    def __init__(self) -> None:
        self.taken: list[tuple[int, int]] = []

    def free(self, start: int, end: int) -> bool:
        n = bisect(self.taken, (start, end))
        return (n == 0 or self.taken[n - 1][1] <= start) and (n == len(self.taken) or end <= self.taken[n][0])

    def add(self, start: int, end: int) -> None:
        self.taken.insert(bisect(self.taken, (start, end)), (start, end))


def matches(item: str, text: str, k: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of disjoint occurrences within k edits, the closest first, among equals the first."""
    spans, out = Spans(), []
    for distance, end in sorted(hit for hit in myers(item, text) if hit[0] <= k):
        if spans.free(max(0, end - (len(item) - k)), end):  # no occurrence is shorter
            back = text[max(0, end - len(item) - distance) : end][::-1]
            _, length = min((abs(s - distance), j) for s, j in myers(item[::-1], back))
            if spans.free(end - length, end):
                spans.add(end - length, end)
                out.append((distance, end - length, end))
    return out


class Matcher:
    """All items of a chunk, ready to search texts."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float) -> None:
        self.items = [(i, n) for i, t in items if (n := normalise(t))]
        self.budget = [int(len(n) * error_rate) for _, n in self.items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, n) in enumerate(self.items):
            parts = self.budget[at] + 1
            cuts = [len(n) * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[n[a:b]].append((at, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def search(self, raw: str | None) -> list[tuple[int | None, int, int, int]]:
        if raw is None or not self.any or not (text := normalise(raw)):
            return []
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, (length, where) in self.automaton.iter(text):
            for at, offset in where:
                diagonals[at].add(end + 1 - length - offset)
        found = []
        for at, starts in diagonals.items():
            (item_id, item), k = self.items[at], self.budget[at]
            ordered = sorted(starts)
            if k == 0:
                whole = (a for a in ordered if text[a - 1 : a] in ("", " ") and text[a + len(item) : a + len(item) + 1] in ("", " "))
                near = [(0, a, a + len(item)) for a in whole]
            else:
                near = []
                first = last = ordered[0]
                for d in [*ordered[1:], None]:
                    if d is not None and d - last <= k:
                        last = d
                        continue
                    a = max(0, first - k)
                    near += [(n, a + start, a + end) for n, start, end in matches(item, text[a : max(0, last) + len(item) + k], k)]
                    first = last = d
            # windows of neighbouring diagonals may show parts of one occurrence
            spans = Spans()
            for distance, start, end in sorted(near):
                if spans.free(start, end):
                    spans.add(start, end)
                    found.append((item_id, distance, start, end))
        return sorted(found, key=lambda h: (h[0] is None, h[0] or 0, h[2], h[3]))


def chunks(items: DataFrame, chunk_chars: int) -> list[str]:
    """Folders of the shared folder that hold about chunk_chars characters of items each."""
    items = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // chunk_chars)
    path = run_dir(items.sparkSession, "items")
    if n:
        items.withColumn("chunk", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition(int(min(n, 1000)), "chunk").write.partitionBy("chunk").parquet(path)
    return [f"{path}/chunk={i}" for i in range(n)]


def load(path: str) -> list[tuple[int | None, str]]:
    """The items of a chunk; a chunk that no item fell to has no folder."""
    files, at = place(path)
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return []
    rows = pq.read_table(at, columns=["item_id", "text"], filesystem=files, partitioning=None)
    return sorted(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist()), key=repr)


def hits(text: Column, chunk: str, error_rate: float) -> Column:
    """Column of HITS of one chunk of items."""

    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = kept(f"{chunk} {error_rate}", lambda: Matcher(load(chunk), error_rate))
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d, "start": a, "end": b} for i, d, a, b in matcher.search(t)] for t in texts], dtype=object)

    return search(text)


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Occurrences (doc_id, item_id, distance, start, end) of items in documents."""
    out = docs.sparkSession.createDataFrame([], docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ") + ", item_id bigint, distance int, start int, end int")
    for chunk in chunks(items, chunk_chars):
        out = out.unionByName(docs.select("doc_id", F.explode(hits(F.col("text"), chunk, error_rate)).alias("hit")).select("doc_id", "hit.*"))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows of docs in which no item occurs, with the columns of docs."""
    for chunk in chunks(items, chunk_chars):
        docs = docs.where(F.size(hits(F.col("text"), chunk, error_rate)) == 0)
    return docs
