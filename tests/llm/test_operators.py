"""Each operator on awkward rows, and against brute force."""

import gzip
import itertools
import pathlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from brightloom.llm import bytehash, common, decontamination, exact_dedup, html_extract, language_id, licenses, packing, pii, simhash, toxicity, warc
from brightloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, h string, row string, rank long, fp string, k long"
LONG = "lorem ipsum dolor " * 8_000


def frame(spark, rows):
    """rows of (doc_id, text); the further columns clash with names that operators might use."""
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None, None if t is None else len(t), "h", None, 3, "fp", i) for i, t in rows], DDL)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, "same text here"), (2, "same text here"), (2, "same text here"), (None, "same text here"), (3, None), (4, None), (5, ""), (6, ""), (7, "!!! ???"), (8, LONG), (9, LONG), (10, "x" * 200_000), (11, "😀 naïve ÇA\u0000 z"), (None, None), (12, "Released under the MIT License.")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def ids(df, *columns):
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()), key=repr)


# exact deduplication


def test_exact_dedup(awkward, empty):
    kept = exact_dedup.exact_dedup(awkward)
    assert kept.columns == awkward.columns
    assert ids(kept, "doc_id") == sorted([1, 3, 4, 5, 7, 8, 10, 11, None, 12], key=repr)
    assert ids(exact_dedup.duplicate_pairs(awkward), "doc_id", "keep_id") == sorted([(2, 1), (2, 1), (None, 1), (6, 5), (9, 8)], key=repr)
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.duplicate_pairs(empty).count() == 0


def test_repeated_rows_leave_one(spark):
    df = frame(spark, [(5, "a"), (5, "a"), (5, "b")])
    assert ids(exact_dedup.exact_dedup(df), "doc_id", "text") == [(5, "a"), (5, "b")]
    assert ids(exact_dedup.duplicate_pairs(df), "doc_id", "keep_id") == [(5, 5)]


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "content_hash", lambda text: F.lit(b"0" * 16))
    df = frame(spark, [(1, "a"), (2, "b"), (3, "a")])
    assert ids(exact_dedup.exact_dedup(df), "doc_id") == [1, 2] and ids(exact_dedup.duplicate_pairs(df), "doc_id", "keep_id") == [(3, 1)]


# packing

moved: dict = {}  # fill level to its windows, in the order in which they came to it


def brute_pack(sizes, capacity):
    """Sum-of-squares packing with a dictionary of fill levels."""
    fills, out = [], []
    for n in sizes:
        start = 0
        while n - start >= capacity:
            fills.append(capacity)
            out.append((len(fills) - 1, 0, capacity))
            start += capacity
        if n == start:
            continue
        s = n - start
        best = None
        for level in [0, *sorted({f for f in fills if 0 < f <= capacity - s}, reverse=True)]:
            after = Counter(f for f in fills if 0 < f < capacity)
            if level:
                after[level] -= 1
            if level + s < capacity:
                after[level + s] += 1
            cost = (sum(c * c for c in after.values()), level == 0, -level)
            if best is None or cost < best[0]:
                best = (cost, level)
        level = best[1]
        if level:
            w = moved[level][0]
        else:
            fills.append(0)
            w = len(fills) - 1
        out.append((w, level, s))
        fills[w] = level + s
        moved.setdefault(level + s, []).append(w)
        if level:
            moved[level].remove(w)
    return out


@pytest.mark.parametrize("capacity, seed", [(10, 0), (16, 1), (7, 2), (50, 3)])
def test_packer_against_brute_force(capacity, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, int(capacity * 1.5)) for _ in range(300)]
    moved.clear()
    p = packing.Packer(capacity)
    got = [(w, at, n) for s in sizes for w, _, n, at in p.add(s)]
    assert got == brute_pack(sizes, capacity)


def test_packing_covers_every_token(spark, docs, awkward, empty):
    for df in (docs, awkward):
        pieces = packing.pack(df, 128, 50).collect()
        want = Counter()
        for r in df.select("doc_id", packing.token_count(F.col("text")).alias("n")).collect():
            want[r["doc_id"]] += r["n"]
        got = Counter()
        for r in pieces:
            got[r["doc_id"]] += r["n_tokens"]
        assert got == +want
        for _, w in itertools.groupby(sorted(pieces, key=lambda r: (r["shard"], r["window_id"], r["at"])), key=lambda r: (r["shard"], r["window_id"])):
            at = 0
            for r in w:
                assert r["at"] == at
                at += r["n_tokens"]
            assert at <= 128
    assert packing.pack(empty).count() == 0


def test_packing_against_brute_force_on_a_table(spark, docs):
    got = packing.pack(docs, 128, 10_000).collect()
    sizes = docs.select("doc_id", F.xxhash64("text").alias("h"), packing.token_count(F.col("text")).alias("n")).where("n > 0").orderBy("doc_id", "n", "h").collect()
    moved.clear()
    want = brute_pack([r["n"] for r in sizes], 128)
    assert [(r["window_id"], r["at"], r["n_tokens"]) for r in got] == want and {r["shard"] for r in got} == {0}


def test_packing_spreads_hot_rows(spark):
    for rows in ([(None, "a b c")] * 3000, [(7, "a b c")] * 3000, [(None, f"text {i}") for i in range(3000)], [(7, f"text {i}") for i in range(3000)]):
        shards = Counter(r["shard"] for r in packing.pack(frame(spark, rows), 64, 300).collect())
        assert sum(shards.values()) == 3000 and max(shards.values()) <= 1200 and len(shards) > 4


# decontamination


def edit_distances(pattern, text):
    row = list(range(len(pattern) + 1))
    for c in text:
        diagonal, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (p != c))
        yield row[-1]


def test_myers_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (90, 60))
        assert [s for s, _ in decontamination.myers(p, t)] == list(edit_distances(p, t))
        d, a, b = decontamination.matches(p, t, len(p) - 1)[0] if min(edit_distances(p, t)) < len(p) else (len(p), 0, 0)
        assert d == min(edit_distances(p, t)) and min(itertools.chain([len(p)], edit_distances(p, t[a:b]))) <= d


def test_no_occurrence_within_the_budget_is_missed():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(6)]
    m = decontamination.Matcher(items, 0.1)
    for _ in range(150):
        i, item = rng.choice(items)
        text = list(item)
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(text))
            rng.choice([lambda: text.pop(at), lambda: text.insert(at, rng.choice("abc")), lambda: text.__setitem__(at, "z")])()
        page = decontamination.normalise(" ".join(rng.choices(words, k=15)) + " " + "".join(text) + " " + " ".join(rng.choices(words, k=15)))
        found = {h[0]: h[1] for h in m.search(page)}
        for j, n in m.items:
            best = min(edit_distances(n, page))
            assert (j in found) == (best <= int(len(n) * 0.1)) and found.get(j, best) == best


def test_every_occurrence_is_reported_or_overlaps_a_closer_one():
    rng = random.Random(3)
    for _ in range(120):
        item = "".join(rng.choice("ab") for _ in range(rng.randint(10, 14))) * 2
        k = int(len(item) * 0.1)
        page = decontamination.normalise("".join(rng.choice([item, item[: len(item) // 2], "ab", "ba c"]) for _ in range(12)))
        found = [(d, a, b) for _, d, a, b in decontamination.Matcher([(1, item)], 0.1).search(page)]
        assert all(x[2] <= y[1] for x, y in zip(sorted(found, key=lambda h: h[1]), sorted(found, key=lambda h: h[1])[1:]))
        for end, score in enumerate(edit_distances(decontamination.normalise(item), page), 1):
            assert score > k or any(d <= score and a < end and end - (len(item) - k) < b for d, a, b in found)


def test_short_and_periodic_items():
    found = lambda item, page: [h[1:] for h in decontamination.Matcher([(1, item)], 0.05).search(page)]
    assert found("a" * 20, "a" * 60) == [(0, 0, 20), (0, 20, 40), (0, 40, 60)]
    assert found("cat", "concatenate a cat, cats; Cat") == [(0, 14, 17), (0, 23, 26)] and found("x", "x") == [(0, 0, 1)]
    assert len(found("ab" * 15, "ab" * 40_000)) == 80_000 // 30


def test_decontamination(spark, awkward, empty):
    items = spark.createDataFrame([(7, "Same text, HERE"), (8, None), (9, ""), (None, "lorem ipsum dolor lorem")], "item_id long, text string")
    found = decontamination.contaminated(awkward, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 7), (2, 7), (None, 7), (8, None), (9, None)}
    kept = decontamination.decontaminate(awkward, items)
    assert kept.columns == awkward.columns and ids(kept, "doc_id") == sorted([3, 4, 5, 6, 7, 10, 11, None, 12], key=repr)
    assert ids(decontamination.contaminated(awkward, items, chunk_chars=10), "doc_id", "item_id", "start") == ids(found, "doc_id", "item_id", "start")
    assert decontamination.contaminated(empty, items).count() == 0 and decontamination.decontaminate(awkward, items.limit(0)).count() == awkward.count()


# language identification


def test_language_id(spark, docs, awkward, empty):
    model = language_id.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 600)
    rows = language_id.identify(docs, model).alias("j").join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id").collect()
    assert sum(r["lang"] == r["label"] for r in rows) / len(rows) > 0.98 and sum(r["accepted"] for r in rows) / len(rows) > 0.99
    judged = {r["text"][:4] if r["text"] else r["text"]: r["j"] for r in awkward.select("text", language_id.judged(F.col("text"), model).alias("j")).collect()}
    for t in (None, "", "!!! "):
        assert judged[t]["lang"] is None and not judged[t]["accepted"] and judged[t]["confidence"] == 0
    foreign = spark.createDataFrame([("Привет мир как дела сегодня хорошо",), ("这是一个测试文本",)], "text string").select(language_id.judged(F.col("text"), model)["accepted"])
    assert not any(r[0] for r in foreign.collect())
    assert language_id.accepted(awkward, model).columns == awkward.columns
    assert language_id.identify(empty, model).count() == 0 and language_id.identify(awkward, language_id.train(empty)).where("accepted").count() == 0


def test_language_scores_against_brute_force():
    """Mean table rows of all n-grams of bytes inside words and at their edges, one by one."""
    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b"], rng.normal(size=(1 << language_id.BITS, 2)).astype(np.float32), np.array([0.1, -0.2]))
    letter = lambda c: 97 <= c <= 122 or c >= 128
    for text in ("Der Hund, 3 Katzen", "été naïve x", "a", "ab", "x1y", "the quick brown fox jumps"):
        buf = b"\n" + text.lower().encode() + b"\n"
        total, n_grams = np.zeros(2), 0
        for n in language_id.SIZES:
            for i in range(len(buf) - n + 1):
                gram = buf[i : i + n]
                if all(letter(c) for c in gram[1:-1]):
                    h = 0
                    for c in gram:
                        h = (h * 0x01000193 + (c if letter(c) else 32)) & 0xFFFFFFFF
                    h = (h + n * 0x9E37) & 0xFFFFFFFF
                    h = ((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
                    total += model.table[(h ^ (h >> 13)) & ((1 << language_id.BITS) - 1)]
                    n_grams += 1
        assert np.allclose(model.scores([text])[0], total / n_grams + model.bias, atol=1e-5)
        e = np.exp((total / n_grams + model.bias) / model.temperature)
        lang, top, _ = model.judge([text])
        assert lang == [model.langs[int(e.argmax())]] and np.isclose(top[0], e.max() / e.sum(), atol=1e-5)


def test_rare_labels_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGS", 2)
    rows = [(i, "the cat and the dog", "en") for i in range(9)] + [(i, "der hund und die katze", "de") for i in range(20, 29)] + [(50, "zzz", f"x{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.train(docs).langs == ["de", "en"]


def test_scores_do_not_depend_on_the_batch(docs):
    rows = [(r["lang"], r["text"]) for r in docs.limit(60).collect()]
    model = language_id.fit(rows)
    texts = [t for _, t in rows] + [None, "", "é", "a"]
    one = np.vstack([model.scores([t]) for t in texts])
    assert np.allclose(model.scores(texts), one, equal_nan=True)


# near-duplicates


def brute_components(fps, names, radius):
    bits = np.unpackbits(fps, axis=1)
    near = (bits.sum(axis=1)[:, None] + bits.sum(axis=1)[None, :] - 2 * (bits.astype(np.float32) @ bits.T.astype(np.float32))) <= radius
    label = np.arange(len(fps))
    a, b = np.nonzero(near)
    simhash.unite(label, a, b)
    return {int(names[i]): int(names[label[i]]) for i in range(len(fps)) if label[i] != i}


@pytest.mark.parametrize("n, buckets, radius", [(3, 1, 52), (200, 1, 52), (64, 1, 0), (65, 1, 100), (700, 9, 60), (500, 40, 3)])
def test_bit_slices_against_brute_force(n, buckets, radius):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 256, (max(1, n // 6), 32), dtype=np.uint8)
    fps = centres[rng.integers(0, len(centres), n)].copy()
    flips = rng.random((n, 256)) < rng.uniform(0, 0.25, (n, 1))
    fps ^= np.packbits(flips, axis=1)
    bucket, names = np.sort(rng.integers(0, buckets, n)), np.arange(n)
    a, b = simhash.spanning(names, fps, bucket, radius)
    label = np.arange(n)
    simhash.unite(label, a, b)
    for x in range(buckets):
        own = np.flatnonzero(bucket == x)
        want = brute_components(fps[own], own, radius)
        assert {int(i): int(label[i]) for i in own if label[i] != i} == want


@pytest.mark.parametrize("n, share, radius", [(3000, 0.9, 52), (2500, 0.0, 20), (5000, 0.5, 45)])
def test_pivots_lose_no_link(n, share, radius):
    """A bucket in which many points share a template, chains of points among them."""
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    hot = rng.random(n) < share
    fps[hot] = fps[0] ^ np.packbits(rng.random((hot.sum(), 256)) < rng.uniform(0, 0.16, (hot.sum(), 1)), axis=1)
    for i in range(1, 40):  # a chain
        fps[i] = fps[i - 1] ^ np.packbits(rng.random(256) < 0.12)
    a, b = simhash.spanning(np.arange(n), fps, np.zeros(n, dtype=np.int64), radius)
    label = np.arange(n)
    simhash.unite(label, a, b)
    assert {i: int(label[i]) for i in range(n) if label[i] != i} == brute_components(fps, np.arange(n), radius)


def test_large_buckets_in_cells_give_the_same_groups(spark, docs):
    want = ids(simhash.near_duplicates(docs, key_bits=3, tables=4), "doc_id", "keep_id")
    assert want and ids(simhash.near_duplicates(docs, key_bits=3, tables=4, cell=7), "doc_id", "keep_id") == want


def test_near_duplicates_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    fps = simhash.fingerprints([r["text"] for r in rows], simhash.projection())
    with_fp = [i for i, f in enumerate(fps) if f is not None]
    names = np.array([rows[i]["doc_id"] for i in with_fp])
    want = brute_components(np.frombuffer(b"".join(fps[i] for i in with_fp), dtype=np.uint8).reshape(-1, 32), names, simhash.RADIUS)
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(set(got.items()) & set(want.items())) >= 0.9 * len(want) and set(got) <= set(want)
    assert simhash.near_dedup(docs).count() == len(rows) - len(got)


def test_each_text_is_fingerprinted_once(spark, docs, monkeypatch):
    """A filter on fingerprints that moves below their projection would compute them twice, by two workers for each task."""
    done = spark.sparkContext.accumulator(0)

    @F.pandas_udf("binary")
    def counted(texts: pd.Series) -> pd.Series:
        done.add(len(texts))
        return pd.Series(simhash.fingerprints(list(texts), simhash.projection()), dtype=object)

    want = ids(simhash.near_duplicates(docs), "doc_id", "keep_id")
    monkeypatch.setattr(simhash, "fingerprint", counted)
    assert ids(simhash.near_duplicates(docs), "doc_id", "keep_id") == want
    assert done.value == docs.where("doc_id is not null and text is not null").count()


def test_near_duplicates_on_awkward_rows(spark, awkward, empty):
    assert ids(simhash.near_duplicates(awkward), "doc_id", "keep_id") == [(2, 1), (9, 8)]
    kept = simhash.near_dedup(awkward)
    assert kept.columns == awkward.columns and ids(kept, "doc_id") == sorted([1, None, 3, 4, 5, 6, 7, 8, 10, 11, None, 12], key=repr)
    assert simhash.near_duplicates(empty).count() == simhash.near_dedup(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(500, x) for x in range(501, 540)]
    label = np.arange(600)
    simhash.unite(label, *np.array(pairs).T)
    got = {r["doc_id"]: r["keep_id"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: int(label[i]) for i in range(600) if label[i] != i}


def test_word_hashes():
    for _, _, buf, _ in bytehash.chunked(["one two one", "ÉTÉ two 2x"]):
        start, length, h = bytehash.words(buf)
        spelt = [bytes(buf[a : a + n]).decode() for a, n in zip(start, length)]
        assert spelt == ["one", "two", "one", "été", "two", "2x"] and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 4


# licenses


def test_licenses(spark, awkward, empty):
    text = {
        1: "foo released under the mit license, tail",
        2: "Licensed under the Apache License, Version 2.0. and again licensed under the apache license, version 2.0.",
        3: "This work is licensed under the GNU General Public big License, version 3.",
        4: licenses.TEMPLATES["MIT"] + " trailing",
        5: "under the MIT sun, a license to write",
    }
    got = ids(licenses.scan(frame(spark, list(text.items()) + [(None, text[1])])), "doc_id", "license", "from_word", "to_word")
    assert got == sorted([(None, "MIT (notice)", 1, 6), (1, "MIT (notice)", 1, 6), (2, "Apache-2.0 (notice)", 0, 7), (2, "Apache-2.0 (notice)", 9, 16), (3, "GPL-3.0 (notice)", 0, 13), (4, "MIT", 0, 117)], key=repr)
    assert ids(licenses.scan(awkward), "doc_id") == [12] and licenses.scan(empty).count() == 0


def test_every_license_line_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = docs.where(F.col("text").rlike("Released under the MIT License\\.|Licensed under the Apache License, Version 2\\.0|GNU General Public License, version 3|Licensed under CC BY-NC 4\\.0"))
    assert set(ids(licenses.scan(docs), "doc_id")) == set(ids(lines, "doc_id"))


def brute_scan(text, templates):
    """Spans of one text: all k-gram matches, diagonals, runs and verification in plain Python."""
    find = lambda t: regex.findall(licenses.WORDS, t.lower())
    own, out = find(text), set()
    for name, raw in templates.items():
        whole = find(raw)
        n, k = len(whole), licenses.K
        at = {}
        for q in range(n - k + 1):
            at.setdefault(tuple(whole[q : q + k]), []).append(q)
        diagonals = {}
        for p in range(len(own) - k + 1):
            for q in at.get(tuple(own[p : p + k]), []):
                diagonals.setdefault(p - q, []).append((p, q))
        held, last = [], None
        for d in sorted(diagonals):
            ps = [p for p, _ in diagonals[d]]
            if last is None or d - last[0] > licenses.DRIFT or min(ps) - last[1] > n:
                held.append([])
            held[-1].append(d)
            last = (d, max(ps))
        for run in held:
            votes = sum(len({p for p, _ in diagonals[d]}) for d in run)
            if votes < max(1, -(-(n - k + 1) // 2)):
                continue
            a = min(min(p for p, _ in diagonals[d]) - min(q for _, q in diagonals[d]) for d in run)
            b = max(max(p for p, _ in diagonals[d]) + n - max(q for _, q in diagonals[d]) for d in run)
            a, b = max(a, 0), min(b, len(own))
            span, target = " ".join(own[a:b]), " ".join(whole)
            *_, distance = [len(span)] if not target else [whole_distance(span, target)]
            if distance <= int(licenses.MAX_DISTANCE * len(target)):
                out.add((name, a, b, votes, distance))
    return out


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_licenses_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    short = {k: v for k, v in licenses.TEMPLATES.items() if len(v) < 260}
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(list(short.values())).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.pop(at), lambda: w.insert(at, "extra"), lambda: w.__setitem__(at, "other")])()
            parts += [" ".join(rng.choice(["this", "license", "work", "the", "foo"]) for _ in range(rng.randint(0, 9))), " ".join(w)]
        texts.append(" ".join(parts))
    want = {(i, *hit) for i, t in enumerate(texts) for hit in brute_scan(t, short)}
    got = {(r["doc_id"], r["license"], r["from_word"], r["to_word"], r["votes"], r["distance"]) for r in licenses.scan(frame(spark, list(enumerate(texts))), short).collect()}
    assert got == want and len(want) > 60
    for name in ("MIT (notice)", "ISC"):
        (tmp_path / f"{name}.txt").write_text(licenses.TEMPLATES[name])
    docs = frame(spark, [(1, licenses.TEMPLATES["ISC"])])
    assert ids(licenses.scan(docs, licenses.templates_in(spark, str(tmp_path))), "license") == ["ISC"]
    with pytest.raises(Exception, match="fewer than"):
        licenses.scan(docs, {"x": "two words"}).collect()


# web pages


def test_warc_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html", F.lit("x").alias("path"), F.lit(1).alias("file"))
    extra = spark.createDataFrame([(None, None, None, "x", 1), (3, "http://a\nb", "", "x", 1), (3, "http://a\nb", "", "x", 1), (4, "u", "é" * 300_000, "x", 1)], pages.schema)
    pages = pages.unionByName(extra)
    files = warc.monoliths(pages, f"file://{tmp_path}/in", 20)
    files = files.persist()
    assert sum(r["records"] for r in files.collect()) == pages.count()
    index = warc.normalise(files, f"file://{tmp_path}/out").collect()
    assert len(index) == pages.count() and all(r["error"] is None for r in index)
    want = Counter((p["page_id"], (p["html"] or "").encode()) for p in pages.collect())
    got = Counter()
    for r in index:
        record = warc.read_record(f"file://{tmp_path}/out/{r['output']}", r["offset"], r["length"])
        got[r["page_id"], record.split(b"\r\n\r\n", 2)[2][:-4]] += 1
    assert got == want
    for r in files.collect():  # member by member, the same bytes as the one stream
        name = r["path"].removeprefix("file://")
        assert gzip.open(name).read() == gzip.open(f"{tmp_path}/out/{name.rsplit('/', 1)[1].removesuffix('.gz')}.members.gz").read()
    assert warc.monoliths(pages.limit(0), f"file://{tmp_path}/none").count() == 0


GOOD = warc.warc_record(1, "u", "x")


@pytest.mark.parametrize("raw, whole", [(b"", 0), (b"no gzip", 0), (gzip.compress(b"junk\r\n\r\n"), 0), (gzip.compress(GOOD + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort"), 1), (gzip.compress(GOOD * 2 + b"\0" * 64), 2), (gzip.compress(GOOD + b"WARC/1.0\r\nContent-Length: -60\r\n\r\n" + GOOD), 1), (gzip.compress(GOOD + b"WARC/1.0\r\nContent-Length: 1_0\r\n\r\n0123456789\r\n\r\n"), 1), (gzip.compress(GOOD + b"x" * (3 << 20)), 1), (gzip.compress(GOOD) + b"tail", 1)])
def test_broken_files_are_reported(tmp_path, raw, whole):
    (tmp_path / "a.warc.gz").write_bytes(raw)
    rows = list(warc.normalise_file(f"{tmp_path}/a.warc.gz", f"{tmp_path}/out"))
    out = tmp_path / "out/a.warc.members.gz"
    assert [r["output"] for r in rows] == [out.name] * whole + [None] * bool(raw) and out.exists() == (whole > 0 or not raw)
    assert all(warc.read_record(str(out), r["offset"], r["length"]) == GOOD for r in rows[:whole]) and all(r["error"] for r in rows[whole:])
    assert not raw or (out.parent / (out.name + ".idx")).exists() == (whole > 0)


def test_truncated_file_keeps_whole_records(tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(warc.warc_record(i, "u", "%d" % i * 5000) for i in range(300)))[:-60])
    rows = list(warc.normalise_file(f"{tmp_path}/a.warc.gz", f"{tmp_path}/out"))
    assert len(rows) > 200 and rows[-1]["error"] and [r["page_id"] for r in rows[:-1]] == list(range(len(rows) - 1))


def test_foreign_heads(tmp_path):
    heads = ["abc", "9" * 30, " 12 ", "-5", "1_0", ""]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(b"WARC/1.1\r\nX-Page-Id:" + h.encode() + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n" for h in heads)))
    assert [r["page_id"] for r in warc.normalise_file(f"{tmp_path}/a.warc.gz", f"{tmp_path}/out")] == [None, None, 12, -5, None, None]


def test_members_are_taken_like_one_stream(tmp_path):
    raw = [warc.warc_record(i, "u", "x" * i) for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    rows = list(warc.normalise_file(f"{tmp_path}/a.warc.gz", f"{tmp_path}/out"))
    assert [r["page_id"] for r in rows] == list(range(5))
    assert zlib.decompress((tmp_path / "out/a.warc.members.gz").read_bytes()[rows[1]["offset"] :][: rows[1]["length"]], 31) == raw[1]


def texts(page):
    """Texts with their elements that are no inline ones, outermost first."""
    p = html_extract.parse(page)

    def path(n):
        return () if n == 0 else path(p.nodes[n].parent) + tuple(x.removeprefix("under:") for x in p.nodes[n].adds if x.startswith("under:"))

    return [(b.text, path(b.node)) for b in p.blocks]


def test_html_blocks():
    assert texts("<div>a<p>b<b>c<p>d</div><!-- x") == [("a", ("div",)), ("bc", ("div", "p")), ("d", ("div", "p"))]
    assert texts("<ul><li>1<li>2</ul>&amp; 3") == [("1", ("ul", "li")), ("2", ("ul", "li")), ("& 3", ())]
    assert texts("<script>var a='<p>x</p>'</script>y<style>") == [("y", ())] and texts("< 5 <") == [("< 5 <", ())]
    assert texts(None) == texts("") == texts("<p class=") == []
    page = html_extract.parse('<a href="x">l</a> t')
    assert page.blocks[0].link_chars == 1
    crossed = html_extract.parse('<a class="k">l<div class="k j">m</a>n<p>o</div>q</p></a>r')
    assert [(b.text, b.link_chars) for b in crossed.blocks] == [("l", 1), ("mn", 1), ("o", 0), ("qr", 0)] and crossed.nodes[1].adds == ("mark:k",) and crossed.nodes[2].adds == ("under:div", "mark:j")


def test_deep_markup_takes_linear_time():
    began = time.perf_counter()
    for page in ("<div>x" * 60_000, '<i><div class="c%d">' * 40_000 + "x</i>" * 40_000, "<a><b>" * 40_000 + "</a>x" * 40_000, "<section>" * 60_000 + "<p>a<p>b" + "</section>" * 60_000):
        html_extract.Model({"one": 0}, np.zeros((1, 2))).decode(html_extract.parse(page))
    assert time.perf_counter() - began < 30


def test_scores_and_training_are_those_of_listed_ancestors():
    """The tree of elements against each block's features written out."""
    rng = random.Random(8)
    tags = ["div", "p", "section", "b", "a", "article", "ul", "li"]
    pages = ["<article>in</article>" + "".join(rng.choice([f'<{rng.choice(tags)} class="c{rng.randint(0, 5)} c{rng.randint(0, 5)}">', f"</{rng.choice(tags)}>", "some text. ", "More"]) for _ in range(80)) for _ in range(6)]

    def listed(page):
        out = []
        for b, f in zip(page.blocks, html_extract.features(page)):
            n, f = b.node, list(f)
            while n > 0:
                f += page.nodes[n].adds
                n = page.nodes[n].parent
            assert len(set(f)) == len(f)
            out.append(f)
        return out

    model = html_extract.fit(pages, epochs=1, seed=5)
    flat = html_extract.Model(model.names, np.zeros_like(model.weights), np.zeros((2, 2)))
    order = [html_extract.parse(p) for p in sorted(pages)]
    for step, i in enumerate(np.random.default_rng(5).permutation(len(order))):
        y, lr = np.array(order[i].inside()), html_extract.RATE / (1 + step / (2 * len(order)))
        codes = flat.coded(listed(order[i]))
        single, pairs = html_extract.marginals(np.array([flat.weights[k].sum(axis=0) for k in codes]), flat.moves)
        gap = np.eye(2)[y] - single
        flat.weights *= 1 - lr * html_extract.DECAY
        for k, g in zip(codes, gap):
            flat.weights[k] += lr * g / len(y) ** 0.5
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1], y[1:]), 1)
        flat.moves += lr * (seen - pairs) / len(y)
    assert np.allclose(flat.weights, model.weights) and np.allclose(flat.moves, model.moves)


def test_viterbi_and_marginals_against_brute_force():
    rng = np.random.default_rng(1)
    model = html_extract.Model({"one": 0}, np.zeros((1, 2)), rng.normal(size=(2, 2)))
    for n in (1, 2, 5):
        e = rng.normal(size=(n, 2))
        paths = {y: sum(e[i, y[i]] for i in range(n)) + sum(model.moves[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
        model.emissions = lambda page, e=e: e
        assert tuple(model.decode(html_extract.Page([None] * n, []))) == max(paths, key=paths.get)
        z = sum(np.exp(s) for s in paths.values())
        single, pairs = html_extract.marginals(e, model.moves)
        assert np.allclose(single[:, 1], [sum(np.exp(s) for y, s in paths.items() if y[i]) / z for i in range(n)])
        assert np.allclose(pairs[0, 1], sum(np.exp(s) * sum(p == (0, 1) for p in zip(y, y[1:])) for y, s in paths.items()) / z)


def test_extraction_on_held_out_pages(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    model = html_extract.fit(pages[:120])
    right = total = 0
    for page in pages[120:]:
        b = html_extract.parse(page.replace("<article>", "<div>").replace("</article>", "</div>"))  # landmarks are not needed
        want = html_extract.parse(page).inside()
        if len(want) == len(b.blocks):
            right, total = right + sum(a == c for a, c in zip(model.decode(b), want)), total + len(want)
    assert right / total > 0.97
    odd = spark.createDataFrame([(1, None, "k"), (None, "", "k"), (2, "<p>" * 3000, "k"), (2, "<p>x", "k")], "page_id long, html string, text string")
    assert [(r["blocks"], r["kept"] <= r["blocks"]) for r in html_extract.extracted(odd, model).collect()] == [(0, True), (0, True), (0, True), (1, True)]
    none = html_extract.train(odd)
    assert html_extract.extracted(odd, none).where("kept > 0").count() == 0 and html_extract.extracted(odd.limit(0), none).count() == 0


# identifiers


def test_candidates():
    text = 'call +1 (499) 555-6503 now, mail a.19@m5.example.com; token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" v2.0.'
    assert [(text[a:b], s) for a, b, s, _ in pii.candidates(text)] == [(s, s) for s in ("+1 (499) 555-6503", "a.19@m5.example.com", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "v2.0")]
    assert list(pii.candidates(None)) == list(pii.candidates("")) == list(pii.candidates("no such thing")) == []


def test_bootstrapping_finds_unseen_identifiers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = pii.cut(pii.occurrences(docs, "salt"))
    believed, _ = pii.beliefs(found)
    rows = found.select("instance", "kind", pii.is_seed(pii.SEED_SHARE).alias("seed")).distinct().join(believed, "instance", "left").collect()
    for kind in ("card", "email", "ip", "phone", "secret"):  # what the recognisers know, but no seed, is found through patterns
        hidden = [r for r in rows if r["kind"] == kind and not r["seed"]]
        assert len(hidden) > 50 and sum(r["type"] == kind and r["belief"] >= pii.INSTANCE_LEAST for r in hidden) / len(hidden) > 0.95, kind
        assert 0 < sum(r["kind"] == kind and r["seed"] for r in rows) < 0.5 * len(hidden)
    assert not any(r["kind"] == pii.NEGATIVE and r["type"] not in (None, pii.NEGATIVE) and r["belief"] >= pii.INSTANCE_LEAST for r in rows)


def brute_beliefs(occurrences, share):
    """The rounds with dictionaries. occurrences: (instance, patterns, kind, seed)."""
    graph = {(i, p) for i, ps, _, _ in occurrences for p in ps}
    n = Counter(p for _, p in graph)
    seeds = {i: (True, 1.0, k) for i, _, k, seed in occurrences if seed}
    held, state = dict(seeds), None
    while True:
        full = {p: n[p] * share if state is None else n[p] for p in n}
        total, support = Counter(), Counter()
        for i, p in graph:
            if i in held:
                total[p, held[i][2]] += held[i][1]
                support[p, held[i][2]] += 1
        best = {}
        for (p, kind), x in total.items():
            c = min(1.0, x / (full[p] + pii.PRIOR * (1.0 - min(1.0, x / full[p]))))
            best[p] = max(best.get(p, (0.0, "", 0)), (c, kind, support[p, kind]))
        now = dict(held)
        for i, p in graph:
            if p in best and best[p][0] >= pii.PATTERN_LEAST and best[p][2] >= pii.SUPPORT:
                now[i] = max(now.get(i, (False, 0.0, "")), (False, int(best[p][0] * 100 + 1e-9) / 100, best[p][1]))
        if now == held and state is not None:
            return {i: (kind, belief) for i, (_, belief, kind) in held.items()}
        held, state = now, True


def test_beliefs_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        instance = f"i{rng.randint(0, 120)}"
        kind = [None, "email", "card", pii.NEGATIVE][int(instance[1:]) % 4]
        patterns = sorted({rng.choice([int(instance[1:]) % 4, int(instance[1:]) % 9, 20 + rng.randint(0, 15)]) for _ in range(3)})
        rows.append((i, 0, 1, instance, kind, int(instance[1:]) * 7 % 1000, patterns))
    found = spark.createDataFrame(rows, "doc_id long, start int, end int, instance string, kind string, draw int, patterns array<long>")
    for share in (0.3, 0.9):
        want = brute_beliefs([(r[3], r[6], r[4], r[4] is not None and r[5] < round(1000 * share)) for r in rows], share)
        got = {r["instance"]: (r["type"], r["belief"]) for r in pii.beliefs(found, share)[0].collect()}
        assert got == pytest.approx(want) if not want else {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
        assert len(want) > 60


def test_secrets_of_unseen_format_are_found(spark):
    codes = [f"{i:02d}" + "9f3b7c" * 6 + "ab" for i in range(20, 80)]
    docs = frame(spark, [(i, f'the token = "{c}" here') for i, c in enumerate(codes)] + [(90, f'THE TOKEN = "{"77" + "9A3C7D" * 6 + "BE"}" HERE'), (91, 'the token = "Zq-81/44_kk!x9" of no known format')])
    assert ids(pii.identifiers(docs), "doc_id", "type") == sorted([(i, "secret") for i in [*range(60), 90, 91]], key=repr)


def test_identifiers_on_awkward_rows(spark, awkward, empty):
    mails = frame(spark, [(i, f"write to user.{i}@mail.example.com today") for i in range(20, 80)] + [(20, "write to user.20@mail.example.com today"), (None, "write to user.77@mail.example.com")])
    got = pii.identifiers(awkward.unionByName(mails))
    assert Counter(ids(got, "doc_id")) == Counter([20, *range(20, 80), None]) and set(ids(got, "type")) == {"email"}
    assert set(ids(got, "seed")) == {True, False} and got.columns == ["doc_id", "type", "start", "end", "belief", "seed", "instance_hash"]
    assert pii.identifiers(empty).count() == 0


def test_no_identifier_is_written(spark):
    mails = frame(spark, [(i, f"write to zebra{i}quux@mail.example.com today") for i in range(20, 60)])
    assert pii.identifiers(mails).count() == 40
    shared = common.shared_dir(spark).removeprefix("file://")
    written = [f for f in pathlib.Path(shared).rglob("part-*") if f.is_file()]
    assert written and not any(b"quux" in f.read_bytes() for f in written)
    one, two = ({r[0] for r in pii.identifiers(mails, salt=s).select("instance_hash").collect()} for s in ("a", "b"))
    assert len(one) == len(two) == 40 and not one & two


# toxicity


def test_toxicity(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = toxicity.train(docs, labels.where(half), 900)
    rows = toxicity.classify(docs.where("lang = 'en'"), model).withColumnRenamed("toxic", "found").join(labels.where(~half), "doc_id").collect()
    caught = [r["found"] for r in rows if r["toxic"]]
    false = [r["found"] for r in rows if not r["toxic"]]
    assert sum(caught) / len(caught) > 0.9 and sum(false) / len(false) < 0.02
    odd = {r["doc_id"]: r for r in toxicity.classify(awkward, model).collect()}
    assert all(odd[i]["windows"] == 0 and not odd[i]["toxic"] for i in (3, 5, 7)) and not odd[8]["toxic"]
    assert toxicity.classify(empty, model).count() == 0
    assert toxicity.classify(awkward, toxicity.train(awkward, labels.limit(0))).where("toxic").count() == 0


def test_toxicity_against_brute_force(spark):
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in ("lo", "ra", "ti", "mu", "se") for b in ("ne", "ka", "ri", "vo", "sta", "pel")]
    text = lambda n, bad: " ".join(rng.choice(["vileword", "grubface"]) if rng.random() < bad else rng.choice(plain) for _ in range(n))
    rows = [(int(i % 3 == 0), text(rng.randint(30, 300), 0.04 if i % 3 == 0 else 0.0), "xx") for i in range(240)]
    model = toxicity.fit(rows)
    assert model.threshold < float("inf") and model.toxic[: len(model.ordinary)][:1000] == model.ordinary[:1000] and not model.ordinary.startswith(b"\x37\xa4\x30\xec")
    long = text(6000, 0) + " " + text(32, 0.5) + " " + text(6000, 0)
    texts = [long, text(12_000, 0), *[text(60, 0.08) for _ in range(20)], *[text(60, 0) for _ in range(20)], "", None, "?!"]
    got = toxicity.classify(frame(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        words = toxicity.plain(t).split() if t else []
        weight = []
        for i in range(0, len(words), toxicity.WINDOW_WORDS):
            window = toxicity.FIRST + b" " + b" ".join(words[i : i + toxicity.WINDOW_WORDS]) + b" " + toxicity.CARRIER
            a, b = (len(c.compress(window)) for c in brute_lengths(model))
            weight.append(float(model.weight[min(max(a - b, 0), len(model.weight) - 1)]))
        whole = sum(weight) / max(1, len(weight)) ** 0.5
        n = min(toxicity.RUN, len(weight))
        run = max((sum(weight[i : i + n]) for i in range(len(weight) - n + 1)), default=0.0) / max(1, n) ** 0.5
        assert r["windows"] == len(weight) and r["score"] == pytest.approx(whole) and r["passage"] == pytest.approx(run, abs=1e-9)
        assert r["toxic"] == (r["score"] >= model.threshold or r["passage"] >= model.run_threshold)
    assert got[0]["toxic"] and got[0]["passage"] >= model.run_threshold and not got[1]["toxic"]
    assert sum(r["toxic"] for r in got[2:22]) >= 18 and not any(r["toxic"] for r in got[22:])


def brute_lengths(model, held={}):  # noqa: B006
    """Compressors of a model, made once."""
    if held.get("key") != model.key:
        held.update(key=model.key, of=[toxicity.Lengths.compressor(c) for c in (model.ordinary, model.toxic)])
    return held["of"]


def test_toxicity_in_every_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = toxicity.train(docs, labels.where(half), 900)
    rows = toxicity.classify(docs, model).withColumnRenamed("toxic", "found").join(docs.select("doc_id", "lang"), "doc_id").join(labels.where(~half), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        caught = [r["found"] for r in rows if r["toxic"] and r["lang"] == lang]
        false = [r["found"] for r in rows if not r["toxic"] and r["lang"] == lang]
        assert sum(caught) / len(caught) > 0.7 and sum(false) / len(false) < 0.04, (lang, sum(caught), len(caught), sum(false), len(false))


# queries and pipeline


def test_queries_are_one_for_each_operator():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)] and set(ORACLES) <= set(QUERIES)


def test_pipeline_against_its_stages_done_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for (i, t), ok in zip(rows.items(), model.judge(list(rows.values()))[2]) if ok}
    first = {}
    for i in sorted(kept):
        first.setdefault(kept[i], i)
    kept = {i: t for t, i in first.items()}
    near = simhash.near_duplicates(spark.createDataFrame(list(kept.items()), "doc_id long, text string"))
    for r in near.collect():
        del kept[r["doc_id"]]
    m = decontamination.Matcher([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], decontamination.ERROR_RATE)
    kept = {i: t for i, t in kept.items() if not m.search(t)}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == {i for i, t in kept.items() if t.strip()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_on_awkward_and_empty_documents(spark, awkward, empty):
    for name, stage in corpus_pipeline.STAGES:
        for df in (awkward, empty):
            out = stage(spark, df, DATA)
            assert out.count() <= df.count() * (100_000 if name == "packing" else 1)
            if name != "packing":
                assert out.columns == df.columns
