"""Toxicity by compression distance: one zstandard dictionary trained on toxic
text and one on ordinary text, and the lengths of windows under either.

A window is `WINDOW_WORDS` neighbouring words, lower-cased, with a space on both
sides, followed by a fixed carrier that both dictionaries end with: the carrier's
cost is the same in both, so the difference of the two lengths is what the window
alone costs more in ordinary text than in toxic text, and a frame's overhead (and
that zstandard keeps a window plain if it can save no two bytes) cancels out.
Windows follow one another over the whole text.

The ordinary dictionary is trained on labelled ordinary documents, the toxic one
on toxic documents, reduced to what distinguishes them: trained on them as they
are, it holds the words of both classes, whose chance matches in any text outweigh
the few words that differ (the README has figures). So it is the ordinary one,
then toxic stems, then parts of these; the ordinary one has zeros in the stems'
place, and ordinary text is kept without the stems and their last three
characters. A window then costs more in ordinary text only if it holds a whole
stem, but for rare changes of the parse. A stem is the beginning of a word, of
`STEM_LEAST` to `STEM_MOST` characters, or a whole word, that is over-represented
in labelled toxic documents against ordinary ones of the same language (column lang
where docs has one; null is a language; without ordinary labels of its own a
language is measured against all) by a z-score of `Z_LEAST` and a factor of
`RATIO_LEAST`. A word is counted once for each different next word, so copies of a
document count once. Stems are taken strongest first, up to `TOXIC_BYTES`, each
without the words that stronger ones explain. Both serve as raw content: the
trained dictionary without its header and entropy tables.

A saving weighs the logarithm of how much more often windows of toxic training
documents save as much, up to `WEIGHT_MOST`. A document has two scores: the weight of
all its windows divided by the square root of their number, and that of its
heaviest run of `RUN` windows likewise, so that a toxic passage does not fade in a
long text. Both thresholds come from documents that the model which scores them has not
seen: either half of the labelled sample is scored by a model of the other, and the
model that is used is then made of both. The threshold of the first score is the
one that maximises the share of toxic documents caught less `FALSE_COST` times the
share of ordinary ones caught; that of the second lies by a factor of `RUN_MARGIN`
above the heaviest run of any ordinary document, and above `RUN_LEAST` windows of
the highest weight. Either makes a document toxic.

At most `train_rows` labelled documents are used, half of them toxic where there
are as many, drawn by a hash of doc_id; whole texts.

Defined results: null, empty and wordless texts have no windows, score 0 and are
not toxic; very long texts are read whole; labels that are null or have no document
count for nothing; repeated labels count once, toxic if any is; with no toxic or no
ordinary label (as with an empty table) nothing is toxic; of equally good thresholds
the lowest is taken; every row is judged by itself, so repeated rows, null ids and
further columns, whatever their names, change nothing.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import kept

TRAIN_ROWS = 2500
STEM_LEAST = 3
STEM_MOST = 12
Z_LEAST = 12.0
RATIO_LEAST = 8.0
TOXIC_BYTES = 4096
ORDINARY_BYTES = 65536
FALSE_COST = 10.0
#: Savings from here on weigh the same.
MOST_SAVED = 8
#: No saving counts for more than this logarithm of a ratio.
WEIGHT_MOST = 5.0
WINDOW_WORDS = 8
#: Windows of a passage.
RUN = 8
RUN_MARGIN = 1.1
#: A passage has the weight of more than so many of the heaviest windows.
RUN_LEAST = 1.5
CARRIER = b"0123456789 abcdefghijklmnopqrstuvwxyz 9876543210 zyxwvutsrqponmlkjihgfedcba "
#: Between a dictionary and the carrier, so that no window goes on into the carrier there.
APART = b"\x00\x01\x02\x03"
#: zstandard never matches the first byte of a frame.
FIRST = b"\x05"
JUDGED = "windows int, hits int, score double, passage double, toxic boolean"

_NO_WORD = re.compile(r"\W+")


def plain(text: str) -> bytes:
    return (" " + _NO_WORD.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace")


def beginnings(word: str) -> list[str]:
    """Stems of a word, shortest first; a space stands for an edge of the word."""
    return [" " + word[:n] for n in range(STEM_LEAST, min(len(word), STEM_MOST) + 1)] + [f" {word} "]


def counts(docs: list[bytes]) -> tuple[Counter[str], int]:
    """How many different words follow each word, and the number of words."""
    pairs: set[tuple[str, str]] = set()
    words = 0
    for raw in docs:
        found = raw.decode("utf-8", "replace").split()
        words += len(found)
        pairs.update(zip(found, [*found[1:], ""]))
    return Counter(word for word, _ in pairs), words


def stems(toxic: dict[str | None, list[bytes]], ordinary: dict[str | None, list[bytes]]) -> list[tuple[str, str]]:
    """Over-represented stems, weakest first, each with its longest beginning that is not; documents by language."""
    own, expected = Counter[str](), Counter[str]()
    for lang, docs in toxic.items():
        there, size = counts(docs)
        other, other_size = counts(ordinary.get(lang) or [raw for o in ordinary.values() for raw in o])
        own.update(there)
        for word, n in other.items():
            expected[word] += n * size / max(1, other_size)
    words: dict[str, list[str]] = {}
    seen, foreseen = Counter[str](), Counter[str]()
    for word in own | expected:
        for stem in beginnings(word):
            words.setdefault(stem, []).append(word)
            seen[stem] += own[word]
            foreseen[stem] += expected[word]

    def z(stem: str) -> float:
        n, e = seen[stem], foreseen[stem]
        return (n - e) / (e + 1) ** 0.5 if n >= RATIO_LEAST * (e + 0.5) else 0.0

    rest = {stem for stem in seen if z(stem) >= Z_LEAST}
    found: list[tuple[str, str]] = []
    size = 0
    while rest:
        stem = max(rest, key=lambda s: (z(s), len(s), s))
        size += len(stem.encode("utf-8", "replace")) + 1
        if z(stem) < Z_LEAST or size > TOXIC_BYTES:
            break
        n = seen[stem]
        # what this stem explains speaks for no other
        for word in words[stem]:
            for s in beginnings(word):
                seen[s] -= own[word]
                foreseen[s] -= expected[word]
            own[word] = 0
            expected[word] = 0
        rest.discard(stem)
        shorter = [stem[: n + 1] for n in range(STEM_LEAST, len(stem) - 1)]
        found.append((stem, next((s for s in reversed(shorter) if foreseen[s] * RATIO_LEAST**2 >= n), stem[:STEM_LEAST])))
    return found[::-1]


def begun(stem: str, short: str) -> bytes:
    """short with the bytes that the stem's next character shares with others."""
    return short.encode("utf-8", "replace") + stem[len(short) : len(short) + 1].encode("utf-8", "replace")[:-1]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on samples; too few to train on are its content themselves."""
    try:
        # content follows the header, which ends with the first three repeat offsets
        return zstandard.train_dictionary(size, samples, k=24, d=8).as_bytes().split(struct.pack("<3I", 1, 4, 8), 1)[-1]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    threshold: float = float("inf")
    run_threshold: float = float("inf")
    weight: np.ndarray = field(default_factory=lambda: np.zeros(MOST_SAVED + 1))
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def lengths(self) -> "Lengths":
        return Lengths(self)


class Lengths:
    """Differences of windows' lengths under a model's dictionaries."""

    def __init__(self, model: Model) -> None:
        self.of = [self.compressor(model.ordinary), self.compressor(model.toxic)]

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content + APART + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(3, source_size=256, dict_size=len(content) + len(APART) + len(CARRIER), write_content_size=0, write_dict_id=0, write_checksum=0, min_match=3, search_log=3, strategy=zstandard.STRATEGY_BTOPT, target_length=64)
        data.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=how)

    def differences(self, text: str | None) -> np.ndarray:
        """For each window, the bytes it is shorter with the toxic dictionary."""
        words = plain(text).split() if text is not None else []
        ordinary, toxic = self.of
        out = np.empty(-(-len(words) // WINDOW_WORDS), dtype=np.int64)
        for i in range(len(out)):
            window = FIRST + b" " + b" ".join(words[i * WINDOW_WORDS : (i + 1) * WINDOW_WORDS]) + b" " + CARRIER
            out[i] = len(ordinary.compress(window)) - len(toxic.compress(window))
        return out


def weights(differences: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weight[np.clip(differences, 0, len(weight) - 1)]


def score(differences: np.ndarray, weight: np.ndarray) -> float:
    return float(weights(differences, weight).sum() / max(1, len(differences)) ** 0.5)


def passage(differences: np.ndarray, weight: np.ndarray) -> float:
    """The score of the heaviest run of RUN windows, or of all where there are fewer."""
    total = np.concatenate([[0.0], np.cumsum(weights(differences, weight))])
    n = min(RUN, len(differences))
    return float((total[n:] - total[: len(total) - n]).max() / max(1, n) ** 0.5)


def fit(rows: list[tuple[int, str, str | None]], seed: int = 3) -> Model:
    """A model from (toxic 0/1, text, language) rows."""
    rows = sorted(rows, key=repr)
    rows = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]
    model = built(rows)
    if model.toxic:
        halves = rows[::2], rows[1::2]
        unseen = []
        for own, other in (halves, halves[::-1]):
            half = built(own)
            lengths = half.lengths()
            unseen += [(bool(t), d, half.weight) for t, x, _ in other for d in (lengths.differences(x),)]
        calibrate(model, [(t, score(d, w)) for t, d, w in unseen])
        model.run_threshold = max([RUN_LEAST * float(model.weight.max()) / RUN**0.5, *(RUN_MARGIN * passage(d, w) for t, d, w in unseen if not t)])
    return model


def built(rows: list[tuple[int, str, str | None]]) -> Model:
    """A model without thresholds; an empty one if there is nothing to tell apart."""
    of: tuple[dict[str | None, list[bytes]], dict[str | None, list[bytes]]] = {}, {}
    for t, x, lang in rows:
        if len(raw := plain(x)) > 2:
            of[bool(t)].setdefault(lang, []).append(raw)
    found = stems(of[1], of[0]) if of[0] and of[1] else []
    if not found:
        return Model()
    ordinary = dictionary([raw[i : i + 40] for docs in of[0].values() for raw in docs for i in range(0, len(raw), 40)], ORDINARY_BYTES)
    # no match may go on from within a stem to what follows it, else it costs no more without the stem
    for stem, _ in found:
        raw = (stem if stem.endswith(" ") else stem[-3:]).encode("utf-8", "replace")
        ordinary = ordinary.replace(raw, b"\x00" * len(raw))
    whole = "\x00".join(["", *(stem for stem, _ in found)]).encode("utf-8", "replace")
    # parts of stems lie in both, nearer than the stems, so that only a whole stem saves
    parts = b"\x00".join([b"", *(part for stem, short in found for part in (stem[2:].encode("utf-8", "replace"), begun(stem, short)))])
    model = Model(ordinary + whole + parts, ordinary + b"\x00" * len(whole) + parts)
    weigh(model, rows)
    return model


def weigh(model: Model, rows: list[tuple[int, str, str | None]]) -> None:
    """Sets the weights: the logarithm of how much more often toxic documents save so many bytes."""
    lengths = model.lengths()
    n = np.zeros((2, MOST_SAVED + 1))
    for t, x, _ in rows:
        n[int(bool(t))] += np.bincount(np.clip(lengths.differences(x), 0, MOST_SAVED), minlength=MOST_SAVED + 1)
    ordinary, toxic = (n + [[1.0], [n[1].sum() / n[0].sum()]]) / n.sum(axis=1, keepdims=True)
    # a word that saves more weighs no less
    model.weight = np.maximum.accumulate(np.clip(np.log(toxic / ordinary), 0, WEIGHT_MOST) / WEIGHT_MOST * (np.arange(MOST_SAVED + 1) > 0))


def calibrate(model: Model, scored: list[tuple[bool, float]]) -> None:
    """Sets the threshold from the scores of unseen rows."""
    y, s = np.array([t for t, _ in scored]), np.array([x for _, x in scored])
    if not y.any() or y.all():
        return
    levels = np.unique(s[s > 0])
    best = -np.inf
    # between two scores that occur, so that neither side is at the edge
    for low, high in zip(np.concatenate([[0.0], levels[:-1]]), levels):
        worth = (s[y] >= high).mean() - FALSE_COST * (s[~y] >= high).mean() + 1e-3 * (high - low)
        if worth > best:
            best, model.threshold = worth, float((low + high) / 2)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from at most about train_rows labelled documents."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") != 0).alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    u = F.pmod(F.xxhash64(F.lit("toxicity sample"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = min(n.get(True, 0), train_rows // 2)
    rate = {True: few / max(1, n.get(True, 0)), False: min(1.0, (train_rows - few) / max(1, n.get(False, 0)))}
    sample = labels.where(u < F.when(F.col("toxic"), rate[True]).otherwise(rate[False]))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", lang.alias("lang")).where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")  # train_rows bounds it
    return fit([(int(r[0]), r[1], r[2]) for r in texts.select("toxic", "text", "lang").collect()])


def judged(text: Column, model: Model) -> Column:
    """Column JUDGED for each text."""

    @F.pandas_udf(JUDGED)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lengths = kept(f"toxicity {model.key}", model.lengths)
        for texts in batches:
            found = [lengths.differences(t) for t in texts]
            s, p = np.array([score(d, model.weight) for d in found]), np.array([passage(d, model.weight) for d in found])
            windows, hits = np.array([len(d) for d in found], dtype=np.int32), np.array([(weights(d, model.weight) > 0).sum() for d in found], dtype=np.int32)
            yield pd.DataFrame({"windows": windows, "hits": hits, "score": s, "passage": p, "toxic": (s >= model.threshold) | (p >= model.run_threshold)})

    return judge(text)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, windows, hits, score, passage, toxic) for each row of docs."""
    return docs.select("doc_id", judged(F.col("text"), model).alias("j")).select("doc_id", "j.*")
