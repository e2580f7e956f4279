"""Language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent, with calibrated rejection.

A document is the mean of the embeddings of its byte n-grams (3, 4 and 5 bytes
inside words and at their edges, hashed); a linear layer and a softmax follow.
As all of that is linear up to the softmax, the embedding table and the layer
are multiplied once after training, and a document's scores are sums of one
table row for each n-gram of its whole text.

The model is fitted on a sample of at most `train_rows` labelled documents
(whole texts), drawn by a hash of doc_id with a rate for each language; a fifth
of it is held out. On that part, and on the same texts with their letters exchanged at random, a
temperature is fitted so that the former are sure of their language and the
latter of none; the threshold is the quantile of held-out confidence under which
`max_reject` of them fall, but at least `least_confidence`. Subwords never seen
have a zero embedding, so a text in an unknown language gets no more than the
languages' prior confidence and is rejected.

Defined results: null, empty and letterless texts have language null,
confidence 0 and are rejected; very long texts are read whole; rows with null lang
or text are no training data, nor are those of languages beyond the `MAX_LANGS` most
frequent labels (of equally frequent ones, the first by name are taken); of equally
likely languages the first by name is taken; every row is judged by itself, so
repeated rows, null ids and further columns, whatever their names, change nothing.
With no labelled row, as in an empty table, there is no model, and all texts are
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.bytehash import chunked, grams, letters

TRAIN_ROWS = 3000
BITS = 18
DIM = 16
EPOCHS = 6
RATE = 0.5
#: An n-gram's share of a text is small; its step is scaled up by this.
SHARE_SCALE = 100.0
SIZES = (3, 4, 5)
#: Languages that are learned, at most: those with the most rows.
MAX_LANGS = 256
MAX_REJECT = 0.0005
LEAST_CONFIDENCE = 0.42
JUDGED = "lang string, confidence double, accepted boolean"


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # a score for each bucket and language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = LEAST_CONFIDENCE

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Mean scores of the n-grams of each text; NaN where there are none."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        inner = letters(digits=False)
        for first, end, buf, starts in chunked(texts):
            total, count = np.zeros((end - first, len(self.langs))), np.zeros(end - first)
            for n in SIZES:
                at, bucket = grams(buf, n, inner, BITS)
                edges = np.searchsorted(at, starts)
                some = np.flatnonzero(edges[1:] > edges[:-1])
                if len(some):
                    total[some] += np.add.reduceat(self.table[bucket], edges[some], axis=0, dtype=np.float64)
                    count[some] += (edges[1:] - edges[:-1])[some]
            with np.errstate(invalid="ignore"):
                out[first:end] = np.where(count[:, None] > 0, total / count[:, None] + self.bias, np.nan)
        return out

    def confidence(self, scores: np.ndarray) -> np.ndarray:
        s = scores / self.temperature
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def judge(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, confidence and acceptance of each text."""
        if not self.langs:
            return [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        scores = self.scores(texts)
        known = ~np.isnan(scores[:, 0])
        p = self.confidence(np.nan_to_num(scores))
        best, top = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
        return [self.langs[b] if k else None for b, k in zip(best, known)], top, known & (top >= self.threshold)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their share."""
    inner = letters(digits=False)
    found = [np.zeros(0, dtype=np.int32)]
    for _, _, buf, _ in chunked([text]):
        found += [grams(buf, n, inner, BITS)[1] for n in SIZES]
    bucket, count = np.unique(np.concatenate(found), return_counts=True)
    return bucket, (count / max(1, count.sum())).astype(np.float32)


def fit(rows: list[tuple[str, str]], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE, max_reject: float = MAX_REJECT, least_confidence: float = LEAST_CONFIDENCE) -> Model:
    """A model from (lang, text) rows, in an order fixed by their content."""
    rng = np.random.default_rng(seed)
    rows = sorted(rows)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), dtype=np.float32), np.zeros(0))
    held, train = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    y = np.array([langs.index(lang) for lang, _ in train])
    x = [features(text) for _, text in train]
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias, seen = np.zeros((DIM, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32), np.zeros(1 << BITS, dtype=bool)
    for b, _ in x:
        seen[b] = True
    steps, step = max(1, epochs * len(x)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            bucket, share = x[i]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(bucket):
                continue
            hidden = share @ table[bucket]
            s = hidden @ layer + bias
            p = np.exp(s - s.max())
            g = p / p.sum()
            g[y[i]] -= 1
            back = layer @ g
            layer -= lr * np.outer(hidden, g).astype(np.float32)
            bias -= lr * 0.1 * g
            table[bucket] -= (lr * SHARE_SCALE) * share[:, None] * back[None, :]
    table[~seen] = 0
    model = Model(langs, (table @ layer).astype(np.float32), bias.astype(np.float64))
    calibrate(model, held or train, max_reject, least_confidence)
    return model


def scrambled(text: str, rng: np.random.Generator) -> str:
    """The text in no language: its letters exchanged for one another by a random key."""
    lower = text.lower()
    alphabet = sorted({c for c in lower if c.isalpha()} | set("abcdefghijklmnopqrstuvwxyz"))
    return lower.translate({ord(a): alphabet[i] for a, i in zip(alphabet, rng.permutation(len(alphabet)))})


def calibrate(model: Model, held: list[tuple[str, str]], max_reject: float, least_confidence: float) -> None:
    """Sets temperature and threshold from held-out rows and their scrambled twins.

    Held-out rows should be sure of their language, twins of none: the
    temperature minimises the cross entropy with those targets.
    """
    rng = np.random.default_rng(11)
    scores = model.scores([text for _, text in held])
    noise = model.scores([scrambled(text, rng) for _, text in held])
    y = np.array([model.langs.index(lang) for lang, _ in held])
    ok = ~np.isnan(scores[:, 0])
    if not ok.any():
        return
    scores, y, noise = scores[ok], y[ok], noise[~np.isnan(noise[:, 0])]

    def loss(t: float) -> float:
        model.temperature = t
        p, q = model.confidence(scores)[np.arange(len(y)), y], model.confidence(noise)
        return -np.log(np.maximum(p, 1e-9)).mean() - np.log(np.maximum(q, 1e-9)).mean()

    model.temperature = min(np.geomspace(0.02, 200, 120), key=loss)
    top = model.confidence(scores).max(axis=1)
    model.threshold = max(least_confidence, float(np.quantile(top, max_reject)) * 0.9)


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from at most about train_rows labelled rows of docs, an equal number for each language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return fit([])
    each = max(1, train_rows // len(counts))
    u = F.pmod(F.xxhash64(F.lit("language sample"), F.col("doc_id"), F.length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    return fit([tuple(r) for r in labelled.where(u < F.try_element_at(rate, F.col("lang"))).select("lang", "text").collect()])


def judged(text: Column, model: Model) -> Column:
    """Column JUDGED for each text."""

    @F.pandas_udf(JUDGED)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, confidence, accepted = model.judge(list(texts))
            yield pd.DataFrame({"lang": pd.Series(lang, dtype=object), "confidence": confidence, "accepted": accepted})

    return judge(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, confidence, accepted) for each row of docs."""
    return docs.select("doc_id", judged(F.col("text"), model).alias("j")).select("doc_id", "j.*")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is recognised, with the columns of docs."""
    return docs.where(judged(F.col("text"), model)["accepted"])
