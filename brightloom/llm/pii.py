"""Personal identifiers by bootstrapped contextual extraction.

Candidates are the tokens of a text that hold a digit or an @; neighbouring
tokens of short digit runs and punctuation only are one candidate. A candidate
is an instance (its characters) and has lexical patterns: its shape (runs of
letters, long hexadecimal and upper-case codes, and digits with their number),
the same with digit runs up to four alike, the shape with the word before it and
with the two before it, these two words alone, and what stands before an = or :
inside it.

Seeds are few: of the instances that a type's seed recogniser matches, those that
a hash draws with `SEED_SHARE`; the recognisers say nothing about the others,
which are found through patterns or not at all. Results tell either (`seed`).

The corpus becomes a graph between patterns and instances, aggregated over all
documents. For each type, iteratively:

* a pattern's confidence is the mean belief of its instances, taken over a
  smoothing `PRIOR` of unbelieved ones, and a pattern is trusted from
  `PATTERN_LEAST` on if it has at least `SUPPORT` believed instances; in the first
  round, when only seeds are believed, over the share of them that can be seeds;
* an instance's belief is 1 for a seed, else the highest confidence (in steps of
  0.01) that its trusted patterns have had; it never falls, so the rounds end, and
  they go on until no belief changes.

The negative type `number` (plain years, versions, ordinals) competes with the
others: what a pattern passes on is its strongest type, and numbers are not
reported. Occurrences of instances believed from `INSTANCE_LEAST` on are reported.

Identifiers never leave the task that reads the text: instances are known by 128
bits of SHA-256 over a secret salt and their characters, patterns (which hold words
of the text) by a salted hash; only these are shuffled, checkpointed and returned.
The salt is drawn for each call unless one is given, as a holder of it can test
guesses.

Defined results: null, empty and candidate-free texts give nothing; very long texts
are read whole; a null doc_id is carried through; repeated rows are reported as
often as they occur and weigh in the graph once for each distinct instance; of
types with equal belief the last by name is taken; a corpus with fewer than
`SUPPORT` seeds of a type yields its seeds alone; an empty table gives no rows;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import cut

SEED_SHARE = 0.2
PRIOR = 1.0
SUPPORT = 2
PATTERN_LEAST = 0.6
INSTANCE_LEAST = 0.5
NEGATIVE = "number"

_TOKEN = re.compile(r"\S+")
_DIGITS_ONLY = re.compile(r"\+?\(?\d[\d()/-]*\Z")
_GOES_ON = re.compile(r"\(?\d[\d()/-]*\Z")
_LONG_RUN = re.compile(r"\d{5}")
_EDGE = " \t\n\r.,;:!?\"'`<>[]{}#*%$&|"
_RUN = re.compile(r"[a-z]+|[A-Z]+|\d+|[^\W\d_a-zA-Z]+|\s+|[^\s]", re.ASCII)
_SHORT_RUN = re.compile(r"9\{[1-4]\}")
_HEX = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{12,}")
_UPPER_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-F]*[0-9])(?=[0-9A-F]*[A-F])[0-9A-F]{12,}(?![0-9A-Za-z])")
_MIXED_UPPER = re.compile(r"(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{12,}")

SEEDS = {
    "email": r"^[A-Za-z0-9._%+\-\x80-\x{10FFFF}]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)+$",
    "phone": r"^\+\d{1,3} \(\d{2,4}\) \d{3,4}-\d{3,4}$",
    "ip": r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$",
    "card": r"^\d{15,16}$",
    "secret": r"^((password|passwd|secret|token|api_?key)=\S{8,}|[0-9a-f]{40}|AKIA[0-9A-Z]{16})$",
    NEGATIVE: r"^(\d{1,4}|\d{1,3}(\.\d{1,3}){1,2}|\d{1,3}(st|nd|rd|th)|[A-Za-z]{1,12}-?\d{1,3})$",
}
FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
FOUND_DDL = "doc_id long, start int, end int, instance string, patterns array<string>"


def shape(s: str) -> str:
    """Runs of characters by kind: a lower, A upper, h long hex of either case, X long upper with digits, 9{n} digits, u other letters."""
    s = _MIXED_UPPER.sub("\x01", _UPPER_HEX.sub("\x00", _HEX.sub("\x00", s)))
    out = []
    for m in _RUN.finditer(s):
        r = m.group()
        c = r[0]
        if c == "\x00" or c == "\x01":
            out.append("h" if c == "\x00" else "X")
        elif c.isdigit() and c.isascii():
            out.append(f"9{{{len(r)}}}")
        elif c.isspace():
            out.append(" ")
        elif c.isalpha() and c.isascii():
            out.append("a" if c.islower() else "A")
        else:
            out.append("u" if c.isalpha() else c)
    # letters of any alphabet in one run are one kind
    return re.sub(r"[au]+", "a", "".join(out))


def candidates(text: str | None) -> Iterator[tuple[int, int, str, list[str]]]:
    """Start, end, characters and patterns of each candidate."""
    if not text:
        return
    before = ["^", "^"]
    tokens = list(_TOKEN.finditer(text))
    i = 0
    while i < len(tokens):
        m = tokens[i]
        token = m.group()
        start = m.start() + len(token) - len(token.lstrip(_EDGE))
        end = m.end() - (len(token) - len(token.rstrip(_EDGE)))
        core = text[start:end]
        nxt = i + 1
        if core and ("@" in core or any(c.isdigit() for c in core)):
            if _DIGITS_ONLY.match(core) and end == m.end() and not _LONG_RUN.search(core):
                while nxt < len(tokens):
                    more = tokens[nxt].group().rstrip(_EDGE)
                    if not _GOES_ON.match(more) or _LONG_RUN.search(more) or tokens[nxt].start() - end != 1 or text[end] != " ":
                        break
                    end = tokens[nxt].start() + len(more)
                    nxt += 1
                    if end != tokens[nxt - 1].end():
                        break
                core = text[start:end]
            # a bracket without its partner is not part of the instance
            while core.endswith(")") and core.count(")") > core.count("("):
                end -= 1
                core = text[start:end]
            while core.startswith("(") and core.count("(") > core.count(")"):
                start += 1
                core = text[start:end]
            kind = shape(core)
            patterns = [f"s:{kind}", "c:" + _SHORT_RUN.sub("9", kind), f"1:{before[-1]} {kind}", f"2:{before[-2]} {before[-1]} {kind}", f"b:{before[-2]} {before[-1]}"]
            key = re.match(r"([^\W\d]+)\s*[=:]", core)
            if key:
                patterns.append(f"k:{key.group(1).lower()}")
            yield start, end, core, patterns
        before = [before[-1], text[tokens[nxt - 1].start() : tokens[nxt - 1].end()].strip(_EDGE).lower() or token]
        i = nxt


def occurrences(docs: DataFrame, salt: str) -> DataFrame:
    """(doc_id, start, end, instance, kind, draw, patterns): every candidate of every text with a digit or an @.

    instance and patterns are salted hashes, kind the type whose seed recogniser
    matches (null for none), draw a number under 1000 that follows from the instance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows += [(doc, a, b, s, p) for a, b, s, p in candidates(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(FOUND)], schema=FOUND)

    some = docs.where(F.col("text").rlike(r"[0-9@]")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = F.col("instance")
    return some.mapInArrow(run, FOUND_DDL).select(
        "doc_id",
        "start",
        "end",
        F.left(F.sha2(F.concat(F.lit(salt), raw), 256), F.lit(32)).alias("instance"),
        F.coalesce(*[F.when(raw.rlike(r), F.lit(t)) for t, r in SEEDS.items()]).alias("kind"),
        F.pmod(F.xxhash64(F.lit("seed"), raw), F.lit(1000)).cast("int").alias("draw"),
        F.transform("patterns", lambda p: F.xxhash64(F.lit(salt), p)).alias("patterns"),
    )


def is_seed(share: float) -> Column:
    """Whether an occurrence is one of a seed."""
    return F.col("kind").isNotNull() & (F.col("draw") < round(1000 * share))


def beliefs(found: DataFrame, share: float = SEED_SHARE) -> tuple[DataFrame, DataFrame]:
    """(instance, type, belief) and (pattern, type, confidence), when no belief changes any more."""
    graph = cut(found.select("instance", F.explode("patterns").alias("pattern")).distinct())
    sizes = cut(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    seeds = cut(found.where(is_seed(share)).select("instance", F.col("kind").alias("type"), F.lit(1.0).alias("belief"), F.lit(True).alias("seed")).distinct())
    believed, state, full = seeds, None, F.col("n") * share
    while True:
        scored = (
            graph.join(believed, "instance")
            .groupBy("pattern", "type")
            .agg(F.sum("belief").alias("sum"), F.count(F.lit(1)).alias("support"))
            .join(sizes, "pattern")
            .withColumn("confidence", F.least(F.lit(1.0), F.col("sum") / (full + PRIOR * (1.0 - F.least(F.lit(1.0), F.col("sum") / full)))))
        )
        best = scored.groupBy("pattern").agg(F.max_by(F.struct("type", "confidence", "support"), F.struct("confidence", "type")).alias("b")).select("pattern", "b.*")
        trusted = best.where((F.col("confidence") >= PATTERN_LEAST) & (F.col("support") >= SUPPORT)).select("pattern", "type", "confidence")
        carried = graph.join(trusted, "pattern").select("instance", "type", F.floor(F.col("confidence") * 100 + 1e-9) / 100, F.lit(False)).toDF("instance", "type", "belief", "seed")
        whole = carried.unionByName(believed).groupBy("instance").agg(F.max(F.struct("seed", "belief", "type")).alias("b"))
        believed = cut(whole.select("instance", "b.type", "b.belief", "b.seed"))
        now = tuple(believed.agg(F.count(F.lit(1)), F.sum(F.round(F.col("belief") * 100).cast("long")), F.sum(F.xxhash64("type").cast("decimal(38,0)"))).first())
        if now == state:
            return believed.drop("seed"), trusted
        state, full = now, F.col("n").cast("double")


def identifiers(docs: DataFrame, share: float = SEED_SHARE, salt: str | None = None) -> DataFrame:
    """(doc_id, type, start, end, belief, seed, instance_hash) of each identifier found."""
    found = cut(occurrences(docs, salt or secrets.token_hex(16)))
    believed, _ = beliefs(found, share)
    sure = believed.where((F.col("belief") >= INSTANCE_LEAST) & (F.col("type") != NEGATIVE))
    return (
        found.select("doc_id", "start", "end", "instance", is_seed(share).alias("seed"))
        .join(sure, "instance")
        .select("doc_id", "type", "start", "end", "belief", "seed", F.col("instance").alias("instance_hash"))
    )
