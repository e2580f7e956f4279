"""Normalising what is written: metric samples and log pushes, into the tables of stores.

Batches are frames; the same functions serve batch jobs and, in foreachBatch,
streams. Later rows win by arrival_seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import labels as L
from brightloom.functions import parsers
from brightloom.sources import wire

INTERVAL_MS = 15_000
SEVERITY_KEYS = ("detected_level", "level", "severity", "severity_text", "lvl")
SEVERITIES = {"trace": "trace", "debug": "debug", "info": "info", "information": "info", "warn": "warn", "warning": "warn", "error": "error", "err": "error", "critical": "critical", "crit": "critical", "fatal": "fatal", "unknown": "unknown"}
_WORDS = {"fatal": "fatal", "critical": "critical", "error": "error", "err": "error", "info": "info"}
SEVERITY_NUMBERS = {"trace": 1, "debug": 5, "info": 9, "": 9, "unknown": 9, "warn": 13, "error": 17, "fatal": 21, "critical": 21}
_EDGE_LEFT, _EDGE_RIGHT = "[ \\t\\n\\[({\"'=|]", "[ \\t\\n\\[\\](){}:,!\"'=|]"


def series_id(labels: Column) -> Column:
    """A stable 64-bit id of a full label set."""
    return F.xxhash64(L.key(labels))


def checked(batch: DataFrame) -> DataFrame:
    """Fails on a label set without a metric name or with an empty label name."""
    labels = F.col("labels")
    bad = (F.coalesce(labels[L.NAME], F.lit("")) == "") | F.map_contains_key(labels, F.lit(""))
    return batch.withColumn("labels", F.when(bad, F.raise_error(F.lit("a series needs a metric name and no empty label names")).cast("map<string,string>")).otherwise(labels))


def samples(batch: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """Rows of the samples table from (team_id, labels, ts_ms, v, is_stale, arrival_seq).

    NaN that marks no staleness is dropped. Times are floored to the write
    interval (0 keeps them), and of a series' samples in one interval the last to
    arrive stays.
    """
    df = checked(batch).where(~F.isnan("v") | F.col("is_stale"))
    if interval_ms:
        df = df.withColumn("ts_ms", F.floor(F.col("ts_ms") / interval_ms).cast("bigint") * interval_ms)
    df = df.select("team_id", series_id(F.col("labels")).alias("id"), F.col("labels")[L.NAME].alias("metric_name"), "ts_ms", "v", "is_stale", "arrival_seq")
    last = df.groupBy("team_id", "id", "metric_name", "ts_ms").agg(F.max_by(F.struct("v", "is_stale"), "arrival_seq").alias("s"), F.max("arrival_seq").alias("arrival_seq"))
    return last.select("team_id", "id", "metric_name", "ts_ms", "s.v", "s.is_stale", "arrival_seq")


def histograms(batch: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """Rows of the histograms table from (team_id, labels, ts_ms, h); the version is the time as written."""
    floored = F.floor(F.col("ts_ms") / interval_ms).cast("bigint") * interval_ms if interval_ms else F.col("ts_ms")
    return checked(batch).select("team_id", series_id(F.col("labels")).alias("id"), floored.alias("ts_ms"), F.col("ts_ms").alias("version"), "h")


def new_series(batch: DataFrame, known: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """Rows of the series table for label sets that `known` lacks, with the batch's first and last time."""
    floored = F.floor(F.col("ts_ms") / interval_ms).cast("bigint") * interval_ms if interval_ms else F.col("ts_ms")
    df = checked(batch).where(~F.isnan("v") | F.col("is_stale")).withColumn("key", L.key(F.col("labels"))).withColumn("ts_ms", floored)
    found = df.groupBy("team_id", "key").agg(F.min("ts_ms").alias("min_time_ms"), F.max("ts_ms").alias("max_time_ms"))
    full = L.from_key(F.col("key"))
    rows = found.select("team_id", F.xxhash64("key").alias("id"), full[L.NAME].alias("metric_name"), L.without(full, [L.NAME]).alias("labels"), "min_time_ms", "max_time_ms")
    return rows.join(known.select("team_id", "id"), ["team_id", "id"], "left_anti")


def severity(line: Column) -> Column:
    """A line's severity: from its JSON or logfmt keys, else from the first severity word that stands alone, else unknown."""
    spelt = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    known = lambda c: F.try_element_at(spelt, F.lower(F.trim(c)))
    fields = parsers.logfmt_labels(line)
    explicit = [known(F.get_json_object(line, f"$.{k}")) for k in SEVERITY_KEYS] + [known(fields[k]) for k in SEVERITY_KEYS]
    word = F.regexp_extract(F.lower(line), f"(?:^|(?<={_EDGE_LEFT}))({'|'.join(_WORDS)})(?=$|{_EDGE_RIGHT})", 1)
    return F.coalesce(*explicit, F.try_element_at(F.create_map(*[F.lit(x) for kv in _WORDS.items() for x in kv]), word), F.lit("unknown"))


def severity_number(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_NUMBERS.items() for x in kv]), F.lower(text)), F.lit(0))


PUSH_DDL = "streams array<struct<stream:map<string,string>,labels:string,values:array<array<string>>,entries:array<struct<ts:string,timestamp:string,line:string>>>>"


def push_entries(bodies: DataFrame) -> DataFrame:
    """(labels, ts_ns, line, metadata) from JSON push bodies in column `body`.

    An entry is [time in ns, line, metadata] in values, or {ts or timestamp, line} in entries.
    """
    s = bodies.select(F.explode(F.from_json("body", PUSH_DDL)["streams"]).alias("s"))
    spelt = F.regexp_extract_all("s.labels", F.lit(r'([a-zA-Z_][a-zA-Z0-9_.]*)\s*=\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)), F.regexp_extract_all("s.labels", F.lit(r'([a-zA-Z_][a-zA-Z0-9_.]*)\s*=\s*"((?:[^"\\]|\\.)*)"'), F.lit(2))
    labels = F.coalesce("s.stream", F.when(F.col("s.labels").isNotNull(), F.map_from_arrays(*spelt)), L.empty())
    values = s.select(labels.alias("labels"), F.explode("s.values").alias("e")).select("labels", F.get("e", F.lit(0)).cast("bigint").alias("ts_ns"), F.get("e", F.lit(1)).alias("line"), F.coalesce(F.from_json(F.get("e", F.lit(2)), "map<string,string>"), L.empty()).alias("metadata"))
    stamp = F.coalesce("e.ts", "e.timestamp")
    ns = F.coalesce(stamp.try_cast("bigint"), F.unix_micros(F.try_to_timestamp(stamp)) * 1000)
    entries = s.select(labels.alias("labels"), F.explode("s.entries").alias("e")).select("labels", ns.alias("ts_ns"), F.col("e.line").alias("line"), L.empty().alias("metadata"))
    return values.unionByName(entries)


_PAIRS = r'([a-zA-Z_][a-zA-Z0-9_.]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def binary_push_entries(bodies: DataFrame) -> DataFrame:
    """(labels, ts_ns, line, metadata) from binary push bodies in column `body`; an unreadable body fails the batch."""
    rows = wire.pushed(bodies)
    spelt = F.regexp_extract_all("labels", F.lit(_PAIRS), F.lit(1)), F.regexp_extract_all("labels", F.lit(_PAIRS), F.lit(2))
    labels = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("push body: "), "error")).cast("map<string,string>")).otherwise(F.map_from_arrays(*spelt))
    return rows.select(labels.alias("labels"), "ts_ns", "line", F.coalesce("metadata", L.empty()).alias("metadata"))


def write_tables(bodies: DataFrame, team_id: int, interval_ms: int = INTERVAL_MS) -> dict[str, DataFrame]:
    """What the write requests in column `body` add to each table: series, samples, histograms, exemplars, metadata, and errors."""
    rows = wire.written(bodies).withColumn("team_id", F.lit(team_id).cast("bigint"))
    none = bodies.sparkSession.createDataFrame([], "team_id bigint, id bigint")
    of = lambda kind: rows.where(F.col("kind") == kind)
    points = of("sample").select("team_id", "labels", "ts_ms", "v", "is_stale", "arrival_seq")
    native = of("histogram").select("team_id", "labels", "ts_ms", "h")
    every = rows.where(F.col("kind").isin("sample", "histogram")).select("team_id", "labels", "ts_ms", F.lit(0.0).alias("v"), F.lit(True).alias("is_stale"))  # not a union, which decodes every body twice
    return {
        "series": new_series(every, none, interval_ms),
        "samples": samples(points, interval_ms),
        "histograms": histograms(native, interval_ms),
        "exemplars": of("exemplar").select("team_id", series_id(F.col("labels")).alias("id"), "ts_ms", "v", F.col("exemplar").alias("labels")),
        "metadata": of("metadata").select("team_id", "family", "type", "unit", "help", F.col("arrival_seq").alias("updated_at_ms")),
        "errors": rows.where(F.col("error").isNotNull()).select("arrival_seq", "error"),
    }


def log_rows(entries: DataFrame, team_id: int, observed_ns: Column, retention_ms: int = 31 * 86_400_000) -> DataFrame:
    """Normalised log rows with their streams, from (labels, ts_ns, line, metadata).

    Metadata named resource_x or resource.x are resource attributes, the rest
    fields. Service name and level are written under their canonical names; a
    level that nothing names is inferred from the line. Trace and span ids stay
    stream labels where they are such, else they are fields.
    """
    labels, meta = F.col("labels"), F.col("metadata")
    is_resource = lambda k, _: k.startswith("resource_") | k.startswith("resource.")
    resource = F.transform_keys(F.map_filter(meta, is_resource), lambda k, _: F.substring(k, 10, 1 << 20))
    rest = F.map_filter(meta, lambda k, v: ~is_resource(k, v))
    df = entries.select("ts_ns", "line", labels.alias("labels"), rest.alias("fields"), resource.alias("resource_attributes"))
    labels, fields = F.col("labels"), F.col("fields")
    service = F.coalesce(F.nullif(L.aliased(fields, "service_name"), F.lit("")), F.nullif(L.aliased(labels, "service_name"), F.lit("")), F.col("resource_attributes")["service.name"])
    level = F.coalesce(F.nullif(L.aliased(fields, "level"), F.lit("")), F.nullif(L.aliased(labels, "level"), F.lit("")), severity(F.col("line")))
    names = [*L.SERVICES, *L.LEVELS]
    stream = L.put(L.put(L.without(labels, names), "service_name", service), "level", level)
    df = df.withColumn("stream", F.map_filter(stream, lambda k, v: (k != "") & (v != ""))).withColumn("fields", F.map_filter(L.without(fields, names), lambda k, v: (k != "") & (v != "")))
    return df.select(
        F.lit(team_id).cast("bigint").alias("team_id"), "ts_ns", observed_ns.alias("observed_ns"), F.xxhash64(L.key(F.col("stream")), L.key(F.col("resource_attributes"))).alias("stream_id"), "line", "fields",
        (F.floor(F.col("ts_ns") / 1_000_000) + retention_ms).cast("bigint").alias("expires_at_ms"), F.col("stream").alias("labels"), "resource_attributes", F.col("stream")["level"].alias("severity_text"), severity_number(F.col("stream")["level"]).alias("severity_number"),
    )


def log_streams(rows: DataFrame) -> DataFrame:
    """Rows of the streams table of normalised log rows."""
    found = rows.groupBy("team_id", "stream_id").agg(F.any_value(F.struct("labels", "resource_attributes")).alias("s"), F.floor(F.max("observed_ns") / 1_000_000).alias("updated_at_ms"))
    return found.select("team_id", "stream_id", "s.labels", "s.resource_attributes", "updated_at_ms")


def log_stream_labels(streams: DataFrame) -> DataFrame:
    """(team_id, label_name, label_value, stream_id) of stream rows."""
    return streams.select("team_id", "stream_id", F.explode(L.merge(F.col("resource_attributes"), F.col("labels"))).alias("label_name", "label_value")).distinct()


def log_stats(rows: DataFrame) -> DataFrame:
    """(team_id, stream_id, bucket_ms, log_count, byte_count) for each minute."""
    bucket = (F.floor(F.col("ts_ns") / 60_000_000_000) * 60_000).cast("bigint")
    return rows.groupBy("team_id", "stream_id", bucket.alias("bucket_ms")).agg(F.count(F.lit(1)).alias("log_count"), F.sum(F.octet_length("line")).alias("byte_count"))


def label_index(series: DataFrame) -> DataFrame:
    """(team_id, metric_name, label_name, label_value, id) of series rows."""
    return series.select("team_id", "metric_name", "id", F.explode("labels").alias("label_name", "label_value"))


def attribute_counts(rows: DataFrame, attributes: str, ts_ms: str) -> DataFrame:
    """(attribute_key, attribute_value, bucket_ms, n) for each 10 minutes; keys and values of under 256 characters."""
    bucket = (F.floor(F.col(ts_ms) / 600_000) * 600_000).cast("bigint")
    pairs = rows.select(bucket.alias("bucket_ms"), F.explode(attributes).alias("attribute_key", "attribute_value"))
    return pairs.where((F.length("attribute_key") < 256) & (F.length("attribute_value") < 256)).groupBy("attribute_key", "attribute_value", "bucket_ms").agg(F.count(F.lit(1)).alias("n"))


def parquet_series(tags: DataFrame, data: DataFrame, team_id: int, values: list[str], ts_ms: str, tag_id: str) -> tuple[DataFrame, DataFrame]:
    """(series, samples) from wide Parquet: tags has tag_id and label columns, data has tag_id, a time and a column for each metric."""
    names = [c for c in tags.columns if c != tag_id]
    long = data.select(tag_id, F.col(ts_ms).alias("ts_ms"), F.explode(F.create_map(*[x for v in values for x in (F.lit(v), F.col(v).cast("double"))])).alias("metric_name", "v")).where("v is not null")
    full = L.build([(L.NAME, F.col("metric_name")), *[(n, F.col(n)) for n in names]])
    rows = long.join(tags, tag_id).select(F.lit(team_id).cast("bigint").alias("team_id"), full.alias("labels"), "ts_ms", "v", F.lit(False).alias("is_stale"), F.lit(0).cast("bigint").alias("arrival_seq"))
    known = tags.sparkSession.createDataFrame([], "team_id bigint, id bigint")
    return new_series(rows, known, 0), samples(rows, 0)
