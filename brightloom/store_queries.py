"""Registered queries over the normalised stores, the protocols' bodies and wide OpenTelemetry tables, all made of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom import engine, metadata
from brightloom.functions import labels as L
from brightloom.operators import histograms as H
from brightloom.queries import BOTH, DAY, END, HOUR, NS, ORACLES as PLAIN, START, _grid, _latest, flat
from brightloom.sources import ingest, otel, stores, wire
from brightloom.sources.stores import LogStore, MetricStore, micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NAME = "event_value"
_E = BOTH[:1]


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def batch(spark: SparkSession, d: str) -> DataFrame:
    """Events as written samples of tenant 1, values over 90 as marks of staleness, and those of tenant 2, which are others."""
    labels = L.build([(L.NAME, F.lit(NAME)), ("event_type", F.col("event_type")), ("user_id", F.col("user_id"))])
    own = events(spark, d).select(F.lit(1).cast("bigint").alias("team_id"), labels.alias("labels"), "ts_ms", F.col("value").alias("v"), F.lit(False).alias("is_stale"), F.col("event_id").alias("arrival_seq"))
    return own.unionByName(own.withColumns({"team_id": F.lit(2).cast("bigint"), "v": F.col("v") + 1000}))


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "team_id bigint, id bigint")


def metric_store(spark: SparkSession, d: str, stale: bool = False) -> MetricStore:
    rows = batch(spark, d)
    if stale:
        rows = rows.withColumn("is_stale", F.col("v") > 90)
    daily = H.from_values(events(spark, d).select("event_type", (F.floor(F.col("ts_ms") / DAY) * DAY).cast("bigint").alias("ts_ms"), (F.col("value") + 0.5).alias("v")), ["event_type", "ts_ms"])
    native = daily.select(F.lit(1).cast("bigint").alias("team_id"), L.build([(L.NAME, F.lit("event_native")), ("event_type", F.col("event_type"))]).alias("labels"), "ts_ms", "h")
    series = ingest.new_series(rows.drop("arrival_seq").unionByName(native.select("team_id", "labels", "ts_ms", F.lit(0.0).alias("v"), F.lit(False).alias("is_stale"))), none(spark), 0)
    traced = rows.where("team_id = 1 and v > 95").select("team_id", ingest.series_id(F.col("labels")).alias("id"), "ts_ms", "v", F.create_map(F.lit("trace_id"), F.col("arrival_seq").cast("string")).alias("labels"))
    families = events(spark, d).select(F.lit(1).cast("bigint").alias("team_id"), F.col("event_type").alias("family"), F.lit("gauge").alias("type"), F.lit("").alias("unit"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("help"), F.col("event_id").alias("updated_at_ms"))
    return MetricStore(series, ingest.samples(rows, 0), 1, ingest.histograms(native, 0), traced, families)


def ranged(store: object, text: str, names: tuple[str, ...], step: int = HOUR, lookback: int = HOUR) -> DataFrame:
    return flat(engine.promql_range(store, text, START, END, step, lookback), names)


@query(PLAIN["promql_sum_by"])
def store_sum_by(spark: SparkSession, d: str) -> DataFrame:
    return ranged(metric_store(spark, d), "sum by (event_type) (event_value)", _E)


@query(PLAIN["promql_rate"])
def store_rate(spark: SparkSession, d: str) -> DataFrame:
    return ranged(metric_store(spark, d), "rate(event_value[1d]) * 3600", BOTH)


@query(_latest("SELECT event_type, user_id, ts, round(v, 6) AS value FROM l WHERE v <= 90 AND regexp_full_match(user_id, '[1-4].*') AND event_type <> 'error'"))
def store_staleness(spark: SparkSession, d: str) -> DataFrame:
    """A newest sample that marks staleness hides its series; matchers select series by id."""
    return ranged(metric_store(spark, d, stale=True), 'event_value{user_id=~"[1-4].*",event_type!="error"}', BOTH)


@query(f"WITH {_grid(START, END, HOUR)} SELECT ts, 1.0 AS value FROM g")
def store_contradiction(spark: SparkSession, d: str) -> DataFrame:
    """Matchers that leave a label no value are an empty relation, so vector(1) is all there is."""
    return ranged(metric_store(spark, d), 'count(event_value{event_type="click",event_type="view"}) or vector(1)', ())


@query(f"SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type IN ('click', 'view') AND epoch_us(ts) // 1000 BETWEEN {START} AND {START + DAY}")
def store_active_series(spark: SparkSession, d: str) -> DataFrame:
    found = metadata.series(metric_store(spark, d), ['event_value{event_type=~"click|view"}'], START, START + DAY)
    return found.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"))


@query("SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS trace_id, epoch_us(ts) // 1000 AS ts_ms, round(value, 6) AS value FROM events WHERE value > 95 AND event_type IN ('click', 'view')")
def store_exemplars(spark: SparkSession, d: str) -> DataFrame:
    found = metadata.exemplars(metric_store(spark, d), 'rate(event_value{event_type="click"}[5m]) or on (user_id) event_value{event_type="view"}', START, END)
    return found.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"), F.col("exemplar_labels")["trace_id"].alias("trace_id"), "ts_ms", F.round("v", 6).alias("value"))


@query("SELECT event_type AS family, 'gauge' AS type, '' AS unit, 'user ' || arg_max(user_id, event_id) AS help FROM events GROUP BY event_type")
def store_families(spark: SparkSession, d: str) -> DataFrame:
    return metadata.families(metric_store(spark, d))


@query("SELECT 'event_type' AS label_name, event_type AS label_value, count(DISTINCT user_id) AS n FROM events GROUP BY event_type UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(DISTINCT event_type) FROM events GROUP BY user_id")
def ingest_label_index(spark: SparkSession, d: str) -> DataFrame:
    index = ingest.label_index(ingest.new_series(batch(spark, d).where("team_id = 1"), none(spark), 0))
    return index.groupBy("label_name", "label_value").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT attribute_key, attribute_value, bucket_ms, count(*) AS n FROM (
    SELECT 'event_type' AS attribute_key, event_type AS attribute_value, epoch_us(ts) // 600000000 * 600000 AS bucket_ms FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), epoch_us(ts) // 600000000 * 600000 FROM events) AS pairs GROUP BY ALL""")
def ingest_attribute_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("ts_ms", F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"), F.lit("long"), F.repeat(F.lit("x"), 256)).alias("attributes"))
    return ingest.attribute_counts(rows, "attributes", "ts_ms")


@query("SELECT metric_name, \"user\", count(*) AS n, round(sum(v), 4) AS total FROM (SELECT 'value' AS metric_name, 'u' || user_id AS \"user\", value AS v FROM events UNION ALL SELECT 'event_id', 'u' || user_id, event_id FROM events) AS long GROUP BY ALL")
def ingest_parquet_series(spark: SparkSession, d: str) -> DataFrame:
    """Wide Parquet of tags and values as series and samples, joined again."""
    e = events(spark, d)
    tags = e.select("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user")).distinct()
    series, samples = ingest.parquet_series(tags, e.select("user_id", "ts_ms", "value", "event_id"), 1, ["value", "event_id"], "ts_ms", "user_id")
    return samples.join(series.select("id", "labels"), "id").groupBy("metric_name", F.col("labels")["user"].alias("user")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


# native histograms; buckets of the eighth root of 2, values moved from 0
_B = f"""WITH v AS (SELECT event_type, epoch_us(ts) // 1000 // {DAY} * {DAY} AS ts, value + 0.5 AS v, ceil(log2(value + 0.5) * 8) AS i FROM events),
    b AS (SELECT event_type, ts, i, count(*) AS c, sum(count(*)) OVER (PARTITION BY event_type, ts ORDER BY i) AS cum, sum(count(*)) OVER (PARTITION BY event_type, ts) AS n FROM v GROUP BY event_type, ts, i)"""


@query(f"{_B} SELECT event_type, ts, round(min_by(exp2((i - 1) / 8 + (n * 0.75 - (cum - c)) / c / 8), i), 6) AS value FROM b WHERE cum >= n * 0.75 GROUP BY event_type, ts".replace("exp2(", "pow(2, "))
def native_histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    return ranged(metric_store(spark, d), "histogram_quantile(0.75, event_native)", _E, DAY, DAY)


@query(f"{_B} SELECT ts, round(sum(v) + count(*) * 2 + avg(v), 6) AS value FROM v GROUP BY ts")
def native_histogram_sum(spark: SparkSession, d: str) -> DataFrame:
    """Histograms added over series, and read."""
    return ranged(metric_store(spark, d), "histogram_sum(sum(event_native)) + histogram_count(sum(event_native * 2)) + histogram_avg(sum(event_native))", (), DAY, DAY)


@query(f"{_B} SELECT event_type, ts, round(var_pop + sqrt(var_pop), 6) AS value FROM (SELECT event_type, ts, sum((pow(2, (i - 0.5) / 8) - m) ** 2) / count(*) AS var_pop FROM (SELECT *, avg(v) OVER (PARTITION BY event_type, ts) AS m FROM v) AS w GROUP BY event_type, ts) AS x")
def native_histogram_spread(spark: SparkSession, d: str) -> DataFrame:
    return ranged(metric_store(spark, d), "histogram_stdvar(event_native) + histogram_stddev(event_native)", _E, DAY, DAY)


@query(f"{_B} SELECT event_type, ts, round(count(*) FILTER (WHERE i <= 40) / count(*), 6) AS value FROM v GROUP BY event_type, ts")
def native_histogram_fraction(spark: SparkSession, d: str) -> DataFrame:
    return ranged(metric_store(spark, d), "histogram_fraction(0, 32, event_native)", _E, DAY, DAY)


# logs


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as pushed entries (labels, ts_ns, line, metadata)."""
    meta = F.create_map(F.lit("trace_id"), F.col("event_id").cast("string"), F.lit("resource_zone"), F.concat(F.lit("z"), F.pmod("user_id", F.lit(3)).cast("string")))
    return events(spark, d).select(F.create_map(F.lit("app"), F.lit("events"), F.lit("event_type"), F.col("event_type")).alias("labels"), (micros("ts") * 1000).alias("ts_ns"), F.concat(F.lit("an "), "event_type", F.lit(": "), "props").alias("line"), meta.alias("metadata"))


def log_store(spark: SparkSession, d: str, minutes: bool = False) -> LogStore:
    rows = ingest.log_rows(entries(spark, d), 1, F.lit(END * NS))
    other = ingest.log_rows(entries(spark, d), 2, F.lit(END * NS))
    both = rows.unionByName(other)
    return LogStore.tables(both.drop("labels", "resource_attributes"), ingest.log_streams(both), 1, ingest.log_stats(both) if minutes else None)


def log_ranged(store: LogStore, text: str, names: tuple[str, ...]) -> DataFrame:
    return flat(engine.logql_range(store, text, START * NS, END * NS, HOUR * NS), names)


_EVENTS = "s AS (SELECT event_type, epoch_us(ts) * 1000 AS t, 'an ' || event_type || ': ' || props AS line, CASE WHEN event_type = 'error' THEN 'error' ELSE 'unknown' END AS level, 'z' || user_id % 3 AS zone, CAST(event_id AS VARCHAR) AS trace_id FROM events)"
_G = _grid(START * NS, END * NS, HOUR * NS)
_IN = f"g JOIN s ON s.t > g.ts - {2 * HOUR * NS} AND s.t <= g.ts"


@query(f"WITH {_EVENTS}, {_G} SELECT level, g.ts // {NS} AS ts, CAST(count(*) AS DOUBLE) AS value FROM {_IN} WHERE event_type <> 'view' GROUP BY level, g.ts")
def log_store_count(spark: SparkSession, d: str) -> DataFrame:
    """Rows joined with their streams; the level was inferred from the line."""
    return log_ranged(log_store(spark, d), 'sum by (level) (count_over_time({app="events",event_type!="view"}[2h]))', ("level",))


@query(f"WITH {_EVENTS}, {_G} SELECT zone, g.ts // {NS} AS ts, CAST(count(*) AS DOUBLE) AS value FROM {_IN} WHERE zone <> 'z0' AND trace_id LIKE '%7' GROUP BY zone, g.ts".replace("SELECT zone,", "SELECT").replace("GROUP BY zone, g.ts", "GROUP BY g.ts"))
def log_store_resource(spark: SparkSession, d: str) -> DataFrame:
    """A matcher on a resource attribute and a filter on a field."""
    return log_ranged(log_store(spark, d), 'sum(count_over_time({zone=~"z[12]"} | trace_id=~".*7" [2h]))', ())


@query(f"WITH s AS (SELECT event_type, (epoch_us(ts) // 60000000 + 1) * 60000000000 AS t, 'an ' || event_type || ': ' || props AS line FROM events), {_G} SELECT event_type, g.ts // {NS} AS ts, round(count(*) / 7200.0, 6) AS value FROM {_IN} GROUP BY event_type, g.ts")
def log_store_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Answered from the counts of each minute; logs are not read."""
    return log_ranged(log_store(spark, d, minutes=True), 'sum by (event_type) (rate({app="events"}[2h]))', _E)


@query(f"WITH s AS (SELECT event_type, (epoch_us(ts) // 60000000 + 1) * 60000000000 AS t, 'an ' || event_type || ': ' || props AS line FROM events), {_G} SELECT event_type, g.ts // {NS} AS ts, CAST(sum(strlen(line)) AS DOUBLE) AS value FROM {_IN} GROUP BY event_type, g.ts")
def log_store_minutes_bytes(spark: SparkSession, d: str) -> DataFrame:
    return log_ranged(log_store(spark, d, minutes=True), 'sum by (event_type) (bytes_over_time({app="events"}[2h]))', _E)


@query("SELECT DISTINCT event_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'unknown' END AS level FROM events WHERE event_type IN ('click', 'error')")
def log_store_series(spark: SparkSession, d: str) -> DataFrame:
    found = metadata.log_series(log_store(spark, d), ['{event_type="click"}', '{level="error"}'], START * NS, END * NS)
    return found.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["level"].alias("level"))


@query("SELECT event_type, count(*) AS n, min(epoch_us(ts) * 1000) AS first_ns, max(epoch_us(ts) * 1000) AS last_ns FROM events GROUP BY event_type")
def log_store_streams(spark: SparkSession, d: str) -> DataFrame:
    """Rows grouped into streams, newest first."""
    from brightloom.lang import logql as ast
    from brightloom.plans.logql import Compiler

    q = ast.parse('{app="events"} | keep event_type')
    found = Compiler(log_store(spark, d), START * NS, END * NS, (END - START) * NS, instant=True).streams(q, None)
    value = F.col("values")
    return found.select(F.col("labels")["event_type"].alias("event_type"), F.size(value).cast("bigint").alias("n"), F.element_at(value, -1)["ts_ns"].alias("first_ns"), F.element_at(value, 1)["ts_ns"].alias("last_ns"))


_PUSHED = "SELECT event_type, epoch_us(ts) * 1000 AS ts_ns, 'an ' || event_type || ': ' || props AS line, CASE WHEN event_type = 'error' THEN 'error' ELSE 'unknown' END AS severity_text, CASE WHEN event_type = 'error' THEN 17 ELSE 9 END AS severity_number, CAST(event_id AS VARCHAR) AS trace_id, 'z' || user_id % 3 AS zone FROM events"


def pushed_rows(rows: DataFrame) -> DataFrame:
    out = ingest.log_rows(rows, 1, F.lit(END * NS))
    return out.select(F.col("labels")["event_type"].alias("event_type"), "ts_ns", "line", "severity_text", "severity_number", F.col("fields")["trace_id"].alias("trace_id"), F.col("resource_attributes")["zone"].alias("zone"))


@query(_PUSHED)
def push_json(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON push bodies of one stream each, read again."""
    e = entries(spark, d)
    value = F.concat(F.lit('["'), F.col("ts_ns").cast("string"), F.lit('",'), F.to_json(F.array("line")).substr(F.lit(2), F.length(F.to_json(F.array("line"))) - 2), F.lit(","), F.to_json("metadata"), F.lit("]"))
    body = F.concat(F.lit('{"streams":[{"stream":'), F.to_json("labels"), F.lit(',"values":['), value, F.lit("]}]}"))
    return pushed_rows(ingest.push_entries(e.select(body.alias("body"))))


def bodies(rows: DataFrame, encode: Callable[[dict], bytes]) -> DataFrame:
    """Each row as a body, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("body", pa.binary()), ("arrival_seq", pa.int64())])
        for part in batches:
            rows = part.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([wire.packed(encode(r)) for r in rows], pa.binary()), pa.array([r["event_id"] for r in rows], pa.int64())], schema=schema)

    return rows.mapInArrow(run, "body binary, arrival_seq bigint")


@query(_PUSHED)
def push_binary(spark: SparkSession, d: str) -> DataFrame:
    """The same as binary bodies."""

    def encode(r: dict) -> bytes:
        labels = "{" + ", ".join(f'{k}="{v}"' for k, v in r["labels"]) + "}"
        entry = wire.put(1, wire.put(1, r["ts_ns"] // 10**9) + wire.put(2, r["ts_ns"] % 10**9)) + wire.put(2, r["line"]) + b"".join(wire.put(3, wire.put(1, k) + wire.put(2, v)) for k, v in r["metadata"])
        return wire.put(1, wire.put(1, labels) + wire.put(2, entry))

    rows = entries(spark, d).withColumn("event_id", F.lit(0).cast("bigint"))
    return pushed_rows(ingest.binary_push_entries(bodies(rows, encode)))


def write_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a write request: a sample, an exemplar and its family."""

    def encode(r: dict) -> bytes:
        series = wire.put_series({L.NAME: NAME, "event_type": r["event_type"], "user_id": str(r["user_id"])}, [(r["ts_ms"], r["value"])])
        series += wire.put(3, wire.put(1, wire.put(1, "trace_id") + wire.put(2, str(r["event_id"]))) + wire.put(2, float(r["value"])) + wire.put(3, r["ts_ms"]))
        return wire.put(1, series) + wire.put(3, wire.put(1, 2) + wire.put(2, r["event_type"]) + wire.put(4, f"user {r['user_id']}"))

    return bodies(events(spark, d).select("event_id", "event_type", "user_id", "ts_ms", "value"), encode)


@query("SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 // 15000 * 15000 AS ts_ms, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2, 3")
def remote_write_samples(spark: SparkSession, d: str) -> DataFrame:
    """Write requests decoded and normalised; samples joined with their new series."""
    t = ingest.write_tables(write_bodies(spark, d), 1)
    joined = t["samples"].join(t["series"].select("id", "labels"), "id")
    return joined.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"), "ts_ms", F.round("v", 6).alias("value"))


@query("SELECT 'exemplar' AS kind, event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type UNION ALL SELECT 'gauge', event_type, count(*), 0.0 FROM events GROUP BY event_type")
def remote_write_others(spark: SparkSession, d: str) -> DataFrame:
    """Exemplars and families of write requests."""
    t = ingest.write_tables(write_bodies(spark, d), 1)
    found = t["exemplars"].join(t["series"].select("id", F.col("labels")["event_type"].alias("name")), "id").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total")).select(F.lit("exemplar").alias("kind"), "name", "n", "total")
    return found.unionByName(t["metadata"].groupBy(F.col("type").alias("kind"), F.col("family").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("total")))


@query(f"SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts) AS nth, epoch_us(ts) // 1000 AS ts_ms, round(value, 6) AS value FROM events WHERE event_type IN ('click', 'view') AND epoch_us(ts) // 1000 BETWEEN {START} AND {START + 10 * DAY}")
def remote_read(spark: SparkSession, d: str) -> DataFrame:
    """Series with their points in time order."""
    found = engine.remote_read(metric_store(spark, d), START, START + 10 * DAY, [(L.NAME, "=", NAME), ("event_type", "=~", "click|view")])
    points = found.select("labels", F.posexplode("samples").alias("i", "p"))
    return points.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"), (F.col("i") + 1).cast("bigint").alias("nth"), F.col("p.ts").alias("ts_ms"), F.round("p.v", 6).alias("value"))


# wide OpenTelemetry tables


def wide_metrics(spark: SparkSession, d: str) -> DataFrame:
    attributes = F.create_map(F.lit("event_type__str"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"), F.lit(""), F.lit("x"))
    e = spark.read.parquet(f"{d}/events.parquet")
    own = e.select(F.lit(1).alias("team_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("svc").alias("service_name"), F.lit(NAME).alias("metric_name"), F.lit("gauge").alias("metric_type"), "value", F.create_map(F.lit("event_type"), F.lit("overruled"), F.lit("zone"), F.concat(F.lit("z"), F.pmod("user_id", F.lit(3)).cast("string"))).alias("resource_attributes"), attributes.alias("attributes_map_str"))
    return own.unionByName(own.withColumns({"team_id": F.lit(2), "value": F.col("value") + 1}))


@query(PLAIN["promql_sum_by"])
def otel_sum_by(spark: SparkSession, d: str) -> DataFrame:
    return ranged(otel.metric_store(wide_metrics(spark, d), 1), 'sum by (event_type) (event_value{service_name="svc"})', _E)


@query("SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id, 'z' || user_id % 3 AS zone, 'svc' AS service_name FROM events WHERE user_id % 3 = 1")
def otel_series(spark: SparkSession, d: str) -> DataFrame:
    found = metadata.series(otel.metric_store(wide_metrics(spark, d), 1), ['event_value{zone="z1"}'])
    return found.select(*[F.col("labels")[n].alias(n) for n in ("event_type", "user_id", "zone", "service_name")])


@query("SELECT unnest(['__name__', 'event_type', 'service_name', 'user_id', 'zone']) AS name")
def otel_label_names(spark: SparkSession, d: str) -> DataFrame:
    return metadata.label_names(otel.metric_store(wide_metrics(spark, d), 1))


@query("SELECT DISTINCT 'z' || user_id % 3 AS value FROM events WHERE event_type = 'click'")
def otel_label_values(spark: SparkSession, d: str) -> DataFrame:
    return metadata.label_values(otel.metric_store(wide_metrics(spark, d), 1), "zone", ['event_value{event_type="click"}'])


@query(f"WITH {_EVENTS}, {_G} SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, g.ts // {NS} AS ts, CAST(count(*) AS DOUBLE) AS value FROM {_IN} WHERE event_type <> 'view' AND zone = 'z2' AND contains(line, '7') GROUP BY 1, g.ts")
def otel_logs(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    table = e.select(F.lit(1).alias("team_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("ts").cast("timestamp").alias("observed_timestamp"), F.lit("").alias("trace_id"), F.lit("").alias("span_id"), F.concat(F.lit("an "), "event_type", F.lit(": "), "props").alias("body"), level.alias("severity_text"), F.lit("svc").alias("service_name"), F.create_map(F.lit("zone"), F.concat(F.lit("z"), F.pmod("user_id", F.lit(3)).cast("string"))).alias("resource_attributes"), F.create_map(F.lit("event_type__str"), F.col("event_type")).alias("attributes_map_str"))
    return log_ranged(otel.log_store(table, 1), 'sum by (level) (count_over_time({service_name="svc",zone="z2"} |= "7" | event_type != "view" [2h]))', ("level",))
