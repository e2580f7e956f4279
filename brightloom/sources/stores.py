"""Where series, samples and log rows come from.

A store hands out points (key columns, t, v, is_stale) for a time range and
label matchers, and can attach the label set to any frame that still has the
key columns. Normalised tables key points by series id and attach labels by a
join with the few selected series; wide tables, which hold labels as columns,
key points by these columns and need no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from brightloom.functions import labels as L
from brightloom.functions.bind import bound

Matchers = Sequence[tuple[str, str, str]]

SERIES = "team_id bigint, id bigint, metric_name string, labels map<string,string>, min_time_ms bigint, max_time_ms bigint"
SAMPLES = "team_id bigint, id bigint, metric_name string, ts_ms bigint, v double, is_stale boolean, arrival_seq bigint"
HISTOGRAMS = "team_id bigint, id bigint, ts_ms bigint, version bigint, h struct<schema:int,sum:double,count:double,zero_threshold:double,zero_count:double,pos_spans:array<struct<offset:int,length:int>>,pos_buckets:array<double>,neg_spans:array<struct<offset:int,length:int>>,neg_buckets:array<double>>"
EXEMPLARS = "team_id bigint, id bigint, ts_ms bigint, v double, labels map<string,string>"
METADATA = "team_id bigint, family string, type string, unit string, help string, updated_at_ms bigint"
LOG_STREAMS = "team_id bigint, stream_id bigint, labels map<string,string>, resource_attributes map<string,string>, updated_at_ms bigint"
LOGS = "team_id bigint, ts_ns bigint, observed_ns bigint, stream_id bigint, line string, fields map<string,string>, expires_at_ms bigint"
LOG_STATS = "team_id bigint, stream_id bigint, bucket_ms bigint, log_count bigint, byte_count bigint"


def moment(df: DataFrame, column: str, micros: int) -> Column:
    """A literal of the column's own timestamp type, so that comparisons reach the scan; sessions run in UTC."""
    stamp = datetime.fromtimestamp(micros // 1_000_000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + f".{micros % 1_000_000:06d}"
    ntz = isinstance(df.schema[column].dataType, TimestampNTZType)
    return F.expr(f"TIMESTAMP_NTZ '{stamp}'" if ntz else f"TIMESTAMP '{stamp}Z'")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


@dataclass
class Points:
    df: DataFrame
    keys: list[str]
    attach: Callable[[DataFrame], DataFrame]


def predicate(matchers: Matchers, column: Callable[[str], Column]) -> Column | None:
    """All matchers as one predicate; None if they hold for everything."""
    if L.contradictory(matchers):
        return F.lit(False)
    out = None
    for name, op, literal in matchers:
        p = L.matches(column(name), op, literal)
        if p is not None:
            out = p if out is None else out & p
    return out


def narrowed(df: DataFrame, p: Column | None) -> DataFrame:
    return df if p is None else df.where(p)


class MetricStore:
    """Normalised tables with the schemas above, of one tenant."""

    def __init__(self, series: DataFrame, samples: DataFrame, tenant: int | None = None, histograms: DataFrame | None = None, exemplars: DataFrame | None = None, metadata: DataFrame | None = None, max_series: int = 1_000_000) -> None:
        own = lambda df: df if df is None or tenant is None else df.where(F.col("team_id") == tenant)
        self.series_table, self.samples, self.histograms, self.exemplars, self.metadata = map(own, (series, samples, histograms, exemplars, metadata))
        self.max_series = max_series
        self.spark: SparkSession = series.sparkSession

    def series(self, matchers: Matchers, start: int | None = None, end: int | None = None) -> DataFrame:
        """(id, labels with the name) of the series that match and have samples in the time range, if one is given."""
        full = L.merge(F.col("labels"), F.create_map(F.lit(L.NAME), F.col("metric_name")))
        p = predicate(matchers, lambda n: F.col("metric_name") if n == L.NAME else L.value(F.col("labels"), n))
        found = narrowed(self.series_table, p).select("id", full.alias("labels")).dropDuplicates(["id"])
        if start is not None:
            ids = self.samples.where(F.col("ts_ms").between(start, end)).select("id")
            if self.histograms is not None:
                ids = ids.unionByName(self.histograms.where(F.col("ts_ms").between(start, end)).select("id"))
            found = found.join(ids.distinct(), "id", "left_semi")
        return found

    def limited(self, found: DataFrame) -> DataFrame:
        """The selected series; the query fails where there are more than max_series, having read no more than one too many."""
        n = F.count(F.lit(1))
        checked = found.limit(self.max_series + 1).agg(F.when(n > self.max_series, F.raise_error(F.lit(f"more than {self.max_series} series selected")).cast("bigint")).otherwise(n).alias("n"))
        return found.where(checked.scalar() >= 0)

    def points(self, matchers: Matchers, start: int, end: int) -> Points:
        """Samples with start <= t <= end."""
        found = self.limited(self.series(matchers))
        samples = self.samples.where(F.col("ts_ms").between(start, end))
        names = [v for n, op, v in matchers if n == L.NAME and op == "="]
        for v in names:
            samples = samples.where(F.col("metric_name") == v)
        if len(names) < len(matchers):
            samples = samples.join(found.select("id"), "id", "left_semi")
        df = samples.select("id", F.col("ts_ms").alias("t"), "v", F.coalesce("is_stale", F.lit(False)).alias("is_stale"))
        return Points(df, ["id"], lambda x: x.join(found, "id").drop("id"))

    def native(self, matchers: Matchers, start: int, end: int) -> Points | None:
        """Native histograms with start <= t <= end, in place of the values; None without such a table."""
        if self.histograms is None:
            return None
        found = self.limited(self.series(matchers))
        latest = self.histograms.where(F.col("ts_ms").between(start, end)).groupBy("id", "ts_ms").agg(F.max_by("h", "version").alias("v"))
        df = latest.join(found.select("id"), "id", "left_semi").select("id", F.col("ts_ms").alias("t"), "v", F.lit(False).alias("is_stale"))
        return Points(df, ["id"], lambda x: x.join(found, "id").drop("id"))


class WideStore:
    """A table whose rows are samples, with labels as columns.

    time: the table's timestamp column; t: its milliseconds, an expression over it.
    """

    def __init__(self, table: DataFrame, name: str, labels: dict[str, str], time: str, value: str) -> None:
        self.table, self.name, self.labels, self.time, self.value = table, name, labels, time, value
        self.spark = table.sparkSession
        self.histograms = self.exemplars = self.metadata = None

    def rows(self, matchers: Matchers, start: int | None, end: int | None) -> DataFrame:
        column = lambda n: F.lit(self.name) if n == L.NAME else F.coalesce(F.col(self.labels[n]).cast("string"), F.lit("")) if n in self.labels else F.lit("")
        df = narrowed(self.table, predicate(matchers, column))
        if start is not None:  # on the stored column, so that row groups are skipped
            df = df.where((F.col(self.time) >= moment(df, self.time, start * 1000)) & (F.col(self.time) < moment(df, self.time, (end + 1) * 1000)))
        return df

    def label_map(self) -> Column:
        return L.build([(L.NAME, F.lit(self.name)), *[(n, F.col(f"`{n}`")) for n in self.labels]])

    def series(self, matchers: Matchers, start: int | None = None, end: int | None = None) -> DataFrame:
        df = self.rows(matchers, start, end).select(*[F.col(c).cast("string").alias(n) for n, c in self.labels.items()]).distinct()
        return df.select(F.xxhash64(*[f"`{n}`" for n in self.labels]).alias("id"), self.label_map().alias("labels"))

    def points(self, matchers: Matchers, start: int, end: int) -> Points:
        t = F.expr(f"unix_millis(CAST(`{self.time}` AS TIMESTAMP))")
        df = self.rows(matchers, start, end).select(*[F.col(c).cast("string").alias(n) for n, c in self.labels.items()], t.alias("t"), F.col(self.value).cast("double").alias("v"), F.lit(False).alias("is_stale"))
        keys = list(self.labels)
        return Points(df, keys, lambda x: x.withColumn("labels", self.label_map()).drop(*keys))

    def native(self, matchers: Matchers, start: int, end: int) -> Points | None:
        return None


class LogStore:
    """Log rows (ts_ns, observed_ns, line, stream, resource, fields) of one tenant.

    time: a stored timestamp column of `rows`, where there is one, for skipping.
    stats: counts and bytes of each stream and minute (bucket_ms, log_count,
    byte_count, stream, resource), from which queries over whole minutes that look at
    streams alone are answered; a row then counts at the end of its minute.
    """

    def __init__(self, rows: DataFrame, stats: DataFrame | None = None, time: str | None = None) -> None:
        self.rows, self.stats, self.time = rows, stats, time
        self.spark = rows.sparkSession

    @classmethod
    def tables(cls, logs: DataFrame, streams: DataFrame, tenant: int | None = None, stats: DataFrame | None = None) -> "LogStore":
        own = lambda df: df if df is None or tenant is None else df.where(F.col("team_id") == tenant)
        latest = own(streams).groupBy("team_id", "stream_id").agg(F.max_by(F.struct("labels", "resource_attributes"), "updated_at_ms").alias("s"))
        rows = own(logs).join(latest, ["team_id", "stream_id"])
        minutes = None if stats is None else own(stats).join(latest, ["team_id", "stream_id"]).select("bucket_ms", "log_count", "byte_count", F.col("s.labels").alias("stream"), F.col("s.resource_attributes").alias("resource"))
        return cls(rows.select("ts_ns", "observed_ns", "line", F.col("s.labels").alias("stream"), F.col("s.resource_attributes").alias("resource"), "fields", "stream_id"), minutes)

    def select(self, matchers: Matchers, start_ns: int, end_ns: int) -> DataFrame:
        """Rows with start_ns < ts_ns <= end_ns whose stream labels match."""
        df = self.rows
        if self.time:
            df = df.where((F.col(self.time) >= moment(df, self.time, start_ns // 1000)) & (F.col(self.time) <= moment(df, self.time, -(-end_ns // 1000))))
        df = df.where((F.col("ts_ns") > start_ns) & (F.col("ts_ns") <= end_ns))
        return narrowed(df, self.stream_predicate(matchers))

    def select_minutes(self, matchers: Matchers, start_ns: int, end_ns: int) -> DataFrame:
        """Minutes that end in start_ns < t <= end_ns of the streams that match."""
        end = (F.col("bucket_ms") + 60_000) * 1_000_000
        return narrowed(self.stats.where((end > start_ns) & (end <= end_ns)), self.stream_predicate(matchers)).withColumn("t", end)

    @staticmethod
    def stream_predicate(matchers: Matchers) -> Column | None:
        both = lambda n: F.coalesce(F.nullif(L.aliased(F.col("stream"), n), F.lit("")), F.nullif(F.col("resource")[n], F.lit("")), F.lit(""))
        return predicate(matchers, both)


def events_metrics(spark: SparkSession, sf_dir: str) -> WideStore:
    """events as the gauge event_value{event_type, user_id}."""
    return WideStore(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_value", {"event_type": "event_type", "user_id": "user_id"}, "ts", "value")


def lineitem_metrics(spark: SparkSession, sf_dir: str) -> WideStore:
    """lineitem as the gauge line_quantity{returnflag, linestatus}."""
    return WideStore(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "line_quantity", {"returnflag": "l_returnflag", "linestatus": "l_linestatus"}, "l_shipdate", "l_quantity")


def events_logs(spark: SparkSession, sf_dir: str, line: str = "json") -> LogStore:
    """events as log rows of the streams {app="events", event_type=...}.

    line: json (the column props), logfmt, text, or colour (text with escape sequences).
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, at = F.col("k"), F.col("ns")
    body = {
        "json": F.col("props"),
        "logfmt": F.concat(F.lit("type="), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" took="), k, F.lit("ms size="), k, F.lit("KiB")),
        "colour": F.concat(F.lit("\x1b[31m"), "event_type", F.lit("\x1b[0m k="), k),
        "text": F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type", F.lit(" k="), k),
    }[line]
    e = e.withColumn("ns", micros("ts") * 1000)
    if line != "json":
        e = bound(bound(e, {"k": F.get_json_object("props", "$.k")}), {"body": body})
        body = F.col("body")
    rows = e.select("ts", at.alias("ts_ns"), at.alias("observed_ns"), body.alias("line"), F.create_map(F.lit("app"), F.lit("events"), F.lit("event_type"), F.col("event_type")).alias("stream"), L.empty().alias("resource"), L.empty().alias("fields"))
    return LogStore(rows, time="ts")
