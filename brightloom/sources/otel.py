"""Wide OpenTelemetry tables, one row for each data point or log record, as stores.

Attribute keys may carry the type suffix __str, which is no part of the name. Of
names that meet, the later of resource attributes, service_name, attributes and
the metric's name wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import labels as L
from brightloom.functions.bind import bound
from brightloom.sources.stores import LogStore, MetricStore, micros

METRICS = "team_id int, timestamp timestamp, service_name string, metric_name string, metric_type string, value double, resource_attributes map<string,string>, attributes_map_str map<string,string>"
LOGS = "team_id int, timestamp timestamp, observed_timestamp timestamp, trace_id string, span_id string, body string, severity_text string, service_name string, resource_attributes map<string,string>, attributes_map_str map<string,string>"


def named(attributes: Column) -> Column:
    """Attributes without the type suffix, empty names and the metric's name; of names that become alike the last."""
    entries = F.transform(F.map_entries(F.coalesce(attributes, L.empty())), lambda e: F.struct(F.regexp_replace(e["key"], "__str$", "").alias("key"), e["value"].alias("value")))
    kept = F.reverse(F.filter(entries, lambda e: (e["key"] != "") & (e["key"] != L.NAME)))
    return F.map_from_entries(F.filter(kept, lambda e, i: F.array_position(F.transform(kept, lambda x: x["key"]), e["key"]) == i + 1))


def metric_rows(table: DataFrame) -> DataFrame:
    """(team_id, labels, ts_ms, v): each data point with its full label set."""
    resource = F.map_filter(F.coalesce("resource_attributes", L.empty()), lambda k, _: k != "")
    rows = bound(table, {"own": named(F.col("attributes_map_str")), "base": L.put(L.without(resource, [L.NAME]), "service_name", F.coalesce(F.nullif("service_name", F.lit("")), resource["service_name"]))})
    labels = L.put(L.merge(F.col("base"), F.col("own")), L.NAME, F.col("metric_name"))
    return bound(rows, {"full": labels}).select(F.col("team_id").cast("bigint").alias("team_id"), F.col("full").alias("labels"), F.unix_millis(F.col("timestamp").cast("timestamp")).alias("ts_ms"), F.col("value").alias("v"))


def metric_store(table: DataFrame, tenant: int) -> MetricStore:
    """A store of the tenant's data points; of one series and time the last by value stays."""
    rows = bound(metric_rows(table.where(F.col("team_id") == tenant)), {"key": L.key(F.col("labels"))})
    rows = rows.select("team_id", "key", F.xxhash64("key").alias("id"), F.col("labels")[L.NAME].alias("metric_name"), "ts_ms", "v")
    full = L.from_key(F.col("key"))
    series = rows.groupBy("team_id", "id", "key", "metric_name").agg(F.min("ts_ms").alias("min_time_ms"), F.max("ts_ms").alias("max_time_ms"))
    series = series.select("team_id", "id", "metric_name", L.without(full, [L.NAME]).alias("labels"), "min_time_ms", "max_time_ms")
    samples = rows.groupBy("team_id", "id", "metric_name", "ts_ms").agg(F.max("v").alias("v"))
    return MetricStore(series, samples.withColumns({"is_stale": F.lit(False), "arrival_seq": F.lit(0).cast("bigint")}), tenant)


def log_store(table: DataFrame, tenant: int) -> LogStore:
    """A store of the tenant's records: service, level and trace ids are stream labels, attributes are fields."""
    stream = L.build([("service_name", F.col("service_name")), ("level", F.col("severity_text")), ("trace_id", F.col("trace_id")), ("span_id", F.col("span_id"))])
    own = table.where(F.col("team_id") == tenant)
    rows = own.select("timestamp", (micros("timestamp") * 1000).alias("ts_ns"), (micros("observed_timestamp") * 1000).alias("observed_ns"), F.col("body").alias("line"), stream.alias("stream"), F.coalesce("resource_attributes", L.empty()).alias("resource"), named(F.col("attributes_map_str")).alias("fields"))
    return LogStore(rows, time="timestamp")
