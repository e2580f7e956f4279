import json
import math

import pytest
from pyspark.sql import functions as F

from brightloom import engine, metadata
from brightloom.functions import labels as L
from brightloom.functions import parsers, units
from brightloom.operators import histograms as H
from brightloom.plans import logql as plan
from brightloom.queries import QUERIES
from brightloom.sources import ingest, stores

S = 1_000_000_000


def log_store(spark, rows):
    """rows: (seconds, line, stream labels)"""
    df = spark.createDataFrame([(int(t * S), int(t * S), line, labels, {}, {}) for t, line, labels in rows], "ts_ns long, observed_ns long, line string, stream map<string,string>, resource map<string,string>, fields map<string,string>")
    return stores.LogStore(df)


def metric_store(spark, series):
    """series: {name: [(labels, [(ms, v) or (ms, v, stale)])]}"""
    srows, rows = [], []
    for name, members in series.items():
        for labels, points in members:
            i = len(srows)
            srows.append((1, i, name, labels, 0, 0))
            rows += [(1, i, name, p[0], float(p[1]), len(p) > 2 and p[2], n) for n, p in enumerate(points)]
    return stores.MetricStore(spark.createDataFrame(srows, stores.SERIES), spark.createDataFrame(rows, stores.SAMPLES), tenant=1)


def values(df, *names):
    return sorted((tuple(r["labels"].get(n) for n in names) + (r["ts"], round(r["v"], 9)) for r in df.collect()), key=lambda row: [(x is not None, x) for x in row])


@pytest.mark.parametrize(
    "function, wanted",
    [("sum_over_time", 14), ("avg_over_time", 14 / 3), ("min_over_time", 2), ("max_over_time", 8), ("first_over_time", 2), ("last_over_time", 8), ("stdvar_over_time", 56 / 9), ("stddev_over_time", math.sqrt(56 / 9)), ("quantile_over_time", 4), ("count_over_time", 3), ("rate", 0.05), ("bytes_over_time", 21), ("bytes_rate", 0.35)],
)
def test_log_range_functions(spark, function, wanted):
    store = log_store(spark, [(10, "value=2", {"app": "api"}), (20, "value=4", {"app": "api"}), (30, "value=8", {"app": "api"})])
    unwrap = "" if function in ("count_over_time", "rate", "bytes_over_time", "bytes_rate") else "| logfmt | unwrap value"
    param = "0.5, " if function == "quantile_over_time" else ""
    for by in ("", " by (app)"):
        out = engine.logql_instant(store, f'{function}({param}{{app="api"}} {unwrap} [1m]){by}', 60 * S).collect()
        assert len(out) == (3 if unwrap and not by else 1)  # without by, parsed labels make groups
        if len(out) == 1:
            assert out[0]["v"] == pytest.approx(wanted) and out[0]["labels"] == {"app": "api"}


def test_log_window_is_open_on_the_left(spark):
    store = log_store(spark, [(0, "a", {"app": "x"}), (60, "b", {"app": "x"})])
    assert [r["v"] for r in engine.logql_instant(store, 'count_over_time({app="x"}[1m])', 60 * S).collect()] == [1.0]


def test_log_pipeline_stages(spark):
    store = log_store(
        spark,
        [
            (1, '{"http": {"status": 503}, "path": "/checkout", "tags": [1, 2]}', {"app": "api"}),
            (2, '{"http": {"status": 200}, "path": "/ok"}', {"app": "api"}),
            (3, "not json", {"app": "api"}),
        ],
    )
    one = engine.logql_range(store, '{app="api"} | json | http_status >= 500 | line_format "{{.path}} {{.http_status}}" | keep app, tags', 0, 10 * S).collect()
    assert [(r["line"], r["labels"]) for r in one] == [("/checkout 503", {"app": "api", "tags": "[1,2]"})]
    bad = engine.logql_range(store, '{app="api"} | json | __error__="JSONParserErr"', 0, 10 * S).collect()
    assert [r["line"] for r in bad] == ["not json"] and "__error__" not in bad[0]["labels"]
    path = engine.logql_range(store, '{app="api"} | json s="http.status", t="tags[1]" | t="2"', 0, 10 * S).collect()
    assert path[0]["labels"] == {"app": "api", "s": "503", "t": "2"}


def test_templates_and_formats(spark):
    store = log_store(spark, [(1, "x", {"app": "api", "env": "prod"})])
    q = '{app="api"} | line_format `{{.app | upper}}-{{ .none | default "d" }}-{{ trunc 2 .env }}-{{ .env | replace "o" "0" }}` | label_format copied=app, joined="{{.app}}/{{.env}}" | drop env'
    (r,) = engine.logql_range(store, q, 0, 10 * S).collect()
    assert r["line"] == "API-d-pr-pr0d" and r["labels"] == {"app": "api", "copied": "api", "joined": "api/prod"}


def test_colour_and_pattern(spark):
    store = log_store(spark, [(1, "\x1b[31mGET /a 200\x1b[0m", {"app": "api"})])
    (r,) = engine.logql_range(store, '{app="api"} | decolorize | pattern "<method> <path> <status>" | status="200"', 0, 10 * S).collect()
    assert r["line"] == "GET /a 200" and r["labels"] == {"app": "api", "method": "GET", "path": "/a", "status": "200"}


def test_filters_go_left_to_right(spark):
    store = log_store(spark, [(1, "a=1 b=2 c=3", {"app": "x"})])
    # (a=9 and b=2) or c=3 is true; a=1 or b=9 and c=9 is (a=1 or b=9) and c=9: false
    assert engine.logql_range(store, '{app="x"} | logfmt | a="9" and b="2" or c="3"', 0, 10 * S).count() == 1
    assert engine.logql_range(store, '{app="x"} | logfmt | a="1" or b="9" and c="9"', 0, 10 * S).count() == 0


def test_lean_and_full_pipelines_agree(spark):
    lines = ['level=info took=20ms size=1.5KiB msg="a \\"b\\" c" n=5', "took=1h30m n=x n=7", '{"n": 3, "a": {"b": "c"}}', "", "plain n=2"]
    store = log_store(spark, [(i + 1, x, {"app": "x", "n": "0"}) for i, x in enumerate(lines)])
    for q in ("| logfmt", "| logfmt | n > 1", "| json", "| json | a_b=\"c\"", '| regexp "n=(?P<n>[0-9])"', "| logfmt | label_format n=took", "| logfmt | drop n", '| logfmt | line_format "{{.n}}"'):
        lean = values(engine.logql_instant(store, f'sum by (n) (bytes_over_time({{app="x"}} {q} [1m]))', 60 * S), "n")
        full = values(engine.logql_instant(store, f'sum by (n) (0 + bytes_over_time({{app="x"}} {q} [1m]))', 60 * S), "n")
        assert lean == full, q


def test_log_binary_operators(spark):
    store = log_store(spark, [(1, "ok", {"service": "api", "region": "east"}), (2, "ok", {"service": "api", "region": "east"}), (3, "bad", {"service": "worker", "region": "west"})])
    at = 60 * S
    ratio = 'sum by (service) (count_over_time({service=~".+"}[1m])) / on (service) sum by (service) (count_over_time({service=~".+"} |= "ok" [1m]))'
    assert values(engine.logql_instant(store, ratio, at), "service") == [("api", 60000, 1.0)]
    left = 'sum by (service) (count_over_time({service=~".+"}[1m])) * on (service) group_left (region) sum by (service, region) (count_over_time({service=~".+"}[1m]))'
    assert values(engine.logql_instant(store, left, at), "service", "region") == [("api", "east", 60000, 4.0), ("worker", "west", 60000, 1.0)]
    assert values(engine.logql_instant(store, 'topk(1, sum by (service) (count_over_time({service=~".+"}[1m])))', at), "service") == [("api", 60000, 2.0)]
    assert values(engine.logql_instant(store, '5 > sum(count_over_time({service=~".+"}[1m]))', at)) == [(60000, 5.0)]
    assert values(engine.logql_instant(store, "vector(5) % vector(2) + 2 ^ 3", at)) == [(60000, 9.0)]


def test_selector_lookback_and_staleness(spark):
    store = metric_store(spark, {"up": [({"i": "a"}, [(0, 1), (60_000, 2)]), ({"i": "b"}, [(0, 5), (30_000, math.nan, True)])]})
    assert values(engine.promql_instant(store, "up", 60_000), "i") == [("a", 60_000, 2.0)]
    assert values(engine.promql_instant(store, "up", 300_000), "i") == [("a", 300_000, 2.0)]
    assert values(engine.promql_instant(store, "up", 360_000), "i") == []  # the window is open on the left
    assert values(engine.promql_instant(store, 'up{i="b"} offset 1m', 80_000), "i") == [("b", 80_000, 5.0)]
    assert engine.promql_instant(store, 'up{i="a",i="b"}', 60_000).count() == 0


def brute_rate(points, start, end, per_second, counter=True):
    inside = [(t, v) for t, v in points if start < t <= end]
    if len(inside) < 2:
        return None
    change = inside[-1][1] - inside[0][1]
    if counter:
        change += sum(a for (_, a), (_, b) in zip(inside, inside[1:]) if b < a)
    span = (inside[-1][0] - inside[0][0]) / 1000
    gap = span / (len(inside) - 1)
    a, z = (inside[0][0] - start) / 1000, (end - inside[-1][0]) / 1000
    a, z = (gap / 2 if a >= gap * 1.1 else a), (gap / 2 if z >= gap * 1.1 else z)
    if counter and change > 0 and inside[0][1] >= 0:
        a = min(a, span * inside[0][1] / change)
    out = change * (span + a + z) / span
    return out / ((end - start) / 1000) if per_second else out


@pytest.mark.parametrize("step, window", [(15_000, 60_000), (60_000, 45_000), (7_000, 100_000)])
def test_rates_against_brute_force(spark, step, window):
    import random

    rng = random.Random(step)
    points, t, v = [], 0, 0.0
    for _ in range(60):
        t += rng.choice([1_000, 5_000, 15_000, 40_000])
        v = 0.0 if rng.random() < 0.15 else v + rng.random() * 10
        points.append((t, v))
    store = metric_store(spark, {"c": [({"a": "b"}, points)]})
    for name, per_second, counter in (("rate", True, True), ("increase", False, True), ("delta", False, False)):
        got = {r["ts"]: r["v"] for r in engine.promql_range(store, f"{name}(c[{window}ms])", 0, t, step).collect()}
        want = {x: y for x in range(0, t + 1, step) if (y := brute_rate(points, x - window, x, per_second, counter)) is not None}
        assert got.keys() == want.keys()
        assert all(got[x] == pytest.approx(want[x], rel=1e-9) for x in want), name
    for name, f in (("sum", sum), ("max", max), ("min", min), ("count", len)):  # by steps and by points alike
        got = {r["ts"]: r["v"] for r in engine.promql_range(store, f"{name}_over_time(c[{window}ms])", 0, t, step).collect()}
        want = {x: f(i) for x in range(0, t + 1, step) if (i := [v for s, v in points if x - window < s <= x])}
        assert got == pytest.approx(want)


def test_matching_errors(spark):
    store = metric_store(spark, {"a": [({"x": "1", "y": "1"}, [(0, 1)]), ({"x": "1", "y": "2"}, [(0, 2)])], "b": [({"x": "1", "z": "q"}, [(0, 10)])]})
    assert values(engine.promql_instant(store, "a * on (x) group_left (z) b", 0), "y", "z") == [("1", "q", 0, 10.0), ("2", "q", 0, 20.0)]
    with pytest.raises(Exception, match="many-to-many"):
        engine.promql_instant(store, "a * on (x) b", 0).collect()
    with pytest.raises(Exception, match="same labelset"):
        engine.promql_instant(store, 'label_replace(a, "y", "same", "", "")', 0).collect()


def test_ieee_values(spark):
    store = metric_store(spark, {"z": [({"i": "a"}, [(0, 0)]), ({"i": "b"}, [(0, 1)]), ({"i": "c"}, [(0, math.nan)])]})
    rows = {r["labels"]["i"]: r["v"] for r in engine.promql_instant(store, "z / 0", 0).collect()}
    assert math.isnan(rows["a"]) and rows["b"] == math.inf and math.isnan(rows["c"])
    assert [r["labels"] for r in engine.promql_instant(store, "z == z", 0).select("labels").collect()] != [] and engine.promql_instant(store, "z > 0", 0).count() == 1
    (m,) = engine.promql_instant(store, "max(z)", 0).collect()
    assert m["v"] == 1.0
    assert [r["labels"]["i"] for r in engine.promql_instant(store, "topk(2, z)", 0).orderBy(F.col("v").desc()).collect()] == ["b", "a"]


def test_subquery_running_sum_and_union(spark):
    store = metric_store(spark, {"m": [({"i": "a"}, [(t * 60_000, t) for t in range(10)]), ({"i": "b"}, [(0, 100)])]})
    got = values(engine.promql_range(store, 'sum_over_time(m{i="a"}[3m:1m])', 300_000, 420_000, 60_000), "i")
    assert got == [("a", 300_000, 12.0), ("a", 360_000, 15.0), ("a", 420_000, 18.0)]
    assert values(engine.promql_range(store, 'running_sum(m{i="a"})', 60_000, 180_000, 60_000), "i") == [("a", 60_000, 1.0), ("a", 120_000, 3.0), ("a", 180_000, 6.0)]
    one = values(engine.promql_instant(store, 'm{i="a"} or m{i="b"}', 0), "i")
    assert one == values(engine.promql_instant(store, 'm{i="a"} or on (i) m{i="b"}', 0), "i") == [("a", 0, 0.0), ("b", 0, 100.0)]


def test_normalised_and_wide_stores_agree(spark):
    wide = stores.events_metrics(spark, "/root/testdata/sf0.001")
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.lit(1).cast("bigint").alias("team_id"), L.build([(L.NAME, F.lit("event_value")), ("event_type", F.col("event_type")), ("user_id", F.col("user_id"))]).alias("labels"), F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("ts_ms"), F.col("value").alias("v"), F.lit(False).alias("is_stale"), F.col("event_id").alias("arrival_seq")
    )
    store = stores.MetricStore(ingest.new_series(batch, spark.createDataFrame([], "team_id bigint, id bigint"), 0), ingest.samples(batch, 0), tenant=1)
    for q in ("sum by (event_type) (avg_over_time(event_value[6h]))", 'event_value{user_id="3"}', "rate(event_value[1d])"):
        a, b = (values(engine.promql_range(s, q, 1704067200000, 1704672000000, 3_600_000), "event_type", "user_id") for s in (wide, store))
        assert a == pytest.approx(b) if not a else [x[:-1] for x in a] == [x[:-1] for x in b]


def test_plans_push_time_down_and_join_nothing(spark, capsys):
    df = engine.promql_range(stores.events_metrics(spark, "/root/testdata/sf0.001"), "sum by (event_type) (sum_over_time(event_value[6h]))", 1704067200000, 1704672000000, 3_600_000)
    df.explain("formatted")
    plan_text = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan_text and "Join" not in plan_text and "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan_text


def test_ingest_buckets_and_nan(spark):
    rows = [(1000, 1.0, False), (14999, 2.0, False), (15000, 3.0, False)]
    frame = lambda rows: spark.createDataFrame([(1, {"__name__": "m", "a": "b"}, t, v, s, n) for n, (t, v, s) in enumerate(rows)], "team_id long, labels map<string,string>, ts_ms long, v double, is_stale boolean, arrival_seq long")
    got = ingest.samples(frame(rows)).orderBy("ts_ms").collect()
    assert [(r["ts_ms"], r["v"]) for r in got] == [(0, 2.0), (15000, 3.0)]
    batch = frame([(1000, 1.0, False), (14000, 3.0, False), (16000, 2.0, False), (17000, math.nan, False), (31000, math.nan, True)])
    got = ingest.samples(batch).orderBy("ts_ms").collect()
    assert [(r["ts_ms"], r["is_stale"]) for r in got] == [(0, False), (15000, False), (30000, True)] and [r["v"] for r in got[:2]] == [3.0, 2.0]
    (s,) = ingest.new_series(batch, spark.createDataFrame([], "team_id long, id long")).collect()
    assert (s["min_time_ms"], s["max_time_ms"], s["labels"]) == (0, 30000, {"a": "b"})
    assert ingest.new_series(batch, ingest.new_series(batch, spark.createDataFrame([], "team_id long, id long"))).count() == 0
    with pytest.raises(Exception, match="metric name"):
        ingest.samples(batch.withColumn("labels", F.create_map(F.lit("a"), F.lit("b")))).collect()


def test_push_and_severity(spark):
    body = json.dumps({"streams": [{"stream": {"app": "x"}, "values": [["1700000000000000000", "level=warn hi", {"resource_service.name": "svc", "trace_id": "t"}]]}, {"labels": '{app="y", level="info"}', "entries": [{"ts": "2023-11-14T22:13:20Z", "line": "an error: here"}]}]})
    rows = ingest.log_rows(ingest.push_entries(spark.createDataFrame([(body,)], "body string")), 1, F.lit(5)).orderBy("line").collect()
    assert rows[0]["labels"] == {"app": "y", "level": "info"} and rows[0]["ts_ns"] == 1700000000000000000
    assert rows[1]["labels"] == {"app": "x", "service_name": "svc", "level": "warn"} and rows[1]["fields"] == {"trace_id": "t"} and rows[1]["resource_attributes"] == {"service.name": "svc"}
    lines = spark.createDataFrame([(x,) for x in ('{"level":"ERR"}', "an error: x", "errors", "[fatal] info", "")], "line string").select(ingest.severity(F.col("line")).alias("s"))
    assert [r["s"] for r in lines.collect()] == ["error", "error", "unknown", "fatal", "unknown"]


def test_units(spark):
    df = spark.createDataFrame([("1h30m",), ("250ms",), ("-1.5s",), ("5",), ("x",)], "t string")
    assert [r[0] for r in df.select(units.seconds("t")).collect()] == [5400.0, 0.25, -1.5, None, None]
    df = spark.createDataFrame([("1.5KiB",), ("512B",), ("2MB",), ("7",), ("5d",)], "t string")
    assert [r[0] for r in df.select(units.size("t")).collect()] == [1536.0, 512.0, 2e6, 7.0, None]
    df = spark.createDataFrame([("5",), (" 5 ",), ("5d",), ("-1e3",), ("+Inf",)], "t string")
    assert [r[0] for r in df.select(units.number("t")).collect()] == [5.0, None, None, -1000.0, math.inf]


def test_native_histograms(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("b", 0.0), ("b", -4.0)], "k string, v double")
    h = H.from_values(df, ["k"])
    rows = {r["k"]: r for r in h.select("k", H.count("h").alias("n"), H.total("h").alias("s"), H.quantile("h", 0.5).alias("q"), H.fraction("h", 0.0, 50.0).alias("f"), H.deviation("h").alias("d")).collect()}
    assert rows["a"]["n"] == 100 and rows["a"]["s"] == 5050 and rows["a"]["q"] == pytest.approx(50, rel=0.05) and rows["a"]["f"] == pytest.approx(0.5, abs=0.03) and rows["a"]["d"] == pytest.approx(28.87, rel=0.05)
    assert rows["b"]["n"] == 2 and rows["b"]["s"] == -4


def test_metadata(spark):
    store = metric_store(spark, {"a": [({"x": "1"}, [(0, 1)])], "b": [({"y": "2"}, [(100_000, 1)])]})
    assert [r["name"] for r in metadata.label_names(store).collect()] == ["__name__", "x", "y"]
    assert [r["value"] for r in metadata.label_values(store, "__name__", (), 50_000, 150_000).collect()] == ["b"]
    assert [r["labels"] for r in metadata.series(store, ["a", "b"], limit=1).collect()] == [{"__name__": "a", "x": "1"}]
    assert engine.matrix_json(engine.promql_range(store, "a", 0, 0, 1))["data"]["result"] == [{"metric": {"__name__": "a", "x": "1"}, "values": [[0.0, "1"]]}]
    assert engine.spelt(1e21) == "1000000000000000000000" and engine.spelt(math.nan) == "NaN" and engine.spelt(0.5) == "0.5"


def test_series_limit(spark):
    store = metric_store(spark, {"a": [({"x": str(i)}, [(0, 1)]) for i in range(5)]})
    store.max_series = 3
    with pytest.raises(Exception, match="more than 3 series"):
        engine.promql_instant(store, "a", 0).collect()
    store.max_series = 5
    assert engine.promql_instant(store, "a", 0).count() == 5


def test_logfmt_last_key_wins(spark):
    (r,) = spark.createDataFrame([('a=1 b="x \\"y\\"" a=2 c-d=3 bare',)], "line string").select(parsers.logfmt_labels(F.col("line")).alias("m"), parsers.logfmt_value(F.col("line"), "a").alias("a"), parsers.logfmt_value(F.col("line"), "c_d").alias("c")).collect()
    assert r["m"] == {"a": "2", "b": 'x "y"', "c_d": "3"} and (r["a"], r["c"]) == ("2", "3")
    assert plan.needed([], ["level"]) == list(L.LEVELS)


def test_json_labels_against_plain_python(spark):
    lines = ['{"a":1}', '{"a":1.50,"b":1e3}', '{"a":12345678901234567890}', '{"a":-0}', '{"a":null,"b":true,"c":"x\\u00e9\\n\\"q"}', '{"a":{"b":{"c-d":[1, 2.50]}},"a_b":"x"}', '{"a":1,"a":2}', '{"a.b":1,"a_b":2}', '{"9x":"y"}', "{}", '{"a":1}{', '{"a":1} x', "{'a':1}", '{"a":1,}', '{"a":01}', '{"a":"}"}', "[1]", '"x"', "", "plain", '{"a" : "b:{" }', ' {"a": "2 3"} ', '{"a":{}}', '{"a":tru}', None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: r["p"] for r in parsers.with_json_labels(df, "p").collect()}
    for i, line in enumerate(lines):
        try:
            value = json.loads(line)
        except (TypeError, ValueError):
            value = None
        want = None
        if isinstance(value, dict):
            want = {}
            parsers._flatten("", value, want)
        assert got[i] == want, line


@pytest.mark.parametrize("name", ["logql_select", "logql_regexp_min", "logql_pattern_stddev", "logql_logfmt_duration", "logql_logfmt_bytes", "logql_json_sum", "logql_json_path_filter"])
def test_parsed_values_are_not_copied_through_the_plan(spark, name):
    """Each line is read once: plans stay small and expressions of a parser are few."""
    optimised = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(optimised) < 8000 and sum(optimised.count(x) for x in ("get_json_object(", "regexp_extract(", "regexp_extract_all(", "from_json(")) <= 8


def test_filters_on_time_pass_below_bound_columns(spark, capsys):
    engine.logql_range(stores.events_logs(spark, "/root/testdata/sf0.001", "logfmt"), 'sum by (event_type) (count_over_time({app="events"} | logfmt | took > 10ms [1h]))', 1704067200 * S, 1704672000 * S, 3600 * S).explain("formatted")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in capsys.readouterr().out


def test_write_requests_and_broken_bodies(spark):
    import struct

    from brightloom.sources import wire

    h = {"schema": 1, "sum": 3.5, "count": 4.0, "zero_threshold": 0.001, "zero_count": 1.0, "pos_spans": [{"offset": -2, "length": 2}], "pos_buckets": [1.0, 2.0], "neg_spans": [], "neg_buckets": []}
    integers = wire.put(1, 6) + wire.put(3, 2.0) + wire.put(4, 4) + wire.put(6, 1) + wire.put(11, wire.put(1, 0) + wire.put(2, 3)) + wire.put(12, b"".join(map(wire.put_varint, (4, 1, 4)))) + wire.put(15, 77)
    stale = wire.put(2, wire.put_varint(1 << 3 | 1) + wire.STALE + wire.put(2, 20))
    series = wire.put_series({"__name__": "m", "a": "b"}, [(10, 1.5), (-5, math.inf)], [(30, h)]) + stale + wire.put(4, integers)
    good = wire.packed(wire.put(1, series) + wire.put(3, wire.put(1, 1) + wire.put(2, "m") + wire.put(4, "help") + wire.put(5, "s")) + wire.put(99, "unknown"))
    bodies = [good, b"", b"\xff\xff", wire.packed(b"\x0a\x7f"), good[:-3], None, wire.packed(wire.put(1, 5)), wire.packed(wire.put(1, wire.put(2, wire.put(1, "x"))))]
    rows = wire.written(spark.createDataFrame([(b, i) for i, b in enumerate(bodies)], "body binary, arrival_seq long")).collect()
    own = [r for r in rows if r["arrival_seq"] >> 24 == 0]
    assert [(r["kind"], r["ts_ms"], r["is_stale"]) for r in own] == [("sample", 10, False), ("sample", -5, False), ("histogram", 30, None), ("sample", 20, True), ("histogram", 77, None), ("metadata", None, None)]
    assert own[2]["h"].asDict(recursive=True) == h and own[4]["h"]["pos_buckets"] == [2.0, 1.0, 3.0] and own[4]["h"]["schema"] == 2 and own[5]["type"] == "counter" and own[0]["labels"] == {"__name__": "m", "a": "b"}
    assert sorted(r["arrival_seq"] >> 24 for r in rows if r["error"]) == [1, 2, 3, 4, 6, 7]
    tables = ingest.write_tables(spark.createDataFrame([(good, 0)], "body binary, arrival_seq long"), 1)
    assert {n: t.count() for n, t in tables.items()} == {"series": 1, "samples": 2, "histograms": 2, "exemplars": 0, "metadata": 1, "errors": 0}
    assert sorted((r["ts_ms"], r["is_stale"]) for r in tables["samples"].collect()) == [(-15_000, False), (0, True)]  # the later of two in one interval
    store = stores.MetricStore(tables["series"], tables["samples"], 1, tables["histograms"])
    answer = wire.unpacked(wire.read_response([engine.remote_read(store, -20_000, 20_000, [("__name__", "=", "m")])]))
    (result,) = [x for _, x in wire.fields(answer)]
    (one,) = [x for _, x in wire.fields(result)]
    assert [n for n, _ in wire.fields(one)] == [1, 1, 2, 2, 4]
    request = wire.packed(wire.put(1, wire.put(1, 5) + wire.put(2, 9) + wire.put(3, wire.put(1, 2) + wire.put(2, "a") + wire.put(3, "b.*"))))
    assert wire.read_request(request) == [(5, 9, [("a", "=~", "b.*")])] and struct.unpack("<d", wire.STALE)[0] != 0


def test_histogram_rates_and_sums(spark):
    def h(n, schema=0):
        return {"schema": schema, "sum": float(n), "count": 2.0 * n, "zero_threshold": 0.0, "zero_count": 0.0, "pos_spans": [{"offset": 1, "length": 2}], "pos_buckets": [float(n), float(n)], "neg_spans": [], "neg_buckets": []}

    store = metric_store(spark, {"r": [({"i": "a"}, [(0, 0)]), ({"i": "b"}, [(0, 0)])]})
    rows = [(1, 0, t * 15_000, t, h(10 * t if t < 3 else 10 * (t - 3))) for t in range(5)] + [(1, 1, t * 15_000, t, h(100, 1)) for t in range(5)]
    store.histograms = spark.createDataFrame(rows, stores.HISTOGRAMS)
    # the first series counts 0, 20, 40, begins anew at 0, then 20: 60 in the minute from its first to its last point
    got = dict((r[0], r[2]) for r in values(engine.promql_instant(store, "histogram_count(increase(r[61s]))", 60_000), "i"))
    assert got["a"] == pytest.approx(60 * 61 / 60, rel=0.02) and got["b"] == 0
    assert values(engine.promql_instant(store, "histogram_count(sum(r))", 30_000)) == [(30_000, 240.0)]
    assert values(engine.promql_instant(store, "histogram_sum(avg(r) * 2)", 30_000)) == [(30_000, 120.0)]
    (q,) = values(engine.promql_instant(store, "histogram_quantile(0.5, sum(r))", 30_000))
    assert 1 <= q[1] <= 4 and engine.promql_instant(store, "histogram_count(r + r)", 30_000).count() == 0
    # 100 in (1, 1.41] and 100 in (1.41, 2] at the finer resolution are 200 in (1, 2] at the coarser; the coarser's own lie in (1, 2] and (2, 4]
    assert H.counts_by_index(h(100, 1), 0) == ({1: 200.0}, {})


def test_read_of_histograms_far_apart(spark):
    h = {"schema": 0, "sum": 1.0, "count": 1.0, "zero_threshold": 0.0, "zero_count": 1.0, "pos_spans": [], "pos_buckets": [], "neg_spans": [], "neg_buckets": []}
    times = [0, 30 * 86_400_000, 3 * 86_400_000, 400 * 86_400_000]  # more milliseconds apart than 32 bits hold
    store = metric_store(spark, {"r": [({"i": "a"}, [(0, 0)])]})
    store.histograms = spark.createDataFrame([(1, 0, t, t, h) for t in times], stores.HISTOGRAMS)
    (r,) = engine.remote_read(store, 0, times[-1], [("__name__", "=", "r")]).collect()
    assert [x["ts"] for x in r["histograms"]] == sorted(times)


def test_names_and_values_are_sorted_once(spark):
    store = metric_store(spark, {"a": [({"x": "1"}, [(0, 1)]), ({"x": "2", "y": "3"}, [(0, 1)])]})
    for found in (metadata.label_names(store, ["a", 'a{y="3"}']), metadata.label_values(store, "x", ["a", 'a{y="3"}'])):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Sort [") == 1
    assert [r[0] for r in metadata.label_values(store, "x", ["a", 'a{y="3"}']).collect()] == ["1", "2"]


def test_small_bodies_share_batches(spark, monkeypatch):
    from brightloom.sources import wire

    made, from_arrays = [], wire.pa.RecordBatch.from_arrays

    class Counted:
        @staticmethod
        def from_arrays(arrays, schema):
            made.append(len(arrays[0]))
            return from_arrays(arrays, schema=schema)

    class Frame:  # runs the function of mapInArrow here
        columns = ("body", "arrival_seq")

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    body = lambda i: wire.packed(wire.put(1, wire.put_series({"__name__": "m", "a": str(i)}, [(i, 1.5)])))
    spark.range(1)  # columns need a session
    run = wire._rows(Frame(), wire.write_request, wire.WRITTEN, wire.WRITTEN_DDL)
    monkeypatch.setattr(wire.pa, "RecordBatch", Counted)
    bodies = [body(0), None, b"bad", *map(body, range(1, 10_000))]
    rows = [r for b in run([wire.pa.table({"body": bodies, "arrival_seq": list(range(len(bodies)))})]) for r in b.to_pylist()]
    assert made == [wire.BATCH_ROWS, 10_001 - wire.BATCH_ROWS] and len(rows) == 10_001
    assert [r["arrival_seq"] >> 24 for r in rows] == [i for i, b in enumerate(bodies) if b is not None]
    assert rows[1]["error"] and dict(rows[-1]["labels"]) == {"__name__": "m", "a": "9999"}


@pytest.mark.parametrize("query", ["rate(event_value[1d])", "irate(event_value[1d])", "resets(event_value[1d])", "deriv(event_value[1d])"])
def test_windows_are_not_grouped_after_the_fan_out(spark, query):
    store = stores.events_metrics(spark, "/root/testdata/sf0.001")
    plan = engine.promql_range(store, query, 1704067200000, 1706659200000, 3_600_000)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    fan_out = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert not [line for line in plan[:fan_out] if "Aggregate" in line or "Sort" in line or "Window" in line]


def test_slopes_of_steps(spark):
    """Points of one time alone have no slope, however many; steps are put together as one window."""
    same = [(7_000, v) for v in (1, 2, 5)]
    store = metric_store(spark, {"m": [({"a": "same"}, same), ({"a": "line"}, [(t, 3 * t / 1000 + 1) for t in (1_000, 4_000, 12_000, 13_000, 25_000)])]})
    found = values(engine.promql_range(store, "deriv(m[30s])", 0, 40_000, 10_000), "a")
    assert {r[0] for r in found} == {"line"} and {r[-1] for r in found} == {3.0}
    ahead = values(engine.promql_range(store, "predict_linear(m[30s], 5)", 0, 40_000, 10_000), "a")
    assert [(t, v) for _, t, v in ahead] == [(t, 3 * (t / 1000 + 5) + 1) for t in (10_000, 20_000, 30_000, 40_000)]
