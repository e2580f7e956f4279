"""A registered query for each operator, over whole tables, with its SQL twin.

Results are flat: labels as columns, ts in milliseconds, values rounded to six
decimals. The SQL takes another way than the plans: times are joined to samples
by range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom import engine, metadata
from brightloom.functions import labels as L
from brightloom.operators import histograms
from brightloom.sources import ingest, stores

START, END, HOUR, DAY = 1704067200000, 1706659200000, 3_600_000, 86_400_000
SHIP_START, SHIP_END = 788918400000, 1009843200000
NS = 1_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SAMPLES = "s AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS t, value AS v FROM events)"
_LINES = "s AS (SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, epoch_ms(l_shipdate) AS t, l_quantity AS v FROM lineitem)"
_LOGS = "s AS (SELECT event_type, epoch_us(ts) * 1000 AS t, props AS line, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, user_id FROM events)"


def _grid(start: int, end: int, step: int) -> str:
    return f"g AS (SELECT unnest(generate_series({start}, {end}, {step})) AS ts)"


def flat(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col("labels")[n].alias(n) for n in names], "ts", F.round("v", 6).alias("value"))


def _prom(key: str, query: str, names: Sequence[str], sql: str | None, step: int = HOUR, lookback: int = HOUR, store: Callable = stores.events_metrics, start: int = START, end: int = END) -> None:
    QUERIES[key] = lambda spark, d: flat(engine.promql_range(store(spark, d), query, start, end, step, lookback), names)
    if sql:
        ORACLES[key] = sql


def _log(key: str, query: str, names: Sequence[str], sql: str | None, step: int = HOUR, line: str = "json") -> None:
    QUERIES[key] = lambda spark, d: flat(engine.logql_range(stores.events_logs(spark, d, line), query, START * NS, END * NS, step * NS), names)
    if sql:
        ORACLES[key] = sql


def _over(select: str, group: str, window: int, tail: str = "", step: int = HOUR, base: str = _SAMPLES, start: int = START, end: int = END, scale: int = 1, where: str = "TRUE") -> str:
    """SQL: an aggregate of the rows in (ts - window, ts] for each time."""
    keys = f"{group}, " if group else ""
    return f"WITH {base}, {_grid(start * scale, end * scale, step * scale)}, r AS (SELECT {keys}g.ts, {select} AS value FROM g JOIN s ON s.t > g.ts - {window * scale} AND s.t <= g.ts WHERE {where} GROUP BY {keys}g.ts) {tail or f'SELECT {keys}ts // {scale} AS ts, round(value, 6) AS value FROM r'}"


def _latest(tail: str, window: int = HOUR, step: int = HOUR) -> str:
    """SQL: the newest sample of each series in (ts - window, ts]; `l` has it."""
    return f"WITH {_SAMPLES}, {_grid(START, END, step)}, l AS (SELECT event_type, user_id, g.ts, arg_max(v, t) AS v, max(t) AS t FROM g JOIN s ON s.t > g.ts - {window} AND s.t <= g.ts GROUP BY event_type, user_id, g.ts) {tail}"


def _pairs(tail: str, window: int, fell: str = "CASE WHEN v < pv THEN pv ELSE 0 END") -> str:
    """SQL: first, last and resets of the samples of each series and window; `f` has them."""
    return f"""WITH {_SAMPLES}, o AS (SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM s WINDOW w AS (PARTITION BY event_type, user_id ORDER BY t)), {_grid(START, END, HOUR)},
    f AS (SELECT event_type, user_id, g.ts, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(v, t) AS v0, arg_max(v, t) AS v1, arg_max(pv, t) AS pv, arg_max(pt, t) AS pt,
          sum({fell}) FILTER (WHERE pt > g.ts - {window}) AS fell, sum(CASE WHEN v <> pv THEN 1 ELSE 0 END) FILTER (WHERE pt > g.ts - {window}) AS moved, sum(CASE WHEN v < pv THEN 1 ELSE 0 END) FILTER (WHERE pt > g.ts - {window}) AS resets,
          regr_slope(v, (t - g.ts) / 1000.0) AS slope, regr_intercept(v, (t - g.ts) / 1000.0) AS level
          FROM g JOIN o ON o.t > g.ts - {window} AND o.t <= g.ts GROUP BY event_type, user_id, g.ts) {tail}"""


def _extrapolated(window: int, counter: bool, rate: bool) -> str:
    change = "v1 - v0 + coalesce(fell, 0)" if counter else "v1 - v0"
    zero = "CASE WHEN change > 0 AND v0 >= 0 AND span * (v0 / change) < a THEN span * (v0 / change) ELSE a END" if counter else "a"
    return _pairs(
        f""", c AS (SELECT *, {change} AS change, (t1 - t0) / 1000.0 AS span, (t1 - t0) / 1000.0 / (n - 1) AS gap, (t0 - (ts - {window})) / 1000.0 AS a0, (ts - t1) / 1000.0 AS z0 FROM f WHERE n >= 2 AND t1 > t0),
        e AS (SELECT *, CASE WHEN a0 >= gap * 1.1 THEN gap / 2 ELSE a0 END AS a, CASE WHEN z0 >= gap * 1.1 THEN gap / 2 ELSE z0 END AS z FROM c)
        SELECT event_type, user_id, ts, round(change * ((span + {zero} + z) / span) / {window / 1000 if rate else 1} * {3600 if rate else 1}, 6) AS value FROM e""",
        window,
    )


BOTH = ("event_type", "user_id")
W6 = 6 * HOUR

# PromQL: selectors and aggregation
_prom("promql_selector_latest", "event_value", BOTH, _latest("SELECT event_type, user_id, ts, round(v, 6) AS value FROM l"))
_prom("promql_sum_by", "sum by (event_type) (event_value)", BOTH[:1], _latest("SELECT event_type, ts, round(sum(v), 6) AS value FROM l GROUP BY ALL"))
_prom("promql_avg_without", "avg without (user_id) (event_value)", BOTH[:1], _latest("SELECT event_type, ts, round(avg(v), 6) AS value FROM l GROUP BY ALL"))
_prom("promql_min_max_spread", "max(event_value) - min(event_value)", (), _latest("SELECT ts, round(max(v) - min(v), 6) AS value FROM l GROUP BY ts"))
_prom("promql_stddev_stdvar", "stddev by (event_type) (event_value) + stdvar by (event_type) (event_value)", BOTH[:1], _latest("SELECT event_type, ts, round(stddev_pop(v) + var_pop(v), 6) AS value FROM l GROUP BY ALL"))
_prom("promql_quantile", "quantile by (event_type) (0.9, event_value)", BOTH[:1], _latest("SELECT event_type, ts, round(quantile_cont(v, 0.9), 6) AS value FROM l GROUP BY ALL"))
_prom("promql_group_count", "count by (event_type) (event_value) * group by (event_type) (event_value)", BOTH[:1], _latest("SELECT event_type, ts, CAST(count(*) AS DOUBLE) AS value FROM l GROUP BY ALL"))
_prom("promql_nested_count", "count(count by (event_type) (event_value))", (), _latest("SELECT ts, CAST(count(DISTINCT event_type) AS DOUBLE) AS value FROM l GROUP BY ts"))
_prom("promql_count_values", 'count_values("rounded", round(event_value, 10))', ("rounded",), _latest("SELECT CAST(CAST(floor(v / 10 + 0.5) * 10 AS BIGINT) AS VARCHAR) AS rounded, ts, CAST(count(*) AS DOUBLE) AS value FROM l GROUP BY ALL"))
_prom("promql_topk", "topk by (event_type) (2, event_value)", BOTH, _latest("SELECT event_type, user_id, ts, round(v, 6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY ts, event_type ORDER BY v DESC, 'event_type' || chr(1) || event_type || chr(2) || 'user_id' || chr(1) || user_id) <= 2"))
_prom("promql_bottomk", "bottomk(3, event_value)", BOTH, _latest("SELECT event_type, user_id, ts, round(v, 6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY ts ORDER BY v, event_type, user_id) <= 3"))
_prom("promql_matchers", 'sum by (event_type) (event_value{event_type=~"cl.*|view",user_id!~"1.*",event_type!="error"})', BOTH[:1], _latest("SELECT event_type, ts, round(sum(v), 6) AS value FROM l WHERE regexp_full_match(event_type, 'cl.*|view') AND NOT regexp_full_match(user_id, '1.*') GROUP BY ALL"))
_prom("promql_union", 'sum by (event_type) (event_value{event_type="click"} or event_value{event_type="view"} or event_value{event_type="error"})', BOTH[:1], _latest("SELECT event_type, ts, round(sum(v), 6) AS value FROM l WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL"))
_prom("promql_offset", "sum(event_value offset 3h)", (), f"WITH {_SAMPLES}, {_grid(START, END, HOUR)}, l AS (SELECT event_type, user_id, g.ts, arg_max(v, t) AS v FROM g JOIN s ON s.t > g.ts - {4 * HOUR} AND s.t <= g.ts - {3 * HOUR} GROUP BY ALL) SELECT ts, round(sum(v), 6) AS value FROM l GROUP BY ts")
_prom("promql_at", f"sum by (event_type) (sum_over_time(event_value[30d] @ {END // 1000}))", BOTH[:1], f"WITH {_SAMPLES}, {_grid(START, END, HOUR)}, r AS (SELECT event_type, sum(v) AS value FROM s WHERE t > {END - 30 * DAY} AND t <= {END} GROUP BY event_type) SELECT event_type, ts, round(value, 6) AS value FROM r, g")

# PromQL: range functions
_prom("promql_sum_over_time", "sum_over_time(event_value[6h])", BOTH, _over("sum(v)", "event_type, user_id", W6))
_prom("promql_avg_over_time", "avg_over_time(event_value[6h])", BOTH, _over("avg(v)", "event_type, user_id", W6))
_prom("promql_min_max_over_time", "max_over_time(event_value[6h]) - min_over_time(event_value[6h])", BOTH, _over("max(v) - min(v)", "event_type, user_id", W6))
_prom("promql_count_over_time", "count_over_time(event_value[6h]) + present_over_time(event_value[6h])", BOTH, _over("count(*) + 1.0", "event_type, user_id", W6))
_prom("promql_last_over_time", "last_over_time(event_value[6h])", BOTH, _over("arg_max(v, t)", "event_type, user_id", W6))
_prom("promql_stddev_over_time", "stddev_over_time(event_value[6h]) + stdvar_over_time(event_value[6h])", BOTH, _over("stddev_pop(v) + var_pop(v)", "event_type, user_id", W6))
_prom("promql_quantile_over_time", "quantile_over_time(0.75, event_value[6h])", BOTH, _over("quantile_cont(v, 0.75)", "event_type, user_id", W6))
_prom("promql_rate", "rate(event_value[1d]) * 3600", BOTH, _extrapolated(DAY, True, True))  # an hour's, as six decimals of a second's say little
_prom("promql_increase", "increase(event_value[1d])", BOTH, _extrapolated(DAY, True, False))
_prom("promql_delta", "delta(event_value[1d])", BOTH, _extrapolated(DAY, False, False))
_prom("promql_irate", "irate(event_value[1d])", BOTH, _pairs(f"SELECT event_type, user_id, ts, round(CASE WHEN v1 < pv THEN v1 ELSE v1 - pv END / ((t1 - pt) / 1000.0), 6) AS value FROM f WHERE pt > ts - {DAY}", DAY))
_prom("promql_idelta", "idelta(event_value[1d])", BOTH, _pairs(f"SELECT event_type, user_id, ts, round(v1 - pv, 6) AS value FROM f WHERE pt > ts - {DAY}", DAY))
_prom("promql_changes_resets", "changes(event_value[1d]) + resets(event_value[1d])", BOTH, _pairs("SELECT event_type, user_id, ts, CAST(coalesce(moved, 0) + coalesce(resets, 0) AS DOUBLE) AS value FROM f", DAY))
_prom("promql_deriv", "deriv(event_value[1d])", BOTH, _pairs("SELECT event_type, user_id, ts, round(slope, 6) AS value FROM f WHERE n >= 2 AND slope IS NOT NULL", DAY))
_prom("promql_predict_linear", "round(predict_linear(event_value[1d], 3600), 0.01)", BOTH, _pairs("SELECT event_type, user_id, ts, round(floor((level + slope * 3600) / 0.01 + 0.5) * 0.01, 6) AS value FROM f WHERE n >= 2 AND slope IS NOT NULL", DAY))
_prom("promql_subquery", "max_over_time(sum by (event_type) (event_value)[6h:1h])", BOTH[:1], _latest(f", q AS (SELECT event_type, ts AS t, sum(v) AS v FROM l GROUP BY ALL) SELECT event_type, g.ts, round(max(q.v), 6) AS value FROM g JOIN q ON q.t > g.ts - {W6} AND q.t <= g.ts GROUP BY ALL").replace(_grid(START, END, HOUR), f"g0 AS (SELECT unnest(generate_series({START - W6}, {END}, {HOUR})) AS ts), g AS (SELECT ts FROM g0 WHERE ts >= {START})").replace("g.ts, arg_max(v, t) AS v, max(t) AS t FROM g JOIN", "g0.ts, arg_max(v, t) AS v, max(t) AS t FROM g0 JOIN").replace(f"s.t > g.ts - {HOUR} AND s.t <= g.ts GROUP BY event_type, user_id, g.ts", f"s.t > g0.ts - {HOUR} AND s.t <= g0.ts GROUP BY event_type, user_id, g0.ts"))
_prom("promql_running_sum", "running_sum(sum by (event_type) (event_value))", BOTH[:1], _latest(", q AS (SELECT event_type, ts, sum(v) AS v FROM l GROUP BY ALL) SELECT event_type, ts, round(sum(v) OVER (PARTITION BY event_type ORDER BY ts), 6) AS value FROM q"))
_prom("promql_absent", 'absent(event_value{event_type="signup"})', BOTH[:1], _latest("SELECT 'signup' AS event_type, g.ts, 1.0 AS value FROM g WHERE g.ts NOT IN (SELECT ts FROM l WHERE event_type = 'signup')"))
_prom("promql_absent_over_time", 'absent_over_time(event_value{user_id="7"}[2h])', BOTH[1:], f"WITH {_SAMPLES}, {_grid(START, END, HOUR)} SELECT '7' AS user_id, g.ts, 1.0 AS value FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = '7' AND s.t > g.ts - {2 * HOUR} AND s.t <= g.ts)")
_prom("promql_line_sum_over_time", "sum_over_time(line_quantity[7d])", ("returnflag", "linestatus"), _over("sum(v)", "returnflag, linestatus", 7 * DAY, step=DAY, base=_LINES, start=SHIP_START, end=SHIP_END), step=DAY, store=stores.lineitem_metrics, start=SHIP_START, end=SHIP_END)

# PromQL: operators and functions
_TOTAL = ", a AS (SELECT event_type, ts, sum(v) AS v FROM l GROUP BY ALL)"
_prom("promql_arithmetic", "(sum by (event_type) (event_value) * 2 + 1) / 4 - 3 % 2", BOTH[:1], _latest("SELECT event_type, ts, round((sum(v) * 2 + 1) / 4 - 1, 6) AS value FROM l GROUP BY ALL"))
_prom("promql_compare_filter", "event_value > 50 < 90", BOTH, _latest("SELECT event_type, user_id, ts, round(v, 6) AS value FROM l WHERE v > 50 AND v < 90"))
_prom("promql_compare_bool", "event_value >= bool 50", BOTH, _latest("SELECT event_type, user_id, ts, CAST(v >= 50 AS INT) * 1.0 AS value FROM l"))
_prom("promql_match_on", "sum by (event_type) (event_value) / on (event_type) count by (event_type) (event_value)", BOTH[:1], _latest("SELECT event_type, ts, round(avg(v), 6) AS value FROM l GROUP BY ALL"))
_prom("promql_group_left", "event_value / on (event_type) group_left () sum by (event_type) (event_value)", BOTH, _latest(_TOTAL + " SELECT l.event_type, l.user_id, l.ts, round(l.v / a.v, 6) AS value FROM l JOIN a USING (event_type, ts) WHERE a.v <> 0"))
_prom("promql_match_ignoring", "event_value - ignoring (user_id) group_left () max by (event_type) (event_value)", BOTH, _latest(", a AS (SELECT event_type, ts, max(v) AS v FROM l GROUP BY ALL) SELECT l.event_type, l.user_id, l.ts, round(l.v - a.v, 6) AS value FROM l JOIN a USING (event_type, ts)"))
_prom("promql_and", 'event_value and on (user_id) event_value{event_type="error"}', BOTH, _latest("SELECT event_type, user_id, ts, round(v, 6) AS value FROM l WHERE (user_id, ts) IN (SELECT user_id, ts FROM l WHERE event_type = 'error')"))
_prom("promql_unless", 'event_value unless on (user_id) event_value{event_type="error"}', BOTH, _latest("SELECT event_type, user_id, ts, round(v, 6) AS value FROM l WHERE (user_id, ts) NOT IN (SELECT user_id, ts FROM l WHERE event_type = 'error')"))
_prom("promql_or", 'event_value{event_type="error"} or on (user_id) event_value{event_type="view"}', BOTH, _latest("SELECT event_type, user_id, ts, round(v, 6) AS value FROM l WHERE event_type = 'error' OR (event_type = 'view' AND (user_id, ts) NOT IN (SELECT user_id, ts FROM l WHERE event_type = 'error'))"))
_prom("promql_math", "ln(event_value + 1) + sqrt(event_value) + abs(-event_value) + ceil(event_value) - floor(event_value)", BOTH, _latest("SELECT event_type, user_id, ts, round(ln(v + 1) + sqrt(v) + abs(v) + ceil(v) - floor(v), 6) AS value FROM l"))
_prom("promql_trig", "sin(event_value) * cos(event_value) + atan(event_value) + rad(deg(event_value))", BOTH, _latest("SELECT event_type, user_id, ts, round(sin(v) * cos(v) + atan(v) + v, 6) AS value FROM l"))
_prom("promql_clamp_round", "clamp(round(event_value, 5), 10, 60)", BOTH, _latest("SELECT event_type, user_id, ts, round(greatest(10, least(60, floor(v / 5 + 0.5) * 5)), 6) AS value FROM l"))
_prom("promql_clock", "hour() * 100 + day_of_week() * 10 + days_in_month()", (), f"WITH {_grid(START, END, HOUR)}, d AS (SELECT ts, epoch_ms(CAST(ts AS BIGINT)) AS moment FROM g) SELECT ts, CAST(hour(moment) * 100 + dayofweek(moment) * 10 + day(last_day(moment)) AS DOUBLE) AS value FROM d")
_prom("promql_time_scalar", "sum(event_value) + scalar(count(event_value)) - time() / 3600", (), _latest("SELECT ts, round(sum(v) + count(*) - ts / 3600000.0, 6) AS value FROM l GROUP BY ts"))
_prom("promql_timestamp", "timestamp(event_value)", BOTH, _latest("SELECT event_type, user_id, ts, round(t / 1000.0, 6) AS value FROM l"))
_prom("promql_label_replace", 'sum by (kind) (label_replace(event_value, "kind", "$1", "event_type", "(..).*"))', ("kind",), _latest("SELECT left(event_type, 2) AS kind, ts, round(sum(v), 6) AS value FROM l GROUP BY ALL"))
_prom("promql_label_join", 'sum by (both) (label_join(event_value, "both", "-", "event_type", "user_id"))', ("both",), _latest("SELECT event_type || '-' || user_id AS both, ts, round(sum(v), 6) AS value FROM l GROUP BY ALL"))
_prom("promql_histogram_quantile", 'histogram_quantile(0.5, label_replace(count(event_value <= 25), "le", "25", "", "") or label_replace(count(event_value <= 50), "le", "50", "", "") or label_replace(count(event_value), "le", "+Inf", "", ""))', (), _latest(""", b AS (SELECT ts, CAST(count(*) FILTER (WHERE v <= 25) AS DOUBLE) AS c1, CAST(count(*) FILTER (WHERE v <= 50) AS DOUBLE) AS c2, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY ts)
    SELECT ts, round(CASE WHEN c1 = 0 AND c2 = 0 THEN 'NaN'::DOUBLE WHEN c1 > 0 AND c1 >= n / 2 THEN 25 * (n / 2 / c1) WHEN c2 >= n / 2 THEN CASE WHEN c1 > 0 THEN 25 + 25 * ((n / 2 - c1) / (c2 - c1)) ELSE 50 * (n / 2 / c2) END WHEN c2 > 0 THEN 50 ELSE 25 END, 6) AS value FROM b"""))

_prom("promql_at_start_end", "sum(sum_over_time(event_value[3d] @ start() offset -3d)) - sum(sum_over_time(event_value[3d] @ end() offset 1d))", (), f"WITH {_SAMPLES}, {_grid(START, END, HOUR)} SELECT ts, round((SELECT sum(v) FROM s WHERE t > {START} AND t <= {START + 3 * DAY}) - (SELECT sum(v) FROM s WHERE t > {END - 4 * DAY} AND t <= {END - DAY}), 6) AS value FROM g")
_prom("promql_negative_offset", "sum(event_value offset -3h)", (), f"WITH {_SAMPLES}, {_grid(START, END, HOUR)}, l AS (SELECT event_type, user_id, g.ts, arg_max(v, t) AS v FROM g JOIN s ON s.t > g.ts + {2 * HOUR} AND s.t <= g.ts + {3 * HOUR} GROUP BY ALL) SELECT ts, round(sum(v), 6) AS value FROM l GROUP BY ts")
_prom("promql_group_right", "sum by (event_type) (event_value) * on (event_type) group_right () event_value", BOTH, _latest(_TOTAL + " SELECT l.event_type, l.user_id, l.ts, round(l.v * a.v, 6) AS value FROM l JOIN a USING (event_type, ts)"))
_prom("promql_group_left_include", 'event_value * on (event_type) group_left (kind) label_replace(count by (event_type) (event_value), "kind", "$1", "event_type", "(..).*")', (*BOTH, "kind"), _latest(", a AS (SELECT event_type, ts, count(*) AS n FROM l GROUP BY ALL) SELECT l.event_type, l.user_id, left(l.event_type, 2) AS kind, l.ts, round(l.v * a.n, 6) AS value FROM l JOIN a USING (event_type, ts)"))
_prom("promql_sort_desc", "sort_desc(sum by (event_type) (event_value))", BOTH[:1], _latest("SELECT event_type, ts, round(sum(v), 6) AS value FROM l GROUP BY ALL"))
_prom("promql_modulo_power_atan2", "(event_value % 7) + (event_value ^ 2) + (event_value atan2 (event_value + 1))", BOTH, _latest("SELECT event_type, user_id, ts, round(fmod(v, 7) + v * v + atan2(v, v + 1), 6) AS value FROM l"))
_prom("promql_calendar", "year() * 1000000 + month() * 10000 + day_of_month() * 100 + day_of_year() + minute()", (), f"WITH {_grid(START, END, HOUR)}, d AS (SELECT ts, epoch_ms(CAST(ts AS BIGINT)) AS moment FROM g) SELECT ts, CAST(year(moment) * 1000000 + month(moment) * 10000 + day(moment) * 100 + dayofyear(moment) + minute(moment) AS DOUBLE) AS value FROM d")
_prom("promql_hyperbolic", "sinh(event_value / 1000) + cosh(event_value / 1000) + tanh(event_value) + asinh(event_value) + acosh(event_value + 1) + atanh(event_value / 10000) + asin(event_value / 10000) + acos(event_value / 10000) + tan(event_value / 10000)", BOTH, _latest("SELECT event_type, user_id, ts, round(sinh(v / 1000) + cosh(v / 1000) + tanh(v) + asinh(v) + acosh(v + 1) + atanh(v / 10000) + asin(v / 10000) + acos(v / 10000) + tan(v / 10000), 6) AS value FROM l"))
_prom("promql_logarithms", "exp(event_value / 100) + log2(event_value + 1) + log10(event_value + 1) + sgn(event_value - 50)", BOTH, _latest("SELECT event_type, user_id, ts, round(exp(v / 100) + log2(v + 1) + log10(v + 1) + sign(v - 50), 6) AS value FROM l"))
_prom("promql_or_vector", "sum(event_value) or vector(0)", (), _latest("SELECT g.ts, round(coalesce(sum(l.v), 0), 6) AS value FROM g LEFT JOIN l ON l.ts = g.ts GROUP BY g.ts"))
_prom("promql_round_large", "round((event_value + 1) * 1e300) / 1e300 + clamp_max(round((event_value + 1) / 0), 5)", BOTH, _latest("SELECT event_type, user_id, ts, round(v + 6, 6) AS value FROM l"))
_prom("promql_implicit_step", "max_over_time(sum by (event_type) (event_value)[6h])", BOTH[:1], ORACLES["promql_subquery"])

# LogQL
_E = ("event_type",)
W2 = 2 * HOUR
_lq = lambda select, window, **kw: _over(select, "event_type", window * NS, base=_LOGS, **kw).replace(_grid(START, END, HOUR), _grid(START * NS, END * NS, HOUR * NS)).replace("SELECT event_type, ts // 1 AS ts", f"SELECT event_type, ts // {NS} AS ts")
_log("logql_count_over_time", 'sum by (event_type) (count_over_time({app="events"}[1h]))', _E, _lq("CAST(count(*) AS DOUBLE)", HOUR))
_log("logql_rate", 'sum by (event_type) (rate({app="events"}[2h]))', _E, _lq("count(*) / 7200.0", W2))
_log("logql_bytes", 'sum by (event_type) (bytes_over_time({app="events"}[2h]))', _E, _lq("CAST(sum(strlen(line)) AS DOUBLE)", W2))
_log("logql_bytes_rate", 'sum by (event_type) (bytes_rate({app="events"}[2h]))', _E, _lq("sum(strlen(line)) / 7200.0", W2))
_log("logql_line_contains", 'sum by (event_type) (count_over_time({app="events"} |= "7" != "77" [2h]))', _E, _lq("CAST(count(*) AS DOUBLE)", W2, where="contains(line, '7') AND NOT contains(line, '77')"))
_log("logql_line_regex", 'sum by (event_type) (count_over_time({app="events"} |~ "[0-4]}$" !~ "1." [2h]))', _E, _lq("CAST(count(*) AS DOUBLE)", W2, where="regexp_matches(line, '[0-4]}$') AND NOT regexp_matches(line, '1.')"))
_log("logql_line_pattern", 'sum by (event_type) (count_over_time({app="events"} |> "user <_> did <_> k=9<_>" [2h]))', _E, _lq("CAST(count(*) AS DOUBLE)", W2, where="k = 9 OR (k >= 90 AND k < 100)"), line="text")
_log("logql_json_sum", 'sum_over_time({app="events"} | json | unwrap k [2h]) by (event_type)', _E, _lq("sum(k)", W2))
_log("logql_json_path_filter", 'avg_over_time({app="events"} | json n="k" | n >= 20 | unwrap n [2h]) by (event_type)', _E, _lq("avg(k)", W2, where="k >= 20"))
_log("logql_logfmt_duration", 'sum_over_time({app="events"} | logfmt | took > 10ms | unwrap duration(took) [2h]) by (event_type)', _E, _lq("sum(k) / 1000", W2, where="k > 10"), line="logfmt")
_log("logql_logfmt_bytes", 'max_over_time({app="events"} | logfmt | size <= 50KiB | unwrap bytes(size) [2h]) by (event_type)', _E, _lq("max(k) * 1024", W2, where="k <= 50"), line="logfmt")
_log("logql_regexp_min", 'min_over_time({app="events"} | regexp "k=(?P<n>[0-9]+)$" | unwrap n [2h]) by (event_type)', _E, _lq("min(k)", W2), line="text")
_log("logql_pattern_stddev", 'stddev_over_time({app="events"} | pattern "user <u> did <a> k=<n>" | unwrap n [2h]) by (event_type)', _E, _lq("stddev_pop(k)", W2), line="text")
_log("logql_stdvar", 'stdvar_over_time({app="events"} | json | unwrap k [2h]) by (event_type)', _E, _lq("var_pop(k)", W2))
_log("logql_first_last", 'last_over_time({app="events"} | json | unwrap k [2h]) by (event_type) - first_over_time({app="events"} | json | unwrap k [2h]) by (event_type)', _E, _lq("arg_max(k, t) - arg_min(k, t)", W2))
_log("logql_quantile_nearest_rank", 'quantile_over_time(0.9, {app="events"} | json | unwrap k [2h]) by (event_type)', _E, _lq("quantile_disc(k, 0.9)", W2))
_log("logql_absent", 'absent_over_time({app="events", event_type="signup"}[1h])', (), f"WITH {_LOGS}, {_grid(START * NS, END * NS, HOUR * NS)} SELECT g.ts // {NS} AS ts, 1.0 AS value FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE event_type = 'signup' AND s.t > g.ts - {HOUR * NS} AND s.t <= g.ts)")
_log("logql_offset", 'sum by (event_type) (count_over_time({app="events"}[1h] offset 1h))', _E, f"WITH {_LOGS}, {_grid(START * NS, END * NS, HOUR * NS)} SELECT event_type, g.ts // {NS} AS ts, CAST(count(*) AS DOUBLE) AS value FROM g JOIN s ON s.t > g.ts - {2 * HOUR * NS} AND s.t <= g.ts - {HOUR * NS} GROUP BY ALL")
_log("logql_line_and_label_format", 'sum by (tag) (bytes_over_time({app="events"} | json | line_format "{{.event_type | upper}}:{{.k}}" | label_format tag="{{.event_type}}-{{.k}}" [1d]))', ("tag",), f"WITH {_LOGS}, {_grid(START * NS, END * NS, HOUR * NS)} SELECT event_type || '-' || CAST(CAST(k AS BIGINT) AS VARCHAR) AS tag, g.ts // {NS} AS ts, CAST(sum(strlen(upper(event_type) || ':' || CAST(CAST(k AS BIGINT) AS VARCHAR))) AS DOUBLE) AS value FROM g JOIN s ON s.t > g.ts - {DAY * NS} AND s.t <= g.ts GROUP BY ALL")
_log("logql_keep_drop", 'count_over_time({app="events"} | json | drop k | keep event_type [2h])', _E, _lq("CAST(count(*) AS DOUBLE)", W2))
_log("logql_topk", 'topk(2, sum by (event_type) (count_over_time({app="events"}[2h])))', _E, _lq("count(*)", W2, tail=f"SELECT event_type, ts // {NS} AS ts, CAST(value AS DOUBLE) AS value FROM r QUALIFY row_number() OVER (PARTITION BY ts ORDER BY value DESC, event_type) <= 2"))
_log("logql_bottomk", 'bottomk(1, sum by (event_type) (count_over_time({app="events"}[2h])))', _E, _lq("count(*)", W2, tail=f"SELECT event_type, ts // {NS} AS ts, CAST(value AS DOUBLE) AS value FROM r QUALIFY row_number() OVER (PARTITION BY ts ORDER BY value, event_type) <= 1"))
_log("logql_comparison", 'sum by (event_type) (count_over_time({app="events"}[2h])) > 2', _E, _lq("count(*)", W2, tail=f"SELECT event_type, ts // {NS} AS ts, CAST(value AS DOUBLE) AS value FROM r WHERE value > 2"))
_HIT = _lq("count(*) FILTER (WHERE regexp_matches(line, '[0-4]}$')) AS hit, count(*)", W2, tail="@@")
_log("logql_div_on", 'sum by (event_type) (count_over_time({app="events"} |~ "[0-4]}$" [2h])) / on (event_type) sum by (event_type) (count_over_time({app="events"}[2h]))', _E, _HIT.replace("@@", f"SELECT event_type, ts // {NS} AS ts, round(hit / value, 6) AS value FROM r WHERE hit > 0"))
_log("logql_unless", 'sum by (event_type) (count_over_time({app="events"}[2h])) unless on (event_type) sum by (event_type) (count_over_time({app="events"} |~ "[0-4]}$" [2h]))', _E, _HIT.replace("@@", f"SELECT event_type, ts // {NS} AS ts, CAST(value AS DOUBLE) AS value FROM r WHERE hit = 0"))
_log("logql_and", 'sum by (event_type) (count_over_time({app="events"}[2h])) and on (event_type) sum by (event_type) (count_over_time({app="events"} |~ "[0-4]}$" [2h]))', _E, _HIT.replace("@@", f"SELECT event_type, ts // {NS} AS ts, CAST(value AS DOUBLE) AS value FROM r WHERE hit > 0"))
_log("logql_or_vector", 'sum(count_over_time({app="events"}[1h])) or vector(0)', (), f"WITH {_LOGS}, {_grid(START * NS, END * NS, HOUR * NS)} SELECT g.ts // {NS} AS ts, CAST(count(s.t) AS DOUBLE) AS value FROM g LEFT JOIN s ON s.t > g.ts - {HOUR * NS} AND s.t <= g.ts GROUP BY g.ts")
_log("logql_label_replace_join", 'label_join(label_replace(sum by (event_type) (count_over_time({app="events"}[2h])), "short", "$1", "event_type", "(..).*"), "joined", "/", "short", "event_type")', ("joined",), _lq("count(*)", W2, tail=f"SELECT left(event_type, 2) || '/' || event_type AS joined, ts // {NS} AS ts, CAST(value AS DOUBLE) AS value FROM r"))
_log("logql_aggregates", 'max(sum by (event_type) (count_over_time({app="events"}[2h]))) - min(sum by (event_type) (count_over_time({app="events"}[2h]))) + avg(sum by (event_type) (count_over_time({app="events"}[2h])))', (), _lq("count(*)", W2, tail=f"SELECT ts // {NS} AS ts, round(max(value) - min(value) + avg(value), 6) AS value FROM r GROUP BY ts"))


_log("logql_without", 'sum without (app) (count_over_time({app="events"}[2h]))', _E, _lq("CAST(count(*) AS DOUBLE)", W2))
_log("logql_range_without", 'sum_over_time({app="events"} | json | unwrap k [2h]) without (app, k)', _E, _lq("sum(k)", W2))
_log("logql_group_left", 'sum by (event_type) (count_over_time({app="events"}[2h])) * on () group_left () sum(count_over_time({app="events"}[2h]))', _E, _lq("count(*)", W2, tail=f"SELECT event_type, ts // {NS} AS ts, CAST(value * sum(value) OVER (PARTITION BY ts) AS DOUBLE) AS value FROM r"))
_log("logql_bool", 'sum by (event_type) (count_over_time({app="events"}[2h])) > bool 2', _E, _lq("CAST(count(*) > 2 AS INT) * 1.0", W2))
_log("logql_modulo_power", 'sum by (event_type) (count_over_time({app="events"}[2h])) % 3 + sum by (event_type) (count_over_time({app="events"}[2h])) ^ 2', _E, _lq("CAST(count(*) % 3 + count(*) * count(*) AS DOUBLE)", W2))
_log("logql_spread_aggregates", 'stddev(sum by (event_type) (count_over_time({app="events"}[2h]))) + stdvar(sum by (event_type) (count_over_time({app="events"}[2h]))) + count(sum by (event_type) (count_over_time({app="events"}[2h])))', (), _lq("count(*)", W2, tail=f"SELECT ts // {NS} AS ts, round(stddev_pop(value) + var_pop(value) + count(*), 6) AS value FROM r GROUP BY ts"))
_log("logql_decolorize", 'sum by (event_type) (bytes_over_time({app="events"} | decolorize [2h]))', _E, _lq("CAST(sum(strlen(event_type) + 3 + strlen(CAST(CAST(k AS BIGINT) AS VARCHAR))) AS DOUBLE)", W2), line="colour")
_log("logql_connectors", 'sum by (event_type) (count_over_time({app="events"} | json | k >= 90 or k < 10 and event_type != "click" [2h]))', _E, _lq("CAST(count(*) AS DOUBLE)", W2, where="(k >= 90 OR k < 10) AND event_type <> 'click'"))
_log("logql_equal_number", 'sum by (event_type) (count_over_time({app="events"} | json | k == 7 [1d]))', _E, _lq("CAST(count(*) AS DOUBLE)", DAY, where="k = 7"))
_log("logql_error", 'sum by (event_type) (count_over_time({app="events"} | json | __error__="JSONParserErr" [2h]))', _E, _lq("CAST(count(*) AS DOUBLE)", W2), line="text")
_log("logql_not_pattern", 'sum by (event_type) (count_over_time({app="events"} !> "user <_> did <_> k=9<_>" [2h]))', _E, _lq("CAST(count(*) AS DOUBLE)", W2, where="NOT (k = 9 OR (k >= 90 AND k < 100))"), line="text")
_log("logql_unwrap_rate", 'rate({app="events"} | json | unwrap k [2h]) by (event_type)', _E, _lq("count(*) / 7200.0", W2))
_log("logql_template_functions", 'sum by (event_type) (bytes_over_time({app="events"} | line_format "{{.event_type | upper | trunc 3}}{{ .none | default `none` }}{{ .event_type | replace `e` `333` }}{{ substr 1 3 .event_type }}" [2h]))', _E, _lq("CAST(sum(3 + 4 + strlen(replace(event_type, 'e', '333')) + 2) AS DOUBLE)", W2))


def logql_select(spark: SparkSession, d: str) -> DataFrame:
    rows = engine.logql_range(stores.events_logs(spark, d), '{app="events"} | json | k > 90', START * NS, END * NS, limit=None)
    return rows.select(F.col("labels")["event_type"].alias("event_type"), "ts_ns", "line")


def document_line_filters(spark: SparkSession, d: str) -> DataFrame:
    """documents as log lines of streams {lang, source}, each a second after the last."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ns = (F.col("doc_id") + 1) * 1_000_000_000
    rows = docs.select(ns.alias("ts_ns"), ns.alias("observed_ns"), F.col("text").alias("line"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("stream"), L.empty().alias("resource"), L.empty().alias("fields"))
    out = engine.logql_instant(stores.LogStore(rows), 'sum by (lang) (bytes_over_time({source=~"src.+"} |= "an" !~ "[0-9]{5}" [3650d]))', 3650 * DAY * NS)
    return out.select(F.col("labels")["lang"].alias("lang"), F.round("v", 6).alias("value"))


def meta_label_names(spark: SparkSession, d: str) -> DataFrame:
    return metadata.label_names(stores.events_metrics(spark, d))


def meta_label_values(spark: SparkSession, d: str) -> DataFrame:
    return metadata.label_values(stores.events_metrics(spark, d), "user_id", ['event_value{event_type="click"}'], START, END)


def meta_series(spark: SparkSession, d: str) -> DataFrame:
    return metadata.series(stores.events_metrics(spark, d), ['event_value{event_type=~"click|view"}'], START, END).select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"))


def meta_log_labels(spark: SparkSession, d: str) -> DataFrame:
    return metadata.log_labels(stores.events_logs(spark, d), START * NS, END * NS)


def meta_log_label_values(spark: SparkSession, d: str) -> DataFrame:
    return metadata.log_label_values(stores.events_logs(spark, d), "event_type", START * NS, END * NS)


def _event_batch(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    labels = F.create_map(F.lit(L.NAME), F.lit("event_value"), F.lit("event_type"), F.col("event_type"))
    return e.select(F.lit(1).cast("bigint").alias("team_id"), labels.alias("labels"), F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("ts_ms"), F.col("value").alias("v"), F.lit(False).alias("is_stale"), F.col("event_id").alias("arrival_seq"))


def ingest_bucket_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Samples of one series in one interval of 15 minutes: the last to arrive stays."""
    return ingest.samples(_event_batch(spark, d), 900_000).select("ts_ms", F.round("v", 6).alias("value"), "arrival_seq")


def ingest_new_series(spark: SparkSession, d: str) -> DataFrame:
    batch = _event_batch(spark, d)
    known = ingest.new_series(batch.where("labels['event_type'] in ('click', 'error')"), spark.createDataFrame([], "team_id bigint, id bigint"))
    return ingest.new_series(batch, known).select(F.col("labels")["event_type"].alias("event_type"), "min_time_ms", "max_time_ms")


def ingest_severity(spark: SparkSession, d: str) -> DataFrame:
    """Severity of lines that name it in JSON, in a key of logfmt, as a word of a sentence, or not at all."""
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.col("event_type")
    line = F.when(kind == "click", '{"k": 1, "level": "WARN"}').when(kind == "view", "lvl=debug error x").when(kind == "purchase", "[fatal] info").when(kind == "signup", '{"severity": "unheard"} of errors').otherwise(F.concat(F.lit("an "), kind, F.lit(": "), "props"))
    return e.select(ingest.severity(line).alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def logs_minute_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = stores.events_logs(spark, d).rows.select(F.lit(1).alias("team_id"), F.xxhash64(F.col("stream")["event_type"]).alias("stream_id"), "ts_ns", "line", F.col("stream")["event_type"].alias("event_type"))
    stats = ingest.log_stats(rows)
    names = rows.select("stream_id", "event_type").distinct()
    return stats.join(names, "stream_id").select("event_type", "bucket_ms", "log_count", "byte_count")


def native_histogram_totals(spark: SparkSession, d: str) -> DataFrame:
    """Count and sum of native histograms made of the events' values, one for each type and day."""
    return histograms.from_values(spark.read.parquet(f"{d}/events.parquet").select("event_type", (F.floor(F.expr("unix_millis(CAST(ts AS TIMESTAMP))") / DAY) * DAY).alias("ts"), F.col("value").alias("v")), ["event_type", "ts"]).select("event_type", "ts", histograms.count("h").alias("n"), F.round(histograms.total("h"), 4).alias("total"))


for _f in (logql_select, document_line_filters, meta_label_names, meta_label_values, meta_series, meta_log_labels, meta_log_label_values, ingest_bucket_last_wins, ingest_new_series, ingest_severity, logs_minute_rollup, native_histogram_totals):
    QUERIES[_f.__name__] = _f

ORACLES |= {
    "logql_select": f"SELECT event_type, epoch_us(ts) * 1000 AS ts_ns, props AS line FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 90 AND epoch_ms(ts) BETWEEN {START} AND {END}",
    "document_line_filters": "SELECT lang, CAST(sum(strlen(text)) AS DOUBLE) AS value FROM documents WHERE contains(text, 'an') AND NOT regexp_matches(text, '[0-9]{5}') GROUP BY lang",
    "meta_label_names": "SELECT unnest(['__name__', 'event_type', 'user_id']) AS name",
    "meta_label_values": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'click'",
    "meta_series": "SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type IN ('click', 'view')",
    "meta_log_labels": "SELECT unnest(['app', 'detected_level', 'event_type', 'level', 'service.name', 'service_name', 'severity_text', 'span_id', 'trace_id']) AS name",
    "meta_log_label_values": "SELECT DISTINCT event_type AS value FROM events",
    "ingest_bucket_last_wins": "SELECT (epoch_us(ts) // 1000) // 900000 * 900000 AS ts_ms, round(arg_max(value, event_id), 6) AS value, max(event_id) AS arrival_seq FROM events GROUP BY event_type, 1",
    "ingest_new_series": "SELECT event_type, min((epoch_us(ts) // 1000) // 15000 * 15000) AS min_time_ms, max((epoch_us(ts) // 1000) // 15000 * 15000) AS max_time_ms FROM events WHERE event_type NOT IN ('click', 'error') GROUP BY event_type",
    "ingest_severity": "SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' WHEN 'view' THEN 'debug' WHEN 'purchase' THEN 'fatal' ELSE 'unknown' END AS severity, count(*) AS n FROM events GROUP BY 1",
    "logs_minute_rollup": "SELECT event_type, (epoch_us(ts) // 60000000) * 60000 AS bucket_ms, count(*) AS log_count, CAST(sum(strlen(props)) AS BIGINT) AS byte_count FROM events GROUP BY ALL",
    "native_histogram_totals": f"SELECT event_type, (epoch_us(ts) // 1000) // {DAY} * {DAY} AS ts, CAST(count(*) AS DOUBLE) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
