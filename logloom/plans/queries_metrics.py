"""Queries on metrics, windows, features, anomaly scores, reliability and service levels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as txt
from ..operators import alerts, anomaly, features, metrics, promql, reliability, routing, slo
from ..schema import PROCESSING_BUCKETS
from .adapters import LOG_SQL, US, events_as_log, table
from .pipeline import Mode, apply, load
from .registry import query

LOG = f"WITH log AS ({LOG_SQL})\n"
NOW_US = "epoch_us(TIMESTAMP '2024-01-31 00:00:00')"
NOW = 1706659200 * US


def r6(c):
    return F.round(c, 6)


DEFAULT_PIPELINE = r"""
pipelines:
  - name: default
    steps:
      - {name: extract_level, type: log_level_extract, config: {pattern: '(?i)\b(trace|debug|info|warn|warning|error|fatal|crit|critical)\b'}}
      - {name: ensure_msg, type: field_add, config: {fields: {msg: '{{message}}'}}}
      - {name: add_standard_labels, type: field_add, config: {fields: {pipeline: default}}}
"""


@query(LOG + "SELECT CASE WHEN level = 'error' THEN 'logs-high-priority' ELSE 'logs' END AS topic, level, CAST(count(*) AS BIGINT) AS records FROM log GROUP BY 1, 2")
def records_per_topic(spark, d):
    """The flagship: records per topic and level after the default pipeline."""
    pipelines, _ = load(DEFAULT_PIPELINE)
    e = events_as_log(spark, d).withColumn("timestamp", F.col("ts").cast("timestamp"))
    out = apply(e, pipelines["default"], Mode())
    level = F.coalesce(F.col("labels")["level"], F.col("level"))
    return out.groupBy(routing.topic(F.col("labels")).alias("topic"), level.alias("level")).agg(F.count("*").alias("records"))


# --- aggregates ---------------------------------------------------------------------------------------------------------------


@query(LOG + "SELECT event_type, level, CAST(count(*) AS BIGINT) AS value FROM log GROUP BY 1, 2")
def a01_counters(spark, d):
    return metrics.counters(events_as_log(spark, d), ["event_type", "level"])


@query(LOG + "SELECT source_id, event_type, arg_max(value, us) AS value, CAST(max(us) AS BIGINT) AS ts FROM log GROUP BY 1, 2")
def a02_gauges(spark, d):
    return metrics.gauges(events_as_log(spark, d), ["source_id", "event_type"], "value", "us")


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)


@query(LOG + " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, CAST(count(*) FILTER (value <= {b}) AS BIGINT) AS count FROM log GROUP BY 1" for b in _BOUNDS) + " UNION ALL SELECT event_type, 'Infinity', CAST(count(*) AS BIGINT) FROM log GROUP BY 1")
def a03_histogram(spark, d):
    return metrics.histogram(events_as_log(spark, d), ["event_type"], "value", _BOUNDS).select("event_type", F.col("le").cast("string").alias("le"), "count")


@query("""WITH w AS (SELECT o_orderpriority AS priority, least(date_diff('day', o_orderdate, l_shipdate) / 10.0, 20.0) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
""" + " UNION ALL ".join(f"SELECT priority, '{b}' AS le, CAST(count(*) FILTER (abs(v) <= {b}) AS BIGINT) AS count FROM w GROUP BY 1" for b in PROCESSING_BUCKETS))
def a03_latency_histogram(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.timestamp_diff("DAY", F.col("o_orderdate"), F.col("l_shipdate"))
    v = rows.select(F.col("o_orderpriority").alias("priority"), F.abs(F.least(days / 10.0, F.lit(20.0))).alias("v"))
    return metrics.histogram(v, ["priority"], "v", PROCESSING_BUCKETS).where(F.col("le") < float("inf")).select("priority", F.col("le").cast("string").alias("le"), "count")


@query(LOG + "SELECT id, source_id, CAST(sum(CASE WHEN level = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failed FROM log")
def a04_running_totals(spark, d):
    return metrics.running(events_as_log(spark, d), ["source_id"], ["us"], F.when(F.col("level") == "error", 1).otherwise(0), "failed").select("id", "source_id", "failed")


_HOURLY = "SELECT event_type, CAST(floor(us / 3600000000) AS BIGINT) * 3600 AS s, count(*) AS n FROM log GROUP BY 1, 2"


def hourly(spark, d):
    e = events_as_log(spark, d)
    return e.groupBy("event_type", (F.floor(F.col("us") / (3600 * US)) * 3600).alias("s")).agg(F.count("*").alias("n"))


@query(LOG + f"SELECT event_type, s, round((total - lag(total) OVER w) / (s - lag(s) OVER w), 6) AS rate FROM (SELECT event_type, s, sum(n) OVER (PARTITION BY event_type ORDER BY s) AS total FROM ({_HOURLY})) WINDOW w AS (PARTITION BY event_type ORDER BY s)")
def a05_throughput(spark, d):
    total = metrics.running(hourly(spark, d), ["event_type"], ["s"], F.col("n"), "total")
    return metrics.throughput(total, ["event_type"], "s", "total").select("event_type", "s", r6(F.col("rate")).alias("rate"))


@query("WITH RECURSIVE log AS (" + LOG_SQL + "), o AS (SELECT source_id, value, row_number() OVER (PARTITION BY source_id ORDER BY us) AS i, id FROM log), e AS (SELECT source_id, i, id, value AS ewma FROM o WHERE i = 1 UNION ALL SELECT o.source_id, o.i, o.id, 0.1 * o.value + 0.9 * e.ewma FROM e JOIN o ON o.source_id = e.source_id AND o.i = e.i + 1) SELECT id, round(ewma, 6) AS ewma FROM e")
def a06_ewma(spark, d):
    return metrics.ewma(events_as_log(spark, d).select("id", "source_id", "us", "value"), ["source_id"], ["us"], "value", 0.1).select("id", r6(F.col("ewma")).alias("ewma"))


_Q = ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(100 * q):02d}" for q in metrics.PERCENTILES)


@query(LOG + f"SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, {_Q} FROM log GROUP BY 1")
def a07_summary(spark, d):
    out = metrics.summary(events_as_log(spark, d), ["event_type"], "value")
    return out.select("event_type", "n", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"), "min", "max", F.round("sum", 4).alias("sum"), *(r6(F.col(c)).alias(c) for c in anomaly.NAMES))


@query(LOG + "SELECT source_id, round(median(value), 6) AS median FROM log GROUP BY 1")
def a09_median(spark, d):
    return events_as_log(spark, d).groupBy("source_id").agg(r6(F.percentile("value", 0.5)).alias("median"))


@query(LOG + "SELECT event_type, v[CAST(least(floor(len(v) * 99 / 100), len(v) - 1) AS BIGINT) + 1] AS p99 FROM (SELECT event_type, list_sort(list(value)) AS v FROM log GROUP BY 1)")
def a10_index_percentile(spark, d):
    return metrics.index_percentile(events_as_log(spark, d), ["event_type"], "value", 99)


@query(LOG + "SELECT id, v[CAST(least(floor(len(v) * 95 / 100), len(v) - 1) AS BIGINT) + 1] AS p95 FROM (SELECT id, list_sort(list(value) OVER (PARTITION BY source_id ORDER BY us ROWS 99 PRECEDING)) AS v FROM log)")
def a11_ring_percentile(spark, d):
    w = Window.partitionBy("source_id").orderBy("us").rowsBetween(-99, 0)
    v = F.array_sort(F.collect_list("value").over(w))  # at most a hundred values
    return events_as_log(spark, d).select("id", v.alias("v")).select("id", F.element_at("v", F.least(F.floor(F.size("v") * 95 / 100), F.size("v") - 1).cast("int") + 1).alias("p95"))


@query("SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+'), lambda x: lower(x)))) AS BIGINT) AS unique_words FROM documents")
def a13_unique_words(spark, d):
    words = F.transform(F.regexp_extract_all(F.col("text"), F.lit("[^\\t\\n\\x0B\\f\\r ]+"), 0), F.lower)
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(words)).cast("long").alias("unique_words"))


@query(LOG + "SELECT source_id, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1 ORDER BY n DESC, source_id LIMIT 10")
def a14_top_sources(spark, d):
    return metrics.top(events_as_log(spark, d), ["source_id"], 10)


@query(LOG + f"SELECT event_type, s, round(CASE WHEN coalesce(lag(n) OVER w, 0) = 0 THEN 0 ELSE (n - lag(n) OVER w) / lag(n) OVER w * 100 END, 6) AS growth, CASE WHEN n / 3.0 > 2 THEN 'critical' WHEN n / 3.0 > 1.5 THEN 'high' ELSE 'warning' END AS severity FROM ({_HOURLY}) WINDOW w AS (PARTITION BY event_type ORDER BY s)")
def a15_growth(spark, d):
    out = metrics.growth_percent(hourly(spark, d), ["event_type"], "s", "n")
    return out.select("event_type", "s", r6(F.col("growth")).alias("growth"), metrics.severity_of_ratio(F.col("n"), F.lit(3.0)).alias("severity"))


@query(LOG + f"SELECT event_type, s, round(coalesce((last_value(n) OVER w - first_value(n) OVER w) * 60.0 / nullif(last_value(s) OVER w - first_value(s) OVER w, 0), 0), 6) AS per_minute FROM ({_HOURLY}) WINDOW w AS (PARTITION BY event_type ORDER BY s ROWS 4 PRECEDING)")
def a16_growth_per_minute(spark, d):
    return metrics.growth_per_minute(hourly(spark, d), ["event_type"], "s", "n").select("event_type", "s", r6(F.col("per_minute")).alias("per_minute"))


_WAIT = 2 * 3600 * US
_FIRES = """WITH RECURSIVE log AS (""" + LOG_SQL + """), k AS (SELECT id, us, source_id AS key FROM log WHERE level = 'error'),
 chain AS (SELECT key, min(us) AS us FROM k GROUP BY key UNION ALL SELECT c.key, (SELECT min(k.us) FROM k WHERE k.key = c.key AND k.us >= c.us + {w}) FROM chain c WHERE EXISTS (SELECT 1 FROM k WHERE k.key = c.key AND k.us >= c.us + {w})) """


@query(_FIRES.format(w=_WAIT) + "SELECT k.id, c.us IS NULL AS suppressed FROM k LEFT JOIN chain c ON c.key = k.key AND c.us = k.us")
def a19_cooldown(spark, d):
    e = events_as_log(spark, d).where("level = 'error'").select("id", "us", F.col("source_id").alias("key"))
    return metrics.cooldown(e, "key", "us", _WAIT).select("id", "suppressed")


#: Each key's records one after the other: ``start`` and ``step`` are the states' columns, of rows ``o`` (state before: ``r``).
_FOLD = LOG.replace("WITH", "WITH RECURSIVE", 1) + ", o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY us, {tie}) AS rn FROM log), r AS ({start} FROM o WHERE rn = 1 UNION ALL {step}) "


@query(_FOLD.format(tie="id", start="SELECT id, source_id, rn, CAST(0 AS BIGINT) AS batch, us AS first, 1 AS n", step="""SELECT o.id, o.source_id, o.rn, CASE WHEN r.n >= 5 OR o.us - r.first >= 86400000000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 5 OR o.us - r.first >= 86400000000 THEN o.us ELSE r.first END,
 CASE WHEN r.n >= 5 OR o.us - r.first >= 86400000000 THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.source_id = r.source_id AND o.rn = r.rn + 1""") + "SELECT id, batch FROM r")
def a20_micro_batches(spark, d):
    e = events_as_log(spark, d).select("id", "us", "source_id")
    return metrics.micro_batches(e, ["source_id"], "us", 5, 86_400 * US).select("id", "batch")


def _sized(size: str, delay: str) -> str:
    """A batch's size and delay after an observation (value, ten times it as the rate) from those before."""
    new = "CASE WHEN o.value > 50 THEN {0} * CAST({1} AS DOUBLE) WHEN o.value * 10 < 100 THEN {0} * CAST({2} AS DOUBLE) ELSE {0} END"
    return f"least(greatest(CAST(floor({new.format(size, 0.8, 1.2)}) AS BIGINT), 10), 1000) AS batch_size, least(greatest({new.format(delay, 0.8, 1.1)}, 0.1), 10) AS batch_delay"


@query(_FOLD.format(tie="value", start="SELECT id, source_id, rn, " + _sized("100", "CAST(1 AS DOUBLE)"), step="SELECT o.id, o.source_id, o.rn, " + _sized("r.batch_size", "r.batch_delay") + " FROM r JOIN o ON o.source_id = r.source_id AND o.rn = r.rn + 1") + "SELECT id, batch_size, round(batch_delay, 6) AS batch_delay FROM r")
def a21_adaptive_batches(spark, d):
    e = events_as_log(spark, d).select("id", "us", "source_id", "value", (F.col("value") * 10).alias("rate"))
    return metrics.adaptive_batches(e, ["source_id"], ["us"], "value", "rate", 50.0, 100.0).select("id", "batch_size", F.round("batch_delay", 6).alias("batch_delay"))


@query("SELECT c_mktsegment AS type, c_nationkey % 3 AS tenant, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (c_acctbal >= 0) AS BIGINT) AS running FROM customer GROUP BY 1, 2")
def a22_service_counts(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("type"), (F.col("c_nationkey") % 3).alias("tenant")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") >= 0).alias("running"))


@query("""WITH a AS (SELECT c_custkey AS id, c_mktsegment AS m, c_nationkey AS k FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE c_mktsegment END AS m, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_nationkey END AS k FROM customer WHERE c_custkey % 7 <> 0)
 SELECT id, CASE WHEN a.m IS NULL THEN 'added' WHEN b.m IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a.m IS NULL OR b.m IS NULL THEN '' WHEN a.m <> b.m AND a.k <> b.k THEN 'm,k' WHEN a.m <> b.m THEN 'm' ELSE 'k' END AS fields FROM a FULL JOIN b USING (id) WHERE a.m IS NULL OR b.m IS NULL OR a.m <> b.m OR a.k <> b.k""")
def a23_changes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("m"), F.col("c_nationkey").alias("k"))
    after = c.where("id % 7 <> 0").withColumns({"m": F.when(F.col("id") % 3 == 0, "X").otherwise(F.col("m")), "k": F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("k"))})
    return metrics.changes(c.where("id % 5 <> 0"), after, "id", ["m", "k"]).withColumn("fields", F.array_join("fields", ","))


@query(LOG + "SELECT level, event_type, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY ROLLUP (level, event_type)")
def a24_rollup(spark, d):
    return events_as_log(spark, d).rollup("level", "event_type").agg(F.count("*").alias("n"))


# --- windowed algebra ---------------------------------------------------------------------------------------------------------

_SERIES = "SELECT event_type, us, id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY us) % 50 AS DOUBLE) AS c FROM log"


def series(spark, d):
    """A counter per event type that falls back to zero at every fiftieth event (those of one time by id), and the events' values as a gauge."""
    c = F.row_number().over(Window.partitionBy("event_type").orderBy("us", "id")) % 50
    return events_as_log(spark, d).select("event_type", "us", "id", "value", c.cast("double").alias("c"))


@query(LOG + "SELECT id, value FROM log WHERE event_type <> 'view' AND regexp_full_match(source_id, '1.*|2') AND level = 'info'")
def q01_selector(spark, d):
    return promql.selector(events_as_log(spark, d), "labels", equal={"level": "info"}, unequal={"event_type": "view"}, like={"user": "1.*|2"}).select("id", "value")


@query(LOG + f"SELECT event_type, arg_max(value, us) AS value FROM log WHERE us <= {NOW_US} - 86400000000 AND us > {NOW_US} - 86400000000 - 43200000000 GROUP BY 1")
def q01_instant(spark, d):
    return promql.instant(events_as_log(spark, d), ["event_type"], "us", "value", NOW - 86_400 * US, 43_200)


_INC = f"""SELECT id, sum(dd) OVER w - first_value(dd) OVER w AS inc FROM (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN c < p THEN c ELSE c - p END AS dd FROM (SELECT *, lag(c) OVER (PARTITION BY event_type ORDER BY us) AS p FROM ({_SERIES})))
 WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW)"""


@query(LOG + f"SELECT id, round(inc / 21600.0, 9) AS rate FROM ({_INC})")
def q02_rate(spark, d):
    return promql.with_rate(series(spark, d), ["event_type"], "us", "c", 21_600).select("id", F.round("rate", 9).alias("rate"))


@query(LOG + f"SELECT id, CASE WHEN us - pu <= 21600000000 THEN round((CASE WHEN c < p THEN c ELSE c - p END) / ((us - pu) / 1e6), 6) END AS irate FROM (SELECT *, lag(c) OVER w AS p, lag(us) OVER w AS pu FROM ({_SERIES}) WINDOW w AS (PARTITION BY event_type ORDER BY us))")
def q03_irate(spark, d):
    return promql.with_irate(series(spark, d), ["event_type"], "us", "c", 21_600, ties=("id",)).select("id", r6(F.col("irate")).alias("irate"))


@query(LOG + f"SELECT id, inc AS increase FROM ({_INC})")
def q04_increase(spark, d):
    return promql.with_increase(series(spark, d), ["event_type"], "us", "c", 21_600).select("id", "increase")


@query(LOG + f"SELECT id, round(CASE WHEN count(*) OVER w > 1 THEN regr_slope(c, x) OVER w END, 6) AS deriv FROM (SELECT *, (us - min(us) OVER (PARTITION BY event_type)) / 1e6 AS x FROM ({_SERIES})) WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW)")
def q05_deriv(spark, d):
    return promql.with_deriv(series(spark, d), ["event_type"], "us", "c", 43_200).select("id", r6(F.col("deriv")).alias("deriv"))


_CASES = " ".join(f"WHEN b{i} >= r THEN {(0.0 if i == 0 else _BOUNDS[i - 1])} + ({b} - {(0.0 if i == 0 else _BOUNDS[i - 1])}) * (r - {('0' if i == 0 else f'b{i - 1}')}) / (b{i} - {('0' if i == 0 else f'b{i - 1}')})" for i, b in enumerate(_BOUNDS))


@query(LOG + f"SELECT event_type, q, round(CASE {_CASES} ELSE {_BOUNDS[-1]} END, 6) AS quantile FROM (SELECT *, n * q AS r FROM (SELECT event_type, count(*) AS n, " + ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(_BOUNDS)) + " FROM log GROUP BY 1), (SELECT CAST(x AS DOUBLE) AS q FROM (VALUES (0.5), (0.9), (0.99)) AS t(x)))")
def q06_histogram_quantile(spark, d):
    h, out = metrics.histogram(events_as_log(spark, d), ["event_type"], "value", _BOUNDS), None
    for q in (0.5, 0.9, 0.99):
        one = promql.histogram_quantile(h, ["event_type"], "le", "count", q).withColumn("q", F.lit(q))
        out = one if out is None else out.unionByName(one)
    return out.select("event_type", "q", r6(F.col("quantile")).alias("quantile"))


@query(LOG + "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM log GROUP BY 1")
def q07_sum_and_avg_by(spark, d):
    e = events_as_log(spark, d)
    return promql.sum_by(e, ["event_type"], "value").select("event_type", F.round("value", 4).alias("total")).join(promql.avg_by(e, ["event_type"], "value").select("event_type", r6(F.col("value")).alias("mean")), "event_type")





@query(LOG + "SELECT a.day, round(100 * a.n / b.n, 6) AS value FROM (SELECT CAST(floor(us / 86400000000) AS BIGINT) AS day, count(*) AS n FROM log WHERE event_type = 'error' GROUP BY 1) a JOIN (SELECT CAST(floor(us / 86400000000) AS BIGINT) AS day, count(*) AS n FROM log GROUP BY 1) b USING (day) WHERE 100 * a.n / b.n > 19")
def q10_error_percent(spark, d):
    day = F.floor(F.col("us") / (86_400 * US)).alias("day")
    e = events_as_log(spark, d)
    errors, all_ = (x.groupBy(day).agg(F.count("*").alias("value")) for x in (e.where("event_type = 'error'"), e))
    return promql.binary(errors, all_, ["day"], "/").select("day", r6(F.col("value") * 100).alias("value")).where("value > 19")


@query(LOG + """, m AS (SELECT event_type, us, id, value > 10 AS c FROM log), s AS (SELECT *, CASE WHEN c AND NOT coalesce(lag(c) OVER w, false) THEN us END AS st FROM m WINDOW w AS (PARTITION BY event_type ORDER BY us)),
 a AS (SELECT *, CASE WHEN c THEN last_value(st IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) END AS since FROM s) SELECT id, CASE WHEN NOT c THEN 'inactive' WHEN us - since >= 7200000000 THEN 'firing' ELSE 'pending' END AS state FROM a""")
def q12_hold(spark, d):
    e = events_as_log(spark, d).select("event_type", "us", "id", "value")
    return promql.held(e, ["event_type"], "us", F.col("value") > 10, 7200).select("id", "state")


@query(LOG + f"""SELECT event_type, step_us, value FROM (SELECT t.event_type, s.step_us, arg_max(value, us) AS value FROM log t JOIN (SELECT unnest(generate_series({NOW_US} - 864000000000, {NOW_US}, 3600000000)) AS step_us) s ON t.us <= s.step_us AND t.us > s.step_us - 7200000000 GROUP BY 1, 2)""")
def q13_range_evaluation(spark, d):
    return promql.evaluate_at(events_as_log(spark, d), ["event_type"], "us", "value", NOW - 864_000 * US, NOW, 3600, 7200)


@query(LOG + "SELECT id, message FROM log WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def q14_log_stream(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return promql.log_stream(events_as_log(spark, d), {"event_type": "error"}, at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00"), "ts").select("id", "message")


@query(LOG + "SELECT id, message FROM log WHERE event_type = 'view' ORDER BY ts DESC LIMIT 50")
def q15_topic_browse(spark, d):
    return events_as_log(spark, d).where("event_type = 'view'").orderBy(F.desc("ts")).limit(50).select("id", "message")


@query(None)
def q16_all_alert_rules(spark, d):
    """Every rule over metrics made from the events, with the states of each sample counted."""
    e = events_as_log(spark, d).select(F.col("event_type").alias("instance"), "us", "value", F.row_number().over(Window.partitionBy("event_type").orderBy("us")).cast("double").alias("n"))
    names = sorted({r.metric for r in alerts.RULES if r.kind != "quantile"} | {r.other for r in alerts.RULES if r.other})
    plain = e.select("instance", "us", F.lit(None).cast("double").alias("le"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col("n") if m.endswith("_total") else F.col("value") * (i + 1)).alias("value")) for i, m in enumerate(names)))).alias("x")).select("instance", "us", "le", "x.metric", "x.value")
    bounds = (1.0, 5.0, 25.0, float("inf"))
    buckets = e.select("instance", "us", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(b).alias("le"), (F.col("n") * (i + 1)).alias("value")) for m in sorted({r.metric for r in alerts.RULES if r.kind == "quantile"}) for i, b in enumerate(bounds)))).alias("x")).select("instance", "us", "x.le", "x.metric", "x.value")
    out = alerts.evaluate_all(plain.unionByName(buckets), ["instance"])
    return out.groupBy("alert", "severity", "state").agg(F.count("*").alias("n"))


# --- features and anomaly -------------------------------------------------------------------------------------------------------

_W = "regexp_extract_all(message, '[^\\t\\n\\x0B\\f\\r ]+')"
_ENT = "list_sum(list_transform(list_distinct(str_split(message, '')), lambda ch: -(len(list_filter(str_split(message, ''), lambda z: z = ch)) / length(message)) * log2(len(list_filter(str_split(message, ''), lambda z: z = ch)) / length(message))))"


@query(LOG + f"""SELECT id, CAST(strlen(message) AS DOUBLE) AS text_message_length, CAST(len({_W}) AS DOUBLE) AS text_word_count, CAST(length(message) AS DOUBLE) AS text_char_count,
 round(len(regexp_extract_all(message, '\\p{{Nd}}')) / length(message), 6) AS text_digit_ratio, round(len(regexp_extract_all(message, '\\p{{L}}')) / length(message), 6) AS text_letter_ratio, {", ".join(f"CAST(len(regexp_extract_all(message, '{p}')) AS DOUBLE) AS text_pattern_{i}_count" for i, p in enumerate(txt.COUNTED))},
 round(len(regexp_extract_all(message, '[\t\n\x0B\f\r ]')) / length(message), 6) AS text_space_ratio, round(len(regexp_extract_all(message, '[^\\p{{Nd}}\\p{{L}}\t\n\x0B\f\r ]')) / length(message), 6) AS text_special_ratio,
 CAST(len(regexp_extract_all(message, '\\p{{Lu}}')) AS DOUBLE) AS text_uppercase_count, round(len(list_filter(range(1, length(message)), lambda k: message[k] = message[k + 1])) / (length(message) - 1), 6) AS text_repetition_score,
 round({_ENT}, 6) AS text_entropy, CAST(len(list_distinct(list_transform({_W}, lambda x: lower(x)))) AS DOUBLE) AS text_unique_words, round(list_sum(list_transform({_W}, lambda x: strlen(x))) / len({_W}), 6) AS text_avg_word_length,
 CAST(len(regexp_extract_all(message, '\\p{{Ll}}')) AS DOUBLE) AS text_lowercase_count FROM log""")
def e01_text_features(spark, d):
    out = features.with_text(events_as_log(spark, d).select("id", "message"))
    return out.select("id", *(r6(F.col(c)).alias(c) for c in features.feature_names(out)))


@query(LOG + """SELECT id, round(coalesce((us - lag(us) OVER k) / 1e6, 0), 6) AS diff, CAST(hour(ts) AS DOUBLE) AS hour, CAST(dayofweek(ts) AS DOUBLE) AS dow, CAST(day(ts) AS DOUBLE) AS dom, CAST(count(*) OVER (PARTITION BY source_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS DOUBLE) AS per_minute,
 CAST(count(*) OVER (PARTITION BY source_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS DOUBLE) AS per_hour, CAST(row_number() OVER (PARTITION BY source_id, level ORDER BY us) AS DOUBLE) AS level_count,
 CAST(row_number() OVER (PARTITION BY source_id ORDER BY us) AS DOUBLE) AS source_count, CAST(row_number() OVER (PARTITION BY source_id, message ORDER BY us) AS DOUBLE) AS duplicate_count, CAST(month(ts) AS DOUBLE) AS month FROM log WINDOW k AS (PARTITION BY source_id ORDER BY us)""")
def e02_statistical_features(spark, d):
    out = features.with_statistical(events_as_log(spark, d).withColumn("timestamp", F.col("ts")))
    p = "statistical_"
    return out.select("id", r6(F.col(f"{p}time_diff_seconds")).alias("diff"), F.col(f"{p}hour_of_day").alias("hour"), F.col(f"{p}day_of_week").alias("dow"), F.col(f"{p}day_of_month").alias("dom"), F.col(f"{p}events_per_minute").alias("per_minute"), F.col(f"{p}events_per_hour").alias("per_hour"), F.col(f"{p}level_count").alias("level_count"), F.col(f"{p}source_count").alias("source_count"), F.col(f"{p}message_duplicate_count").alias("duplicate_count"), F.col(f"{p}month").alias("month"))


#: Means are taken over whole microseconds, so that they are the same digits in whatever order they are added.
@query(LOG + """, i AS (SELECT id, source_id, ts, us, us - lag(us) OVER (PARTITION BY source_id ORDER BY us) AS d FROM log),
 m AS (SELECT *, count(d) OVER w AS n, sum(d) OVER w AS s1, sum(CAST(d AS HUGEINT) * d) OVER w AS s2, min(d) OVER w AS low, max(d) OVER w AS high, quantile_cont(d, 0.5) OVER w AS mid FROM i WINDOW w AS (PARTITION BY source_id ORDER BY us ROWS 1000 PRECEDING)),
 v AS (SELECT *, s1 / n AS mean, CASE WHEN n > 1 THEN sqrt(greatest(CAST(n * s2 - s1 * s1 AS DOUBLE), 0) / (CAST(n AS DOUBLE) * (n - 1))) ELSE 0 END AS sd FROM m)
 SELECT id, floor(coalesce(d, 0) / CAST(1e6 AS DOUBLE) * 10000) / 10000 AS current_interval, floor(coalesce(mean, 0) / CAST(1e6 AS DOUBLE) * 10000) / 10000 AS avg_interval, floor(sd / CAST(1e6 AS DOUBLE) * 10000) / 10000 AS std_interval, floor(coalesce(low, 0) / CAST(1e6 AS DOUBLE) * 10000) / 10000 AS min_interval, floor(coalesce(high, 0) / CAST(1e6 AS DOUBLE) * 10000) / 10000 AS max_interval, floor(coalesce(mid, 0) / CAST(1e6 AS DOUBLE) * 10000) / 10000 AS median_interval,
 round(CASE WHEN n < 3 THEN 1 WHEN mean = 0 THEN 0 ELSE exp(-sd / mean) END, 6) AS regularity_score, round(sin(hour(ts) * pi() / 12), 6) AS hour_sin, round(cos(hour(ts) * pi() / 12), 6) AS hour_cos, round(sin(dayofweek(ts) * 2 * pi() / 7), 6) AS dow_sin, round(cos(dayofweek(ts) * 2 * pi() / 7), 6) AS dow_cos FROM v""")
def e03_temporal_features(spark, d):
    out = features.with_temporal(events_as_log(spark, d).withColumn("timestamp", F.col("ts")))
    p = "temporal_"
    names = ("current_interval", "avg_interval", "std_interval", "min_interval", "max_interval", "median_interval")
    rest = ("regularity_score", "hour_sin", "hour_cos", "dow_sin", "dow_cos")
    return out.select("id", *((F.floor(F.col(f"{p}{k}") * 10_000) / 10_000).alias(k) for k in names), *(r6(F.col(f"{p}{k}")).alias(k) for k in rest))


def _score_sql(patterns, col="lower(message)"):
    return " + ".join(f"CAST(regexp_matches({col}, '{p}') AS DOUBLE)" for p in patterns)


@query(LOG + f"""SELECT id, {_score_sql(txt.ERRORS)} AS error_score, {_score_sql(txt.WARNINGS)} AS warning_score, {_score_sql(txt.SECURITY)} AS security_score, CAST({" + ".join(f"len(regexp_extract_all(lower(message), '{p}'))" for p in txt.PERFORMANCE)} AS DOUBLE) AS performance_score,
 CAST(len(n) AS DOUBLE) AS numbers, list_max(n) AS max_number, list_min(n) AS min_number, round(list_sum(n) / len(n), 6) AS avg_number, CAST(CASE level WHEN 'error' THEN 5 ELSE 3 END AS DOUBLE) AS severity FROM (SELECT *, list_transform(regexp_extract_all(message, '\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE)) AS n FROM log)""")
def e04_pattern_features(spark, d):
    out = features.with_patterns(events_as_log(spark, d).select("id", "message", "level"))
    p = "pattern_"
    return out.select("id", *(F.col(f"{p}{k}_pattern_score").alias(f"{k}_score") for k in ("error", "warning", "security", "performance")), F.col(f"{p}numeric_value_count").alias("numbers"), F.col(f"{p}max_numeric_value").alias("max_number"), F.col(f"{p}min_numeric_value").alias("min_number"), r6(F.col(f"{p}avg_numeric_value")).alias("avg_number"), F.col(f"{p}level_severity").alias("severity"))


_LONG = "SELECT id, 'value' AS feature, value AS v FROM log UNION ALL SELECT id, 'length', CAST(strlen(message) AS DOUBLE) FROM log"
_MODEL = f"SELECT feature, avg(v) AS mean, stddev_samp(v) AS sd, " + ", ".join(f"quantile_cont(v, {q}) AS {n}" for q, n in zip(metrics.PERCENTILES, anomaly.NAMES)) + f" FROM ({_LONG}) GROUP BY 1"


def _long(spark, d):
    e = events_as_log(spark, d).select("id", "value", F.octet_length("message").cast("double").alias("length"))
    return anomaly.long_form(e, ["id"], ["value", "length"])


@query(LOG + f"SELECT feature, round(mean, 6) AS mean, round(sd, 6) AS sd, " + ", ".join(f"round({n}, 6) AS {n}" for n in anomaly.NAMES) + f" FROM ({_MODEL})")
def m01_train_statistical(spark, d):
    m = anomaly.train_statistical(_long(spark, d))
    return m.select("feature", *(r6(F.col(c)).alias(c) for c in ("mean", "sd", *anomaly.NAMES)))


_VS = "greatest(CASE WHEN abs(v - mean) / sd > 3 THEN 0.95 WHEN abs(v - mean) / sd > 2 THEN 0.8 WHEN abs(v - mean) / sd > 1.5 THEN 0.6 WHEN abs(v - mean) / sd > 1 THEN 0.4 ELSE 0.1 END, CASE WHEN v < p01 OR v > p99 THEN 0.9 WHEN v < p05 OR v > p95 THEN 0.7 WHEN v < p25 OR v > p75 THEN 0.3 ELSE 0.1 END)"
_SCORES = f"SELECT id, CAST(max({_VS}) AS DOUBLE) AS score FROM ({_LONG}) l JOIN ({_MODEL}) m USING (feature) GROUP BY 1"


@query(LOG + f"SELECT id, score FROM ({_SCORES})")
def m02_score_statistical(spark, d):
    long = _long(spark, d)
    return anomaly.score_statistical(long, anomaly.train_statistical(long), ["id"])


@query(None)
def m03_isolation_forest(spark, d):
    e = events_as_log(spark, d).select("id", "us", "value", F.octet_length("message").cast("double").alias("length"))
    names = ["value", "length"]
    forest = anomaly.IsolationForest(seed=7).fit(anomaly.training_sample(e, names, F.col("us")))
    return anomaly.with_model_score(e, forest, names, "score").select("id", F.round("score", 9).alias("score"))


@query(None)
def m04_autoencoder(spark, d):
    e = events_as_log(spark, d).select("id", "us", "value", F.octet_length("message").cast("double").alias("length"))
    names = ["value", "length"]
    model = anomaly.Autoencoder(seed=7).fit(anomaly.training_sample(e, names, F.col("us")))
    return anomaly.with_model_score(e, model, names, "score").select("id", F.round("score", 9).alias("score"))


_TWO_SCORES = "SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE round(value / 500, 6) END AS a, CAST(id % 10 AS DOUBLE) / 10 AS b FROM log"


def two_scores(spark, d):
    return events_as_log(spark, d).select("id", F.when(F.col("id") % 4 != 0, F.round(F.col("value") / 500, 6)).alias("a"), ((F.col("id") % 10) / 10.0).alias("b"))


@query(LOG + f"SELECT id, round(CASE WHEN a IS NULL THEN b ELSE (0.4 * a + 0.3 * b) / 0.7 END, 6) AS weighted, round(CASE WHEN a IS NULL THEN b ELSE (a + b) / 2 END, 6) AS average, CASE WHEN (coalesce(CAST(a > 0.5 AS INT), 0) + CAST(b > 0.5 AS INT)) > (CASE WHEN a IS NULL THEN 0.5 ELSE 1 END) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS majority FROM ({_TWO_SCORES})")
def m05_ensemble(spark, d):
    s = {"isolation": F.col("a"), "statistical": F.col("b")}
    return two_scores(spark, d).select("id", r6(anomaly.combine(s)).alias("weighted"), r6(anomaly.combine(s, how="average")).alias("average"), anomaly.combine(s, how="majority").alias("majority"))


@query(LOG + f"SELECT l.id, CASE WHEN regexp_matches(message, '^error .*k=9') THEN CAST(1 AS DOUBLE) WHEN regexp_matches(message, '^click') THEN CAST(0 AS DOUBLE) ELSE score END AS score FROM ({_SCORES}) s JOIN log l USING (id)")
def m08_lists(spark, d):
    e = events_as_log(spark, d).select("id", "message")
    return e.join(m02_score_statistical(spark, d), "id").select("id", anomaly.listed(F.col("message"), F.col("score"), ["^error .*k=9"], ["^click"]).alias("score"))


@query(LOG + f"SELECT id, round(CASE WHEN a IS NULL THEN 0.5 ELSE 1 - least(abs(a - b) / 2 * 2, 1) END, 6) AS confidence, CASE WHEN b >= 0.9 THEN 'critical' WHEN b >= 0.8 THEN 'high' WHEN b >= 0.6 THEN 'medium' WHEN b >= 0.4 THEN 'low' ELSE 'none' END AS severity FROM ({_TWO_SCORES})")
def m09_confidence_and_severity(spark, d):
    return two_scores(spark, d).select("id", r6(anomaly.confidence([F.col("a"), F.col("b")])).alias("confidence"), anomaly.severity(F.col("b")).alias("severity"))


@query(LOG + f"SELECT severity, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.8 THEN 'high' END AS severity FROM ({_SCORES}) WHERE score > 0.8) GROUP BY 1")
def m11_alerts(spark, d):
    s = m02_score_statistical(spark, d).where(F.col("score") > anomaly.ALERT)
    return s.groupBy(anomaly.severity(F.col("score")).alias("severity")).agg(F.count("*").alias("n"))


@query(None)
def m12_explanations(spark, d):
    e = features.with_patterns(features.with_text(events_as_log(spark, d).select("id", "message", "level")))
    names = features.feature_names(e)
    rows = e.select("id", features.feature_map(e, names).alias("features"), F.lit(0.95).alias("score"))
    out = anomaly.verdict(rows, {"statistical": F.col("score")}, F.col("features"))
    return out.select("id", "reason", "severity", F.array_join("recommendations", "; ").alias("recommendations"))


@query(LOG + """, b AS (SELECT id, ts, source_type, level, value / 100 AS v, length(message) / 100.0 AS n FROM log ORDER BY ts DESC LIMIT 500) SELECT id, list_extract(m, 1) AS s1, list_extract(m, 2) AS s2, list_extract(m, 3) AS s3 FROM (SELECT q.id, list(b.id ORDER BY b.ts DESC, b.id DESC) AS m FROM (SELECT id, source_type, level, value / 100 AS v, length(message) / 100.0 AS n FROM log) q JOIN b ON q.source_type = b.source_type AND q.level = b.level AND q.id <> b.id
 AND (1 - least(abs(q.v - b.v), 1) + 1 - least(abs(q.n - b.n), 1)) / 2 > 0.8 GROUP BY 1)""")
def m14_similar_entries(spark, d):
    e = events_as_log(spark, d).select("id", F.col("ts").alias("timestamp"), "source_type", "level", (F.col("value") / 100).alias("v"), (F.length("message") / 100.0).alias("n"))
    buffer = anomaly.training_buffer(e, "timestamp", size=500)
    out = anomaly.similar(e, buffer, ["v", "n"])
    return out.select("id", *(F.try_element_at("similar", F.lit(i)).alias(f"s{i}") for i in (1, 2, 3)))


@query(LOG + "SELECT id FROM log QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY us DESC) <= 100")
def m15_training_buffer(spark, d):
    return anomaly.training_buffer(events_as_log(spark, d), "us", ["event_type"], 100).select("id")


# --- reliability ----------------------------------------------------------------------------------------------------------------


@query(LOG + "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CASE WHEN ok = 5 THEN 'done' WHEN ok = 0 THEN 'dead_letter' ELSE 'retry' END AS outcome FROM (SELECT event_type, id % 6 AS ok FROM log) GROUP BY 1, 3")
def l02_outcomes(spark, d):
    return events_as_log(spark, d).groupBy("event_type", reliability.outcome(F.col("id") % 6, F.lit(5)).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT CAST(n AS BIGINT) AS n, CASE WHEN n <= 3 THEN CAST(n AS DOUBLE) END AS linear, CAST(least(60.0 * power(2, n - 1), 1800.0) AS DOUBLE) AS exponential FROM (SELECT unnest(generate_series(1, 8)) AS n)")
def l03_delays(spark, d):
    n = F.col("n")
    return spark.range(1, 9).select(F.col("id").alias("n")).select("n", reliability.linear_delay(n).alias("linear"), reliability.exponential_delay(n).alias("exponential"))


@query(LOG + "SELECT 'loki_' || us || '000_' || source_id AS entry_id, 'loki' AS failed_sink, message FROM log WHERE event_type = 'error'")
def l04_dead_letters(spark, d):
    e = events_as_log(spark, d).where("event_type = 'error'").withColumn("timestamp", F.timestamp_micros("us"))
    out = reliability.dead_letters(e, F.col("timestamp"), F.lit("loki"), F.lit("refused"), F.lit("send"))
    return out.select("entry_id", "failed_sink", F.col("original_entry.message").alias("message"))


_DLQ = "SELECT id, us, id % 8 AS attempts, id % 5 <> 0 AS enabled, CASE WHEN id % 3 = 0 THEN us + 3600000000 END AS next_us FROM log WHERE event_type = 'error'"


def dlq(spark, d):
    e = events_as_log(spark, d).where("event_type = 'error'")
    return e.select(F.col("id").alias("entry_id"), F.timestamp_micros("us").alias("timestamp"), (F.col("id") % 8).cast("int").alias("reprocess_attempts"), (F.col("id") % 5 != 0).alias("reprocessing_enabled"), F.when(F.col("id") % 3 == 0, F.timestamp_micros(F.col("us") + 3600 * US)).alias("next_reprocess_time"), F.lit(None).cast("timestamp").alias("last_reprocess_attempt"))


_AT = 1705320000 * US


@query(LOG + f"SELECT id AS entry_id FROM ({_DLQ}) WHERE enabled AND attempts < 6 AND us <= {_AT} - 300000000 AND (next_us IS NULL OR next_us <= {_AT})")
def l05_replay_selection(spark, d):
    return reliability.replay_selection(dlq(spark, d), F.timestamp_micros(F.lit(_AT))).select("entry_id")


@query(LOG + f"SELECT id AS entry_id, attempts + 1 AS attempts, CAST({_AT} + least(60.0 * power(2, attempts), 1800.0) * 1000000 AS BIGINT) AS next_us FROM ({_DLQ}) WHERE id % 4 <> 0")
def l06_after_attempt(spark, d):
    out = reliability.after_attempt(dlq(spark, d), F.col("entry_id") % 4 == 0, F.timestamp_micros(F.lit(_AT)))
    return out.select("entry_id", F.col("reprocess_attempts").cast("bigint").alias("attempts"), F.unix_micros("next_reprocess_time").alias("next_us"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS m FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0 UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 11 = 0 AND c_custkey > 0")
def l07_upsert_and_delete(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("m"))
    kept = reliability.delete(c, c.where("c_custkey % 5 = 0"), "c_custkey")
    changes = c.where("c_custkey % 3 = 0").withColumn("m", F.lit("new")).unionByName(c.where("c_custkey % 11 = 0 AND c_custkey > 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("m")))
    return reliability.upsert(kept, changes, "c_custkey")


@query(LOG + f"SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (us > {_AT} - 60000000) AS BIGINT) AS last_minute, count(*) FILTER (us > {_AT} - 60000000) > 10 AS rate_alert, count(*) > 10000 AS total_alert FROM ({_DLQ})")
def l08_dlq_alerts(spark, d):
    return reliability.dlq_alerts(dlq(spark, d), F.timestamp_micros(F.lit(_AT)))


_SNAPSHOTS = "SELECT source_id, us, row_number() OVER (PARTITION BY source_id ORDER BY us, id) * 40 AS total_entries, id % 1200 AS queue_size, count_if(event_type = 'error') OVER (PARTITION BY source_id ORDER BY us, id) AS write_errors FROM log"


@query(LOG + f"""SELECT source_id, us, type, severity, round(CAST(current AS DOUBLE), 6) AS current FROM (SELECT source_id, us, unnest([
 {{'type': 'high_entry_rate', 'severity': 'warning', 'current': CASE WHEN us > us0 AND (total_entries - total0) / ((us - us0) / 6e7) > 0.1 THEN (total_entries - total0) / ((us - us0) / 6e7) END}},
 {{'type': 'high_total_count', 'severity': 'critical', 'current': CASE WHEN total_entries > 300 THEN CAST(total_entries AS DOUBLE) END}},
 {{'type': 'high_queue_size', 'severity': 'warning', 'current': CASE WHEN queue_size > 1000 THEN CAST(queue_size AS DOUBLE) END}},
 {{'type': 'write_errors', 'severity': 'error', 'current': CASE WHEN errors0 IS NOT NULL AND write_errors > errors0 THEN CAST(write_errors - errors0 AS DOUBLE) END}}], recursive := true)
 FROM (SELECT *, lag(us) OVER w AS us0, lag(total_entries) OVER w AS total0, lag(write_errors) OVER w AS errors0 FROM ({_SNAPSHOTS}) WINDOW w AS (PARTITION BY source_id ORDER BY us, total_entries))) WHERE current IS NOT NULL""")
def l08_dlq_health(spark, d):
    w = Window.partitionBy("source_id").orderBy("us", "id")
    e = events_as_log(spark, d)
    s = e.select("source_id", "us", (F.row_number().over(w) * 40).alias("total_entries"), (F.col("id") % 1200).alias("queue_size"), F.count_if(F.col("event_type") == "error").over(w).alias("write_errors"))
    out = reliability.dlq_health(s, ["source_id"], "us", per_minute=0.1, total=300)
    return out.select("source_id", "us", "type", "severity", r6(F.col("current")).alias("current"))


@query("""WITH RECURSIVE log AS (""" + LOG_SQL + """), o AS (SELECT id, source_id, us, row_number() OVER (PARTITION BY source_id ORDER BY us) AS i FROM log),
 b AS (SELECT id, source_id, us, i, CAST(1.0 AS DOUBLE) AS tokens, true AS allowed FROM o WHERE i = 1 UNION ALL SELECT o.id, o.source_id, o.us, o.i, least(2.0, b.tokens + (o.us - b.us) / 1e6 / 43200.0) - CASE WHEN least(2.0, b.tokens + (o.us - b.us) / 1e6 / 43200.0) >= 1 THEN 1 ELSE 0 END, least(2.0, b.tokens + (o.us - b.us) / 1e6 / 43200.0) >= 1 FROM b JOIN o ON o.source_id = b.source_id AND o.i = b.i + 1) SELECT id, allowed FROM b""")
def l10_token_bucket(spark, d):
    e = events_as_log(spark, d).select("id", "source_id", "us")
    return reliability.token_bucket(e, ["source_id"], "us", 1 / 43_200, 2.0).select("id", "allowed")


_ADAPTED = "least(greatest(CASE WHEN {a} > 24 THEN {r} * CAST(0.9 AS DOUBLE) WHEN {a} < 16 THEN {r} * CAST(1.1 AS DOUBLE) ELSE {r} END, 10), 10000)"


@query(_FOLD.format(tie="value", start="SELECT id, source_id, rn, value AS mean, " + _ADAPTED.format(a="value", r="CAST(1000 AS DOUBLE)") + " AS rps",
 step="SELECT id, source_id, rn, mean, " + _ADAPTED.format(a="mean", r="rps") + " FROM (SELECT o.id, o.source_id, o.rn, CAST(0.1 AS DOUBLE) * o.value + CAST(0.9 AS DOUBLE) * r.mean AS mean, r.rps FROM r JOIN o ON o.source_id = r.source_id AND o.rn = r.rn + 1)") + "SELECT id, round(rps, 6) AS rps FROM r")
def l11_adaptive_rate(spark, d):
    e = events_as_log(spark, d).select("id", "source_id", "us", "value")
    return reliability.adaptive_rate(e, ["source_id"], ["us"], "value", 20.0).select("id", F.round("rps", 6).alias("rps"))


_LOAD = "SELECT id, round(least(value / 100, 1), 4) AS queue, (id % 10) / 10 AS memory, (id % 7) / 7.0 AS cpu, 0.5 AS io, CASE WHEN level = 'error' THEN 1.0 ELSE 0.0 END AS errors FROM log"


@query(LOG + f"SELECT id, round(score, 6) AS score, CASE WHEN score >= 0.95 THEN 'critical' WHEN score >= 0.9 THEN 'high' WHEN score >= 0.75 THEN 'medium' WHEN score >= 0.6 THEN 'low' ELSE 'none' END AS level, CASE WHEN score >= 0.95 THEN 0.2 WHEN score >= 0.9 THEN 0.5 WHEN score >= 0.75 THEN 0.7 WHEN score >= 0.6 THEN 0.9 ELSE 1.0 END::DOUBLE AS factor FROM (SELECT id, round(queue * 0.3 + memory * 0.25 + cpu * 0.2 + io * 0.15 + errors * 0.1, 6) AS score FROM ({_LOAD}))")
def l12_backpressure(spark, d):
    e = events_as_log(spark, d).select("id", F.round(F.least(F.col("value") / 100, F.lit(1)), 4).alias("queue"), ((F.col("id") % 10) / 10).alias("memory"), ((F.col("id") % 7) / 7.0).alias("cpu"), F.lit(0.5).alias("io"), F.when(F.col("level") == "error", 1.0).otherwise(0.0).alias("errors"))
    s = e.select("id", r6(reliability.load_score()).alias("score"))
    level, factor = reliability.backpressure(F.col("score"))
    return s.select("id", "score", level.alias("level"), factor.alias("factor"))


@query("SELECT level, features FROM (VALUES ('none', ''), ('low', 'debug_logging'), ('medium', 'debug_logging,metrics_detail,deduplication'), ('high', 'debug_logging,metrics_detail,deduplication,anomaly_detection,enrichment'), ('critical', 'debug_logging,metrics_detail,deduplication,anomaly_detection,enrichment,processing,compression')) AS t(level, features)")
def l13_degradation(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("none", "low", "medium", "high", "critical")], "level string")
    return rows.select("level", F.array_join(reliability.degraded_features(F.col("level")), ",").alias("features"))


#: Attempts three at most while half open, three failures to open, three successes to close, a day until it is tried, two days half open.
_BREAKER = """SELECT id, source_id, rn, NOT barred AS allowed,
 CASE WHEN barred THEN state WHEN state = 'half_open' THEN CASE WHEN NOT ok THEN 'open' WHEN wins + 1 >= 3 THEN 'closed' ELSE state END WHEN NOT ok AND fails + 1 >= 3 THEN 'open' ELSE state END AS state,
 CASE WHEN barred THEN fails WHEN state = 'half_open' THEN CASE WHEN ok AND wins + 1 >= 3 THEN 0 ELSE fails END WHEN ok THEN greatest(fails - 1, 0) ELSE fails + 1 END AS fails,
 CASE WHEN NOT barred AND state = 'half_open' AND ok THEN wins + 1 ELSE wins END AS wins, CASE WHEN NOT barred AND state = 'half_open' THEN calls + 1 ELSE calls END AS calls,
 CASE WHEN NOT barred AND NOT ok AND (state = 'half_open' OR fails + 1 >= 3) THEN us ELSE since END AS since
 FROM (SELECT *, state = 'open' OR state = 'half_open' AND calls >= 3 AS barred FROM (SELECT * REPLACE (CASE WHEN stuck THEN 'open' ELSE state END AS state, CASE WHEN stuck THEN us ELSE since END AS since) FROM (SELECT *, state = 'half_open' AND us - since >= 172800000000 AS stuck
 FROM (SELECT id, source_id, rn, us, ok, fails, CASE WHEN due THEN 'half_open' ELSE state END AS state, CASE WHEN due THEN 0 ELSE wins END AS wins, CASE WHEN due THEN 0 ELSE calls END AS calls, CASE WHEN due THEN us ELSE since END AS since
 FROM (SELECT *, state = 'open' AND us - since >= 86400000000 AS due FROM ({rows}))))))"""


@query(_FOLD.format(tie="event_type <> 'error'", start="SELECT id, source_id, rn, true AS allowed, 'closed' AS state, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS fails, 0 AS wins, 0 AS calls, CAST(0 AS BIGINT) AS since",
 step=_BREAKER.format(rows="SELECT o.id, o.source_id, o.rn, o.us, o.event_type <> 'error' AS ok, r.state, r.fails, r.wins, r.calls, r.since FROM r JOIN o ON o.source_id = r.source_id AND o.rn = r.rn + 1")) + "SELECT id, allowed, state FROM r")
def l14_circuit_breaker(spark, d):
    e = events_as_log(spark, d).select("id", "source_id", (F.col("us") / US).alias("s"), (F.col("event_type") != "error").alias("ok"))
    return reliability.circuit_breaker(e, ["source_id"], "s", "ok", 3, 86_400.0).select("id", "allowed", "state")


@query(LOG + """SELECT id, coalesce(inode <> lag(inode) OVER w, false) AS rotated, coalesce(size < lag(size) OVER w, false) AND NOT coalesce(inode <> lag(inode) OVER w, false) AS truncated FROM (SELECT id, source_id, us, id // 500 AS inode, CAST(round(value * 100) AS BIGINT) AS size FROM log) WINDOW w AS (PARTITION BY source_id ORDER BY us)""")
def l15_file_changes(spark, d):
    p = events_as_log(spark, d).select("id", F.col("source_id").alias("file_path"), F.col("us").alias("last_read"), F.floor(F.col("id") / 500).alias("inode"), F.lit(1).alias("device"), F.round(F.col("value") * 100).cast("long").alias("size"), F.lit(0).cast("long").alias("offset"))
    return reliability.file_changes(p).select("id", "rotated", "truncated")


@query(LOG + "SELECT id, CASE WHEN id % 3 = 0 THEN us WHEN id % 2 = 0 THEN us - 1 ELSE us - 2 END AS since FROM log")
def l16_container_since(spark, d):
    status = F.when(F.col("id") % 3 == 0, "restarted").otherwise("running")
    return events_as_log(spark, d).select("id", reliability.container_since(status, F.col("us"), F.when(F.col("id") % 2 == 0, F.col("us") - 1), F.col("us") - 2, F.lit(0)).alias("since"))


@query(LOG + f"SELECT id FROM log WHERE event_type IN ('view', 'click') AND us < {_AT} - 604800000000")
def l17_stale_positions(spark, d):
    p = events_as_log(spark, d).select("id", F.timestamp_micros("us").alias("last_read"), F.when(F.col("event_type") == "view", "removed").when(F.col("event_type") == "click", "deleted").otherwise("active").alias("status"))
    return reliability.stale_positions(p, F.timestamp_micros(F.lit(_AT))).select("id")


_FILES = "SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS size, CAST(1000000 + doc_id * 60 AS DOUBLE) AS mod_s FROM documents"


@query(f"""WITH f AS ({_FILES}), r AS (SELECT *, sum(size) OVER w AS b, count(*) OVER w AS n FROM f WHERE mod_s >= 1000600 WINDOW w AS (ORDER BY mod_s DESC, path ROWS UNBOUNDED PRECEDING))
 SELECT path, CASE WHEN b > 500000 THEN 'size' WHEN n > 300 THEN 'count' END AS delete_reason FROM r UNION ALL SELECT path, 'age' FROM f WHERE mod_s < 1000600""")
def l19_retention(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), (F.lit(1_000_000.0) + F.col("doc_id") * 60).alias("mod_s"))
    return reliability.retention(f, F.lit(1_060_600.0), 60_000.0, 500_000, 300).select("path", "delete_reason")


@query(f"SELECT path, sum(size) OVER (PARTITION BY left(path, 1) ORDER BY mod_s ROWS UNBOUNDED PRECEDING) <= 100000 AS admitted FROM ({_FILES})")
def k07_disk_admission(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mod_s")).withColumn("g", F.left("path", F.lit(1)))
    return reliability.admitted(f, ["g"], ["mod_s"], F.col("size"), 100_000).select("path", "admitted")


@query(f"SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY left(path, 1) ORDER BY mod_s DESC) AS r FROM ({_FILES})) WHERE r > 20")
def k06_file_count_retention(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").cast("double").alias("mod_s")).withColumn("g", F.left("path", F.lit(1)))
    return reliability.retention(f, F.lit(0.0), max_files=20, group=["g"]).where("delete_reason = 'count'").select("path")


@query(LOG + f"SELECT source_id AS task, CAST(max(us) AS BIGINT) AS last_us FROM log GROUP BY 1 HAVING max(us) < epoch_us(TIMESTAMP '2024-01-30 00:00:00')")
def l23_stale_tasks(spark, d):
    beats = events_as_log(spark, d).select(F.col("source_id").alias("task"), F.timestamp_micros("us").alias("ts"))
    return reliability.stale_tasks(beats, F.timestamp_micros(F.lit(1706572800 * US)), 0).select("task", F.unix_micros("last").alias("last_us"))


# --- service levels ---------------------------------------------------------------------------------------------------------------

_MEASURES = "SELECT event_type AS slo, CAST(floor(us / 86400000000) AS BIGINT) AS ts, least((count(*) FILTER (value > 5)) / count(*) / 0.9 * 100, 100.0) AS compliance FROM log GROUP BY 1, 2"
_BUDGET = f"SELECT slo, ts, compliance, (100 - compliance) / 100 AS burn, sum((100 - compliance) / 100 * 86400 / 2592000) OVER (PARTITION BY slo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS consumed FROM ({_MEASURES})"


def slo_series(spark, d):
    e = events_as_log(spark, d)
    day = e.groupBy(F.col("event_type").alias("slo"), F.floor(F.col("us") / (86_400 * US)).alias("ts")).agg((F.count_if(F.col("value") > 5) / F.count("*")).alias("value"))
    m = day.withColumns({"target": F.lit(0.9), "window_s": F.lit(2_592_000.0), "interval_s": F.lit(86_400.0), "budget_total": F.lit(0.2)})
    return slo.slo_compliance(m)


@query(LOG + f"SELECT slo, ts, round(compliance, 6) AS compliance FROM ({_MEASURES})")
def l20_slo_compliance(spark, d):
    return slo_series(spark, d).select("slo", "ts", r6(F.col("compliance")).alias("compliance"))


@query(LOG + f"SELECT slo, ts, round(burn, 6) AS burn_rate, round(consumed, 6) AS consumed, round(greatest(0.2 - consumed, 0), 6) AS remaining FROM ({_BUDGET})")
def l21_error_budget(spark, d):
    return slo.error_budget(slo_series(spark, d)).select("slo", "ts", *(r6(F.col(c)).alias(c) for c in ("burn_rate", "consumed", "remaining")))


@query(LOG + f"SELECT slo, ts, CASE WHEN u >= 100 THEN 'breached' WHEN u >= 80 THEN 'critical' WHEN u >= 60 OR compliance < 60 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT *, round(consumed / 0.2 * 100, 6) AS u FROM ({_BUDGET}))")
def l22_slo_status(spark, d):
    b = slo.error_budget(slo_series(spark, d)).withColumn("used", F.round(F.col("consumed") / 0.2 * 100, 6))
    return b.select("slo", "ts", slo.status(F.col("used"), F.lit(100.0), F.col("compliance") < 60).alias("status"))


# --- views of the service's addresses -----------------------------------------------------------------------------------------------


@query(LOG + "SELECT source_type, level, CAST(count(*) AS BIGINT) AS processed, CAST(count(DISTINCT source_id) AS BIGINT) AS sources, CAST(max(us) AS BIGINT) AS last_us FROM log GROUP BY 1, 2")
def view_stats(spark, d):
    return events_as_log(spark, d).groupBy("source_type", "level").agg(F.count("*").alias("processed"), F.countDistinct("source_id").alias("sources"), F.max("us").alias("last_us"))


@query(LOG + f"SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (enabled) AS BIGINT) AS enabled, CAST(max(attempts) AS BIGINT) AS most_attempts FROM ({_DLQ})")
def view_dlq_stats(spark, d):
    return dlq(spark, d).agg(F.count("*").alias("entries"), F.count_if("reprocessing_enabled").alias("enabled"), F.max("reprocess_attempts").cast("bigint").alias("most_attempts"))
