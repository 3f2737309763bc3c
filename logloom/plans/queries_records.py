"""Queries on sources, record steps, routing, sinks, validation and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lab
from ..functions import redact as red
from ..functions import validate as val
from ..operators import dedup, metrics, routing, sinks
from ..sources import containers, files, ingest, stores
from . import pipeline as pipe
from .adapters import LOG_SQL, events_as_log, table
from .registry import query

LOG = f"WITH log AS ({LOG_SQL})\n"
#: The moment that times are compared with.
REFERENCE = "2024-01-15 12:00:00"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- sources ------------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, url AS path FROM pages WHERE regexp_matches(url, '[^/]*\\.html$') AND NOT regexp_matches(url, '/[0-9]*5[0-9]*\\.html$') AND NOT starts_with(url, 'http://')""")
def s02_discovery(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return p.where(files.wanted(F.col("path"), ("*.html",), ("*5*",), ("http:/",)))


@query("""SELECT page_id, url AS path FROM pages WHERE NOT contains(url, 'example.com/')""")
def s03_pipeline_discovery(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return p.where(files.wanted(F.col("path"), exclude_dirs=("example.com",), infix=True))


@query(LOG + """SELECT '{"event_type":"' || event_type || '","instance":"10.0.0.1","instance_name":"node","level":"' || level || '","service":"logloom","source":"file"}' AS stream, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1""")
def s05_file_labels(spark, d):
    e = events_as_log(spark, d).withColumn("labels", lab.put(lab.remove(F.col("labels"), "user"), {"project": F.lit("x"), "com.docker.compose.version": F.lit("2")}))
    std = lab.standard(F.col("labels"), "file", F.lit("10.0.0.1"), F.lit("node"))
    return e.groupBy(lab.stream_key(std).alias("stream")).agg(F.count("*").alias("n"))


@query(LOG + "SELECT id, message FROM log")
def s06_container_lines(spark, d):
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z  "), F.col("message"), F.lit("  "))
    return events_as_log(spark, d).select("id", containers.clean_line(raw).alias("message"))


@query("""SELECT c_custkey FROM customer WHERE NOT contains(c_name, '7') AND c_mktsegment <> 'BUILDING' AND (contains(c_name, '1') OR contains(c_name, '2'))""")
def s07_container_predicate(spark, d):
    c = table(spark, d, "customer")
    labels = F.create_map(F.lit("segment"), F.col("c_mktsegment"))
    return c.where(containers.followed(F.col("c_name"), labels, ("1", "2"), ("7",), ("segment",), ("segment=BUILDING",))).select("c_custkey")


_ACTION = "CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'unpause' WHEN 'purchase' THEN 'pause' WHEN 'signup' THEN 'die' ELSE 'other' END"
_STATE = f"CASE {_ACTION} WHEN 'start' THEN 'running' WHEN 'unpause' THEN 'running' WHEN 'pause' THEN 'paused' WHEN 'die' THEN 'stopped' END"


@query(LOG + f"SELECT source_id AS container, arg_max({_STATE}, us) AS state, CAST(max(us) AS BIGINT) AS since FROM log WHERE event_type <> 'error' GROUP BY 1")
def s08_container_states(spark, d):
    e = events_as_log(spark, d).select(F.col("source_id").alias("container"), F.expr(_ACTION).alias("action"), "us")
    return containers.states(e, "container", "action", "us")


@query(LOG + """SELECT '{"event_type":"' || event_type || '","instance":"10.0.0.2","instance_name":"c","level":"' || level || '","service":"logloom","source":"docker"}' AS stream, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1""")
def s09_container_labels(spark, d):
    std = containers.container_labels(lab.remove(F.col("labels"), "user"), F.lit("10.0.0.2"), F.lit("c"))
    return events_as_log(spark, d).groupBy(lab.stream_key(std).alias("stream")).agg(F.count("*").alias("n"))


@query(LOG + """SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN '' ELSE message END AS message, CASE WHEN id % 3 = 0 OR id % 7 = 0 THEN 'info' ELSE level END AS level, CASE WHEN id % 7 = 0 THEN 'api' ELSE 'events' END AS source_type,
 CASE WHEN id % 7 = 0 THEN 'http-ingest' ELSE source_id END AS source_id, 'http_api' AS via, CASE WHEN id % 7 = 0 THEN 'invalid_json' WHEN id % 11 = 0 THEN 'missing_message' END AS reject_reason FROM log""")
def s10_http_ingest(spark, d):
    e = events_as_log(spark, d)
    body = F.to_json(F.struct(F.when(F.col("id") % 11 == 0, "").otherwise(F.col("message")).alias("message"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("level")).alias("level"), "source_type", "source_id", "labels"))
    posted = e.select("id", F.when(F.col("id") % 7 == 0, F.lit("{broken")).otherwise(body).alias("value"))
    out = ingest.parse_requests(posted)
    return out.select("id", "message", "level", "source_type", "source_id", F.col("labels")["ingested_via"].alias("via"), "reject_reason")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'docker' AS type, CASE WHEN c_acctbal < 0 THEN 'stopped' ELSE 'running' END AS status, lower(c_mktsegment) AS pipeline, CAST(c_nationkey AS VARCHAR) AS tenant FROM customer WHERE c_custkey % 2 = 0""")
def s11_services(spark, d):
    c = table(spark, d, "customer")
    labels = F.create_map(F.lit("log.enabled"), F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false"), F.lit("log.pipeline"), F.lower("c_mktsegment"), F.lit("log.tenant"), F.col("c_nationkey").cast("string"))
    rows = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 0, "stopped").otherwise("running").alias("status"), labels.alias("labels"))
    return stores.services_from_labels(rows).select("id", "name", "type", "status", "pipeline", "tenant")


# --- steps ----------------------------------------------------------------------------------------------------------------

_MYSQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z  ' || id || ' [' || CASE WHEN level = 'error' THEN 'Error' WHEN id % 2 = 0 THEN 'Note' ELSE 'Debug' END || '] ' || message"


def mysql_lines(spark, d):
    e = events_as_log(spark, d)
    kind = F.when(F.col("level") == "error", "Error").when(F.col("id") % 2 == 0, "Note").otherwise("Debug")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z  "), F.col("id").cast("string"), F.lit(" ["), kind, F.lit("] "), F.col("message"))
    return e.select("id", line.alias("message"), F.lit(None).cast("map<string,string>").alias("labels"), F.lit(None).cast("timestamp").alias("timestamp"), "source_type")


def _run(df, steps, mode=None):
    p, _ = pipe.load(__import__("yaml").safe_dump({"pipelines": [{"name": "x", "steps": steps}]}))
    return pipe.apply(df, p["x"], mode or pipe.Mode())


_PATTERN = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+\d+\s+\[(Note|Warning|Error)\]\s+(.+)"


@query(LOG + f"""SELECT id, nullif(regexp_extract(line, '{_PATTERN}', 2), '') AS level, nullif(regexp_extract(line, '{_PATTERN}', 3), '') AS msg FROM (SELECT id, {_MYSQL} AS line FROM log)""")
def p01_regex_extract(spark, d):
    out = _run(mysql_lines(spark, d), [{"type": "regex_extract", "config": {"pattern": _PATTERN, "fields": ["_temp_time", "level", "msg"]}}])
    return out.select("id", F.col("labels")["level"].alias("level"), F.col("labels")["msg"].alias("msg"))


@query(LOG + f"""SELECT id, CASE WHEN regexp_matches(line, '{_PATTERN}') THEN us END AS parsed_us FROM (SELECT id, us, {_MYSQL} AS line FROM log)""")
def p02_timestamp_parse(spark, d):
    steps = [{"type": "regex_extract", "config": {"pattern": _PATTERN, "fields": ["_temp_time", "level", "msg"]}}, {"type": "timestamp_parse", "config": {"field": "_temp_time", "format": "2006-01-02T15:04:05.000000Z", "timezone": "UTC"}}]
    out = _run(mysql_lines(spark, d), steps)
    # the layout has no zone: the session's own is taken out again
    return out.select("id", F.unix_micros(F.to_utc_timestamp("timestamp", "UTC")).alias("parsed_us"))


@query(LOG + """SELECT id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM log""")
def p03_detect_timestamp(spark, d):
    e = events_as_log(spark, d)
    seconds = F.floor(F.col("us") / 1_000_000).cast("string")
    text = F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_type") == "view", seconds).when(F.col("event_type") == "error", F.concat(seconds, F.lit("000"))).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    from ..functions.layouts import detect

    return e.select("id", "event_type", F.unix_seconds(detect(text)).alias("seconds"))


@query(LOG + "SELECT id, event_type AS kind, source_id AS user_label, json_extract_string(j, '$.nested') AS nested FROM (SELECT *, '{\"nested\":{\"v\":1}}' AS j FROM log)")
def p05_json_parse(spark, d):
    e = events_as_log(spark, d)
    line = F.concat(F.lit('{"kind":"'), F.col("event_type"), F.lit('","user":"no","nested":{"v":1}}'))
    out = _run(e.select("id", "source_id", line.alias("message"), "labels", F.col("ts").cast("timestamp").alias("timestamp")), [{"type": "json_parse"}])
    return out.select("id", F.col("labels")["kind"].alias("kind"), F.col("labels")["user"].alias("user_label"), F.col("labels")["nested"].alias("nested"))


@query(LOG + """SELECT id, 'svc' AS service, message AS msg, event_type || '/' || source_id AS tag, '{{message}}' AS kept FROM log""")
def p06_field_add(spark, d):
    e = events_as_log(spark, d).withColumn("timestamp", F.col("ts").cast("timestamp"))
    out = _run(e, [{"type": "field_add", "config": {"fields": {"service": "svc", "msg": "{{message}}", "tag": "{{event_type}}/{{user}}"}}}])
    out = _run(out, [{"type": "field_add", "config": {"fields": {"kept": "{{message}}"}}}], pipe.Mode(literal=True))
    return out.select("id", *(F.col("labels")[x].alias(x) for x in ("service", "msg", "tag", "kept")))


@query(LOG + """SELECT '{"event_type":"' || event_type || '"}' AS stream, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1""")
def p07_field_remove(spark, d):
    e = events_as_log(spark, d).withColumn("timestamp", F.col("ts").cast("timestamp"))
    out = _run(e, [{"type": "field_remove", "config": {"fields": ["level", "user", "absent"]}}])
    return out.groupBy(lab.stream_key(F.col("labels")).alias("stream")).agg(F.count("*").alias("n"))


@query(LOG + """SELECT id, lower(nullif(regexp_extract(message, '(?i)\\b(trace|debug|info|warn|warning|error|fatal|crit|critical)\\b', 1), '')) AS found FROM log""")
def p08_level_extract(spark, d):
    e = events_as_log(spark, d).withColumn("timestamp", F.col("ts").cast("timestamp"))
    out = _run(e, [{"type": "log_level_extract", "config": {"pattern": r"(?i)\b(trace|debug|info|warn|warning|error|fatal|crit|critical)\b", "field": "found"}}])
    return out.select("id", F.col("labels")["found"].alias("found"))


@query(LOG + """SELECT id, CASE WHEN regexp_matches(message, '^(view|error) .*k=[1-4]') THEN 'yes' END AS flag FROM log""")
def p09_condition(spark, d):
    e = events_as_log(spark, d).withColumn("timestamp", F.col("ts").cast("timestamp"))
    out = _run(e, [{"type": "field_add", "condition": "^(view|error) .*k=[1-4]", "config": {"fields": {"flag": "yes"}}}])
    return out.select("id", F.col("labels")["flag"].alias("flag"))


@query(LOG + """SELECT CASE WHEN source_id = '1' OR contains(source_id, '12') THEN 'first' WHEN contains(event_type, 'view') THEN 'second' ELSE 'default' END AS pipeline, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1""")
def p10_routing(spark, d):
    mapping = {"first": ["user:12", "absent:x"], "second": ["event_type:view", "mysql"]}
    e = events_as_log(spark, d)
    to = F.when(F.col("source_id") == "1", "first").otherwise(pipe.route(F.col("source_type"), F.col("labels"), mapping))
    return e.groupBy(to.alias("pipeline")).agg(F.count("*").alias("n"))


@query(LOG + f"""SELECT pipeline, service, level, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN id % 3 = 0 THEN 'mysql' ELSE 'default' END AS pipeline, CASE WHEN id % 3 = 0 THEN 'mysql' ELSE 'log-capture' END AS service,
 CASE WHEN id % 3 = 0 THEN 'info' ELSE lower(nullif(regexp_extract(line, '(?i)\\b(trace|debug|info|warn|warning|error|fatal)\\b', 1), '')) END AS level FROM (SELECT id, {_MYSQL} AS line FROM log)) GROUP BY 1, 2, 3""")
def p12_routed_pipelines(spark, d):
    text = r"""
pipelines:
  - name: default
    steps:
      - {type: log_level_extract, config: {pattern: '(?i)\b(trace|debug|info|warn|warning|error|fatal)\b'}}
      - {type: field_add, config: {fields: {msg: '{{message}}'}}}
      - {type: field_add, config: {fields: {service: log-capture}}}
  - name: mysql
    steps:
      - {type: regex_extract, config: {pattern: '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\s+\d+\s+\[(Note|Warning|Error)\]', fields: [level]}}
      - {type: field_add, config: {fields: {level: info}}}
      - {type: field_add, config: {fields: {service: mysql}}}
source_mapping:
  mysql: ['container_name:mysql', mysql]
"""
    pipelines, mapping = pipe.load(text)
    e = mysql_lines(spark, d).withColumn("labels", F.when(F.col("id") % 3 == 0, F.create_map(F.lit("container_name"), F.lit("mysql-1"))).otherwise(F.create_map().cast("map<string,string>")))
    out = pipe.apply_routed(e, pipelines, mapping)
    return out.groupBy("pipeline", F.col("labels")["service"].alias("service"), F.col("labels")["level"].alias("level")).agg(F.count("*").alias("n"))


# --- routing and sinks ----------------------------------------------------------------------------------------------------

_ROUTED = "CASE WHEN level = 'error' THEN 'logs-high-priority' WHEN event_type = 'view' THEN 'views' ELSE 'logs' END"


@query(LOG + f"SELECT {_ROUTED} AS topic, level, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1, 2")
def k14_topics(spark, d):
    e = events_as_log(spark, d).withColumn("labels", F.when(F.col("event_type") == "view", lab.put(F.col("labels"), {"kafka_topic": F.lit("views")})).otherwise(F.col("labels")))
    return e.groupBy(routing.topic(F.col("labels")).alias("topic"), "level").agg(F.count("*").alias("n"))


@query(LOG + """SELECT id, CASE WHEN event_type = 'purchase' AND source_id LIKE '1%' THEN 'vip' WHEN event_type IN ('purchase', 'signup') THEN 'business' ELSE 'logs' END AS topic FROM log""")
def k15_rule_topics(spark, d):
    rules = [{"topic": "business", "priority": 1, "match": {"event_type": "^(purchase|signup)$"}}, {"topic": "vip", "priority": 5, "match": {"event_type": "^purchase$", "user": "^1"}}]
    return events_as_log(spark, d).select("id", routing.rule_topic(F.col("labels"), rules, "logs").alias("topic"))


@query(LOG + "SELECT id, CASE WHEN id % 2 = 0 THEN event_type ELSE source_id END AS key FROM log")
def k16_partition_keys(spark, d):
    e = events_as_log(spark, d)
    labels = F.when(F.col("id") % 2 == 0, lab.put(F.col("labels"), {"tenant": F.col("event_type")})).otherwise(F.col("labels"))
    return e.select("id", routing.partition_key(labels, F.col("source_id")).alias("key"))


@query(LOG + """SELECT strftime(ts, '%Y-%m-%d') || '_' || strftime(ts, '%H') || '_' || CASE WHEN id % 2 = 0 THEN 'a_b' ELSE 'unknown-container' END || '_' || CASE WHEN id % 2 = 0 THEN 'unknown-file' ELSE 'x_y.' || event_type END || '.log' AS name, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1""")
def k02_file_names(spark, d):
    e = events_as_log(spark, d)
    kind = F.when(F.col("id") % 2 == 0, "docker").otherwise("file")
    labels = lab.put(F.col("labels"), {"container_name": F.lit("a/b"), "file_path": F.concat(F.lit("/var/log/x y."), F.col("event_type"), F.lit(".log"))})
    name = routing.file_name("{date}_{hour}_{container}_{file}.log", F.col("ts"), kind, labels)
    return e.groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query(LOG + """SELECT id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","message":"' || message || '","source_type":"events","source_id":"' || source_id || '"' || CASE WHEN id % 2 = 0 THEN '' ELSE ',"labels":{"level":"' || level || '"}' END || '}' AS line FROM log""")
def k03_json_lines(spark, d):
    e = events_as_log(spark, d).withColumn("timestamp", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))
    e = e.withColumn("labels", F.when(F.col("id") % 2 == 0, F.create_map().cast("map<string,string>")).otherwise(F.map_filter("labels", lambda k, _: k == "level")))
    return e.select("id", sinks.json_line(e).alias("line"))


@query(LOG + """SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | [EVENTS:' || source_id || '] | {level=' || level || '} | ' || message AS line FROM log""")
def k04_text_lines(spark, d):
    e = events_as_log(spark, d)
    return e.select("id", sinks.text_line(F.col("ts"), F.col("source_type"), F.col("source_id"), F.col("labels"), F.col("message")).alias("line"))


@query(LOG + """SELECT stream_key, ns, line, CAST(count(*) AS BIGINT) AS entries FROM (SELECT CAST(us * 1000 AS VARCHAR) AS ns, message AS line, '{"event_type":"' || event_type || '","job":"j","level":"' || level || '","service":"logloom"}' AS stream_key FROM log) GROUP BY ALL""")
def k08_stream_batches(spark, d):
    e = events_as_log(spark, d).withColumn("timestamp", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")).withColumn("labels", lab.remove(F.col("labels"), "user"))
    entries = sinks.loki_streams(e, {"job": "j"}).select("stream_key", F.explode("values").alias("v"))
    return entries.groupBy("stream_key", F.col("v")[0].alias("ns"), F.col("v")[1].alias("line")).agg(F.count("*").alias("entries"))


@query(LOG + """SELECT id, '{"event_type":"' || event_type || '","level":"' || level || '","user":"' || "user" || '"}' AS stream_key FROM log""")
def k09_stream_keys(spark, d):
    return events_as_log(spark, d).select("id", lab.stream_key(F.col("labels")).alias("stream_key"))


@query(LOG + """SELECT '{"a_b":"' || event_type || '","env":"prod","label_9x":"1","level":"' || level || '","service":"logloom"}' AS stream_key, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1""")
def k10_stream_labels(spark, d):
    e = events_as_log(spark, d)
    labels = F.create_map(F.lit("a-b"), F.col("event_type"), F.lit("9x"), F.lit("1"), F.lit("level"), F.col("level"), F.lit("trace_id"), F.col("source_id"), F.lit("_temp_x"), F.lit("y"))
    return e.groupBy(lab.stream_key(lab.stream_labels(labels, {"env": "prod"})).alias("stream_key")).agg(F.count("*").alias("n"))


_STATUS = "CASE id % 6 WHEN 0 THEN 204 WHEN 1 THEN 400 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 404 ELSE 400 END"
_BODY = "CASE id % 6 WHEN 1 THEN 'entry has timestamp too old' WHEN 5 THEN 'bad labels' ELSE event_type END"


@query(LOG + f"""SELECT class, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN s < 300 THEN 'ok' WHEN s = 400 AND contains(b, 'timestamp') THEN 'data_error' WHEN s IN (429, 503) THEN 'retryable' ELSE 'permanent' END AS class FROM (SELECT {_STATUS} AS s, {_BODY} AS b FROM log)) GROUP BY 1""")
def k11_error_classes(spark, d):
    e = events_as_log(spark, d)
    return e.groupBy(routing.error_class(F.expr(_STATUS), F.expr(_BODY)).alias("class")).agg(F.count("*").alias("n"))


@query(LOG + """SELECT id, CASE WHEN u > 95 THEN 'loki_queue_full' WHEN u > 90 AND w <= 1 OR u > 75 AND u <= 90 AND w <= 3 OR u <= 75 AND w <= 10 THEN 'sent' ELSE 'loki_timeout' END AS admission FROM (SELECT id, id % 101 AS u, CASE WHEN id % 7 > 0 THEN id % 13 END AS w FROM log)""")
def k12_push_admission(spark, d):
    wait = F.when(F.col("id") % 7 > 0, F.col("id") % 13)
    return events_as_log(spark, d).select("id", routing.push_admission((F.col("id") % 101) / 100, wait).alias("admission"))


@query(LOG + f"""SELECT {_ROUTED} AS topic, source_id AS key, message, source_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS at, level FROM log""")
def k13_kafka_records(spark, d):
    e = events_as_log(spark, d).withColumn("timestamp", F.col("ts").cast("timestamp"))
    e = e.withColumn("labels", F.when(F.col("event_type") == "view", lab.put(F.col("labels"), {"kafka_topic": F.lit("views")})).otherwise(F.col("labels")))
    out = sinks.kafka_records(e, routing.topic(F.col("labels")), routing.partition_key(F.col("labels"), F.col("source_id")))
    return out.select("topic", "key", *(F.get_json_object("value", f"$.{x}").alias(y) for x, y in (("message", "message"), ("source_id", "source_id"), ("timestamp", "at"), ("labels.level", "level"))))


@query(LOG + """SELECT 'logs-' || strftime(ts, '%Y.%m.%d') || '-' || strftime(ts, '%H') AS "index", 'dflt' AS env, level, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1, 3""")
def k18_elastic_documents(spark, d):
    e = events_as_log(spark, d).withColumn("timestamp", F.col("ts").cast("timestamp"))
    docs = sinks.elastic_documents(e, routing.index_name("logs-{date}-{hour}", F.col("ts")), {"env": "dflt", "level": "none"})
    return docs.groupBy("index", F.get_json_object("document", "$.labels.env").alias("env"), F.get_json_object("document", "$.labels.level").alias("level")).agg(F.count("*").alias("n"))


@query(LOG + """SELECT id, round(us / 1e6, 3) AS time, CASE WHEN id % 2 = 0 THEN 'h' || source_id ELSE 'default' END AS host, 'main' AS "index", message FROM log""")
def k20_splunk_events(spark, d):
    e = events_as_log(spark, d).withColumn("timestamp", F.timestamp_micros("us"))
    e = e.withColumn("labels", F.when(F.col("id") % 2 == 0, lab.put(F.col("labels"), {"host": F.concat(F.lit("h"), F.col("source_id"))})).otherwise(F.col("labels")))
    out = sinks.splunk_events(e.withColumn("level", F.col("id").cast("string")), "default", "src", "st", "main")
    return out.select(F.get_json_object("event", "$.level").cast("bigint").alias("id"), F.round("time", 3).alias("time"), "host", "index", F.get_json_object("event", "$.message").alias("message"))


@query(LOG + """SELECT id, CASE WHEN sum(octet_length(encode(message))) OVER (PARTITION BY source_id) > 1500 THEN ntile(2) OVER (PARTITION BY source_id ORDER BY id) ELSE 0 END AS half FROM log""")
def k21_batch_halves(spark, d):
    e = events_as_log(spark, d)
    return sinks.halves(e, F.col("source_id"), ["id"], F.octet_length("message"), 1500).select("id", F.col("half").cast("bigint").alias("half"))


@query(LOG + f"SELECT id, ({_STATUS}) IN (429, 503) OR event_type = 'click' AS retryable FROM log")
def k22_retryable(spark, d):
    e = events_as_log(spark, d)
    return e.select("id", routing.retryable(F.expr(_STATUS), F.when(F.col("event_type") == "click", "Connection reset").otherwise(F.col("event_type"))).alias("retryable"))


@query("""SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN 'none' WHEN strlen(text) < 4096 THEN 'lz4' WHEN strlen(text) < 65536 THEN 'gzip' WHEN strlen(text) < 1048576 THEN 'zstd' ELSE 'lz4' END AS codec FROM documents""")
def k23_codecs(spark, d):
    return table(spark, d, "documents").select("doc_id", routing.codec(F.octet_length("text")).alias("codec"))


# --- validation -------------------------------------------------------------------------------------------------------------

_FUTURE, _PAST = f"ts > TIMESTAMP '{REFERENCE}' + INTERVAL 60 SECOND", f"ts < TIMESTAMP '{REFERENCE}' - INTERVAL 6 HOUR"


@query(LOG + f"SELECT id, CASE WHEN {_FUTURE} THEN 'timestamp_too_far_future' WHEN {_PAST} THEN 'timestamp_too_old' END AS reason FROM log")
def v01_timestamp_window(spark, d):
    r = val.timestamp_result(F.col("ts"), ntz(REFERENCE))
    return events_as_log(spark, d).select("id", r["reason"].alias("reason"))


_ACTIONS = (("clamp", True), ("clamp", False), ("reject", True), ("warn", True), ("odd", True))
_DONE = {0: "clamped", 1: "rejected", 2: "rejected", 3: "warned", 4: "clamped"}


@query(LOG + " UNION ALL ".join(f"SELECT {i} AS mode, CASE WHEN bad THEN '{w}' ELSE 'valid' END AS action, (NOT bad) OR {str(w != 'rejected').lower()} AS valid, CAST(count(*) AS BIGINT) AS n FROM (SELECT ({_FUTURE}) OR ({_PAST}) AS bad FROM log) GROUP BY 1, 2, 3" for i, w in _DONE.items()))
def v02_invalid_actions(spark, d):
    e, out = events_as_log(spark, d), None
    for i, (action, clamp) in enumerate(_ACTIONS):
        r = val.timestamp_result(F.col("ts"), ntz(REFERENCE), action=action, clamp=clamp)
        one = e.select(F.lit(i).alias("mode"), r["action"].alias("action"), r["valid"].alias("valid"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("mode", "action", "valid").agg(F.count("*").alias("n"))


@query(LOG + """SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS seconds, CASE WHEN id % 3 = 2 THEN 'timestamp_parse_failed' END AS failed FROM log""")
def v04_parse_and_validate(spark, d):
    text = F.when(F.col("id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("id") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).otherwise("yesterday")
    r = val.parse_and_validate(text, F.lit("2024-01-15 12:00:00").cast("timestamp"), past_s=10**8, future_s=10**8)
    return events_as_log(spark, d).select("id", F.unix_seconds(r["original_time"]).alias("seconds"), r["reason"].alias("failed"))


@query(LOG + f"SELECT CAST(count(*) AS BIGINT) AS n FROM log WHERE ts > TIMESTAMP '{REFERENCE}' - INTERVAL 6 HOUR AND ts < TIMESTAMP '{REFERENCE}' + INTERVAL 60 SECOND")
def v05_in_window(spark, d):
    return events_as_log(spark, d).where(val.in_window(F.col("ts"), ntz(REFERENCE))).agg(F.count("*").alias("n"))


@query(LOG + f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER ({_FUTURE}) AS BIGINT) AS future, CAST(count(*) FILTER ({_PAST}) AS BIGINT) AS past, round(count(*) FILTER (NOT (({_FUTURE}) OR ({_PAST}))) / count(*), 6) AS valid_rate FROM log""")
def v06_validation_stats(spark, d):
    r = events_as_log(spark, d).select(val.timestamp_result(F.col("ts"), ntz(REFERENCE))["reason"].alias("reason"))
    return r.agg(F.count("*").alias("total"), F.count_if(F.col("reason") == "timestamp_too_far_future").alias("future"), F.count_if(F.col("reason") == "timestamp_too_old").alias("past"), F.round(F.count_if(F.col("reason").isNull()) / F.count("*"), 6).alias("valid_rate"))


@query(LOG + f"SELECT id, CASE WHEN ts < TIMESTAMP '{REFERENCE}' - INTERVAL 24 HOUR THEN epoch_us(TIMESTAMP '{REFERENCE}') ELSE us END AS us FROM log")
def v07_late_clamp(spark, d):
    from .adapters import micros

    return events_as_log(spark, d).select("id", micros(val.clamp_late(F.col("ts"), ntz(REFERENCE))).alias("us"))


_BLOCKED_SQL = r"'\.\.|/etc/|/proc/|/sys/|/dev/|/root/|\$\{|`|\||;|&'"


@query(f"""SELECT page_id, CASE WHEN contains(p, '..') THEN 'traversal' WHEN NOT starts_with(p, '/') THEN 'not_absolute' WHEN regexp_matches(p, {_BLOCKED_SQL}) THEN 'blocked_pattern' WHEN NOT regexp_matches(p, '^[a-zA-Z0-9\\-_./]*$') THEN 'invalid_characters' END AS error
 FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?:/', '') WHEN 1 THEN '/etc/' || page_id WHEN 2 THEN '/a/../b' ELSE url END AS p FROM pages)""")
def v08_paths(spark, d):
    i = F.col("page_id") % 4
    p = F.when(i == 0, F.regexp_replace("url", "^https?:/", "")).when(i == 1, F.concat(F.lit("/etc/"), F.col("page_id").cast("string"))).when(i == 2, "/a/../b").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", val.path_error(p).alias("error"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'private_host' WHEN 2 THEN 'unsupported_scheme' WHEN 3 THEN 'private_host' END AS error FROM pages""")
def v09_urls(spark, d):
    i = F.col("page_id") % 4
    u = F.when(i == 0, F.col("url")).when(i == 1, "http://192.168.3.4:80/x").when(i == 2, "ftp://example.org/").otherwise("https://localhost:8443/")
    return table(spark, d, "pages").select("page_id", val.url_error(u).alias("error"))


@query(f"""SELECT doc_id, CASE WHEN strlen(text) > 65536 THEN 'too_long' WHEN regexp_matches(text, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]') THEN 'control_characters' WHEN regexp_matches(text, {_BLOCKED_SQL}) THEN 'blocked_pattern' END AS error FROM documents""")
def v10_strings(spark, d):
    return table(spark, d, "documents").select("doc_id", val.string_error(F.col("text")).alias("error"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'injection' END AS error FROM pages""")
def v11_messages(spark, d):
    m = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x <SCRIPT y "), F.col("page_id").cast("string"))).otherwise(F.lit("plain"))
    return table(spark, d, "pages").select("page_id", val.message_error(m).alias("error"))


@query("""SELECT c_custkey, regexp_matches(k, '^[a-zA-Z][a-zA-Z0-9_]*$') AND length(k) <= 63 AS ok FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'k' || c_custkey ELSE '9k' END AS k FROM customer)""")
def v12_labels(spark, d):
    i = F.col("c_custkey") % 3
    k = F.when(i == 0, F.col("c_name")).when(i == 1, F.concat(F.lit("k"), F.col("c_custkey").cast("string"))).otherwise("9k")
    return table(spark, d, "customer").select("c_custkey", val.labels_ok(F.create_map(k, F.lit("v"))).alias("ok"))


@query("""SELECT doc_id, CASE WHEN strlen(r) > 1000 THEN substr(r, 1, 997) || '...' ELSE r END AS safe FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '(?i)password["\\s]*[:=]["\\s]*[^"\\s,}]+', '[REDACTED]', 'g'), '(?i)token["\\s]*[:=]["\\s]*[^"\\s,}]+', '[REDACTED]', 'g'), '(?i)secret["\\s]*[:=]["\\s]*[^"\\s,}]+', '[REDACTED]', 'g'), '(?i)key["\\s]*[:=]["\\s]*[^"\\s,}]+', '[REDACTED]', 'g'), '(?i)authorization["\\s]*:["\\s]*[^"\\s,}]+', '[REDACTED]', 'g') AS r FROM documents)""")
def v13_safe_text(spark, d):
    return table(spark, d, "documents").select("doc_id", val.safe_for_log(F.col("text")).alias("safe"))


@query(LOG + """SELECT CASE WHEN source_id = '7' OR contains(source_id, '7') THEN 'self_source_id' WHEN event_type = 'signup' THEN 'container_pattern_match' WHEN regexp_matches(message, 'k=99$') THEN 'message_pattern_match' END AS reason, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1""")
def v14_feedback_guard(spark, d):
    e = events_as_log(spark, d)
    labels = lab.put(F.col("labels"), {"container": F.concat(F.lit("svc-"), F.col("event_type"))})
    r = val.guard_result(F.col("source_id"), labels, F.col("message"), ("7",), ("-signup$",), (), ("k=99$",))
    return e.groupBy(r["reason"].alias("reason")).agg(F.count("*").alias("n"))


_GRANTS = "(VALUES ('admin', '*', '*'), ('operator', 'logs', 'read'), ('viewer', 'logs', 'read')) AS g(role, resource, action)"


@query(f"""SELECT DISTINCT c_custkey FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'operator' WHEN 2 THEN 'guest' ELSE 'viewer' END AS role, CASE WHEN c_custkey % 8 < 4 THEN 'logs' ELSE 'config' END AS res FROM customer) u
 JOIN {_GRANTS} ON g.role = u.role AND g.resource IN (u.res, '*') AND g.action IN ('read', '*')""")
def v16_access(spark, d):
    i = F.col("c_custkey") % 4
    users = table(spark, d, "customer").select("c_custkey", F.when(i == 0, "admin").when(i == 1, "operator").when(i == 2, "guest").otherwise("viewer").alias("role"), F.when(F.col("c_custkey") % 8 < 4, "logs").otherwise("config").alias("res"))
    grants = spark.createDataFrame([("admin", "*", "*"), ("operator", "logs", "read"), ("viewer", "logs", "read")], "g_role string, resource string, action string")
    ok = (F.col("role") == F.col("g_role")) & F.col("resource").isin("*") | (F.col("role") == F.col("g_role")) & (F.col("resource") == F.col("res"))
    return users.join(F.broadcast(grants), ok & F.col("action").isin("read", "*"), "left_semi").select("c_custkey")


@query(LOG + """SELECT source_id, CAST(min(us) AS BIGINT) AS locked_us FROM (SELECT source_id, us, event_type, row_number() OVER (PARTITION BY source_id ORDER BY us) - row_number() OVER (PARTITION BY source_id, event_type = 'view' ORDER BY us) AS run,
 row_number() OVER (PARTITION BY source_id, event_type = 'view' ORDER BY us) AS i FROM log) QUALIFY row_number() OVER (PARTITION BY source_id, event_type = 'view', run ORDER BY us) >= 3 AND event_type = 'view' GROUP BY 1""".replace("SELECT source_id, CAST(min(us) AS BIGINT) AS locked_us FROM (", "SELECT source_id, CAST(min(us) AS BIGINT) AS locked_us FROM (SELECT source_id, us FROM (").replace(" GROUP BY 1", ") GROUP BY 1"))
def v17_lockout(spark, d):
    """A source is locked at the third failure (here: view) in a row."""
    from ..operators.fold import fold

    e = events_as_log(spark, d).select("source_id", "us", (F.col("event_type") == "view").alias("failed"))
    marked = fold(e, ["source_id"], ["us"], ["failed"], lambda: 0, lambda n, bad: (n + 1, (n + 1 >= 3,)) if bad else (0, (False,)), {"locked": "boolean"})
    return marked.where("locked").groupBy("source_id").agg(F.min("us").alias("locked_us"))


# --- redaction --------------------------------------------------------------------------------------------------------------


def _redact_sql(col: str, cards=True, emails=False, ips=False) -> str:
    for _, pattern, by in red.rules(cards, emails, ips):
        by = by.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
        col = "regexp_replace({}, '{}', '{}', 'g')".format(col, pattern.replace("'", "''"), by)
    return col


#: Lines with one secret of each kind, built from the events.
_SECRET_SQL = """CASE id % 9 WHEN 0 THEN 'db://u:pw' || id || '@host/x' WHEN 1 THEN 'Bearer abc' || id || '.x' WHEN 2 THEN 'api_key=zz' || id || ' next' WHEN 3 THEN 'Authorization: Basic ' || id WHEN 4 THEN 'password=p' || id || ',user=x'
 WHEN 5 THEN 'card 4111 1111-1111' || lpad(CAST(id % 10000 AS VARCHAR), 4, '0') WHEN 6 THEN 'mail user' || id || '@example.org from 10.1.2.' || (id % 256) WHEN 7 THEN 'ssn 123-45-' || lpad(CAST(id % 10000 AS VARCHAR), 4, '0') || ' cpf 123.456.789-0' || (id % 10) ELSE 'token=abcdefghij0123456789' || id END"""


def secrets(spark, d):
    e = events_as_log(spark, d).select("id")
    s = F.expr("CAST(id AS STRING)")
    four = F.lpad((F.col("id") % 10000).cast("string"), 4, "0")
    i, c = F.col("id") % 9, F.concat
    text = (
        F.when(i == 0, c(F.lit("db://u:pw"), s, F.lit("@host/x"))).when(i == 1, c(F.lit("Bearer abc"), s, F.lit(".x"))).when(i == 2, c(F.lit("api_key=zz"), s, F.lit(" next"))).when(i == 3, c(F.lit("Authorization: Basic "), s))
        .when(i == 4, c(F.lit("password=p"), s, F.lit(",user=x"))).when(i == 5, c(F.lit("card 4111 1111-1111"), four)).when(i == 6, c(F.lit("mail user"), s, F.lit("@example.org from 10.1.2."), (F.col("id") % 256).cast("string")))
        .when(i == 7, c(F.lit("ssn 123-45-"), four, F.lit(" cpf 123.456.789-0"), (F.col("id") % 10).cast("string"))).otherwise(c(F.lit("token=abcdefghij0123456789"), s))
    )
    return e.select("id", text.alias("text"))


@query(LOG + f"SELECT id, {_redact_sql('text')} AS text FROM (SELECT id, {_SECRET_SQL} AS text FROM log)")
def r01_redact(spark, d):
    return secrets(spark, d).select("id", red.redact(F.col("text")).alias("text"))


@query(LOG + f"SELECT id, {_redact_sql('text', True, True, True)} AS text FROM (SELECT id, {_SECRET_SQL} AS text FROM log)")
def r09_redact_all(spark, d):
    return secrets(spark, d).select("id", red.redact(F.col("text"), emails=True, ips=True).alias("text"))


@query(f"SELECT doc_id, md5({_redact_sql('text', True, True, True)}) AS digest FROM documents")
def r08_redact_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(red.redact(F.col("text"), emails=True, ips=True), "utf-8")).alias("digest"))


@query("SELECT doc_id, " + " OR ".join("regexp_matches(text, '{}')".format(p) for _, p, _ in [*red.rules(True, True, True), red.IPV6]) + " AS sensitive FROM documents")
def r15_is_sensitive(spark, d):
    return table(spark, d, "documents").select("doc_id", red.is_sensitive(F.col("text"), emails=True, ips=True).alias("sensitive"))


@query("""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN contains(url, '?page') THEN '?page=2&ref=x&token=%2A%2A%2A%2A' WHEN contains(url, '?utm') THEN '?token=%2A%2A%2A%2A&utm_source=feed' ELSE '?token=%2A%2A%2A%2A' END || regexp_extract(url, '(#.*)$', 1) AS url FROM pages""")
def r14_redact_urls(spark, d):
    u = F.regexp_replace("url", r"^([^?#]*)\??([^#]*)(#.*)?$", "$1?token=abc&$2$3")
    return table(spark, d, "pages").select("page_id", red.redact_url(F.regexp_replace(u, "&(#|$)", "$1")).alias("url"))


@query(LOG + f"SELECT id, {_redact_sql('text')} AS v FROM (SELECT id, {_SECRET_SQL} AS text FROM log)")
def r16_redact_maps(spark, d):
    return secrets(spark, d).select("id", red.redact_map(F.create_map(F.lit("a"), F.col("text"), F.lit("b"), F.lit("x")))["a"].alias("v"))


# --- dedup -------------------------------------------------------------------------------------------------------------------


@query(LOG + """SELECT id, source_id || '_' || sha256(event_type || '_' || source_id || '_' || strftime(ts, '%Y-%m-%dT%H:%M')) AS key FROM log""")
def d01_hash_keys(spark, d):
    e = events_as_log(spark, d)
    return e.select("id", dedup.hash_key(F.col("event_type"), F.col("source_id"), F.col("ts")).alias("key"))


_TTL = 6 * 3600 * 1_000_000
_CHAIN = """WITH RECURSIVE log AS (""" + LOG_SQL + """), k AS (SELECT id, us, event_type || source_id AS key FROM log),
 chain AS (SELECT key, min(us) AS us FROM k GROUP BY key UNION ALL SELECT c.key, (SELECT min(k.us) FROM k WHERE k.key = c.key AND k.us > c.us + {ttl}) AS us FROM chain c WHERE EXISTS (SELECT 1 FROM k WHERE k.key = c.key AND k.us > c.us + {ttl})) """


@query(_CHAIN.format(ttl=_TTL) + "SELECT k.id, c.us IS NULL AS duplicate FROM k LEFT JOIN chain c ON c.key = k.key AND c.us = k.us")
def d02_ttl_dedup(spark, d):
    e = events_as_log(spark, d).select("id", "us", F.concat("event_type", "source_id").alias("key"))
    return dedup.ttl_dedup(e, "key", "us", _TTL, "id").select("id", "duplicate")


@query(None)
def d03_lru_admission(spark, d):
    e = events_as_log(spark, d).select("id", "us", "source_id")
    return dedup.lru_admission(e, "source_id", "us", 64, 4).select("id", "cached")


@query(_CHAIN.format(ttl=_TTL) + "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (c.us IS NULL) AS BIGINT) AS duplicates, CAST(count(*) FILTER (c.us IS NOT NULL) AS BIGINT) AS accepted, round(count(*) FILTER (c.us IS NULL) / count(*), 6) AS duplicate_rate FROM k LEFT JOIN chain c ON c.key = k.key AND c.us = k.us")
def d05_dedup_stats(spark, d):
    e = events_as_log(spark, d).select("id", "us", F.concat("event_type", "source_id").alias("key"))
    return dedup.dedup_stats(dedup.ttl_dedup(e, "key", "us", _TTL, "id")).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@query(LOG + """SELECT source_id, CAST(us - arg_min(us, us) OVER (PARTITION BY source_id ORDER BY us) AS BIGINT) AS since_first, id FROM log""".replace("arg_min(us, us)", "first_value(us)"))
def a17_delta_to_first(spark, d):
    return metrics.delta_to_first(events_as_log(spark, d), ["source_id"], "us", "us").select("id", "source_id", F.col("delta").alias("since_first"))
