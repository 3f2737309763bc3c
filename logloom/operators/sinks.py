"""Payloads of sinks as projections, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import put, stream_key, stream_labels

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TEXT_LABELS = ("level", "service", "container", "container_name")


def json_line(df: DataFrame) -> Column:
    """Time, message, source type and id, time of processing, and labels unless there are none."""
    stamp = lambda c: F.date_format(c, RFC3339)
    labels = F.when(F.size("labels") > 0, F.col("labels"))
    fields = [stamp(F.col("timestamp")).alias("timestamp"), F.col("message"), F.col("source_type"), F.col("source_id")]
    if "processed_at" in df.columns:
        fields.append(stamp(F.col("processed_at")).alias("processed_at"))
    return F.to_json(F.struct(*fields, labels.alias("labels")))


def text_line(ts: Column, source_type: Column, source_id: Column, labels: Column, message: Column, separator: str = " | ", with_time: bool = True, with_labels: bool = True) -> Column:
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter(labels, lambda k, _: k.isin(*TEXT_LABELS)))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    parts = [F.date_format(ts, "yyyy-MM-dd HH:mm:ss")] * with_time + [F.concat(F.lit("["), F.upper(source_type), F.lit(":"), source_id, F.lit("]"))]
    parts += [F.when(pairs != "", F.concat(F.lit("{"), pairs, F.lit("}")))] * with_labels
    return F.concat_ws(separator, *parts, message)


def write_files(df: DataFrame, path: str, as_json: bool = True, max_records: int = 0, compression: str = "gzip") -> None:
    """One folder per date and hour; rotation by records per file, compressed."""
    line = json_line(df) if as_json else text_line(F.col("timestamp"), F.col("source_type"), F.col("source_id"), F.col("labels"), F.col("message"))
    out = df.select(line.alias("value"), F.date_format("timestamp", "yyyy-MM-dd").alias("date"), F.date_format("timestamp", "HH").alias("hour"))
    out.write.mode("append").option("compression", compression).option("maxRecordsPerFile", max_records).partitionBy("date", "hour").text(path)


def loki_streams(df: DataFrame, defaults: dict[str, str] | None = None, batch: int = 1000) -> DataFrame:
    """Streams of at most ``batch`` entries: key, labels, values [[nanoseconds, line]...]. Entries are numbered inside a stream's minute
    and gathered by number, so no group holds more than a batch."""
    keyed = df.select(stream_labels(F.col("labels"), defaults).alias("stream"), F.col("timestamp"), F.col("message")).withColumn("stream_key", stream_key(F.col("stream")))
    keyed = keyed.withColumn("part", F.floor(F.unix_micros("timestamp") / (60 * 1_000_000)))
    number = F.row_number().over(Window.partitionBy("stream_key", "part").orderBy("timestamp", "message"))
    entry = F.struct(F.col("number"), (F.unix_micros("timestamp") * 1000).cast("string").alias("ns"), F.col("message").alias("line"))
    chunks = keyed.withColumn("number", number).withColumn("chunk", F.floor((F.col("number") - 1) / batch)).groupBy("stream_key", "part", "chunk")
    return chunks.agg(F.first("stream").alias("stream"), F.array_sort(F.collect_list(entry)).alias("v")).select("stream_key", "stream", F.transform("v", lambda x: F.array(x["ns"], x["line"])).alias("values"))


def kafka_records(df: DataFrame, topic: Column, key: Column) -> DataFrame:
    return df.select(topic.alias("topic"), key.alias("key"), json_line(df).alias("value"))


def kafka_options(servers: str, acks: str = "all", compression: str = "snappy", sasl: dict[str, str] | None = None) -> dict[str, str]:
    """Options of Spark's Kafka writer."""
    out = {"kafka.bootstrap.servers": servers, "kafka.acks": acks, "kafka.compression.type": compression}
    if sasl:
        out |= {"kafka.security.protocol": sasl.get("protocol", "SASL_SSL"), "kafka.sasl.mechanism": sasl["mechanism"], "kafka.sasl.jaas.config": sasl["jaas"]}
    return out


def elastic_documents(df: DataFrame, index: Column, defaults: dict[str, str] | None = None) -> DataFrame:
    """index, document: default labels give way to the record's."""
    labels = put(F.lit(None).cast("map<string,string>"), {k: F.lit(v) for k, v in sorted((defaults or {}).items())}) if defaults else F.create_map().cast("map<string,string>")
    own = F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(labels, lambda k, _: ~F.map_contains_key(own, k)), own)
    rows = df.withColumn("__l", merged)
    doc = F.struct(F.date_format("timestamp", RFC3339).alias("@timestamp"), "message", "level", "source_id", F.col("__l").alias("labels"), F.col("__l")["host"].alias("host"), F.col("__l")["service"].alias("service"))
    return rows.select(index.alias("index"), F.to_json(doc).alias("document"))


def splunk_events(df: DataFrame, host: str = "", source: str = "", sourcetype: str = "", index: str = "") -> DataFrame:
    """time (epoch seconds), host, source, sourcetype, index (labels win over the settings), event as JSON."""
    own = F.col("labels")
    return df.select(
        (F.unix_micros("timestamp") / 1e6).alias("time"),
        F.coalesce(own["host"], F.lit(host)).alias("host"), F.coalesce(own["source"], F.lit(source)).alias("source"), F.coalesce(own["sourcetype"], F.lit(sourcetype)).alias("sourcetype"), F.coalesce(own["index"], F.lit(index)).alias("index"),
        F.to_json(F.struct("message", "level", "source_id", F.date_format("timestamp", RFC3339).alias("timestamp"), own.alias("labels"))).alias("event"),
    )


def halves(df: DataFrame, batch: Column, order: list[str], size: Column, limit: int) -> DataFrame:
    """``half`` of each record of an oversized batch (1 or 2; 0 where the batch fits)."""
    w = Window.partitionBy(batch)
    return df.withColumn("half", F.when(F.sum(size).over(w) > limit, F.ntile(2).over(w.orderBy(*order))).otherwise(0))
