"""Record schemas as DDL."""

STEP = "STRUCT<name:STRING,timestamp:TIMESTAMP,duration:BIGINT,success:BOOLEAN,error:STRING,input:STRING,output:STRING,metadata:MAP<STRING,STRING>>"

#: A log record. Labels are string to string; dynamic fields are kept as JSON text per key.
LOG_ENTRY = (
    "trace_id STRING, span_id STRING, parent_span_id STRING, timestamp TIMESTAMP, timestamp_ns BIGINT, duration BIGINT, processed_at TIMESTAMP, message STRING, level STRING,"
    " source_type STRING, source_id STRING, tags ARRAY<STRING>, labels MAP<STRING,STRING>, fields MAP<STRING,STRING>, processing_steps ARRAY<" + STEP + ">, pipeline STRING,"
    " data_classification STRING, retention_policy STRING, sanitized_fields ARRAY<STRING>, metrics MAP<STRING,DOUBLE>, slos MAP<STRING,DOUBLE>"
)

INGEST_REQUEST = "message STRING, level STRING, source_type STRING, source_id STRING, labels MAP<STRING,STRING>, timestamp TIMESTAMP"

DLQ_ENTRY = (
    "timestamp TIMESTAMP, original_entry STRUCT<timestamp:TIMESTAMP,message:STRING,level:STRING,source_type:STRING,source_id:STRING,labels:MAP<STRING,STRING>>, error_message STRING, error_type STRING, failed_sink STRING,"
    " retry_count INT, context MAP<STRING,STRING>, stack_trace STRING, reprocess_attempts INT, last_reprocess_attempt TIMESTAMP, next_reprocess_time TIMESTAMP, reprocessing_enabled BOOLEAN, entry_id STRING"
)

METRIC_SAMPLE = "metric STRING, labels MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE"
HISTOGRAM_SAMPLE = "metric STRING, labels MAP<STRING,STRING>, le DOUBLE, ts TIMESTAMP, value DOUBLE"
POSITION = "file_path STRING, offset BIGINT, size BIGINT, last_modified TIMESTAMP, last_read TIMESTAMP, inode BIGINT, device BIGINT, log_count BIGINT, bytes_read BIGINT, status STRING"
CONTAINER_POSITION = "container_id STRING, since TIMESTAMP, last_read TIMESTAMP, last_log_time TIMESTAMP, created TIMESTAMP, status STRING, restart_count BIGINT, log_count BIGINT, bytes_read BIGINT"
SLO_MEASUREMENT = "slo STRING, sli STRING, ts TIMESTAMP, value DOUBLE, target DOUBLE, window_s DOUBLE, interval_s DOUBLE, budget_total DOUBLE"
SINK_ATTEMPT = "sink STRING, ts TIMESTAMP, ok BOOLEAN, error STRING, latency_ms DOUBLE"
RESOURCE_SAMPLE = "ts TIMESTAMP, queue DOUBLE, memory DOUBLE, cpu DOUBLE, io DOUBLE, errors DOUBLE"
FILE_INFO = "path STRING, size BIGINT, mod_time TIMESTAMP"
SERVICE = "id STRING, name STRING, type STRING, status STRING, pipeline STRING, component STRING, tenant STRING, labels MAP<STRING,STRING>"

#: Histogram bounds (the last bucket is infinite).
PROCESSING_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
SINK_SEND_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
MESSAGE_BYTES_BUCKETS = (100.0, 500.0, 1024.0, 5120.0, 10240.0, 51200.0, 102400.0, 512000.0, 1048576.0)
