"""Schemas and fixed value sets of the event model."""

from pyspark.sql import types as T

# The event types, severities and health states of the model.
EVENT_TYPES = (
    "package_update",
    "service_fail",
    "disk_alert",
    "snapshot",
    "log_anomaly",
    "reboot_required",
    "briefing",
    "system_metric",
    "trend_alert",
    "boot_analysis",
    "config_change",
)
SEVERITIES = ("info", "warning", "critical")
STATUSES = ("healthy", "degraded", "critical")

SYSTEM_EVENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("host", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("summary", T.StringType()),
    T.StructField("summary_hash", T.StringType()),
    T.StructField("raw_data", T.StringType()),
    T.StructField("source", T.StringType(), False),
    T.StructField("user_action", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("event_date", T.DateType(), False),
])

# The stored table adds the batch that wrote a row, so that a batch can be written again.
STORED_EVENTS = T.StructType([*SYSTEM_EVENTS.fields, T.StructField("batch", T.StringType())])

# Reserved by the model for learned preferences and skills; nothing reads them yet.
PREFERENCES = T.StructType([
    T.StructField("pattern", T.StringType(), False),
    T.StructField("learned_pref", T.StringType(), False),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("sample_count", T.LongType()),
    T.StructField("last_updated", T.TimestampType()),
])
SKILLS = T.StructType([
    T.StructField("trigger", T.StringType(), False),
    T.StructField("solution", T.StringType(), False),
    T.StructField("success_count", T.LongType()),
    T.StructField("failure_count", T.LongType()),
    T.StructField("last_used", T.TimestampType()),
])

METRIC_SAMPLES = T.StructType([
    T.StructField("host", T.StringType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("value", T.DoubleType()),
])

# Journal export fields, named as the journal names them.
JOURNAL_JSON = T.StructType([
    T.StructField("MESSAGE", T.StringType()),
    T.StructField("PRIORITY", T.StringType()),
    T.StructField("_TRANSPORT", T.StringType()),
    T.StructField("_SYSTEMD_UNIT", T.StringType()),
    T.StructField("_SYSTEMD_USER_UNIT", T.StringType()),
    T.StructField("SYSLOG_IDENTIFIER", T.StringType()),
    T.StructField("__REALTIME_TIMESTAMP", T.StringType()),
    T.StructField("__CURSOR", T.StringType()),
])

PEER_STATUS = T.StructType([
    T.StructField("Peer", T.MapType(T.StringType(), T.StructType([
        T.StructField("HostName", T.StringType()),
        T.StructField("Online", T.BooleanType()),
    ]))),
])

ENRICHMENT = T.StructType([
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("summary", T.StringType()),
        T.StructField("action", T.StringType()),
    ]))),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("overall", T.StringType()),
])

CLASSIFICATION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("root_cause", T.StringType()),
])
