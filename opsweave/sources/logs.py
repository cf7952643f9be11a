"""Log text to typed rows: journal exports, package manager logs, ring log lines.

Input is collected text, `raw_lines(host, source, captured_at, line)`; the same
functions serve batch and streaming tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsweave.functions.severity import priority_to_severity
from opsweave.functions.text import display_text, journal_raw, package_summary, strip
from opsweave.functions.times import utc_stamp
from opsweave.operators.timeline import Timeline
from opsweave.schemas import JOURNAL_JSON

# Package log line format and its time format; longest ring log message.
PACKAGE_LINE = r"^\[(.+?)\] \[ALPM\] (upgraded|installed|removed) (.+?) \((.+?)\)"
PACKAGE_TIME = "yyyy-MM-dd'T'HH:mm:ssZ"
LINE_LIMIT = 2000


def journal_entries(raw: DataFrame) -> DataFrame:
    """Journal fields (see JOURNAL_JSON) to id, host, ts, unit, priority, message and identity columns.

    Entries without a time get `captured_at`; without an id, a hash of the journal's cursor,
    which names an entry uniquely.
    """
    named = F.xxhash64("host", "__CURSOR", "__REALTIME_TIMESTAMP", "_SYSTEMD_UNIT", "MESSAGE")
    unit = F.nullif(F.col("_SYSTEMD_UNIT"), F.lit(""))
    return raw.select(
        "host", F.col("id") if "id" in raw.columns else named.alias("id"),
        F.coalesce(F.timestamp_micros(F.col("__REALTIME_TIMESTAMP").try_cast("bigint")),
                   F.col("captured_at")).alias("ts"),
        default_unit(unit, F.col("_TRANSPORT")).alias("unit"),
        F.coalesce(F.col("PRIORITY").try_cast("int"), F.lit(6)).alias("priority"),
        F.coalesce("MESSAGE", F.lit("")).alias("message"),
        F.col("_TRANSPORT").alias("transport"),
        F.col("_SYSTEMD_USER_UNIT").alias("user_unit"),
        F.col("SYSLOG_IDENTIFIER").alias("ident"))


def parse_journal(raw_lines: DataFrame) -> DataFrame:
    """JSON journal lines to entries.

    All fields come out of one pass over a line. Taken from a parsed struct they would be
    parsed once per field and filter, as projections are merged.
    """
    passed = [c for c in ("id",) if c in raw_lines.columns]
    names = JOURNAL_JSON.fieldNames()
    return journal_entries(raw_lines.select(
        "host", "captured_at", *passed, F.json_tuple("line", *names).alias(*names)))


def read_journal(spark: SparkSession, path: str, host: str = "local", streaming: bool = False) -> DataFrame:
    """A folder of JSON journal exports as entries."""
    reader = (spark.readStream if streaming else spark.read).schema(JOURNAL_JSON)
    return journal_entries(reader.json(path).withColumns(
        {"host": F.lit(host), "captured_at": F.current_timestamp()}))


def default_unit(unit: Column, transport: Column) -> Column:
    """The unit; 'kernel' for kernel messages without one, else 'unknown'."""
    return F.coalesce(F.nullif(unit, F.lit("")), F.when(transport == "kernel", "kernel"), F.lit("unknown"))


def priority_filter(entries: DataFrame, maximum: int = 3) -> DataFrame:
    """Errors and worse, kernel messages included."""
    return entries.where(F.col("priority") <= maximum)


def exclude_self(entries: DataFrame, units: list[str], idents: list[str]) -> DataFrame:
    """Drop the monitor's own messages; a missing unit or identifier is never its own."""
    own = F.lit(False)
    if units:
        own = own | F.coalesce(F.col("user_unit").isin(*units), F.lit(False))
    if idents:
        own = own | F.coalesce(F.col("ident").isin(*idents), F.lit(False))
    return entries.where(~own)


def non_empty_message(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("message") != "")


def startup_grace(entries: DataFrame, starts: DataFrame, seconds: float = 10.0) -> DataFrame:
    """Within the grace period after a session start (host, start_ts) keep only priority <= 2.

    Starts are rows among the entries: what decides is the last start at or before an entry.
    """
    begun = starts.select("host", F.col("start_ts").alias("ts"), F.lit(0).alias("_kind"))
    both = entries.withColumn("_kind", F.lit(1)).unionByName(begun, allowMissingColumns=True)
    rows = Timeline(both, ["host"], ["ts", "_kind"]).carry({"_start": F.when(F.col("_kind") == 0, F.unix_micros("ts"))}).df
    in_grace = F.coalesce(F.unix_micros("ts") - F.col("_start") < round(seconds * 1e6), F.lit(False))
    return rows.where((F.col("_kind") == 1) & (~in_grace | (F.col("priority") <= 2))).drop("_kind", "_start")


def journal_filter(raw_lines: DataFrame, units: list[str] | None = None, idents: list[str] | None = None,
                   maximum: int = 3) -> DataFrame:
    """The journal entries worth an event, as one projection and filter over the scan."""
    return priority_filter(exclude_self(non_empty_message(parse_journal(raw_lines)), units or [], idents or []),
                           maximum)


def journal_events(entries: DataFrame, suppressed: Column | None = None, source: str = "journald") -> DataFrame:
    """Entries as log_anomaly events without a summary; the analyzer fills that in later."""
    passed = [c for c in ("id",) if c in entries.columns]
    return entries.select(
        *passed, "host", "ts", F.lit("log_anomaly").alias("type"),
        priority_to_severity(F.col("priority")).alias("severity"),
        F.lit(None).cast("string").alias("summary"),
        journal_raw(F.col("unit"), F.col("priority"), F.col("message"), suppressed).alias("raw_data"),
        F.lit(source).alias("source"))


def parse_package_log(raw_lines: DataFrame) -> DataFrame:
    """Package manager log lines to host, ts, name, action, old_version, new_version, raw.

    Lines of another kind and lines without a readable time are left out.
    """
    line = strip(F.col("line"))
    passed = [c for c in ("id",) if c in raw_lines.columns]
    version, action = F.col("_version"), F.col("action")
    both = (action == "upgraded") & version.contains(" -> ")
    parts = F.split(version, " -> ", 2)
    return (raw_lines.where(line.rlike(PACKAGE_LINE))
            .select("host", *passed,
                    F.try_to_timestamp(F.regexp_extract(line, PACKAGE_LINE, 1), F.lit(PACKAGE_TIME)).alias("ts"),
                    F.regexp_extract(line, PACKAGE_LINE, 3).alias("name"),
                    F.regexp_extract(line, PACKAGE_LINE, 2).alias("action"),
                    F.regexp_extract(line, PACKAGE_LINE, 4).alias("_version"), line.alias("raw"))
            .where(F.col("ts").isNotNull())
            .withColumns({
                "old_version": F.when(both, parts[0]).when(action != "installed", version),
                "new_version": F.when(both, parts[1]).when(action == "installed", version)})
            .select("host", *passed, "ts", "name", "action", "old_version", "new_version", "raw"))


def package_events(packages: DataFrame) -> DataFrame:
    passed = [c for c in ("id",) if c in packages.columns]
    return packages.select(
        *passed, "host", "ts", F.lit("package_update").alias("type"), F.lit("info").alias("severity"),
        package_summary(F.col("name"), F.col("action"), F.col("old_version"), F.col("new_version")).alias("summary"),
        F.col("raw").alias("raw_data"), F.lit("pacman").alias("source"))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """`TIME LEVEL SOURCE message` lines; the source is 'unknown' on shorter lines."""
    parts = F.split(strip(F.col("line")), r"\s+", 4)
    return lines.select(
        "*", F.get(parts, F.lit(0)).try_cast("timestamp").alias("ts"), F.get(parts, F.lit(1)).alias("level"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("unknown")).alias("log_source"),
        F.get(parts, F.lit(3)).alias("message"))


def log_line(events: DataFrame) -> DataFrame:
    """Events as ring log lines; a message over the limit is cut and marked with dots."""
    message = F.concat(F.lit("type="), "type", F.lit(" summary="),
                       display_text(F.col("summary"), F.col("raw_data"), 200))
    short = F.when(F.length(message) > LINE_LIMIT,
                   F.concat(F.substring(message, 1, LINE_LIMIT), F.lit("..."))).otherwise(message)
    stamp = utc_stamp(F.col("ts"))
    return events.select("host", "id", F.concat_ws(" ", stamp, F.upper("severity"), "source", short).alias("line"))


def log_tail(lines: DataFrame, n: int = 200, keys: tuple[str, ...] = ("host", "session")) -> DataFrame:
    """The last `n` lines of each session, in no order; each task trims to n before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("line_no"))
    return lines.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def log_lines_schema() -> T.StructType:
    return T.StructType([T.StructField("host", T.StringType(), False), T.StructField("session", T.StringType(), False),
                         T.StructField("line_no", T.LongType(), False), T.StructField("line", T.StringType())])


def retain_last_lines(lines: DataFrame, max_lines: int = 50_000, max_archives: int = 3) -> DataFrame:
    """The newest lines that fit the current log and its archives, per host."""
    order = ["session", "line_no"] if "session" in lines.columns else ["line_no"]
    return (Timeline(lines, ["host"], order).index("_r", reverse=True).df
            .where(F.col("_r") <= max_lines * (1 + max_archives)).drop("_r"))
