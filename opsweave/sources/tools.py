"""Tool output to typed rows.

Line parsers take `line`, blob parsers take `body`; all other columns (host, source,
captured_at, tick, ..) pass through. Text that does not match gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.functions.evidence import LINE_BREAK
from opsweave.functions.severity import container_severity, crash_severity, risk_to_severity
from opsweave.functions.text import exe_basename, strip
from opsweave.schemas import PEER_STATUS

# Container actions kept, and patterns of the tools' output.
CONTAINER_ACTIONS = ("start", "stop", "die", "kill", "oom", "restart", "destroy")
PRESSURE = r"(?m)^some (?:.*?\s)?avg10=(\S+)"
SMART = {
    "spare": (r"Available Spare:\s+(\d+)%", 100),
    "spare_threshold": (r"Available Spare Threshold:\s+(\d+)%", 5),
    "media_errors": (r"Media and Data Integrity Errors:\s+(\d+)", 0),
}
DEVICE_COUNTER = r"\[(/dev/\S+)\]\.(\w+)\s+(\d+)"
WORD_START = r"(?:^|\s)"
# Text before the first all-digit word, that word, and the text after it.
DUMP = r"(?s)^\s*((?:(?!\p{Nd}+(?:\s|$))\S+\s+)*+)(\p{Nd}+)(?=\s|$)(.*)$"
# A signal that comes before any path, and the text after it.
SIGNAL_FIRST = r"(?s)^(?:\s+(?!SIG)[^\s/]+)*+\s+(SIG\S*)(.*)$"
AUDIT = r"^(\S+) is affected by (.+)\. (\w+) risk!$"


def _others(df: DataFrame, used: str) -> list[str]:
    return [c for c in df.columns if c != used]


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """The rows with more columns, made once each: a filter on them stays behind them, where one on columns of a plain
    projection is moved before it and repeats their expressions, those within one another many times over."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def parse_container_events(raw_lines: DataFrame) -> DataFrame:
    """`type action name` lines with an action worth an event."""
    parts = F.split(strip(F.col("line")), r"\s+", 3)
    return (raw_lines.withColumn("_p", parts).where(F.size("_p") >= 3)
            .select(*_others(raw_lines, "line"), F.get("_p", F.lit(1)).alias("action"),
                    F.get("_p", F.lit(2)).alias("container"))
            .where(F.col("action").isin(*CONTAINER_ACTIONS)))


def container_events(containers: DataFrame) -> DataFrame:
    return containers.select(
        "*", F.lit("system_metric").alias("type"), container_severity(F.col("action")).alias("severity"),
        F.concat(F.lit("container="), "container", F.lit(" action="), "action").alias("raw_data"),
        F.concat(F.lit("docker: "), "container", F.lit(" "), "action").alias("summary"))


def parse_peer_status(raw_blobs: DataFrame) -> DataFrame:
    """One row per peer name with `up`; of several peers with one name the last counts."""
    keep = _others(raw_blobs, "body")
    named = F.transform(F.map_values(F.from_json("body", PEER_STATUS)["Peer"]), lambda p: F.struct(
        F.coalesce(p["HostName"], F.lit("?")).alias("entity"), F.coalesce(p["Online"], F.lit(False)).alias("up")))
    last = F.transform(F.array_distinct(F.transform("_peers", lambda p: p["entity"])),
                       lambda name: F.element_at(F.filter("_peers", lambda p: p["entity"] == name), -1))
    return (raw_blobs.select(*keep, named.alias("_peers")).select(*keep, F.inline(last)))


def parse_gpu_csv(raw_lines: DataFrame) -> DataFrame:
    """`temperature, memory used, memory total, power` lines."""
    fields = F.transform(F.split("line", ","), lambda x: strip(x).try_cast("double"))
    used, total = F.col("_f")[1], F.col("_f")[2]
    return (raw_lines.withColumn("_f", fields)
            .where((F.size("_f") >= 4) & F.forall(F.slice("_f", 1, 4), lambda x: x.isNotNull()))
            .select(*_others(raw_lines, "line"), F.col("_f")[0].alias("gpu_temp"), used.alias("vram_used"),
                    total.alias("vram_total"), F.col("_f")[3].alias("power"),
                    F.when(total > 0, used / total * 100).otherwise(0.0).alias("gpu_vram_pct")))


def parse_pressure(raw_blobs: DataFrame) -> DataFrame:
    """The 10-second average of partial stalls."""
    return (raw_blobs.select(*_others(raw_blobs, "body"),
                             F.regexp_extract("body", PRESSURE, 1).try_cast("double").alias("avg10"))
            .where(F.col("avg10").isNotNull()))


def parse_diskstats(raw_lines: DataFrame, device: str = "nvme0n1") -> DataFrame:
    """Milliseconds spent on I/O by one device."""
    parts = F.split(strip(F.col("line")), r"\s+")
    return (raw_lines.withColumn("_p", parts)
            .where((F.size("_p") >= 14) & (F.get("_p", F.lit(2)) == device))
            .select(*_others(raw_lines, "line"), F.get("_p", F.lit(12)).cast("long").alias("io_ms")))


def parse_smart(raw_blobs: DataFrame) -> DataFrame:
    """Spare capacity, its threshold and media errors, with defaults for what is missing."""
    return raw_blobs.select(*_others(raw_blobs, "body"), *[
        F.coalesce(F.regexp_extract("body", pattern, 1).try_cast("long"), F.lit(default)).alias(name)
        for name, (pattern, default) in SMART.items()])


def parse_btrfs_stats(raw_blobs: DataFrame) -> DataFrame:
    """One row per device counter: metric = device.counter."""
    found = F.arrays_zip(*[F.regexp_extract_all("body", F.lit(DEVICE_COUNTER), F.lit(g)).alias(name)
                           for g, name in ((1, "device"), (2, "counter"), (3, "value"))])
    return (raw_blobs.select(*_others(raw_blobs, "body"), F.explode(found).alias("m"))
            .select(*_others(raw_blobs, "body"), F.concat("m.device", F.lit("."), "m.counter").alias("metric"),
                    F.col("m.value").cast("long").alias("value")))


def parse_coredumps(raw_lines: DataFrame) -> DataFrame:
    """Process id, signal and executable, read left to right; reading stops at the executable."""
    part = lambda g: F.regexp_extract("line", DUMP, g)
    before, rest, early = F.col("_before"), F.col("_rest"), F.nullif("_early", F.lit(""))
    late = lambda g: F.regexp_extract(rest, SIGNAL_FIRST, g)
    words = _once(raw_lines, part(1).alias("_before"), part(2).alias("pid"), part(3).alias("_rest")).where(F.col("pid") != "")
    parts = (_once(words, F.regexp_extract(before, rf"{WORD_START}(SIG\S*)", 1).alias("_early"),
                   late(1).alias("_late"), late(2).alias("_after"))
             .select(*_others(raw_lines, "line"), "pid", F.coalesce(early, F.nullif("_late", F.lit(""))).alias("signal"),
                     F.when(early.isNotNull(), rest).otherwise(F.col("_after")).alias("_rest"))
             .where(F.col("signal").isNotNull()))
    return parts.select(*_others(raw_lines, "line"), "pid", "signal",
                        _found(rest, rf"{WORD_START}(\S*/\S*)", 1).alias("exe"),
                        F.concat("pid", F.lit("_"), "signal").alias("dump_key"))


def coredump_events(dumps: DataFrame) -> DataFrame:
    return dumps.select(
        "*", F.lit("log_anomaly").alias("type"), crash_severity(F.col("signal")).alias("severity"),
        F.concat(F.lit("sig="), "signal", F.lit(" exe="), F.coalesce("exe", F.lit("None"))).alias("raw_data"),
        F.concat(F.lit("Crash: "), exe_basename(F.col("exe")), F.lit(" ("), "signal", F.lit(")")).alias("summary"))


def parse_audit(raw_lines: DataFrame) -> DataFrame:
    """Packages with known vulnerabilities."""
    names = ["entity", "description", "risk"]
    text = _once(raw_lines, strip(F.col("line")).alias("_text"))
    found = _once(text, *[F.regexp_extract("_text", AUDIT, g).alias(name) for g, name in enumerate(names, 1)])
    return found.where(F.col("entity") != "").select(*_others(raw_lines, "line"), *names)


def audit_events(vulnerable: DataFrame) -> DataFrame:
    return vulnerable.select(
        "*", F.lit("config_change").alias("type"), risk_to_severity(F.col("risk")).alias("severity"),
        F.concat(F.lit("pkg="), "entity", F.lit(" risk="), "risk").alias("raw_data"),
        F.concat(F.lit("CVE: "), "entity", F.lit(" — "), "description", F.lit(" ("), "risk", F.lit(")"))
        .alias("summary"))


def parse_listing(raw_blobs: DataFrame, first_word: bool = False) -> DataFrame:
    """Non-blank lines as entities in listing order (`pos`), optionally cut to their first word."""
    keep = _others(raw_blobs, "body")
    rows = (raw_blobs.select(*keep, F.posexplode(F.split("body", LINE_BREAK)).alias("pos", "_line"))
            .select(*keep, "pos", strip(F.col("_line")).alias("entity")).where(F.col("entity") != ""))
    return rows.withColumn("entity", F.split("entity", r"\s+")[0]) if first_word else rows


def parse_temps(raw: DataFrame) -> DataFrame:
    """(chip, label, file, value text in millidegrees) to degrees; the file names unlabelled sensors."""
    return (raw.withColumns({
        "label": F.coalesce("label", "file"),
        "value": strip(F.col("value")).try_cast("bigint") / 1000.0}).where(F.col("value").isNotNull()).drop("file"))


def parse_snapshots(raw: DataFrame) -> DataFrame:
    """(dir_name, info_xml, ts) to numbered snapshots; unreadable or missing info gives type unknown."""
    info = F.from_xml("info_xml", "type string, description string, _bad string",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    known = F.col("_i").isNotNull() & F.col("_i._bad").isNull()
    return (raw.where(F.col("dir_name").rlike(r"^\p{Nd}+$")).withColumn("_i", info)
            .select(*[c for c in raw.columns if c not in ("dir_name", "info_xml")],
                    F.col("dir_name").cast("long").alias("number"),
                    F.when(known, F.coalesce("_i.type", F.lit("single"))).otherwise("unknown").alias("snapshot_type"),
                    F.when(known, F.coalesce("_i.description", F.lit(""))).otherwise("").alias("description")))


def recent_snapshots(snapshots: DataFrame, n: int = 10) -> DataFrame:
    """The `n` highest-numbered snapshots of each host, newest first."""
    newest = Window.partitionBy("host").orderBy(F.desc("number"))
    return (snapshots.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")
            .orderBy("host", F.desc("number")))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    rest = [c for c in snapshots.columns if c != "host"]
    return (snapshots.groupBy("host").agg(F.max_by(F.struct(*rest), F.col("number")).alias("s"))
            .select("host", "s.*"))


def snapshot_events(snapshots: DataFrame, root: str = "/.snapshots") -> DataFrame:
    """First sightings of snapshots as events."""
    number = F.col("number").cast("string")
    return snapshots.select(
        "host", "ts", F.lit("snapshot").alias("type"), F.lit("info").alias("severity"),
        F.concat(F.lit("snapshot="), number, F.lit(f" path={root}/"), number).alias("raw_data"),
        F.lit("snapshot").alias("source"), F.concat(F.lit("Snapshot #"), number, F.lit(" created")).alias("summary"))
