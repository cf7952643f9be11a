"""Daily briefings and crash reports, one per host.

Texts are put together from counts and from the first few events of a host; every list
that is collected has a fixed upper length (event types, severities, 15 lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.functions import severity as sev
from opsweave.functions.text import cut, display_text
from opsweave.functions.times import Instant, at, utc_day
from opsweave.operators.timeline import Timeline
from opsweave.plans.enrich import Generate, analyze, briefing_prompt
from opsweave.sources.logs import log_tail

# Size limits of a briefing, and what marks a crash in a log.
MAX_LINES = 15
MAX_CHARS = 1200
QUIET = "No events in the last 24 hours."
QUIET_PLAIN = "Morning briefing: No events in the last 24 hours. System quiet."
CRITICAL_WORD = r"\bCRITICAL\b"
OOM_WORDS = r"(?i)\b(oom|out.of.memory|killed.process)\b"
PANIC_WORDS = r"(?i)\b(panic|segfault|coredump)\b"
NO_LOG = "Previous session crashed (no ring log available for analysis)"


def last_day(events: DataFrame, as_of: Instant) -> DataFrame:
    end = at(as_of)
    cond = (F.col("ts") >= end - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= end)
    if "event_date" in events.columns:
        cond = cond & F.col("event_date").between(F.date_sub(utc_day(end), 1), utc_day(end))
    return events.where(cond)


def _first(events: DataFrame, n: int, order: list[Column], text: Column) -> DataFrame:
    """The first `n` texts of each host as an ordered array; trimmed before the shuffle."""
    rank = Window.partitionBy("host").orderBy(*order)
    return (events.select("host", F.row_number().over(rank).alias("_r"), text.alias("_t"))
            .where(F.col("_r") <= n).groupBy("host")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]).alias("texts")))


def briefing_facts(events: DataFrame) -> DataFrame:
    """Per host: total, type lines, severity lines, notable lines, critical lines."""
    line = F.concat(F.lit("  "), F.col("type"), F.lit(": "), F.col("n").cast("string"))
    per_type = events.groupBy("host", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"), F.min("id").alias("id"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    facts = per_type.groupBy("host").agg(
        F.sum("n").alias("total"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "ts", "id", line.alias("line")))).alias("t"),
        *[F.sum(s).alias(s) for s in ("critical", "warning", "info")])
    severities = F.filter(F.array(*[
        F.when(F.col(s) > 0, F.concat(F.lit(f"  {s}: "), F.col(s).cast("string")))
        for s in ("critical", "warning", "info")]), lambda x: x.isNotNull())
    described = F.concat(F.col("type"), F.lit(": "), display_text(F.col("summary"), F.col("raw_data"), 80))
    notable = _first(events, MAX_LINES, [sev.severity_rank(F.col("severity")).desc(), F.col("ts"), F.col("id")],
                     F.concat(F.lit("- ["), F.upper("severity"), F.lit("] "), described))
    critical = _first(events.where(F.col("severity") == "critical"), 5, [F.col("ts"), F.col("id")],
                      F.concat(F.lit("  - "), described))
    return (facts.select("host", "total", F.transform("t", lambda x: x["line"]).alias("types"),
                         severities.alias("severities"))
            .join(notable.withColumnRenamed("texts", "notable"), "host")
            .join(critical.withColumnRenamed("texts", "critical"), "host", "left"))


def events_summary(facts: DataFrame) -> Column:
    """Counts and the most severe events in at most 15 lines (and one for the rest), 1200 characters."""
    shown = F.least(F.col("total"), F.greatest(F.lit(1), F.lit(MAX_LINES - 3) - F.size("types"))).cast("int")
    left = F.col("total") - shown
    lines = F.concat(
        F.array(F.concat(F.lit("Total events: "), F.col("total").cast("string"))), F.col("types"),
        F.array(F.lit(""), F.lit("Notable events:")), F.slice("notable", F.lit(1), shown),
        F.when(left > 0, F.array(F.concat(F.lit("  ... and "), left.cast("string"), F.lit(" more events"))))
        .otherwise(F.array().cast("array<string>")))
    return cut(F.array_join(lines, "\n"), MAX_CHARS)


def plain_briefing(facts: DataFrame) -> Column:
    """The briefing written without a generator."""
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.lit("Morning briefing (LLM unavailable — plain summary):"),
                F.concat(F.lit("Total events in last 24h: "), F.col("total").cast("string")),
                F.lit(""), F.lit("By severity:")),
        F.col("severities"), F.array(F.lit(""), F.lit("By type:")), F.col("types"),
        F.when(F.col("critical").isNotNull(), F.concat(
            F.array(F.lit(""), F.lit("Critical events requiring attention:")), F.col("critical"))).otherwise(none))
    return F.array_join(lines, "\n")


def briefing(events: DataFrame, as_of: Instant, generate: Generate | None = None,
             hosts: DataFrame | None = None) -> DataFrame:
    """One briefing event per host over the 24 hours before `as_of`.

    raw_data is the events summary; summary is the generator's text, or the plain briefing
    when there is none. Hosts listed in `hosts` that had no event get a fixed sentence.
    """
    facts = briefing_facts(last_day(events, as_of))
    out = facts.select("host", "total", events_summary(facts).alias("raw_data"),
                       plain_briefing(facts).alias("summary"))
    if hosts is not None:
        out = (hosts.select("host").distinct().join(out, "host", "left")
               .select("host", F.coalesce("total", F.lit(0)).alias("total"),
                       F.coalesce("raw_data", F.lit(QUIET)).alias("raw_data"),
                       F.coalesce("summary", F.lit(QUIET_PLAIN)).alias("summary")))
    if generate is not None:
        out = (analyze(out.withColumn("prompt", briefing_prompt(F.col("raw_data"))), generate, temperature=0.3)
               .withColumn("summary", F.coalesce("response", "summary")).drop("prompt", "response", "error"))
    return out.select("host", at(as_of).alias("ts"), F.lit("briefing").alias("type"), F.lit("info").alias("severity"),
                      F.lit("scheduler").alias("source"), "total", "raw_data", "summary")


def crash_stats(lines: DataFrame, keys: tuple[str, ...] = ("host", "session")) -> DataFrame:
    """Per session tail: line count, CRITICAL lines, signs of memory exhaustion or panic, last source."""
    last = F.max_by("line", F.col("line_no"))
    words = F.split(F.trim(F.col("_last")), r"\s+", 4)
    return (lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").rlike(CRITICAL_WORD)).alias("n_critical"),
        F.bool_or(F.col("line").rlike(OOM_WORDS)).alias("oom"),
        F.bool_or(F.col("line").rlike(PANIC_WORDS)).alias("panic"), last.alias("_last"))
        .withColumn("last_source", F.coalesce(F.get(words, F.lit(2)), F.lit("unknown"))).drop("_last"))


def crash_text() -> Column:
    text = F.concat_ws(
        ". ",
        F.concat(F.lit("Previous session crashed ("), F.col("n_lines").cast("string"), F.lit(" log lines recovered)")),
        F.when(F.col("n_critical") > 0, F.concat(F.col("n_critical").cast("string"), F.lit(" CRITICAL events"))),
        F.when(F.col("oom"), "OOM detected"), F.when(F.col("panic"), "kernel panic/segfault detected"),
        F.concat(F.lit("last active source: "), "last_source"))
    return F.when(F.col("n_lines").isNull(), F.lit(NO_LOG)).otherwise(text)


def crash_report(sessions: DataFrame, lines: DataFrame, n: int = 200) -> DataFrame:
    """One row per unclean session: the log tail of the crashed session and its analysis.

    sessions(host, session, ts, state); lines(host, session, line_no, line).
    """
    before = Timeline(sessions, ["host"], ["ts", "session"]).carry({"crashed": F.col("session"), "previous_state": F.col("state")}).df
    crashed = (before.where((F.col("state") == "booted") & (F.col("previous_state") == "booted"))
               .select("host", "session", "ts", "state", "crashed", "previous_state"))
    wanted = lines.join(crashed.select("host", F.col("crashed").alias("session")).distinct(), ["host", "session"],
                        "left_semi")
    tail = log_tail(wanted, n)
    stats = crash_stats(tail)
    kept = tail.groupBy("host", "session").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("log"))
    found = stats.join(kept, ["host", "session"]).withColumnRenamed("session", "crashed")
    return (crashed.join(found, ["host", "crashed"], "left")
            .select("host", "session", "ts", F.lit(True).alias("detected"), "previous_state",
                    F.coalesce("log", F.array().cast("array<string>")).alias("pre_crash_log"),
                    crash_text().alias("analysis")))


def boot_events(reports: DataFrame) -> DataFrame:
    return reports.select("host", "ts", F.lit("boot_analysis").alias("type"), F.lit("warning").alias("severity"),
                          F.concat(F.lit("prev_state="), "previous_state").alias("raw_data"),
                          F.lit("boot").alias("source"), F.col("analysis").alias("summary"))
