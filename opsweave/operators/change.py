"""Change between polled snapshots: new, recovered, switched, first seen, grown.

`ticks(host, source, tick)` lists every poll, also polls that found nothing;
`entities(host, source, tick, entity, ..)` lists what each poll found. Comparing a
poll with the one before is an equi-join on (host, source, entity, tick), spread
evenly whatever a host or source weighs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.operators.timeline import Timeline

POLL = ["host", "source", "tick"]


def with_previous_tick(ticks: DataFrame) -> DataFrame:
    """Each poll with the poll before it; null for the first."""
    polls = ticks.select(*POLL).distinct()
    return Timeline(polls, ["host", "source"], ["tick"]).carry({"prev_tick": F.col("tick")}).df


def with_next_tick(ticks: DataFrame) -> DataFrame:
    polls = ticks.select(*POLL).distinct()
    return Timeline(polls, ["host", "source"], ["tick"]).carry({"next_tick": F.col("tick")}, reverse=True).df


def new_entities(entities: DataFrame, ticks: DataFrame, prime: bool = False) -> DataFrame:
    """Entities of a poll that the poll before did not find.

    The first poll fires for everything, or is a silent baseline when `prime` is set.
    """
    seen = entities.dropDuplicates([*POLL, "entity"]).join(with_previous_tick(ticks), POLL)
    if prime:
        seen = seen.where(F.col("prev_tick").isNotNull())
    before = entities.select("host", "source", F.col("tick").alias("prev_tick"), "entity").distinct()
    return seen.join(before, ["host", "source", "prev_tick", "entity"], "left_anti").select(*entities.columns)


def recovered_entities(entities: DataFrame, ticks: DataFrame) -> DataFrame:
    """(host, source, tick, entity) for entities gone at `tick` that the poll before found."""
    gone = (entities.select(*POLL, "entity").distinct().join(with_next_tick(ticks), POLL)
            .where(F.col("next_tick").isNotNull())
            .select("host", "source", F.col("next_tick").alias("tick"), "entity"))
    return gone.join(entities.select(*POLL, "entity"), [*POLL, "entity"], "left_anti")


def state_transitions(states: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Rows whose `up` differs from the entity's previous state, with `was`.

    With `ticks`, previous means the poll just before (an entity missing there is
    silent); without, the entity's last known state however old.
    """
    if ticks is None:
        keys = ["host", "source", "entity"]
        compared = Timeline(states, keys, ["tick"]).carry({"was": F.col("up")}).df
    else:
        before = states.select("host", "source", F.col("tick").alias("prev_tick"), "entity",
                               F.col("up").alias("was"))
        compared = (states.join(with_previous_tick(ticks), POLL)
                    .join(before, ["host", "source", "prev_tick", "entity"]).drop("prev_tick"))
    return compared.where(F.col("was") != F.col("up"))


def peer_events(peers: DataFrame, ticks: DataFrame) -> DataFrame:
    """Peers going offline (warning) and coming online (info)."""
    moved = state_transitions(peers, ticks)
    return _event(
        moved, event_type=F.lit("system_metric"),
        severity=F.when(F.col("up"), "info").otherwise("warning"), source="tailscale",
        raw=F.concat(F.lit("peer="), F.col("entity")),
        summary=F.concat(F.lit("tailscale: "), F.col("entity"), F.when(F.col("up"), " online").otherwise(" offline")))


def service_down_events(services: DataFrame) -> DataFrame:
    """Services that stopped being active."""
    down = state_transitions(services).where(~F.col("up"))
    return _event(down, event_type=F.lit("service_fail"), severity=F.lit("warning"), source="netcheck",
                  raw=F.concat(F.lit("svc="), F.col("entity")),
                  summary=F.concat(F.col("entity"), F.lit(".service down")))


def port_down_events(ports: DataFrame) -> DataFrame:
    """Ports (entity = number, `label` = service) that stopped answering."""
    down = state_transitions(ports).where(~F.col("up"))
    return _event(down, event_type=F.lit("system_metric"), severity=F.lit("warning"), source="netcheck",
                  raw=F.concat(F.lit("port="), F.col("entity")),
                  summary=F.concat(F.lit("Port "), F.col("entity"), F.lit(" ("), F.col("label"), F.lit(") down")))


def failed_unit_events(units: DataFrame, ticks: DataFrame) -> DataFrame:
    return _event(new_entities(units, ticks), event_type=F.lit("service_fail"), severity=F.lit("critical"),
                  source="services", raw=F.concat(F.lit("unit="), F.col("entity"), F.lit(" state=failed")),
                  summary=F.concat(F.lit("Service "), F.col("entity"), F.lit(" has failed")))


def config_file_events(paths: DataFrame, ticks: DataFrame) -> DataFrame:
    """Configuration files left beside the ones in use; the first poll is the baseline."""
    return _event(new_entities(paths, ticks, prime=True), event_type=F.lit("config_change"),
                  severity=F.lit("warning"), source="pacnew", raw=F.concat(F.lit("path="), F.col("entity")),
                  summary=F.concat(F.lit("New .pacnew: "), F.col("entity")))


def _event(df: DataFrame, event_type: Column, severity: Column, source: str, raw: Column,
           summary: Column) -> DataFrame:
    return df.select("host", "tick", event_type.alias("type"), severity.alias("severity"),
                     F.lit(source).alias("source"), raw.alias("raw_data"), summary.alias("summary"))


def first_seen(df: DataFrame, keys: list[str], order: list[str], prime: bool = False,
               scan: list[str] | None = None) -> DataFrame:
    """The first row of every key for all time.

    With `prime`, keys already present in the first scan (smallest `order[0]` per `scan`)
    stay silent. A plain aggregate: each task keeps one row per key before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    least = F.struct(*rest), F.struct(*order)
    shown = lambda first: first.select(*keys, "r.*").select(*df.columns)
    if not prime:
        return shown(df.groupBy(*keys).agg(F.min_by(*least).alias("r")))
    scan = scan or ["host"]
    if set(scan) <= set(keys):  # a scan's start is the least of its keys'
        # both sides need both aggregates, so the rows are read and grouped once
        first = df.groupBy(*keys).agg(F.min_by(*least).alias("r"), F.min(order[0]).alias("_least")).where("r is not null and _least is not null")
        start = first.groupBy(*scan).agg(F.min("_least").alias("_start"))
    else:
        first = df.groupBy(*keys).agg(F.min_by(*least).alias("r"))
        start = df.groupBy(*scan).agg(F.min(order[0]).alias("_start"))
    return shown(first).join(start, scan).where(F.col(order[0]) > F.col("_start")).drop("_start")


def accumulation_alert(df: DataFrame, key: str, order: list[str], warn: int = 50) -> DataFrame:
    """One row per host, when its number of distinct keys first reaches `warn`."""
    nth = Window.partitionBy("host").orderBy(*order, key)
    return (first_seen(df.select("host", key, *order).distinct(), ["host", key], order)
            .withColumn("n", F.row_number().over(nth)).where(F.col("n") <= warn)
            .where(F.col("n") == warn))


def growth_alert(entities: DataFrame, ticks: DataFrame, sample: int = 5) -> DataFrame:
    """Polls that found more entities than the poll before: n, added, first few names.

    Names are the first word of the first `sample` lines, in listing order (`pos`) where
    known. Counts and samples are reduced per poll before polls are compared.
    """
    order = F.struct("pos", "entity") if "pos" in entities.columns else F.struct("entity")
    counts = entities.groupBy(*POLL).agg(F.count(F.lit(1)).alias("n"))
    head = (entities.withColumn("_o", order)
            .withColumn("_r", F.row_number().over(Window.partitionBy(*POLL).orderBy("_o")))
            .where(F.col("_r") <= sample).groupBy(*POLL)
            .agg(F.array_sort(F.collect_list("_o")).alias("head")))
    sizes = (ticks.select(*POLL).distinct().join(counts, POLL, "left")
             .withColumn("n", F.coalesce("n", F.lit(0))))
    grown = (Timeline(sizes, ["host", "source"], ["tick"]).carry({"prev": F.col("n")}).df
             .where(F.col("n") > F.col("prev")))
    words = F.transform(F.col("head"), lambda x: F.split(x["entity"], r"\s+")[0])
    return grown.join(head, POLL).select(
        *POLL, "n", (F.col("n") - F.col("prev")).alias("added"), F.array_join(words, ", ").alias("sample"))


def kernel_mismatch(running: DataFrame, installed: DataFrame) -> DataFrame:
    """Polls whose running kernel (host, tick, version) is not among the installed ones."""
    known = (installed.select("host", "tick", "version").distinct()
             .groupBy("host", "tick").agg(F.array_join(F.array_sort(F.collect_list("version")), ",").alias("names")))
    return (running.join(installed.select("host", "tick", "version"), ["host", "tick", "version"], "left_anti")
            .join(known, ["host", "tick"], "left")
            .select("host", "tick", F.concat(F.lit("running="), F.col("version"), F.lit(" installed="),
                                             F.coalesce("names", F.lit(""))).alias("mismatch")))


def edge_alerts(df: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Rows where a flag turns true; it counts as false before the first row."""
    return (Timeline(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), keys, order)
            .carry({"_was": F.col("_flag")}).df
            .where(F.col("_flag") & ~F.coalesce("_was", F.lit(False))).drop("_flag", "_was"))


def reboot_events(df: DataFrame, sentinel: str = "/run/reboot-required") -> DataFrame:
    """(host, tick, sentinel boolean, mismatch string) -> one event each time a reboot becomes due."""
    due = edge_alerts(df, F.col("sentinel") | F.col("mismatch").isNotNull(), ["host"], ["tick"])
    return _event(due, event_type=F.lit("reboot_required"), severity=F.lit("warning"), source="reboot",
                  raw=F.when(F.col("sentinel"), F.lit(f"sentinel={sentinel}"))
                  .otherwise(F.concat(F.lit("kernel_mismatch: "), F.col("mismatch"))),
                  summary=F.lit("System reboot required"))


def unclean_sessions(sessions: DataFrame) -> DataFrame:
    """(host, ts, state) rows with state 'booted' that follow another 'booted': a crash between."""
    order = ["ts", "session"] if "session" in sessions.columns else ["ts", "state"]
    return (Timeline(sessions, ["host"], order).carry({"previous_state": F.col("state")}).df
            .where((F.col("state") == "booted") & (F.col("previous_state") == "booted")))
