"""Severity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsweave.schemas import EVENT_TYPES, SEVERITIES


def severity_rank(severity: Column) -> Column:
    """info 0, warning 1, critical 2; anything else null."""
    return F.when(severity == "info", 0).when(severity == "warning", 1).when(severity == "critical", 2)


def severity_of_rank(rank: Column) -> Column:
    return F.when(rank == 2, "critical").when(rank == 1, "warning").when(rank == 0, "info")


def severity_max(a: Column, b: Column) -> Column:
    """The more severe of two; `a` when they tie."""
    return F.when(severity_rank(a) >= severity_rank(b), a).otherwise(b)


def priority_to_severity(priority: Column) -> Column:
    """Syslog priority: 0-3 critical, 4 warning, all else info."""
    return (F.when(priority.between(0, 3), "critical")
            .when(priority == 4, "warning")
            .otherwise("info"))


def risk_to_severity(risk: Column) -> Column:
    return (F.when(risk.isin("Critical", "High"), "critical")
            .when(risk == "Medium", "warning")
            .otherwise("info"))


def container_severity(action: Column) -> Column:
    return (F.when(action == "oom", "critical")
            .when(action.isin("die", "kill"), "warning")
            .otherwise("info"))


def crash_severity(signal: Column) -> Column:
    return F.when(signal.isin("SIGSEGV", "SIGBUS"), "critical").otherwise("warning")


def known_type(event_type: Column) -> Column:
    return F.coalesce(event_type.isin(*EVENT_TYPES), F.lit(False))


def known_severity(severity: Column) -> Column:
    return F.coalesce(severity.isin(*SEVERITIES), F.lit(False))
