"""From journal lines to stored events: filter, fingerprint, suppress repeats, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.config import DedupParams
from opsweave.functions.text import fingerprint
from opsweave.operators.throttle import dedup_by_fingerprint, dedup_rate_limited
from opsweave.sources.logs import journal_events, journal_filter


def with_fingerprint(entries: DataFrame, source: str = "journald") -> DataFrame:
    return entries.withColumns({
        "source": F.lit(source),
        "fingerprint": fingerprint(F.lit(source), F.col("unit"), F.col("message"))})


def journal_to_events(raw_lines: DataFrame, params: DedupParams | None = DedupParams(),
                      rate_limited: bool = False, units: list[str] | None = None,
                      idents: list[str] | None = None) -> DataFrame:
    """Events from JSON journal lines; `params=None` keeps every entry.

    Filters come before the fingerprint and the shuffle. The rate limit is exact but folds
    over a whole source; without it suppression goes by fingerprint.
    """
    entries = journal_filter(raw_lines, units, idents)
    if params is None:
        return journal_events(entries)
    marked = with_fingerprint(entries)
    if rate_limited:
        kept = dedup_rate_limited(marked, params).where(F.col("action") == "emit")
    else:
        kept = dedup_by_fingerprint(marked, params)
    return journal_events(kept, F.col("suppressed_count"))
