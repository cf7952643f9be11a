"""Batched enrichment of events without a summary, joined back by id.

Events are chunked by host and five-minute slot into batches of at most 50, so every
group that is turned into a prompt has a fixed upper size. Nothing is left over: a slot
with more events has more batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.functions.text import batch_line, cut, fallback_summary, wrap_untrusted
from opsweave.operators.events import actionable
from opsweave.operators.timeline import Timeline
from opsweave.schemas import CLASSIFICATION, ENRICHMENT

BATCH = ["host", "slot", "batch"]
SYSTEM_PROMPT = ("Summarise each event of the batch in a few words, name an action for it "
                 "(ignore, investigate, restart_service or reboot), and list patterns across events.")

# generate(prompt, system, temperature) -> text, or None when the analyzer is unavailable
Generate = Callable[[str, str, float], "str | None"]


def in_batches(events: DataFrame, size: int = 50, every_seconds: int = 300) -> DataFrame:
    """Unanalyzed events with their batch (host, slot, batch), oldest first."""
    waiting = events.where(F.col("summary").isNull()).withColumn(
        "slot", F.floor(F.unix_seconds("ts") / every_seconds))
    return (Timeline(waiting, ["host", "slot"], ["ts", "id"]).index("_n").df
            .withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n"))


def batch_prompts(batched: DataFrame) -> DataFrame:
    """One prompt per batch: the events in time order inside an untrusted-data tag."""
    line = batch_line(F.col("id"), F.col("severity"), F.col("source"), F.col("raw_data"))
    rows = F.array_sort(F.collect_list(F.struct("ts", "id", line.alias("line"))))
    return batched.groupBy(*BATCH).agg(F.count(F.lit(1)).alias("n"), rows.alias("rows")).select(
        *BATCH, "n",
        F.concat(wrap_untrusted(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), "events"),
                 F.lit("\n\nAnalyze these "), F.col("n").cast("string"),
                 F.lit(" events. Respond with ONLY JSON: {\"events\": [{\"id\": N, \"summary\": \"short\", "
                       "\"action\": \"...\"}], \"patterns\": [\"...\"], \"overall\": \"...\"}")).alias("prompt"))


def rule_analyzer(prompt: str, system: str = "", temperature: float = 0.0) -> str:
    """The analyzer used when none is plugged in: a summary and action from each prompt line."""
    action = {"critical": "investigate", "warning": "restart_service"}
    found = re.findall(r"(?m)^\[id=(\d+)\] \[(\w+)\] (.*?): (.*)$", prompt)
    worst = sum(level == "critical" for _, level, _, _ in found)
    return json.dumps({
        "events": [{"id": int(i), "summary": f"{source}: {raw.split('msg=', 1)[-1][:80]}",
                    "action": action.get(level, "ignore")} for i, level, source, raw in found],
        "patterns": sorted({f"{source} {level}" for _, level, source, _ in found if level != "info"}),
        "overall": f"{worst} critical of {len(found)} events" if found else "",
    })


def analyze(prompts: DataFrame, generate: Generate = rule_analyzer, system: str = SYSTEM_PROMPT,
            temperature: float = 0.0) -> DataFrame:
    """Adds `response`, one analyzer call per prompt, null where the analyzer fails or has none, and
    `error`, what it raised; an unavailable analyzer means fallback summaries, not a failed job.

    Every use of the result calls the analyzer again: write it to a table to use it twice.
    """
    def call(prompt: str) -> tuple[str | None, str | None]:
        try:
            return generate(prompt, system, temperature), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            said = [call(p) for p in pdf["prompt"]]
            yield pdf.assign(**{name: pd.Series([s[i] for s in said], dtype=object, index=pdf.index)
                                for i, name in enumerate(("response", "error"))})

    fields = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes)
    return prompts.mapInPandas(run, f"{fields}, response string, error string")


def analyzer_failures(responses: DataFrame) -> DataFrame:
    """How many calls failed, by error."""
    return responses.where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def parsed_responses(responses: DataFrame) -> DataFrame:
    return responses.withColumn("_r", F.from_json("response", ENRICHMENT))


def response_items(responses: DataFrame) -> DataFrame:
    """One row per batch and id; of a repeated id the last summary and last action count."""
    items = parsed_responses(responses).select(*BATCH, F.posexplode("_r.events").alias("pos", "e"))
    action = actionable(F.col("e.action"))
    return items.groupBy(*BATCH, F.col("e.id").alias("id")).agg(
        F.max_by(F.struct(F.col("e.summary").alias("summary")), F.col("pos")).alias("_item"),
        F.max_by(action, F.when(action.isNotNull(), F.col("pos"))).alias("_action"))


def apply_enrichment(batched: DataFrame, responses: DataFrame) -> DataFrame:
    """Events with summaries and actions from the responses.

    Ids the batch did not hold are ignored; events without an answer, or whose response is
    missing or no JSON, get a fallback summary.
    """
    joined = batched.join(response_items(responses), [*BATCH, "id"], "left")
    answered = F.coalesce("_item.summary", F.substring("raw_data", 1, 120))
    return joined.withColumns({
        "summary": F.when(F.col("_item").isNotNull(), answered).otherwise(fallback_summary(F.col("raw_data"))),
        "user_action": F.coalesce("_action", "user_action"),
    }).drop("_item", "_action")


def patterns_summary(responses: DataFrame) -> DataFrame:
    """One briefing event per batch that reported patterns or an overall statement."""
    patterns = F.coalesce("_r.patterns", F.array().cast("array<string>"))
    overall = F.coalesce("_r.overall", F.lit(""))
    text = F.concat(overall, F.when(F.size(patterns) > 0, F.concat(
        F.lit(" Patterns: "), F.array_join(F.slice(patterns, 1, 3), "; "))).otherwise(""))
    return (parsed_responses(responses).where((F.size(patterns) > 0) | (overall != ""))
            .select(*BATCH, F.lit("briefing").alias("type"), F.lit("info").alias("severity"),
                    F.lit("batch_analysis").alias("source"),
                    F.to_json(F.struct(patterns.alias("patterns"), overall.alias("overall"))).alias("raw_data"),
                    F.substring(text, 1, 200).alias("summary")))


def enrich(events: DataFrame, generate: Generate = rule_analyzer, available: bool = True) -> DataFrame:
    """Unanalyzed events with a summary; unchanged when the analyzer is known to be down."""
    if not available:
        return events.where(F.col("summary").isNull())
    batched = in_batches(events)
    return apply_enrichment(batched, analyze(batch_prompts(batched), generate)).drop("slot", "batch")


def parse_classification(response: Column) -> Column:
    """A classification struct, or null unless type, severity and summary are all there."""
    complete = lambda c: c["type"].isNotNull() & c["severity"].isNotNull() & c["summary"].isNotNull()
    return F.get(F.filter(F.array(F.from_json(response, CLASSIFICATION)), complete), F.lit(0))


def classification_prompt(text: Column) -> Column:
    return F.concat(wrap_untrusted(text), F.lit(
        "\n\nClassify this log entry. Respond with ONLY a JSON object with type, severity, summary, "
        "action and root_cause."))


def briefing_prompt(summary: Column) -> Column:
    return F.concat(wrap_untrusted(cut(summary, 1200), "events_summary"),
                    F.lit("\n\nWrite a morning briefing of four to six sentences."))
