"""Memory of past events: similar ones by embedding, and what was done about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.catalog import EV, query, us
from opsweave.functions.text import display_text
from opsweave.operators.similar import build_index, past_context, similar
from opsweave.operators.preferences import preferences
from opsweave.sources.tables import AS_OF, sample_events, table

_PAIRS = """pairs AS (SELECT q.id AS query, e.id,
    round(list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v))), 9) AS similarity
  FROM vecs q JOIN vecs e ON q.id <> e.id AND {past} WHERE q.id % 100 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id)::INTEGER AS rank FROM pairs QUALIFY rank <= 3)"""
_VECS = "vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v{ts} FROM embeddings{join})"
_ANY = _VECS.format(ts="", join="") + ",\n" + _PAIRS.format(past="true")
_PAST = (_VECS.format(ts=", us", join=" JOIN ev ON ev.id = vec_id") + ",\n" + _PAIRS.format(past="e.us < q.us"))


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(f"WITH {_ANY} SELECT query, rank, id, round(similarity, 6) AS similarity FROM top")
def similar_events(spark, folder):
    """The three events most similar to each event whose id is divisible by 100, of all events: as if all were compared."""
    rows = _vectors(spark, folder)
    found = similar(build_index(rows), rows.where("id % 100 = 0"), exact=True)
    return found.withColumn("similarity", F.round("similarity", 6))


def _past(spark, folder):
    events = sample_events(spark, folder)
    rows = _vectors(spark, folder).join(events.select("id", "ts"), "id")
    return similar(build_index(rows, at="ts"), rows.where("id % 100 = 0"), at="ts", exact=True), events


@query(f"WITH {EV},\n{_PAST} SELECT query, rank, id, round(similarity, 6) AS similarity FROM top")
def similar_past_events(spark, folder):
    """The same of earlier events only."""
    return _past(spark, folder)[0].withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {EV},\n{_PAST} SELECT query, count(*) AS n, string_agg(concat('- [', printf('%.2f', similarity), '] ',
  coalesce(nullif(summary, ''), raw_data[1:80]), coalesce(' -> ' || user_action, '')), chr(10) ORDER BY rank) AS context
FROM top JOIN ev USING (id) GROUP BY query""")
def similar_context(spark, folder):
    """What a prompt says of similar past events: their texts and what was done."""
    found, events = _past(spark, folder)
    return past_context(found, events, display_text(F.col("summary"), F.col("raw_data"), 80))


@query(f"""WITH {_ANY} SELECT count(*) AS n, true AS enough FROM top""")
def similar_recall(spark, folder):
    """Recall of the index's own number of probes against the exact result, over all those queries: 0.9 or more."""
    rows = _vectors(spark, folder)
    index, asked = build_index(rows), rows.where("id % 100 = 0")
    want = similar(index, asked, exact=True).select("query", "id")
    got = similar(index, asked).select("query", "id", F.lit(1).alias("hit"))
    return want.join(got, ["query", "id"], "left").agg(
        F.count(F.lit(1)).alias("n"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query(f"""WITH RECURSIVE {EV}, acts AS (SELECT host, concat(type, ':', source) AS pattern, us, id, user_action FROM ev
  WHERE user_action IS NOT NULL),
each AS (SELECT acts.*, p.preference, user_action = p.preference AS hit, row_number() OVER (PARTITION BY host, pattern, preference ORDER BY us, id) AS rn
  FROM acts, (VALUES ('ignored'), ('restarted'), ('postponed'), ('applied')) p(preference)),
steps AS (SELECT host, pattern, preference, rn, us, CASE WHEN hit THEN 1 - pow(3, -0.25) ELSE 0 END AS c, hit::INTEGER::BIGINT AS samples FROM each WHERE rn = 1
  UNION ALL SELECT e.host, e.pattern, e.preference, e.rn, e.us, CASE WHEN e.hit THEN pow(3, -0.25) ELSE 0.5 END * s.c * exp(-ln(2) / 7776000e6 * (e.us - s.us))
    + CASE WHEN e.hit THEN 1 - pow(3, -0.25) ELSE 0 END, s.samples + e.hit::INTEGER
  FROM steps s JOIN each e USING (host, pattern, preference) WHERE e.rn = s.rn + 1),
ends AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY host, pattern, preference ORDER BY rn DESC) = 1)
SELECT host, pattern, preference, round(c * exp(-ln(2) / 7776000e6 * (epoch_us(TIMESTAMP '{AS_OF}') - us)), 9) AS confidence, samples,
  us AS last_updated_us, c * exp(-ln(2) / 7776000e6 * (epoch_us(TIMESTAMP '{AS_OF}') - us)) > 0.8 AS change FROM ends WHERE samples > 0""")
def preference_confidence(spark, folder):
    """What users prefer to do about each pattern of events, and how sure that is."""
    events = sample_events(spark, folder)
    acts = events.withColumn("pattern", F.concat("type", F.lit(":"), "source"))
    return preferences(acts, AS_OF).select("host", "pattern", "preference", F.round("confidence", 9).alias("confidence"), "samples",
                                           us("last_updated"), "change")
