"""Text and evidence queries over whole documents and conversations."""

from pyspark.sql import functions as F

from opsweave.catalog import EV, query
from opsweave.functions import evidence, text
from opsweave.plans.enrich import classification_prompt, parse_classification
from opsweave.sources.tables import sample_events, system_events, table

# The engine's regular expressions have no look-around and ASCII-only shorthands, so a
# long number is matched with its neighbours, twice because neighbours may be shared.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = f"'^{_SPACE}+|{_SPACE}+$', '', 'g'"


def _long_numbers(x: str, mark: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    once = rf"'(^|{edge})\p{{Nd}}{{4,}}($|{edge})', '\1{mark}\2', 'g'"
    return f"regexp_replace(regexp_replace({x}, {once}), {once})"


def _normalized(x: str) -> str:
    for pattern, mark in ((text.BROWSER_PREFIX, "[*:"), (text.PID, "[*]"), (text.UUID, "<UUID>"), (text.HEX, "0x*")):
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return f"regexp_replace({_long_numbers(x, '*')}, {_STRIP})"


def _normalized_summary(x: str) -> str:
    x = f"lower({x})"
    for pattern in (text.PID, text.HEX):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    # Numbers vanish here, so a blank on either side must survive for the second pass.
    x = _long_numbers(x, "")
    inner = _SPACE[1:-1]
    x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_{inner}]', '', 'g')"
    return f"regexp_replace(regexp_replace({x}, '{_SPACE}+', ' ', 'g'), {_STRIP})"


def _messages(spark, folder):
    """Whole documents with the volatile parts a log message has."""
    n = F.col("doc_id").cast("string")
    d = table(spark, folder, "documents")
    return d.select("doc_id", "source", "lang", F.concat(
        F.lit("[66:212:0328/063400."), n, F.lit(":ERROR] app["), n, F.lit("]: "), "text", F.lit(" at 0xbeef"), n,
        F.lit(" session a1b2c3d4-e5f6-7890-abcd-ef1234567890 port "), (F.col("doc_id") + 1000).cast("string"),
        F.lit(" ")).alias("message"))


_MSG = """msg AS (SELECT doc_id, source, lang, concat('[66:212:0328/063400.', doc_id, ':ERROR] app[', doc_id, ']: ', text,
  ' at 0xbeef', doc_id, ' session a1b2c3d4-e5f6-7890-abcd-ef1234567890 port ', doc_id + 1000, ' ') AS message
  FROM documents)"""


@query(f"WITH {_MSG} SELECT doc_id, n, length(n) AS n_chars FROM (SELECT doc_id, {_normalized('message')} AS n FROM msg)")
def normalize_message(spark, folder):
    n = text.normalize_message(F.col("message"))
    return _messages(spark, folder).select("doc_id", n.alias("n")).withColumn("n_chars", F.length("n").cast("long"))


@query(f"WITH {_MSG} SELECT doc_id, sha256(concat(source, ':', lang, ':', {_normalized('message')}))[1:16] AS fp FROM msg")
def fingerprint(spark, folder):
    return _messages(spark, folder).select(
        "doc_id", text.fingerprint(F.col("source"), F.col("lang"), F.col("message")).alias("fp"))


@query(f"WITH {_MSG} SELECT doc_id, {_normalized_summary('message')} AS n FROM msg")
def normalize_summary(spark, folder):
    return _messages(spark, folder).select("doc_id", text.normalize_summary(F.col("message")).alias("n"))


@query(f"WITH {_MSG} SELECT fp, count(*) AS n, min(doc_id) AS first_id FROM "
       f"(SELECT doc_id, sha256({_normalized_summary('message')})[1:16] AS fp FROM msg) GROUP BY fp")
def summary_groups(spark, folder):
    fp = text.summary_fingerprint(F.col("message")).alias("fp")
    return (_messages(spark, folder).select("doc_id", fp).groupBy("fp")
            .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")))


def _generated(spark, folder):
    """Turns of conversations as generated reports: heading, the turn's lines, a cited line, a rule."""
    c = table(spark, folder, "conversations")
    return c.select("conv_id", "turn", F.concat(
        F.lit("## "), "role", F.lit("\n"), "text", F.lit("\n\nnoted by [source:  "), "role", F.lit(" ] \n---\n")).alias("text"))


_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_HEADER = rf"^({_SPACE}*#{{1,6}}{_SPACE}+.*|{_SPACE}*[-=]{{3,}}{_SPACE}*|{_SPACE}*\*{{3,}}{_SPACE}*|{_SPACE}*)$"
_TAG = rf"(?i)\[Source:{_SPACE}*([^\]]+)\]"
_GEN = rf"""gen AS (SELECT conv_id, turn,
  concat('## ', role, chr(10), text, chr(10), chr(10), 'noted by [source:  ', role, ' ] ', chr(10), '---', chr(10)) AS text
  FROM conversations),
parts AS (SELECT conv_id, turn, string_split_regex(text, '{_BREAK}') AS p FROM gen),
cut AS (SELECT conv_id, turn, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts),
lines AS (SELECT conv_id, turn, i - 1 AS line_no, regexp_replace(p[i], '{_SPACE}+$', '') AS line
  FROM cut, generate_series(1, len(p)) AS g(i)),
checked AS (SELECT *, regexp_matches(line, '{_HEADER}') AS header, regexp_matches(line, '{_TAG}') AS tagged FROM lines)"""


@query(rf"WITH {_GEN} SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, line AS text, header AS is_header, "
       rf"CASE WHEN NOT header AND tagged THEN regexp_replace(regexp_extract(line, '{_TAG}', 1), {_STRIP}) END AS source, "
       "header OR tagged AS sourced FROM checked")
def evidence_lines(spark, folder):
    return evidence.evidence_table(_generated(spark, folder), ["conv_id", "turn"])


@query(f"WITH {_GEN} SELECT conv_id, turn, bool_and(header OR tagged) AS all_sourced, count(*) AS n_lines "
       "FROM checked GROUP BY ALL")
def validate_evidence(spark, folder):
    return (evidence.validate_evidence(_generated(spark, folder))
            .select("conv_id", "turn", "all_sourced", F.size("lines").cast("long").alias("n_lines")))


@query(f"WITH {_GEN} SELECT conv_id, turn, string_agg(CASE WHEN header OR tagged THEN line "
       "ELSE concat(line, ' [Source: LLM analysis]') END, chr(10) ORDER BY line_no) AS text FROM checked GROUP BY ALL")
def reformat_evidence(spark, folder):
    return _generated(spark, folder).select("conv_id", "turn", evidence.reformat_evidence(F.col("text")).alias("text"))


@query(f"WITH {EV} SELECT id, concat('[id=', id, '] [', severity, '] ', source, ': ', raw_data[1:200]) AS line FROM ev")
def batch_lines(spark, folder):
    return system_events(spark, folder).select("id", text.batch_line(
        F.col("id"), F.col("severity"), F.col("source"), F.col("raw_data")).alias("line"))


@query("SELECT page_id, concat('<log_content>', chr(10), html, chr(10), '</log_content>') AS prompt FROM pages")
def wrap_untrusted(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.wrap_untrusted(F.col("html")).alias("prompt"))


@query("SELECT page_id, concat('<log_content>', chr(10), html, chr(10), '</log_content>', chr(10), chr(10), "
       "'Classify this log entry. Respond with ONLY a JSON object with type, severity, summary, action and root_cause.') "
       "AS prompt FROM pages")
def classification_prompts(spark, folder):
    return table(spark, folder, "pages").select("page_id", classification_prompt(F.col("html")).alias("prompt"))


def _answers(spark, folder):
    """Classification answers, some of them incomplete or no JSON."""
    e = sample_events(spark, folder)
    head = F.concat(F.lit('{"type":"'), "type", F.lit('","severity":"'), "severity", F.lit('"'))
    return e.select("id", F.when(F.col("event_type") == "view", F.col("raw_data"))
                    .when(F.col("event_type") == "click", F.concat(head, F.lit("}")))
                    .otherwise(F.concat(head, F.lit(',"summary":"'), "raw_data", F.lit('","action":"ignore"}'))).alias("r"))


@query(f"WITH {EV} SELECT id, type, severity, raw_data AS summary, 'ignore' AS action FROM ev "
       "WHERE event_type NOT IN ('view', 'click')")
def parse_classifications(spark, folder):
    return (_answers(spark, folder).select("id", parse_classification(F.col("r")).alias("c"))
            .where(F.col("c").isNotNull()).select("id", "c.type", "c.severity", "c.summary", "c.action"))


@query(f"WITH {EV} SELECT id, concat('Crash: ', raw_data) AS crash, concat('u', user_id, ' upgraded (', id, ' -> ', "
       "id + 1, ')') AS package, CASE WHEN event_type = 'error' THEN concat(raw_data, ' [+', user_id + 1, ' suppressed]') "
       "ELSE raw_data END AS journal FROM (SELECT id, user_id, event_type, concat('unit=u', user_id, ' priority=3 msg=', "
       "event_type) AS raw_data FROM ev)")
def event_texts(spark, folder):
    e = sample_events(spark, folder)
    user, n = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("id")
    raw = lambda *extra: text.journal_raw(user, F.lit(3), F.col("event_type"), *extra)
    return e.select("id", F.concat(F.lit("Crash: "), raw()).alias("crash"), text.package_summary(
        user, F.lit("upgraded"), n.cast("string"), (n + 1).cast("string")).alias("package"),
        raw(F.when(F.col("event_type") == "error", F.col("user_id") + 1).otherwise(0)).alias("journal"))
