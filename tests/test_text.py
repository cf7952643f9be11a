"""Severities, text normalisation and evidence truth tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from opsweave.functions import evidence, severity, text


def one(spark, expr_of, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([values], schema).select(expr_of(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize("p, s", [(0, "critical"), (3, "critical"), (4, "warning"), (5, "info"), (6, "info"), (99, "info")])
def test_priority(spark, p, s):
    assert one(spark, severity.priority_to_severity, p) == s


@pytest.mark.parametrize("a, b, s", [("info", "warning", "warning"), ("critical", "warning", "critical"), ("info", "info", "info")])
def test_severity_max(spark, a, b, s):
    assert one(spark, severity.severity_max, a, b) == s


@pytest.mark.parametrize("message, expected", [
    ("worker[7] gave up", "worker[*] gave up"),
    ("page 0x0 then 0xA9f", "page 0x* then 0x*"),
    ("job 00000000-1111-2222-3333-444444444444 is late", "job <UUID> is late"),
    ("job 00000000-1111-2222-3333-44444444444 is late", "job *-*-*-*-* is late"),
    ("slot 1000 and slot 999 of 123456", "slot * and slot 999 of *"),
    ("[1:2:0101/000000.5:WARN:pool.cc] low", "[*:WARN:pool.cc] low"),
    ("\n\t ends \r", "ends"),
    ("x9999 9999x 9999 9999", "x9999 9999x * *"),
    ("", ""),
])
def test_normalize(spark, message, expected):
    assert one(spark, text.normalize_message, message) == expected


def test_fingerprint(spark):
    fp = lambda m: one(spark, text.fingerprint, "kern", "pump.service", m)
    assert fp("valve shut") == hashlib.sha256(b"kern:pump.service:valve shut").hexdigest()[:16]
    assert fp("pump[1] stalls at 0xf") == fp("pump[22] stalls at 0x0e") != fp("pump stalls")
    assert len(fp("x")) == 16


def test_summary(spark):
    assert one(spark, text.normalize_summary, "Disk  [12] FULL at 0xff, naïve! 12345") == "disk full at naïve"
    assert one(spark, text.summary_fingerprint, "A b") == hashlib.sha256(b"a b").hexdigest()[:16]


@pytest.mark.parametrize("raw, expected", [("unit=a msg=hello msg=x", "hello msg=x"), ("plain", "plain"), ("msg=" + "a" * 200, "a" * 120)])
def test_fallback(spark, raw, expected):
    assert one(spark, text.fallback_summary, raw) == expected


@pytest.mark.parametrize("summary, raw, expected", [("s", "r", "s"), ("", "raw text", "raw "), (None, "raw text", "raw ")])
def test_display(spark, summary, raw, expected):
    df = spark.createDataFrame([(summary, raw)], "s string, r string")
    assert df.select(text.display_text(F.col("s"), F.col("r"), 4).alias("x")).first()["x"] == expected


def test_builders(spark):
    df = spark.range(1)
    lit = F.lit
    got = df.select(
        text.package_summary(lit("linux"), lit("upgraded"), lit("1"), lit("2")),
        text.package_summary(lit("x"), lit("upgraded"), lit("1"), lit(None).cast("string")),
        text.package_summary(lit("x"), lit("removed"), lit(None).cast("string"), lit(None).cast("string")),
        text.trend_summary(lit("cpu"), lit(-2.345), lit(50.0)),
        text.batch_line(lit(1), lit("info"), lit("s"), lit("raw")),
        text.wrap_untrusted(lit("{a}")), text.exe_basename(lit("/usr/bin/foo")), text.exe_basename(lit(None).cast("string")),
        text.journal_raw(lit("u"), lit(3), lit("m"), lit(2)), text.journal_raw(lit("u"), lit(3), lit("m"), lit(0)),
    ).first()
    assert list(got) == ["linux upgraded (1 -> 2)", "x upgraded (1)", "x removed",
                         "cpu falling at 2.35/hour (current: 50.0)", "[id=1] [info] s: raw",
                         "<log_content>\n{a}\n</log_content>", "foo", "unknown",
                         "unit=u priority=3 msg=m [+2 suppressed]", "unit=u priority=3 msg=m"]


@pytest.mark.parametrize("line, header", [
    ("\t", True), ("  ## Morning", True), ("##### Disks and fans", True), ("####### seven marks", False), ("#Fans", False),
    ("#", False), ("# ", True), ("--", False), (" -----", True), ("=-=", True), ("== ==", False), ("**", False),
    ("*****  ", True), ("**bold** claim", False), ("1. a claim", False), ("a # b", False)])
def test_header(spark, line, header):
    assert one(spark, evidence.is_header_line, line) is header


@pytest.mark.parametrize("line, tag", [
    ("fan loud [Source: sensor 4]", "sensor 4"), ("[SOURCE:kernel] oom", "kernel"), ("[sOuRcE:\tsmart\t]", "smart"),
    ("[Source: a:b, c] and [Source: d]", "a:b, c"), ("[Source:\t]", ""), ("[Source:]", None), ("[ Source: x]", None),
    ("Source: x", None), ("[Source: x", None), ("[Source: [x]]", "[x")])
def test_tag(spark, line, tag):
    assert one(spark, evidence.extract_source_tag, line) == tag


MIXED = "\n".join([
    "## Night report", "\t", "Fan 2 is loud [Source: sensor]", "Memory high", "---", "Swap grew [source: b]", "[Source: ]",
    "Nobody knows why", "=====", "Link is back [Source: net]  "])


def test_validate(spark):
    df = spark.createDataFrame([(1, MIXED), (2, ""), (3, "a [Source: x]\r\n\r\nb [Source: y]\n")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in evidence.validate_evidence(df).collect()}
    assert got[1]["all_sourced"] is False and len(got[1]["lines"]) == 10
    assert got[2]["all_sourced"] is True and got[2]["lines"] == []
    assert got[3]["all_sourced"] is True and [line["source"] for line in got[3]["lines"]] == ["x", None, "y"]
    table = evidence.evidence_table(df, ["doc_id"])
    assert table.where("doc_id = 1 and not sourced").count() == 2
    again = df.select("doc_id", evidence.reformat_evidence(F.col("text"), "LLM analysis").alias("text"))
    assert [r["x"] for r in again.select(evidence.all_sourced(F.col("text")).alias("x")).collect()] == [True] * 3
    assert "Memory high [Source: LLM analysis]\n---" in again.where("doc_id = 1").first()["text"]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_is_exact(spark, digits):
    rng = random.Random(digits)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.5, 1.5, 2.5, 2.675, 100.35, 147.35, 1e-9, 0.95, 0.995, 9.995, 99.95, 12345678.125, -0.3,
              -2.5, 1e13, 4503599627370497.5]
    values += [rng.randrange(10 ** 6) / 1000 for _ in range(300)] + [rng.random() * 10 ** rng.randrange(9) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.fixed(F.col("v"), digits).alias("t"))
    assert [(r["v"], r["t"]) for r in df.collect()] == [(v, f"{v:.{digits}f}") for v in values]
