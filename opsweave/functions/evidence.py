"""Checks that every claim in a generated text names its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.functions.text import rstrip, strip

# Line breaks, the citation tag, heading-like lines, default citation.
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
SOURCE_TAG = r"(?iU)\[Source:\s*([^\]]+)\]"
HEADER_LINE = r"(?U)^(\s*#{1,6}\s+.*|\s*[-=]{3,}\s*|\s*\*{3,}\s*|\s*)$"
DEFAULT_SOURCE = "LLM analysis"


def lines_of(text: Column) -> Column:
    """Lines without their breaks; no empty last line after a closing break."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_header_line(line: Column) -> Column:
    return line.rlike(HEADER_LINE)


def extract_source_tag(line: Column) -> Column:
    """Content of the first source tag, null if there is none."""
    return F.when(line.rlike(SOURCE_TAG), strip(F.regexp_extract(line, SOURCE_TAG, 1)))


def evidence_lines(text: Column) -> Column:
    """array<struct<text, source>>; heading-like lines carry no source."""
    def one(raw: Column) -> Column:
        line = rstrip(raw)
        return F.struct(line.alias("text"),
                        F.when(~is_header_line(line), extract_source_tag(line)).alias("source"))
    return F.transform(lines_of(text), one)


def all_sourced(text: Column) -> Column:
    """True when every content line has a source tag, also when there is no content line."""
    return F.forall(F.transform(lines_of(text), rstrip),
                    lambda line: is_header_line(line) | line.rlike(SOURCE_TAG))


def reformat_evidence(text: Column, fallback: str = DEFAULT_SOURCE) -> Column:
    """Add the fallback tag to content lines that have none."""
    def one(raw: Column) -> Column:
        line = rstrip(raw)
        return F.when(is_header_line(line) | line.rlike(SOURCE_TAG), line).otherwise(
            F.concat(line, F.lit(f" [Source: {fallback}]")))
    return F.array_join(F.transform(lines_of(text), one), "\n")


def validate_evidence(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `lines` and `all_sourced`."""
    return df.withColumns({"lines": evidence_lines(F.col(text)), "all_sourced": all_sourced(F.col(text))})


def evidence_table(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line: keys, line_no, text, source, is_header, sourced."""
    line = F.col("line")
    return (df.select(*keys, F.posexplode(F.transform(lines_of(F.col(text)), rstrip)).alias("line_no", "line"))
            .select(*keys, "line_no", line.alias("text"), is_header_line(line).alias("is_header"))
            .withColumn("source", F.when(~F.col("is_header"), extract_source_tag(F.col("text"))))
            .withColumn("sourced", F.col("is_header") | F.col("source").isNotNull()))
