r"""Text expressions: normalisation, fingerprints, display text, event templates.

Word characters are spelled out as letters, numbers and underscore because the
regex shorthands `\w` and `\b` mean different sets in different engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Volatile parts of log text and what replaces them, in order.
_WORD = r"[\p{L}\p{N}_]"
BROWSER_PREFIX = r"\[\p{Nd}+:\p{Nd}+:\p{Nd}+/\p{Nd}+\.\p{Nd}+:"
PID = r"\[\p{Nd}+\]"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
HEX = r"0x[0-9a-fA-F]+"
LONG_NUMBER = rf"(?=\p{{Nd}})(?<!{_WORD})\p{{Nd}}{{4,}}+(?!{_WORD})"
MESSAGE_RULES = (
    (BROWSER_PREFIX, "[*:"),
    (PID, "[*]"),
    (UUID, "<UUID>"),
    (HEX, "0x*"),
    (LONG_NUMBER, "*"),
)
SUMMARY_RULES = (
    (PID, ""),
    (HEX, ""),
    (LONG_NUMBER, ""),
)
# Every character that counts as white space.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + (
    "\u2028\u2029\u202f\u205f\u3000")
_BLANK = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # all but the plain one
PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]+"
# Runs of white space other than a single plain blank, which needs no replacing.
BLANK_RUN = rf" [ {_BLANK}]+|[{_BLANK}][ {_BLANK}]*"


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends (SQL trim takes only blanks by itself)."""
    return F.trim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def _apply(rules, text: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, text)


def normalize_message(message: Column) -> Column:
    """Replace process ids, addresses, UUIDs and long numbers by fixed marks."""
    return strip(_apply(MESSAGE_RULES, message))


def fingerprint(source: Column, unit: Column, message: Column) -> Column:
    """16 hex digits naming a message up to its volatile parts."""
    return F.substring(F.sha2(F.concat(source, F.lit(":"), unit, F.lit(":"), normalize_message(message)), 256), 1, 16)


def normalize_summary(summary: Column) -> Column:
    """Lower-case words of a summary with numbers, punctuation and extra blanks gone."""
    words = F.regexp_replace(_apply(SUMMARY_RULES, F.lower(summary)), PUNCTUATION, "")
    return strip(F.regexp_replace(words, BLANK_RUN, " "))


def summary_fingerprint(summary: Column) -> Column:
    return F.substring(F.sha2(normalize_summary(summary), 256), 1, 16)


def display_text(summary: Column, raw: Column, n: int) -> Column:
    """The summary if there is one, else the first `n` characters of the raw text."""
    return F.coalesce(F.nullif(summary, F.lit("")), F.substring(F.coalesce(raw, F.lit("")), 1, n))


def fallback_summary(raw: Column, n: int = 120) -> Column:
    """Text after the first `msg=`, else the raw text; cut to `n` characters."""
    at = F.locate("msg=", raw)
    return F.when(at > 0, F.substring(raw, at + 4, F.lit(n))).otherwise(F.substring(raw, 1, n))


def cut(text: Column, n: int) -> Column:
    """Hard cut to `n` characters, the last three being dots."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def fixed(number: Column, digits: int) -> Column:
    """A number as text with a fixed number of decimals: its exact binary value rounded, ties to even.

    Whether a number lies above or below the middle between two texts is told without a rounding error:
    it is split into two halves whose products with a small integer are exact.
    """
    x = F.abs(number.cast("double"))
    power = 10 ** digits
    below = F.floor(x * power)  # may be one too large where the product is rounded up; the rest says so
    wide = x * 134217729.0  # 2 ** 27 + 1 cuts a double into halves
    high = wide - (wide - x)
    rest = (high * (2 * power) - (2 * below + 1)) + (x - high) * (2 * power)
    units = F.when(rest > 0, below + 1).when(rest < 0, below).otherwise(below + below % 2)
    shown = units.cast("string") if digits == 0 else F.concat(
        F.floor(units / power).cast("string"), F.lit("."), F.lpad((units % power).cast("string"), digits, "0"))
    signed = F.concat(F.when(number < 0, "-").otherwise(""), shown)
    return F.when(x < 2.0 ** 40, signed).otherwise(F.format_string(f"%.{digits}f", number.cast("double")))


def package_summary(name: Column, action: Column, old: Column, new: Column) -> Column:
    """`name action (old -> new)`, showing only the versions that are known."""
    versions = F.concat_ws(" -> ", old, new)
    return F.concat(name, F.lit(" "), action,
                    F.when(versions != "", F.concat(F.lit(" ("), versions, F.lit(")"))).otherwise(""))


def journal_raw(unit: Column, priority: Column, message: Column, suppressed: Column | None = None) -> Column:
    """`unit=.. priority=.. msg=..`, with the number of suppressed repeats if any."""
    text = F.concat(F.lit("unit="), unit, F.lit(" priority="), priority.cast("string"), F.lit(" msg="), message)
    if suppressed is None:
        return text
    return F.concat(text, F.when(suppressed > 0, F.concat(F.lit(" [+"), suppressed.cast("string"),
                                                          F.lit(" suppressed]"))).otherwise(""))


def trend_summary(metric: Column, slope: Column, value: Column) -> Column:
    return F.concat(metric, F.when(slope > 0, " rising at ").otherwise(" falling at "),
                    fixed(F.abs(slope), 2), F.lit("/hour (current: "), fixed(value, 1), F.lit(")"))


def batch_line(event_id: Column, severity: Column, source: Column, raw: Column) -> Column:
    """One prompt line per event: `[id=1] [warning] source: text`."""
    return F.concat(F.lit("[id="), event_id.cast("string"), F.lit("] ["), severity, F.lit("] "),
                    source, F.lit(": "), F.substring(F.coalesce(raw, F.lit("")), 1, 200))


def wrap_untrusted(text: Column, tag: str = "log_content") -> Column:
    """Untrusted text on its own lines inside a labelled tag; braces stay as they are."""
    return F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>"))


def exe_basename(exe: Column) -> Column:
    return F.element_at(F.split(F.coalesce(exe, F.lit("unknown")), "/"), -1)
