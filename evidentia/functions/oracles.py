"""Row-level security predicates: each gives pass, skip or violation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, SKIP, VIOLATION = "pass", "skip", "violation"
#: Signs of database errors in a body. Fixed values.
DATABASE_ERRORS = (
    r"(?i)you have an error in your SQL syntax",
    r"\bORA-\d{5}\b",
    r"(?i)SQLSTATE\[[A-Z0-9]+\]",
    r"(?i)syntax error at or near [\"']",
    r"(?i)unclosed quotation mark after the character string",
    r"(?i)(?:SQL Native Client|ODBC SQL Server Driver|OLE DB Provider)",
)
#: Signs of stack traces and exceptions. Fixed values.
STACK_TRACES = (
    r"(?i)traceback \(most recent call last\)",
    r"(?i)stack[\s_-]*trace",
    r"(?i)uncaught\s+\w*exception",
    r"\.exs?:\d+(?::\d+)?",
    r"(?:ArgumentError|FunctionClauseError|CaseClauseError|KeyError):",
)


def _first(body: Column, patterns: tuple[str, ...]) -> Column:
    """The number, from one, of the first pattern found in a body; 0 for none."""
    out = F.lit(0)
    for i, p in reversed(list(enumerate(patterns, 1))):
        out = F.when(body.rlike(p), i).otherwise(out)
    return out


def no_500(status: Column, low: int = 500, high: int = 599, missing: str = SKIP) -> Column:
    """A status within the bounds; a missing one is skipped, or what `missing` says."""
    return F.when(status.isNull(), missing).when(status.between(low, high), VIOLATION).otherwise(PASS)


def no_reflection(body: Column, content_type: Column, payload: Column, any_case: bool = False, unknown: str = SKIP) -> Column:
    """A payload that stands verbatim, or in any case, in a page; other content passes, empty payloads are skipped. Content of no type is skipped, or looked at with unknown="check"."""
    kind = F.lower(F.split_part(content_type, F.lit(";"), F.lit(1)))
    page = F.trim(kind).isin("text/html", "application/xhtml+xml")
    held = F.contains(F.lower(body), F.lower(payload)) if any_case else F.contains(body, payload)
    untyped = content_type.isNull() if unknown == SKIP else F.lit(False)
    return F.when(untyped | body.isNull() | (F.coalesce(payload, F.lit("")) == ""), SKIP).when(F.coalesce(page, F.lit(True)) & held, VIOLATION).otherwise(PASS)


def injection_signal(body: Column) -> Column:
    return F.when(body.isNull(), SKIP).when(_first(body, DATABASE_ERRORS) > 0, VIOLATION).otherwise(PASS)


def sensitive_leak(body: Column) -> Column:
    return F.when(body.isNull(), SKIP).when(_first(body, STACK_TRACES) > 0, VIOLATION).otherwise(PASS)


def canonical_encoding(given: Column, accepted: Column, encoded: Column) -> Column:
    """An accepted input must be what it is encoded to again; a rejected one passes."""
    return F.when(~accepted, PASS).when(given.eqNullSafe(encoded), PASS).otherwise(VIOLATION)


def bounded_length(value: Column, most: int, unit: str) -> Column:
    """A value (text or bytes) of more than `most` bytes, codepoints or graphemes. Of the latter two, values over a MiB and those that are not UTF-8 are skipped."""
    if unit == "bytes":
        return F.when(value.isNull(), SKIP).when(F.octet_length(value) > most, VIOLATION).otherwise(PASS)
    text = F.when(F.is_valid_utf8(value.cast("string")) & (F.octet_length(value) <= 1 << 20), value.cast("string"))
    sizes = {"codepoints": F.length(text), "graphemes": F.regexp_count(text, F.lit(r"\X"))}
    return F.when(text.isNull(), SKIP).when(sizes[unit] > most, VIOLATION).otherwise(PASS)


def state_growth(before: Column, after: Column, settled: Column, most: Column, tolerance: Column) -> Column:
    """Growth beyond a bound, or what is not given back; a state that never settled is skipped."""
    return F.when(before.isNull() | after.isNull(), SKIP).when(after - before > most, VIOLATION).when(settled.isNull(), SKIP).when(settled - before > tolerance, VIOLATION).otherwise(PASS)


def terminal_safety(output: Column) -> Column:
    """Control sequences other than colours, tabs and line breaks; output that is not UTF-8 is a violation too."""
    text = output.cast("string")
    bare = F.regexp_replace(text, r"\x1b\[[0-9;]*m", "")
    return F.when(output.isNull(), SKIP).when(~F.is_valid_utf8(text), VIOLATION).when(bare.rlike(r"[\x00-\x08\x0b-\x1f\x7f\u0080-\u009f]"), VIOLATION).otherwise(PASS)


def replay_verdict(violations: Column, skips: Column) -> Column:
    """Confirmed by a violation, inconclusive by a skip, else refuted."""
    return F.when(violations > 0, "confirmed").when(skips > 0, "inconclusive").otherwise("refuted")
