"""Small text helpers shared by rules, fixes and reports."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F


def contains_any(col: Column, *needles: str) -> Column:
    return reduce(or_, [col.contains(n) for n in needles])


def strip(col: Column) -> Column:
    """Drop leading and trailing blanks and control characters."""
    return F.regexp_replace(col, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def location(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line)


def line_of_location(loc: Column) -> Column:
    """The number after the last colon; with no colon the first digit run; else 0."""
    after_colon = strip(F.substring_index(F.regexp_replace(loc, r":+\z", ""), ":", -1))
    signed = F.when(after_colon.rlike(r"\A[+-]?[0-9]+\z"), after_colon)
    digits = F.regexp_extract(loc, r"[0-9]+", 0)
    picked = F.when(loc.contains(":"), signed).otherwise(digits)
    return F.coalesce(picked.try_cast("int"), F.lit(0))


def assigned_name(line: Column) -> Column:
    """First word directly left of an ``=``, null when there is none."""
    return F.nullif(F.regexp_extract(line, r"\b(\w+)\s*=", 1), F.lit(""))


def shorten_literal(literal: Column, redact: bool = False) -> Column:
    """A literal as shown in a description: 27 characters and an ellipsis at most.

    ``redact`` masks the value, for sinks that must not carry secrets.
    """
    if redact:
        return F.when(literal.isNotNull(), F.lit('"***"'))
    return F.when(F.length(literal) > 30, F.concat(F.substr(literal, F.lit(1), F.lit(27)), F.lit("..."))).otherwise(literal)


def escape_markup(col: Column) -> Column:
    """Escape the five characters that HTML and XML treat as markup."""
    for raw, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#39;"),
    ):
        col = F.replace(col, F.lit(raw), F.lit(entity))
    return col
