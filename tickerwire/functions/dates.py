"""Publish-date finder over free text.

One alternation regex finds every date-shaped substring; the first of them
that is a real calendar date is the result, so a false match (``13/45/2019``)
does not hide a later date. Supported shapes, months in any letter case:

    yyyy-MM-dd, yyyy/MM/dd   (also the prefix of an ISO timestamp)
    June 5, 2020             full or short month, with or without the comma
    Jun. 5, 2020             "Sept" counts as a short month
    5 June 2020              full or short month, with or without a comma
    6/5/2020                 (US order)

A day may carry its ordinal ending (``June 5th, 2020``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerwire.functions.rows import compute_once

# English month names; a month is known by its first three letters.
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]

_MONTH = r"\b(?:" + "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS) + r"|Sept)\b\.?"
_DAY = r"[0-9]{1,2}(?:st|nd|rd|th)?"

YEAR_FIRST = r"[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}"
MONTH_FIRST = _MONTH + r"\s+" + _DAY + r",?\s+[0-9]{4}"
DAY_FIRST = _DAY + r"\s+" + _MONTH + r",?\s+[0-9]{4}"
SLASH_US = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"

DATE_PATTERN = "(?i)" + "|".join([YEAR_FIRST, MONTH_FIRST, DAY_FIRST, SLASH_US])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def date_texts(text) -> Column:
    """Every date-shaped substring, in order."""
    return F.regexp_extract_all(_c(text), F.lit(DATE_PATTERN), F.lit(0))


def parse_date_text(m) -> Column:
    """DATE of one date-shaped text; null when there is no such day."""
    m = _c(m)
    day = F.regexp_extract(m, r"(?:^|[^0-9])([0-9]{1,2})(?![0-9])", 1)
    return (F.when(m.rlike("^[0-9]{4}"), F.try_to_date(F.replace(m, F.lit("/"), F.lit("-")), "yyyy-MM-dd"))
            .when(F.contains(m, F.lit("/")), F.try_to_date(m, "M/d/yyyy"))
            .otherwise(F.try_to_date(F.concat_ws("-", F.right(m, F.lit(4)), _month_number(m).cast("string"), day), "yyyy-M-d")))


def _month_number(m: Column) -> Column:
    short = F.lower(F.regexp_extract(m, r"([A-Za-z]{3})", 1))
    return F.array_position(F.array(*[F.lit(x[:3].lower()) for x in MONTHS]), short)


def first_date(texts: Column) -> Column:
    """The first real date among date-shaped texts, or null."""
    return F.get(F.filter(F.transform(texts, parse_date_text), lambda d: d.isNotNull()), 0)


def publish_date(text) -> Column:
    """F9 as a single column expression."""
    return first_date(date_texts(text))


def with_publish_date(df: DataFrame, text, out: str = "publish_date") -> DataFrame:
    """adds ``out``, the first date found in ``text`` (DATE, null if
    none), computed once per row (``compute_once``)."""
    return compute_once(df, **{out: publish_date(text)})
