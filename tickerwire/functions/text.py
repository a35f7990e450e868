"""String column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerwire.sources.registry import NAME_STOPWORDS

# Fixed value: the characters Python's str.split() treats as whitespace,
# written so that Java regex and RE2 read the class the same way.
WHITESPACE_CLASS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}"
                    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def querify(s) -> Column:
    """every single space becomes '+'."""
    return F.replace(_c(s), F.lit(" "), F.lit("+"))


def query_string(ticker, source) -> Column:
    """``TICKER+source+stock+articles``."""
    return F.concat(_c(ticker), F.lit("+"), _c(source), F.lit("+stock+articles"))


def company_query(name, source) -> Column:
    """name tokens without the stop tokens, joined by '+', then
    ``+source+stock+news``. Null when the name is null."""
    tokens = F.split(_c(name), " ")
    kept = F.filter(tokens, lambda t: ~t.isin(*NAME_STOPWORDS))
    return F.concat(F.array_join(kept, "+"), F.lit("+"), _c(source), F.lit("+stock+news"))


def collapse_ws(s) -> Column:
    """runs of whitespace become one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(s), WHITESPACE_CLASS + "+", " "))


def strip_all_ws(s) -> Column:
    """remove every whitespace character."""
    return F.regexp_replace(_c(s), WHITESPACE_CLASS + "+", "")


def store_key(ticker, source) -> Column:
    """``ticker+source`` (null if either part is null)."""
    return F.concat(_c(ticker), F.lit("+"), _c(source))


def word_count(text) -> Column:
    """F8: number of pieces of a single-space split (empty pieces count),
    i.e. the number of spaces plus one; counted without building the array
    of pieces."""
    t = _c(text)
    return (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("bigint") + 1
