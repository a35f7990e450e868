"""URL predicates and rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerwire.sources.registry import HOSTS, homepage_patterns


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host_labels(url) -> Column:
    """Text between the first '://' and the next '/', split on '.'."""
    authority = F.split_part(F.split_part(_c(url), F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return F.split(authority, r"\.")


def is_of_source(url, source) -> Column:
    """Some host label equals the source (case-sensitive). A URL without
    '://' has no labels and is not of any source."""
    return _c(url).contains("://") & F.array_contains(host_labels(url), _c(source))


def is_homepage(url, source, patterns: dict[str, list[str]] | None = None) -> Column:
    """P5: unanchored regex search of the source's homepage patterns; an
    unknown source is never a homepage. The patterns are literals, so each
    compiles once per task."""
    patterns = homepage_patterns() if patterns is None else patterns
    u, s = _c(url), _c(source)
    expr = None
    for name, rxs in patterns.items():
        hit = None
        for rx in rxs:
            m = u.rlike(rx)
            hit = m if hit is None else (hit | m)
        expr = F.when(s == name, hit) if expr is None else expr.when(s == name, hit)
    if expr is None:
        return F.lit(False)
    return expr.otherwise(F.when(u.isNotNull(), F.lit(False)))


# scheme ':' '//' authority, as a URL parser splits them
_SCHEME_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)"


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _SCHEME_AUTHORITY, 1))


# host part of an authority: after any userinfo, a bracketed IPv6 literal or
# everything up to the port
_HOST = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)"


def url_hostname(url) -> Column:
    """Lower-cased host: userinfo, port and IPv6 brackets removed; '' when
    absent."""
    authority = F.regexp_extract(_c(url), _SCHEME_AUTHORITY, 2)
    host = F.regexp_extract(authority, _HOST, 1)
    return F.lower(F.regexp_replace(host, r"^\[|\]$", ""))


def registry_host(source) -> Column:
    """Host registered for a source name (exact case), else null."""
    mapping = F.create_map(*[F.lit(x) for pair in HOSTS for x in pair])
    return F.try_element_at(mapping, _c(source))


def site_of(url) -> Column:
    """Source whose registered host is the URL's, else null."""
    mapping = F.create_map(*[F.lit(x) for source, host in HOSTS for x in (host, source)])
    return F.try_element_at(mapping, url_hostname(url))


def is_valid_url(url, source, curious: bool | Column = False) -> Column:
    """http(s) scheme, non-empty host, and host equal to the source's
    registered host unless ``curious``."""
    host = url_hostname(url)
    structural = url_scheme(url).isin("http", "https") & (host != "")
    cur = curious if isinstance(curious, Column) else F.lit(bool(curious))
    return structural & (cur | F.coalesce(host == registry_host(source), F.lit(False)))


def unwrap_link(href) -> Column:
    """drop the 7-character redirect prefix, one leading '/', and add
    'http://' unless the rest starts with 'http'. Empty results are null."""
    rest = F.substring(_c(href), 8, 1 << 30)
    rest = F.when(rest.startswith("/"), F.substring(rest, 2, 1 << 30)).otherwise(rest)
    full = F.when(rest.startswith("http"), rest).otherwise(F.concat(F.lit("http://"), rest))
    return F.when(F.substring(_c(href), 8, 1 << 30) != "", full)


def symbol_from_href(href) -> Column:
    """text between the first '/' and the last ':' (greedy), or null."""
    return F.nullif(F.regexp_extract(_c(href), "/(.*):", 1), F.lit(""))
