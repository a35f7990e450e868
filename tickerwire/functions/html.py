"""HTML element selection with regular expressions (H1 and helpers).

A selector (tag, attribute, value) compiles to one literal regex, so each
executor compiles it once per task. Where the first match holds another
element of the same tag, the element's end comes from the page's structural
index (``functions.structure``), so it ends at its own closing tag; pages
without such a match never build the index.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerwire.functions.rows import compute_once
from tickerwire.functions.structure import inner, matching, with_elements
from tickerwire.functions.text import collapse_ws

# A character reference: decimal, hexadecimal or named; old names and numbers
# also without the semicolon.
_REFERENCE = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};?)"
# In an attribute, a name without its semicolon counts only where no letter,
# digit or equals sign follows.
_REFERENCE_IN_VALUE = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31}(?:;|(?![A-Za-z0-9=])))"
# Names: the standard's own table, with the semicolon where a name must have
# one. Numbers 128-159 stand for Windows-1252.
_WINDOWS = {b: bytes([b]).decode("cp1252") for b in range(128, 160) if b not in (129, 141, 143, 144, 157)}
_OLD_NAMES = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"

# comments, scripts and styles hide markup-like text that must not match
_HIDDEN = (r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>"
           r"|<style(?:\s[^>]*)?>.*?</style\s*>")

_SPECIAL = set("\\.^$|?*+()[]{}")


def escape(text: str) -> str:
    """Escape regex metacharacters only (valid in both Java regex and RE2)."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in text)


def _tag(tag: str) -> str:
    """Tag name matched in any letter case, as an HTML parser does."""
    return "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else escape(ch) for ch in tag)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_hidden(html) -> Column:
    """Remove comments, <script> and <style> blocks."""
    return F.regexp_replace(_c(html), _HIDDEN, "")


def _attr_regex(attr: str, value: str) -> str:
    v = escape(value)
    if attr == "class":   # any token of the class list
        val = r"(?:[^\"']*\s)?" + v + r"(?:\s[^\"']*)?"
    else:
        val = v
    return r"\s" + _tag(attr) + r"\s*=\s*(?:[\"']" + val + r"[\"']|" + v + r"(?=[\s>/]))"


def open_tag_regex(tag: str, attr: str | None = None, value: str | None = None) -> str:
    """Regex of an opening tag of ``tag`` having ``attr`` = ``value``."""
    t = _tag(tag)
    if attr is None:
        return "<" + t + r"(?:\s[^>]*)?>"
    return "<" + t + r"(?:\s[^>]*)?" + _attr_regex(attr, value or "") + r"[^>]*>"


def element_regex(tag: str, attr: str | None = None, value: str | None = None,
                  outer: bool = False) -> str:
    """Regex whose group 1 is the first matching element: its inner HTML, or
    its outer HTML when ``outer``."""
    open_ = open_tag_regex(tag, attr, value)
    close = "</" + _tag(tag) + r"\s*>"
    if outer:
        return "(?s)(" + open_ + ".*?" + close + ")"
    return "(?s)" + open_ + "(.*?)" + close


# alternatives of one output: (condition or None, tag, attribute, value)
Choices = Sequence[tuple[Column | None, str, str | None, str | None]]


def by_case(choices: Choices, value: Callable[[str, str | None, str | None], Column]) -> Column:
    """``value`` of the selector whose condition holds first."""
    expr, last = None, None
    for when, tag, attr, val in choices:
        v = value(tag, attr, val)
        if when is None:
            last = v
        else:
            expr = F.when(when, v) if expr is None else expr.when(when, v)
    return last if expr is None else expr if last is None else expr.otherwise(last)


def with_first(df: DataFrame, html: str, fields: dict[str, Choices], outer: Sequence[str] = ()) -> DataFrame:
    """H1 over a table: adds, per entry of ``fields``, the first element that
    the row's choice selects (a class matches any of its tokens): its inner
    markup, or with its tags for the names in ``outer``; null when absent or
    empty. ``html`` holds no hidden blocks (``strip_hidden``)."""
    first = {k: f"_first_{k}" for k in fields}
    df = compute_once(df, **{first[k]: F.nullif(by_case(c, lambda *s, k=k: F.regexp_extract(
        F.col(html), element_regex(*s, outer=k in outer), 1)), F.lit("")) for k, c in fields.items()})
    # an element that holds a tag of its own name ends later than the first closing tag
    deep = {k: f"_deep_{k}" for k in fields}
    inner_tag = lambda k: lambda tag, attr, val: F.col(first[k]).rlike(
        ("(?s)^<[^>]*>.*?<" if k in outer else "<") + _tag(tag) + r"[\s>/]")
    df = compute_once(df, **{deep[k]: F.coalesce(by_case(c, inner_tag(k)), F.lit(False)) for k, c in fields.items()})
    names = sorted({tag for c in fields.values() for _, tag, *_ in c})
    df = df.withColumn("_deep_html", F.when(reduce(or_, [F.col(d) for d in deep.values()]), F.col(html)))
    df = with_elements(df, "_deep_html", names, "_page")
    hit = {k: f"_hit_{k}" for k in fields}
    df = compute_once(df, **{hit[k]: F.when(F.col(deep[k]), by_case(c, lambda tag, attr, val: F.expr(
        f"get({matching('_page', tag, open_tag_regex(tag, attr, val))}, 0)"))) for k, c in fields.items()})

    def whole(k: str) -> Column:
        text = F.expr(inner("_page", hit[k]))
        if k in outer:
            text = F.concat(F.expr(f"get(_page.tags, {hit[k]}.open)"), text, F.lit("</"), F.col(f"{hit[k]}.name"), F.lit(">"))
        return F.nullif(text, F.lit(""))
    df = compute_once(df, **{k: F.when(F.col(deep[k]), whole(k)).otherwise(F.col(first[k])) for k in fields})
    return df.drop("_deep_html", "_page", *first.values(), *deep.values(), *hit.values())


def strip_tags(fragment) -> Column:
    return F.regexp_replace(_c(fragment), r"<[^>]*>", "")


def sql_text(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _decode(in_value: bool) -> Column:
    """Lambda (SQL) that decodes every character reference of a text once,
    left to right (``&amp;lt;`` gives ``&lt;``). It is one constant string, so
    a plan that decodes often is still built quickly."""
    point = ("cast(if(rlike(n, '^#[xX]'), conv(regexp_extract(n, '^#[xX]([0-9a-fA-F]+)', 1), 16, 10), "
             "regexp_extract(n, '^#([0-9]+)', 1)) as int)")
    by_number = (f"coalesce(try_element_at(from_json({sql_text(json.dumps(_WINDOWS))}, 'map<string,string>'), cast({point} as string)), "
                 f"if({point} BETWEEN 1 AND 1114111 AND NOT {point} BETWEEN 55296 AND 57343, "
                 f"decode(unhex(lpad(hex({point}), 8, '0')), 'UTF-32'), '\\uFFFD'))")
    # the name itself, else in texts the longest old name that it begins with
    old = "''" if in_value else f"regexp_extract(n, {sql_text(_OLD_NAMES)}, 0)"
    found = f"transform(array(n, nullif({old}, '')), k -> try_element_at(from_json({sql_text(json.dumps(html5))}, 'map<string,string>'), k))"
    by_name = f"get(transform(array({found}), v -> coalesce(v[0], concat(v[1], substr(n, length({old}) + 1)), concat('&', n))), 0)"
    reference = sql_text(_REFERENCE_IN_VALUE if in_value else _REFERENCE)
    refs = f"transform(regexp_extract_all(x, {reference}, 0), r -> get(transform(array(substr(r, 2)), n -> if(startswith(n, '#'), {by_number}, {by_name})), 0))"
    return F.expr(f"x -> CASE WHEN contains(x, '&') THEN array_join(zip_with(split(x, {reference}, -1), "
                  f"concat(array(''), {refs}), (g, c) -> concat(c, g)), '') ELSE x END")


def decode_all(texts: Column, in_value: bool = False) -> Column:
    """The texts of an array with their character references decoded, as in
    an element's text or (``in_value``) an attribute's value."""
    return F.call_function("transform", texts, _decode(in_value))


def decode_entities(s, in_value: bool = False) -> Column:
    """One text with its character references decoded."""
    return F.get(decode_all(F.array(_c(s)), in_value), 0)


def text_of(fragment) -> Column:
    """Text content of an HTML fragment, character references decoded, with
    whitespace collapsed; null when the text is empty."""
    return F.nullif(collapse_ws(decode_entities(strip_tags(fragment))), F.lit(""))


def texts_of(fragments: dict[str, str]) -> dict[str, Column]:
    """``text_of`` for several columns with one decoding expression: name ->
    text, to be computed in one projection."""
    decoded = decode_all(F.array(*[strip_tags(c) for c in fragments.values()]))
    return {name: F.nullif(collapse_ws(F.get(decoded, i)), F.lit("")) for i, name in enumerate(fragments)}


# the value of an href attribute, with its quotes if it has any
_HREF = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def attribute_values(raw: Column) -> Column:
    """An array of attribute values as a parser reads them: unquoted and
    decoded."""
    return decode_all(F.call_function("transform", raw, F.expr("r -> regexp_replace(r, '^[\"\\']|[\"\\']$', '')")), in_value=True)


def first_href(fragment) -> Column:
    """The href of the first anchor that has one; null when none has."""
    return F.get(first_hrefs(F.array(_c(fragment))), 0)


def first_hrefs(fragments: Column) -> Column:
    """Per markup of an array, the href of its first anchor that has one."""
    return attribute_values(F.transform(fragments, lambda f: F.nullif(F.regexp_extract(f, _HREF, 1), F.lit(""))))


def anchor_hrefs(html) -> Column:
    """Every anchor's href value in document order."""
    return attribute_values(F.regexp_extract_all(_c(html), F.lit(_HREF), F.lit(1)))
