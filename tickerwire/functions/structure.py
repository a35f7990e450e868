"""Elements of a page as intervals: the structural index behind H1 and H4-H6.

Regular expressions find tags but not which closing tag ends which element.
``with_elements`` lists the tags of the wanted names once per page, in order,
with the text between them. Per name, a running count of opening minus closing
tags gives every tag its level; sorted by (name, level, place) an opening tag
is followed by the closing tag that ends it. An element is then an interval of
tag places, and containment an interval test, whatever the nesting: the
elements inside another are one slice of the list, those of one name a filter
on it. What is never closed ends with the element around it.

The index is a projection in the scan stage, without a shuffle and without
Python. Running counts are taken in blocks of ``_BLOCK`` tags, so the work is
near linear in the tags of a page; an element's markup is put together from
the pieces between its tags, so it costs its own length. Void elements must
not be among the names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerwire.functions.rows import compute_once

_BLOCK = 64

# Tags as (place, name, sign): 1 opens, -1 closes.
_SIGNED = ("transform(_tags, (t, i) -> named_struct('place', i, 'name', lower(regexp_extract(t, '^</?([A-Za-z0-9]+)', 1)), "
           "'sign', if(startswith(t, '</'), -1, 1)))")
_SUM = "aggregate({}, 0, (a, s) -> a + s)"


def _levels(names: Sequence[str]) -> str:
    """Tags as (name, level, place, sign): the level of an opening tag counts
    itself, that of a closing tag the element it ends."""
    block = f"slice(m, k * {_BLOCK} + 1, {_BLOCK})"
    blocks = (f"CASE WHEN size(m) = 0 THEN slice(array(m), 1, 0) ELSE "
              f"transform(sequence(0, cast((size(m) - 1) / {_BLOCK} as int)), k -> {block}) END")
    totals = "transform(bs, b -> " + _SUM.format("transform(b, x -> x.sign)") + ")"
    level = "base + " + _SUM.format("transform(slice(b, 1, i + 1), y -> y.sign)") + " + if(x.sign < 0, 1, 0)"
    one = f"transform(b, (x, i) -> named_struct('name', x.name, 'level', {level}, 'place', x.place, 'sign', x.sign))"
    based = f"get(transform(array({_SUM.format('slice(totals, 1, k)')}), base -> {one}), 0)"
    per_name = f"get(transform(array({blocks}), bs -> get(transform(array({totals}), totals -> flatten(transform(bs, (b, k) -> {based}))), 0)), 0)"
    listed = ", ".join(f"'{n}'" for n in names)
    return f"flatten(transform(array({listed}), w -> get(transform(array(filter(_signed, x -> x.name = w)), m -> {per_name}), 0)))"


# Opening tags with the place of the closing one (the number of tags where
# there is none); closing tags stand for themselves with an empty name.
_PAIRED = """transform(_levels, (x, i) -> named_struct('open', x.place, 'name', if(x.sign > 0, x.name, ''),
  'close', get(transform(array(get(_levels, i + 1)), y ->
    if(y.name = x.name AND y.level = x.level AND y.sign < 0, y.place, size(_levels))), 0)))"""


def is_flat(html: str, names: Sequence[str]) -> Column:
    """Whether no element of ``names`` (outer to inner) holds one of its own or
    an outer name and all are closed: pairs of the innermost name are taken
    out of the list of tag names, then those of the next one, and nothing is
    left. Such pages need no index."""
    mark = rf"(?i)<(/?(?:{'|'.join(names)}))(?=[\s>/])"
    left = F.lower(F.array_join(F.regexp_extract_all(F.col(html), F.lit(mark), F.lit(1)), " "))
    for name in reversed(names):
        left = F.regexp_replace(left, rf"(?<![^ ]){name} /{name}(?: |$)", "")
    return left == ""


def with_elements(df: DataFrame, html: str, names: Sequence[str], out: str = "_page") -> DataFrame:
    """Adds ``out``: a struct of ``tags``, ``gaps`` (the text before each tag
    and after the last) and ``elements`` (open, name, close), one per tag, of
    the named tags in ``html``, which has no hidden blocks (``strip_hidden``).
    Null markup gives null arrays."""
    mark = rf"(?is)</?(?:{'|'.join(names)})(?=[\s>/])[^>]*>"
    # each step is fenced: the next one reads it many times
    steps = [{"_tags": F.regexp_extract_all(F.col(html), F.lit(mark), F.lit(0)), "_gaps": F.split(F.col(html), mark, -1)},
             {"_signed": F.expr(_SIGNED)}, {"_levels": F.expr(f"sort_array({_levels(names)})")},
             {out: F.struct(F.col("_tags").alias("tags"), F.col("_gaps").alias("gaps"), F.expr(f"sort_array({_PAIRED})").alias("elements"))}]
    for step in steps:
        df = compute_once(df, **step)
    return df.drop("_tags", "_gaps", "_signed", "_levels")


def inner(page: str, e: str) -> str:
    """SQL: the markup between the tags of element ``e``."""
    return (f"array_join(zip_with(slice({page}.gaps, {e}.open + 2, {e}.close - {e}.open), "
            f"concat(slice({page}.tags, {e}.open + 2, {e}.close - {e}.open - 1), array('')), (g, t) -> concat(g, t)), '')")


def inside(page: str, e: str, name: str) -> str:
    """SQL: the elements of a name inside element ``e``, in document order."""
    return (f"transform(filter(slice({page}.elements, {e}.open + 2, {e}.close - {e}.open - 1), x -> x.name = '{name}'), "
            f"x -> named_struct('open', x.open, 'name', x.name, 'close', least(x.close, {e}.close)))")


def matching(page: str, name: str, open_tag: str) -> str:
    """SQL: the elements of a name whose opening tag matches a pattern."""
    quoted = open_tag.replace("\\", "\\\\").replace("'", "\\'")
    return f"filter({page}.elements, x -> x.name = '{name}' AND rlike(get({page}.tags, x.open), '{quoted}'))"
