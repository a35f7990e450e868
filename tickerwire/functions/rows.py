"""Per-row evaluation helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **fields: Column) -> DataFrame:
    """Adds ``fields`` through a one-row ``inline`` per input row.

    Filters on columns of a plain projection are pushed below it with the
    column's expression substituted in, so an expensive field (a regex over
    a whole page) would be evaluated by the filter and again by the
    projection, and chains of such fields grow the plan multiplicatively.
    Filters on generator output stay above the generator: the fields are
    computed once per row and later predicates read the result."""
    packed = F.struct(*[e.alias(k) for k, e in fields.items()])
    return df.select("*", F.inline(F.array(packed)))
