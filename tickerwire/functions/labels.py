"""Price-move class labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerwire.sources.registry import PRICE_NOT_FOUND


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def price_class(p0, p1) -> Column:
    """+1 if the price rose from p0 to p1, -1 if it fell, 0 if flat;
    the not-found class when either price is missing (or not a number)."""
    return F.coalesce(F.signum(_c(p1) - _c(p0)).try_cast("int"), F.lit(PRICE_NOT_FOUND))


def horizon_class(p_t, p0) -> Column:
    """the price move truncated toward zero to an integer; null when a
    price is missing or the move is not a number."""
    return (_c(p_t) - _c(p0)).try_cast("int")
