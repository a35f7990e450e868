"""Company dimension lookups: J3, J4, J5 (+F12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerwire.sources.registry import hosts_df


def with_company(df: DataFrame, companies: DataFrame) -> DataFrame:
    """Attach industry and sector by upper-cased ticker; a ticker without
    a profile gets nulls. ``companies``: (ticker, industry, sector), one row
    per ticker.

    No broadcast hint: the company table grows with the universe, so the
    size-checked choice is left to Spark (autoBroadcastJoinThreshold, and
    AQE re-plans to a broadcast when the runtime size is small)."""
    dim = companies.select(F.upper("ticker").alias("_ct"), "industry", "sector")
    return (df.join(dim, F.upper(df["ticker"]) == dim["_ct"], "left").drop("_ct"))


def first_names(symbols: DataFrame) -> DataFrame:
    """Per symbol the name of its first listing (lowest ``position``).
    min_by is a partial aggregate: a hot symbol is combined map-side."""
    return (symbols.groupBy("symbol")
            .agg(F.min_by("name", "position").alias("name")))


def with_name(tickers: DataFrame, symbols: DataFrame) -> DataFrame:
    """Company name of each ticker by exact symbol match, first match
    wins, null when absent. ``symbols``: (symbol, name, position)."""
    firsts = first_names(symbols)
    return tickers.join(firsts, tickers["ticker"] == firsts["symbol"], "left").drop("symbol")


def source_translation(df: DataFrame, col: str, to_host: bool = True,
                       out: str | None = None) -> DataFrame:
    """Source name -> host (or host -> name), exact case; null when
    absent. The registry is a fixed 16-row literal, so it is broadcast."""
    reg = hosts_df(df.sparkSession)
    key, val = ("source", "host") if to_host else ("host", "source")
    out = out or ("host" if to_host else "source_name")
    reg = reg.select(F.col(key).alias("_k"), F.col(val).alias(out))
    return df.join(F.broadcast(reg), df[col] == reg["_k"], "left").drop("_k")
