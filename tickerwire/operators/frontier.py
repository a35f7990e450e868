"""Work list and URL frontier: J1, J2, D16 (first query wins), U1, L1, L3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerwire.functions.text import company_query, querify, query_string
from tickerwire.sources.registry import VALID_SOURCES


def build_queries(tickers: DataFrame, sources: list[str] | None = None, depth: int = 1,
                  names: DataFrame | None = None) -> DataFrame:
    """J1 (+F2, F3): one query per (ticker, source); with depth > 1 and a
    company name, a name query is placed before the ticker query.

    ``tickers``: (ticker[, ticker_pos]), repeats give their queries again;
    ``names``: (ticker, name), of several names of a ticker the least counts
    (see ``company.with_name``); a blank name gives no query. The source list
    is configuration sized, so the fan-out is an ``explode`` of a literal
    array: no join.

    Output: ticker, source, string, kind ('name' | 'ticker'), ticker_pos,
    source_pos, sub — (ticker_pos, source_pos, sub) is the run order.
    """
    names_list = VALID_SOURCES if sources is None else list(sources)
    if "ticker_pos" not in tickers.columns:
        tickers = tickers.withColumn("ticker_pos", F.lit(None).cast("bigint"))
    src = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("name"))
                    for i, s in enumerate(names_list)])
    fan = tickers.select("ticker", "ticker_pos", F.explode(src).alias("s"))
    fan = fan.select("ticker", "ticker_pos", F.col("s.pos").alias("source_pos"),
                     F.col("s.name").alias("source"))
    if depth > 1 and names is not None:
        known = names.filter(F.trim("name") != "").groupBy("ticker").agg(F.min("name").alias("name"))
        fan = fan.join(known, "ticker", "left")
        by_name = company_query(F.col("name"), F.col("source"))
    else:
        by_name = F.lit(None).cast("string")
    cands = F.array(
        F.struct(F.lit(0).alias("sub"), F.lit("name").alias("kind"), by_name.alias("string")),
        F.struct(F.lit(1).alias("sub"), F.lit("ticker").alias("kind"),
                 query_string(F.col("ticker"), F.col("source")).alias("string")),
    )
    q = fan.select("ticker", "source", "ticker_pos", "source_pos",
                   F.explode(F.filter(cands, lambda c: c["string"].isNotNull())).alias("q"))
    return q.select("ticker", "source", F.col("q.string").alias("string"),
                    F.col("q.kind").alias("kind"), "ticker_pos", "source_pos",
                    F.col("q.sub").alias("sub"))


def own_queries(queries: DataFrame) -> DataFrame:
    """J1 for queries of the user's own: (ticker, source, string[, query_pos])
    in place of the generated work list. A null source asks for no particular
    site. Words are joined as F1 joins them; ``query_pos`` (a tie where it is
    missing) gives the run order."""
    pos = F.col("query_pos") if "query_pos" in queries.columns else F.lit(0)
    return queries.select("ticker", "source", querify("string").alias("string"), F.lit("own").alias("kind"),
                          pos.cast("bigint").alias("ticker_pos"), F.lit(0).alias("source_pos"), F.lit(0).alias("sub"))


def drop_parsed(candidates: DataFrame, parsed: DataFrame, keep_key: bool = False, stored: bool = False) -> DataFrame:
    """Remove candidate URLs already parsed for the (upper-cased)
    ticker; repeats inside the candidate list stay (bag semantics). With
    ``stored``, ``parsed`` is a bucketed store (``sources.parsed_store``): its
    tickers are upper case and it is read where it lies, without an exchange.
    ``keep_key`` keeps the join key column ``_t`` (upper ticker) so a later
    step keyed by (``_t``, url) reuses this join's partitioning."""
    ticker = F.col("ticker") if stored else F.upper("ticker")
    seen = parsed.select(ticker.alias("_t"), "url")
    if not stored:   # a plain list may hold a URL many times: combine before the shuffle
        seen = seen.distinct()
    out = candidates.withColumn("_t", F.upper("ticker")).join(seen, ["_t", "url"], "left_anti")
    return out if keep_key else out.drop("_t")


def first_query_only(candidates: DataFrame, order_cols: list[str]) -> DataFrame:
    """A URL met by several queries of one ticker is kept only under
    the first of them (repeats inside that query stay). The window is keyed
    by (upper ticker, url) — the ``_t`` column of ``drop_parsed`` when
    present — so a hot ticker spreads over its distinct URLs."""
    key = "_t" if "_t" in candidates.columns else None
    w = Window.partitionBy(key or F.upper("ticker"), "url")
    first = F.min(F.struct(*[F.col(c) for c in order_cols])).over(w)
    out = (candidates.withColumn("_first", first)
           .filter(F.struct(*[F.col(c) for c in order_cols]) == F.col("_first"))
           .drop("_first"))
    return out.drop("_t") if key else out


def ticker_universe(*lists: DataFrame, distinct: bool = False) -> DataFrame:
    """Concatenation of ticker lists; duplicates kept unless asked."""
    out = reduce(lambda a, b: a.unionByName(b), lists)
    return out.distinct() if distinct else out


def shuffle_rows(df: DataFrame, seed: int = 0) -> DataFrame:
    """L1: a random permutation (range-partitioned sort on a seeded key)."""
    return df.orderBy(F.rand(seed))


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """L3: first n rows in the given order (top-k per partition, then merge)."""
    return df.orderBy(*order).limit(n)
