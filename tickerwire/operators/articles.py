"""Article jobs: P1-P3, P8-P10 and the composite jobs C1-C3."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerwire.functions.rows import compute_once
from tickerwire.functions.text import word_count
from tickerwire.functions.urls import is_homepage, is_of_source, is_valid_url, site_of
from tickerwire.operators.extract import has_title_selector, result_links, with_clean_html, with_fields
from tickerwire.operators.asof import label_articles
from tickerwire.operators.company import with_company
from tickerwire.operators.frontier import build_queries, drop_parsed, first_query_only, own_queries
from tickerwire.operators.stats import source_stats
from tickerwire.options import Options
from tickerwire.sources.files import latest_versions

# Node attributes in alphabetical order (the export order).
NODE_COLUMNS = ["ArticleName", "Industry", "NewsSource", "PublishDate", "Sector",
                "Ticker", "Url"]


def normalise_keys(df: DataFrame) -> DataFrame:
    """Ticker upper case, source lower case."""
    return df.withColumn("ticker", F.upper("ticker")).withColumn("source", F.lower("source"))


def sorted_columns(df: DataFrame) -> DataFrame:
    """Attributes in alphabetical order (the export header order)."""
    return df.select(sorted(df.columns))


def to_nodes(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """The node attributes, alphabetically ordered: the seven, less
    those that the options leave out, and the class where they ask for it
    (``label_nodes``). The source of a query without one is the site that the
    article was found on."""
    source = F.coalesce("source", "site") if "site" in df.columns else F.col("source")
    own = {"ArticleName": F.col("title"), "Classification": opts.classification and F.col("classification"),
           "Industry": opts.industry and F.col("industry"), "NewsSource": F.lower(source), "PublishDate": F.col("publish_date"),
           "Sector": opts.sector and F.col("sector"), "Ticker": F.upper("ticker"), "Url": F.col("url")}
    return df.select(*[c.alias(name) for name, c in own.items() if c is not False])


def label_nodes(nodes: DataFrame, prices: DataFrame, **how) -> DataFrame:
    """C4 on built articles (before ``to_nodes``): ``classification`` by the
    prices of the upper-cased ticker at the publish date and after; articles
    without a date get the not-found class. ``how``: see ``label_articles``."""
    timed = nodes.withColumns({"_ticker": F.upper("ticker"), "_at": F.col("publish_date").cast("timestamp_ntz")})
    ticks = prices.withColumns({"_ticker": F.upper("ticker"), "_at": F.col("ts").cast("timestamp_ntz")})
    return label_articles(timed, ticks, by="_ticker", ts="_at", **how).drop("_ticker", "_at", "t0", "t1")


def require_date(df: DataFrame, col: str = "publish_date") -> DataFrame:
    """Keep rows with a publish date."""
    return df.filter(F.col(col).isNotNull())


def min_length(df: DataFrame, text: str = "article", n: int = 30) -> DataFrame:
    """P9 (+F8): keep rows whose word count is at least n."""
    return df.filter(word_count(text) >= n)


def productive_only(df: DataFrame, nodes: DataFrame,
                    keys: tuple[str, ...] = ("ticker", "source", "string")) -> DataFrame:
    """P10: keep rows of queries that built at least one node (semi-join to
    the distinct query keys of ``nodes``)."""
    k = list(keys)
    return df.join(nodes.select(*k).distinct(), k, "left_semi")


QUERY = ("ticker", "source", "string")


def _same_query(left: DataFrame, queries: DataFrame, keys: tuple[str, ...] = QUERY, how: str = "inner") -> DataFrame:
    """Join on a query's key, whose source may be null."""
    named = queries.select(*[F.col(c).alias(f"_q_{c}") if c in keys else F.col(c) for c in queries.columns])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) if c == "source" else F.col(c) == F.col(f"_q_{c}") for c in keys])
    return left.join(named, on, how).drop(*[f"_q_{c}" for c in keys])


def candidate_urls(queries: DataFrame, results: DataFrame, parsed: DataFrame | None = None,
                   order_cols: tuple[str, ...] = ("ticker_pos", "source_pos", "sub"), stored: bool = False,
                   curious: bool = False) -> DataFrame:
    """Result links of each query (H4, F4, P11), kept when of the
    query's source (P4), minus URLs parsed before for the ticker (J2), and a
    URL met by several queries of one ticker only under the first (D16).

    ``queries``: (ticker, source, string, *order_cols); ``results``:
    (ticker, source, string, html) — the stored result page of a query.
    ``stored``: ``parsed`` is a bucketed store. ``curious`` keeps links of
    every site (P7); without it a query without a source keeps none. Output:
    query columns + (link_pos, url)."""
    # links come out of the (wide) result pages first, in the scan stage;
    # only the narrow link rows meet the query list in the shuffle join
    res = results.select("ticker", "source", "string", "html")
    links = result_links(res, "html").drop("href")
    if not curious:
        links = links.filter(is_of_source("url", "source"))
    q = queries.select("ticker", "source", "string", *order_cols)
    links = _same_query(links, q)
    if parsed is not None:
        links = drop_parsed(links, parsed, keep_key=True, stored=stored)
    return first_query_only(links, list(order_cols))


def build_nodes(candidates: DataFrame, pages: DataFrame, companies: DataFrame, opts: Options = Options(),
                keep_rejected: bool = False, at: str | None = None, version: str | None = None) -> DataFrame:
    """For each non-homepage candidate URL (not P5), look the page up
    (S10), extract title (H2) and date (H3), attach company fields (J3) and
    apply the optional checks (P6/P7, P8, P9). Title and date are
    extracted once per distinct (url, source). The URL set meets the page
    store without a hint: the planner broadcasts it when it is small enough.

    ``candidates``: (ticker, source, url, ...); ``pages``: (url, html), with a
    ``version`` column where the store keeps several pages of a URL: the last
    one at or before ``at`` is used, the newest without ``at``. A URL gives one
    node whatever the store holds. ``companies``: (ticker, industry, sector).
    Output: candidate columns + site, title, publish_date, industry, sector,
    reject_reason; ``site`` is the query's source, for queries without one the
    source registered for the URL's host. Only accepted rows (null reason)
    unless ``keep_rejected``, which keeps one row per candidate, homepages
    included."""
    c = candidates.withColumn("site", F.coalesce("source", site_of("url")))
    c = c.withColumn("_home", F.coalesce(is_homepage("url", "site"), F.lit(False)))
    if not keep_rejected:
        c = c.filter(~F.col("_home"))
    bad_url = ~is_valid_url("url", "site", opts.curious) if opts.validate_url else F.lit(False)
    c = c.withColumn("_fetch", ~F.col("_home") & ~bad_url)

    # Extraction runs once per distinct (url, source): a URL found by many
    # queries (a hot copy) is fetched and parsed once, and only the narrow
    # extracted fields travel back to the candidate rows.
    wanted = c.filter("_fetch").select("url", F.coalesce("site", F.lit("")).alias("_site")).distinct()
    if version:
        pages = latest_versions(pages, wanted, at, version)
    p = pages.select(F.col("url").alias("_purl"), F.col("html").alias("_html"))
    got = wanted.join(p, wanted["url"] == p["_purl"]).drop("_purl")
    got = with_clean_html(got, "_html", "_clean")
    got = with_fields(got, "_clean", "_html", "_site", title="title", date="publish_date",
                      body="_body" if opts.length_check else None)
    fields = ["url", "_site", "title", "publish_date", F.lit(True).alias("_found")]
    if opts.length_check:
        fields.append(F.coalesce(word_count("_body"), F.lit(0)).alias("_words"))
    # one page of a URL counts; the join below needs this partitioning anyway
    got = got.select(*fields, F.xxhash64("_html").alias("_page_hash"))
    own = [x for x in got.columns if x not in ("url", "_site", "_page_hash")]
    got = got.groupBy("url", "_site").agg(F.min_by(F.struct(*own), "_page_hash").alias("_got")).select("url", "_site", "_got.*")

    j = c.withColumn("_site", F.coalesce("site", F.lit(""))).join(got, ["url", "_site"], "left").drop("_site")
    reason = (F.when(F.col("_home"), F.lit("homepage"))
              .when(~F.col("_fetch"), F.lit("invalid_url"))
              .when(F.col("_found").isNull(), F.lit("fetch"))
              .when(~F.coalesce(has_title_selector("site"), F.lit(False)), F.lit("no_selector")))
    if opts.date_checker:
        reason = reason.when(F.col("publish_date").isNull(), F.lit("no_date"))
    if opts.length_check:
        reason = reason.when(F.col("_words") < opts.min_length, F.lit("short"))
    j = compute_once(j, reject_reason=reason).drop("_home", "_fetch", "_found", "_words")
    j = with_company(j, companies)
    return j if keep_rejected else j.filter(F.col("reject_reason").isNull())


def query_outcomes(outcomes: DataFrame, keys: tuple[str, ...] = QUERY) -> DataFrame:
    """A8 in one pass over ``build_nodes(..., keep_rejected=True)``: URLs
    found (every candidate) and nodes built (accepted) per query."""
    return (outcomes.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("urls_found"),
                 F.count_if(F.col("reject_reason").isNull()).alias("nodes_built")))


def run_batch(tickers: DataFrame, sources: list[str], results: DataFrame, pages: DataFrame,
              companies: DataFrame, parsed: DataFrame | None = None,
              opts: Options = Options(), names: DataFrame | None = None, queries: DataFrame | None = None,
              stored: bool = False) -> dict[str, DataFrame]:
    """One run over all queries — those of ``build_queries``, or
    ``queries`` of the user's own — as lazy DataFrames for the sinks:
    nodes (S5), URLs to mark parsed — every candidate of a productive query
    (P10, D7), per-query yield (A8) and per-source stats of productive
    queries (A1, D8). All derive from one row-per-candidate ``outcomes``
    frame; persist it when several sinks are written."""
    queries = build_queries(tickers, sources, opts.depth, names) if queries is None else own_queries(queries)
    cands = candidate_urls(queries, results, parsed, stored=stored, curious=opts.curious)
    outcomes = build_nodes(cands, pages, companies, opts, keep_rejected=True)
    nodes = outcomes.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    yld = query_outcomes(outcomes)
    productive = yld.filter(F.col("nodes_built") > 0)
    stats = source_stats(productive.select("source", F.col("urls_found").alias("num_urls"),
                                           F.col("nodes_built").alias("num_nodes")))
    parsed_new = parsed_rows(outcomes, productive)
    return {"queries": queries, "candidates": cands, "outcomes": outcomes, "nodes": nodes,
            "yield": yld, "stats": stats, "parsed": parsed_new}


def parsed_rows(outcomes: DataFrame, productive: DataFrame) -> DataFrame:
    """URLs to mark parsed: every candidate of a productive query."""
    return _same_query(outcomes, productive.select(*QUERY), how="left_semi").select(
        F.upper("ticker").alias("ticker"), F.lower(F.coalesce("source", "site")).alias("source"), "url")


def write_run(run: dict[str, DataFrame], store_path: str, parsed_path: str, stats_path: str,
              version: int) -> DataFrame:
    """C3 sinks: S5 (append nodes), S6 (append parsed URLs), S7 (stats of
    this run added to the previous version, written as ``version``).

    The per-candidate outcomes feed all three, so they are checkpointed once
    into the shared ``spark.checkpoint.dir`` (reliable: it survives executor
    loss and cuts the lineage back to the page scans); every sink reads the
    checkpointed rows. Returns the new accumulated stats."""
    from tickerwire.session import checkpoint_dir
    from tickerwire.sources import files
    spark = run["outcomes"].sparkSession
    checkpoint_dir(spark)
    outcomes = run["outcomes"].checkpoint(eager=True)
    nodes = to_nodes(outcomes.filter(F.col("reject_reason").isNull()))
    files.append_articles(nodes, store_path)
    yld = query_outcomes(outcomes).filter(F.col("nodes_built") > 0)
    files.append_parsed(parsed_rows(outcomes, yld), parsed_path)
    run_stats = source_stats(yld.select("source", F.col("urls_found").alias("num_urls"),
                                        F.col("nodes_built").alias("num_nodes")))
    if version > 0:
        prev = spark.read.parquet(f"{stats_path.rstrip('/')}/v={version - 1}")
        run_stats = source_stats(prev.unionByName(run_stats))
    files.write_stats(run_stats, stats_path, version)
    return spark.read.parquet(f"{stats_path.rstrip('/')}/v={version}")
