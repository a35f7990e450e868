"""Registered queries: one per operator of the inventory, on driver tables.

Each callable takes (spark, sf_dir) and returns a lazy DataFrame whose
column names equal those of the matching oracle SQL in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerwire.functions import dates, html, labels, text, urls
from tickerwire.operators import articles, asof, company, extract, frontier, stats
from tickerwire.functions.rows import compute_once
from tickerwire.options import Options
from tickerwire.plans import derived as dv
from tickerwire.sources import files, parsed_store, registry
from tickerwire.session import per_session, table

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

# interval between the two prices of a label on the driver's sparse ticks
LABEL_INTERVAL = "1 day"
# age from which those ticks count as no price
MAX_AGE = "36 hours"
# label sources of host names in the driver's page URLs
PAGE_LABELS = ["example", "com", "net", "org", "blog", "www", "m"]


def register(key: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[key] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---- shared inputs and runs ------------------------------------------------

@per_session
def _queries_depth2(spark, d):
    names = company.with_name(dv.companies(spark, d).select("ticker"), dv.symbols(spark, d))
    return frontier.build_queries(dv.companies(spark, d).select("ticker", "ticker_pos"),
                                  dv.NEWS_SOURCES, depth=2, names=names)


@per_session
def _batch(spark, d, opts: Options = Options()):
    c = dv.companies(spark, d)
    return articles.run_batch(c.select("ticker", "ticker_pos"), dv.NEWS_SOURCES,
                              dv.search_results(spark, d), dv.news_pages(spark, d),
                              c, dv.parsed_before(spark, d), opts)


@per_session
def _batch_depth2(spark, d):
    """A run with a name query before each ticker query (D16 decides)."""
    c = dv.companies(spark, d)
    names = company.with_name(c.select("ticker"), dv.symbols(spark, d))
    return articles.run_batch(c.select("ticker", "ticker_pos"), dv.NEWS_SOURCES, dv.search_results_by_name(spark, d),
                              dv.news_pages(spark, d), c, dv.parsed_before(spark, d), Options(depth=2), names)


@per_session
def _own_batch(spark, d):
    """A run of the users' own queries; links of any site are taken."""
    return articles.run_batch(None, [], dv.own_results(spark, d), dv.news_pages(spark, d), dv.companies(spark, d),
                              dv.parsed_before(spark, d), Options(curious=True), queries=dv.own_queries(spark, d))


@per_session
def _labels(spark, d):
    return asof.label_articles(dv.publications(spark, d), dv.price_ticks(spark, d),
                               interval=LABEL_INTERVAL, tick_order="tick_id")


@per_session
def _fresh_labels(spark, d):
    return asof.label_articles(dv.publications(spark, d), dv.price_ticks(spark, d),
                               interval=LABEL_INTERVAL, tick_order="tick_id", max_age=MAX_AGE)


@per_session
def _horizon(spark, d):
    lab = _labels(spark, d)
    return lab.select("event_id", "ticker", "t0", F.col("t1").alias("t6"),
                      labels.horizon_class("t1", "t0").alias("classification"))


def _day(c: str):
    """DATE rendered yyyy-MM-dd (the export form; identical in every engine)."""
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _nodes(spark, d, opts: Options = Options()):
    n = articles.to_nodes(_batch(spark, d, opts)["nodes"])
    return n.withColumn("PublishDate", F.date_format("PublishDate", "yyyy-MM-dd"))


def _documents_labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id", "left").withColumnRenamed("quality", "classification") \
        .withColumnRenamed("text", "article")


# ---- S: sources and sinks ---------------------------------------------------

@register("s1_sources")
def s1_sources(spark, d):
    """Valid sources with the number of stored news pages of each."""
    n = dv.news_pages(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"))
    s = F.broadcast(registry.sources_df(spark))
    return (s.join(n, "source", "left")
            .select("source", "position", F.coalesce("n_pages", F.lit(0)).alias("n_pages")))


@register("s4_stats_json")
def s4_stats_json(spark, d):
    """Per-day stats documents (JSON keyed by source) parsed to rows."""
    daily = dv.runs(spark, d).groupBy("run", "source").agg(
        F.sum("num_urls").cast("bigint").alias("num_urls"),
        F.sum("num_nodes").cast("bigint").alias("num_nodes"))
    docs = files.stats_document(daily, ["run"])
    return files.parse_stats_docs(docs, "value").withColumn("run", F.date_format("run", "yyyy-MM-dd"))


@register("s9_payload")
def s9_payload(spark, d):
    return files.survey_payload(articles.to_nodes(_batch(spark, d)["nodes"]))


@register("s10_page_scan")
def s10_page_scan(spark, d):
    cands = _batch(spark, d)["candidates"].select("ticker", "source", "url", "link_pos")
    scanned = files.page_scan(cands, dv.news_pages(spark, d).select("url", "html"))
    return scanned.select("ticker", "source", "url", "link_pos",
                          F.col("html").isNotNull().alias("has_page"), "reject_reason")


@register("s10_versions")
def s10_versions(spark, d):
    cands = _batch(spark, d)["candidates"].select("ticker", "source", "url", "link_pos")
    scanned = files.page_scan(cands, dv.page_versions(spark, d), at=dv.VERSION_AT, version="fetched_at")
    return scanned.select("ticker", "source", "url", "link_pos", F.md5("html").alias("html_md5"), "reject_reason")


@register("s11_nested")
def s11_nested(spark, d):
    path = _scratch_dir(spark, "nested-articles")
    files.write_nested_articles(articles.to_nodes(_batch(spark, d)["nodes"]), path)
    return files.read_nested_articles(spark, path).withColumn("PublishDate", F.date_format("PublishDate", "yyyy-MM-dd"))


@register("s12_nested_urls")
def s12_nested_urls(spark, d):
    path = _scratch_dir(spark, "nested-urls")
    files.write_nested_urls(_batch(spark, d)["parsed"], path)
    return files.read_nested_urls(spark, path)


# ---- P: projections and predicates -------------------------------------------

@register("p1_nodes")
def p1_nodes(spark, d):
    return _nodes(spark, d)


@register("p2_normalise")
def p2_normalise(spark, d):
    c = dv.companies(spark, d).select(F.lower("ticker").alias("ticker"),
                                      F.upper("sector").alias("source"), "ticker_pos")
    return articles.normalise_keys(c)


@register("p4_is_of_source")
def p4_is_of_source(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    ex = p.select("page_id", "url", F.explode(registry.sources_array(PAGE_LABELS)).alias("source"))
    return ex.select("page_id", "source", urls.is_of_source("url", "source").alias("is_of_source"))


@register("p5_is_homepage")
def p5_is_homepage(spark, d):
    n = dv.news_pages(spark, d)
    return n.select("page_id", "source", "url",
                    urls.is_homepage("url", "source").alias("is_homepage"))


def _url_samples(spark, d):
    n = dv.news_pages(spark, d).select("page_id", "source", "url")
    raw = table(spark, d, "pages").select("page_id", "url")
    raw = raw.join(n.select("page_id", "source"), "page_id")
    rel = dv.search_results(spark, d).select("page_id", "source", F.concat(
        F.lit("http://"), F.split_part(F.col("html"), F.lit('href="/url?q=/'), F.lit(2))).alias("u"))
    rel = rel.select("page_id", "source", F.split_part("u", F.lit('"'), F.lit(1)).alias("url"))
    return (n.withColumn("kind", F.lit("news"))
            .unionByName(raw.withColumn("kind", F.lit("raw")))
            .unionByName(rel.withColumn("kind", F.lit("relative"))))


@register("p6_valid_url")
def p6_valid_url(spark, d):
    s = _url_samples(spark, d)
    return s.select("page_id", "kind", "source", urls.url_scheme("url").alias("scheme"),
                    urls.url_hostname("url").alias("hostname"),
                    urls.is_valid_url("url", "source", False).alias("valid"),
                    urls.is_valid_url("url", "source", True).alias("valid_curious"))


@register("p8_require_date")
def p8_require_date(spark, d):
    n = extract.extract_date(dv.news_pages(spark, d))
    return articles.require_date(n).select("page_id", "source", _day("publish_date"))


@register("p9_min_length")
def p9_min_length(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return articles.min_length(docs, "text", 100).select(
        "doc_id", "source", text.word_count("text").alias("n_words"))


@register("p10_productive")
def p10_productive(spark, d):
    run = _batch(spark, d)
    kept = articles.productive_only(run["candidates"], run["nodes"])
    return articles.normalise_keys(kept).select("ticker", "source", "url")


# ---- J: joins -------------------------------------------------------------------

@register("j1_build_queries")
def j1_build_queries(spark, d):
    return _queries_depth2(spark, d).select("ticker", "source", "string", "kind")


@register("j2_anti_join")
def j2_anti_join(spark, d):
    links = extract.result_links(dv.search_results(spark, d))
    links = links.select("page_id", "ticker", "source", "link_pos", "url")
    return frontier.drop_parsed(links, dv.parsed_before(spark, d))


@register("j2_bucketed_store")
def j2_bucketed_store(spark, d):
    """J2 against the bucketed store: the parsed URLs are appended to it in two
    parts, and the run's links meet it where it lies."""
    base = _scratch_dir(spark, "parsed-store")
    name = "parsed_" + base.rsplit("-", 1)[1]
    parsed_store.attach(spark, name, base, 16)
    before = dv.parsed_before(spark, d)
    even = F.pmod(F.xxhash64("url"), F.lit(2)) == 0
    parsed_store.append(before.filter(even), name, 16)
    parsed_store.append(before.filter(~even), name, 16)
    links = extract.result_links(dv.search_results(spark, d)).select("page_id", "ticker", "source", "link_pos", "url")
    return frontier.drop_parsed(links, spark.table(name), stored=True)


@register("j3_company")
def j3_company(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", dv.letters(F.col("o_custkey")).alias("ticker"))
    return company.with_company(o, dv.companies(spark, d).select("ticker", "industry", "sector"))


@register("j4_first_match")
def j4_first_match(spark, d):
    return company.with_name(dv.companies(spark, d).select("ticker"), dv.symbols(spark, d))


@register("j5_translate")
def j5_translate(spark, d):
    n = dv.news_pages(spark, d).select("page_id", "source", urls.url_hostname("url").alias("url_host"))
    n = company.source_translation(n, "source", to_host=True, out="host")
    n = company.source_translation(n, "url_host", to_host=False, out="source_of_host")
    return n.select("page_id", "source", "host", "url_host", "source_of_host")


@register("j6_asof")
def j6_asof(spark, d):
    return asof.asof_price(dv.publications(spark, d), dv.price_ticks(spark, d),
                           tick_order="tick_id", out="price")


@register("j7_asof_horizon")
def j7_asof_horizon(spark, d):
    return asof.asof_price(dv.publications(spark, d), dv.price_ticks(spark, d),
                           tick_order="tick_id", offset=LABEL_INTERVAL, out="price")


@register("j6_asof_fresh")
def j6_asof_fresh(spark, d):
    return asof.asof_price(dv.publications(spark, d), dv.price_ticks(spark, d),
                           tick_order="tick_id", max_age=MAX_AGE, out="price")


@register("j7_asof_horizon_fresh")
def j7_asof_horizon_fresh(spark, d):
    return asof.asof_price(dv.publications(spark, d), dv.price_ticks(spark, d), tick_order="tick_id",
                           offset=LABEL_INTERVAL, max_age=MAX_AGE, out="price")


# ---- A: aggregations ------------------------------------------------------------------

@register("a1_source_stats")
def a1_source_stats(spark, d):
    return stats.source_stats(dv.runs(spark, d))


def _r6(df, *cols):
    """Doubles rounded to 6 places (the oracle does the same), so both
    engines agree to the bit whatever their summation order."""
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@register("a2_accuracy")
def a2_accuracy(spark, d):
    return _r6(stats.source_accuracy(stats.source_stats(dv.runs(spark, d))), "accuracy")


@register("a3_class_counts")
def a3_class_counts(spark, d):
    return stats.class_counts(_horizon(spark, d))


@register("a4_source_counts")
def a4_source_counts(spark, d):
    return stats.source_counts(_documents_labelled(spark, d))


@register("a5_mean_len")
def a5_mean_len(spark, d):
    return _r6(stats.mean_article_len(_documents_labelled(spark, d)), "mean_len")


@register("a6_mean_len_by_source")
def a6_mean_len_by_source(spark, d):
    return _r6(stats.mean_len_by_source(_documents_labelled(spark, d)), "mean_len")


@register("a7_histogram")
def a7_histogram(spark, d):
    return _r6(stats.class_histogram(_horizon(spark, d), "classification", 3), "lower", "upper")


@register("a8_yield")
def a8_yield(spark, d):
    run = _batch(spark, d)
    return stats.per_query_yield(run["candidates"], run["nodes"])


@register("a9_distinct")
def a9_distinct(spark, d):
    return stats.distinct_sources(dv.runs(spark, d))


@register("a10_query_count")
def a10_query_count(spark, d):
    return stats.query_counts(_queries_depth2(spark, d), dv.companies(spark, d),
                              len(dv.NEWS_SOURCES), 2)


# ---- W: positional ---------------------------------------------------------------------

@register("w1_first_match")
def w1_first_match(spark, d):
    e = table(spark, d, "events")
    return stats.first_match(e, ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@register("w2_odd_rows")
def w2_odd_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    odd = stats.odd_rows(docs, "lines")
    return odd.select("doc_id", "row_pos", F.length("row").cast("bigint").alias("row_len"),
                      F.md5("row").alias("row_md5"))


@register("w3_running")
def w3_running(spark, d):
    return stats.running_stats(dv.runs(spark, d), "run").withColumn("run", F.date_format("run", "yyyy-MM-dd"))


# ---- L and U: order, limit, union ----------------------------------------------------------

@register("l1_shuffle")
def l1_shuffle(spark, d):
    return frontier.shuffle_rows(dv.companies(spark, d).select("ticker", "name"), seed=7)


@register("l3_head")
def l3_head(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return frontier.head(docs, 5, F.col("n_chars").desc(), "doc_id")


def _ticker_lists(spark, d):
    """The default watchlist followed by three table-derived lists (the
    reference concatenates its watchlist with three exchange lists)."""
    w = registry.watchlist_df(spark).select("ticker")
    a = dv.companies(spark, d).select("ticker")
    b = table(spark, d, "supplier").select(dv.letters(F.col("s_suppkey")).alias("ticker"))
    c = dv.symbols(spark, d).select(F.col("symbol").alias("ticker"))
    return w, a, b, c


@register("u1_union_all")
def u1_union_all(spark, d):
    return frontier.ticker_universe(*_ticker_lists(spark, d))


@register("u1_union")
def u1_union(spark, d):
    return frontier.ticker_universe(*_ticker_lists(spark, d), distinct=True)


# ---- F: scalar functions -------------------------------------------------------------

@register("f1_querify")
def f1_querify(spark, d):
    p = table(spark, d, "part")
    s = F.concat_ws(" ", "p_name", "p_type")
    return p.select("p_partkey", text.querify(s).alias("query"))


@register("f3_company_query")
def f3_company_query(spark, d):
    p = table(spark, d, "part")
    name = (F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" Inc.")))
            .when(F.col("p_size") % 3 == 1, F.concat(F.lit("Inc. "), "p_name", F.lit("  Inc")))
            .otherwise(F.col("p_name")))
    return p.select("p_partkey", text.company_query(name, F.lower("p_brand")).alias("query"))


@register("f4_unwrap")
def f4_unwrap(spark, d):
    links = extract.all_links(table(spark, d, "pages").select("page_id", "html"))
    wrapped = F.concat(F.lit("/url?q="), F.col("href"))
    return links.select("page_id", "link_pos", urls.unwrap_link("href").alias("url"),
                        urls.unwrap_link(wrapped).alias("url_wrapped"))


@register("f5_collapse_ws")
def f5_collapse_ws(spark, d):
    docs = table(spark, d, "documents", True).select("doc_id", "text")
    c = text.collapse_ws("text")
    return docs.select("doc_id", F.length(c).cast("bigint").alias("n_chars"), F.md5(c).alias("md5"))


@register("f6_strip_ws")
def f6_strip_ws(spark, d):
    docs = table(spark, d, "documents", True).select("doc_id", "text")
    c = text.strip_all_ws("text")
    return docs.select("doc_id", F.length(c).cast("bigint").alias("n_chars"), F.md5(c).alias("md5"))


@register("f8_word_count")
def f8_word_count(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", text.word_count("text").alias("n_words"))


@register("f9_publish_date")
def f9_publish_date(spark, d):
    o = dates.with_publish_date(dv.order_date_pages(spark, d), "html")
    return o.select("o_orderkey", _day("publish_date"))


@register("f10_price_class")
def f10_price_class(spark, d):
    return _labels(spark, d).select("event_id", "t0", "t1", "classification")


@register("f11_horizon_class")
def f11_horizon_class(spark, d):
    return _horizon(spark, d).select("event_id", "t0", "t6",
                                     F.col("classification").cast("double").alias("classification"))


# ---- H: HTML extraction ----------------------------------------------------------------

@register("h1_select_first")
def h1_select_first(spark, d):
    p = table(spark, d, "pages", True).select("page_id", html.strip_hidden("html").alias("html"))
    whole = lambda *selector: [(None, *selector)]
    found = html.with_first(p, "html", {"_title": whole("title", None, None), "_h1": whole("h1", None, None),
                                        "_article": whole("article", None, None), "_ad": whole("div", "class", "ad")})
    texts = compute_once(found, **html.texts_of({"title": "_title", "h1": "_h1", "article": "_article", "ad": "_ad"}))
    return texts.select("page_id", "title", "h1", text.word_count("article").alias("article_words"), "ad")


@register("h2_title")
def h2_title(spark, d):
    n = extract.extract_title(dv.news_pages(spark, d))
    return n.select("page_id", "source", "title", "reject_reason")


@register("h3_date")
def h3_date(spark, d):
    return extract.extract_date(dv.news_pages(spark, d)).select("page_id", "source", _day("publish_date"))


@register("h4_links")
def h4_links(spark, d):
    links = extract.result_links(dv.search_results(spark, d))
    return links.select("page_id", "link_pos", "href", "url")


@register("h5_table_cells")
def h5_table_cells(spark, d):
    docs = dv.customer_docs(spark, d).select("c_custkey", F.col("constituents").alias("html"))
    cells = extract.table_cells(docs, "id", "constituents")
    return cells.select("c_custkey", "row_pos", "col_pos",
                        html.text_of("cell_html").alias("cell_text"))


@register("h6_constituents")
def h6_constituents(spark, d):
    docs = dv.customer_docs(spark, d)
    kinds = [("id_constituents", "constituents"), ("id_companylist", "companylist"), ("class_quotetable", "quotetable")]
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("spec"), F.col(c).alias("html")) for s, c in kinds]))
    return extract.constituents(docs.select("c_custkey", each), F.col("spec")).select("c_custkey", "spec", "row_pos", "col_pos", "ticker")


@register("h7_anchors")
def h7_anchors(spark, d):
    docs = dv.customer_docs(spark, d).select("c_custkey", F.col("calendar").alias("html"))
    return extract.anchors_by_class(docs, "data-table-row-cell__link")


@register("h8_profile")
def h8_profile(spark, d):
    docs = dv.customer_docs(spark, d).select("c_custkey", F.col("profile").alias("html"))
    return extract.profile_fields(docs)


@register("h9_paren_symbol")
def h9_paren_symbol(spark, d):
    return extract.movers(dv.mover_docs(spark, d))


# ---- C: composite jobs ---------------------------------------------------------------

@register("c1_candidates")
def c1_candidates(spark, d):
    return _batch(spark, d)["candidates"].select("ticker", "source", "string", "link_pos", "url")


@register("c1_own_queries")
def c1_own_queries(spark, d):
    return _own_batch(spark, d)["candidates"].select("ticker", "source", "string", "link_pos", "url")


@register("c2_own_queries")
def c2_own_queries(spark, d):
    n = articles.to_nodes(_own_batch(spark, d)["nodes"])
    return n.withColumn("PublishDate", F.date_format("PublishDate", "yyyy-MM-dd"))


@register("c3_own_queries")
def c3_own_queries(spark, d):
    return _own_batch(spark, d)["yield"]


@register("c1_depth2")
def c1_depth2(spark, d):
    return _batch_depth2(spark, d)["candidates"].select("ticker", "source", "string", "link_pos", "url")


@register("c2_nodes")
def c2_nodes(spark, d):
    return _nodes(spark, d)


@register("c2_nodes_checked")
def c2_nodes_checked(spark, d):
    opts = Options(date_checker=True, length_check=True, min_length=100, validate_url=True)
    return _nodes(spark, d, opts)


@register("c2_versions")
def c2_versions(spark, d):
    """C2 over a store that keeps several versions of a page."""
    n = articles.build_nodes(_batch(spark, d)["candidates"], dv.page_versions(spark, d), dv.companies(spark, d),
                             at=dv.VERSION_AT, version="fetched_at")
    return articles.to_nodes(n).withColumn("PublishDate", F.date_format("PublishDate", "yyyy-MM-dd"))


@register("c3_run_batch")
def c3_run_batch(spark, d):
    return _batch(spark, d)["stats"]


@register("c3_depth2")
def c3_depth2(spark, d):
    return _batch_depth2(spark, d)["stats"]


@register("c4_labels")
def c4_labels(spark, d):
    return _labels(spark, d).select("event_id", "ticker", "ts", "t0", "t1", "classification")


@register("c4_labels_fresh")
def c4_labels_fresh(spark, d):
    return _fresh_labels(spark, d).select("event_id", "ticker", "ts", "t0", "t1", "classification")


@register("c5_summary")
def c5_summary(spark, d):
    arts = _documents_labelled(spark, d)
    return _r6(stats.corpus_summary(arts, stats.source_stats(dv.runs(spark, d))), "value")


# ---- T: streaming (run to completion with availableNow, result read back) -----

def _scratch_dir(spark, name: str) -> str:
    import uuid
    from tickerwire.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/tickerwire-{name}-{uuid.uuid4().hex}"


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    # the stream source takes directories: watch the table folder, pick the file
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", "events.parquet").parquet(d))


@register("t2_stats_stream")
def t2_stats_stream(spark, d):
    """Per-source totals kept as streaming state over the runs stream."""
    from tickerwire.streaming import ingest
    e = _event_stream(spark, d)
    runs = e.select(F.col("event_type").alias("source"),
                    F.floor("value").cast("bigint").alias("num_urls"),
                    F.floor(F.col("value") / 3).cast("bigint").alias("num_nodes"))
    base = _scratch_dir(spark, "stats")
    q = ingest.write_versions(ingest.stats_stream(runs), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return ingest.read_latest_version(spark, f"{base}/out")


def _landed(df: DataFrame, part, parts: int, base: str) -> Iterator[str]:
    """``df`` in folders that arrive one after the other, by number ``part``:
    the landing path, each time another folder is there. A stream run to its
    end between two arrivals takes each as one micro-batch, in however many
    files it was written."""
    staged = df.withColumn("_part", part)
    for n in range(parts):
        staged.filter(F.col("_part") == n).drop("_part").write.parquet(f"{base}/file={n}")
        yield f"{base}/file=*"


def _streamed(df: DataFrame, spark: SparkSession, base: str) -> DataFrame:
    q = (df.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@register("t3_dedupe_stream")
def t3_dedupe_stream(spark, d):
    """(user, event type) repeats dropped within a one-day watermark."""
    from tickerwire.streaming import ingest
    e = _event_stream(spark, d).select("user_id", "event_type", "ts")
    dd = ingest.dedupe_stream(e, ["user_id", "event_type"], "ts", "1 day").drop("ts")
    return _streamed(dd, spark, _scratch_dir(spark, "dedupe"))


@register("t3_horizon_stream")
def t3_horizon_stream(spark, d):
    """T3 by the exact horizon rule, over four arrivals in order of event
    time, one per micro-batch."""
    from tickerwire.streaming import ingest
    base = _scratch_dir(spark, "horizon")
    e = table(spark, d, "events", True).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    span = e.select(F.struct(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))).scalar()
    part = F.floor((F.unix_micros("ts") - span["lo"]) * 4 / (span["hi"] - span["lo"] + 1)).cast("int")
    for landing in _landed(e, part, 4, f"{base}/landing"):
        stream = spark.readStream.schema(e.schema).parquet(landing)
        kept = _streamed(ingest.dedupe_horizon_stream(stream, ["user_id", "event_type"], "ts", "5 days"), spark, base)
    return kept.select("event_id", "user_id", "event_type")


def _ingested(spark, d):
    """The links of a run with name queries arrive in three parts, a query's
    whole in one, and are ingested part by part: URLs repeat within a part
    (two queries) and across parts. Returns the folder of the stores."""
    from tickerwire.streaming import ingest
    base = _scratch_dir(spark, "repeats")
    c = dv.companies(spark, d)
    links = extract.result_links(dv.search_results_by_name(spark, d)).filter(urls.is_of_source("url", "source"))
    links = links.join(_queries_depth2(spark, d), ["ticker", "source", "string"]).select(
        "ticker", "source", "string", "url", "ticker_pos", "source_pos", "sub")
    # every third ticker's name query arrives with its ticker query, others before it
    part = F.when(F.col("sub") == 0, F.pmod("ticker_pos", F.lit(3)) % 2).otherwise(F.pmod("ticker_pos", F.lit(3)))
    for landing in _landed(links, part.cast("int"), 3, f"{base}/landing"):
        q = ingest.ingest_stream(spark, landing, links.schema, dv.news_pages(spark, d).select("url", "html"), c, f"{base}/store",
                                 f"{base}/parsed", f"{base}/ckpt", stats_path=f"{base}/stats",
                                 order_cols=("ticker_pos", "source_pos", "sub"), compact_every=2)
        q.awaitTermination()
    return base


@register("t1_repeats")
def t1_repeats(spark, d):
    nodes = spark.read.parquet(f"{_ingested(spark, d)}/store")
    return nodes.select("batch_id", "ticker", "source", "string", "url", "title", _day("publish_date"))


@register("t1_stats")
def t1_stats(spark, d):
    from tickerwire.streaming import ingest
    return ingest.read_stats(spark, f"{_ingested(spark, d)}/stats")


@register("t1_ingest_stream")
def t1_ingest_stream(spark, d):
    """The run's candidate URLs land as three files; the ingest stream
    processes one file per micro-batch (dedupe against earlier batches,
    build, write). Once all files are in, the store equals the batch nodes."""
    from tickerwire.streaming import ingest
    base = _scratch_dir(spark, "ingest")
    cands = _batch(spark, d)["candidates"].select("ticker", "source", "string", "url")
    schema = "ticker STRING, source STRING, string STRING, url STRING"
    # one job writes the three landing files (one file per part directory)
    part = F.pmod(F.xxhash64("url"), F.lit(3))
    (cands.withColumn("part", part).repartition(3, "part")
     .write.mode("overwrite").partitionBy("part").parquet(f"{base}/landing"))
    comp = dv.companies(spark, d)
    q = ingest.ingest_stream(spark, f"{base}/landing/part=*", schema,
                             dv.news_pages(spark, d).select("url", "html"), comp,
                             f"{base}/store", f"{base}/parsed", f"{base}/ckpt",
                             max_files_per_trigger=1)
    q.awaitTermination()
    nodes = articles.to_nodes(spark.read.parquet(f"{base}/store"))
    return nodes.withColumn("PublishDate", F.date_format("PublishDate", "yyyy-MM-dd"))



# ---- S: stores written and read back (under the shared checkpoint folder) ----

@register("s3_articles_csv")
def s3_articles_csv(spark, d):
    """S3: the labelled-examples CSV (Latin-1, header) written from
    documents x labels and read back by header name."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    ex = docs.join(lab, "doc_id", "left").select(
        F.concat(F.lit("http://"), F.col("source"), F.lit(".example.com/"),
                 F.col("doc_id").cast("string")).alias("url"),
        "source", F.col("text").alias("article"), F.col("quality").cast("double").alias("t0"),
        (F.col("n_chars") / 100.0).alias("t6"))
    path = _scratch_dir(spark, "examples") + "/examples.csv"
    files.write_articles_csv(ex, path)
    back = files.read_articles_csv(spark, path)
    return back.select("url", "source", F.length("article").cast("bigint").alias("article_len"),
                       F.md5("article").alias("article_md5"), "t0", "t6")


@register("s5_append_articles")
def s5_append_articles(spark, d):
    """The run's nodes appended twice to a partitioned store; both
    appends are kept."""
    path = _scratch_dir(spark, "articles")
    nodes = articles.to_nodes(_batch(spark, d)["nodes"])
    files.append_articles(nodes, path)
    files.append_articles(nodes, path)
    back = files.read_articles(spark, path)
    return back.withColumn("PublishDate", F.date_format("PublishDate", "yyyy-MM-dd"))


@register("s6_parsed_store")
def s6_parsed_store(spark, d):
    """Parsed URLs appended twice (list concatenation keeps repeats)."""
    path = _scratch_dir(spark, "parsed")
    files.append_parsed(_batch(spark, d)["parsed"], path)
    files.append_parsed(_batch(spark, d)["parsed"], path)
    return files.read_parsed(spark, path)


@register("s7_write_stats")
def s7_write_stats(spark, d):
    """S7 (with S5, S6 through the checkpointed run sinks): a second run, over
    the first one's parsed URLs, adds its totals to stats version 1. The first
    has the companies with an even position, the second all."""
    base = _scratch_dir(spark, "run")
    paths = (f"{base}/store", f"{base}/parsed", f"{base}/stats")
    c = dv.companies(spark, d)
    inputs = dv.search_results(spark, d), dv.news_pages(spark, d), c
    first = c.filter(F.col("ticker_pos") % 2 == 0).select("ticker", "ticker_pos")
    articles.write_run(articles.run_batch(first, dv.NEWS_SOURCES, *inputs), *paths, 0)
    seen = files.read_parsed(spark, paths[1])
    again = articles.run_batch(c.select("ticker", "ticker_pos"), dv.NEWS_SOURCES, *inputs, parsed=seen)
    return articles.write_run(again, *paths, 1)


@register("s8_export_csv")
def s8_export_csv(spark, d):
    """Nodes exported as CSV with the attribute header, read back."""
    path = _scratch_dir(spark, "export")
    files.export_csv(articles.to_nodes(_batch(spark, d)["nodes"]), path)
    return spark.read.option("header", True).option("multiLine", True).csv(path)


@register("s8_export_labelled")
def s8_export_labelled(spark, d):
    """Articles to labels to CSV: the class of the price move stands in every
    row, the sector is left out by option."""
    opts = Options(classification=True, sector=False)
    labelled = articles.label_nodes(_batch(spark, d)["nodes"], dv.company_ticks(spark, d), interval=LABEL_INTERVAL,
                                    tick_order="tick_id", max_age=MAX_AGE)
    path = _scratch_dir(spark, "export-labelled")
    files.export_csv(articles.to_nodes(labelled, opts), path)
    return spark.read.option("header", True).option("multiLine", True).options(**files.CSV).csv(path)
