"""Inputs derived from the driver tables.

The reference works on tickers, news sites, stored pages, company profiles
and price ticks; the driver ships TPC-H-like tables. Every function here
derives one of those inputs from the driver tables row by row (no grouping,
no sampling), so its size grows with the scale factor. Each has a DuckDB
twin in ``plans.oracle`` that computes the *expected* answer from the
original columns, independently of the extraction code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerwire.functions.text import company_query, query_string
from tickerwire.operators.company import with_name
from tickerwire.session import per_session, table

# Fixed values of the derivation (mirrored in plans.oracle).
NEWS_SOURCES = ["bloomberg", "seekingalpha", "reuters", "thestreet", "investopedia", "wsj",
                "marketwatch"]
NEWS_HOSTS = {"bloomberg": "www.bloomberg.com", "seekingalpha": "seekingalpha.com",
              "reuters": "www.reuters.com", "thestreet": "www.thestreet.com",
              "investopedia": "www.investopedia.com", "wsj": "www.wsj.com",
              "marketwatch": "www.marketwatch.com"}
TITLE_OPEN = {"bloomberg": '<h1 class="lede-text-v2__hed">', "seekingalpha": "<h1>",
              "reuters": '<h1 class="ArticleHeader_headline">',
              "thestreet": '<h1 class="article__headline big">',
              "investopedia": '<h1 id="article-heading_2-0">',
              "wsj": '<h1 class="wsj-article-headline">', "marketwatch": "<h1>"}
DATE_OPEN = {"bloomberg": "<p>", "seekingalpha": "<p>",
             "reuters": '<div class="ArticleHeader_date">',
             "thestreet": '<time title="Last Publish Date">',
             "investopedia": '<div id="displayed-date_1-0">', "wsj": "<time>",
             "marketwatch": "<p>"}
DATE_CLOSE = {"bloomberg": "</p>", "seekingalpha": "</p>", "reuters": "</div>",
              "thestreet": "</time>", "investopedia": "</div>", "wsj": "</time>",
              "marketwatch": "</p>"}
HOMEPAGE_PATH = {"bloomberg": "/quote/{t}:US", "seekingalpha": "/symbol/{t}",
                 "reuters": "/finance/stocks/overview/{t}",
                 "thestreet": "/quote/{t}/details/news.html", "investopedia": "/quote/{t}",
                 "wsj": "/quote/{t}", "marketwatch": "/quote/{t}"}
# every ninth headline starts with references: an old name without its
# semicolon, and one of the long table
HEADLINE_MARK = "&copy 5 &bigstar; "
# a date container of this source holds a container of the same tag
NESTED_DATE = {"reuters": '<div class="stamp">at</div> '}
DATE_FORMATS = ["yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "M/d/yyyy"]
DECOY_DATE = "1/1/1999"
PARSED_BEFORE = "2024-01-05"
VERSION_AT = "2024-02-20"


def letters(c: Column) -> Column:
    """Digits of a key spelled as letters (0 -> A ... 9 -> J): a ticker."""
    return F.translate(c.cast("string"), "0123456789", "ABCDEFGHIJ")


def _case(key: Column, mapping: dict[str, Column | str]) -> Column:
    expr = None
    for k, v in mapping.items():
        val = v if isinstance(v, Column) else F.lit(v)
        expr = F.when(key == k, val) if expr is None else expr.when(key == k, val)
    return expr


@per_session
def companies(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, ticker_pos, name, industry, sector) from customer x nation."""
    c = table(spark, d, "customer")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return j.select(letters(F.col("c_custkey")).alias("ticker"),
                    F.col("c_custkey").alias("ticker_pos"), F.col("c_name").alias("name"),
                    F.col("n_name").alias("industry"), F.col("c_mktsegment").alias("sector"))


@per_session
def symbols(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, name, position) listings from part: several parts share a
    symbol, the lowest part key is the first listing."""
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" Inc."))) \
        .otherwise(F.col("p_name"))
    return p.select(letters(F.col("p_size")).alias("symbol"), name.alias("name"),
                    F.col("p_partkey").alias("position"))


@per_session
def news_pages(spark: SparkSession, d: str) -> DataFrame:
    """Stored news pages: each driver page re-hosted on a news site, with
    that site's title markup and a publish-date container injected.

    (page_id, ticker, source, url, pub_date, has_date, html)."""
    p = table(spark, d, "pages", True)
    pid = F.col("page_id")
    src = F.element_at(F.array(*[F.lit(s) for s in NEWS_SOURCES]),
                       (F.pmod(pid, F.lit(len(NEWS_SOURCES))) + 1).cast("int"))
    p = p.withColumn("source", src).withColumn("ticker", letters(F.pmod(pid * 37, F.lit(149))))
    host = _case(F.col("source"), NEWS_HOSTS)
    home = _case(F.col("source"), {s: F.replace(F.lit(path), F.lit("{t}"), F.col("ticker"))
                                   for s, path in HOMEPAGE_PATH.items()})
    path = F.when(pid % 11 == 0, home).otherwise(F.concat(F.lit("/article/"), pid.cast("string")))
    pub = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(pid, F.lit(30)).cast("int"))
    fmt_idx = (F.pmod(pid, F.lit(len(DATE_FORMATS))) + 1).cast("int")
    shown = F.element_at(F.array(*[F.date_format(pub, f) for f in DATE_FORMATS]), fmt_idx)
    has_date = pid % 13 != 0
    nested = _case(F.col("source"), {s: NESTED_DATE.get(s, "") for s in NEWS_SOURCES})
    container = F.when(has_date, F.concat(_case(F.col("source"), DATE_OPEN), nested, shown,
                                          _case(F.col("source"), DATE_CLOSE))).otherwise(F.lit(""))
    mark = F.when(pid % 9 == 0, F.lit(HEADLINE_MARK)).otherwise(F.lit(""))
    html = F.replace(F.col("html"), F.lit("<h1>"), F.concat(_case(F.col("source"), TITLE_OPEN), mark))
    html = F.replace(html, F.lit("<article>"), F.concat(F.lit("<article>"), container))
    html = F.replace(html, F.lit("<nav>"), F.lit(f"<nav><span>{DECOY_DATE}</span>"))
    return p.select("page_id", "ticker", "source",
                    F.concat(F.lit("https://"), host, path).alias("url"),
                    pub.alias("pub_date"), has_date.alias("has_date"), html.alias("html"))


@per_session
def page_versions(spark: SparkSession, d: str) -> DataFrame:
    """A store of page versions (url, html, fetched_at): a draft of every news
    page, the page itself but for every fifth, and one fetched after the run.
    What the run at VERSION_AT must see is the page, or the draft where there
    is nothing later; repeated rows are stored twice for every fourth page."""
    n = news_pages(spark, d)
    changed = lambda mark: F.replace(F.replace("html", F.lit("</h1>"), F.lit(f" {mark}</h1>")), F.lit("</title>"), F.lit(f" {mark}</title>"))
    page = F.when(F.col("page_id") % 5 != 0, F.col("html"))
    each = [(changed("(draft)"), "2024-01-10"), (page, "2024-02-10"), (F.when(F.col("page_id") % 4 == 0, page), "2024-02-10"),
            (changed("(late)"), "2024-03-10")]
    each = F.filter(F.array(*[F.struct(h.alias("html"), F.lit(day).cast("date").alias("fetched_at")) for h, day in each]),
                    lambda v: v["html"].isNotNull())
    return n.select("url", F.inline(each))


@per_session
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Stored search-result page per news page, attached to the query
    (ticker, source, string) that found it: three div.g blocks — the page's
    own link, a link of a foreign site, and a host-relative link — after the
    driver page's own navigation anchors (which are not result blocks). Every
    sixth page goes on with a block inside a block: both give the inner link,
    an address with escaped ampersands."""
    n = news_pages(spark, d)
    rel = F.split_part(F.col("url"), F.lit("://"), F.lit(2))
    html = F.concat(
        F.lit('<html><body><div id="nav"><a href="/url?q=http://nav.example.com/">nav</a></div>'),
        F.lit('<div class="g"><h3>r</h3><a href="/url?q='), F.col("url"), F.lit('">one</a>'),
        F.lit('<a href="/url?q=http://second.example.com/">two</a></div>'),
        F.lit('<div class="g"><a href="/url?q=https://www.example.com/'),
        F.col("page_id").cast("string"), F.lit('">other</a></div>'),
        F.lit('<div class="g big"><a class="l" href="/url?q=/'), rel, F.lit('">rel</a></div>'),
        F.when(F.col("page_id") % 6 == 0, F.concat(
            F.lit('<div class="g"><div class="m"><div class="x g"><a href="/url?q='), F.col("url"),
            F.lit('?a=1&amp;b=&#50;&copy=3">in</a></div></div><a href="/url?q=http://second.example.com/">two</a></div>'))).otherwise(F.lit("")),
        F.lit("</body></html>"))
    return n.select("page_id", "ticker", "source",
                    query_string(F.col("ticker"), F.col("source")).alias("string"),
                    html.alias("html"))


@per_session
def search_results_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Result pages of a run with name queries: a company whose name is known
    is searched by it too, and the name query finds the page of the ticker
    query, so every such URL is met by two queries of its ticker."""
    r = search_results(spark, d)
    names = with_name(companies(spark, d).select("ticker"), symbols(spark, d)).filter(F.col("name").isNotNull())
    by_name = r.join(names, "ticker").withColumn("string", company_query(F.col("name"), F.col("source"))).drop("name")
    return r.unionByName(by_name.select(*r.columns))


OWN_WORDS = "most recent articles"


@per_session
def own_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries of the user's own (ticker, source, string, query_pos): for every
    second company one that names no source, for the others one for each of
    two sources."""
    c = companies(spark, d)
    sources = F.when(F.col("ticker_pos") % 2 == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit("wsj"), F.lit("reuters")))
    return c.select("ticker", F.explode(sources).alias("source"),
                    F.concat("ticker", F.lit(f" {OWN_WORDS}")).alias("string"), F.col("ticker_pos").alias("query_pos"))


@per_session
def own_results(spark: SparkSession, d: str) -> DataFrame:
    """Result pages of the users' own queries: those of the ticker queries,
    under the query without a source where the company has one."""
    r = search_results(spark, d).join(companies(spark, d).select("ticker", "ticker_pos"), "ticker")
    source = F.when(F.col("ticker_pos") % 2 == 1, F.col("source"))
    return r.select("page_id", "ticker", source.alias("source"), F.replace(F.concat("ticker", F.lit(f" {OWN_WORDS}")), F.lit(" "), F.lit("+")).alias("string"), "html")


@per_session
def parsed_before(spark: SparkSession, d: str) -> DataFrame:
    """URLs parsed by an earlier run: news pages published before a cut-off
    date. (ticker, source, url)."""
    n = news_pages(spark, d)
    return (n.filter(F.col("pub_date") < F.lit(PARSED_BEFORE).cast("date"))
            .select(F.lower("ticker").alias("ticker"), "source", "url"))


@per_session
def price_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Price ticks: purchase events (ticker = user, price = value)."""
    e = table(spark, d, "events").filter(F.col("event_type") == "purchase")
    return e.select(F.col("user_id").alias("ticker"), "ts", F.col("value").alias("price"),
                    F.col("event_id").alias("tick_id"))


@per_session
def company_ticks(spark: SparkSession, d: str) -> DataFrame:
    """The price ticks under company tickers."""
    return price_ticks(spark, d).withColumn("ticker", letters(F.col("ticker")))


@per_session
def publications(spark: SparkSession, d: str) -> DataFrame:
    """Article publications: view events (ticker = user)."""
    e = table(spark, d, "events").filter(F.col("event_type") == "view")
    return e.select("event_id", F.col("user_id").alias("ticker"), "ts")


@per_session
def runs(spark: SparkSession, d: str) -> DataFrame:
    """Crawl runs from events: source = event type, run = day; each event
    contributes floor(value) URLs and floor(value / 3) nodes."""
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("source"), F.to_date("ts").alias("run"),
                    F.floor("value").cast("bigint").alias("num_urls"),
                    F.floor(F.col("value") / 3).cast("bigint").alias("num_nodes"))


@per_session
def order_date_pages(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, html): order dates rendered in the supported formats
    inside a short HTML snippet."""
    o = table(spark, d, "orders", True)
    dt = F.to_date("o_orderdate")
    idx = (F.pmod(F.col("o_orderkey"), F.lit(len(DATE_FORMATS))) + 1).cast("int")
    shown = F.element_at(F.array(*[F.date_format(dt, f) for f in DATE_FORMATS]), idx)
    html = F.concat(F.lit('<div class="meta"><span>Order '), F.col("o_orderkey").cast("string"),
                    F.lit("</span> placed "), shown, F.lit(" status "),
                    F.col("o_orderstatus"), F.lit("</div>"))
    return o.select("o_orderkey", html.alias("html"))


@per_session
def customer_docs(spark: SparkSession, d: str) -> DataFrame:
    """Per customer, small finance pages: constituent tables in the three
    layouts, an earnings-calendar anchor list and a company profile block.
    (c_custkey, constituents, companylist, quotetable, calendar, profile)."""
    c = table(spark, d, "customer", True)   # reading a page costs far more than reading its row
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    c = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    t = letters(F.col("c_custkey"))
    nk = letters(F.col("c_nationkey"))
    constituents = F.concat(
        F.lit('<table class="wikitable" id="constituents"><tr><th>Symbol</th><th>Security</th></tr>'),
        F.lit("<tr><td> "), t, F.lit(" </td><td>"), F.col("c_name"),
        # every fourth customer: a table inside the name's cell, then one more cell
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("<table><tr><td>in "), nk, F.lit("</td></tr></table></td><td>after")))
        .otherwise(F.lit("")), F.lit("</td></tr>"),
        F.lit("<tr><td>"), F.col("c_mktsegment"), F.lit('</td><td><a href="/n">'),
        F.col("n_name"), F.lit("</a></td></tr></table>"))
    companylist = F.concat(
        F.lit('<table id="CompanylistResults"><tr><th>Name</th><th>Symbol</th></tr>'),
        F.lit('<tr><td>'), F.col("c_name"), F.lit('</td><td><a href="/s"> '), t,
        F.lit(" \n</a></td></tr>"),
        F.lit('<tr><td>x</td><td><a href="/s">SKIP</a></td></tr>'),
        F.lit('<tr><td>y</td><td><a href="/s">N '), nk, F.lit("</a></td></tr></table>"))
    quotetable = F.concat(
        F.lit('<table class="data quoteTable"><tr><td><a href="/q">'), t,
        F.lit("</a></td><td>"), F.col("c_mktsegment"), F.lit('</td><td><a href="/q"> X '), nk,
        F.lit("</a></td></tr></table>"))
    calendar = F.concat(
        F.lit('<a class="data-table-row-cell__link" href="/quote/'), t, F.lit(':US">'),
        F.col("c_name"), F.lit('</a><a href="/other/'), F.col("c_custkey").cast("string"),
        F.lit(':X">o</a><a href="/x/'), nk, F.lit(':Z" class="cell data-table-row-cell__link">z</a>'))
    second_p = F.when(F.col("c_acctbal") >= 0, F.concat(
        F.lit("<p><span>Sector</span>: <span>"), F.col("c_mktsegment"),
        F.lit("</span><br><span>Industry</span>: <span>"), F.col("n_name"),
        F.lit("</span></p>"))).otherwise(F.lit(""))
    profile = F.concat(
        F.lit('<div class="asset-profile-container"><div><div><h3>'), F.col("c_name"),
        F.lit("</h3><p>"), F.col("c_name"), F.lit(" address</p>"), second_p,
        F.lit("</div></div></div>"))
    return c.select("c_custkey", constituents.alias("constituents"),
                    companylist.alias("companylist"), quotetable.alias("quotetable"),
                    calendar.alias("calendar"), profile.alias("profile"))


@per_session
def mover_docs(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, html): movers table cells whose anchor text carries the
    symbol in parentheses."""
    p = table(spark, d, "part")
    html = F.concat(F.lit('<table><tr><td><a href="/m">'), F.col("p_name"), F.lit(" ("),
                    F.col("p_brand"), F.lit(")</a></td><td>"), F.col("p_size").cast("string"),
                    F.lit("</td></tr></table>"))
    return p.select("p_partkey", html.alias("html"))
