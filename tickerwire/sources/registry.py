"""Small fixed tables: sources, hosts, homepage patterns, selectors.

These registries are configuration-sized (at most a few dozen rows), so they
are materialised as literal relations and are the only sides this package
ever broadcasts by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------

# Sources the article builder is tuned for.
VALID_SOURCES = ["bloomberg", "seekingalpha", "reuters", "thestreet", "wsj"]

# Default watchlist of tickers.
WATCHLIST = ["SAP", "AAPL", "GOOG", "GPRO", "TSLA", "APRN", "FB", "NVDA",
             "SNAP", "SPY", "NFLX", "AMZN", "AMD"]

# Source name -> host name.
HOSTS = [
    ("motleyfool", "www.fool.com"),
    ("bloomberg", "www.bloomberg.com"),
    ("seekingalpha", "seekingalpha.com"),
    ("yahoofinance", "finance.yahoo.com"),
    ("investopedia", "www.investopedia.com"),
    ("investing", "www.investing.com"),
    ("marketwatch", "www.marketwatch.com"),
    ("googlefinance", "www.google.com"),
    ("reuters", "www.reuters.com"),
    ("thestreet", "www.thestreet.com"),
    ("msn", "www.msn.com"),
    ("wsj", "www.wsj.com"),
    ("barrons", "www.barrons.com"),
    ("zacks", "www.zacks.com"),
    ("investorplace", "investorplace.com"),
    ("benzinga", "www.benzinga.com"),
]

# Source -> regular expressions of stock overview ("homepage") URLs; a URL is
# a homepage when any pattern of its source is found in it.
HOMEPAGE_PATTERNS = [
    ("bloomberg", r"bloomberg\.com\/quote\/[a-zA-Z]*:[a-zA-Z]*"),
    ("yahoo", r"finance\.yahoo\.com\/quote\/(.?)"),
    ("seekingalpha", r"seekingalpha\.com\/symbol\/[a-zA-Z]*"),
    ("reuters", r"reuters\.com\/finance/stocks/overview\/[a-zA-Z]*"),
    ("reuters", r"reuters\.com\/finance\/stocks\/company-news\/[a-zA-Z]*"),
    ("reuters", r"reuters\.com\/finance\/stocks\/companyProfile\/[a-zA-Z]*"),
    ("reuters", r"reuters\.com\/finance\/stocks\/analyst\/[a-zA-Z]*"),
    ("reuters", r"reuters\.com\/finance\/stocks\/chart\/[a-zA-Z]*"),
    ("thestreet", r"thestreet\.com\/quote\/[a-zA-Z]*"),
]

# (source, field, tag, attribute, value): the element holding the publish
# date and the title. attribute None means "first element of that tag".
SELECTORS = [
    ("bloomberg", "date", "article", None, None),
    ("seekingalpha", "date", "article", None, None),
    ("reuters", "date", "div", "class", "ArticleHeader_date"),
    ("thestreet", "date", "time", "title", "Last Publish Date"),
    ("investopedia", "date", "div", "id", "displayed-date_1-0"),
    ("wsj", "date", "time", None, None),
    ("bloomberg", "title", "h1", "class", "lede-text-v2__hed"),
    ("seekingalpha", "title", "title", None, None),
    ("reuters", "title", "h1", "class", "ArticleHeader_headline"),
    ("thestreet", "title", "h1", "class", "article__headline"),
    ("investopedia", "title", "h1", "id", "article-heading_2-0"),
    ("wsj", "title", "h1", "class", "wsj-article-headline"),
]

# Token dropped from company names when building a name query.
NAME_STOPWORDS = ["Inc."]

# Class value of a price that was not found.
PRICE_NOT_FOUND = -1000

# ---------------------------------------------------------------------------


def selectors(field: str) -> list[tuple[str, str, str | None, str | None]]:
    return [(s, tag, a, v) for s, f, tag, a, v in SELECTORS if f == field]


def homepage_patterns() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for source, rx in HOMEPAGE_PATTERNS:
        out.setdefault(source, []).append(rx)
    return out


def sources_df(spark: SparkSession, sources: list[str] | None = None) -> DataFrame:
    """The source list as a relation (source STRING, position INT)."""
    names = VALID_SOURCES if sources is None else list(sources)
    return spark.createDataFrame(list(zip(names, range(len(names)))),
                                 "source STRING, position INT")


def watchlist_df(spark: SparkSession) -> DataFrame:
    """The default watchlist (ticker STRING, position INT)."""
    return spark.createDataFrame(list(zip(WATCHLIST, range(len(WATCHLIST)))),
                                 "ticker STRING, position INT")


def hosts_df(spark: SparkSession) -> DataFrame:
    """Source -> host registry, 16 rows."""
    return spark.createDataFrame(HOSTS, "source STRING, host STRING")


def homepage_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOMEPAGE_PATTERNS, "source STRING, regex STRING")


def selectors_df(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in
                           ("source", "field", "tag", "attr", "value")])
    return spark.createDataFrame(SELECTORS, schema)


def sources_array(sources: list[str] | None = None):
    """The source list as an array literal: used to fan rows out per source
    with ``explode`` (a Generate, no join)."""
    names = VALID_SOURCES if sources is None else list(sources)
    return F.array(*[F.lit(s) for s in names])
