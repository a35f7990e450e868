"""P4/P5/P6 golden cases (the reference's two table-driven tests) plus the
corners listed in FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from tickerwire.functions import urls

# The golden cases of both predicates.
HOMEPAGE_CASES = [
    ("http://www.bloomberg.com/quote/SAP:US", "bloomberg", True),
    ("http://www.bloomberg.com/quote/SAP:GR", "bloomberg", True),
    ("http://www.bloomberg.com/quote/SAP", "bloomberg", False),
    ("http://www.bloomberg.com/quote/SAP2:GR", "bloomberg", False),
    ("http://www.bloomberg.com/quotes/SAP:GR", "bloomberg", False),
    ("https://www.reuters.com/finance/stocks/overview/SAP", "reuters", True),
    ("https://www.reuters.com/finance/stocks/company-news/SAP", "reuters", True),
    ("https://www.reuters.com/article/us-sap-results/sap-says-big-margin-gains-to-wait-until-2020-shares-down-10-idUSKCN1UD0F8", "reuters", False),
    ("https://www.reuters.com/finance/stocks/analyst/SAP", "reuters", True),
    ("https://www.reuters.com/finance/stocks/chart/SAPG.DE", "reuters", True),
    ("https://www.reuters.com/finance/stocks/companyProfile/SAPG.DE", "reuters", True),
    ("https://www.thestreet.com/quote/SAP/details/news.html", "thestreet", True),
    ("https://www.thestreet.com/press-releases/leading-companies-around-the-globe-continue-to-choose-sap-reg-ariba-reg-and-sap-fieldglass-reg-solutions-for-intelligent-spend-management-15056741", "thestreet", False),
    ("https://www.investopedia.com/7-tech-companies-that-may-get-bought-next-in-tech-m-and-a-spree-4690575", "investopedia", False),
]

OF_SOURCE_CASES = [
    ("http://www.bloomberg.com/quote/SAP:US", "bloomberg", True),
    ("http://www.bloomberg.com/quote/SAP:GR", "bloomberg", True),
    ("http://www.bloomberg.com/quotes/SAP:GR", "yahoo", False),
    ("http://seekingalpha.com/article/4243142-sap-growth-without-limit-growing-dividend", "seekingalpha", True),
    ("https://www.reuters.com/finance/stocks/overview/SAP", "reuters", True),
    ("https://www.thestreet.com/quote/SAP/details/news.html", "thestreet", True),
    ("https://www.investopedia.com/7-tech-companies-that-may-get-bought-next-in-tech-m-and-a-spree-4690575", "investopedia", True),
    # corners
    ("www.bloomberg.com/quote/SAP:US", "bloomberg", False),       # no '://'
    ("http://WWW.BLOOMBERG.COM/x", "bloomberg", False),           # labels are case-sensitive
    ("http://www.bloomberg.com:8080/x", "bloomberg", True),
    ("http://www.bloomberg.com:8080/x", "com", False),            # port stays in the label
    ("http://user@bloomberg.com/x", "bloomberg", False),           # userinfo stays in the label
]


def _eval(spark, cases, fn):
    df = spark.createDataFrame(cases, "url STRING, source STRING, expected BOOLEAN")
    out = df.select("url", "source", "expected", fn("url", "source").alias("got")).collect()
    return [(r.url, r.source, r.expected, r.got) for r in out]


@pytest.mark.parametrize("url,source,expected", HOMEPAGE_CASES)
def test_is_homepage_golden(spark, url, source, expected):
    df = spark.createDataFrame([(url, source)], "url STRING, source STRING")
    assert df.select(urls.is_homepage("url", "source")).first()[0] is expected


def test_is_of_source_golden(spark):
    for url, source, expected, got in _eval(spark, OF_SOURCE_CASES, urls.is_of_source):
        assert got is expected, (url, source)


def test_null_inputs(spark):
    df = spark.createDataFrame([(None, "bloomberg"), ("http://www.bloomberg.com/quote/A:B", None)],
                               "url STRING, source STRING")
    got = df.select(urls.is_homepage("url", "source").alias("h"),
                    urls.is_of_source("url", "source").alias("o")).collect()
    assert got[0].h is None and got[0].o is None
    # a null source is no known source: not a homepage; label test unknown
    assert got[1].h is False and got[1].o is None


def test_is_valid_url(spark):
    cases = [
        ("https://www.bloomberg.com/news/x", "bloomberg", True, True),
        ("HTTPS://WWW.Bloomberg.COM:443/news", "bloomberg", True, True),   # scheme/host lower-cased, port dropped
        ("https://user:pw@www.bloomberg.com/news", "bloomberg", True, True),  # userinfo dropped
        ("ftp://www.bloomberg.com/news", "bloomberg", False, False),
        ("https://blog.example.com/x", "bloomberg", False, True),          # curious skips the host check
        ("https:///x", "bloomberg", False, False),                         # empty host
        ("not a url", "bloomberg", False, False),
        ("https://seekingalpha.com/a", "seekingalpha", True, True),
        ("https://www.bloomberg.com/a", "Bloomberg", False, True),         # registry lookup is exact-case
        ("http://[::1]:8080/a", "bloomberg", False, True),                 # IPv6 literal host
    ]
    df = spark.createDataFrame(cases, "url STRING, source STRING, strict BOOLEAN, curious BOOLEAN")
    out = df.select("url", "strict", "curious",
                    urls.is_valid_url("url", "source", False).alias("s"),
                    urls.is_valid_url("url", "source", True).alias("c")).collect()
    for r in out:
        assert (r.s, r.c) == (r.strict, r.curious), r.url


def test_hostname(spark):
    df = spark.createDataFrame([("http://[::1]:80/x",), ("https://u:p@Www.X.com:443/",), ("x",)], "u STRING")
    assert [r[0] for r in df.select(urls.url_hostname("u")).collect()] == ["::1", "www.x.com", ""]


def test_unwrap_link(spark):
    cases = [
        ("/url?q=https://www.reuters.com/a&sa=U", "https://www.reuters.com/a&sa=U"),
        ("/url?q=/www.reuters.com/a", "http://www.reuters.com/a"),
        ("/url?q=www.reuters.com/a", "http://www.reuters.com/a"),
        ("/url?q=", None),
        ("/x", None),
        ("/url?q=/", "http://"),
    ]
    df = spark.createDataFrame(cases, "href STRING, expected STRING")
    for r in df.select("expected", urls.unwrap_link("href").alias("got")).collect():
        assert r.got == r.expected


def test_symbol_from_href(spark):
    cases = [("/quote/AAPL:US", "quote/AAPL"), ("/a/b:c:d", "a/b:c"), ("nohref", None), ("/:", None)]
    df = spark.createDataFrame(cases, "href STRING, expected STRING")
    for r in df.select("expected", urls.symbol_from_href("href").alias("got")).collect():
        assert r.got == r.expected
