"""Scalar functions F1-F11 on hand-made edge cases."""

import datetime as dt

import pytest

from tickerwire.functions import dates, labels, text


def one(spark, expr, value, schema="s STRING"):
    return spark.createDataFrame([(value,)], schema).select(expr).first()[0]


def test_querify(spark):
    assert one(spark, text.querify("s"), "under armour  news") == "under+armour++news"


def test_query_string_and_company_query(spark):
    df = spark.createDataFrame([("AAPL", "Apple Inc. Computers", "reuters")], "t STRING, n STRING, s STRING")
    r = df.select(text.query_string("t", "s").alias("a"), text.company_query("n", "s").alias("b")).first()
    assert r.a == "AAPL+reuters+stock+articles"
    assert r.b == "Apple+Computers+reuters+stock+news"
    # only the exact token is dropped
    assert one(spark, text.company_query("s", "s"), "Inc Inc.,") == "Inc+Inc.,+Inc Inc.,+stock+news"


def test_collapse_ws_unicode(spark):
    s = "  Hello\t\n  wide　world  "
    assert one(spark, text.collapse_ws("s"), s) == "Hello wide world"
    assert one(spark, text.strip_all_ws("s"), " A A P L\n") == "AAPL"


@pytest.mark.parametrize("value,expected", [("", 1), ("a", 1), ("a b", 2), ("a  b", 3), (" a ", 3)])
def test_word_count(spark, value, expected):
    assert one(spark, text.word_count("s"), value) == expected


@pytest.mark.parametrize("value,expected", [
    ("Published 2020-06-05T10:00:00Z", dt.date(2020, 6, 5)),
    ("on June 5, 2020 at noon", dt.date(2020, 6, 5)),
    ("Jun 5, 2020", dt.date(2020, 6, 5)),
    ("Sep. 15, 2019", dt.date(2019, 9, 15)),
    ("May 1, 2018", dt.date(2018, 5, 1)),
    ("5 June 2020", dt.date(2020, 6, 5)),
    ("6/5/2020", dt.date(2020, 6, 5)),
    ("first 1/2/2003 then 2004-05-06", dt.date(2003, 1, 2)),   # earliest position wins
    ("13/45/2019 then July 5, 2020", dt.date(2020, 7, 5)),          # a false match is passed over
    ("JULY 5, 2020", dt.date(2020, 7, 5)),
    ("Sept. 5, 2020", dt.date(2020, 9, 5)),
    ("5 Jul 2020", dt.date(2020, 7, 5)),
    ("July 5 2020", dt.date(2020, 7, 5)),
    ("July 5th, 2020", dt.date(2020, 7, 5)),
    ("5 July, 2020", dt.date(2020, 7, 5)),
    ("/news/2020/07/05/x", dt.date(2020, 7, 5)),
    ("2021-02-30", None),                                       # not a calendar date
    ("no date here", None),
    (None, None),
])
def test_publish_date(spark, value, expected):
    assert one(spark, dates.publish_date("s"), value) == expected
    df = spark.createDataFrame([(value,)], "s STRING")
    assert dates.with_publish_date(df, "s").first()["publish_date"] == expected


def test_price_and_horizon_class(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (1.0, 1.0), (None, 1.0), (1.0, None),
                                (1.0, 0.3), (1.0, float("nan"))], "p0 DOUBLE, p1 DOUBLE")
    got = df.select(labels.price_class("p0", "p1").alias("c"),
                    labels.horizon_class("p1", "p0").alias("h")).collect()
    assert [r.c for r in got][:5] == [1, -1, 0, -1000, -1000]
    assert [r.h for r in got] == [1, -1, 0, None, None, 0, None]   # -0.7 truncates to 0
