"""J1, J2, D16, U1, L1, L3, J3-J5."""

from pyspark.sql import functions as F

from tickerwire.operators import company, frontier


def test_build_queries_depth(spark):
    t = spark.createDataFrame([("AAPL", 0), ("ZZZ", 1)], "ticker STRING, ticker_pos INT")
    names = spark.createDataFrame([("AAPL", "Apple Inc. Computers"), ("ZZZ", None)], "ticker STRING, name STRING")
    q1 = frontier.build_queries(t, ["reuters", "wsj"], depth=1)
    assert q1.count() == 4
    q2 = frontier.build_queries(t, ["reuters", "wsj"], depth=2, names=names)
    got = q2.orderBy("ticker_pos", "source_pos", "sub").select("ticker", "string").collect()
    assert [r.string for r in got] == [
        "Apple+Computers+reuters+stock+news", "AAPL+reuters+stock+articles",
        "Apple+Computers+wsj+stock+news", "AAPL+wsj+stock+articles",
        "ZZZ+reuters+stock+articles", "ZZZ+wsj+stock+articles"]


def test_drop_parsed_keeps_bag_duplicates(spark):
    cands = spark.createDataFrame([("aapl", "u1"), ("AAPL", "u2"), ("AAPL", "u2"), ("MSFT", "u1")],
                                  "ticker STRING, url STRING")
    parsed = spark.createDataFrame([("AAPL", "reuters", "u1")], "ticker STRING, source STRING, url STRING")
    got = sorted((r.ticker, r.url) for r in frontier.drop_parsed(cands, parsed).collect())
    assert got == [("AAPL", "u2"), ("AAPL", "u2"), ("MSFT", "u1")]


def test_first_query_only_matches_sequential_simulation(spark):
    # two queries of one ticker find overlapping URLs; the second only keeps
    # what the first did not find; repeats inside the first query stay
    rows = [("A", 0, "u1"), ("A", 0, "u1"), ("A", 0, "u2"), ("A", 1, "u2"), ("A", 1, "u3"), ("B", 0, "u2")]
    df = spark.createDataFrame(rows, "ticker STRING, q INT, url STRING")
    got = sorted(tuple(r) for r in frontier.first_query_only(df, ["q"]).collect())
    seen, expected = {}, []
    for t, q, u in rows:
        if seen.get((t, u), q) == q:
            seen[(t, u)] = q
            expected.append((t, q, u))
    assert got == sorted(expected)
    assert len(got) == 5


def test_union_shuffle_head(spark):
    a = spark.createDataFrame([("X",), ("Y",)], "ticker STRING")
    b = spark.createDataFrame([("Y",)], "ticker STRING")
    assert frontier.ticker_universe(a, b).count() == 3
    assert frontier.ticker_universe(a, b, distinct=True).count() == 2
    big = spark.range(100).withColumnRenamed("id", "k")
    assert sorted(r.k for r in frontier.shuffle_rows(big, 3).collect()) == list(range(100))
    assert [r.k for r in frontier.head(big, 5, "k").collect()] == [0, 1, 2, 3, 4]


def test_company_joins(spark):
    df = spark.createDataFrame([("aapl",), ("none",)], "ticker STRING")
    comp = spark.createDataFrame([("AAPL", "Tech", "IT")], "ticker STRING, industry STRING, sector STRING")
    got = {r.ticker: (r.industry, r.sector) for r in company.with_company(df, comp).collect()}
    assert got == {"aapl": ("Tech", "IT"), "none": (None, None)}

    syms = spark.createDataFrame([("AAPL", "Apple 2", 5), ("AAPL", "Apple 1", 2), ("MSFT", "Msft", 1)],
                                 "symbol STRING, name STRING, position INT")
    t = spark.createDataFrame([("AAPL",), ("aapl",), ("GOOG",)], "ticker STRING")
    got = {r.ticker: r.name for r in company.with_name(t, syms).collect()}
    assert got == {"AAPL": "Apple 1", "aapl": None, "GOOG": None}

    s = spark.createDataFrame([("wsj",), ("WSJ",), ("nope",)], "source STRING")
    got = {r.source: r.host for r in company.source_translation(s, "source").collect()}
    assert got == {"wsj": "www.wsj.com", "WSJ": None, "nope": None}
    h = spark.createDataFrame([("www.wsj.com",)], "h STRING")
    assert company.source_translation(h, "h", to_host=False).first().source_name == "wsj"


def test_bucketed_store_is_read_where_it_lies(spark, tmpdir_path):
    """The store meets the candidates without an exchange; only they move."""
    import os
    from tickerwire.sources import parsed_store
    old = [("aaa", "WSJ", f"http://x/{i % 50}") for i in range(120)] + [(None, "wsj", "http://x/1"), ("BBB", "wsj", None)]
    name, path = "parsed_urls_test", os.path.join(tmpdir_path, "store")
    assert parsed_store.attach(spark, name, path, 8).count() == 0
    for part in (old[:70], old[70:]):
        parsed_store.append(spark.createDataFrame(part, "ticker STRING, source STRING, url STRING"), name, 8)
    # another session finds the same buckets
    other = spark.newSession()
    other.sql(f"DROP TABLE IF EXISTS {name}")
    store = parsed_store.attach(spark, name, path, 8)
    assert store.count() == len(old) and {r.source for r in store.collect()} == {"wsj"}
    rows = [("AAA", f"http://x/{i % 60}") for i in range(150)] + [("bbb", "http://x/3"), (None, "http://x/1"), ("BBB", None)]
    cands = spark.createDataFrame(rows, "ticker STRING, url STRING")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = frontier.first_query_only(frontier.drop_parsed(cands.selectExpr("*", "1 AS o"), store, keep_key=True, stored=True), ["o"])
        got = sorted(str((r.ticker, r.url)) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    seen = {(t and t.upper(), u) for t, _, u in old if t and u}
    want = [r for r in rows if not (r[0] and (r[0].upper(), r[1]) in seen)]
    assert got == sorted(map(str, want))
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    new = parsed_store.compact(spark, name, name + "_2", path + "2", 8)
    assert new.count() == 52
    compacted = spark.table(name).distinct()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in compacted
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"DROP TABLE {name}_2")


def test_repeated_tickers_and_blank_names(spark):
    t = spark.createDataFrame([("A", 0), ("A", 1), ("B", 2), ("C", 3)], "ticker STRING, ticker_pos BIGINT")
    names = spark.createDataFrame([("A", "Acme Inc."), ("A", "Acme Inc."), ("B", ""), ("B", " "), ("C", None)], "ticker STRING, name STRING")
    got = frontier.build_queries(t, ["wsj"], 2, names).orderBy("ticker_pos", "sub").collect()
    assert [(r.ticker, r.string) for r in got] == [("A", "Acme+wsj+stock+news"), ("A", "A+wsj+stock+articles")] * 2 + [
        ("B", "B+wsj+stock+articles"), ("C", "C+wsj+stock+articles")]
