"""S3-S12 round trips."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tickerwire.operators.articles import NODE_COLUMNS
from tickerwire.sources import files

NODE_SCHEMA = ("ArticleName STRING, Industry STRING, NewsSource STRING, PublishDate DATE, "
               "Sector STRING, Ticker STRING, Url STRING")


def _nodes(spark):
    import datetime as dt
    rows = [("Tïtle one", "Tech", "reuters", dt.date(2024, 1, 2), None, "AAPL", "https://r/1"),
            ("Two", None, "wsj", None, "IT", "AAPL", "https://w/2"),
            ("Three", "Oil", "reuters", dt.date(2024, 1, 3), "Energy", "XOM", "https://r/3")]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def test_read_articles_csv_latin1(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "examples.csv")
    with open(path, "w", encoding="latin-1") as f:
        f.write("url,source,article,t0,t6,extra\n")
        f.write('http://a,reuters,"caf\xe9 society, again",1.5,2.0,x\n')
        f.write("http://b,wsj,plain,3.0,,y\n")
    got = files.read_articles_csv(spark, path).orderBy("url").collect()
    assert got[0].article == "café society, again" and got[0].t6 == 2.0
    assert got[1].t6 is None


def test_stats_json_round_trip(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "stats.json")
    with open(path, "w") as f:
        json.dump({"reuters": {"num_urls": 10, "num_nodes": 4}, "wsj": {"num_urls": 3, "num_nodes": 0}}, f, indent=4)
    got = {r.source: (r.num_urls, r.num_nodes) for r in files.read_stats_json(spark, path).collect()}
    assert got == {"reuters": (10, 4), "wsj": (3, 0)}
    doc = files.stats_document(files.read_stats_json(spark, path))
    back = {r.source: (r.num_urls, r.num_nodes) for r in files.parse_stats_docs(doc).collect()}
    assert back == got


def test_append_stores(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "articles")
    n = _nodes(spark)
    files.append_articles(n, store)
    files.append_articles(n.limit(1), store)
    assert files.read_articles(spark, store).count() == 4
    assert files.read_articles(spark, store).filter("Ticker = 'XOM'").count() == 1

    parsed = os.path.join(tmpdir_path, "parsed")
    assert files.read_parsed(spark, parsed).count() == 0            # missing store reads empty
    u = spark.createDataFrame([("aapl", "Reuters", "u1"), ("aapl", "Reuters", "u1")],
                              "ticker STRING, source STRING, url STRING")
    files.append_parsed(u, parsed)
    files.append_parsed(u.limit(1), parsed)
    got = files.read_parsed(spark, parsed).collect()
    assert len(got) == 3 and {(r.ticker, r.source) for r in got} == {("AAPL", "reuters")}


def test_write_stats_versioned(spark, tmpdir_path):
    st = spark.createDataFrame([("reuters", 1, 1)], "source STRING, num_urls BIGINT, num_nodes BIGINT")
    out = files.write_stats(st, os.path.join(tmpdir_path, "stats"), 1)
    assert out.endswith("v=1") and spark.read.parquet(out).count() == 1
    with pytest.raises(Exception):
        files.write_stats(st, os.path.join(tmpdir_path, "stats"), 1)   # never overwrite a version


def test_export_csv_mixed_attributes_fail(spark, tmpdir_path):
    n = _nodes(spark)
    files.export_csv(n, os.path.join(tmpdir_path, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv"))
    assert back.columns == sorted(n.columns) and back.count() == 3
    with pytest.raises(Exception):
        files.export_csv(n, os.path.join(tmpdir_path, "csv2"), n.drop("Sector"))


def test_survey_payload_keeps_nulls(spark):
    got = [json.loads(r.payload) for r in files.survey_payload(_nodes(spark)).collect()]
    assert list(got[1]["values"].keys()) == sorted(got[1]["values"].keys())
    assert got[1]["values"]["Industry"] is None and got[1]["values"]["PublishDate"] is None
    assert got[0]["values"]["PublishDate"] == "2024-01-02" and got[0]["values"]["ArticleName"] == "Tïtle one"


def test_page_scan(spark):
    urls = spark.createDataFrame([("u1",), ("u2",)], "url STRING")
    pages = spark.createDataFrame([("u1", "<html/>")], "url STRING, html STRING")
    got = {r.url: r.reject_reason for r in files.page_scan(urls, pages).collect()}
    assert got == {"u1": None, "u2": "fetch"}


NASTY = ['a"b', "a\\", "é\n😀", "", "{}", "a+b", "]", "null"]


def _whole_document(path):
    """The files' documents put together as their readers do."""
    def merge(a, b):
        for k, v in b.items():
            if isinstance(v, list):
                a.setdefault(k, []).extend(v)
            else:
                merge(a.setdefault(k, {}), v)
        return a
    out, names = {}, sorted(x for x in os.listdir(path) if x.startswith("part-"))
    for name in names:
        with open(os.path.join(path, name), encoding="utf-8") as f:
            text = f.read()
        merge(out, json.loads(text) if text.strip() else {})
    return out, len(names)


def test_nested_articles_are_json_documents(spark, tmpdir_path):
    import datetime as dt
    rows = [(f"t{i}", None, s, dt.date(2024, 1, 1 + i % 9), None, t, f"u{i}") for i, (t, s) in enumerate((t, s) for t in NASTY for s in ("wsj", "r"))]
    rows += [("same", None, "hot", None, None, "HOT", "u")] * 3 + [(f"h{i}", "x", "hot", None, None, "HOT", f"u{i}") for i in range(3000)]
    rows += [("no key", None, None, None, None, None, "u")]
    n = spark.createDataFrame(rows, NODE_SCHEMA).repartition(3)
    path = os.path.join(tmpdir_path, "docs")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        files.write_nested_articles(n, path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    doc, parts = _whole_document(path)
    key = lambda r: "" if r[5] is None else f"{r[5]}+{r[2]}"
    want = {}
    for r in rows:
        want.setdefault(key(r), []).append(dict(zip(NODE_COLUMNS, (x.isoformat() if isinstance(x, dt.date) else x for x in r))))
    order = lambda d: {k: sorted(v, key=str) for k, v in d.items()}
    assert order(doc) == order(want) and parts >= 3       # the hot key goes over several files
    back = files.read_nested_articles(spark, path)
    assert sorted(str((r.store_key, r.Url, r.PublishDate)) for r in back.collect()) == sorted(str((key(r), r[6], r[3])) for r in rows)
    files.write_nested_articles(n.limit(0), os.path.join(tmpdir_path, "none"))
    assert files.read_nested_articles(spark, os.path.join(tmpdir_path, "none")).count() == 0


def test_nested_urls_are_json_documents(spark, tmpdir_path):
    rows = [("aapl", "Reuters", f"u{i % 15}") for i in range(20)] + [("MSFT", s, u) for s in NASTY for u in (*NASTY, None)]
    path = os.path.join(tmpdir_path, "urls")
    files.write_nested_urls(spark.createDataFrame(rows, "ticker STRING, source STRING, url STRING"), path)
    doc, _ = _whole_document(path)
    assert set(doc) == {"AAPL", "MSFT"} and doc["AAPL"] == {"reuters": sorted(f"u{i % 15}" for i in range(20))}
    got = files.read_nested_urls(spark, path).collect()
    assert sorted(str((r.ticker, r.source, r.url)) for r in got) == sorted(str((t.upper(), s.lower(), u)) for t, s, u in rows)
    # a document of the old kind, one file written by hand
    one = os.path.join(tmpdir_path, "links.json")
    with open(one, "w") as f:
        json.dump({"A": {"wsj": ["x", "x"], "r": []}, "B": {}}, f, indent=4)
    assert [tuple(r) for r in files.read_nested_urls(spark, one).collect()] == [("A", "wsj", "x")] * 2


def test_write_run_accumulates(spark, tmpdir_path):
    from conftest import SMALL
    from tickerwire.operators import articles
    from tickerwire.plans import catalog
    run = catalog._batch(spark, SMALL)
    paths = [os.path.join(tmpdir_path, x) for x in ("store", "parsed", "stats")]
    s0 = {r.source: (r.num_urls, r.num_nodes) for r in articles.write_run(run, *paths, 0).collect()}
    expected = {r.source: (r.num_urls, r.num_nodes) for r in run["stats"].collect()}
    assert s0 == expected
    s1 = {r.source: (r.num_urls, r.num_nodes) for r in articles.write_run(run, *paths, 1).collect()}
    assert s1 == {k: (2 * u, 2 * n) for k, (u, n) in expected.items()}
    assert spark.read.parquet(paths[0]).count() == 2 * run["nodes"].count()
    assert spark.read.parquet(paths[1]).count() == 2 * run["parsed"].count()


def test_registries_and_exports(spark, tmpdir_path):
    from tickerwire.operators.articles import sorted_columns
    from tickerwire.sources import registry
    assert registry.watchlist_df(spark).count() == 13
    assert registry.hosts_df(spark).count() == 16
    assert registry.homepage_df(spark).filter("source = 'reuters'").count() == 5
    sel = registry.selectors_df(spark)
    assert sel.filter("field = 'date'").count() == 6 and sel.filter("field = 'title'").count() == 6
    assert [r.source for r in registry.sources_df(spark).orderBy("position").collect()] == registry.VALID_SOURCES
    n = _nodes(spark)
    assert sorted_columns(n.select("Url", "Ticker", "ArticleName")).columns == ["ArticleName", "Ticker", "Url"]
    out = os.path.join(tmpdir_path, "payloads")
    files.export_survey_json(n, out)
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert len(lines) == 3 and all(set(x) == {"values"} for x in lines)


def test_node_attributes_by_option(spark):
    from tickerwire.operators.articles import label_nodes, to_nodes
    from tickerwire.options import Options
    import datetime as dt
    df = spark.createDataFrame([("T", None, "wsj", dt.date(2024, 1, 2), "i", "s", "aa", "u"), ("T2", "R", "wsj", None, "i", "s", "aa", "u2")],
                               "title STRING, source STRING, site STRING, publish_date DATE, industry STRING, sector STRING, ticker STRING, url STRING")
    ticks = spark.createDataFrame([("AA", dt.datetime(2024, 1, 1, 23), 1.0), ("AA", dt.datetime(2024, 1, 2, 0, 5), 3.0)], "ticker STRING, ts TIMESTAMP, price DOUBLE")
    assert to_nodes(df).columns == NODE_COLUMNS
    assert to_nodes(df, Options(industry=False, sector=False)).columns == ["ArticleName", "NewsSource", "PublishDate", "Ticker", "Url"]
    got = to_nodes(label_nodes(df, ticks), Options(classification=True)).orderBy("Url").collect()
    assert [(r.Classification, r.NewsSource) for r in got] == [(1, "wsj"), (-1000, "r")]
    assert [r.Classification for r in to_nodes(label_nodes(df, ticks, max_age="30 minutes"), Options(classification=True)).collect()] == [-1000, -1000]


def test_one_page_of_a_url_counts(spark):
    from tickerwire.operators.articles import build_nodes
    u = "https://www.wsj.com/a/1"
    html = '<h1 class="wsj-article-headline">{}</h1><time>2024-01-0{}</time>'
    store = [(u, html.format("old", 1), 1), (u, html.format("mid", 2), 2), (u, html.format("mid", 2), 2), (u, html.format("also mid", 3), 2),
             (u, html.format("new", 4), 3), (u, None, None), (None, "x", 1)]
    pages = spark.createDataFrame(store, "url STRING, html STRING, v INT")
    urls = spark.createDataFrame([("T", "wsj", u), ("T", "wsj", u), ("T", "wsj", "https://www.wsj.com/a/2"), ("T", "wsj", None)], "ticker STRING, source STRING, url STRING")
    companies = spark.createDataFrame([("T", "i", "s")], "ticker STRING, industry STRING, sector STRING")
    def titles(**how):
        return sorted(r.title for r in build_nodes(urls, pages, companies, **how).collect())
    assert titles(version="v") == ["new"] * 2 and titles(version="v", at="1") == ["old"] * 2
    mid = titles(version="v", at="2")
    assert mid in (["mid"] * 2, ["also mid"] * 2) and mid == titles(version="v", at="2")
    assert len(set(titles())) == 1 and len(titles()) == 2
    for how in ({}, {"version": "v"}, {"version": "v", "at": "2"}):
        rows_ = files.page_scan(urls, pages, **how).collect()
        assert len(rows_) == 4 and [r.reject_reason for r in rows_].count("fetch") == 2
    assert files.page_scan(urls, pages, version="v", at="1").where("html is not null").first().html == html.format("old", 1)


def test_one_line_csv_is_split_by_size(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "one.csv")
    with open(path, "w", encoding="latin-1") as f:
        f.write("url,source,article,t0\n" + "".join(f'http://x/{i},wsj,"word ""é"", {i}",{i}.5\n' for i in range(30000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        one, many = files.read_articles_csv(spark, path), files.read_articles_csv(spark, path, multi_line=False)
        assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 3
        assert many.count() == 30000 and many.exceptAll(one).count() == 0
        assert many.filter("t0 = 7.5").first().article == 'word "é", 7'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
