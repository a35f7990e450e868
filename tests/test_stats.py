"""A1-A10, W1-W3, C5 on small frames."""

import numpy as np

from tickerwire.operators import stats


def test_source_stats_accuracy_running(spark):
    runs = spark.createDataFrame([("a", 1, 10, 5), ("a", 2, 10, 0), ("b", 1, 0, 0), ("a", 2, 4, 1)],
                                 "source STRING, run INT, num_urls BIGINT, num_nodes BIGINT")
    st = {r.source: (r.num_urls, r.num_nodes, r.accuracy)
          for r in stats.source_accuracy(stats.source_stats(runs)).collect()}
    assert st == {"a": (24, 6, 0.25), "b": (0, 0, None)}
    run = [(r.run, r.total_urls, r.total_nodes)
           for r in stats.running_stats(runs).filter("source = 'a'").orderBy("run").collect()]
    assert run == [(1, 10, 5), (2, 24, 6)]


def test_counts_and_means(spark):
    df = spark.createDataFrame([("s1", "a b c", 1), ("s1", "a", None), ("s2", "", 0)],
                               "source STRING, article STRING, classification INT")
    assert {r.source: r.n_classified for r in stats.source_counts(df).collect()} == {"s1": 1, "s2": 1}
    assert {r.classification: r.n for r in stats.class_counts(df).collect()} == {1: 1, 0: 1}
    assert stats.mean_article_len(df).first().mean_len == (3 + 1 + 1) / 3
    assert {r.source: r.mean_len for r in stats.mean_len_by_source(df).collect()} == {"s1": 2.0, "s2": 1.0}


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = [int(v) for v in rng.integers(-5, 9, 200)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "classification INT")
    counts, edges = np.histogram([v for v in vals if v is not None], bins=3)
    got = sorted((r.bin, r.n, r.lower, r.upper) for r in stats.class_histogram(df).collect())
    assert [g[1] for g in got] == list(counts)
    assert np.allclose([g[2] for g in got], edges[:-1]) and np.isclose(got[-1][3], edges[-1])
    const = spark.createDataFrame([(4,), (4,)], "classification INT")
    counts, edges = np.histogram([4, 4], bins=3)
    got = sorted((r.bin, r.n) for r in stats.class_histogram(const).collect())
    assert got == [(i + 1, int(c)) for i, c in enumerate(counts)]
    none = spark.createDataFrame([(None,), (float("nan"),)], "classification DOUBLE")
    assert [(r.bin, r.lower, r.n) for r in stats.class_histogram(none, bins=2).orderBy("bin").collect()] == [(1, 0.0, 0), (2, 0.5, 0)]


def test_first_match_odd_rows_yield(spark):
    ev = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (1, 3, "z"), (2, 9, "w")],
                               "k INT, ts INT, v STRING")
    got = {r.k: r.v for r in stats.first_match(ev, ["k"], ["ts", "v"], ["v"]).collect()}
    assert got == {1: "y", 2: "w"}
    arr = spark.createDataFrame([(1, ["h", "a", "b", "c"])], "k INT, rows ARRAY<STRING>")
    assert [(r.row_pos, r.row) for r in stats.odd_rows(arr, "rows").collect()] == [(1, "a"), (3, "c")]
    urls = spark.createDataFrame([("T", "s", "q", "u1"), ("T", "s", "q", "u2"), ("T", "s", "r", "u3")],
                                 "ticker STRING, source STRING, string STRING, url STRING")
    nodes = urls.filter("url = 'u1'")
    got = {r.string: (r.urls_found, r.nodes_built) for r in stats.per_query_yield(urls, nodes).collect()}
    assert got == {"q": (2, 1), "r": (1, 0)}


def test_corpus_summary(spark):
    arts = spark.createDataFrame([("s1", "a b", 1), ("s2", "a", None)],
                                 "source STRING, article STRING, classification INT")
    st = spark.createDataFrame([("s1", 4, 1)], "source STRING, num_urls BIGINT, num_nodes BIGINT")
    got = {(r.metric, r.key): r.value for r in stats.corpus_summary(arts, st).collect()}
    assert got[("class_count", "1")] == 1.0
    assert got[("source_count", "s2")] == 0.0
    assert got[("mean_len", None)] == 1.5
    assert got[("accuracy", "s1")] == 0.25
    assert [got[("class_histogram", str(b))] for b in (1, 2, 3)] == [0.0, 1.0, 0.0]


def test_groups_come_in_order(spark):
    """L2: classes and sources ascend."""
    df = spark.createDataFrame([(s, "a", c) for s, c in zip("zbxaycz", (5, -3, 11, 0, -1000, 2, None))], "source STRING, article STRING, classification INT").repartition(4)
    assert [r.classification for r in stats.class_counts(df).collect()] == [-1000, -3, 0, 2, 5, 11]
    for out in (stats.source_counts(df), stats.mean_len_by_source(df)):
        assert [r.source for r in out.collect()] == sorted(set("zbxayc"))


def test_empty_links_are_dropped(spark):
    """A redirect without a target gives no link."""
    from tickerwire.operators import extract
    blocks = "".join(f'<div class="g"><a href="{h}">x</a></div>' for h in ("/url?q=", "/url?q=/", "/url", "", "/url?q=http://a.com/"))
    df = spark.createDataFrame([(1, blocks)], "k INT, html STRING")
    assert [r.url for r in extract.result_links(df).orderBy("link_pos").collect()] == ["http://", "http://a.com/"]
