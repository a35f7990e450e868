"""Streams equal the batch result; a replayed micro-batch is
harmless."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tickerwire.operators.articles import build_nodes
from tickerwire.streaming import ingest

SCHEMA = "ticker STRING, source STRING, string STRING, url STRING"


def _inputs(spark):
    pages = spark.createDataFrame(
        [(f"https://www.reuters.com/a/{i}",
          f'<h1 class="ArticleHeader_headline">T{i}</h1><div class="ArticleHeader_date">2024-01-0{1 + i % 9}</div>')
         for i in range(12)], "url STRING, html STRING")
    companies = spark.createDataFrame([("AAA", "I", "S")], "ticker STRING, industry STRING, sector STRING")
    return pages, companies


def test_ingest_stream_equals_batch_and_dedupes(spark, tmpdir_path):
    pages, companies = _inputs(spark)
    land = os.path.join(tmpdir_path, "landing")
    # three landing files; file 2 repeats two URLs of file 0 (already parsed)
    batches = [[("AAA", "reuters", "q", f"https://www.reuters.com/a/{i}") for i in range(0, 5)],
               [("AAA", "reuters", "q", f"https://www.reuters.com/a/{i}") for i in range(5, 9)],
               [("AAA", "reuters", "q", f"https://www.reuters.com/a/{i}") for i in (0, 1, 9, 10, 11)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(os.path.join(land, f"f{i}"))
    store, parsed = os.path.join(tmpdir_path, "store"), os.path.join(tmpdir_path, "parsed")
    q = ingest.ingest_stream(spark, os.path.join(land, "*"), SCHEMA, pages, companies, store, parsed,
                             os.path.join(tmpdir_path, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination()
    got = spark.read.parquet(store)
    assert got.select("batch_id").distinct().count() == 3
    all_rows = spark.createDataFrame([r for b in batches for r in b], SCHEMA).dropDuplicates(["url"])
    expected = build_nodes(all_rows, pages, companies)
    cols = ["ticker", "source", "url", "title", "publish_date"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == \
        sorted(tuple(r) for r in expected.select(cols).collect())

    # replaying batch 1 rewrites the same rows (it only sees batch 0 as earlier)
    before = sorted(tuple(r) for r in spark.read.parquet(store).select(cols).collect())
    ingest.ingest_batch(spark.createDataFrame(batches[1], SCHEMA), 1, pages, companies, store, parsed)
    after = sorted(tuple(r) for r in spark.read.parquet(store).select(cols).collect())
    assert before == after


def test_stats_stream_equals_batch(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "runs")
    data = [("reuters", 3, 1), ("wsj", 2, 2), ("reuters", 5, 0), ("wsj", 1, 1)]
    for i in range(2):
        spark.createDataFrame(data[2 * i:2 * i + 2], "source STRING, num_urls BIGINT, num_nodes BIGINT") \
            .write.parquet(os.path.join(land, f"f{i}"))
    runs = (spark.readStream.schema("source STRING, num_urls BIGINT, num_nodes BIGINT")
            .option("maxFilesPerTrigger", 1).parquet(os.path.join(land, "*")))
    out = os.path.join(tmpdir_path, "out")
    ingest.write_versions(ingest.stats_stream(runs), out, os.path.join(tmpdir_path, "ck")).awaitTermination()
    got = {r.source: (r.num_urls, r.num_nodes) for r in ingest.read_latest_version(spark, out).collect()}
    assert got == {"reuters": (8, 1), "wsj": (3, 3)}


def test_dedupe_stream(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "urls")
    rows = [("A", "u1", "2024-01-01 00:00:00"), ("A", "u1", "2024-01-01 05:00:00"),
            ("A", "u2", "2024-01-01 06:00:00"), ("B", "u1", "2024-01-01 07:00:00")]
    spark.createDataFrame(rows, "ticker STRING, url STRING, ts STRING") \
        .withColumn("ts", F.to_timestamp("ts")).write.parquet(os.path.join(land, "f0"))
    s = spark.readStream.schema("ticker STRING, url STRING, ts TIMESTAMP").parquet(os.path.join(land, "*"))
    out = os.path.join(tmpdir_path, "dd")
    q = (ingest.dedupe_stream(s, ["ticker", "url"], "ts", "1 day").writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.ticker, r.url) for r in spark.read.parquet(out).collect())
    assert got == [("A", "u1"), ("A", "u2"), ("B", "u1")]


def _arrivals(spark):
    """Four files: a URL found by two queries of one file, and again later."""
    url = "https://www.reuters.com/a/{}".format
    return [[("AAA", "reuters", "q1", url(0), 1), ("AAA", "reuters", "q0", url(0), 0), ("AAA", "reuters", "q0", url(0), 0), ("aaa", "reuters", "q2", url(1), 2)],
            [("aaa", "reuters", "q3", url(1), 0), ("AAA", "reuters", "q3", url(2), 0), ("BBB", "reuters", "q4", url(2), 1), ("AAA", "reuters", "q5", url(99), 2)],
            [("AAA", "reuters", "q6", url(99), 0), ("AAA", "reuters", "q6", url(3), 0), ("AAA", "reuters", "q7", url(0), 1)],
            [("AAA", "reuters", "q8", url(i), 0) for i in range(5)]]


SCHEMA_ORDERED = SCHEMA + ", pos INT"


def test_batches_are_runs_one_after_the_other(spark, tmpdir_path):
    pages, companies = _inputs(spark)
    paths = [os.path.join(tmpdir_path, x) for x in ("store", "parsed")]
    stats = os.path.join(tmpdir_path, "stats")
    batches = [spark.createDataFrame(b, SCHEMA_ORDERED) for b in _arrivals(spark)]

    def run(n):
        ingest.ingest_batch(batches[n], n, pages, companies, *paths, order_cols=("pos",), stats_path=stats, compact_every=2, buckets=4)

    def state():
        nodes = sorted((r.batch_id, r.ticker, r.string, r.url[-2:]) for r in spark.read.parquet(paths[0]).collect())
        return nodes, sorted(tuple(r) for r in ingest.read_parsed_before(spark, paths[1]).distinct().collect()), sorted(tuple(r) for r in ingest.read_stats(spark, stats).collect())

    for n in range(3):
        run(n)
        once = state()
        run(n)          # a replayed batch changes nothing
        assert state() == once, n
    # batch 2 folded batches 0 and 1: they cannot run against their own output
    assert ingest._numbered(spark, f"{paths[1]}/base", "upto=") == [1] and ingest._numbered(spark, f"{paths[1]}/delta", "batch_id=") == [2]
    with pytest.raises(ValueError, match="folded"):
        run(1)
    run(3)
    nodes, parsed, totals = state()
    assert nodes == [(0, "AAA", "q0", "/0"), (0, "AAA", "q0", "/0"), (0, "aaa", "q2", "/1"), (1, "AAA", "q3", "/2"), (1, "BBB", "q4", "/2"),
                     (2, "AAA", "q6", "/3"), (3, "AAA", "q8", "/4")]
    # the page 99 does not exist: q5 built nothing, so q6 found its URL again
    assert totals == [("reuters", 8, 7)] and len(parsed) == 7
    assert ingest.read_stats(spark, f"{tmpdir_path}/none").count() == 0


def test_an_interrupted_fold_changes_nothing(spark, tmpdir_path):
    pages, companies = _inputs(spark)
    paths = [os.path.join(tmpdir_path, x) for x in ("store", "parsed")]
    for n, b in enumerate(_arrivals(spark)[:2]):
        ingest.ingest_batch(spark.createDataFrame(b, SCHEMA_ORDERED), n, pages, companies, *paths, order_cols=("pos",), buckets=4)
    before = sorted(map(str, ingest.read_parsed_before(spark, paths[1]).collect()))
    # a base without its commit mark: written in part, then lost
    spark.createDataFrame([("X", "y", "z", 1)], "ticker STRING, source STRING, url STRING, bucket INT") \
        .write.partitionBy("bucket").parquet(f"{paths[1]}/base/upto=1")
    os.remove(f"{paths[1]}/base/upto=1/_SUCCESS")
    assert sorted(map(str, ingest.read_parsed_before(spark, paths[1]).collect())) == before
    ingest.compact_parsed(spark, paths[1], 2)
    assert sorted(map(str, ingest.read_parsed_before(spark, paths[1]).collect())) == sorted(set(before))


def _horizon(rows, hours):
    """In order of time a row stays unless one of its key stayed within the horizon before."""
    last, stay = {}, []
    for i, key, ts in sorted(rows, key=lambda r: r[2]):
        if key not in last or ts > last[key] + dt.timedelta(hours=hours):
            last[key] = ts
            stay.append(i)
    return sorted(stay)


def test_horizon_does_not_depend_on_batch_borders(spark, tmpdir_path):
    r = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    times = sorted(r.sample(range(60 * 24 * 5), 200))
    rows = [(i, r.choice(["a", "b", "c", None]), base + dt.timedelta(minutes=m)) for i, m in enumerate(times)]
    schema = "id INT, key STRING, ts TIMESTAMP"
    for k, borders in enumerate(([200], [50, 100, 150, 200], [1, 2, 9, 130, 131, 200])):
        land = os.path.join(tmpdir_path, f"land{k}")
        start = 0
        for n, end in enumerate(borders):
            part = rows[start:end]
            r.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(land, f"f{n}"))
            start = end
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(land, "*"))
        out = os.path.join(tmpdir_path, f"out{k}")
        q = (ingest.dedupe_horizon_stream(s, ["key"], "ts", "7 hours").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", os.path.join(tmpdir_path, f"ck{k}")).trigger(availableNow=True).start())
        q.awaitTermination()
        assert sorted(x.id for x in spark.read.parquet(out).collect()) == _horizon(rows, 7), borders


def test_horizon_state_is_kept_per_bucket(spark, tmpdir_path):
    """Python and the state store see a few buckets, however many keys there
    are; keys stay exact beside nulls."""
    r = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    big = 2 ** 60
    keys = [(user, kind, x) for user in [None, *range(big, big + 60)] for kind in ("a", None) for x in (None, 0.5)]
    times = sorted(r.choices(range(60 * 24 * 4), k=2000))
    rows = [(big + i if i % 7 else None, *r.choice(keys), base + dt.timedelta(minutes=m, microseconds=i)) for i, m in enumerate(times)]
    schema = "id BIGINT, user BIGINT, kind STRING, x DOUBLE, ts TIMESTAMP"
    land, out = os.path.join(tmpdir_path, "land"), os.path.join(tmpdir_path, "out")
    state, wanted, last = [], [], {}
    for row in rows:
        if row[1:4] not in last or row[4] > last[row[1:4]] + dt.timedelta(hours=30):
            last[row[1:4]] = row[4]
            wanted.append(row)
    for n in range(4):   # a run per arrival, from the checkpoint of the one before
        part = rows[500 * n:500 * (n + 1)]
        r.shuffle(part)
        spark.createDataFrame(part, schema).repartition(3).write.parquet(os.path.join(land, f"f{n}"))
        s = spark.readStream.schema(schema).parquet(os.path.join(land, "*"))
        q = (ingest.dedupe_horizon_stream(s, ["user", "kind", "x"], "ts", "30 hours", buckets=8).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
        state += [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    got = [tuple(x) for x in spark.read.schema(schema).parquet(out).collect()]
    assert sorted(got, key=lambda x: x[4]) == wanted
    assert 0 < max(state) <= 8
