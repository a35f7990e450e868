"""J6/J7/C4 against a brute-force as-of on random ticks (several buckets,
ties at the probe instant, empty buckets, keys without ticks)."""

import datetime as dt
import random
from collections import Counter

from tickerwire.operators import asof


def brute(probes, ticks, offset=dt.timedelta(0)):
    out = {}
    for pid, key, ts in probes:
        best = None
        for k, t, p, tid in ticks:
            if k == key and t <= ts + offset and (best is None or (t, tid) > (best[0], best[1])):
                best = (t, tid, p)
        out[pid] = None if best is None else best[2]
    return out


def _data(seed=1):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    ticks = []
    for i in range(400):
        k = rnd.choice(["A", "A", "A", "B", "C"])            # a hot key
        t = base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 6))
        ticks.append((k, t, float(rnd.randrange(1000)) / 10, i))
    ticks.append(("A", ticks[0][1], 999.0, 10_000))           # tie at one instant
    probes = [(j, rnd.choice(["A", "B", "C", "D"]),
               base + dt.timedelta(minutes=rnd.randrange(-600, 60 * 24 * 8))) for j in range(300)]
    probes.append((999, "A", ticks[0][1]))                    # probe at a tick instant
    return probes, ticks


def test_asof_matches_brute_force(spark):
    probes, ticks = _data()
    p = spark.createDataFrame(probes, "pid INT, ticker STRING, ts TIMESTAMP")
    t = spark.createDataFrame(ticks, "ticker STRING, ts TIMESTAMP, price DOUBLE, tick_id INT")
    for bucket in ("hour", "day", "month"):
        got = {r.pid: r.asof_price for r in asof.asof_price(p, t, tick_order="tick_id", bucket=bucket).collect()}
        assert got == brute(probes, ticks), bucket
    exp = brute(probes, ticks, dt.timedelta(minutes=10))
    got = {r.pid: r.asof_price for r in asof.asof_price(p, t, tick_order="tick_id", offset="10 minutes").collect()}
    assert got == exp
    assert got[999] == 999.0


def test_label_articles(spark):
    probes, ticks = _data(2)
    p = spark.createDataFrame(probes, "pid INT, ticker STRING, ts TIMESTAMP")
    t = spark.createDataFrame(ticks, "ticker STRING, ts TIMESTAMP, price DOUBLE, tick_id INT")
    t0 = brute(probes, ticks)
    t1 = brute(probes, ticks, dt.timedelta(hours=3))
    for r in asof.label_articles(p, t, interval="3 hours", tick_order="tick_id").collect():
        a, b = t0[r.pid], t1[r.pid]
        exp = -1000 if a is None or b is None else (b > a) - (b < a)
        assert (r.t0, r.t1, r.classification) == (a, b, exp)


def test_null_keys_match_nothing(spark):
    t0 = dt.datetime(2024, 1, 1, 12)
    p = spark.createDataFrame([(1, None, t0), (2, "A", t0), (3, "A", None)], "pid INT, ticker STRING, ts TIMESTAMP")
    t = spark.createDataFrame([(None, t0, 5.0, 1), ("A", t0 - dt.timedelta(days=3), 7.0, 2)],
                              "ticker STRING, ts TIMESTAMP, price DOUBLE, tick_id INT")
    got = {r.pid: r.asof_price for r in asof.asof_price(p, t, tick_order="tick_id").collect()}
    assert got == {1: None, 2: 7.0, 3: None}


def test_equal_rows_and_null_columns_stay(spark):
    t0 = dt.datetime(2024, 1, 2, 12)
    rows = [(None, "A", t0)] * 3 + [(7, None, t0)] * 2 + [(7, "A", None), (8, "A", t0), (None, None, None)]
    p = spark.createDataFrame(rows, "pid INT, ticker STRING, ts TIMESTAMP")
    t = spark.createDataFrame([("A", t0 - dt.timedelta(hours=30), 1.0), ("A", t0 + dt.timedelta(minutes=5), 2.0)], "ticker STRING, ts TIMESTAMP, price DOUBLE")
    got = asof.label_articles(p, t)
    assert got.columns == ["pid", "ticker", "ts", "t0", "t1", "classification"]
    want = [(*r, 1.0, 2.0, 1) if r[1:] == ("A", t0) else (*r, None, None, -1000) for r in rows]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert asof.label_articles(p.limit(0), t).count() == 0 and asof.label_articles(p, t.limit(0)).count() == len(rows)


def test_old_prices_are_not_found(spark):
    probes, ticks = _data(3)
    p = spark.createDataFrame(probes, "pid INT, ticker STRING, ts TIMESTAMP")
    t = spark.createDataFrame(ticks, "ticker STRING, ts TIMESTAMP, price DOUBLE, tick_id INT")
    age, step = dt.timedelta(hours=2), dt.timedelta(hours=3)

    def fresh(pid, key, at):
        near = [x for x in ticks if x[0] == key and at - age <= x[1] <= at]
        return max(near, key=lambda x: (x[1], x[3]))[2] if near else None
    for bucket in ("hour", "day"):
        got = asof.label_articles(p, t, interval="3 hours", tick_order="tick_id", max_age="2 hours", bucket=bucket).collect()
        assert len(got) == len(probes)
        for r in got:
            a, b = fresh(r.pid, r.ticker, r.ts), fresh(r.pid, r.ticker, r.ts + step)
            assert (r.t0, r.t1) == (a, b) and r.classification == (-1000 if a is None or b is None else (b > a) - (b < a))
    assert {r.classification for r in got} >= {-1000, 1, -1}


def test_ticks_and_articles_are_read_once(spark, tmpdir_path):
    probes, ticks = _data(4)
    spark.createDataFrame(probes, "pid INT, ticker STRING, ts TIMESTAMP").write.parquet(f"{tmpdir_path}/p")
    spark.createDataFrame(ticks, "ticker STRING, ts TIMESTAMP, price DOUBLE, tick_id INT").write.parquet(f"{tmpdir_path}/t")
    p, t = spark.read.parquet(f"{tmpdir_path}/p"), spark.read.parquet(f"{tmpdir_path}/t")
    for job in (asof.label_articles(p, t, tick_order="tick_id"), asof.asof_price(p, t, tick_order="tick_id")):
        job.collect()
        plan = job._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("FileScan parquet") == 2 and plan.count("ReusedExchange") == 1
