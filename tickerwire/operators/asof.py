"""As-of price lookups (J6, J7, W4) and article labels (C4).

A backward as-of join ("the price known at time t") is written as a union of
probes and ticks plus a ``last(tick, ignorenulls)`` window. A window keyed by
ticker alone would put a hot ticker — possibly a third of all ticks — into a
single task, so the window is keyed by (ticker, time bucket). Probes whose
bucket holds no earlier tick take the carry-in: the last tick of the latest
earlier bucket, found by a window over one row per active (ticker, bucket).

Several horizons are looked up together: a row is exploded into one probe per
horizon, so articles and ticks are read once and meet in one exchange by
(ticker, bucket). Per-bucket last ticks are aggregated from that same exchange
(both readers ask for the same columns, so Spark reuses it), and the carry-in
joins back on its partitioning. The state carried is (time, price): with a
``max_age`` a price that is older at the probe's time counts as not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerwire.functions.labels import price_class


def _bucket(ts: Column, unit: str) -> Column:
    # monotone in ts, which is all the carry-in logic needs
    return F.date_trunc(unit, ts)


def _later(ts: Column, interval: str | None) -> Column:
    return ts if interval is None else ts + F.expr(f"INTERVAL {interval}")


def _row_id(df: DataFrame) -> Column:
    """128-bit identity of a row's values; equal rows share it."""
    cols = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b"))


def asof_prices(left: DataFrame, prices: DataFrame, *, offsets: dict[str, str | None], by: str = "ticker",
                ts: str = "ts", price: str = "price", tick_order: str | None = None,
                max_age: str | None = None, bucket: str = "day") -> DataFrame:
    """J6/J7 for several probe times: ``left`` with one column per entry of
    ``offsets`` (name -> interval after ``ts``, None for ``ts`` itself): the
    last ``price`` of the same ``by`` key at or before that time; null when
    there is none, or none of the last ``max_age``.

    A tick at the probe instant counts; among ticks at one instant
    ``tick_order`` (ascending) decides which is last. Null keys, times and
    prices match nothing; equal rows of ``left`` stay as many as they are.
    ``bucket``: a date_trunc unit ('hour', 'day', 'week', 'month') bounding
    the rows of one window task."""
    names = list(offsets)
    row = F.struct(*[F.col(c) for c in left.columns])
    times = F.array(*[F.struct(F.lit(i).alias("tag"), _later(F.col(ts), off).alias("at")) for i, off in enumerate(offsets.values())])
    if len(names) == 1:
        probe = row
    else:   # the row itself rides on its first probe, its identity on all
        probe = F.struct(F.col("_time.tag").alias("tag"), _row_id(left).alias("id"), F.when(F.col("_time.tag") == 0, row).alias("row"))
    probes = left.select("*", F.explode(times).alias("_time")).select(
        F.col(by).alias("_by"), F.col("_time.at").alias("_ts"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_ord"),
        F.lit(None).cast("double").alias("_price"), probe.alias("_probe"))
    order = F.col(tick_order).cast("bigint") if tick_order else F.lit(0).cast("bigint")
    ticks = prices.select(F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.lit(0).alias("_kind"), order.alias("_ord"),
                          F.col(price).cast("double").alias("_price"), F.lit(None).cast(probes.schema["_probe"].dataType).alias("_probe"))
    ticks = ticks.filter(F.col("_by").isNotNull() & F.col("_price").isNotNull() & F.col("_ts").isNotNull())
    events = probes.unionByName(ticks).withColumn("_b", _bucket(F.col("_ts"), bucket)).repartition("_by", "_b")

    # 1. inside each (key, bucket): last tick at or before the probe
    tick = F.when(F.col("_kind") == 0, F.struct(F.col("_ts").alias("ts"), F.col("_price").alias("price")))
    so_far = (Window.partitionBy("_by", "_b").orderBy("_ts", "_kind", "_ord")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = (events.withColumn("_seen", F.last(tick, ignorenulls=True).over(so_far)).filter(F.col("_kind") == 1)
            .select("_by", "_b", "_ts", "_seen", "_probe"))

    # 2. carry-in: last tick of the latest earlier bucket, for buckets with probes
    when = F.when(F.col("_kind") == 0, F.struct("_ts", "_ord"))
    # (the keys leave the aggregate as values: a null check that the join below
    # implies must not go down to the exchange, which would then differ)
    per_bucket = (events.groupBy("_by", "_b").agg(F.max("_by").alias("by"), F.max("_b").alias("b"), F.max_by(tick, when).alias("_last"),
                                                  F.count("_probe").alias("_n")).select("by", "b", "_last", "_n"))
    before = Window.partitionBy("by").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (per_bucket.withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
             .filter(F.col("_n") > 0).select(F.col("by").alias("_by"), F.col("b").alias("_b"), "_carry"))

    found = seen.join(carry, ["_by", "_b"], "left").withColumn("_tick", F.coalesce("_seen", "_carry"))
    known = F.col("_tick.price")
    if max_age is not None:
        known = F.when(_later(F.col("_tick.ts"), max_age) >= F.col("_ts"), known)
    if len(names) == 1:
        return found.select("_probe.*", known.alias(names[0]))
    found = found.select("_probe.tag", "_probe.id", "_probe.row", known.alias("_known"))
    wide = found.groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), F.count("row").alias("n"),
                                   *[F.max(F.when(F.col("tag") == i, F.col("_known"))).alias(f"_at{i}") for i in range(len(names))])
    return (wide.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
            .select("row.*", *[F.col(f"_at{i}").alias(n) for i, n in enumerate(names)]))


def asof_price(left: DataFrame, prices: DataFrame, *, offset: str | None = None, out: str = "asof_price", **how) -> DataFrame:
    """``asof_prices`` at one time, ``ts`` plus ``offset`` (e.g.
    '10 minutes')."""
    return asof_prices(left, prices, offsets={out: offset}, **how)


def label_articles(articles: DataFrame, prices: DataFrame, *, interval: str = "10 minutes", **how) -> DataFrame:
    """C4: price at publish time (t0), price ``interval`` later (t1) and the
    move class (F10); the not-found class when either price is missing or, with
    ``max_age``, too old."""
    a = asof_prices(articles, prices, offsets={"t0": None, "t1": interval}, **how)
    return a.withColumn("classification", price_class("t0", "t1"))
