"""Incremental ingestion with Structured Streaming: T1-T3.

T1 turns the batch job into micro-batches: each batch of candidate URLs is
deduplicated against everything parsed by *earlier* batches, a URL that
several queries of the batch found stays under the first of them (D16), nodes
are built and written, with the batch's totals per source. foreachBatch is
at-least-once, so every output is written with ``overwrite`` into a
``batch_id=N`` directory and batch N reads only what batches below N wrote: a
replayed batch rewrites the same rows instead of removing or duplicating them.

The parsed store is a base (the distinct URLs of all batches up to one) and
the deltas after it, both laid out by a hash bucket of the ticker, so a batch
probes only the buckets it needs. Every ``compact_every`` batches the deltas
are folded into a new base; a base counts once its write has committed, and a
batch that a base already holds is refused instead of being run against its
own output.

T2 keeps per-source totals as streaming aggregation state (checkpointed).
T3 drops repeats of a key: ``dedupe_stream`` with the built-in operator, whose
answer for repeats beyond the horizon depends on where micro-batches end, and
``dedupe_horizon_stream`` by an exact rule of event time that does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickerwire.operators.articles import build_nodes, parsed_rows, query_outcomes
from tickerwire.operators.frontier import first_query_only
from tickerwire.operators.stats import source_stats
from tickerwire.options import Options
from tickerwire.sources.files import PARSED_SCHEMA

# the parsed store is laid out by a hash bucket of the upper-cased ticker
PARSED_BUCKETS = 64
COMPACT_EVERY = 50
STATS_SCHEMA = "source STRING, num_urls BIGINT, num_nodes BIGINT"


def _bucket(ticker_col: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.upper(ticker_col)), F.lit(buckets)).cast("int")


def _numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers N of the committed directories ``folder/<prefix>N``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS"))
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and done(n))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_parsed_before(spark: SparkSession, parsed_path: str, batch_id: int | None = None) -> DataFrame:
    """(ticker, source, url, bucket) parsed by batches below ``batch_id`` (by
    all without): the newest base and the deltas after it."""
    bases = _numbered(spark, f"{parsed_path}/base", "upto=")
    upto = bases[-1] if bases else -1
    if batch_id is not None and upto >= batch_id:
        raise ValueError(f"batch {batch_id} is folded into the base up to batch {upto} and cannot run again")
    deltas = [n for n in _numbered(spark, f"{parsed_path}/delta", "batch_id=") if n > upto and (batch_id is None or n < batch_id)]
    folders = [f"{parsed_path}/base/upto={upto}"] * bool(bases) + [f"{parsed_path}/delta/batch_id={n}" for n in deltas]
    schema = f"{PARSED_SCHEMA}, bucket INT"
    out = spark.createDataFrame([], schema)
    for f in folders:   # bounded by compact_every
        out = out.unionByName(spark.read.schema(schema).parquet(f))
    return out


def compact_parsed(spark: SparkSession, parsed_path: str, batch_id: int) -> None:
    """Fold what batches below ``batch_id`` parsed into a new base, then drop
    what it replaces. To be called before batch ``batch_id`` runs, when all
    below it have committed; a fold that is interrupted leaves the old base and
    the deltas in force."""
    deltas = [n for n in _numbered(spark, f"{parsed_path}/delta", "batch_id=") if n < batch_id]
    if not deltas:
        return
    bases = _numbered(spark, f"{parsed_path}/base", "upto=")
    rows = read_parsed_before(spark, parsed_path, batch_id).distinct()
    (rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
     .parquet(f"{parsed_path}/base/upto={deltas[-1]}"))
    for n in deltas:
        _delete(spark, f"{parsed_path}/delta/batch_id={n}")
    for n in bases:
        if n < deltas[-1]:
            _delete(spark, f"{parsed_path}/base/upto={n}")


def ingest_batch(batch: DataFrame, batch_id: int, pages: DataFrame, companies: DataFrame,
                 store_path: str, parsed_path: str, opts: Options = Options(),
                 order_cols: tuple[str, ...] = (),
                 stats_path: str | None = None, compact_every: int = COMPACT_EVERY, buckets: int = PARSED_BUCKETS) -> None:
    """One T1 micro-batch (also usable on its own as a batch step).

    ``batch``: (ticker, source, string, url, *order_cols); ``order_cols`` is
    the run order of the queries, by which a URL belongs to the first query
    that found it. The parsed store is read only in the buckets the batch's
    tickers fall into: their ids (at most ``buckets`` small integers, a
    planning input) become a partition filter, so a batch scans the slice of
    the store it can hit, not all of it."""
    spark = batch.sparkSession
    done = _numbered(spark, f"{parsed_path}/delta", "batch_id=")
    if len([n for n in done if n < batch_id]) >= compact_every:
        compact_parsed(spark, parsed_path, batch_id)
    key_cols = ["bucket", "_t", "url"]
    b = batch.withColumn("_t", F.upper("ticker")).withColumn("bucket", _bucket(F.col("ticker"), buckets))
    touched = [r[0] for r in b.select("bucket").distinct().collect()]   # <= buckets ints
    earlier = read_parsed_before(spark, parsed_path, batch_id).filter(F.col("bucket").isin(touched))
    hits = (earlier.select("bucket", F.upper("ticker").alias("_t"), "url")
            .join(b.select(*key_cols).distinct(), key_cols, "left_semi"))
    fresh = b.join(hits.distinct(), key_cols, "left_anti").drop("bucket")
    fresh = first_query_only(fresh, list(order_cols)) if order_cols else fresh.drop("_t")
    outcomes = build_nodes(fresh, pages, companies, opts, keep_rejected=True).persist()
    try:
        nodes = outcomes.filter(F.col("reject_reason").isNull())
        nodes.write.mode("overwrite").parquet(f"{store_path}/batch_id={batch_id}")
        productive = query_outcomes(outcomes).filter(F.col("nodes_built") > 0)
        if stats_path:
            source_stats(productive.select("source", F.col("urls_found").alias("num_urls"), F.col("nodes_built").alias("num_nodes"))) \
                .write.mode("overwrite").parquet(f"{stats_path}/batch_id={batch_id}")
        parsed = parsed_rows(outcomes, productive)
        # the parsed URLs last: a batch that fails before them is run again as a whole
        (parsed.withColumn("bucket", _bucket(F.col("ticker"), buckets)).write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{parsed_path}/delta/batch_id={batch_id}"))
    finally:
        outcomes.unpersist()


def read_stats(spark: SparkSession, stats_path: str) -> DataFrame:
    """A1 over all batches: every batch's totals are kept once, under its
    number, and added up when read."""
    batches = _numbered(spark, stats_path, "batch_id=")
    if not batches:
        return spark.createDataFrame([], STATS_SCHEMA)
    return source_stats(spark.read.schema(STATS_SCHEMA).parquet(*[f"{stats_path}/batch_id={n}" for n in batches]))


def ingest_stream(spark: SparkSession, landing_path: str, schema: str, pages: DataFrame,
                  companies: DataFrame, store_path: str, parsed_path: str, checkpoint: str,
                  opts: Options = Options(), max_files_per_trigger: int | None = None,
                  available_now: bool = True, **how) -> StreamingQuery:
    """Candidate URL files landing in ``landing_path`` -> article store,
    parsed-URL store and totals, as if each file were a run after the ones
    before it. ``how``: further arguments of ``ingest_batch``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(landing_path)

    def run(batch_df: DataFrame, batch_id: int) -> None:
        ingest_batch(batch_df, batch_id, pages, companies, store_path, parsed_path, opts, **how)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def stats_stream(runs: DataFrame) -> DataFrame:
    """Running per-source totals of a stream of runs
    (source, num_urls, num_nodes); use output mode 'complete' or 'update'."""
    return source_stats(runs)


def write_versions(df: DataFrame, out_path: str, checkpoint: str,
                   available_now: bool = True) -> StreamingQuery:
    """Sink for a complete-mode aggregate: every micro-batch writes the
    whole current result to ``out_path/v=<batch_id>`` (overwrite, so a
    replay is harmless); readers take the highest version."""
    def run(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{out_path}/v={batch_id}")

    w = (df.writeStream.outputMode("complete").foreachBatch(run)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_latest_version(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest complete result written by ``write_versions``."""
    versions = spark.read.parquet(out_path)
    latest = versions.select(F.max("v")).scalar()
    return versions.filter(F.col("v") == latest).drop("v")


def dedupe_stream(urls: DataFrame, keys: list[str], event_time: str,
                  horizon: str = "1 day") -> DataFrame:
    """Drop repeats of ``keys`` seen within ``horizon`` of event time;
    state older than the watermark is dropped, so a repeat arriving later
    than the horizon is kept. The watermark moves between micro-batches only:
    a repeat beyond the horizon is dropped where both fall into one batch and
    kept where they do not. Event time must be TIMESTAMP (an NTZ column is
    cast with the session time zone)."""
    ts = F.col(event_time).cast("timestamp")
    return (urls.withColumn("_event_time", ts)
            .withWatermark("_event_time", horizon)
            .dropDuplicatesWithinWatermark(keys)
            .drop("_event_time"))


# groups that ``dedupe_horizon_stream`` deals its keys to; a checkpoint keeps the number it began with
HORIZON_BUCKETS = 1024


def _key_text(df: DataFrame, keys: list[str]) -> Column:
    """``keys`` as one text, equal where all are equal (nulls and both zeros
    of a float too), so that a lookup in Python is exact for every type."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}
    cols = [F.when(F.col(k) == 0, F.lit(0.0)).otherwise(F.col(k)) if k in floats else F.col(k) for k in keys]
    return F.to_json(F.struct(*[c.alias(str(i)) for i, c in enumerate(cols)]),
                     {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                      "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def _within(horizon: int, columns: list[str]):
    def kept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:   # the newest time is past the horizon, so all are
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values("_micros", kind="stable")
        watermark = state.getCurrentWatermarkMs()
        last = {k: t for k, t in state.get[0].items() if t + horizon >= watermark * 1000} if state.exists else {}
        stay = []
        for k, t in zip(rows["_key"], rows["_micros"].tolist()):
            stay.append(k not in last or t > last[k] + horizon)
            if stay[-1]:
                last[k] = t
        state.update((last,))
        state.setTimeoutTimestamp(max((max(last.values()) + horizon) // 1000 + 1, watermark + 1))
        yield rows.loc[stay, columns]
    return kept


def dedupe_horizon_stream(urls: DataFrame, keys: list[str], event_time: str, horizon: str = "1 day",
                          late: str = "0 seconds", buckets: int = HORIZON_BUCKETS) -> DataFrame:
    """T3 by an exact rule: in order of event time a row stays unless a row of
    its key stayed at most ``horizon`` before it. Rows may arrive out of order
    within a micro-batch, and across micro-batches by no more than ``late``;
    then the result does not depend on where batches end. The state is one
    time per key of the last horizon. Keys are dealt to ``buckets`` groups by
    hash, so that Python is called once per group and micro-batch and not once
    per key; a group holds 1 / ``buckets`` of a micro-batch in memory. Null
    event times are dropped."""
    rows = (urls.withColumn("_event_time", F.col(event_time).cast("timestamp")).filter(F.col("_event_time").isNotNull())
            .withWatermark("_event_time", late))
    # a BIGINT goes to pandas as text: beside a null it would be a float
    longs = {f.name for f in urls.schema if f.dataType.typeName() == "long"}
    sent = [F.col(f"`{c}`").cast("string").alias(c) if c in longs else F.col(f"`{c}`") for c in urls.columns]
    rows = rows.select(*sent, "_event_time", F.unix_micros("_event_time").alias("_micros"), _key_text(rows, keys).alias("_key"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    out = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in urls.columns)
    kept = rows.groupBy("_bucket").applyInPandasWithState(
        _within(pd.Timedelta(horizon).value // 1000, urls.columns), out, "last MAP<STRING, BIGINT>", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if c in longs else F.col(f"`{c}`") for c in urls.columns])
