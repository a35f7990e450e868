"""Session construction and table access."""

from __future__ import annotations

import functools
import os
import tempfile
import weakref

from pyspark.sql import DataFrame, SparkSession

# Settings we want when we build the session ourselves (bench, tests).
# A cluster-provided session keeps its own values.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tickerwire") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TICKERWIRE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is only read. When it
    is unset and the master is local (unit tests, a laptop) a private folder
    is created and set; elsewhere its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tickerwire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_MEMO: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def per_session(fn):
    """Memoise a (spark, *hashable args) -> DataFrame builder per session.

    DataFrames are immutable plan descriptions, so handing the same object
    to several queries is safe; it saves rebuilding large expression trees
    (thousands of driver->JVM calls) for every query that shares an input.
    """
    @functools.wraps(fn)
    def wrapper(spark: SparkSession, *args):
        memo = _MEMO.setdefault(spark, {})
        key = (fn.__module__, fn.__qualname__) + args
        if key not in memo:
            memo[key] = fn(spark, *args)
        return memo[key]
    return wrapper


# inputs smaller than this are never fanned out
FANOUT_MIN_BYTES = 1 << 20


def _path_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength()


def fan_out(df: DataFrame, path: str | None = None) -> DataFrame:
    """Spread an input held in fewer files than task slots over all slots.

    A parquet file with one row group is read by one task however large it
    is, so per-row work (regex extraction over pages and documents) would run
    on a single core. Such inputs (fewer files than slots, more than
    FANOUT_MIN_BYTES) get a round-robin repartition; filters and column
    pruning still reach the scan below it. Inputs made of many files — any
    table at cluster scale — are left as they are."""
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * slots:   # cluster-scale input: nothing to do
        return df
    files = df.inputFiles()
    if len(files) >= slots:
        return df
    size = _path_bytes(spark, path) if path else sum(_path_bytes(spark, f) for f in files)
    return df.repartition(slots) if size > FANOUT_MIN_BYTES else df


@per_session
def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the driver's parquet tables (read-only inputs). ``spread``
    fans an under-partitioned input out over all task slots (``fan_out``);
    worth it before heavy per-row work (regex over whole pages or texts),
    not before light work where the extra exchange costs more."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    return fan_out(df, path) if spread else df
