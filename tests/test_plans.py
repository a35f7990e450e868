"""Plan-shape regression tests for the scale decisions."""

import re

import __spark_entry__ as entry
from conftest import SMALL
from tickerwire.plans import catalog


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filtered_extraction_plan_stays_small(spark):
    # a filter on an extracted field must not inline the regex chain
    for key in ("p8_require_date", "c2_nodes_checked", "c2_nodes"):
        plan = _optimized(entry.queries()[key](spark, SMALL))
        # the table of character names is one literal per decoding of a page
        names = plan.count("CounterClockwiseContourIntegral")
        rest = re.sub(r"keys: \[.*?\], values: \[.*?\]", "names", plan, flags=re.S)
        assert names <= 4 and len(rest) < 120_000, (key, names, len(rest))


def test_asof_window_is_keyed_by_bucket(spark):
    plan = _physical(entry.queries()["j6_asof"](spark, SMALL))
    assert "Window" in plan
    # the big window partitions by (key, bucket), never by the key alone
    assert "_b" in plan.split("Window [")[1].split("]")[1] or "_b#" in plan


def test_page_lookup_streams_the_store(spark):
    df = entry.queries()["c2_nodes"](spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_pushdown_and_pruning(spark):
    import re
    plan = _physical(entry.queries()["j6_asof"](spark, SMALL))
    pushed = re.findall(r"PushedFilters: \[([^]]*)\]", plan)
    assert any("EqualTo(event_type,purchase)" in p for p in pushed)
    assert any("EqualTo(event_type,view)" in p for p in pushed)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("props" not in s for s in schemas)      # unused column never read


def test_no_python_udfs(spark):
    for key, fn in catalog.queries().items():
        if key.startswith("t"):
            continue
        plan = _physical(fn(spark, SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, key


def test_fan_out_only_for_large_inputs_in_few_files(spark, tmpdir_path):
    import os
    from pyspark.sql import functions as F
    from tickerwire.session import fan_out
    big = os.path.join(tmpdir_path, "big")
    (spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 512).alias("s"))
     .coalesce(1).write.parquet(big))
    small = os.path.join(tmpdir_path, "small")
    spark.range(10).coalesce(1).write.parquet(small)
    slots = spark.sparkContext.defaultParallelism
    assert fan_out(spark.read.parquet(big), big).rdd.getNumPartitions() == slots
    s = spark.read.parquet(small)
    assert fan_out(s, small) is s


def test_constituents_of_one_file_are_read_by_all_slots(spark, tmp_path):
    from pyspark.sql import functions as F
    n = 20_000   # one file, one row group, 1 to 4 MB: one task reads it
    c = spark.range(n).select(F.col("id").alias("c_custkey"), F.sha2(F.col("id").cast("string"), 256).alias("c_name"), F.lit(1).alias("c_nationkey"),
                              F.lit(0.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    c.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "N")], "n_nationkey INT, n_name STRING").write.parquet(f"{tmp_path}/nation.parquet")
    got = catalog.queries()["h6_constituents"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(got) >= spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in got) == n * 6 + n // 4
