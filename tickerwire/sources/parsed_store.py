"""The parsed-URL store as a bucketed table.

URLs parsed before are the one input of a run that only grows. Kept as a table
bucketed and sorted by (ticker, url), it meets a run's candidates without being
moved: Spark shuffles the candidates to the store's buckets and merges. Both
columns make the bucket, so a hot ticker is spread over all of them.

The table's files lie in a folder that the caller names; a new session attaches
to it with the number of buckets it was made with. Tickers are stored in upper
and sources in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerwire.sources.files import PARSED_SCHEMA

BUCKETS = 200
KEY = ["ticker", "url"]


def attach(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Make the store in ``path`` known as table ``name``; a new folder is an
    empty store."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({PARSED_SCHEMA}) USING parquet "
              f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def append(urls: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Add (ticker, source, url) rows, one file per touched bucket; repeats
    are kept."""
    rows = urls.select(F.upper("ticker").alias("ticker"), F.lower("source").alias("source"), "url")
    (rows.repartition(buckets, *KEY).write.mode("append").format("parquet")
     .bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(name))


def compact(spark: SparkSession, name: str, new_name: str, new_path: str, buckets: int = BUCKETS) -> DataFrame:
    """A new store of the distinct (ticker, source, url) rows of another. Rows
    equal in all three share a bucket, so this shuffles nothing."""
    attach(spark, new_name, new_path, buckets)
    append(spark.table(name).distinct(), new_name, buckets)
    return spark.table(new_name)
