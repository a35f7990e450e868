"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerwire.session import checkpoint_dir

# Spark deletes a write's shuffle files when it ends, not only when the driver
# happens to collect garbage (Spark 4.1; earlier ones ignore it).
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The white space of the word contract: blank and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


@functools.cache
def _shipped(context) -> str:
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tickerwire-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, wherever
    it is installed: once per context, Spark serves it from the driver."""
    _shipped(spark.sparkContext)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tickerwire/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut,
    and what was computed survives the loss of any executor. ``few``: the short
    rows that many tasks leave of much work are dealt to as many tasks as run at
    once before they are written, instead of a small file for each task (in a
    local folder an executor starts a process or more for the rights of each).
    The write's shuffle files go when it ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if few:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_folder = path   # for ``drop``
    return table


def drop(table: DataFrame) -> None:
    """Delete the files of a table that ``cut`` gave, when nothing that is
    still to be computed reads it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """16-byte identity of a text; a null text counts as the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def gram_hashes(df: DataFrame, words: str, out: str) -> DataFrame:
    """``df`` with ``out``: the 64-bit hash of each run of five words of the
    array column ``words``; an array of fewer words gives an empty one. The
    words' hashes are a column of their own, so they are evaluated once. (A
    filter on ``out``, or the one that ``explode`` implies, would be pushed
    below that column and evaluate them per element: use ``explode_outer``.)"""
    g = f"{out}_1"
    runs = F.transform(g, lambda x, i: F.xxhash64(x, *[F.get(g, i + k) for k in range(1, 5)]))
    return (df.withColumn(g, F.transform(words, lambda w: F.xxhash64(w)))
            .withColumn(out, F.slice(runs, 1, F.greatest(F.size(words) - 4, F.lit(0)))).drop(g))
