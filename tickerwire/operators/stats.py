"""Yield statistics and corpus summaries: A1-A10, W1-W3, C5.

All aggregates are decomposable (sum, count, min/max, min_by), so Spark runs
them as partial aggregates before the shuffle: a hot source or class is
combined map-side and never reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerwire.functions.text import word_count


def source_stats(runs: DataFrame) -> DataFrame:
    """A1: per source the total URLs and nodes over all runs.
    ``runs``: (source, num_urls, num_nodes)."""
    return (runs.groupBy("source")
            .agg(F.sum("num_urls").cast("bigint").alias("num_urls"),
                 F.sum("num_nodes").cast("bigint").alias("num_nodes")))


def source_accuracy(stats: DataFrame) -> DataFrame:
    """A2: nodes per URL, by column name; null when a source has no URLs."""
    return stats.withColumn("accuracy", F.try_divide(F.col("num_nodes").cast("double"),
                                                     F.col("num_urls").cast("double")))


def class_counts(df: DataFrame, col: str = "classification") -> DataFrame:
    """A3 (+L2): rows per class in ascending class order (rows with a null
    class form no group, as in a pandas groupby)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(col))


def source_counts(df: DataFrame, col: str = "classification", by: str = "source") -> DataFrame:
    """A4 (+L2): non-null classes per source (count of the column, not of
    rows), sources ascending."""
    return df.groupBy(by).agg(F.count(col).alias("n_classified")).orderBy(by)


def mean_article_len(df: DataFrame, text: str = "article") -> DataFrame:
    """A5 (+F8): global mean word count."""
    return df.agg(F.avg(word_count(text)).alias("mean_len"))


def mean_len_by_source(df: DataFrame, text: str = "article", by: str = "source") -> DataFrame:
    """A6 (+F8, L2): mean word count per source, sources ascending."""
    return df.groupBy(by).agg(F.avg(word_count(text)).alias("mean_len")).orderBy(by)


def class_histogram(df: DataFrame, col: str = "classification", bins: int = 3) -> DataFrame:
    """Equal-width bin counts between the column's min and max, empty bins
    included; the last bin is closed on the right; a constant column is binned
    over [v - 0.5, v + 0.5] and an empty one over [0, 1], as numpy does. NaN
    counts as missing.

    One partial aggregate per distinct value feeds the edges (a scalar
    subquery) and the counts, which are joined to generated bins; the two share
    its shuffle stage, and the data is never gathered into one partition."""
    x = F.col(col).cast("double")
    per_value = (df.select(x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
                 .groupBy("_x").agg(F.count(F.lit(1)).alias("_n")))
    return _histogram(per_value, bins)


def _histogram(per_value: DataFrame, bins: int) -> DataFrame:
    """A7 from (_x, _n): values and how often they occur."""
    lo0, hi0 = F.min("_x"), F.max("_x")
    edges = per_value.agg(F.coalesce(F.when(lo0 == hi0, lo0 - 0.5).otherwise(lo0), F.lit(0.0)).alias("lo"),
                          F.coalesce(F.when(lo0 == hi0, hi0 + 0.5).otherwise(hi0), F.lit(1.0)).alias("hi"))
    width = (F.col("_e.hi") - F.col("_e.lo")) / F.lit(float(bins))
    bin_ = F.least(F.floor((F.col("_x") - F.col("_e.lo")) / width).cast("int") + 1, F.lit(bins))
    counts = (per_value.withColumn("_e", edges.select(F.struct("lo", "hi")).scalar()).groupBy(bin_.alias("bin"))
              .agg(F.sum("_n").cast("bigint").alias("n")))
    spine = edges.select(F.struct("lo", "hi").alias("_e"), F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    lower = F.col("_e.lo") + (F.col("bin") - 1) * width
    upper = F.when(F.col("bin") == bins, F.col("_e.hi")).otherwise(F.col("_e.lo") + F.col("bin") * width)
    return spine.join(counts, "bin", "left").select("bin", lower.alias("lower"), upper.alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def per_query_yield(urls: DataFrame, nodes: DataFrame,
                    keys: tuple[str, ...] = ("ticker", "source", "string")) -> DataFrame:
    """URLs found and nodes built per query (0 when none)."""
    k = list(keys)
    u = urls.groupBy(*k).agg(F.count(F.lit(1)).alias("urls_found"))
    n = nodes.groupBy(*k).agg(F.count(F.lit(1)).alias("nodes_built"))
    return (u.join(n, k, "full")
            .select(*k, F.coalesce("urls_found", F.lit(0)).alias("urls_found"),
                    F.coalesce("nodes_built", F.lit(0)).alias("nodes_built")))


def distinct_sources(stats: DataFrame, by: str = "source") -> DataFrame:
    """The set of sources seen."""
    return stats.select(by).distinct()


def query_counts(queries: DataFrame, n_tickers: DataFrame, n_sources: int,
                 depth: int = 1) -> DataFrame:
    """A10: planned work (tickers x sources x depth) and queries built."""
    built = queries.agg(F.count(F.lit(1)).alias("built"))
    planned = n_tickers.agg((F.count(F.lit(1)) * F.lit(n_sources * depth)).alias("planned"))
    return planned.select("planned", built.select("built").scalar().alias("built"))


def first_match(df: DataFrame, keys: list[str], order: list[str],
                cols: list[str]) -> DataFrame:
    """Per key the row that comes first in ``order``; a partial
    ``min_by`` aggregate instead of a ranked window, so a hot key is
    combined map-side."""
    row = F.min_by(F.struct(*[F.col(c) for c in cols]),
                   F.struct(*[F.col(c) for c in order])).alias("_first")
    return df.groupBy(*keys).agg(row).select(*keys, "_first.*")


def odd_rows(df: DataFrame, rows_col: str) -> DataFrame:
    """Elements of an array column at odd 0-based positions."""
    ex = df.select("*", F.posexplode(rows_col).alias("row_pos", "row"))
    return ex.filter(F.col("row_pos") % 2 == 1).drop(rows_col)


def running_stats(runs: DataFrame, run_order: str = "run") -> DataFrame:
    """Per source the accumulated totals after each run. Runs are first
    summed per (source, run), so the window holds one row per run."""
    per_run = (runs.groupBy("source", run_order)
               .agg(F.sum("num_urls").cast("bigint").alias("num_urls"),
                    F.sum("num_nodes").cast("bigint").alias("num_nodes")))
    w = (Window.partitionBy("source").orderBy(run_order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per_run.select("source", run_order,
                          F.sum("num_urls").over(w).alias("total_urls"),
                          F.sum("num_nodes").over(w).alias("total_nodes"))


def corpus_summary(articles: DataFrame, stats: DataFrame | None = None, *,
                   text: str = "article", by: str = "source",
                   classification: str = "classification", bins: int = 3) -> DataFrame:
    """The notebook's summary as one long table (metric, key, value):
    class counts (A3) and their histogram (A7, key: the bin), classified rows
    per source (A4), mean length overall (A5) and per source (A6), and accuracy
    per source (A2) when ``stats`` is given.

    Two scans of the articles: one grouped by class, which the counts and the
    histogram share, and one grouped by source that yields A4, A6 and — from
    its per-source sums — the exact global mean A5."""
    s = F.col(by).cast("string")
    per_source = articles.groupBy(by).agg(
        F.count(classification).alias("_classified"),
        F.sum(word_count(text)).alias("_words"),
        F.count(text).alias("_texts"))
    per_class = articles.filter(F.col(classification).isNotNull()).groupBy(classification).agg(F.count(F.lit(1)).alias("n"))
    values = per_class.select(F.col(classification).cast("double").alias("_x"), F.col("n").alias("_n"))
    parts = [
        per_class.select(F.lit("class_count").alias("metric"), F.col(classification).cast("string").alias("key"),
                         F.col("n").cast("double").alias("value")),
        _histogram(values.filter(F.col("_x").isNotNull() & ~F.isnan("_x")), bins)
        .select(F.lit("class_histogram").alias("metric"), F.col("bin").cast("string").alias("key"), F.col("n").cast("double").alias("value")),
        per_source.select(F.lit("source_count").alias("metric"), s.alias("key"),
                          F.col("_classified").cast("double").alias("value")),
        per_source.agg((F.sum("_words") / F.sum("_texts")).alias("value"))
        .select(F.lit("mean_len").alias("metric"), F.lit(None).cast("string").alias("key"),
                "value"),
        per_source.select(F.lit("mean_len_by_source").alias("metric"), s.alias("key"),
                          (F.col("_words") / F.col("_texts")).alias("value")),
    ]
    if stats is not None:
        parts.append(source_accuracy(stats)
                     .select(F.lit("accuracy").alias("metric"), F.col("source").alias("key"),
                             F.col("accuracy").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
