"""Benchmark decontamination by item-sized windows and an exact prefix index.

A text is contaminated by a benchmark item if one of its windows, as many
words long as the item, has a weighted Jaccard similarity of ``SIMILARITY`` or
more with it over runs of five words. Every place of a text is a possible
window, but only those need a look that begin with a run of the item and hold
enough such runs for the similarity: a window that begins with another run
loses nothing, and may win, by beginning at the next run that the item holds.
That leaves the windows of quoted items, in whatever order their parts stand.
Windows of equal words are one, however many texts hold them. Two
multisets of similarity t share at least t of the runs of either, so, both
sorted by hash, the first n - ceil(t * n) + 1 of the n runs of each have one
in common: an equi-join over (length, run) of these prefixes finds every pair
of window and item that is similar enough, without any miss. The pairs found
are verified exactly.

Words are runs of letters and digits, compared without case. Everything is a
DataFrame expression. The benchmark's runs are joined, not collected: Spark
sends them to every task only while their written table is under its limit.

Defined results: null texts are empty; items of under five words have no run
and match nothing; a text shorter than an item is one window; an item that a
text breaks off is compared with what the text has of it; equal items are
reported each; repeated documents are reported each; empty tables give no rows.
Of several windows of a text that match an item, the most similar and then
first is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerwire.llm.common import cut, gram_hashes, text_key

SHINGLE, SIMILARITY = 5, 0.8


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _prefix(runs: Column, least: float) -> Column:
    """The distinct runs among the first by hash of which two arrays with a
    similarity of ``least`` or more have one in common."""
    n = F.size(runs)
    # the product's rounding must not shorten the prefix
    keep = n - F.ceil(F.lit(float(least)) * n - F.lit(1e-6)).cast("int") + 1
    return F.array_distinct(F.slice(F.array_sort(runs), 1, F.least(F.greatest(keep, F.lit(0)), n)))


def _jaccard(a: Column, b: Column) -> Column:
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, begin, similarity, text_key) of every document and
    item that it holds; begin: the window's first word, which begins a run of
    five words that the benchmark holds, or the text's last window."""
    bench = cut(gram_hashes(items.select(F.col(item_id).alias("item_id"), _words(F.col(item_text)).alias("words")), "words", "runs")
                .where("size(words) >= 5").select("item_id", F.size("words").alias("n"), "words", "runs"), "bench-items")
    base = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    # the benchmark's runs with their places, by item length
    runs = cut(bench.select("n", F.posexplode_outer("runs").alias("q", "run")).groupBy("n", "run").agg(F.collect_set("q").alias("qs")), "bench-runs")
    places = gram_hashes(base.select("key", _words(F.col("text")).alias("words")), "words", "runs").select(
        "key", F.size("runs").alias("total"), F.posexplode_outer("runs").alias("p", "run"))
    # the last window of a text; an item that the text breaks off begins after it
    own, last = F.col("n") - 4, F.greatest(F.col("total") - F.col("n") + 4, F.lit(0))
    broken = F.when(F.col("p") >= last, F.filter(F.transform("qs", lambda q: F.col("p") - q), lambda b: b > last))
    hits = (places.join(runs, "run").groupBy("key", "total", "n")
            .agg(F.sort_array(F.collect_set("p")).alias("places"), F.array_distinct(F.flatten(F.collect_list(broken))).alias("broken")))
    # a window of M runs needs so many of the item's N for the similarity; the last
    # window of a text stands for those that would begin after it
    need = F.ceil(F.lit(least / (1 + least)) * (own + F.least(own, F.col("total"))) - F.lit(1e-6)).cast("int")
    full = F.filter(F.transform("places", lambda p, i: F.when((p < last) & (F.get("places", i + need - 1) < p + own), p)), lambda p: p.isNotNull())
    begins = F.concat(full, F.when(F.get("places", F.size("places") - need) >= last, F.array(last)).otherwise(F.array().cast("array<int>")))
    windows = cut(hits.select("key", "n", F.explode(F.concat(begins, "broken")).alias("begin")), "bench-windows")
    texts = (base.select("key", "text").join(windows.select("key").distinct(), "key", "left_semi")
             .groupBy("key").agg(_words(F.first("text")).alias("words")))
    held = cut(windows.join(texts, "key").select("key", "begin", "n", F.slice("words", F.col("begin") + 1, F.col("n")).alias("words"))
               .withColumn("window", text_key(F.array_join("words", " "))), "bench-held")
    # windows of equal words are compared once
    one = gram_hashes(held.groupBy("window", "n").agg(F.first("words").alias("words")), "words", "runs")
    marked = cut(one.select("window", "n", "runs", _prefix(F.col("runs"), least).alias("prefix")), "bench-marked")
    known = cut(bench.select("item_id", F.col("n").alias("m"), F.col("runs").alias("item_runs"), _prefix(F.col("runs"), least).alias("prefix")), "bench-known")
    at = lambda df: df.withColumn("run", F.explode_outer("prefix")).drop("prefix")
    near = (at(marked).alias("w").join(at(known).alias("i"), (F.col("w.n") == F.col("i.m")) & (F.col("w.run") == F.col("i.run")))
            .groupBy("window", "n", "item_id").agg(F.first("runs").alias("runs"), F.first("item_runs").alias("item_runs")))
    same = near.select("window", "n", "item_id", _jaccard(F.col("runs"), F.col("item_runs")).alias("similarity")).where(F.col("similarity") >= least)
    best = (held.select("key", "begin", "n", "window").join(same, ["window", "n"]).groupBy("key", "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("begin")).alias("at"))).alias("best")))
    return base.select("doc_id", "key").join(cut(best, "bench-best"), "key").select(
        "doc_id", "item_id", (-F.col("best.at")).alias("begin"), F.col("best.similarity").alias("similarity"), F.col("key").alias("text_key"))
