"""Quality rules with thresholds adapted to language and source.

Per text the rules measure ratios (symbols per word, repeated lines, words in
repeated 5-word windows, mean word length). Their cutoffs are not fixed: every
(lang, source) group has a quantile sketch per measure: counts of logarithmic
buckets (relative error 1 %), at most some hundred however many rows the group
has. Sketches merge by adding up, so a group too small to speak for itself
takes the merged sketch of its language, and one of a language too small that
of the corpus. A text fails where a measure lies beyond the upper
(or lower) quartile by more than ``spread`` interquartile ranges and by more
than ``slack``. Thresholds are then joined to the rows.

Defined results: null text: no words, fails; null lang or source: a group of
its own; repeated rows are judged alike; an empty table gives no rows; input
columns, whatever their names, are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerwire.llm.common import cut, gram_hashes, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
# measure -> (whether low values fail too, slack)
MEASURES = {"symbol_ratio": (False, 0.05), "dup_line_ratio": (False, 0.25),
            "repeat_ratio": (False, 0.05), "mean_word": (True, 2.0)}
MIN_ROWS = 100
SPREAD = 3.0
GAMMA = 1.02
NONE = -100_000   # the bucket of 0


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` with n_words, word_chars, n_symbols, n_lines,
    n_dup_lines and n_repeat_words (all long) of each text."""
    given = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keep, given.alias("__t"), words_of(F.col(text)).alias("__w"),
                       F.filter(F.split(given, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    hashed = gram_hashes(base, "__w", "__h").select(
        *keep, F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), "__h")
    # only texts with an equal pair of windows are sorted
    spots = hashed.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(
        F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # (an element is taken out before its field: the other order would copy the array each time)
    near = lambda i: F.get("__s", i)["h"]
    hits = spots.withColumn("__r", F.array_sort(F.filter(F.transform("__s", lambda s, i: F.when(
        (near(i - 1) == s["h"]) | (near(i + 1) == s["h"]), s["i"])), lambda i: i.isNotNull())))
    # a repeated window adds the words up to the next one's begin
    added = F.aggregate(F.transform("__r", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__r", i + 1) - p, F.lit(WINDOW)))),
                        F.lit(0), lambda a, x: a + x)
    return hits.withColumn("n_repeat_words", F.coalesce(added, F.lit(0)).cast("long")).drop("__h", "__s", "__r")


def _bucket(x: Column) -> Column:
    return F.when(x > 0, F.ceil(F.ln(x) / math.log(GAMMA))).otherwise(NONE).cast("int")


def _value(bucket: Column) -> Column:
    """The middle of a bucket."""
    return F.when(bucket > NONE, F.pow(F.lit(GAMMA), bucket) * (2 / (GAMMA + 1))).otherwise(0.0)


def _ratios(rows: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return rows.withColumns({
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "mean_word": F.col("word_chars") / words})


def thresholds(rows: DataFrame, min_rows: int = MIN_ROWS, spread: float = SPREAD) -> DataFrame:
    """Per (lang, source): the limits ``<measure>_most`` and, where low values
    fail too, ``<measure>_least``."""
    points = rows.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), _bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("p"))
    sketch = points.groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count("*").alias("n"))
    keys = {"own": ["lang", "source"], "of_lang": ["lang"], "of_all": []}
    summary = {}
    for level, by in keys.items():   # sketches merge by adding their buckets up
        merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*by, "measure")
        ranked = merged.withColumns({"total": F.sum("n").over(group), "rank": F.sum("n").over(group.orderBy("bucket"))})
        summary[level] = ranked.groupBy(*by, "measure").agg(
            F.max("total").alias("n"), *[_value(F.min(F.when(F.col("rank") >= q * F.col("total"), F.col("bucket")))).alias(f"q{i}")
                                         for i, q in ((1, 0.25), (3, 0.75))])
    g, lang, every = (summary[k].alias(k) for k in keys)
    joined = (g.join(lang, F.col("own.lang").eqNullSafe(F.col("of_lang.lang")) & (F.col("own.measure") == F.col("of_lang.measure")))
              .join(every, F.col("own.measure") == F.col("of_all.measure")))
    level = lambda q: (F.when(F.col("own.n") >= min_rows, F.col(f"own.{q}"))
                       .when(F.col("of_lang.n") >= min_rows, F.col(f"of_lang.{q}")).otherwise(F.col(f"of_all.{q}")))
    long = joined.select(F.col("own.lang").alias("lang"), F.col("own.source").alias("source"),
                         F.col("own.measure").alias("measure"), level("q1").alias("q1"), level("q3").alias("q3"))
    limits = []
    for m, (both, slack) in MEASURES.items():
        reach = F.greatest(F.lit(spread) * (F.col("q3") - F.col("q1")), F.lit(slack))
        of = lambda c, m=m: F.max(F.when(F.col("measure") == m, c))
        limits += [of(F.col("q3") + reach).alias(f"{m}_most")] + ([of(F.col("q1") - reach).alias(f"{m}_least")] if both else [])
    return long.groupBy("lang", "source").agg(*limits)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          carry: list[str] | None = None, min_rows: int = MIN_ROWS, spread: float = SPREAD) -> DataFrame:
    """Every row of ``docs`` (its columns ``carry``, all by default, as the
    struct ``row``) with its measures, ``base_failed`` (under 10 words, or over
    a fifth of the words repeated) and ``kept``. Texts are measured once: the
    measured rows are written to the shared folder and read for the sketches
    and for the verdict."""
    carried = F.struct("*") if carry is None else F.struct(*carry)
    packed = docs.select(carried.alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    rows = _ratios(cut(measure(packed, "text", ("row", "lang", "source")), "quality"))
    limits = thresholds(rows.where("n_words >= 10"), min_rows, spread)
    beyond = F.lit(False)
    for m, (both, _) in MEASURES.items():
        beyond = beyond | (F.col(m) > F.col(f"{m}_most"))
        if both:
            beyond = beyond | (F.col(m) < F.col(f"{m}_least"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    joined = rows.alias("r").join(
        limits.alias("t"), F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    return joined.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES,
                         failed.alias("base_failed"), (~failed & ~F.coalesce(beyond, F.lit(False))).alias("kept"))
