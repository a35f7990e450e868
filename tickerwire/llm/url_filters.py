"""URL rules by a sort-merge range join over reversed-host keys.

A rule is a host, a path prefix and a verdict; it fits its host and every
subdomain. The canonical key of a host is its labels from the top down
(``org.example``). A URL has one key per host suffix, followed by its path, so
that "host or subdomain, and path prefix" becomes a plain prefix, i.e. an
interval of the key order ``[rule key, rule key + highest character)``. Rules
and URL keys are sorted together; the intervals nest, so the rules that are
open at a URL form a stack whose top is the last rule begun. Each rule carries
the stack at its own begin (its chain of enclosing rules), hence one running
``last`` over the sorted rows yields the stack at every URL, and the rules on
it whose key is a prefix of the URL's key are those still open.

Defined results: null url, or one without ``://``: empty host and path, judged
like any other. Equal URLs are judged once. Of the rules that fit, the one
with the longest host + path wins; of equally long ones the one with the
longer host; of one (host, path) given twice, ``block`` before ``allow``.
Rules with a null host, path or verdict fit nothing. Empty inputs give empty
results; every input column is kept beside the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows of one host suffix are dealt over so many groups; its rules go to each.
SALTS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z lower-cased; path then up to ``?``, ``#`` or the end."""
    given = F.coalesce(url, F.lit(""))
    at = F.instr(given, "://")
    rest = F.when(at > 0, F.substring(given, at + 3, F.length(given))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule (host, path, verdict) with the stack of rules open at its
    begin, itself last: (suffix, path, stack)."""
    one = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
           .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
           .select(reversed_host(F.col("host")).alias("suffix"), "path",
                   F.struct(F.length("path").alias("n"), "path", "host", "verdict").alias("rule")))
    # the enclosing rules are found among the rule's own prefixes by an equi-join
    prefixes = one.select("suffix", F.col("path").alias("full"),
                          F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    return (prefixes.select("suffix", "full", F.expr("substring(full, 1, n)").alias("path"))
            .join(one, ["suffix", "path"])
            .groupBy("suffix", F.col("full").alias("path")).agg(F.sort_array(F.collect_list("rule")).alias("stack")))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url",
          salts: int = SALTS) -> DataFrame:
    """Every row of ``urls`` with host, path, rule and verdict added as the
    struct column ``judged``; ``default`` is the verdict where no rule fits."""
    stacks = rule_stacks(rules)
    # no rule fits a suffix with more labels than the longest rule host has
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0
    host, path = url_parts(F.col(url))
    rows = urls.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    keys = rows.select("host", "path").distinct()
    labels = keys.select("host", "path", F.slice(F.reverse(F.split("host", r"\.", -1)), 1, max(deepest, 1)).alias("labels"))
    probes = labels.select(
        "host", "path", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"),
        F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("labels")),
                              lambda n: F.array_join(F.slice("labels", 1, n), "."))).alias("suffix"))
    begins = stacks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = (probes.select("suffix", "salt", "path", F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
            .unionByName(begins.select("suffix", "salt", "path", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")))
    sweep = Window.partitionBy("suffix", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.filter(F.last("stack", ignorenulls=True).over(sweep), lambda r: F.startswith(F.col("path"), r["path"]))
    best = (both.withColumn("opened", opened).where("kind = 1 AND size(opened) > 0")
            .withColumn("top", F.element_at("opened", -1))
            .groupBy("host", "path")
            .agg(F.max_by("top", F.struct(F.col("top.n") + F.length("top.host"), F.length("top.host"))).alias("top")))
    return (rows.join(best, ["host", "path"], "left")
            .select("row.*", F.struct(
                "host", "path", F.concat("top.host", "top.path").alias("rule"),
                F.coalesce("top.verdict", F.lit(default)).alias("verdict")).alias("judged")))
