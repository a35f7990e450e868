"""Exact duplicates by a content sort.

Sampled splitters range-partition the texts, an external sort inside each
partition places equal texts side by side, and each text is compared in full
with its neighbour. The order is (first ``PREFIX`` characters, 64-bit hash,
whole text, identifier): it is total over contents, so equals are neighbours,
while the splitters that Spark samples to the driver stay a few bytes long
however long texts or their common beginnings are. As the identifier takes
part, a text that a third of all rows hold is cut over several partitions.

Tasks stream their sorted rows: memory holds one Arrow batch and the text
before it. A run of equal texts that lies inside one batch is final at once.
Those that touch a batch's border are counted afterwards by narrow columns,
and runs that meet across partitions are found by comparing each partition's
first text with the last one before it: two rows a partition.

Defined results: a null text counts as empty; null identifiers come last in
the order of choice; of rows equal in text and identifier one stays; an empty
table gives no rows; columns other than the two named are only carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerwire.llm.common import cut, ship

PREFIX = 64
_OUT = "id long, sha binary, part int, run long, head boolean, open boolean, keep_id long, n long, edge string, edge_text string"
_TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_NAMES = [x.split(" ")[0] for x in _OUT.split(", ")]


def _sha(texts: pa.Array, at: int) -> bytes:
    return hashlib.sha256(texts[at].as_buffer()).digest()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, text, row) -> the rows of ``_OUT`` with ``row``, and two
    rows for the partition's first and last text."""
    from pyspark import TaskContext
    part, run, last, first, sha, keep, row_type = TaskContext.get().partitionId(), -1, None, None, None, None, None
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        ids, texts, row_type = batch.column(0), batch.column(1), batch.column(2).type
        begins = np.ones(size, bool)
        begins[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        begins[0] = last is None or texts[0].as_buffer() != last.as_buffer()
        if first is None:
            first = texts[0].as_py()
        starts = np.flatnonzero(begins)
        # runs of this batch: the one it goes on with, if any, then those that begin in it
        shas, keeps = [_sha(texts, i) for i in starts.tolist()], ids.take(pa.array(starts)).to_pylist()
        if not begins[0]:
            shas, keeps, starts = [sha, *shas], [keep, *keeps], np.concatenate([[0], starts])
        runs = run + np.arange(len(starts)) + (1 if begins[0] else 0)
        sizes = np.diff(np.append(starts, size))
        # a run at either end may reach into another batch or partition
        is_open = np.zeros(len(starts), bool)
        is_open[[0, -1]] = True
        of = np.repeat(np.arange(len(starts)), sizes)
        spread = pa.array(of)
        yield pa.RecordBatch.from_arrays([
            ids, pa.array(shas, pa.binary()).take(spread), pa.array(np.full(size, part), pa.int32()), pa.array(runs[of], pa.int64()),
            pa.array(begins), pa.array(is_open[of]), pa.array(keeps, pa.int64()).take(spread),
            pa.array(sizes[of], pa.int64(), mask=is_open[of]), pa.nulls(size, pa.string()), pa.nulls(size, pa.string()), batch.column(2)],
            names=[*_NAMES, "row"])
        run, last, sha, keep = int(runs[-1]), texts[size - 1], shas[-1], keeps[-1]
    if first is not None:
        blank = [[None, None, part, r, None, None, None, None, e, t] for r, e, t in ((0, "first", first), (run, "last", last.as_py()))]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*blank), _TYPES)), pa.nulls(2, row_type)], names=[*_NAMES, "row"])


def _across(rows: DataFrame) -> DataFrame:
    """(part, run, n, keep_id, begins) of the open runs over all partitions:
    whole group size and kept identifier; ``begins``: whether the group starts
    with this run. Texts meet by partition number alone; what one task orders
    is two numbers a partition."""
    edges = rows.where("edge IS NOT NULL")
    firsts = edges.where("edge = 'first'").select("part", F.col("edge_text").alias("text"))
    lasts = edges.where("edge = 'last'").select("part", "run", F.col("edge_text").alias("text"))
    order = lasts.select("part", F.col("run").alias("last_run"), F.lag("part").over(Window.orderBy("part")).alias("prev"))
    met = (firsts.join(order, "part").join(lasts.select(F.col("part").alias("prev"), F.col("text").alias("prev_text")), "prev", "left")
           .select("part", "last_run", F.coalesce(F.col("text") == F.col("prev_text"), F.lit(False)).alias("goes_on")))
    ends = met.select("part", "goes_on", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), "last_run"))).alias("run"))
    begins = ~(F.col("goes_on") & (F.col("run") == 0))
    ends = ends.select("part", "run", begins.alias("begins"),
                       F.sum(begins.cast("long")).over(Window.orderBy("part", "run")).alias("chain"))
    counted = rows.where("open").groupBy("part", "run").agg(F.count("*").alias("n"), F.max("keep_id").alias("keep_id"))
    counted = cut(counted.join(ends, ["part", "run"], "left"), "open-runs")
    chains = counted.where("chain IS NOT NULL").groupBy("chain").agg(
        F.sum("n").alias("chain_n"), F.min_by("keep_id", F.struct("part", "run")).alias("chain_keep"))
    whole = counted.join(chains, "chain", "left")
    return whole.select("part", "run", F.coalesce("chain_n", "n").alias("n"), F.coalesce("begins", F.lit(True)).alias("begins"),
                        F.when(F.col("chain").isNull(), F.col("keep_id")).otherwise(F.col("chain_keep")).alias("keep_id"))


def content_order(rows: DataFrame, keep: str) -> DataFrame:
    """(id, text, row) range-partitioned and sorted; the row that stays comes
    first among equals."""
    chosen = {"least": F.col("id").asc_nulls_last(), "greatest": F.col("id").desc_nulls_last()}[keep]
    keyed = rows.withColumn("begin", F.substring("text", 1, PREFIX)).withColumn("hash", F.xxhash64("text"))
    return (keyed.repartitionByRange("begin", "hash", chosen)
            .sortWithinPartitions("begin", "hash", "text", chosen).select("id", "text", "row"))


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "least", carry: Sequence[str] = (),
         normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept,
    text_sha256, row). Texts are equal when ``normalise`` (none: no change)
    makes them the same; ``keep``: the row with the least or the greatest
    identifier of a group stays; ``row``: a struct of the columns ``carry``."""
    ship(docs.sparkSession)
    plain = F.coalesce(F.col(text), F.lit(""))
    plain = F.coalesce(normalise(plain), F.lit("")) if normalise else plain
    number = F.col(doc_id).cast("long")
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(number.alias("id"), plain.alias("text"), row.alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()
    found = cut(content_order(rows, keep).mapInArrow(_neighbours, f"{_OUT}, row {row_type}"), "sorted-texts")
    out = lambda d, n, k, kept: d.select("id", k.alias("keep_id"), n.alias("group_size"), kept.alias("kept"),
                                         F.lower(F.hex("sha")).alias("text_sha256"), "row")
    closed = out(found.where("NOT open"), F.col("n"), F.col("keep_id"), F.col("head"))
    whole = cut(_across(found).select("part", "run", F.col("n").alias("all_n"), F.col("keep_id").alias("all_keep"), "begins"), "whole-runs")
    met = out(found.where("open").join(whole, ["part", "run"]), F.col("all_n"), F.col("all_keep"), F.col("head") & F.col("begins"))
    return closed.unionByName(met)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "least",
                normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, whole."""
    return mark(docs, doc_id, text, keep, docs.columns, normalise).where("kept").select("row.*")
