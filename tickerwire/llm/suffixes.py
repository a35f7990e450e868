"""Repeated passages by a sparse suffix array over the whole corpus.

Texts are sequences of word hashes. Of all suffixes only those are kept that
begin at a minimiser: the position with the least hashed ``GRAM``-word run
among ``SPAN`` neighbouring ones, which the content alone selects. Every
passage of ``LEAST`` words holds such a position among its first ``SPAN``, so
equal passages keep suffixes at the same places, followed by at least
``LEAST - SPAN + 1`` equal words. The kept suffixes are sorted by that many
words (by their hash) over all partitions and compared with their neighbours;
those equal to none are dropped, which are nearly all. The others are extended
to the left and right: all passages of exactly ``LEAST`` words around them are
compared exactly (128-bit), and runs of repeated passages merge into maximal
spans. A span's passages may have come first in different places: its parts
are the runs of passages whose first places lie one after another, and each
part tells whether it is removable. Removing every removable part keeps a copy
of every word: its first place is earlier in the order of (id, place), so the
chain of first places ends at words that stay. One group is never gathered: counts are combined before they are
shuffled, and a hot key's sorted rows are split over partitions by their
position.

Defined results: null counts as the empty text; texts under ``LEAST`` words
repeat nothing; equal texts are one node: the document with the smallest
doc_id (null last) is the first, all others repeat it wholly (a span over the
whole text, beside those shared with other texts); an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerwire.llm.common import cut, drop, ship, text_key
from tickerwire.llm.wordhash import grams, rolling, slices, word_hashes

LEAST, SPAN, GRAM = 50, 20, 8
PREFIX = LEAST - SPAN + 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def minimisers(words: np.ndarray) -> np.ndarray:
    """Positions of the least ``GRAM``-word run of each ``SPAN`` neighbours
    that a passage of ``LEAST`` words can begin with (the first of equals)."""
    if len(words) < LEAST:
        return np.zeros(0, np.int64)
    order = grams(words, GRAM)[:len(words) - LEAST + SPAN]
    windows = np.lib.stride_tricks.sliding_window_view(order, SPAN)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (suffix, node, at)."""
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            hashes, first = word_hashes(part.column("text"))
            rows, spots, keys = [], [], []
            for i in range(part.num_rows):
                words = hashes[first[i]:first[i + 1]]
                at = minimisers(words)
                if len(at):
                    rows.append(np.full(len(at), i))
                    spots.append(at)
                    keys.append(rolling(words, PREFIX, 0x5851F42D4C957F2D)[at])
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), part.column("node").take(pa.array(np.concatenate(rows))),
                     pa.array(np.concatenate(spots).astype(np.int32))], names=["suffix", "node", "at"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes those equal to a neighbour of another place; what
    copies of a text gave again is one. A partition's first and last suffix
    stay, as their other neighbour is elsewhere."""
    held = None   # the last row so far, and whether it stays anyway
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        again = pc.and_(pc.equal(batch.column("node")[1:], batch.column("node")[:-1]), pc.equal(batch.column("at")[1:], batch.column("at")[:-1]))
        batch = batch.filter(pa.concat_arrays([pa.array([True]), pc.invert(again)]))
        key = batch.column("suffix").to_numpy(zero_copy_only=False)
        same = key[1:] == key[:-1]
        stay = np.zeros(len(key), bool)
        stay[1:] |= same
        stay[:-1] |= same
        if held is None:
            stay[0] = True
        elif held_stays:
            stay[0] = True
        held, held_stays = batch.slice(len(key) - 1), bool(stay[-1])
        yield batch.slice(0, len(key) - 1).filter(pa.array(stay[:-1])).select(["node", "at"])
    if held is not None:
        yield held.select(["node", "at"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id, text, spots) -> (h, g, node, id, at, char_begin, char_end):
    the passages of ``LEAST`` words whose first minimiser is among ``spots``."""
    names = ["h", "g", "row", "at", "char_begin", "char_end"]
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            hashes, first = word_hashes(part.column("text"))
            out: list[list] = [[] for _ in names]
            for i in range(part.num_rows):
                words = hashes[first[i]:first[i + 1]]
                n = len(words) - LEAST + 1
                spots = np.unique(np.array(part.column("spots")[i].as_py(), np.int64))
                near = np.zeros(max(n, 0) + 1, np.int64)
                np.add.at(near, np.clip(spots - SPAN + 1, 0, max(n, 0)), 1)
                np.add.at(near, np.clip(spots + 1, 0, max(n, 0)), -1)
                at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                if len(at):
                    begins, ends = _word_places(part.column("text")[i].as_py())
                    for column, values in zip(out, (rolling(words, LEAST, 0x2545F4914F6CDD1D)[at], rolling(words, LEAST, 0x9FB21C651E98DF25)[at],
                                                    np.full(len(at), i), at, begins[at], ends[at + LEAST - 1])):
                        column.append(values)
            if out[0]:
                h, g, row, *places = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), *(part.column(c).take(pa.array(row)) for c in ("node", "id")),
                     *(pa.array(c.astype(np.int32)) for c in places)], names=["h", "g", "node", "id", *names[3:]])


_PART = pa.struct([(c, pa.int64()) for c in ("begin", "end", "char_begin", "char_end", "first_id", "first_at")])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, repeats: [(at, first id, first at, char_begin, char_end)]) ->
    maximal spans in words and code points, with where the passage at the
    begin came first and the parts that came first in one place each."""
    schema = pa.schema([("node", pa.binary()), *[(c, pa.int64()) for c in _PART.names], ("parts", pa.list_(_PART))])
    for batch in batches:
        rows = []
        lists = batch.column("repeats")
        bounds, values = lists.offsets.to_numpy(), lists.values
        column = lambda c: values.field(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        ats, firsts, char_begins, char_ends = map(column, ("at", "first_at", "char_begin", "char_end"))
        ids = values.field("id")
        null, numbers = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        for i, node in enumerate(batch.column("node").to_pylist()):
            order = np.argsort(ats[bounds[i]:bounds[i + 1]]) + bounds[i]
            at, first, number, no = ats[order], firsts[order], numbers[order], null[order]
            apart = np.diff(at) > 1
            turns = apart | (np.diff(first - at) != 0) | (np.diff(number) != 0) | (no[1:] != no[:-1])
            begins = np.concatenate([[0], np.flatnonzero(turns) + 1])
            ends = np.concatenate([begins[1:], [len(at)]]) - 1
            fresh = np.concatenate([[True], apart])[begins]
            parts: list = []

            def done() -> tuple:
                a, b = parts[0], parts[-1]  # noqa: B023
                return (node, a["begin"], b["end"], a["char_begin"], b["char_end"], a["first_id"], a["first_at"], parts)  # noqa: B023
            for new, a, b, id_, is_null, where, chars, until in zip(
                    fresh.tolist(), at[begins].tolist(), at[ends].tolist(), number[begins].tolist(), no[begins].tolist(), first[begins].tolist(),
                    char_begins[order][begins].tolist(), char_ends[order][ends].tolist()):
                if new and parts:
                    rows.append(done())
                    parts = []
                parts.append(dict(zip(_PART.names, (a, b + LEAST, chars, until, None if is_null else id_, where))))
            rows.append(done())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
    return found[:, 0], found[:, 1]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and maximal repeated span: doc_id, begin, end
    (words), char_begin, char_end (code points), first_doc_id, first_begin (of
    the passage at the begin), removable (every part is) and parts: per part
    the same columns, removable if it is not the first place."""
    ship(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), text_key(F.col(text)).alias("node"))
    # equal texts are one node; its first document, nulls last. What a whole copy
    # spans is told by counts, so no text goes on with it
    white = F.lit(" \t\n\x0b\x0c\r")
    whole = {"words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
             "char_begin": (F.length("text") - F.length(F.ltrim("text", white))).cast("long"), "char_end": F.length(F.rtrim("text", white)).cast("long")}
    nodes = cut(base.select("node", "doc_id", *[c.alias(k) for k, c in whole.items()]).groupBy("node")
                .agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), *[F.max(k).alias(k) for k in whole]), "suffix-nodes")
    # written before the splitters are sampled: suffixes are cut once
    found = cut(base.select("node", "text").mapInArrow(_suffixes, "suffix long, node binary, at int"), "suffixes")
    ordered = found.repartitionByRange("suffix", "node", "at").sortWithinPartitions("suffix", "node", "at")
    spots = cut(ordered.mapInArrow(_neighbours, "node binary, at int"), "suffix-repeated", few=True)
    drop(found)
    spots = spots.groupBy("node").agg(F.collect_list("at").alias("spots")).join(nodes.select("node", "id"), "node")
    texts = base.select("node", "text").join(spots, "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("id", "text", "spots")])
    place = ["at", "char_begin", "char_end"]
    passages = cut(texts.mapInArrow(_passages, "h long, g long, node binary, id long, " + ", ".join(f"{c} int" for c in place)), "passages")
    where = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("at").alias("at"))
    twice = passages.groupBy("h", "g").agg(F.count("*").alias("k"), F.min(where).alias("first")).where("k > 1").select("h", "g", "first")
    hits = (passages.drop("id").join(twice, ["h", "g"]).groupBy("node")
            .agg(F.collect_list(F.struct(F.col("first.id").alias("id"), F.col("first.at").alias("first_at"), *place)).alias("repeats")))
    fields = ", ".join(f"{c} long" for c in _PART.names)
    parts_type = f"array<struct<{fields.replace(' long', ': long')}>>"
    spans = hits.mapInArrow(_spans, f"node binary, {fields}, parts {parts_type}")
    copies = nodes.where(f"n > 1 AND words >= {LEAST}").select(
        "node", F.lit(0).cast("long").alias("begin"), F.col("words").alias("end"), "char_begin", "char_end", F.col("id").alias("first_id"),
        F.lit(0).cast("long").alias("first_at"))
    spans = cut(spans.unionByName(copies.withColumn("parts", F.array(F.struct(*_PART.names)).cast(parts_type))), "suffix-spans", few=True)
    rows = base.select("doc_id", "node").join(spans, "node")
    parts = F.transform("parts", lambda p: F.struct(
        *[p[c].alias(c) for c in ("begin", "end", "char_begin", "char_end")], p["first_id"].alias("first_doc_id"), p["first_at"].alias("first_begin"),
        (~(F.col("doc_id").eqNullSafe(p["first_id"]) & (p["begin"] == p["first_at"]))).alias("removable")))
    return rows.select("doc_id", "begin", "end", "char_begin", "char_end", F.col("first_id").alias("first_doc_id"),
                       F.col("first_at").alias("first_begin"), F.forall(parts, lambda p: p["removable"]).alias("removable"), parts.alias("parts"))
