"""Mixture-controlled packing into fixed windows.

Documents of each source form a queue. They are turned into ids first, so all
lengths and proportions are counted in tokens. A virtual clock deals the queues
out: a document at share v of its source's length has time v, so any stretch of
the clock holds every source in its target proportion. Stretches of about
``task_chars`` characters go to one task each, which serves its queues by deficit round
robin: each round adds a quantum proportional to the source's target to its
deficit, and documents leave the queue while the deficit covers them; what is
left over, or overdrawn, is carried to the next window. Over stretches the
clock itself carries: its times come from running totals of each whole queue,
so what one stretch dealt too much of a source the next one deals less of, and a
queue starts each stretch with what the ones before still owe it.
Documents are laid end to end and cut at the windows' ends; only the last
window of a stretch is padded.

Targets default to the sources' shares of the corpus, so all queues end
together; with other targets the queues left over share what remains.

Defined results: null text: the end mark alone; null source: a queue of its
own; equal or repeated rows are packed each; an empty table gives no pieces;
a text of any length is cut over as many windows as it takes.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerwire.llm.common import cut, ship
from tickerwire.llm.wordhash import slices

WINDOW = 2048
TASK_CHARS = 8 << 20
PARTS = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Tokens:
    """Texts to their ids and ``end_id`` as little-endian unsigned 32-bit
    numbers. ``tokenizer``: a byte-level BPE among the public tokenizers. Its
    added tokens count wherever a text holds their strings, as in the
    tokenizers library."""

    def __init__(self, tokenizer: str, end_id: int):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        added = library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{tokenizer}: added tokens that take blanks or whole words are not supported")
        self.added = {t.content: [i] for i, t in added.items()}
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        to_byte = _byte_alphabet()
        vocabulary = library.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(to_byte.__getitem__, t)): rank for t, rank in vocabulary.items() if t not in self.added}
        self.encode = tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = [end_id]

    def ids(self, text: str) -> list[int]:
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.encode(text[at:m.start()]) + self.added[m.group()]
            at = m.end()
        return out + self.encode(text[at:]) if at else self.encode(text)

    def __call__(self, text: str | None) -> bytes:
        return np.array(self.ids(text or "") + self.end, "<u4").tobytes()


@functools.cache
def tokens(tokenizer: str, end_id: int = 1) -> Tokens:
    """Kept by each Python worker."""
    return Tokens(tokenizer, end_id)


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level BPE vocabularies: printable bytes stand
    for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def round_robin(queues: dict[str, deque], weight: dict[str, float], deficit: dict[str, float], quantum: int = WINDOW) -> Iterator:
    """Documents (.., bytes) of the queues in deficit round-robin order;
    ``deficit`` (tokens) is carried in place."""
    while any(queues.values()):
        live = [s for s in queues if queues[s]]
        total = sum(weight[s] for s in live)
        # rounds in which no queue could send are taken at once
        need = min(max(0.0, (len(queues[s][0][-1]) // 4 - deficit[s]) * total / (weight[s] * quantum)) for s in live)
        rounds = max(1, math.ceil(need))
        for s in live:
            deficit[s] += rounds * quantum * weight[s] / total
            while queues[s] and len(queues[s][0][-1]) // 4 <= deficit[s]:
                item = queues[s].popleft()
                deficit[s] -= len(item[-1]) // 4
                yield s, item


def _encode(tokenizer: str, end_id: int):
    """(doc_id, source, hash, chars, text) -> with the text's ids and their
    number n; ids are kept in two bytes each where all of a text's fit."""
    def narrow(ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        return numbers.astype("<u2").tobytes() if numbers.max() < 1 << 16 else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = list(map(tokens(tokenizer, end_id), part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "source", "hash", "chars")), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(narrow, ids)), pa.binary())],
                    names=["doc_id", "source", "hash", "chars", "n", "ids"])
    return run


def _pack(window: int):
    """Rows without ids tell what a queue is owed (``due``) as its stretch starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, weight, owed = {}, {}, {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "source", "due", "doc_id", "share", "own", "ids"))
            for bucket, source, due, doc_id, share, own, ids in zip(*columns):
                key = "" if source is None else "=" + source
                if ids is None:
                    owed[bucket, key] = due
                else:
                    ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * own else ids
                    docs.setdefault(bucket, {}).setdefault(key, []).append((due, -1 if doc_id is None else doc_id, doc_id, ids))
                    weight[key] = share
        for bucket in sorted(docs):
            queues = {s: deque(sorted(docs[bucket][s], key=lambda d: (d[0], d[1], d[3]))) for s in sorted(docs[bucket])}
            deficit = {s: owed.get((bucket, s), 0.0) for s in queues}
            rows, position = [], 0
            for source, (_, _, doc_id, ids) in round_robin(queues, weight, deficit, window):
                total, at = len(ids) // 4, 0
                while at < total:
                    room = window - position % window
                    n = min(room, total - at)
                    rows.append((doc_id, at, n, zlib.crc32(ids[4 * at:4 * (at + n)]), total,
                                 (bucket << 32) + position // window, position % window, source[1:] or None))
                    at, position = at + n, position + n
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 7 + [pa.string()])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])
            del docs[bucket]
    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = "byte_bpe_50k.json",
         end_id: int = 1, window: int = WINDOW, targets: dict[str, float] | None = None, task_chars: int = TASK_CHARS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, source) that hold every token of every document once."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                        F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("hash"),
                        (F.length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("chars"), F.col(text).alias("text"))
    rows = cut(texts.mapInArrow(_encode(tokenizer, end_id), "doc_id long, source string, hash long, chars long, n long, ids binary"), "packing-ids")
    # a part of the rows, told by their content, has a stretch of each source's queue
    part = F.pmod("hash", F.lit(PARTS))
    lengths = rows.groupBy("source", part.alias("part")).agg(F.sum("n").alias("n"))
    queue = Window.partitionBy("source")
    # a row per source and part, written: Spark knows its size and broadcasts it to the ids if it is small
    placed = cut(lengths.select("source", "part", (F.sum("n").over(queue.orderBy("part")) - F.col("n")).alias("before"), "n",
                                F.sum("n").over(queue).alias("total")), "packing-places")
    sums = lengths.groupBy("source").agg(F.sum("n").alias("total"))
    whole, chars = (x or 1 for x in rows.agg(F.sum("n"), F.sum("chars")).first())
    share = F.col("total") / F.lit(float(whole))
    if targets is not None:
        given = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.greatest(F.coalesce(F.element_at(F.create_map(*given), F.coalesce("source", F.lit(""))), F.lit(0.0)), F.lit(1e-6))
    # the clock runs until the queue that lasts longest at its share is empty
    span = sums.agg(F.max(F.col("total") / share)).first()[0] or 1.0
    buckets = max(1, math.ceil(span * chars / whole / task_chars))
    # a row's place in the stretch, by its content alone, so that a task that runs again deals
    # each row to the same bucket whatever order it reads; rows of equal places are told apart there
    lot = F.pmod(F.shiftrightunsigned("hash", 20), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def dealt(*more: str) -> DataFrame:
        timed = (rows.select("source", "hash", F.col("n").alias("own"), *more).withColumn("part", part)
                 .join(placed.select(F.col("source").alias("s"), F.col("part").alias("q"), "before", "n", "total"),
                       F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("q")))
                 .select("source", "own", "total", *more, share.alias("share"),
                         ((F.col("before") + lot * F.col("n")) / share / F.lit(float(span))).alias("due")))
        return timed.withColumn("bucket", F.least(F.floor(F.col("due") * buckets), F.lit(buckets - 1)).cast("long"))

    sent = dealt().groupBy("bucket", "source").agg(F.sum("own").alias("own"), F.first("total").alias("total"), F.first("share").alias("share"))
    earlier = F.sum("own").over(queue.orderBy("bucket")) - F.col("own")
    meant = F.least(F.col("share") * F.lit(float(span)) * F.col("bucket") / F.lit(float(buckets)), F.col("total").cast("double"))
    starts = sent.select("bucket", "source", (meant - earlier).alias("due"), F.lit(None).cast("long").alias("doc_id"),
                         F.lit(None).cast("binary").alias("ids"), "share", F.lit(None).cast("long").alias("own"))
    queued = dealt("doc_id", "ids").select("bucket", "source", "due", "doc_id", "ids", "share", "own").unionByName(starts)
    return queued.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(_pack(window), PIECES)
