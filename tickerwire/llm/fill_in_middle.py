"""Fill-in-middle examples from seekable compressed texts.

``store`` keeps a text as independent zstandard frames of about ``FRAME``
bytes, each with the number of units, characters and bytes before it: a seek
index. A unit is a run of ASCII letters or any other single character; a run
that a frame's end divides counts where it starts. ``transform`` looks the two
cuts up in the index, decompresses only the frames that hold them, and lays
out prefix, suffix and middle as frames of the output; ``digests`` streams
output frames in order, finds the marks again and streams the rebuilt text.
No step holds a whole text beside its frames.

The cuts, the form and the order of the parts follow from the sha256 of
``seed:doc_id`` alone.

Defined results: a null text counts as empty; a null identifier is the empty
string in the hash; empty texts and texts that hold one of the marks are
plain; equal rows give equal rows; an empty table gives no rows; columns other
than the two named are not read.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerwire.llm.common import ship

FRAME, BATCH = 64 << 10, 4 << 20
MARKS = (b"<P>", b"<S>", b"<M>")
_SEEK = pa.list_(pa.struct([("unit", pa.int64()), ("char", pa.int64()), ("byte", pa.int64()), ("joined", pa.bool_()), ("data", pa.binary())]))
_LAID = pa.list_(pa.struct([("byte", pa.int64()), ("data", pa.binary())]))
STORED = ("id long, n long, chars long, bytes long, marked boolean, "
          "frames array<struct<unit:long,char:long,byte:long,joined:boolean,data:binary>>")
MADE = "id long, n long, form string, prefix_chars long, middle_chars long, bytes long, output array<struct<byte:long,data:binary>>"
DIGESTS = "id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
TEXTS = "id long, form string, output string, restored string"


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _marks(data: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes of characters, first bytes of units) as masks; ``joined``:
    the character before is a letter."""
    letter = ((data | 32) - np.uint8(97)) < 26
    before = np.empty(len(data), bool)
    before[:1], before[1:] = joined, letter[:-1]
    lead = (data & 0xC0) != 0x80
    return lead, lead & ~(letter & before)


def frames_of(text: bytes) -> tuple[list[dict], int, int]:
    """(frames with their seek index, units, characters) of a text."""
    frames, unit, char, at, joined = [], 0, 0, 0, False
    while at < len(text):
        end = min(at + FRAME, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:   # frames end between characters
            end += 1
        piece = text[at:end]
        lead, starts = _marks(np.frombuffer(piece, np.uint8), joined)
        frames.append({"unit": unit, "char": char, "byte": at, "joined": joined, "data": _zstd()[0].compress(piece)})
        unit, char, at, joined = unit + int(starts.sum()), char + int(lead.sum()), end, piece[-1:].isalpha()
    return frames, unit, char


def place(frames: list[dict], cut: int, n: int, chars: int, size: int) -> tuple[int, int]:
    """(byte, character) at which unit ``cut`` starts; that of the end for n."""
    if cut == n:
        return size, chars
    frame = frames[bisect_right(frames, cut, key=lambda f: f["unit"]) - 1]
    lead, starts = _marks(np.frombuffer(_zstd()[1].decompress(frame["data"]), np.uint8), frame["joined"])
    at = int(np.flatnonzero(starts)[cut - frame["unit"]])
    return frame["byte"] + at, frame["char"] + int(lead[:at].sum())


def pieces(frames: list[dict], begin: int, end: int) -> Iterator[bytes]:
    """Bytes begin..end of framed data, a frame at a time."""
    at = max(0, bisect_right(frames, begin, key=lambda f: f["byte"]) - 1)
    while begin < end and at < len(frames):
        data, start = _zstd()[1].decompress(frames[at]["data"]), frames[at]["byte"]
        yield data[max(0, begin - start):end - start]
        at += 1
        if at < len(frames) and frames[at]["byte"] >= end:
            return


def framed(parts: Iterator[bytes]) -> tuple[list[dict], int]:
    """Frames of a stream of bytes, and their total."""
    frames, at, held, size = [], 0, [], 0
    def flush() -> None:
        nonlocal at, held, size
        if size:
            frames.append({"byte": at, "data": _zstd()[0].compress(b"".join(held))})
            at, held, size = at + size, [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= FRAME:
            flush()
    flush()
    return frames, at


def marks_at(frames: list[dict]) -> dict[bytes, int]:
    """Byte of each mark in framed output; a mark may lie across frames."""
    found, tail = {}, b""
    for frame in frames:
        data = tail + _zstd()[1].decompress(frame["data"])
        for mark in MARKS:
            if mark not in found and (i := data.find(mark)) >= 0:
                found[mark] = frame["byte"] - len(tail) + i
        tail = data[-2:]
    return found


def restored(frames: list[dict], form: str, size: int) -> Iterator[bytes]:
    """The text that output frames of a form stand for."""
    if form == "plain":
        yield from pieces(frames, 0, size)
        return
    at = marks_at(frames)
    p, s, m = (at[x] for x in MARKS)
    yield from pieces(frames, p + 3, s if form == "psm" else m)
    yield from pieces(frames, m + 3, size)
    yield from pieces(frames, s + 3, m if form == "psm" else p)


def _batches(rows: Iterator[tuple[tuple, int]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes as record batches of bounded bytes."""
    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 64
        if size >= BATCH:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[tuple, int]]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_buffer().to_pybytes()
                frames, n, chars = frames_of(text)
                yield (i, n, chars, len(text), any(m in text for m in MARKS), frames), sum(len(f["data"]) for f in frames)
    yield from _batches(rows(), _names(STORED), [pa.int64()] * 4 + [pa.bool_(), _SEEK])


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The framed texts of ``docs``; may be written and read again."""
    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_store, STORED)


def _transform(seed: int, plain_from: int, spm_below: int):
    def one(r: dict) -> tuple[tuple, int]:
        n, size, frames = r["n"], r["bytes"], r["frames"]
        digest = hashlib.sha256(f"{seed}:{'' if r['id'] is None else r['id']}".encode()).digest()
        h = [int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4)]
        if not size or r["marked"] or h[2] % 100 >= plain_from:
            out = [{"byte": f["byte"], "data": f["data"]} for f in frames]
            return (r["id"], n, "plain", None, None, size, out), size
        (b1, c1), (b2, c2) = (place(frames, c, n, r["chars"], size) for c in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        form = "spm" if h[3] % 100 < spm_below else "psm"
        prefix, suffix = (MARKS[0], 0, b1), (MARKS[1], b2, size)
        order = [*((suffix, prefix) if form == "spm" else (prefix, suffix)), (MARKS[2], b1, b2)]
        out, total = framed(x for mark, a, b in order for x in (mark, *pieces(frames, a, b)))
        return (r["id"], n, form, c1, c2 - c1, total, out), total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (one(r) for b in batches for k in range(0, b.num_rows, 64) for r in b.slice(k, 64).to_pylist())
        yield from _batches(rows, _names(MADE), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _LAID])
    return run


def transform(stored: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Outputs of framed texts, framed themselves. Of a hundred texts about
    ``plain_from`` are cut; of those ``spm_below`` in a hundred put the suffix
    first."""
    ship(stored.sparkSession)
    return stored.mapInArrow(_transform(seed, plain_from, spm_below), MADE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digest(parts: Iterator[bytes]) -> str:
        sha = hashlib.sha256()
        for part in parts:
            sha.update(part)
        return sha.hexdigest()

    def rows() -> Iterator[tuple[tuple, int]]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                for r in b.slice(k, 64).to_pylist():
                    frames, size = r["output"], r["bytes"]
                    yield (r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"],
                           digest(pieces(frames, 0, size)), digest(restored(frames, r["form"], size))), 200
    yield from _batches(rows(), _names(DIGESTS), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def digests(made: DataFrame) -> DataFrame:
    """sha256 of each output and of the text rebuilt from output and form."""
    return made.mapInArrow(_digests, DIGESTS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[tuple, int]]:
        for b in batches:
            for r in (x for k in range(0, b.num_rows, 64) for x in b.slice(k, 64).to_pylist()):
                out, back = (b"".join(x) for x in (pieces(r["output"], 0, r["bytes"]), restored(r["output"], r["form"], r["bytes"])))
                yield (r["id"], r["form"], out.decode(), back.decode()), 2 * len(out)
    yield from _batches(rows(), _names(TEXTS), [pa.int64(), pa.string(), pa.string(), pa.string()])


def texts(made: DataFrame) -> DataFrame:
    """Each output as text, and the text rebuilt from it."""
    return made.mapInArrow(_texts, TEXTS)
