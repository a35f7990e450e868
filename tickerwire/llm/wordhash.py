"""Word hashes of Arrow string batches, computed over the raw UTF-8 bytes.

A word's hash is a polynomial over its bytes modulo 2**64 (an odd base is
invertible there, so prefix sums give every word's value at once) followed by
a bit mixer. Buffers are worked through in blocks of ``BLOCK`` bytes cut at
white space, so memory does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK, 1 << (n - 1).bit_length()) + 1
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, _MASK + 1), np.uint64)
        up[0] = down[0] = 1
        pair = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > BLOCK + 1:   # a single word longer than a block: not worth keeping
            return pair
        _POWERS[size] = pair
    return _POWERS[size]


def _block_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of one block; ``breaks``: positions at
    which a new text begins."""
    word = ~_IS_SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = ~word[:-1]
    before[breaks] = True
    after = np.ones(len(data), bool)
    after[:-1] = ~word[1:]
    after[breaks[breaks > 0] - 1] = True
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text in order, index of each text's first
    word, with the total at the end). Nulls must be filled before."""
    data, offsets = text_buffer(texts)
    hashes, starts = [], []
    at, n = 0, len(data)
    while at < n:
        end = min(at + BLOCK, n)
        if end < n:   # cut at a text's begin or at white space
            k = offsets[np.searchsorted(offsets, end, "right") - 1]
            if k > at:
                end = int(k)
            else:
                while True:
                    blanks = np.flatnonzero(_IS_SPACE[data[at:end]])
                    if len(blanks):
                        end = at + int(blanks[-1]) + 1
                        break
                    stop = int(offsets[np.searchsorted(offsets, at, "right")])
                    if end >= stop:
                        end = stop
                        break
                    end = min(end + BLOCK, stop)
        breaks = offsets[np.searchsorted(offsets, at, "left"):np.searchsorted(offsets, end, "left")] - at
        h, s, _ = _block_words(data[at:end], breaks.astype(np.int64))
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` words; a shorter text is one run."""
    if len(hashes) == 0:
        return hashes
    size = min(n, len(hashes))
    out = np.full(len(hashes) - size + 1, (seed * 0x632BE59BD9B4E019 + size) & _MASK, np.uint64)
    for i in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i:i + len(out)]
    return mix(out)


def rolling(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash of each run of ``n`` words in time independent of ``n``."""
    if len(hashes) < n:
        return hashes[:0]
    base |= 1
    up, down = np.full(len(hashes) + 1, base & _MASK, np.uint64), np.full(len(hashes) + 1, pow(base, -1, _MASK + 1), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(base & 0xFFFF)) * up[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[:len(hashes) - n + 1])


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``size`` bytes of text each."""
    lengths = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    total, at = np.cumsum(lengths), 0
    while at < len(lengths):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + size, "right")))
        yield batch.slice(at, end - at)
        at = end
