"""Words and digests of many texts at once, as numpy arrays over Arrow's buffers.

A batch is cut into chunks of about a megabyte of whole texts, so that arrays stay
small however long the batch is. The digest of a word is a sum over its bytes of fixed
random numbers, one for each byte at each place; that of a run of words comes from those
of its halves, mixed at every step. Neither is linear in what it digests, so that texts
with a regular build do not meet. Two tables give two independent digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Places with numbers of their own; beyond them, numbers are mixed with the place.
PLACES = 64
#: For each of two digests, a number for each byte at each place.
_numbers = np.random.default_rng(20240229).integers(0, 1 << 64, (2, PLACES * 256), dtype=np.uint64)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Chunk:
    """Whole texts first..last of a batch: bytes, and where each text begins and ends."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Null texts count as empty. A text longer than ``size`` bytes is a chunk of its own."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for i, j in _cuts(off, size):
        yield Chunk(i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i])


def _cuts(off: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """First and last + 1 of each run of whole texts of at most ``size`` bytes; a longer text is alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1))
        yield i, j
        i = j


def slices(batch: pa.RecordBatch, column: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of ``batch``, in slices of at most ``size`` bytes of the texts in ``column``,
    or of one row. Nothing is copied."""
    texts = batch.column(column)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = texts.buffers()[1]
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    for i, j in _cuts(off.astype(np.int64), size):
        yield batch.slice(i, j - i)


@dataclass
class Words:
    """Words of a chunk: byte spans, the text of each, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    offsets: np.ndarray
    keep: np.ndarray  # which bytes belong to words


def words(chunk: Chunk, inside: np.ndarray | None = None) -> Words:
    """Runs of bytes that are not white space (or of bytes that ``inside`` marks)."""
    data, off = chunk.data, chunk.offsets
    keep = ~SPACE[data] if inside is None else inside[data]
    before = np.zeros(len(data), bool)
    before[1:] = keep[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = keep[1:]
    edges = off[(off > 0) & (off < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(keep & ~before)
    ends = np.flatnonzero(keep & ~after) + 1
    at = np.searchsorted(starts, off)
    return Words(starts, ends, np.repeat(np.arange(len(off) - 1), np.diff(at)), at, keep)


def word_digests(chunk: Chunk, w: Words, lower: bool = False, which: int = 0) -> np.ndarray:
    """A 64-bit digest of the bytes of each word; ``which`` of two independent ones."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    data = chunk.data[w.keep]
    if lower:
        data = LOWER[data]
    size = w.ends - w.starts
    begin = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=begin[1:])
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(begin, size)
    values = _numbers[which][((place & (PLACES - 1)) << 8) | data]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        values[far] = mix(values[far] + (place[far] // PLACES).astype(np.uint64) * _LEFT)
    return mix(np.add.reduceat(values, begin) + size.astype(np.uint64))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _LEFT
    x ^= x >> np.uint64(29)
    x += right
    x *= _RIGHT
    x ^= x >> np.uint64(32)
    return x


class Runs:
    """Digests of runs of consecutive words, each from two runs of a power of two words that cover it."""

    def __init__(self, digests: np.ndarray):
        self.levels = [digests]

    def _level(self, k: int) -> np.ndarray:
        """Digests of all runs of 2**k words."""
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            n = max(0, len(last) - half)
            self.levels.append(_pair(last[:n], last[half : half + n]))
        return self.levels[k]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of words start..end-1, at least one."""
        size = end - start
        out = np.zeros(len(size), np.uint64)
        level = np.frexp(size)[1] - 1
        for k in np.unique(level):
            mine = np.flatnonzero(level == k)
            runs, a, b = self._level(int(k)), start[mine], end[mine]
            out[mine] = mix(_pair(runs[a], runs[b - (1 << int(k))]) + size[mine].astype(np.uint64))
        return out

    def every(self, length: int) -> np.ndarray:
        """Of all runs of ``length`` words, across text borders too."""
        k = length.bit_length() - 1
        n = max(0, len(self.levels[0]) - length + 1)
        runs, shift = self._level(k), length - (1 << k)
        return mix(_pair(runs[:n], runs[shift : shift + n]) + np.uint64(length))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned digests as Spark's long."""
    return x.view(np.int64)


def binary_column(rows: np.ndarray) -> pa.Array:
    """Equal rows of numbers as a column of byte strings."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.dtype.itemsize * rows.shape[1]
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int64) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(rows.tobytes())])
