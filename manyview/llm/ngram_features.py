"""Hashed word and character n-grams of many texts, and sums of their weights.

A model that averages over a text's features and is linear in the average needs one
weight for each bucket: sums of weights over all positions come from a running sum,
however long the texts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from manyview.llm.word_arrays import LOWER, Chunk, chunks, mix, word_digests, words

_odd = np.random.default_rng(11).integers(0, 1 << 32, 16, dtype=np.uint32) | np.uint32(1)
#: Bytes of the texts whose buckets are in memory at once: some 40 bytes for each of theirs.
PART_BYTES = 1 << 18
#: An odd factor that tells the first word of a pair from the second.
PAIR = np.uint64(0x9E3779B97F4A7C15)


def code_points(chunk: Chunk, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts of a chunk as numbers, and where each text's begin; the last entry is their end."""
    data = LOWER[chunk.data] if lower else chunk.data
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(np.uint32)
    long = (first >= 0xC0).astype(np.uint32) + (first >= 0xE0) + (first >= 0xF0)
    points = first & np.array([0x7F, 0x1F, 0x0F, 0x07], np.uint32)[long]
    for k in (1, 2, 3):
        more = np.flatnonzero(long >= k)
        points[more] = points[more] << np.uint32(6) | data[np.minimum(at[more] + k, len(data) - 1)] & np.uint32(0x3F)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return points, before[chunk.offsets]


def bucket_lists(
    chunk: Chunk, orders: tuple[int, ...], bits: int, lower: bool, pairs: bool
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, pairs of neighbouring words in their order if ``pairs`` says so, then
    each order of n-grams of characters: buckets in text order, and where each text's
    begin and end."""
    shift = np.uint64(64 - bits)
    w = words(chunk)
    digests = word_digests(chunk, w, lower=lower)
    out = [((digests >> shift).astype(np.int64), w.offsets[:-1], w.offsets[1:])]
    if pairs:
        both = mix(digests[:-1] * PAIR + digests[1:])
        begin = np.minimum(w.offsets[:-1], len(both))
        out.append(((both >> shift).astype(np.int64), begin, np.clip(w.offsets[1:] - 1, begin, len(both))))
    data, off = code_points(chunk, lower)
    data += np.uint32(1)
    for order in orders:
        n = len(data) - order + 1
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros_like(off[:-1]), np.zeros_like(off[:-1])))
            continue
        h = np.full(n, np.uint32(order) * _odd[15])
        for i in range(order):
            h *= _odd[i]
            h ^= h >> np.uint32(15)
            h += data[i : i + n]
        h *= _odd[14]
        h ^= h >> np.uint32(16)
        h *= _odd[13]
        begin = np.minimum(off[:-1], n)
        out.append(((h >> np.uint32(32 - bits)).astype(np.int64), begin, np.clip(off[1:] - order + 1, begin, n)))
    return out


def averages(
    texts: pa.Array, weights: np.ndarray, orders: tuple[int, ...], bits: int, lower: bool, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the mean weights of its features (rows of ``weights`` by bucket), and how many it has."""
    parts, counts = [np.zeros((0, weights.shape[1]))], [np.zeros(0, np.int64)]
    for chunk in chunks(texts, PART_BYTES):
        total = np.zeros((len(chunk.offsets) - 1, weights.shape[1]))
        count = np.zeros(len(chunk.offsets) - 1, np.int64)
        for bucket, begin, end in bucket_lists(chunk, orders, bits, lower, pairs):
            count += end - begin
            for c in range(weights.shape[1]):
                run = np.zeros(len(bucket) + 1)
                np.cumsum(weights[bucket, c] if weights.shape[1] > 1 else weights[:, 0][bucket], dtype=np.float64, out=run[1:])
                total[:, c] += run[end] - run[begin]
        parts.append(total / np.maximum(count, 1)[:, None])
        counts.append(count)
    return np.concatenate(parts), np.concatenate(counts)


def sparse_rows(texts: list[str], orders: tuple[int, ...], bits: int, lower: bool, pairs: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its buckets, and their shares of all its features."""
    out = []
    for chunk in chunks(pa.array(texts, pa.large_string())):
        lists = bucket_lists(chunk, orders, bits, lower, pairs)
        for i in range(len(chunk.offsets) - 1):
            every = np.concatenate([bucket[begin[i] : end[i]] for bucket, begin, end in lists])
            bucket, count = np.unique(every, return_counts=True)
            out.append((bucket, count / max(1, len(every))))
    return out
