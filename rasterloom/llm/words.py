"""Vectorised word and shingle hashes over the buffers of Arrow string columns.

Words are the maximal runs of bytes other than space, tab, LF, VT, FF and CR.
All hashes are 64-bit, keyed by fixed random tables; two different words or
shingles of one corpus share a hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once; a longer row is worked on alone.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_POS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, text bytes, offsets) of pieces of ``batch``; null texts are empty."""
    texts = pc.fill_null(batch.column(column), "")
    texts = texts if pa.types.is_large_string(texts.type) else texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        a, b = int(offsets[first]), int(offsets[last])
        yield batch.slice(first, last - first), data[a:b], offsets[first : last + 1] - a
        first = last


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and words before each row's end (length rows + 1)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    previous = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    begins = inside & (~previous | edge[:-1])
    following = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = inside & (~following | edge[1:])
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the words before each row's end (length rows + 1)."""
    starts, stops, upto = spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), upto
    lengths = stops - starts
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    kept = data[~_SPACE[data]]
    place = np.arange(len(kept), dtype=np.int64) - np.repeat(at, lengths)
    # A byte's weight depends on its place: 64 odd numbers, times a step for each full 64.
    weight = _POS[place & 63]
    if len(place) and place.max() >= 64:
        far = place >= 64
        weight[far] *= mix((place[far] >> 6).astype(np.uint64)) | np.uint64(1)
    values = (_BYTE_LOWER if lower else _BYTE)[kept] * weight
    values ^= values >> np.uint64(29)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(values, at)
    return mix(sums + lengths.astype(np.uint64) * _STEP[0]), upto


def windows(words: np.ndarray, upto: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within rows, the word index of each run's start, and runs before each row's end."""
    n = len(words) - k + 1
    counts = np.maximum(np.diff(upto) - k + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0 or not ends[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), ends
    h = words[:n] * _STEP[1]
    for j in range(1, k):
        h = h + words[j : j + n] * _STEP[1 + j]
    starts = np.arange(ends[-1]) - np.repeat(ends[:-1], counts) + np.repeat(upto[:-1], counts)
    return mix(h[starts]), starts, ends


def pieces(words: np.ndarray, upto: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``windows``, but a row of fewer than k words (and at least one) has its whole sequence as one."""
    h, _, ends = windows(words, upto, k)
    lengths = np.diff(upto)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if not len(short):
        return h, ends
    whole = np.empty(len(short), np.uint64)
    for i, row in enumerate(short):
        part = words[upto[row] : upto[row + 1]]
        whole[i] = mix((part * _STEP[1 : 1 + len(part)]).sum(keepdims=True) + np.uint64(len(part)) * _STEP[40])[0]
    counts = np.diff(ends)
    counts[short] = 1
    new_ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(new_ends[-1], np.uint64)
    is_short = np.zeros(len(out), bool)
    is_short[new_ends[short]] = True
    out[is_short] = whole
    out[~is_short] = h
    return out, new_ends


def distinct_sorted(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in ascending order (as signed numbers), and values before each row's end."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    signed = h.view(np.int64)
    order = np.lexsort((signed, row))
    signed, row = signed[order], row[order]
    keep = np.ones(len(signed), bool)
    keep[1:] = (signed[1:] != signed[:-1]) | (row[1:] != row[:-1])
    signed, row = signed[keep], row[keep]
    return signed, np.searchsorted(row, np.arange(len(ends)))
