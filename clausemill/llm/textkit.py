"""Vectorised word, shingle and min-max signature kernels over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; all of these are
ASCII, so the split is the same on UTF-8 bytes and on code points.  Hashes are 64
bits wide and do not depend on the process, the batch or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, salt: int) -> np.ndarray:
    """n odd, fixed pseudo-random 64-bit multipliers."""
    with np.errstate(over="ignore"):
        seeds = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE) + np.uint64(salt)
        return mix64(seeds) | np.uint64(1)


_MULT = constants(SHINGLE, 0x51)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SEGMENT, 1 << int(n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            np.cumprod(t, out=t)
            tables.append(t)
        if size > _SEGMENT:  # a giant word: use once, keep no memory
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    buffers = column.buffers()
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and each document's n+1 word offsets."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:] - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; by prefix sums of a polynomial, a segment at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SEGMENT, "right")))
            lo, hi = int(starts[at]), int(ends[to - 1])
            power, inverse = _power_tables(hi - lo)
            part = data[lo:hi]
            part = (_LOWER[part] if lower else part).astype(np.uint64)
            part += np.uint64(1)
            part *= power[: hi - lo]
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(part, out=total[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            h = (total[e] - total[s]) * inverse[s]
            out[at:to] = mix64(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            at = to
    return out


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents, and their n+1 offsets.

    A document with fewer than k words has one shingle, its whole sequence; one
    without words has none.  Repeats are kept.
    """
    counts = np.diff(bounds)
    mult = _MULT if k == SHINGLE else constants(k, 0x51)
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(n_out, out=out_bounds[1:])
    with np.errstate(over="ignore"):
        if len(words) >= k:
            full = len(words) - k + 1
            acc = words[:full] * mult[0]
            for j in range(1, k):
                acc += words[j : j + full] * mult[j]
        else:
            acc = np.empty(0, np.uint64)
        keep = np.zeros(len(acc), np.int8)
        long_ = counts >= k
        np.add.at(keep, bounds[:-1][long_], 1)
        stop = bounds[1:][long_] - k + 1
        np.add.at(keep, stop[stop < len(keep)], -1)
        inside = np.cumsum(keep, dtype=np.int64) > 0
        out = np.empty(int(out_bounds[-1]), np.uint64)
        short = np.flatnonzero((counts > 0) & ~long_)
        is_short = np.zeros(len(out), bool)
        is_short[out_bounds[short]] = True
        out[~is_short] = acc[inside]
        if len(short):
            value = counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
            for j in range(k - 1):
                has = counts[short] > j
                value[has] += words[bounds[short[has]] + j] * mult[j]
            out[out_bounds[short]] = value
        return mix64(out), out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's values sorted and without repeats."""
    parts, sizes = [], np.zeros(len(bounds), np.int64)
    for i in range(len(bounds) - 1):
        part = np.sort(values[bounds[i] : bounds[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        sizes[i + 1] = len(part)
        parts.append(part)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(sizes)


def set_sums(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify each set; 0 for an empty one."""
    n = len(bounds) - 1
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        with np.errstate(over="ignore"):
            one[full] = np.add.reduceat(mix64(values ^ np.uint64(0x1234567)), bounds[full])
            two[full] = np.add.reduceat(mix64(values + np.uint64(0xC2B2AE3D27D4EB4F)), bounds[full])
    return one, two


def minmax_bands(values: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (sets x bands) of min-max signatures, and a byte of each signature value
    (sets x bands * rows); every set must be non-empty.

    Each multiplier permutes the 64-bit hashes once and gives two signature
    values, the least and the greatest, so bands * rows values take half as many
    permutations.  A band's value mixes its rows and its number.
    """
    half = (bands * rows + 1) // 2
    n = len(bounds) - 1
    signature = np.empty((2 * half, n), np.uint64)
    with np.errstate(over="ignore"):
        scratch = np.empty(min(len(values), 1 << 16), np.uint64)
        # whole documents at a time, so that the scratch stays in the cache
        at = 0
        mult, add = constants(half, 0x77), constants(half, 0x99)
        while at < n:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + len(scratch), "right")) - 1)
            part, cut = values[bounds[at] : bounds[to]], bounds[at:to] - bounds[at]
            for p in range(half):
                h = part * mult[p]
                h += add[p]
                h ^= h >> np.uint64(32)
                signature[2 * p, at:to] = np.minimum.reduceat(h, cut)
                signature[2 * p + 1, at:to] = np.maximum.reduceat(h, cut)
            at = to
        q = constants(rows, 0xAB)
        out = np.empty((n, bands), np.uint64)
        for b in range(bands):
            acc = np.full(n, b + 1, np.uint64) * np.uint64(0x9FB21C651E98DF25)
            for r in range(rows):
                acc = mix64(acc + signature[b * rows + r] * q[r])
            out[:, b] = acc
    return out, (mix64(signature[: bands * rows]) >> np.uint64(56)).astype(np.uint8).T


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of a piece stays near most_bytes; a longer text goes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
