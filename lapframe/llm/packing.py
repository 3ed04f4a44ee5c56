"""Arrays packed into one compressed value: few rows to shuffle instead of one per element."""

from __future__ import annotations

import numpy as np
import zstandard


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes before all second ones: the high bytes of small numbers are then one run of zeros."""
    size = a.itemsize
    if size == 1:
        return a.tobytes()
    whole = np.ascontiguousarray(a).view(f"u{size}")
    return b"".join((whole >> whole.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(size))


def pack(arrays: list[np.ndarray], level: int = 3) -> bytes:
    """Element counts, then the arrays' bytes, compressed."""
    head = np.array([len(a) for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=level).compress(head.tobytes() + b"".join(_planes(a) for a in arrays))


def unpack(blob: bytes, dtypes: list[type]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(dtypes), []
    for n, dtype in zip(np.frombuffer(raw, np.int64, len(dtypes)).tolist(), dtypes, strict=True):
        size = np.dtype(dtype).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at)
        whole = planes[:n].astype(f"u{size}")
        for k in range(1, size):
            part = planes[k * n : (k + 1) * n]
            if part.any():
                whole |= part.astype(whole.dtype) << whole.dtype.type(8 * k)
        out.append(whole.view(dtype))
        at += n * size
    return out


def unpack_all(blobs: list[bytes], dtypes: list[type]) -> list[np.ndarray]:
    """The arrays of several values, each concatenated over the values."""
    parts = [unpack(b, dtypes) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, d) for k, d in enumerate(dtypes)]


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours; small where numbers that rise slowly are packed. :func:`walk` is the inverse, for each of several parts."""
    return np.diff(a, prepend=a.dtype.type(0))


def walk(a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(a)
    ends = np.cumsum(sizes)
    before = np.r_[a.dtype.type(0), total[ends[:-1] - 1]] if len(ends) else total[:0]
    return total - np.repeat(before, sizes)


def order_of(key: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned integers, equal ones as they stand."""
    return ordered(key)[0]


def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts unsigned integers, equal ones as they stand, and the sorted ones: one sort of numbers that hold both the key's first bits and the place.

    Where the first bits leave neighbours undecided and in the wrong order, these alone are sorted again.
    """
    n = len(key)
    if n < 2:
        return np.arange(n), key
    room = np.uint64((n - 1).bit_length())
    drop = np.uint64(max(0, int(key.max()).bit_length() + int(room) - 64))
    both = key.astype(np.uint64)
    if drop:
        both >>= drop
    both <<= room
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << room) - np.uint64(1))).view(np.int64)
    both >>= room
    if not drop:
        return order, both.astype(key.dtype, copy=False)
    found = key[order]
    falls = np.flatnonzero(found[1:] < found[:-1])
    if len(falls):
        opens = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        group = np.searchsorted(opens, falls, side="right") - 1
        group = group[np.r_[True, group[1:] != group[:-1]]]
        size = np.diff(np.r_[opens, n])[group]
        at = np.arange(int(size.sum())) + np.repeat(opens[group] - (np.cumsum(size) - size), size)
        again = at[np.argsort(found[at], kind="stable")]
        order[at], found[at] = order[again], found[again]
    return order, found


def split_points(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and the bounds of their runs."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, np.int64)
    return sorted_keys[starts], np.r_[starts, len(sorted_keys)]


def gather_runs(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs source[start : start + length], one after the other."""
    if not len(starts):
        return source[:0]
    ends = np.cumsum(lengths)
    index = np.arange(int(ends[-1]), dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return source[index]
