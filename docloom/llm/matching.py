"""Numpy helpers of the substring operators: content-chosen anchors and window hashes over documents laid end to end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _B
    return h ^ (h >> np.uint64(29))


def gram_hashes(symbols: np.ndarray, n: int, room: np.ndarray) -> np.ndarray:
    """Hash of the n symbols from each place; MAX where fewer than n are left in the document.

    room: symbols left in the document from each place on. By doubling, so a few passes suffice.
    """
    part = mixed(symbols * _A + _B)
    out, done, size = None, 0, 1
    while size <= n:
        if n & size:
            ahead = part[done:]
            out = ahead if out is None else mixed(out[: len(ahead)] * _A + ahead)
            done += size
        size *= 2
        if size <= n:
            part = mixed(part[: max(0, len(part) - size // 2)] * _A + part[size // 2 :])
    full = np.full(len(symbols), MAX, dtype=np.uint64)
    full[: len(out)] = np.minimum(out, MAX - np.uint64(1))
    full[room < n] = MAX
    return full


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick over x[i : i + w] for each i with a whole window."""
    size, cur = 1, x
    while size * 2 <= w:
        cur = pick(cur[: len(cur) - size], cur[size:])
        size *= 2
    return pick(cur[: len(cur) - (w - size)], cur[w - size :]) if w > size else cur


def least_of(h: np.ndarray, w: int) -> np.ndarray:
    """The least hash among the w grams from each place; MAX where fewer than w follow."""
    least = np.full(len(h), MAX, dtype=np.uint64)
    if len(h) >= w:
        least[: len(h) - w + 1] = _sliding(h, w, np.minimum)
    return least


def minimizers(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash among the w grams from each place (MAX where the window is cut), and which places hold one."""
    least = least_of(h, w)
    usable = least.copy()
    usable[least == MAX] = 0
    before = np.concatenate([np.zeros(w - 1, dtype=np.uint64), usable])
    most = _sliding(before, w, np.maximum)
    return least, (most == h) & (h != MAX)


def at_most_two(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of places sorted by hash (order), the first two of each hash."""
    s = hashes[order]
    keep = np.ones(len(s), dtype=bool)
    keep[2:] = s[2:] != s[:-2]
    return order[keep]


def dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) by hash."""
    bucket = (mixed(hashes) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Binary values laid end to end as one array."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=kind)


def found_in(values: np.ndarray, sorted_hashes: np.ndarray) -> np.ndarray:
    """Index of each value in sorted_hashes, -1 where it isn't there."""
    if not len(sorted_hashes):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, values), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == values, at, -1)


def spread(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of size places lie in one of the intervals."""
    d = np.zeros(size + 1, dtype=np.int32)
    np.add.at(d, np.minimum(starts, size), 1)
    np.add.at(d, np.minimum(ends, size), -1)
    return np.cumsum(d[:-1]) > 0
