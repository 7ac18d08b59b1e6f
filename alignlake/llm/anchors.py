"""Window anchors: a compact, exact stand-in for "every window of W symbols".

A window of ``W`` consecutive symbols (bytes or words) holds ``W - q + 1`` q-grams.  Its anchor
is the leftmost q-gram of smallest priority, so equal windows have equal anchors at equal places.
Neighbouring windows mostly share an anchor, so the windows of a text fall into a few *runs*
(about two for every ``W - q + 2`` symbols).  Two windows can only be equal if their runs' anchors
are equal: an anchor that occurs once proves every window of its run unique.

Only numpy helpers for one text live here; all exchange between texts is done by Spark.
"""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_M3 = np.uint64(0xBF58476D1CE4E5B9)
_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)
#: Longest stretch of windows handled at once; longer texts go in overlapping stretches.
MAX_STRETCH = 1 << 22


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of the pair (bucket of a position, bucket of a later position)."""
    x = a * _M1 + ((b ^ (b >> np.uint64(29))) * _M2)
    x ^= x >> np.uint64(32)
    x *= _M3
    x ^= x >> np.uint64(29)
    return x


def byte_buckets(data: bytes) -> np.ndarray:
    """The 8-byte string at every offset, as its own bucket identifier."""
    n = len(data) - 7
    if n <= 0:
        return np.empty(0, np.uint64)
    return np.ndarray((n,), "<u8", data, strides=(1,)).astype(np.uint64)


def refine(buckets: np.ndarray, offset: int) -> np.ndarray:
    """Refine each position's bucket by the bucket of the position ``offset`` further on."""
    n = len(buckets) - offset
    return combine(buckets[:n], buckets[offset:]) if n > 0 else np.empty(0, np.uint64)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, have = v, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(grams: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split a text's windows into runs of one anchor.

    grams: identifier of the q-gram at each offset.  per_window: grams in a window.
    Returns (anchor offset, first window, number of windows) of each run, in order.
    """
    n = len(grams) - per_window + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e, e
    parts = []
    for s in range(0, n, MAX_STRETCH):
        m = min(MAX_STRETCH, n - s)
        g = grams[s : s + m + per_window - 1]
        keyed = (combine(g, g) & ~_POS_MASK) | np.arange(len(g), dtype=np.uint64)
        at = (sliding_min(keyed, per_window) & _POS_MASK).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        lo = np.concatenate(([0], cut))
        parts.append((at[lo] + s, lo + s, np.diff(np.concatenate((lo, [m])))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
