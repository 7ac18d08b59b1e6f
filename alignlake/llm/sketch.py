"""Fast similarity sketches of sets of 64-bit hashes.

A sketch has a number of places.  In each of as many first rounds every element is hashed to a
place and a value; in each of as many further rounds all elements go to one fixed place, the round's own, so every
place is filled at last.  A place keeps its least (round, value), so rounds after the one that fills the last place
change nothing and are left out: a set much larger than the sketch needs a round or two.  Two sets agree at a place
with probability equal to their Jaccard similarity, and the share of places that agree is as concentrated as that of
independent minima.
"""

from __future__ import annotations

import numpy as np

from alignlake.llm.anchors import combine

#: Places of a band and bands; a pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS.
ROWS, BANDS = 8, 44
COORDINATES = ROWS * BANDS
#: The same for lower similarities: least percent, places of a band, bands; a pair at the bound is missed once in a million times.
SHAPES = ((85, ROWS, BANDS), (80, 7, 58), (70, 5, 76), (0, 2, 100))
#: Elements times rounds that are hashed at once.
_STEP = 1 << 12
_ROUND = np.random.default_rng(42).integers(0, 1 << 63, 1 << 10, dtype=np.uint64)
_HALF = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)
_EMPTY = np.iinfo(np.uint64).max


def sketch(found: np.ndarray, places: int = COORDINATES) -> np.ndarray:
    """The least (round, value) of each place, as ``round << 32 | value``; all ones for an empty set."""
    least = np.full(places, _EMPTY, np.uint64)
    if not len(found):
        return least
    done, open_ = 0, places
    while open_ and done < places:
        rounds = np.arange(done, min(places, done + max(1, _STEP // len(found))), dtype=np.uint64)
        h = combine(found[None, :], _ROUND[rounds.astype(np.int64)][:, None])
        place = (((h & _LOW) * np.uint64(places)) >> _HALF).astype(np.int64)
        np.minimum.at(least, place.ravel(), ((rounds[:, None] << _HALF) | (h >> _HALF)).ravel())
        done += len(rounds)
        open_ = int(np.count_nonzero(least == _EMPTY))
    if open_:  # the rounds of fixed places, of which only those that are still empty can tell
        left = np.flatnonzero(least == _EMPTY)
        for part in np.array_split(left, -(-len(left) * len(found) // (8 * _STEP))):
            h = combine(found[None, :], _ROUND[places + part][:, None])
            least[part] = (np.uint64(places) + part.astype(np.uint64) << _HALF) | (h >> _HALF).min(1)
    return least


def shape(percent: int) -> tuple[int, int]:
    """(places of a band, bands) for links of ``percent`` hundredths of similarity or more."""
    return next((rows, bands) for least, rows, bands in SHAPES if percent >= least)


def bands(found: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> list[int]:
    """One signed 64-bit key for each band, from its number and its places; none for an empty set."""
    if not len(found):
        return []
    key = np.arange(bands, dtype=np.uint64)
    for column in sketch(found, rows * bands).reshape(bands, rows).T:
        key = combine(key, column)
    return key.view(np.int64).tolist()
