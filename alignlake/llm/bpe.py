"""Merge rules of byte-pair encodings, and which tokens may follow each other.

A sequence of tokens is an encoding exactly if every neighbouring pair encodes to itself, and
the encoding of a prefix is a prefix of encodings once its last token is settled.  Both the
counting transducer and the prefix tables rest on this.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

#: Entries kept in a worker's memo tables before they are emptied.
MEMO = 400_000
INFINITE = float("inf")


class Merges:
    """``rank(a, b)`` gives the priority of merging two neighbouring symbols, or None."""

    def __init__(self, rank: Callable, split: Callable):
        self.rank, self.split = rank, split
        self._pairs: dict = {}
        self._trees: dict = {}

    def merge(self, parts: list) -> tuple[list, dict]:
        """Merge the pair of lowest rank, leftmost first, until none is left; also how each symbol arose."""
        parts, made = list(parts), {}
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            made[parts[at] + parts[at + 1]] = (best, parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, made

    def tree(self, token) -> tuple[list, list] | None:
        """The symbols at a token's left and right border as merging goes on, each with the rank that ends it.

        None for a token that merging its own symbols doesn't give.
        """
        if token in self._trees:
            return self._trees[token]
        parts, made = self.merge(self.split(token))
        got = None
        if parts == [token]:
            got = []
            for side in (1, 2):
                border, until, now = [], INFINITE, token
                while True:
                    border.append((now, until))
                    if now not in made:
                        break
                    until, now = made[now][0], made[now][side]
                got.append(border[::-1])
            got = tuple(got)
        self._trees[token] = got
        return got

    def reachable(self, token) -> bool:
        """Whether merging a token's own symbols gives the token."""
        return self.tree(token) is not None

    def follows(self, left, right) -> bool:
        """Whether ``left`` then ``right`` is the encoding of their text.

        It is unless the symbols that meet at the border merge before either of them has become
        part of a larger symbol of its own token; of two equal ranks the left merge comes first.
        """
        key = (left, right)
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) > MEMO:
                self._pairs.clear()
            got = self._pairs[key] = self._stay_apart(self.tree(left), self.tree(right))
        return got

    def _stay_apart(self, left: tuple | None, right: tuple | None) -> bool:
        if left is None or right is None:
            return False
        a, b, i, j = left[1], right[0], 0, 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            r = self.rank(x, y)
            if r is not None and r < x_until and r <= y_until:
                return False
            if x_until is INFINITE and y_until is INFINITE:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies written as text."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_json(path: str) -> tuple[dict[str, int], dict[tuple[str, str], int], dict]:
    """(token ids, merge ranks, the whole file) of a ``.json`` tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = spec["model"]["merges"]
    ranks = {tuple(p) if not isinstance(p, str) else tuple(p.split(" ")): i for i, p in enumerate(pairs)}
    return spec["model"]["vocab"], ranks, spec


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
