"""Byte-level BPE encoding and decoding by prefix tables.

For every byte prefix of a piece exactly one token can be its encoding's last.  A ``PrefixTable``
stores that token for each prefix: the encoding is read off backwards, bytes are appended exactly
by extending the table, and an edit re-encodes only what follows it.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from alignlake.llm.bpe import Merges, read_ranks
from alignlake.llm.common import map_texts

#: Texts without these characters are split by ``re``, whose classes agree with the pattern's on the others.
UNUSUAL = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0500-\u200f\u2028-\u202f\u205f-\U0010ffff]")
#: Pieces, and prefixes of pieces, that a worker keeps.
PIECES = 400_000
PREFIXES = 600_000
#: Longest piece whose prefixes are shared with other pieces.
SHARED = 48


class PrefixTable:
    """The unique valid last token of every prefix of ``data``."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", []
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        rules, ranks, growing = self.codec.rules, self.codec.ranks, self.codec.growing
        done, data, last = len(self.data), self.data + more, self.last
        open_at = [s for s in range(max(0, done - self.codec.longest), done) if data[s:done] in growing]
        for end in range(done + 1, len(data) + 1):
            open_at.append(end - 1)
            for start in open_at:
                token = data[start:end]
                if token in ranks and (rules.follows(last[start - 1], token) if start else rules.reachable(token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")
            open_at = [s for s in open_at if data[s:end] in growing]
        self.data = data
        return self

    def edit(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Replace ``data[start:end]``; prefixes before ``start`` keep their tokens."""
        rest = new + self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        return self.append(rest)

    def tokens(self) -> list[bytes]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(out[-1])
        return out[::-1]


class Codec:
    """Ranks and the pattern whose matches are encoded separately."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.growing = {t[:i] for t in self.ranks for i in range(1, len(t))}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.rules = Merges(lambda a, b: self.ranks.get(a + b), lambda t: [t[i : i + 1] for i in range(len(t))])
        plain = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.pattern = regex.compile(plain)
        usual = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\w\s]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.usual = re.compile(usual) if r"\p" not in usual else None
        self.known: dict[str, bytes] = {}
        self.prefixes: dict[bytes, bytes] = {}

    def shared_tokens(self, data: bytes) -> list[bytes]:
        """As ``PrefixTable(self, data).tokens()``, with one table of prefixes for all pieces."""
        last, ranks, follows = self.prefixes, self.ranks, self.rules.follows
        done = len(data)
        while done and data[:done] not in last:
            done -= 1
        for end in range(done + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = data[start:end]
                if token in ranks and (follows(last[data[:start]], token) if start else self.rules.reachable(token)):
                    last[data[:end]] = token
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")
        out, at = [], len(data)
        while at:
            out.append(last[data[:at]])
            at -= len(out[-1])
        return out[::-1]

    def piece(self, text: str) -> bytes:
        """Ids of one match as little-endian 32-bit integers; a match that is a token is that token."""
        data = text.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            ids = [whole]
        elif len(data) <= SHARED:
            ids = [self.ranks[t] for t in self.shared_tokens(data)]
        else:
            ids = [self.ranks[t] for t in PrefixTable(self, data).tokens()]
        if len(self.known) > PIECES:
            self.known.clear()
        if len(self.prefixes) > PREFIXES:
            self.prefixes.clear()
        got = self.known[text] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def encode(self, text: str) -> bytes:
        known = self.known
        pattern = self.pattern if self.usual is None or UNUSUAL.search(text) else self.usual
        return b"".join([known[p] if p in known else self.piece(p) for p in pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_ids(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids array<int>)``; a null text gives no ids, bytes that aren't UTF-8 count as U+FFFD."""

    def each(keys: list, texts: list) -> dict[str, list]:
        c = codec(ranks, pattern)
        return {"doc_id": keys, "ids": [np.frombuffer(c.encode((t or b"").decode("utf-8", "replace")), "<i4").tolist() for t in texts]}

    return map_texts(docs, each, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids again and digest both.

    One row for each input row: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.  Null and empty
    texts have no tokens and the digests of nothing; bytes that aren't UTF-8 count as U+FFFD; repeated
    rows give repeated rows; an empty table gives none.
    """

    def each(keys: list, texts: list) -> dict[str, list]:
        c = codec(ranks, pattern)
        ids = [c.encode((t or b"").decode("utf-8", "replace")) for t in texts]
        return {
            "doc_id": keys,
            "n_tokens": [len(i) // 4 for i in ids],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(c.decode(i)).hexdigest() for i in ids],
        }

    return map_texts(docs, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
