"""Token counts by a compiled transducer whose chunk maps compose through a prefix scan.

The transducer reads the bytes of one pre-token.  Its state is the longest suffix that may still
grow into a vocabulary token, with the settled last token and relative count at each of that
suffix's positions; a transition says how the number of emitted tokens changes.  States are
compiled when first reached and kept in a bounded table.

White space returns the machine to its start state from anywhere.  So the map of a chunk of text,
from entry state to (exit state, emitted tokens), is constant after its first white space and is
held as ``(head, tokens, tail)``: the text before the first and after the last white space still
depends on the neighbours.  Such maps compose associatively.  Short texts are one chunk and counted
where they are; the chunks of long ones are dealt to all tasks, and a prefix scan composes their maps.
Chunks are cut behind white space where there is some, so that heads and tails stay short.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignlake.llm.bpe import Merges, byte_letters, read_json
from alignlake.llm.common import small_batches

#: Code points of a chunk; longer texts are counted chunk by chunk.
CHUNK = 1 << 14
WORDS = regex.compile(r"\P{White_Space}+")
STATES = 150_000
#: Longest word and piece that a worker remembers.
LONG = 256


class CountTransducer:
    def __init__(self, path: str):
        vocab, ranks, spec = read_json(path)
        self.end = spec["model"]["end_of_word_suffix"]
        self.vocab = vocab
        self.letters = byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"] and not t["normalized"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.merges = Merges(lambda a, b: ranks.get((a, b)), self._symbols)
        self.growing = {t[:i] for t in (v.removesuffix(self.end) for v in vocab) for i in range(1, len(t))}
        self.growing |= {t.removesuffix(self.end) for t in vocab if t.endswith(self.end)}
        self._reset()
        self.known: dict[str, int] = {}
        self.counts: dict[str, int] = {}

    def _reset(self) -> None:
        start = ("", ((None, 0),))
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]
        self.ends: list[dict[int, int]] = [{}]

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end) if token != self.end else token
        return [*body] if body == token else [*body[:-1], body[-1] + self.end]

    def _settle(self, state: tuple, letter: str, end: str) -> tuple[str, str, int]:
        """(unsettled text, its last token, relative count) after one more byte."""
        held, marks = state
        text = held + letter
        for size in range(len(text), 0, -1):
            token = text[-size:] + end
            if token not in self.vocab:
                continue
            before, count = marks[len(text) - size]
            if self.merges.reachable(token) if before is None else self.merges.follows(before, token):
                return text, token, count + 1
        raise ValueError(f"no token ends at {text!r}")

    def _compile(self, at: int, byte: int) -> tuple[int, int]:
        text, token, count = self._settle(self.states[at], self.letters[byte], "")
        marks = (*self.states[at][1], (token, count))
        held = next((text[i:] for i in range(len(text)) if text[i:] in self.growing), "")
        state = (held, tuple((t, c - count) for t, c in marks[len(marks) - len(held) - 1 :]))
        if (to := self.number.get(state)) is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.ends.append({})
        got = self.steps[at][byte] = (to, count)
        return got

    def piece(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.states) > STATES:
            self._reset()
        at = total = 0
        for byte in data[:-1]:
            step = self.steps[at].get(byte) or self._compile(at, byte)
            at = step[0]
            total += step[1]
        last = self.ends[at].get(data[-1])
        if last is None:
            last = self.ends[at][data[-1]] = self._settle(self.states[at], self.letters[data[-1]], self.end)[2]
        return total + last

    def word(self, word: str) -> int:
        """Tokens of a stretch without white space; only short ones are remembered."""
        if len(word) > LONG:
            return sum(1 if p in self.special else self._plain(p) for p in (self.cut.split(word) if self.cut else [word]) if p)
        got = self.known.get(word)
        if got is None:
            if any(s in word for s in self.special):
                got = sum(1 if p in self.special else self._plain(p) for p in self.cut.split(word) if p)
            else:
                got = self._plain(word)
            if len(self.known) > 2 * STATES:
                self.known.clear()
            self.known[word] = got
        return got

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        pieces = [text] if text.isalpha() else [text[:-1], text[-1]] if text[:-1].isalpha() and text[-1] in ",." else self.pieces.findall(text)
        counts = self.counts
        return sum([counts[p] if p in counts else self._count(p) if len(p) <= LONG else self.piece(p.encode()) for p in pieces])

    def _count(self, piece: str) -> int:
        if len(self.counts) > 2 * STATES:
            self.counts.clear()
        got = self.counts[piece] = self.piece(piece.encode())
        return got

    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        """(head, tokens between, tail); tokens is None where the chunk has no white space."""
        words = WORDS.findall(text)
        spaced = not words or len(words) > 1 or len(words[0]) < len(text)
        if not text or not spaced:
            return text, None, ""
        head = words.pop(0) if words and text.startswith(words[0]) else ""
        tail = words.pop() if words and text.endswith(words[-1]) else ""
        known = self.known
        return head, sum(known[w] if w in known else self.word(w) for w in words), tail

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of a chunk followed by another."""
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + b[1] + self.word(a[2] + b[0]), b[2]

    def total(self, m: tuple) -> int:
        """Tokens of a whole text from its map: it enters and leaves at a word's border."""
        return self.word(m[0]) + (m[1] or 0) + self.word(m[2])


def prefix_scan(items: list, combine) -> list:
    """Inclusive scan by pairing up: logarithmic depth, every combination of neighbours independent."""
    if len(items) < 2:
        return list(items)
    pairs = prefix_scan([combine(a, b) for a, b in zip(items[::2], items[1::2])], combine)
    return [items[0]] + [pairs[i // 2] if i % 2 else combine(pairs[i // 2 - 1], items[i]) for i in range(1, len(items))]


@lru_cache(maxsize=2)
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def slices(text: str, chunk: int) -> Iterator[str]:
    """``text`` in pieces of about ``chunk`` code points, cut behind white space if the piece has some."""
    at = 0
    while at < len(text):
        end = min(len(text), at + chunk)
        if end < len(text):
            space = next((i for i in range(end, max(at, end - 4096), -1) if text[i - 1].isspace()), end)
            end = space
        yield text[at:end]
        at = end


def _text(data: bytes | None) -> str:
    return (data or b"").decode("utf-8", "replace")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, n_tokens, over_limit)``, one row for each input row.

    A null text counts as empty (no bytes, no tokens); bytes that aren't UTF-8 count as U+FFFD.  Texts of more
    than ``chunk`` code points are counted chunk by chunk, the chunks of one text by many tasks; repeated rows
    are counted apart; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    long = F.octet_length("text") > 4 * chunk  # so its code points may be too many; null texts are short

    def short(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for part in parts:
            texts = part.column(1).to_pylist()
            counts = [machine.total(machine.chunk_map(_text(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for i, piece in enumerate(slices(_text(text), chunk)):
                    columns = ([row], [doc], [len(text)], [i], [piece])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["row", "doc_id", "n_bytes", "chunk", "body"])

    def maps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for part in parts:
            m = [machine.chunk_map(t) for t in part.column(4).to_pylist()]
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array([x[i] for x in m], t) for i, t in enumerate(kinds))], names=["row", "doc_id", "n_bytes", "chunk", "head", "tokens", "tail"])

    def totals(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for part in parts:
            counts = []
            for chunks in part.column(2).to_pylist():
                scan = prefix_scan([(c["head"], c["tokens"], c["tail"]) for c in chunks], machine.compose)
                counts.append(machine.total(scan[-1]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = "doc_id long, n_bytes long, n_tokens long"
    numbered = rows.where(long).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    pieces = numbered.mapInArrow(cut, "row long, doc_id long, n_bytes long, chunk int, body string").repartition("row", "chunk")
    chunks = pieces.mapInArrow(maps, "row long, doc_id long, n_bytes long, chunk int, head string, tokens long, tail string")
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "head", "tokens", "tail"))).alias("maps")  # one small record a chunk
    texts = chunks.groupBy("row", "doc_id", "n_bytes").agg(ordered)
    counted = texts.select("doc_id", "n_bytes", "maps").mapInArrow(totals, out)
    rest = rows.where(~F.coalesce(long, F.lit(False))).select(F.col("doc_id").cast("long"), "text").mapInArrow(short, out)
    return rest.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)
