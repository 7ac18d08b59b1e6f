"""Quality classifier by co-training of a content view and a metadata view.

Two logistic regressions, one on the hashed words of a text, one on the page's metadata (language,
source, length) and layout, are fitted to labelled documents.  In each round both score a share of
all unlabelled documents, each share once; each view hands the documents it is surest of, of either
class, to the other as pseudo-labels, and both are fitted anew.  At last both are calibrated on
held-out labelled rows and combined, and every document is scored by the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignlake.llm.common import small_batches
from alignlake.scratch import drop, materialise

#: Slots of the content view: so many that the many words of a long text seldom share a slot with a telling one.
WIDTH = 1 << 20
META_WIDTH = 1 << 12
#: Labelled documents the classifiers are fitted to, at most: those of smallest doc_id hash.
LABELLED = 8000
ROUNDS = 2
#: Documents that a view hands over in a round at most, in the labelled rows' share of classes, and the calibrated confidence they need.
HANDED, SURE = 400, 0.95
#: Score above which a document is rejected.
THRESHOLD = 0.5
#: Bytes of a word's beginnings that make slots of their own.
STEMS = (4, 5)
#: How many standard deviations more often than by chance bad rows must have a content slot for it to count.
TELLING = 4.5
#: Words whose slots a worker keeps.
MEMO = 400_000
_MARKS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!")
_EDGE = b".,;:!?*$%&#|\"'()[]{}<>-"


def word_slots(word: bytes) -> tuple[int, ...]:
    """Slots of a lower-cased word without edge punctuation and of its beginnings."""
    bare = word.strip(_EDGE)
    forms = [bare, *(bare[:n] + b"~" for n in STEMS if len(bare) >= n)] if bare else []
    return tuple(1 + xxhash.xxh3_64_intdigest(f) % (WIDTH - 1) for f in forms)


def text_slots(words: list[bytes]) -> list[int]:
    """Distinct slots of a text's lower-cased words, and that of the intercept."""
    return [0, *sorted({s for w in set(words) for s in word_slots(w)})]


def meta_slots(data: bytes, words: list[bytes], lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Slots of a page's metadata and layout, some in pairs; null values have slots of their own."""
    total = max(1, len(words))
    flat = np.frombuffer(data, np.uint8)
    upper, lower = int(np.count_nonzero((flat >= 65) & (flat <= 90))), int(np.count_nonzero((flat >= 97) & (flat <= 122)))
    digits = int(np.count_nonzero((flat >= 48) & (flat <= 57)))
    lines = data.count(b"\n") + 1
    length = None if n_chars is None else max(0, n_chars).bit_length()
    marks = min(15, 20 * sum(map(data.count, _MARKS)) // total)
    again = min(7, 16 * sum(a == b for a, b in zip(words, words[1:])) // total)
    shout = min(7, 8 * upper // max(1, upper + lower))
    values = (
        f"lang={lang}", f"source={source}", f"length={length}", f"lang={lang} length={length}", f"lines={lines.bit_length()}", f"line={(total // lines).bit_length()}",
        f"marks={marks}", f"upper={shout}", f"again={again}", f"digits={min(7, 16 * digits // max(1, len(data)))}", f"word={min(15, len(data) // total)}", f"marks={marks} upper={shout} again={again}",
    )
    return [0, *sorted({1 + xxhash.xxh3_64_intdigest(v.encode()) % (META_WIDTH - 1) for v in values})]


def _words(data: bytes | None) -> tuple[bytes, list[bytes]]:
    data = data or b""
    return data, data.lower().split()


@dataclass
class Slots:
    """Rows of slots, one row after the other."""

    ends: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Slots:
        lists = column.combine_chunks()
        return cls(np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy())

    def __len__(self) -> int:
        return len(self.ends)

    def rows(self) -> np.ndarray:
        """The row of every slot."""
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.ends, prepend=0))

    def take(self, keep: np.ndarray) -> Slots:
        sizes = np.diff(self.ends, prepend=0)
        return Slots(np.cumsum(sizes[keep]), self.flat[np.repeat(keep, sizes)])

    def join(self, other: Slots) -> Slots:
        last = self.ends[-1] if len(self) else 0
        return Slots(np.concatenate((self.ends, other.ends + last)), np.concatenate((self.flat, other.flat)))


@dataclass
class View:
    """Logistic regression over the slots that are present in a row; only those with a weight are held.

    ``telling``: fit only slots that bad rows have so many standard deviations more often than by chance,
    so that good words don't excuse bad ones; 0 fits all that four rows or more have.
    """

    telling: float = 0.0
    slots: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def margins(self, rows: Slots) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.slots, rows.flat), len(self.slots) - 1)
        worth = np.where(self.slots[place] == rows.flat, self.weights[place], 0.0)
        return np.bincount(rows.rows(), worth, minlength=len(rows))

    def _used(self, rows: Slots, y: np.ndarray, width: int) -> np.ndarray:
        seen, base = np.bincount(rows.flat, minlength=width), y.mean()
        used = seen >= 4
        if self.telling:
            more = np.bincount(rows.flat, y[rows.rows()], minlength=width) - seen * base
            used &= more > self.telling * np.sqrt(np.maximum(seen * base * (1 - base) * (1 - seen / len(y)), 1e-9))
        return used

    def fit(self, rows: Slots, y: np.ndarray, more: Slots, said: np.ndarray, steps: int = 300, rate: float = 0.1, penalty: float = 1e-4) -> View:
        """``rows`` have labels ``y``, ``more`` pseudo-labels ``said``; slots count that tell in the former or in all."""
        every, y_all = rows.join(more), np.concatenate([y, said])
        width = int(every.flat.max()) + 1
        used = self._used(rows, y, width) | self._used(every, y_all, width)
        used[0] = True
        keep = used[every.flat]
        at, flat, n = every.rows()[keep], (np.cumsum(used, dtype=np.int32) - 1)[every.flat[keep]], int(used.sum())
        rows_all = len(every)
        del every, keep
        w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
        for t in range(1, steps + 1):
            p = _sigmoid(np.bincount(at, w[flat], minlength=rows_all))
            g = np.bincount(flat, (p - y_all)[at], minlength=n) / rows_all + penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.slots, self.weights = np.flatnonzero(used), w
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slopes..., intercept) of a logistic regression of ``y`` on a few margins, by Newton steps."""
    x = np.column_stack([margins, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (p - y) + 1e-3 * w)
    return w


@dataclass
class CoTrained:
    """Both views with their scales and the weights that combine them; ``given``: pseudo-labels by receiving view and round."""

    text: View
    meta: View
    text_scale: np.ndarray
    meta_scale: np.ndarray
    joint: np.ndarray
    given: list[dict[str, int]] = field(default_factory=list)

    def combine(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of rejection by each view, and combined, from the views' margins."""
        t = self.text_scale[0] * text + self.text_scale[1]
        m = self.meta_scale[0] * meta + self.meta_scale[1]
        return _sigmoid(t), _sigmoid(m), _sigmoid(self.joint[0] * t + self.joint[1] * m + self.joint[2])

    def scores(self, texts: list[bytes | None], meta: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``combine``, from texts and ``(lang, source, n_chars)``; words without a weight are known as such."""
        if not hasattr(self, "_worth"):
            self._worth = dict(zip(self.text.slots.tolist(), self.text.weights.tolist()))
            self._memo: dict[bytes, tuple[int, ...]] = {}
        worth, memo = self._worth, self._memo
        margins, rows = np.empty(len(texts)), []
        for i, (text, about) in enumerate(zip(texts, meta, strict=True)):
            data, words = _words(text)
            found: set[int] = set()
            if len(memo) > MEMO:
                memo.clear()
            for w in set(words):
                got = memo.get(w)
                if got is None:
                    got = memo[w] = tuple(s for s in word_slots(w) if s in worth)
                if got:
                    found.update(got)
            margins[i] = worth[0] + sum(worth[s] for s in sorted(found))
            rows.append(meta_slots(data, words, *about))
        flat = np.fromiter((s for r in rows for s in r), np.int64)
        return self.combine(margins, self.meta.margins(Slots(np.cumsum([len(r) for r in rows], dtype=np.int64), flat)))


_FEATURES = ("text", "lang", "source", "n_chars")


def _read(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.col("text").cast("binary"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def features(rows: DataFrame) -> pa.Table:
    """``rows(doc_id, bad, ...)`` -> their slots by view, in the order of hashed doc_ids; for a bounded number of rows."""
    schema = "doc_id long, bad int, text_slots array<int>, meta_slots array<int>"

    def slots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [_words(x) for x in part.column(2).to_pylist()]
            about = zip(*(c.to_pylist() for c in part.columns[3:]), strict=True)
            t = pa.array([text_slots(w) for _, w in texts], pa.list_(pa.int32()))
            m = pa.array([meta_slots(*x, *a) for x, a in zip(texts, about, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), t, m], names=["doc_id", "bad", "text_slots", "meta_slots"])

    got = _read(rows, "doc_id", "bad").mapInArrow(slots, schema).dropDuplicates(["doc_id"]).toArrow()
    ids = got["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: xxhash.xxh64_intdigest(str(ids[i])))
    return got.take(pa.array(order, pa.int64()))


def _calibrated(views: dict[str, View], rows: dict[str, Slots], check: np.ndarray, y: np.ndarray, given: list) -> CoTrained:
    margins = {n: v.margins(rows[n].take(check)) for n, v in views.items()}
    scale = {n: calibrate(m[:, None], y[check]) for n, m in margins.items()}
    both = np.column_stack([scale[n][0] * margins[n] + scale[n][1] for n in ("text", "meta")])
    return CoTrained(views["text"], views["meta"], scale["text"], scale["meta"], calibrate(both, y[check]), given)


def handed_over(scored: DataFrame, bad: int, good: int, sure: float) -> DataFrame:
    """``scored(doc_id, text_score, meta_score, score)`` -> ``(doc_id, to, bad)``: each view's surest ``bad`` bad and ``good`` good documents.

    A view is sure of a bad document by itself, of a good one only where both views together are.
    """
    out = None
    for name, to in (("text_score", "meta"), ("meta_score", "text")):
        for said, most, order in ((1, bad, F.desc(name)), (0, good, F.asc(name))):
            fit = F.col(name) >= sure if said else F.col("score") <= 1 - sure
            best = scored.where(fit).orderBy(order, F.xxhash64("doc_id"), "doc_id").limit(most)
            best = best.select("doc_id", F.lit(to).alias("to"), F.lit(said).alias("bad"))
            out = best if out is None else out.unionByName(best)
    return out


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, handed: int = HANDED, sure: float = SURE) -> CoTrained | None:
    """Fit to at most ``labelled`` labelled documents and what the views hand each other.

    A document is bad if any of its labels says quality 0 or toxic 1; a null says nothing.  Every fourth labelled row is
    held out for calibration.  Each of the ``rounds`` scores its share (by hashed doc_id) of all
    unlabelled documents; a view hands over at most ``handed`` of those, in the labelled rows' share of
    bad ones, with calibrated confidence ``sure`` at least.  Only the slots of fitted rows are gathered.  None if the labels lack
    a class.  Labels without doc_id or document, and documents without doc_id, take no part here.
    """
    small_batches(docs.sparkSession)
    bad = F.max(F.expr("cast(coalesce(quality = 0, false) or coalesce(toxic = 1, false) as int)")).alias("bad")
    said = labels.where("doc_id is not null and coalesce(quality, toxic) is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(bad)
    seen = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), *_FEATURES)
    chosen = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    known = features(seen.join(chosen, "doc_id"))
    y = np.array(known["bad"].to_numpy(), float)
    if len(set(y)) < 2:
        return None
    rows = {"text": Slots.of(known["text_slots"]), "meta": Slots.of(known["meta_slots"])}
    del known
    check = np.arange(len(y)) % 4 == 3
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        check = np.ones(len(y), bool)
        fit = check
    else:
        fit = ~check
    views = {"text": View(TELLING), "meta": View()}
    extra: dict[str, tuple[Slots, np.ndarray]] = {n: (rows[n].take(np.zeros(len(y), bool)), np.empty(0)) for n in views}
    given: list[dict[str, int]] = []
    for done in range(rounds + 1):
        for name, view in views.items():
            view.fit(rows[name].take(fit), y[fit], *extra[name])
        model = _calibrated(views, rows, check, y, given)
        if done == rounds:
            return model
        share = seen.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(rounds)) == done)
        scored = materialise(score(share, model).drop("kept").join(said, "doc_id", "left_anti"))  # no text is shuffled
        bads = round(handed * y[fit].mean())
        best = materialise(handed_over(scored, bads, handed - bads, sure))
        got = features(seen.join(F.broadcast(best.select("doc_id").distinct()), "doc_id").withColumn("bad", F.lit(None).cast("int")))
        place = {d: i for i, d in enumerate(got["doc_id"].to_pylist())}
        counts = dict.fromkeys(views, 0)
        for name in views:
            news = {place[r.doc_id]: float(r.bad) for r in best.where(F.col("to") == name).collect() if r.doc_id in place}  # 2 * handed rows
            keep = np.zeros(len(got), bool)
            keep[list(news)] = True
            old, said_old = extra[name]
            extra[name] = (old.join(Slots.of(got[f"{name}_slots"]).take(keep)), np.concatenate([said_old, [news[i] for i in sorted(news)]]))
            counts[name] = len(news)
        given.append(counts)
        drop(scored, best)
    return None


SCORES = "doc_id long, text_score double, meta_score double, score double, kept boolean"


def score(docs: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, kept)`` for each input row; scores are probabilities of rejection.

    Without a model every score is one half and every row is kept.  Null texts and metadata are
    scored like any other; repeated rows get equal scores; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most a weight for each slot of the fitted rows

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in parts:
            ids, texts, *about = part.columns
            if m is None:
                t = v = p = np.full(part.num_rows, 0.5)
            else:
                t, v, p = m.scores(texts.to_pylist(), list(zip(*(c.to_pylist() for c in about), strict=True)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(t), pa.array(v), pa.array(p), pa.array(p <= threshold)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return _read(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, all columns as they were.

    Each row is judged by itself: null and empty texts and metadata are scored like any other, rows
    without doc_id too; repeated rows stay or go together; an empty table gives no rows.
    """
    model = train(docs, labels)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(True, text.index)
        none = lambda s: [None if pd.isna(x) else x for x in s]
        chars = [None if x is None else int(x) for x in none(n_chars)]
        return pd.Series(shared.value.scores(list(text), list(zip(none(lang), none(source), chars, strict=True)))[2] <= THRESHOLD, text.index)

    keep: Column = good(F.col("text").cast("binary"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return docs.where(keep)
