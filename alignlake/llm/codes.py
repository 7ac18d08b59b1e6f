"""Vector codes by product quantisation in whole numbers, with adaptive bounds between rounds.

Vectors are cut into parts; each part position has a codebook that Lloyd rounds move.  Between rounds each part keeps
its entry with an upper bound of the distance to it, its ``b`` closest other entries with a lower bound each, and one
outer bound for all the rest.  A round moves the bounds by how far the entries moved.  A part whose entry is nearer than
every bound stays; in order of the bounds only as many entries are looked at as may be nearer, in exact whole numbers.
``b`` follows how many that were.  Vectors and bounds stay where they are: a round writes them once and sums up entries'
parts in each task, so nothing is shuffled but those sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignlake.scratch import drop, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Share of the looked-at parts that may need more entries than ``b`` before ``b`` grows.
RARE = 0.02
#: Outward rounding of bounds, far above the error of the arithmetic.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
_MOST = np.finfo(np.float32).max
_NONE = 255
_LIMB = 40
_ROWS = 4096


def whole(v: np.ndarray, exact: bool) -> np.ndarray:
    """``floor(SCALE * v)`` as 64-bit numbers, or as Python's whole numbers where those may be too small."""
    if not exact:
        return np.floor(v * float(SCALE)).astype(np.int64)
    one = lambda x: int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)
    return np.array([one(x) for x in v.ravel().tolist()], object).reshape(v.shape)


def cuts(width: int, parts: int = PARTS) -> list[int]:
    """Ends of the parts, equal where ``parts`` divides ``width``, else as equal as can be."""
    return [p * width // parts for p in range(parts + 1)]


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(-1)


def _root(d: np.ndarray) -> np.ndarray:
    if d.dtype == object:
        flat = [math.sqrt(x) if x < 1 << 1000 else math.inf for x in d.ravel().tolist()]
        return np.array(flat, float).reshape(d.shape)
    return np.sqrt(d.astype(float))


def _in_order(d: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Places of each row's distances in rising order, the lower entry first."""
    if d.dtype != object:
        return np.lexsort((entry, d), axis=-1)
    return np.array([sorted(range(d.shape[1]), key=lambda j: (d[i, j], entry[i, j])) for i in range(len(d))], np.int64).reshape(d.shape)


def bounds_type(b: int, parts: int = PARTS) -> np.dtype:
    """What is kept of a vector: entry, upper bound, outer bound, then the closest other entries with their lower bounds."""
    return np.dtype([("entry", "u1", parts), ("upper", "<f4", parts), ("outer", "<f4", parts), ("near", "u1", (parts, b)), ("lower", "<f4", (parts, b))])


def assign(x: np.ndarray, books: list[np.ndarray], ends: list[int], kept: np.ndarray | None, moved: list[np.ndarray] | None, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries of the parts of ``x`` (ties to the lower one): new bounds with ``b`` entries, and how many parts looked at 0, 1, ... entries.

    ``kept`` are the bounds before the entries moved by ``moved``; without them every entry is looked at.
    """
    n, parts = len(x), len(books)
    out = np.zeros(n, bounds_type(b, parts))
    looked = np.zeros(2, np.int64)

    def note(at: int, times: int) -> None:
        nonlocal looked
        if times:
            looked = np.pad(looked, (0, max(0, at + 1 - len(looked))))
            looked[at] += times

    for p, book in enumerate(books):
        part, k = x[:, ends[p] : ends[p + 1]], len(book)
        entry, upper, outer = np.zeros(n, np.int64), np.zeros(n), np.full(n, float(_MOST))
        near, lower = np.full((n, b), _NONE, np.int64), np.full((n, b), float(_MOST))
        every = np.arange(n)
        if kept is not None:
            was = kept.dtype["near"].shape[1]
            far = np.zeros(256)
            far[:k] = moved[p]
            entry = kept["entry"][:, p].astype(np.int64)
            upper = (kept["upper"][:, p] + far[entry]) * _UP
            seen = kept["near"][:, p].astype(np.int64)
            low = (kept["lower"][:, p].astype(float) - far[seen]) * _DOWN
            out_ = (kept["outer"][:, p].astype(float) - far.max()) * _DOWN
            order = np.minimum.accumulate(np.column_stack([low, out_])[:, ::-1], axis=1)[:, ::-1]
            unsure = np.flatnonzero(~(order[:, 0] > upper))
            note(0, n - len(unsure))
            own = _squared(part[unsure], book[entry[unsure]])
            upper[unsure] = _root(own) * _UP
            need = (~(order[unsure] > upper[unsure, None])).sum(1)
            note(0, int((need == 0).sum()))
            every = unsure[need > was]
            note(was + 1, len(every))
            some = (need > 0) & (need <= was)
            at, need, own = unsure[some], need[some], own[some]
            for m in range(1, was + 1):
                note(m, int((need == m).sum()))
            if len(at):
                m = int(need.max())
                e = np.column_stack([entry[at], seen[at, :m]])
                d = np.zeros(e.shape, x.dtype)
                d[:, 0] = own
                bound = np.column_stack([np.zeros(len(at)), low[at, :m]])
                for z in range(m):
                    here = need > z
                    d[here, z + 1] = _squared(part[at[here]], book[e[here, z + 1]])
                used = np.arange(m + 1) <= need[:, None]
                bound = np.where(used, _root(d) * _DOWN, bound)
                d[~used] = 1 + (d.max() if d.size else 0)  # after all that were looked at
                turn = _in_order(d, e)
                e, bound = np.take_along_axis(e, turn, 1), np.take_along_axis(bound, turn, 1)
                entry[at], upper[at] = e[:, 0], bound[:, 0] * (_UP / _DOWN) * _UP
                seen[at, :m], low[at, :m] = e[:, 1:], bound[:, 1:]
            same = min(b, was)
            near[:, :same], lower[:, :same] = seen[:, :same], low[:, :same]
            outer = np.minimum(out_, low[:, same:].min(1)) if was > same else out_
        else:
            note(k, n)
        for s in range(0, len(every), _ROWS):
            at = every[s : s + _ROWS]
            d = _squared(part[at][:, None, :], book[None])
            turn = _in_order(d, np.broadcast_to(np.arange(k), d.shape))
            dist = _root(np.take_along_axis(d, turn, 1))
            entry[at], upper[at] = turn[:, 0], dist[:, 0] * _UP
            m = min(b, k - 1)
            near[at], lower[at] = _NONE, _MOST
            near[at, :m], lower[at, :m] = turn[:, 1 : m + 1], dist[:, 1 : m + 1] * _DOWN
            outer[at] = dist[:, m + 1] * _DOWN if k > m + 1 else _MOST
        out["entry"][:, p], out["near"][:, p] = entry, near
        with np.errstate(over="ignore"):
            out["upper"][:, p] = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
        down = lambda v: np.nextafter(np.clip(v, -_MOST, _MOST).astype(np.float32), np.float32(-np.inf))
        out["outer"][:, p], out["lower"][:, p] = down(outer), down(lower)
    return out, looked


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number of any size as (place, digits), so that sums over tasks stay within 64 bits."""
    at = 0
    while not -(1 << _LIMB) < value < 1 << _LIMB:
        yield at, value & ((1 << _LIMB) - 1)
        value >>= _LIMB
        at += 1
    yield at, value


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _next_b(looked: dict[int, int], b: int, entries: int) -> int:
    """The least number of entries that all but ``RARE`` of the unsure parts are served by, between an eighth and half of all."""
    unsure = sum(n for at, n in looked.items() if at)
    low, high = max(1, entries // 8), max(1, entries // 2)
    for z in range(low, high):
        if sum(n for at, n in looked.items() if at > z) <= RARE * unsure:
            return z
    return min(high, b + 1)


def _of_width(rows: DataFrame, width: int, largest: float, parts: int, entries: int, rounds: int) -> DataFrame:
    """``rows(vec_id, label, v)`` of one length -> ``(vec_id, label, code, error, codebooks_sha256)``."""
    ends = cuts(width, parts)
    exact = not 4 * (largest * SCALE + 1) ** 2 * (width // parts + 1) < 2.0**61
    first = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    start = whole(np.array(first, float).reshape(len(first), width), exact)
    books = [start[:, ends[p] : ends[p + 1]] for p in range(parts)]
    k, b = len(first), max(1, entries // 4)
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, v {rows.schema['v'].dataType.simpleString()}, bounds binary, sums array<struct<part:int,entry:int,at:int,limb:int,n:long>>"

    def step(books: list, moved: list | None, was: int, b: int):
        def run(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = None
            total = [np.zeros(book.shape, object) for book in books]
            count = np.zeros((parts, k), np.int64)
            looked: dict[int, int] = {}
            for batch in parts_:
                kind = batch.schema
                if not batch.num_rows:
                    continue
                x = whole(_vectors(batch.column(2), width), exact)
                kept = None if moved is None else np.frombuffer(b"".join(batch.column(3).to_pylist()), bounds_type(was, parts))
                new, seen = assign(x, books, ends, kept, moved, b)
                for at, n in enumerate(seen.tolist()):
                    looked[at] = looked.get(at, 0) + n
                for p in range(parts):
                    own = new["entry"][:, p]
                    for e in np.unique(own):
                        here = own == e
                        count[p, e] += int(here.sum())
                        total[p][e] += x[here, ends[p] : ends[p + 1]].sum(0)
                state = pa.array([r.tobytes() for r in new], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], state, pa.nulls(batch.num_rows, sums_type)], names=names)
            if kind is not None:
                sums = [{"part": p, "entry": e, "at": -1, "limb": 0, "n": int(count[p, e])} for p in range(parts) for e in range(k) if count[p, e]]
                sums += [{"part": -1, "entry": at, "at": -1, "limb": 0, "n": n} for at, n in looked.items() if n]
                for p in range(parts):
                    for e in np.flatnonzero(count[p]).tolist():
                        for at, value in enumerate(total[p][e].tolist()):
                            sums += [{"part": p, "entry": e, "at": at, "limb": limb, "n": n} for limb, n in _limbs(int(value)) if n]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kind.field(i).type) for i in range(3)), pa.nulls(1, pa.binary()), pa.array([sums], sums_type)], names=names)

        names = ["vec_id", "label", "v", "bounds", "sums"]
        sums_type = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("n", pa.int64())]))
        return run

    now, moved, was = rows.select("vec_id", "label", "v"), None, b
    table = None
    for _ in range(rounds):
        last, table = table, materialise(now.mapInArrow(step(books, moved, was, b), schema))
        if last is not None:
            drop(last)
        now = table.where("sums is null").select("vec_id", "label", "v", "bounds")
        totals = table.where("sums is not null").select(F.explode("sums").alias("s")).groupBy("s.part", "s.entry", "s.at", "s.limb").agg(F.sum("s.n").alias("n"))
        counts, sums, looked = {}, {}, {}
        for r in totals.collect():  # a few numbers for each component of the codebooks
            if r.part < 0:
                looked[r.entry] = r.n
            elif r["at"] < 0:
                counts[r.part, r.entry] = r.n
            else:
                key = (r.part, r.entry, r["at"])
                sums[key] = sums.get(key, 0) + (r.n << (_LIMB * r.limb))
        new = [book.copy() for book in books]
        for (p, e), n in counts.items():
            new[p][e] = [sums.get((p, e, i), 0) // n for i in range(new[p].shape[1])]
        moved = [_root(_squared(a, c)) * _UP for a, c in zip(new, books, strict=True)]
        books, was, b = new, b, _next_b(looked, b, entries)
    digest = hashlib.sha256(",".join(str(int(c)) for book in books for c in book.ravel()).encode()).hexdigest()

    def finish(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_:
            if not batch.num_rows:
                continue
            x = whole(_vectors(batch.column(2), width), exact)
            kept = None if moved is None else np.frombuffer(b"".join(batch.column(3).to_pylist()), bounds_type(was, parts))
            own = assign(x, books, ends, kept, moved, b)[0]["entry"]
            error = sum(_squared(x[:, ends[p] : ends[p + 1]], books[p][own[:, p]]) for p in range(parts))
            error = [e if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in own]), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    out = materialise(now.mapInArrow(finish, f"vec_id long, label {label}, code string, error long"))
    if table is not None:
        drop(table)
    return out.withColumn("codebooks_sha256", F.lit(digest))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> ``(vec_id, label, code, error, label_error, codebooks_sha256)`` for each usable row.

    Components become ``floor(4096 x)``; vectors are cut into ``parts`` equal parts (as equal as can be).  Each position's
    codebook starts as the parts of the ``entries`` smallest vec_ids (rows of one vec_id in order of their vectors, rows without
    one last) and moves for ``rounds`` rounds to the floored means; then parts are assigned once more.  ``code`` has two
    hex digits for each part.  ``label_error`` sums ``error`` over equal labels, nulls together; either is null where it
    takes more than 64 bits.  Left out are rows whose vector is null or has null or non-finite components.  Vectors of different lengths can't share
    codebooks, so each length is coded by itself, labels across lengths.  Repeated rows count each; an empty table gives no rows.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    peak = F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))).cast("double")
    widths = rows.groupBy(F.size("v").alias("width")).agg(peak.alias("peak")).orderBy("width").collect()  # a table has few lengths
    found = [_of_width(rows.where(F.size("v") == w.width), w.width, w.peak, parts, entries, rounds) for w in widths]
    if not found:
        label = vectors.schema["label"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    coded = reduce(DataFrame.unionByName, found)
    fits = lambda c: F.when(c <= (1 << 63) - 1, c).cast("long")
    total = F.when(F.count_if(F.col("error").isNull()) == 0, F.sum(F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy(F.col("label").alias("of")).agg(fits(total).alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
