"""Optimal length buckets and token-budget batches.

A dynamic program over the global length histogram chooses the bucket boundaries that pad least;
inside each bucket, batches hold as many padded rows as the token budget allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from alignlake.scratch import free_name, materialise

BUCKETS = 8
TOKEN_BUDGET = 32_768


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length ranges with the least total padding.

    ``lengths`` ascend.  The best cost of k ranges up to length j is the lowest of lines in j's
    length, found for all j at once with a convex hull; ties take the fewer rows in the last range.
    """
    n = len(lengths)
    if n == 0:
        return []
    size = [int(x) for x in lengths]
    rows = [0, *(int(x) for x in np.cumsum(counts))]
    mass = [0, *(int(x) for x in np.cumsum(np.asarray(lengths, np.int64) * np.asarray(counts, np.int64)))]
    cost = [size[j] * rows[j + 1] - mass[j + 1] for j in range(n)]
    back: list[list[int]] = []
    for _ in range(1, min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, range start
        best, cut, at = list(cost), [0] * n, 0
        for j in range(1, n):
            slope, icept = -rows[j], cost[j - 1] + mass[j]
            while len(hull) > 1 and (icept - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, icept, j))
            at = min(at, len(hull) - 1)
            x = size[j]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            got = hull[at][0] * x + hull[at][1] + x * rows[j + 1] - mass[j + 1]
            if got < best[j]:
                best[j], cut[j] = got, hull[at][2]
        cost = best
        back.append(cut)
    ends, j = [], n - 1
    for cut in reversed(back):
        if cut[j]:
            ends.append(size[j])
            j = cut[j] - 1
    return [*ends, size[j]][::-1]


def word_count(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_tokens``: words of ``[^\\x20\\x09-\\x0D]+`` (null: none)."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.withColumn("n_tokens", words.cast("long"))


def histogram(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rows): all rows by exact length.  D lengths take D * (D - 1) / 2 words at least, so what
    is gathered grows at most with the square root of all words."""
    rows = measured.groupBy(F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).agg(F.count("*").alias("n")).collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def pack(measured: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``measured(n_tokens, ...)`` -> the same rows, all columns as they were, with ``bucket``, ``padded`` and ``batch``.

    ``padded`` is the bucket's upper length; a batch holds ``max(1, budget // padded)`` rows (a longer row stands
    alone; length zero, and null, count as one).  Tasks number the rows of each bucket as they come and write them once; the
    counts of the tasks, summed up, give each one's first number.  So only the last batch of a bucket is short, no row
    moves, and no doc_id matters: rows without one, or with one that others have too, are packed like any other.  New columns
    take underscores before their names if the table has such columns.  An empty table gives no rows.
    """
    names = [free_name(measured, n) for n in ("bucket", "padded", "batch")]
    lengths, counts = histogram(measured)
    ends = boundaries(lengths, counts, buckets)
    if not ends:
        return measured.select("*", *(F.lit(0).cast(t).alias(n) for n, t in zip(names, ("int", "long", "long"), strict=True)))
    part, number = free_name(measured, "_part"), free_name(measured, "_number")
    place = measured.columns.index("n_tokens")
    upper = np.array(ends, np.int64)
    given = [*measured.columns, names[0], part, number]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(ends), np.int64)
        me = TaskContext.get().partitionId()
        for rows in parts:
            at = np.searchsorted(upper, pc.fill_null(rows.column(place), 0).to_numpy())
            order = np.argsort(at, kind="stable")
            here = np.bincount(at, minlength=len(ends))
            rank = np.empty(len(at), np.int64)
            rank[order] = np.arange(len(at)) - np.repeat(np.cumsum(here) - here, here) + seen[at[order]]
            seen += here
            more = [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), me, np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=given)

    kinds = StructType([*measured.schema.fields, *StructType.fromDDL(f"`{names[0]}` int, `{part}` int, `{number}` long").fields])
    rows = materialise(measured.mapInArrow(run, kinds))
    p, before = free_name(rows, "_p"), free_name(rows, "_before")
    sizes = rows.groupBy(F.col(part).alias(p)).agg(*(F.count_if(F.col(names[0]) == i).alias(f"n{i}") for i in range(len(ends))))
    first = sizes.select(p, F.array(*(F.expr(f"sum(n{i}) over (order by `{p}`) - n{i}") for i in range(len(ends)))).alias(before))
    placed = rows.join(F.broadcast(first), F.col(part) == F.col(p))  # a row of a few numbers for each task that wrote
    padded = F.get(F.array(*[F.lit(int(e)).cast("long") for e in ends]), F.col(names[0]))
    fit = F.get(F.array(*[F.lit(max(1, budget // max(1, int(e)))).cast("long") for e in ends]), F.col(names[0]))
    batch = F.floor((F.get(before, F.col(names[0])) + F.col(number)) / fit).cast("long")
    return placed.select(*(rows[c] for c in measured.columns), names[0], padded.alias(names[1]), batch.alias(names[2]))
