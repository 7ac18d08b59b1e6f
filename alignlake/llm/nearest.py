"""Nearest neighbours through low-dimensional stable projections indexed by a kd-tree.

Inner products become distances by one added coordinate; Gaussian projections to ``DIMS`` numbers
keep them in distribution.  A kd-tree over a bounded sample deals all vectors into cells.  A query
visits cells in order of their projected distance, each round more of them than the one before, and
verifies every vector in them, until the chi-square test says that a nearer vector would almost
surely have shown up by now.  A visit hands back only vectors that the rounds before don't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignlake.llm.common import small_batches
from alignlake.scratch import materialise, numbered

DIMS = 8
SEED = 42
#: Vectors the tree is fitted to, at most; cells, at most; vectors wanted in a cell.
SAMPLE, MOST_CELLS, CELL_ROWS = 20_000, 4096, 512
#: Vectors of a cell, and queries that visit it, that meet in one group.
BLOCK_ROWS, QUERY_ROWS = 4096, 4096
#: Confidence of the stopping test.
CONFIDENCE = 0.95
#: Squared length from which vectors aren't projected (sums of squares may overflow): every query is compared with them.
LOUD = 1e280
#: Cells that a query visits in its first round, and how many times more in each round after it.
FIRST_VISITS, MORE = 1, 4


def chi_square_quantile(p: float, m: int = DIMS) -> float:
    """x with P(chi-square of m degrees <= x) = p, for even m."""

    def cdf(x: float) -> float:
        term = total = 1.0
        for j in range(1, m // 2):
            term *= x / 2 / j
            total += term
        return 1 - np.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def build_tree(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, threshold, left, right) of a kd-tree cut at medians of the widest axis; a negative child ``-1 - c`` is cell c."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(p: np.ndarray, want: int) -> int:
        nonlocal count
        spread = p.max(0) - p.min(0) if len(p) else np.zeros(1)
        axis = int(spread.argmax())
        if want > 1 and len(p) > 1 and spread[axis] > 0:
            cut = float(np.median(p[:, axis]))
            right = p[:, axis] > cut
            if not right.any():
                right = p[:, axis] >= cut
                cut = float(np.nextafter(cut, -np.inf))
            at = len(nodes)
            nodes.append((axis, cut, 0, 0))
            a = grow(p[~right], want // 2)
            b = grow(p[right], want - want // 2)
            nodes[at] = (axis, cut, a, b)
            return at
        count += 1
        return -count

    root = grow(points, cells)
    return nodes if root >= 0 else []


def locate(nodes: list, points: np.ndarray) -> np.ndarray:
    """The cell of every point."""
    if not nodes:
        return np.zeros(len(points), np.int64)
    axis, cut, left, right = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(points), np.int64)
    while (go := np.flatnonzero(at >= 0)).size:
        n = at[go]
        at[go] = np.where(points[go, axis[n]] > cut[n], right[n], left[n])
    return -1 - at


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part: an id, a vector not null or zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The ``k`` vectors of largest inner product for each row whose vec_id is divisible by ``every``.

    ``vectors(vec_id, embedding)`` -> ``(query_id, rank from 1, vec_id, score)``, ties to the smaller
    vec_id, the query's own row left out; fewer than ``k`` only where fewer take part (see ``usable``).
    Every row counts: rows of one vec_id are candidates of each other, and each of them asks.  Vectors
    of different lengths have no inner product, so each length is searched by itself.  Equal vectors are
    searched once and spelled out at the end, so a vector with many copies costs no more than another.
    Vectors too long to be squared are in a cell of their own that every query visits.  Products that overflow are
    infinite; where both infinities meet, the product counts as the lowest.  Empty tables give no rows.
    """
    small_batches(vectors.sparkSession)
    rows = numbered(usable(vectors))
    widths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # a table has few lengths
    found = [_nearest(rows.where(F.size("v") == w), k, every, w, cell_rows) for w in widths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, k: int, every: int, width: int, cell_rows: int) -> DataFrame:
    """As ``nearest`` for ``rows(_row, vec_id, v)`` whose vectors have ``width`` components."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, square = rows.agg(F.count("*"), F.coalesce(F.max(F.when(length < LOUD, length)), F.lit(0.0))).first()
    first = rows.withColumn("place", F.expr("row_number() over (partition by v order by vec_id, _row)")).where(f"place <= {k + 1}")
    first = first.withColumn("rep", F.expr("first_value(_row) over (partition by v order by vec_id, _row)"))
    first = first.withColumn("least", F.expr("first_value(vec_id) over (partition by v order by vec_id, _row)"))
    members = materialise(first.select("rep", "least", "_row", "vec_id", "v"))
    distinct = members.where("_row = rep").select("rep", "least", "v")
    asked = rows.where(f"vec_id % {every} = 0").select(F.col("_row").alias("asker"), F.col("vec_id").alias("query_id"), "v")
    queries = materialise(asked.groupBy("v").agg(F.min("asker").alias("rep")))

    matrix = np.random.default_rng(SEED).standard_normal((width + 1, DIMS))

    def project(v: np.ndarray, lift: bool) -> np.ndarray:
        last = np.sqrt(np.maximum(square - (v * v).sum(1), 0)) if lift else np.zeros(len(v))
        return np.column_stack([v, last]) @ matrix

    def projected(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(project(_matrix(part.column(0)), True)))], names=["y"])

    fit = distinct.where(length < LOUD).orderBy(F.xxhash64("least"), "least", "rep").limit(SAMPLE)
    sample = fit.select("v").mapInArrow(projected, "y array<double>").toArrow()["y"].combine_chunks()  # DIMS numbers a row
    nodes = build_tree(_matrix(sample).reshape(-1, DIMS), int(min(MOST_CELLS, max(1, total // cell_rows))))
    loud = len(nodes) + 1  # the cell of vectors that aren't projected
    n_cells = loud + 1

    def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                v = _matrix(part.column(2))
                with np.errstate(over="ignore"):
                    quiet = (v * v).sum(1) < LOUD
                y = project(np.where(quiet[:, None], v, 0), True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.where(quiet, locate(nodes, y), loud)), pa.array(list(y))], names=["rep", "least", "v", "cell", "y"])

    placed = materialise(distinct.mapInArrow(cells, "rep long, least long, v array<double>, cell long, y array<double>"))
    ends = [f(F.col("y")[i]).alias(f"{n}{i}") for n, f in (("a", F.min), ("b", F.max)) for i in range(DIMS)]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()  # at most MOST_CELLS rows
    low, high = np.zeros((n_cells, DIMS)), np.zeros((n_cells, DIMS))
    blocks = np.zeros(n_cells, np.int64)
    for b in boxes:
        blocks[b["cell"]] = -(-b["n"] // BLOCK_ROWS)
        low[b["cell"]], high[b["cell"]] = [b[f"a{i}"] for i in range(DIMS)], [b[f"b{i}"] for i in range(DIMS)]
    reach = chi_square_quantile(CONFIDENCE)
    share = np.maximum(blocks, 1).tolist()
    spread = F.pmod(F.xxhash64("rep"), F.get(F.array(*map(F.lit, share)), F.col("cell").cast("int")))
    held = materialise(placed.select("rep", "least", "v", "cell", spread.alias("block")))

    def plan(skip: int, most: int):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if not part.num_rows:
                    continue
                v, worst = _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore", invalid="ignore"):
                    square_v = (v * v).sum(1)
                    y = project(np.where(square_v[:, None] < LOUD, v, np.nan), False)
                who, where = [], []
                for i in range(len(v)):
                    gap = np.maximum(np.maximum(low - y[i], y[i] - high), 0)
                    bound = np.nan_to_num((gap * gap).sum(1), nan=0.0)  # a query that isn't projected visits every cell
                    bound[loud] = -1.0
                    order = np.argsort(np.where(blocks > 0, bound, np.inf), kind="stable")
                    true = square_v[i] + square - 2 * worst[i] if worst[i] == worst[i] else np.inf
                    order = order[skip : skip + most]
                    order = order[~(bound[order] > reach * true) & (blocks[order] > 0)]
                    who += [i] * len(order)
                    where += order.tolist()
                take = part.take(pa.array(who, pa.int64())) if who else part.slice(0, 0)
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(where, pa.int64())], names=["query", "q", "worst", "cell"])

        return run

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            order = np.lexsort((right["rep"].to_numpy(), right["least"].to_numpy()))
            ids, ties, v = right["rep"].to_numpy()[order], right["least"].to_numpy()[order], _matrix(right["v"].combine_chunks())[order]
            asks, q = left["query"].to_numpy(), _matrix(left["q"].combine_chunks())
            least = np.nan_to_num(left["worst"].to_numpy(), nan=-np.inf)  # nothing under it can be among the nearest
            for s in range(0, len(asks), 256):
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = q[s : s + 256] @ v.T
                scores[np.isnan(scores)] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                top = np.take_along_axis(scores, best, 1)
                good = top >= least[s : s + 256, None]
                out[0].append(np.repeat(asks[s : s + 256], good.sum(1)))
                out[1].append(ids[best][good])
                out[2].append(ties[best][good])
                out[3].append(top[good])
        cols = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("query", "rep", "least", "score"), map(pa.array, cols), strict=True)))

    def visit(state: DataFrame, skip: int, most: int) -> DataFrame:
        """What the queries find in the next cells: blocks of queries meet blocks of a cell's vectors, so neither side of a group grows."""
        visits = materialise(state.mapInArrow(plan(skip, most), "query long, q array<double>, worst double, cell long"))
        deal = np.ones(n_cells, np.int64)
        for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MOST_CELLS rows
            deal[r["cell"]] = -(-r["n"] // QUERY_ROWS)
        of = lambda table: F.get(F.array(*map(F.lit, table.tolist())), F.col("cell").cast("int"))
        part = F.pmod(F.xxhash64("query"), of(deal)).alias("part")
        block = F.explode(F.sequence(F.lit(0).cast("long"), of(blocks) - 1)).alias("block")
        left = visits.select("query", "q", "worst", "cell", part, block)
        right = held.select("rep", "least", "v", "cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), of(deal) - 1)).alias("part"))
        keys = ("cell", "block", "part")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(verify, "query long, rep long, least long, score double")

    found = None
    state = queries.select("rep", "v", F.lit(float("nan")).alias("worst"))
    skip, most = 0, FIRST_VISITS
    while skip < n_cells:
        hits = visit(state, skip, most)
        found = hits if found is None else found.unionByName(hits)
        found = found.withColumn("place", F.expr("row_number() over (partition by query order by score desc, least, rep)")).where(f"place <= {k + 1}").drop("place")
        found = materialise(found)
        worst = found.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(float("nan"))).alias("worst"))
        state = queries.join(worst, queries["rep"] == worst["query"], "left").select("rep", "v", F.coalesce("worst", F.lit(float("nan"))).alias("worst"))
        skip, most = skip + most, MORE * most
    alike = asked.join(queries.withColumnRenamed("rep", "query"), "v").select("query", "asker", "query_id")
    each = alike.join(found.select("query", "rep", "score"), "query").join(members.select("rep", "_row", "vec_id"), "rep").where("asker != _row")
    ranked = each.withColumn("rank", F.expr("row_number() over (partition by asker order by score desc, vec_id, _row)"))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
