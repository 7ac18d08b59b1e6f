"""Nearest neighbours through a tree of many cells, and with vectors of extreme length."""

import numpy as np

from alignlake.llm import nearest

SCHEMA = "vec_id long, embedding array<double>"


def exact(rows, k=20, every=20):
    out = {}
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    for a, q in enumerate(ids.tolist()):
        if q % every == 0:
            with np.errstate(over="ignore", invalid="ignore"):
                s = v @ v[a]
            s[np.isnan(s)] = -np.inf
            out[q] = [ids[b] for b in np.lexsort((ids, -s)) if b != a][:k]
    return out


def found(spark, rows, **how):
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, SCHEMA), **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, width)) * 2
    return [(i, (centres[rng.integers(25)] + 0.3 * rng.standard_normal(width)).tolist()) for i in range(n)]


def test_thirty_cells_keep_recall(spark, monkeypatch):
    rows = clustered(1500, 12, 1)
    made = []
    build = nearest.build_tree
    monkeypatch.setattr(nearest, "build_tree", lambda *a: made.append(build(*a)) or made[-1])
    got, want = found(spark, rows, cell_rows=50), exact(rows)
    assert len(made[0]) + 1 == 30
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.97 * 20 * len(want)
    assert sum(got[q][0] == want[q][0] for q in want) >= 0.97 * len(want)


def test_every_cell_holds_the_points_it_is_located_in():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((2000, nearest.DIMS))
    nodes = nearest.build_tree(points, 30)
    cells = nearest.locate(nodes, points)
    assert set(cells.tolist()) == set(range(len(nodes) + 1)) and np.bincount(cells).max() < 4 * len(points) / 30


def test_vectors_too_long_to_be_squared(spark):
    rows = clustered(300, 4, 3)
    for extra in ([(1001, [1e200, 0.0, 0.0, 0.0])], [(1000, [1e200, -1e160, 1.0, 0.0]), (1003, [-1e308, 0.0, 0.0, 0.0]), (1020, [5e-324, 0.0, 0.0, 0.0])]):
        assert found(spark, rows + extra, cell_rows=30) == exact(rows + extra)
    huge = [(i * 20, [1e170 * (i + 1), -1e165, 0.0]) for i in range(5)]
    assert found(spark, huge) == exact(huge)


def test_long_but_square_vectors_stay_exact(spark):
    rows = clustered(300, 4, 4) + [(2000, [1e100, 0.0, 0.0, 0.0])]
    assert found(spark, rows, cell_rows=30) == exact(rows)
