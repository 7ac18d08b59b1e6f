"""Vector codes against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np

from alignlake.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """Rows (vec_id, vector, label), all usable and of one length -> ({row number: (code, error)}, codebooks' digest)."""
    whole = lambda x: int(x) * 4096 if abs(x) >= 2**53 else math.floor(x * 4096)
    vectors = [[whole(x) for x in v] for _, v, _ in rows]
    width = len(vectors[0])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    codes_, errors = [""] * len(rows), [0] * len(rows)
    numbers = []
    for p in range(parts):
        a, b = p * width // parts, (p + 1) * width // parts
        part = [v[a:b] for v in vectors]
        book = [part[i] for i in order]
        near = lambda x: min((sum((s - t) ** 2 for s, t in zip(x, c)), i) for i, c in enumerate(book))
        for _ in range(rounds):
            own = [near(x)[1] for x in part]
            new = list(book)
            for e in set(own):
                members = [x for x, o in zip(part, own) if o == e]
                new[e] = [sum(c) // len(members) for c in zip(*members)]
            book = new
        for i, x in enumerate(part):
            d, e = near(x)
            codes_[i] += f"{e:02x}"
            errors[i] += d
        numbers += [c for entry in book for c in entry]
    return list(zip(codes_, errors)), hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def same(spark, rows, **how):
    got = codes.compress(spark.createDataFrame(rows, SCHEMA), **how).collect()
    want, digest = plain(rows, **how)
    assert {r.codebooks_sha256 for r in got} == {digest}
    fit = lambda e: e if e is not None and e < 1 << 63 else None
    sums = {}
    for (_, _, label), (_, e) in zip(rows, want):
        sums[label] = None if fit(e) is None or sums.get(label, 0) is None else sums.get(label, 0) + e
    expected = sorted(repr((i, label, c, fit(e), fit(sums[label]))) for (i, _, label), (c, e) in zip(rows, want))
    assert sorted(repr((r.vec_id, r.label, r.code, r.error, r.label_error)) for r in got) == expected


def vectors(n, width, seed, centres=5):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i * 3, [m + rnd.gauss(0, 0.2) for m in rnd.choice(middle)], rnd.choice([None, 1, 2])) for i in range(n)]


def test_equals_plain_rounds(spark):
    same(spark, vectors(300, 16, 1))


def test_ties_copies_few_rows_and_odd_lengths(spark):
    rnd = random.Random(2)
    grid = [(i // 2, [rnd.choice([-0.5, 0.0, 0.5]) for _ in range(11)], i % 3) for i in range(80)]
    same(spark, grid + grid)
    same(spark, [(None, [1.0] * 8, None), (4, [2.0, -2.0] * 4, None), (4, [1.5] * 8, 7)])
    same(spark, [(1, [], 1), (2, [], None)])


def test_huge_components_stay_exact(spark):
    rows = vectors(40, 8, 3)
    rows[7] = (21, [1e200, -1e200, 3e18, 0.1, -7.0, 1e308, 5e-324, -0.0], 1)
    rows[8] = (24, [1e6] * 8, 2)
    same(spark, rows)


def test_unusable_rows_and_lengths_apart(spark):
    rows = vectors(30, 8, 4)
    odd = [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 1)]
    short = [(1, [0.25, 0.5], 1), (2, [0.5, 0.75], 2)]
    got = codes.compress(spark.createDataFrame(rows + odd + short, SCHEMA)).collect()
    assert len(got) == len(rows) + len(short)
    for part in (rows, short):
        want, digest = plain(part)
        mine = [r for r in got if r.codebooks_sha256 == digest]
        assert sorted((r.vec_id, r.code, r.error) for r in mine) == sorted((i, c, e) for (i, _, _), (c, e) in zip(part, want))
    ones = [r for r in got if r.label == 1]
    assert {r.label_error for r in ones} == {sum(r.error for r in ones)}
    empty = codes.compress(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_bounds_spare_work_and_never_change_the_answer():
    """Many drifting rounds, with few and with many entries kept; what the bounds decide equals a full search."""
    rng = np.random.default_rng(5)
    x = codes.whole(rng.normal(0, 1, (4000, 16)) + rng.integers(-3, 4, (4000, 1)), False)
    ends = codes.cuts(16)
    for first in (1, 2, 6):
        books = [x[:16, ends[p] : ends[p + 1]].copy() for p in range(8)]
        kept = moved = None
        b, looked = first, []
        for step in range(8):
            now = (first, 4, 1, 6)[step % 4]
            kept, seen = codes.assign(x, books, ends, kept, moved, now)
            looked.append(seen)
            for p in range(8):
                part = x[:, ends[p] : ends[p + 1]]
                d = ((part[:, None] - books[p][None]) ** 2).sum(-1)
                assert (kept["entry"][:, p] == d.argmin(1)).all()
                assert (kept["upper"][:, p].astype(float) >= np.sqrt(d.min(1))).all()
            new = [np.array([part_.mean(0).astype(np.int64) if len(part_ := x[kept["entry"][:, p] == e][:, ends[p] : ends[p + 1]]) else books[p][e] for e in range(16)]) for p in range(8)]
            moved = [np.sqrt(((a - c) ** 2).sum(-1)) * (1 + 1e-12) for a, c in zip(new, books)]
            books = new
        assert looked[-1][0] > sum(looked[-1]) / 2  # most parts look at no entry but their own
