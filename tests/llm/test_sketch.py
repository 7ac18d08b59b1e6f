"""Fast similarity sketches, and the near-duplicates found with them against brute force."""

import random

import numpy as np

from alignlake.llm import near, sketch


def test_every_place_fills_and_agreement_estimates_similarity():
    rng = np.random.default_rng(8)
    for n in (1, 2, 17, 252, 3000):
        assert (sketch.sketch(rng.integers(0, 1 << 63, n, dtype=np.uint64)) != np.iinfo(np.uint64).max).all()
    assert sketch.bands(np.empty(0, np.uint64)) == []
    off = []
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        b = a.copy()
        b[:40] = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        off.append(np.mean(sketch.sketch(a) == sketch.sketch(b)) - 260 / 340)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def test_rounds_left_out_change_nothing():
    """The sketch is the least (round, value) over all rounds, hashed ones and fixed ones."""
    found = np.random.default_rng(9).integers(0, 1 << 63, 40, dtype=np.uint64)
    places = sketch.COORDINATES
    least = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    for r in range(2 * places):
        h = sketch.combine(found, np.broadcast_to(sketch._ROUND[r], found.shape))
        place = ((h & sketch._LOW) * np.uint64(places) >> sketch._HALF).astype(np.int64) if r < places else np.full(len(h), r - places)
        np.minimum.at(least, place, (np.uint64(r) << sketch._HALF) | (h >> sketch._HALF))
    assert (least == sketch.sketch(found)).all()


def shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in groups[top(i)] if x is not None]
        least = min(known) if known else None
        out.append((d, len(sets[i]), least, d is not None and d == least))
    return sorted(map(repr, out))


def corpus():
    """Chains of copies of copies, similarities on both sides of 0.85, one hot group, and odd rows."""
    rnd = random.Random(10)
    rows = [None, "", " \n\t", "one", "One", "a b c d", "A b c d", "a b c d e", "Ä b c d e", "ä b c d e"]
    for g in range(10):
        words = [f"g{g}w{rnd.randrange(10_000)}" for _ in range(rnd.choice([12, 60, 300]))]
        chain = list(words)
        for _ in range(14):
            copy = list(words)
            for _ in range(rnd.randrange(1, 2 + len(words) // 40)):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(10**6)}"
            chain = list(chain)
            chain[rnd.randrange(len(chain))] = f"c{rnd.randrange(10**6)}"
            rows += [" ".join(copy).upper(), "  ".join(chain)]
    base = [f"hot{i}" for i in range(100)]
    for _ in range(150):
        copy = list(base)
        for i in rnd.sample(range(100), rnd.randrange(3)):
            copy[i] = f"h{rnd.randrange(10**6)}"
        rows.append(" ".join(copy))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus()
    rows += [(None, rows[40][1]), (None, "nobody else"), (None, None), rows[3], (5, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.minhash_components(docs).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == plain(rows)
    assert near.minhash_components(docs.where("false")).count() == 0


def test_long_text_and_its_near_copy(spark):
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(200_000)]
    other = list(words)
    for i in range(0, len(other), 400):
        other[i] = "x"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.minhash_components(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_keep_one_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (None, "z", 3, "z")], "doc_id long, text string, _row long, node string")
    got = near.keep_one(docs)
    assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, docs.where("doc_id = 1 or doc_id is null").collect()))
