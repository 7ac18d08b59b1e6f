"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import corpus_pipeline as C
from alignlake.llm import near


def shingles(t):
    w = (t or "").encode().lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) > 0


def components(sets):
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = top(i), top(j)
            if a != b and alike(sets[i], sets[j]):
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def corpus():
    """Groups of near copies of one text and chains of copies of copies, whose ends are not alike."""
    rnd = random.Random(4)
    out = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "A b c d e"]
    for g in range(12):
        words = [f"g{g}w{rnd.randrange(10_000)}" for _ in range(rnd.choice([30, 120, 400]))]
        chain = words
        for _ in range(12):
            near_copy = list(words)
            for _ in range(max(1, len(words) // 60)):
                near_copy[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
            chain = list(chain)
            chain[rnd.randrange(len(chain))] = f"c{rnd.randrange(10**6)}"
            out += [" ".join(words), " ".join(near_copy).upper(), "  ".join(chain)]
    rnd.shuffle(out)
    return out


def test_stage_equals_brute_force(spark):
    texts = corpus()
    sets = list(map(shingles, texts))
    want = components(sets)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_components(frame).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {r.doc_id for r in C.simhash_dedup(spark, frame, "").collect()} == set(want)
    assert C.simhash_dedup(spark, frame.where("false"), "").count() == 0
