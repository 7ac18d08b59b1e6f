"""Bracket families in blocks against a stack, words in overlapping pieces, interval bins."""

import random

from alignlake.operators import brackets as B
from alignlake.operators import sequences as S
from alignlake.operators import windows as X


def plain(text, families):
    """Pairs and, for each family, lowest depth and depth at the end."""
    pairs, ends = [], {}
    for f in families:
        stack, depth, low = [], 0, 0
        for i, c in enumerate(text):
            if c == f[0]:
                stack.append(i)
                depth += 1
            elif c == f[1]:
                depth -= 1
                if stack:
                    pairs.append((f, stack.pop(), i))
            low = min(low, depth)
        ends[f] = (low, depth)
    return pairs, ends


def test_blocks_equal_a_stack(spark):
    rnd = random.Random(14)
    families = (*B.FAMILIES, "Aa", "Zz")
    texts = {i: "".join(rnd.choice("<>()[]{}AaZz...") for _ in range(n)) for i, n in enumerate([0, 1, 6, 7, 8, 50, 400])}
    texts[7] = "(" * 40 + "<" * 9 + ")" * 40 + ">" * 9
    texts[8] = ")" * 20 + "(" * 20 + ")" * 5
    frame = spark.createDataFrame([*texts.items(), (99, None)], "id long, text string")
    got = sorted((r.id, r.family, r.lcol, r.rcol) for r in B.match(frame, families, 7).collect())
    assert got == sorted((i, *p) for i, t in texts.items() for p in plain(t, families)[0])
    wrong = {(r.id, r.family): (r.lowest, r.final) for r in B.faults(frame, families, 7).collect()}
    want = {(i, f): e for i, t in texts.items() for f, e in plain(t, families)[1].items() if e[0] < 0 or e[1]}
    assert wrong == want


def test_ten_million_marks_over_many_tasks(spark):
    n = 2_500_000
    frame = spark.createDataFrame([(1,)], "id long").selectExpr("id", f"concat(repeat('(', {n}), repeat('[]', {n}), repeat(')', {n})) as text")
    found = B.match(frame)
    counts = {r.family: r["count"] for r in found.groupBy("family").count().collect()}
    assert counts == {"()": n, "[]": n}
    assert found.where("family = '()' and lcol + rcol != 9999999").isEmpty() and found.where("family = '[]' and rcol != lcol + 1").isEmpty()
    assert B.faults(frame).isEmpty()


def test_words_of_pieces(spark):
    rnd = random.Random(15)
    seqs = [(str(i), "".join(rnd.choice("ab") for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 9, 10, 11, 40])]
    got = S.words(spark.createDataFrame(seqs, "seq_id string, seq string"), 3, 5).collect()
    assert sorted((r.seq_id, r["at"], r.word) for r in got) == sorted((i, j, s[j : j + 3]) for i, s in seqs for j in range(len(s) - 2))


def test_stems_along_their_centre(spark):
    pairs = [("x", 0, 20), ("x", 1, 19), ("x", 2, 18), ("x", 4, 16), ("x", 5, 15), ("x", 7, 30), ("y", 0, 20)]
    got = S.stems(spark.createDataFrame(pairs, "id string, lcol long, rcol long")).collect()
    assert sorted((r.id, r.l0, r.l1, r.r0, r.r1, r.n) for r in got) == [("x", 0, 2, 18, 20, 3), ("x", 4, 5, 15, 16, 2)]


def test_bins_find_the_parents_that_contain(spark):
    rnd = random.Random(16)
    spans = lambda n, most: [(rnd.choice("ab"), i, s := rnd.randrange(1000), s + rnd.randrange(most)) for i in range(n)]
    children, parents = spans(200, 30), spans(120, 300)
    schema = "key string, id long, start long, end long"
    got = X.link_parents(spark.createDataFrame(children, schema), spark.createDataFrame(parents, schema)).collect()
    want = {(k, i): min((p for q, p, a, b in parents if q == k and a <= s and e <= b), default=None) for k, i, s, e in children}
    assert {(r.key, r.id): r.parent for r in got} == want


def test_a_million_features_of_one_sequence(spark):
    """A child meets the parents of a few bins, not all of its sequence."""
    parents = spark.range(1_000_000).selectExpr("'s' as key", "id", "id * 10 as start", "id * 10 + 9 as end")
    children = spark.range(1_000_000).selectExpr("'s' as key", "id", "id * 10 + 2 as start", "id * 10 + 5 as end")
    assert X.link_parents(children, parents).where("parent = id").count() == 1_000_000
