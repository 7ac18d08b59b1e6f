"""Tree and tree-alignment operators against plain loops and worked answers."""

import random

from alignlake.operators import plug, trees
from alignlake.operators.alignment import BLOCK, number_residues, renumber, to_cells
from alignlake.operators.compare import compare_alignments, runs_of
from alignlake.operators.windows import nearest_values, value_centroid


def tidy(nodes):
    """``{node: [parent, name, length]}`` by the rules, one step at a time."""
    nodes = {k: list(v) for k, v in nodes.items()}

    def kids(n):
        return [k for k, v in nodes.items() if v[0] == n]

    while True:
        before = len(nodes)
        for n in [n for n, v in nodes.items() if v[0] is not None and not v[2]]:
            for k in kids(n):
                nodes[k][0] = nodes[n][0]
            del nodes[n]
        for n in [n for n, v in nodes.items() if v[0] is not None and len(kids(n)) == 1]:
            (k,) = kids(n)
            nodes[k][0], nodes[k][2] = nodes[n][0], (nodes[k][2] or 0) + (nodes[n][2] or 0)
            del nodes[n]
        for n in [n for n, v in nodes.items() if not kids(n) and not v[1]]:
            del nodes[n]
        if len(nodes) == before:
            return {k: tuple(v) for k, v in nodes.items()}


def test_tidy_equals_a_plain_loop(spark):
    rnd = random.Random(3)
    for _ in range(3):
        nodes = {0: (None, "root", None)}
        for i in range(1, 60):
            nodes[i] = (rnd.randrange(max(0, i - 6), i), rnd.choice([None, "", f"x{i}", f"x{i}"]), rnd.choice([None, 0, 1, 2, 3]))
        frame = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node int, parent int, name string, branch_len long")
        got = {r.node: (r.parent, r["name"], r.branch_len) for r in trees.tidy(frame).collect()}
        assert got == tidy(nodes)


def test_indels_of_a_branch(spark):
    rows = spark.createDataFrame([("a", 0, "p", "ACGT-A"), ("a", 1, "c", "A--TGA")], "aln_id string, row_no int, name string, gapped string")
    tree = spark.createDataFrame([("a", "p", None, None), ("a", "c", "p", 0.5)], "aln_id string, node string, parent string, branch_len double")
    got = trees.indel_stats(to_cells(rows), tree).first()
    assert (got.matches, got.delete_runs, got.delete_len, got.insert_runs, got.insert_len) == (3, 1, 2, 1, 1)
    assert (got.delete_rate, got.insert_rate, got.delete_extend, got.insert_extend) == (0.5, 0.5, 0.5, 0.0)


def test_comparison_of_two_alignments(spark):
    make = lambda a, b: to_cells(spark.createDataFrame([("x", 0, "s1", a), ("x", 1, "s2", b)], "aln_id string, row_no int, name string, gapped string"))
    got = compare_alignments(make("AC-G", "A-CG"), make("ACG", "ACG")).first()
    assert (got.pairs_a, got.pairs_b, got.pairs_both, got.cols_a, got.cols_both, got.gaps_both) == (2, 3, 2, 4, 2, 0)
    assert got.sps == 1 and round(got.ppv, 6) == round(2 / 3, 6) and got.tcs == 0.5 and round(got.ama, 6) == round(2 / 3, 6)
    assert compare_alignments(make("AC-G", "A-CG"), make("AC-G", "A-CG")).first().ama == 1


def test_long_rows_are_numbered_over_blocks(spark):
    n = 3 * BLOCK + 5
    cells = spark.range(n).selectExpr("'a' as aln_id", "0 as row_no", "'r' as name", "cast(id * 2 as int) as col", "if(id % 3 = 0, '-', 'x') as ch", "id % 3 = 0 as is_gap")
    got = renumber(cells)
    last = got.orderBy("col").tail(1)[0]
    residues = sum(i % 3 != 0 for i in range(n))
    assert got.agg({"col": "max"}).first()[0] == n - 1 and got.where("not is_gap").agg({"pos": "max"}).first()[0] == residues - 1
    assert last.col == n - 1 and number_residues(cells).where("pos = 70000").count() == 1
    kinds = spark.range(n).selectExpr("'a' as aln_id", "cast(id as int) as col", "if(id < 10, 'p', 'q') as kind")
    assert [(r.run, r.kind, r.start, r.stop, r.n) for r in runs_of(kinds, "kind").orderBy("run").collect()] == [(1, "p", 0, 9, 10), (2, "q", 10, n - 1, n - 10)]


def test_leaders_equal_a_plain_loop(spark):
    rnd = random.Random(4)
    value = [rnd.random() for _ in range(50)]
    pairs = [("g", i, j, 1 - abs(value[i] - value[j])) for i in range(50) for j in range(i + 1, 50)]
    leader = {}
    for i in range(50):
        if i not in leader:
            leader |= {j: i for j in range(i, 50) if j not in leader and (i == j or 1 - abs(value[i] - value[j]) > 0.9)}
    items = spark.createDataFrame([("g", i) for i in range(50)], "grp string, i int")
    got = plug.leader_cluster(items, spark.createDataFrame(pairs, "grp string, i int, j int, s double"), 0.9)
    assert {r.i: r.leader for r in got.collect()} == leader
    assert plug.leader_cluster(items.where("false"), spark.createDataFrame(pairs, "grp string, i int, j int, s double"), 0.9).count() == 0


def test_sorted_values_give_what_pairs_give(spark):
    rnd = random.Random(6)
    rows = [(g, i, float(rnd.choice([1, 2, 2, 2, 5, 9, rnd.randrange(30)]))) for g in "ab" for i in range(25)] + [("c", 0, 1.0)]
    items = spark.createDataFrame(rows, "grp string, i int, v double")
    want, means = set(), {}
    for g, i, v in rows:
        others = sorted((abs(v - w), j) for h, j, w in rows if h == g and j != i)
        want |= {(g, i, j, d, k + 1) for k, (d, j) in enumerate(others[:3])}
        means.setdefault(g, []).append((round(sum(d for d, _ in others), 4), i, len(others) + 1))
    assert {(r.grp, r.i, r.j, r.d, r.place) for r in nearest_values(items, 3).collect()} == want
    best = {g: min(m) for g, m in means.items() if g != "c"}
    assert {r.grp: (r.i, r["mean"]) for r in value_centroid(items).collect()} == {g: (i, round(t / n, 6)) for g, (t, i, n) in best.items()}
