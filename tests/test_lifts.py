"""Trees by doubled links against plain loops: random trees, forests, chains, unlisted roots."""

import hashlib
import random

import pytest

from alignlake.operators import lifts, trees
from alignlake.plans import phylogeny

SCHEMA = "node string, parent string, branch_len long"


def tree(n, seed, reach):
    rnd = random.Random(seed)
    return {"n0": (None, None)} | {f"n{i}": (f"n{rnd.randrange(max(0, i - reach), i)}", rnd.randrange(9)) for i in range(1, n)}


def above(nodes, x):
    """The node and its ancestors with distances."""
    out, d = [(x, 0)], 0
    while nodes.get(x, (None,))[0] is not None:
        d += nodes[x][1]
        x = nodes[x][0]
        out.append((x, d))
    return out


def frame(spark, nodes):
    return spark.createDataFrame([(k, *v) for k, v in nodes.items()], SCHEMA)


@pytest.mark.parametrize("reach", [2, 60])
def test_random_trees(spark, reach):
    nodes = tree(120, reach, reach) | {"m0": (None, None), "m1": ("m0", 4)}
    t = frame(spark, nodes)
    up = {x: above(nodes, x) for x in nodes}
    assert {r.node: (r.root, r.depth, r.depth_len) for r in lifts.depths(t).collect()} == {x: (a[-1][0], len(a) - 1, a[-1][1]) for x, a in up.items()}
    below = {}
    for x, a in up.items():
        for y, d in a[1:]:
            below.setdefault(y, []).append((x, d))
    assert {r.node: (r.n_below, r.farthest) for r in lifts.descendants(t).collect()} == {y: (len(b), max(d for _, d in b)) for y, b in below.items()}
    leaves = {x for x in nodes} - {p for p, _ in nodes.values()}
    want = {y: frozenset(x for x, _ in b if x in leaves) for y, b in below.items()}
    got = lifts.leaf_sets(t).collect()
    assert {r.node: r.n_leaves for r in got} == {y: len(s) for y, s in want.items()}
    assert len({r.clade for r in got}) == len(set(want.values())) and len({(r.clade, want[r.node]) for r in got}) == len(set(want.values()))
    rnd = random.Random(1)
    groups = {g: rnd.sample(sorted(nodes), rnd.choice([1, 2, 3, 20])) for g in range(25)} | {25: ["n5", "nowhere"]}
    members = spark.createDataFrame([(g, x) for g, m in groups.items() for x in m], "grp long, node string")
    expected = set()
    for g, m in groups.items():
        if all(x in nodes for x in m):
            common = [y for y, _ in up[m[0]] if all(y in dict(up[x]) for x in m)]
            if common:
                expected |= {(g, x, common[0], dict(up[x])[common[0]]) for x in m}
    assert {tuple(r) for r in lifts.common_ancestors(t, members).collect()} == expected
    assert {r.node for r in lifts.path_to_root(t, "n77").collect()} == {y for y, _ in up["n77"]}


def test_chain_of_a_hundred_thousand(spark):
    """A caterpillar has n * n / 2 pairs of nodes and ancestors; no table here has more than n rows."""
    n = 100_000
    t = spark.range(n).selectExpr("id as node", "case when id > 0 then id - 1 end as parent", "case when id > 0 then 1L end as branch_len")
    reach = lifts.levels(t)
    assert len(reach) == 17 and all(step.count() <= n for step in reach)
    assert lifts.depths(t, reach).agg({"depth": "max"}).first()[0] == n - 1
    assert lifts.descendants(t, reach).where("n_below = farthest and n_below = 99999 - node").count() == n - 1


def test_cycles_and_unlisted_roots(spark):
    with pytest.raises(ValueError, match="cycle"):
        lifts.levels(spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], SCHEMA))
    loop = spark.createDataFrame([("a", "b", None, 0), ("b", "a", None, 0), ("r", None, "r", None)], "node string, parent string, name string, branch_len long")
    with pytest.raises(ValueError, match="cycle"):
        trees.tidy(loop)
    t = spark.createDataFrame([("a", "top", 1), ("b", "top", 2)], SCHEMA)
    assert [(r.node, r.n_leaves) for r in lifts.leaf_sets(t).collect()] == [("top", 2)]
    assert lifts.descendants(t).first().farthest == 2
    assert lifts.depths(t.where("false")).count() == 0


def test_rows_take_the_names_of_the_other_tree(spark):
    a = spark.createDataFrame([("x", "p", 1), ("y", "p", 1), ("p", "r", 1), ("z", "r", 1), ("r", None, None)], SCHEMA)
    b = spark.createDataFrame([("x", "q", 1), ("y", "q", 1), ("q", "s", 1), ("z", "s", 1), ("s", None, None)], SCHEMA)
    rows = spark.createDataFrame([("p", 1), ("r", 2), ("x", 3), ("other", 4)], "name string, id long")
    got = trees.rename_by_map(rows, trees.topology_map(a, b))
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "q"), (2, "s"), (3, "x"), (4, "other")]


def test_a_name_must_be_unique(spark):
    nodes = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "node string, name string")
    ask = lambda *n: trees.find_unique(nodes, spark.createDataFrame([(x,) for x in n], "name string")).collect()
    assert [(r.name, r.node) for r in ask("a")] == [("a", "1")]
    for wrong in ("b", "c"):
        with pytest.raises(Exception, match="not just one node"):
            ask("a", wrong)


@pytest.mark.parametrize("piece", [7, lifts.PIECE])
def test_leaf_lists_digest_the_sorted_names(spark, piece):
    nodes = tree(150, 9, 5) | {"é0": (None, None), "é1": ("é0", 1), "z": ("é0", 1), "Z": ("é0", 1), "alone": (None, None)}
    leaves = {x for x in nodes} - {p for p, _ in nodes.values()}
    below = {}
    for x in leaves:
        for y, _ in above(nodes, x)[1:]:
            below.setdefault(y, []).append(x)
    want = {y: (len(b), hashlib.md5(",".join(sorted(b)).encode()).hexdigest()) for y, b in below.items()}
    got = lifts.leaf_lists(frame(spark, nodes).repartition(3), piece=piece).collect()
    assert {r.node: (r.n_leaves, r.clade) for r in got} == want and len(got) == len(want)


def test_query_of_leaf_sets_digests_names_not_sums(spark):
    path = "/root/testdata/sf0.001"
    customers = {r[0] for r in spark.read.parquet(f"{path}/customer.parquet").select("c_custkey").collect()}
    orders = spark.read.parquet(f"{path}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    below = {}
    for c, o in orders:
        below.setdefault(f"c{c}", []).append(f"o{o}")
    got = {r.node: (r.n_leaves, r.clade) for r in phylogeny.t3_leaf_sets(spark, path).collect()}
    for c in {f"c{x}" for x in customers} & set(below):
        assert got[c] == (len(below[c]), hashlib.md5(",".join(sorted(below[c])).encode()).hexdigest())
