"""Tree tables ``(node, parent, branch_len)``: common ancestors, paths, re-rooting, attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignlake.operators.compare import runs_of
from alignlake.operators.lifts import leaf_sets, path_to_root
from alignlake.operators.sequences import ancestors, leaves
from alignlake.scratch import materialise


def lineage(nodes: DataFrame) -> DataFrame:
    """Every node with its ancestors and itself, and the distance to each."""
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hops"), F.lit(0).cast("bigint").alias("distance"))
    return ancestors(nodes).unionByName(own)


def reroot(nodes: DataFrame, root: str) -> DataFrame:
    """The tree with ``root`` on top: the links between it and the old root turn round, all others stay."""
    path = path_to_root(nodes, root)
    turned = nodes.join(path, "node", "left_semi").where("parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("parent"), "branch_len")
    top = nodes.where(F.col("node") == root).select("node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast(nodes.schema["branch_len"].dataType).alias("branch_len"))
    return nodes.join(path, "node", "left_anti").select("node", "parent", "branch_len").unionByName(turned).unionByName(top)


def unattached(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names that only rows or only tree nodes have."""
    a, b = rows.select("name").distinct(), nodes.select(F.col("node").alias("name")).distinct()
    return a.join(b, "name", "left_anti").withColumn("side", F.lit("row")).unionByName(b.join(a, "name", "left_anti").withColumn("side", F.lit("node")))


def sites_needed(nodes: DataFrame, events: float, error: float) -> DataFrame:
    """Training sites for a fractional ``error`` at the ``events`` rate of the slowest event."""
    return nodes.agg(F.round(1 / (events * error * error * F.sum("branch_len")), 12).alias("sites"))


def inner_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with children, how many, and the smallest of them."""
    return nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.min("node").alias("first_child"))


def siblings(nodes: DataFrame) -> DataFrame:
    """How many other children a node's parent has (none for the root)."""
    n = nodes.where("parent is not null").groupBy("parent").agg((F.count("*") - 1).alias("n_siblings"))
    return nodes.join(n, "parent", "left").select("node", F.coalesce("n_siblings", F.lit(0)).alias("n_siblings"))


def clade_support(clades: DataFrame) -> DataFrame:
    """``clades(tree, clade)`` of sampled trees -> the share of trees that have each clade."""
    n = clades.select("tree").distinct().agg(F.count("*").alias("n_trees"))
    each = clades.groupBy("clade").agg(F.countDistinct("tree").alias("n"))
    return each.crossJoin(F.broadcast(n)).select("clade", "n", F.round(F.col("n") / F.col("n_trees"), 9).alias("support"))  # one row by construction


def topology_map(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner nodes of two trees that have the same leaves below them: ``(node_a, node_b, clade)``, null where one lacks it.

    The topologies are the same if no null shows up.
    """
    x, y = leaf_sets(a).select(F.col("node").alias("node_a"), "clade"), leaf_sets(b).select(F.col("node").alias("node_b"), "clade")
    return x.join(y, "clade", "full").select("node_a", "node_b", "clade")


def rename_by_map(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """Rows named after the nodes of one tree, renamed after those that ``topology_map`` has for them in the other; other names stay."""
    to = mapped.where("node_a is not null and node_b is not null").select(F.col("node_a").alias("name"), "node_b")
    return rows.join(to, "name", "left").withColumn("name", F.coalesce("node_b", "name")).drop("node_b")


def find_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes by ``names(name)``, how many have each name and whether it is just one."""
    n = names.distinct().join(nodes.select(F.col("name"), "node"), "name", "left")
    return n.groupBy("name").agg(F.count("node").alias("n"), F.min("node").alias("node")).withColumn("unique", F.col("n") == 1)


def find_unique(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, node)``; a name that no node or more than one has is an error when the rows are computed."""
    wrong = F.concat(F.lit("not just one node is named "), "name")
    return find_nodes(nodes, names).select("name", F.when(F.col("unique"), F.col("node")).otherwise(F.raise_error(wrong)).alias("node"))


def _skip(nodes: DataFrame, gone: DataFrame, add: bool) -> DataFrame:
    """``nodes`` without the ``gone(node)``: their children hang on the next node above that stays, with summed lengths if ``add``."""
    own = F.col("branch_len") if add else F.lit(0).cast(nodes.schema["branch_len"].dataType)
    rounds, most = 0, max(1, nodes.count()).bit_length() + 1
    jump = materialise(nodes.join(gone, "node", "left_semi").select(F.col("node").alias("via"), F.col("parent").alias("to"), own.alias("more")))
    while True:
        on = jump.select(F.col("via").alias("to"), F.col("to").alias("next"), F.col("more").alias("extra"))
        far = jump.join(on, "to", "left")
        if far.where("next is not null").isEmpty():
            break
        rounds += 1
        if rounds > most:
            raise ValueError("the parents of some nodes form a cycle")
        jump = materialise(far.select("via", F.coalesce("next", "to").alias("to"), (F.col("more") + F.coalesce("extra", F.lit(0))).alias("more")))
    left = nodes.join(gone, "node", "left_anti").join(jump.withColumnRenamed("via", "parent"), "parent", "left")
    return left.select("node", F.coalesce("to", "parent").alias("parent"), "name", (F.col("branch_len") + F.coalesce("more", F.lit(0))).alias("branch_len"))


def tidy(nodes: DataFrame) -> DataFrame:
    """``nodes(node, parent, name, branch_len)`` without empty branches, nodes of one child and unnamed leaves.

    Steps repeat until none removes a node: nodes below the root whose branch is zero or missing go, then those
    with one child (its branch grows), then leaves without name.  Each round's tree is written and read again.
    """
    now = materialise(nodes.select("node", "parent", "name", "branch_len"))
    while True:
        before = now.count()
        zero = now.where("parent is not null and coalesce(branch_len, 0) = 0").select("node")
        now = materialise(_skip(now, zero, False))
        single = now.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").select(F.col("parent").alias("node"))
        single = now.where("parent is not null").join(single, "node", "left_semi").select("node")
        now = materialise(_skip(now, single, True))
        unnamed = leaves(now).where("coalesce(name, '') = ''").select("node")
        now = materialise(now.join(unnamed, "node", "left_anti"))
        if now.count() == before:
            return now


def attach_tree(rows: DataFrame, nodes: DataFrame, prefix: str = "") -> DataFrame:
    """Rows with the node of their tree that has their name, once ``prefix`` (a pattern) is cut from the nodes' names."""
    bare = F.regexp_replace("node", f"^(?:{prefix})", "") if prefix else F.col("node")
    return rows.join(nodes.select("aln_id", bare.alias("name"), "node", "parent", "branch_len"), ["aln_id", "name"])


def _parents(cells: DataFrame, tree: DataFrame) -> DataFrame:
    """Cells of a node beside those of its parent, by ``tree(aln_id, node, parent, branch_len)``."""
    links = tree.where("parent is not null").select("aln_id", "node", "parent", "branch_len")
    child = cells.select("aln_id", F.col("name").alias("node"), "col", F.col("is_gap").alias("child_gap")).join(links, ["aln_id", "node"])
    return child.join(cells.select("aln_id", F.col("name").alias("parent"), "col", F.col("is_gap").alias("parent_gap")), ["aln_id", "parent", "col"])


def check_ancestry(cells: DataFrame, tree: DataFrame) -> DataFrame:
    """Gapped nodes with two or more children that have a residue in the column."""
    bad = _parents(cells, tree).where("parent_gap and not child_gap").groupBy("aln_id", "parent", "col").agg(F.count("*").alias("n_children"))
    return bad.where("n_children > 1").withColumnRenamed("parent", "node")


def indel_stats(cells: DataFrame, tree: DataFrame) -> DataFrame:
    """Matches, runs and lengths of deletions and insertions on each branch, with their rates and extension probabilities."""
    kind = F.when(F.col("child_gap"), "delete").when(F.col("parent_gap"), "insert").otherwise("match")
    steps = _parents(cells, tree).where("not (child_gap and parent_gap)").withColumn("kind", kind)
    runs = runs_of(steps, "kind", ("aln_id", "node"))
    of = lambda k, what: F.coalesce(F.sum(F.when(F.col("kind") == k, what)), F.lit(0)).cast("long")
    n = runs.groupBy("aln_id", "node").agg(of("match", F.col("n")).alias("matches"), *(of(k, w).alias(f"{k}_{x}") for k in ("delete", "insert") for x, w in (("runs", F.lit(1)), ("len", F.col("n")))))
    n = n.join(tree.select("aln_id", "node", "branch_len"), ["aln_id", "node"])
    room = (F.col("matches") + F.col("delete_runs")) * F.greatest("branch_len", F.lit(0.001))
    for k in ("delete", "insert"):
        n = n.withColumn(f"{k}_rate", F.round(F.when(room > 0, F.col(f"{k}_runs") / room), 9))
        n = n.withColumn(f"{k}_extend", F.round(F.when(F.col(f"{k}_len") > 0, 1 - F.col(f"{k}_runs") / F.col(f"{k}_len")), 9))
    return n


def indel_rates(stats: DataFrame) -> DataFrame:
    """A tree's rates as ratios of its branches' sums, extensions as plain means over branches with such indels."""
    room = F.sum((F.col("matches") + F.col("delete_runs")) * F.greatest("branch_len", F.lit(0.001)))
    each = [x for k in ("delete", "insert") for x in (F.round(F.sum(f"{k}_runs") / room, 9).alias(f"{k}_rate"), F.round(F.avg(F.when(F.col(f"{k}_runs") > 0, F.col(f"{k}_extend"))), 9).alias(f"{k}_extend"))]
    return stats.groupBy("aln_id").agg(*each)


def insertion_blocks(cells: DataFrame, tree: DataFrame) -> DataFrame:
    """``(aln_id, node, block, start, stop, n)``: columns by the node where their residues arise, cut where one of an ancestor stands between.

    A column arises at the node nearest the root that has a residue, the smallest of several.
    """
    key = lambda c: F.concat("aln_id", F.lit(":"), c)
    up = materialise(ancestors(tree.select(key("node").alias("node"), key("parent").alias("parent"), F.lit(1).alias("branch_len"))))
    depth = tree.select("aln_id", "node", key("node").alias("key")).join(up.groupBy(F.col("node").alias("key")).agg(F.max("hops").alias("depth")), "key", "left")
    depth = depth.select("aln_id", F.col("node").alias("name"), F.coalesce("depth", F.lit(0)).alias("depth"))
    arise = cells.where("not is_gap").join(depth, ["aln_id", "name"]).groupBy("aln_id", "col").agg(F.min(F.struct("depth", "name"))["name"].alias("kind"))
    runs = materialise(runs_of(arise, "kind").select("aln_id", F.col("kind").alias("node"), "start", "stop", "n"))
    used = runs.select("aln_id", "node").distinct().withColumn("key", key("node"))
    above = used.join(up.select(F.col("node").alias("key"), "ancestor"), "key").select("aln_id", F.col("node").alias("below"), F.substring_index("ancestor", ":", -1).alias("node"))
    cuts = runs.join(above, ["aln_id", "node"]).select("aln_id", F.col("below").alias("node"), "start", "stop", F.lit(0).cast("long").alias("n"), F.lit(1).alias("cut"))
    order = W.partitionBy("aln_id", "node").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    dealt = runs.withColumn("cut", F.lit(0)).unionByName(cuts).withColumn("part", F.sum("cut").over(order)).where("cut = 0")
    blocks = dealt.groupBy("aln_id", "node", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"))
    block = F.row_number().over(W.partitionBy("aln_id", "node").orderBy("start"))
    return blocks.select("aln_id", "node", block.alias("block"), "start", "stop", "n")
