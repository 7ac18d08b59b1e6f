"""Trees ``(node, parent, branch_len)`` of any depth: links of doubled reach instead of pairs of nodes and ancestors.

Level k links a node with its ancestor 2 ** k steps up, so a tree of n nodes and depth d takes at most n log d rows, each
level written and read again.  What is summed or compared over subtrees doubles its reach with the levels; common
ancestors are found by lifting, for sets of nodes of any size.  No row grows with the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignlake.scratch import drop, materialise, numbered


def levels(nodes: DataFrame) -> list[DataFrame]:
    """``(node, up, dist)`` for 1, 2, 4, ... steps up, as far as some node has such an ancestor; a cycle is an error."""
    out = [materialise(nodes.where("parent is not null").select("node", F.col("parent").alias("up"), F.col("branch_len").alias("dist")))]
    links = None
    while True:
        here = out[-1]
        on = here.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"))
        far = materialise(here.join(on, "up").select("node", F.col("next").alias("up"), (F.col("dist") + F.col("more")).alias("dist")))
        if far.isEmpty():
            drop(far)
            return out
        links = out[0].count() if links is None else links
        if 1 << len(out) > links:
            raise ValueError("the parents of some nodes form a cycle")
        out.append(far)


def depths(nodes: DataFrame, reach: list[DataFrame] | None = None) -> DataFrame:
    """``(node, root, depth, depth_len)`` of every node, roots included: links and summed length up to its root."""
    reach = levels(nodes) if reach is None else reach
    kind = nodes.schema["branch_len"].dataType
    now = nodes.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(0).cast(kind).alias("depth_len"))
    for k in range(len(reach) - 1, -1, -1):
        step = reach[k].select(F.col("node").alias("root"), "up", "dist")
        moved = now.join(step, "root", "left")
        far = F.col("up").isNotNull()
        last, now = now, materialise(moved.select(
            "node", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.when(far, 1 << k).otherwise(0)).alias("depth"), F.when(far, F.col("depth_len") + F.col("dist")).otherwise(F.col("depth_len")).alias("depth_len"),
        ))
        drop(last)
    return now


def _every(nodes: DataFrame) -> DataFrame:
    """All nodes, with parents that aren't listed themselves."""
    up = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct()
    return nodes.select("node").unionByName(up.join(nodes.select("node"), "node", "left_anti"))


def _over_subtrees(start: DataFrame, reach: list[DataFrame], found: list[Column], added: dict[str, Column]) -> DataFrame:
    """``start(node, ...)`` with each column joined by what the nodes below hold: ``found`` aggregates them, ``added`` combines."""
    now = start
    for step in reach:
        more = step.join(now, "node").groupBy(F.col("up").alias("node")).agg(*found)
        last, now = now, materialise(now.join(more, "node", "left").select("node", *(c.alias(n) for n, c in added.items())))
        drop(last)
    return now


def descendants(nodes: DataFrame, reach: list[DataFrame] | None = None) -> DataFrame:
    """``(node, n_below, farthest)`` of each inner node: nodes below it and the distance to the farthest of them."""
    reach = levels(nodes) if reach is None else reach
    start = _every(nodes).select("node", F.lit(0).cast("long").alias("n_below"), F.lit(None).cast(nodes.schema["branch_len"].dataType).alias("farthest"))
    far = F.greatest("dist", F.col("dist") + F.col("farthest"))
    found = [F.sum(F.col("n_below") + 1).alias("n_more"), F.max(far).alias("f_more")]
    out = _over_subtrees(start, reach, found, {"n_below": F.col("n_below") + F.coalesce("n_more", F.lit(0)), "farthest": F.greatest("farthest", "f_more")})
    return out.where("n_below > 0")


#: Parts of a leaf's digest that are summed up.
_PARTS = 4


def leaf_sets(nodes: DataFrame, reach: list[DataFrame] | None = None) -> DataFrame:
    """``(node, n_leaves, clade)`` of each inner node; ``clade`` digests the sums of its leaves' name digests, in parts of 32 bits."""
    reach = levels(nodes) if reach is None else reach
    inner = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct().withColumn("inner", F.lit(True))
    leaf = F.coalesce(F.col("inner"), F.lit(False)) == F.lit(False)
    part = lambda i: F.conv(F.substring(F.md5(F.col("node").cast("string")), 8 * i + 1, 8), 16, 10).cast("long")
    names = [f"p{i}" for i in range(_PARTS)]
    own = [F.when(leaf, part(i)).otherwise(0).alias(n) for i, n in enumerate(names)]
    start = _every(nodes).join(inner, "node", "left").select("node", F.when(leaf, 1).otherwise(0).cast("long").alias("n_leaves"), *own)
    every = ["n_leaves", *names]
    out = _over_subtrees(start, reach, [F.sum(c).alias(f"{c}_more") for c in every], {c: F.col(c) + F.coalesce(f"{c}_more", F.lit(0)) for c in every})
    return out.join(inner.select("node"), "node", "left_semi").select("node", "n_leaves", F.md5(F.concat_ws("-", *names)).alias("clade"))


#: Letters of sorted names that are joined into one row before the digest is taken.
PIECE = 1 << 18


def leaf_lists(nodes: DataFrame, reach: list[DataFrame] | None = None, piece: int = PIECE) -> DataFrame:
    """``(node, n_leaves, clade)`` of each inner node; ``clade`` is the MD5 of all its leaves' names, sorted and joined by commas.

    Every leaf meets every node above it.  The pairs are dealt and sorted by range, so a large node's names are sorted in many
    tasks; runs of them are joined into pieces, and only those pass, in order, through the digest of their node.
    """
    reach = levels(nodes) if reach is None else reach
    inner = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct()
    ends = nodes.select("node").where("node is not null").join(inner, "node", "left_anti")
    now = materialise(ends.select(F.col("node").cast("string").alias("leaf"), F.col("node").alias("at"), F.lit(False).alias("above")))
    for step in reach:
        far = now.join(step.select(F.col("node").alias("at"), "up"), "at").select("leaf", F.col("up").alias("at"), F.lit(True).alias("above"))
        last, now = now, materialise(now.unionByName(far))
        drop(last)
    kind = nodes.schema["node"].dataType.simpleString()
    pairs = now.where("above").select(F.col("at").alias("node"), "leaf").repartitionByRange("node", "leaf").sortWithinPartitions("node", "leaf")

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, node, size, seq, kept = [], None, 0, 0, None
        for part in parts:
            kept = part.schema.field(0).type
            for at, leaf in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if held and (at != node or size >= piece):
                    yield _piece(node, kept, held, seq)
                    held, size, seq = [], 0, seq + 1
                node = at
                held.append(leaf)
                size += len(leaf) + 1
        if held:
            yield _piece(node, kept, held, seq)

    pieces = materialise(pairs.mapInArrow(joined, f"node {kind}, first string, seq long, n long, names string"))
    drop(now)

    def digested(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, md5, kept = None, 0, None, None
        for part in parts:
            kept = part.schema.field(0).type
            for at, more, names in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                if md5 is not None and at == node:
                    md5.update(b",")
                else:
                    if md5 is not None:
                        yield _digest(node, kept, n, md5)
                    node, n, md5 = at, 0, hashlib.md5(usedforsecurity=False)
                md5.update(names.as_py().encode())
                n += more
        if md5 is not None:
            yield _digest(node, kept, n, md5)

    ordered = pieces.repartition("node").sortWithinPartitions("node", "first", "seq").select("node", "n", "names")
    return ordered.mapInArrow(digested, f"node {kind}, n_leaves long, clade string")


def _piece(node: object, kind: pa.DataType, held: list[str], seq: int) -> pa.RecordBatch:
    columns = [pa.array([node], kind), pa.array([held[0]]), pa.array([seq], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([",".join(held)])]
    return pa.RecordBatch.from_arrays(columns, names=["node", "first", "seq", "n", "names"])


def _digest(node: object, kind: pa.DataType, n: int, md5: hashlib._Hash) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], kind), pa.array([n], pa.int64()), pa.array([md5.hexdigest()])], names=["node", "n_leaves", "clade"])


def common_ancestors(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``members(grp, node)`` -> ``(grp, node, lca, distance)``: the lowest node that is above (or is) all of a group's nodes, and each one's distance to it.

    Groups with a node that the tree lacks, or of nodes without common ancestor, are left out.
    """
    reach = levels(nodes)
    deep = depths(nodes, reach)
    kind = nodes.schema["branch_len"].dataType
    known = members.select("grp", "node").distinct().join(deep.select("node", "depth"), "node", "left")
    low = known.groupBy("grp").agg(F.min("depth").alias("least"), F.count_if(F.col("depth").isNull()).alias("unknown")).where("unknown = 0")
    now = known.join(low, "grp").select("grp", "node", F.col("node").alias("at"), (F.col("depth") - F.col("least")).alias("left"), F.lit(0).cast(kind).alias("distance"))
    now = materialise(now)

    def lifted(rows: DataFrame, step: DataFrame) -> DataFrame:
        return rows.join(step.select(F.col("node").alias("at"), "up", "dist"), "at", "left")

    for k in range(len(reach) - 1, -1, -1):
        go = F.col("left").bitwiseAND(F.lit(1 << k)) != 0
        last, now = now, materialise(lifted(now, reach[k]).select("grp", "node", F.when(go, F.col("up")).otherwise(F.col("at")).alias("at"), "left", F.when(go, F.col("distance") + F.col("dist")).otherwise(F.col("distance")).alias("distance")))
        drop(last)

    def climb(rows: DataFrame, step: DataFrame, apart: str) -> DataFrame:
        """One step up for the groups that ``apart`` chooses by their nodes (``a``..``b``) and those above them (``c``..``d``)."""
        far = materialise(lifted(rows, step))
        ends = far.groupBy("grp").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.min("up").alias("c"), F.max("up").alias("d"))
        go = far.join(ends.select("grp", F.expr(apart).alias("go")), "grp")
        out = materialise(go.select("grp", "node", F.when(F.col("go"), F.col("up")).otherwise(F.col("at")).alias("at"), F.when(F.col("go"), F.col("distance") + F.col("dist")).otherwise(F.col("distance")).alias("distance")))
        drop(far, rows)
        return out

    for step in reversed(reach):
        now = climb(now, step, "a != b and coalesce(c != d, false)")
    now = climb(now, reach[0], "a != b and c is not null")
    met = now.groupBy("grp").agg(F.min("at").alias("lca"), F.max("at").alias("other")).where("lca = other").select("grp", "lca")
    out = now.join(met, "grp").select("grp", "node", "lca", "distance")
    drop(deep, *reach)
    return out


def common_ancestor(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs ``(x, y)`` with their lowest common ancestor and the length of the path between them."""
    asked = numbered(pairs.select("x", "y").distinct(), "grp")
    members = asked.select("grp", F.explode(F.array("x", "y")).alias("node"))
    found = common_ancestors(nodes, members).select("grp", "node", "lca", "distance")
    a, b = found.select("grp", F.col("node").alias("x"), "lca", F.col("distance").alias("dx")), found.select("grp", F.col("node").alias("y"), F.col("distance").alias("dy"))
    return asked.join(a, ["grp", "x"]).join(b, ["grp", "y"]).select("x", "y", "lca", (F.col("dx") + F.col("dy")).alias("path_len"))


def path_to_root(nodes: DataFrame, node: str) -> DataFrame:
    """The node and all above it, found by doubling: as many rows as it is deep."""
    out = nodes.where(F.col("node") == node).select("node")
    for step in levels(nodes):
        out = materialise(out.unionByName(step.join(out, "node", "left_semi").select(F.col("up").alias("node"))))
    return out
