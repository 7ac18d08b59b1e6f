"""Comparing alignments: aligned pairs, gaps, columns, and the scores built on them.

Pairs join on (alignment, column), never on the alignment alone, so one huge alignment spreads out.
Where only counts are wanted they come from counts per column, without making pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignlake.operators.alignment import BLOCK
from alignlake.scratch import materialise


def residue_pairs(cells: DataFrame) -> DataFrame:
    """All pairs of residues that share a column, names in order."""
    x = cells.where("not is_gap").select("aln_id", "col", F.col("name").alias("n1"), F.col("pos").alias("pos1"), F.col("ch").alias("ch1"))
    y = cells.where("not is_gap").select("aln_id", "col", F.col("name").alias("n2"), F.col("pos").alias("pos2"), F.col("ch").alias("ch2"))
    return x.join(y, ["aln_id", "col"]).where("n1 < n2")


def residue_pair_count(cells: DataFrame) -> DataFrame:
    """Pairs of aligned residues of each alignment, from column counts alone."""
    per = cells.where("not is_gap").groupBy("aln_id", "col").agg(F.count("*").alias("n"))
    return per.groupBy("aln_id").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("n_pairs"))


def gap_pairs(cells: DataFrame) -> DataFrame:
    """Residues of one row that stand against a gap of another: ``(aln_id, name, other, pos)``."""
    x = cells.where("not is_gap").select("aln_id", "col", "name", "pos")
    y = cells.where("is_gap").select("aln_id", "col", F.col("name").alias("other"))
    return x.join(y, ["aln_id", "col"]).where("name != other").select("aln_id", "name", "other", "pos")


def column_signatures(cells: DataFrame) -> DataFrame:
    """Each column as the residue index of every row in order of names, -1 for a gap."""
    marks = F.array_sort(F.collect_list(F.struct("name", F.coalesce("pos", F.lit(-1)).alias("pos"))))
    text = F.array_join(F.transform(marks, lambda m: F.concat_ws(":", m["name"], m["pos"].cast("string"))), " ")
    per = cells.groupBy("aln_id", "col").agg(text.alias("signature"), F.count_if(~F.col("is_gap")).alias("n"))
    return per.where("n > 0").select("aln_id", "signature", "n")


def distinct_columns(cells: DataFrame) -> DataFrame:
    return column_signatures(cells).select("aln_id", "signature").distinct()


def pairs_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Residue pairs that ``a`` has and ``b`` lacks: each residue's column in ``b`` comes along, so that ``b``'s pairs are never made."""
    there = b.where("not is_gap").select("aln_id", "name", "pos", F.col("col").alias("col_b"))
    x = a.where("not is_gap").select("aln_id", "col", "name", "pos").join(there, ["aln_id", "name", "pos"], "left")
    y = x.select("aln_id", "col", F.col("name").alias("n2"), F.col("pos").alias("pos2"), F.col("col_b").alias("other"))
    pairs = x.withColumnRenamed("name", "n1").withColumnRenamed("pos", "pos1").join(y, ["aln_id", "col"]).where("n1 < n2 and coalesce(col_b != other, true)")
    return pairs.select("aln_id", "n1", "n2", "pos1", "pos2")


def pair_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(aln_id, n1, n2, n_shared)``: residue pairs of two rows that both alignments have.

    Residues meet where both their columns agree, so only shared pairs are ever made.
    """
    side = lambda cells, col: cells.where("not is_gap").select("aln_id", "name", "pos", F.col("col").alias(col))
    both = side(a, "col_a").join(side(b, "col_b"), ["aln_id", "name", "pos"])
    x, y = both.select("aln_id", "col_a", "col_b", F.col("name").alias("n1")), both.select("aln_id", "col_a", "col_b", F.col("name").alias("n2"))
    return x.join(y, ["aln_id", "col_a", "col_b"]).where("n1 < n2").groupBy("aln_id", "n1", "n2").agg(F.count("*").alias("n_shared"))


def compare_alignments(a: DataFrame, b: DataFrame) -> DataFrame:
    """How well two alignments of the same sequences agree: SPS, PPV, TCS and AMA of each alignment.

    Both are flush.  Empty columns take no part; a ratio over nothing is null.  All counts come from how many
    residues each column of ``a`` shares with each of ``b``: no pair of residues is ever made.
    """
    key = ["aln_id", "col_a", "col_b"]
    x, y = (materialise(cells.where("not is_gap").select("aln_id", "name", "pos", F.col("col").alias(col))) for cells, col in ((a, "col_a"), (b, "col_b")))
    na = x.groupBy("aln_id", "col_a").agg(F.count("*").alias("na"))
    nb = y.groupBy("aln_id", "col_b").agg(F.count("*").alias("nb"))
    met = x.join(y, ["aln_id", "name", "pos"]).groupBy(*key).agg(F.count("*").alias("n"))
    met = materialise(met.join(na, ["aln_id", "col_a"]).join(nb, ["aln_id", "col_b"]))
    one_to_one = met.where("n = na and n = nb").select(*key, F.col("n").alias("common"))  # the same residues: nothing to look up
    some = met.where("not (n = na and n = nb)").select(*key)
    looked = some.join(x.drop("pos"), ["aln_id", "col_a"]).join(y.drop("pos"), ["aln_id", "col_b", "name"]).groupBy(*key).agg(F.count("*").alias("common"))
    pairs = lambda n: F.sum(F.expr(f"{n} * ({n} - 1) div 2"))
    base = na.groupBy("aln_id").agg(F.sum("na").alias("residues"), pairs("na").alias("pairs_a"), F.count("*").alias("cols_a"))
    base = base.join(a.groupBy("aln_id").agg(F.countDistinct("name").alias("rows")), "aln_id")
    base = base.join(nb.groupBy("aln_id").agg(pairs("nb").alias("pairs_b")), "aln_id", "left")
    shared = met.join(one_to_one.unionByName(looked), key).join(base.select("aln_id", "rows"), "aln_id")
    shared = shared.groupBy("aln_id").agg(pairs("n").alias("pairs_both"), F.count_if(F.expr("n = na and n = nb")).alias("cols_both"), F.sum(F.expr("n * (rows - na - nb + common)")).alias("gaps_both"))
    base = base.join(shared, "aln_id", "left").na.fill(0)
    ratio = lambda x, y: F.when(F.expr(y) != 0, F.expr(x).cast("double") / F.expr(y))
    ama = ratio("2 * pairs_both + gaps_both", "residues * (rows - 1)")
    return base.select(
        "aln_id", "pairs_a", "pairs_b", "pairs_both", "gaps_both", "cols_a", "cols_both",
        F.round(ratio("pairs_both", "pairs_a"), 9).alias("sps"), F.round(ratio("pairs_both", "pairs_b"), 9).alias("ppv"),
        F.round(ratio("cols_both", "cols_a"), 9).alias("tcs"), F.round(ama, 9).alias("ama"),
    )


def percent_identity(cells: DataFrame, count_gaps: bool = False) -> DataFrame:
    """Mean over columns of the top symbol's share, case ignored.

    Columns with two residues or more count (one or more with ``count_gaps``, which divides by all
    rows); a top symbol seen once counts nothing.
    """
    n = cells.groupBy("aln_id", "col", F.lower("ch").alias("ch"), "is_gap").agg(F.count("*").alias("n"))
    per = n.groupBy("aln_id", "col").agg(
        F.coalesce(F.max(F.when(~F.col("is_gap"), F.col("n"))), F.lit(0)).alias("top"), F.coalesce(F.sum(F.when(~F.col("is_gap"), F.col("n"))), F.lit(0)).alias("residues"), F.sum("n").alias("rows")
    )
    share = F.when(F.col("top") > 1, F.col("top")).otherwise(0) / F.col("rows" if count_gaps else "residues")
    return per.where(f"residues > {0 if count_gaps else 1}").groupBy("aln_id").agg(F.round(100 * F.avg(share), 9).alias("percent_id"))


def pair_identity(cells: DataFrame) -> DataFrame:
    """Equal and aligned columns of every pair of rows."""
    p = residue_pairs(cells)
    return p.groupBy("aln_id", "n1", "n2").agg(F.count("*").alias("aligned"), F.count_if(F.lower("ch1") == F.lower("ch2")).alias("same"))


def percent_identity_pairwise(cells: DataFrame) -> DataFrame:
    """Mean over row pairs of the percentage of aligned columns that are equal."""
    return pair_identity(cells).groupBy("aln_id").agg(F.round(F.avg(100 * F.col("same") / F.col("aligned")), 9).alias("percent_id"), F.count("*").alias("n_pairs"))


def split_pairs(cells: DataFrame, min_id: float, max_id: float) -> DataFrame:
    """Row pairs whose percent identity lies between two bounds."""
    i = 100 * F.col("same") / F.col("aligned")
    return pair_identity(cells).withColumn("identity", F.round(i, 9)).where(F.col("identity").between(min_id, max_id))


def nonredundant(cells: DataFrame, dup_id: float = 98.0, min_id: float = 0.0) -> DataFrame:
    """Rows to keep: a row goes if a later one is at least ``dup_id`` percent like it, or its best is under ``min_id``."""
    rows = cells.select("aln_id", "row_no", "name").distinct()
    p = pair_identity(cells).withColumn("identity", 100 * F.col("same") / F.col("aligned"))
    no = lambda n: rows.select("aln_id", F.col("row_no").alias(f"r{n}"), F.col("name").alias(f"n{n}"))
    p = p.join(no(1), ["aln_id", "n1"]).join(no(2), ["aln_id", "n2"])
    both = p.select("aln_id", F.col("r1").alias("row_no"), (F.col("r2") > F.col("r1")).alias("later"), "identity").unionByName(
        p.select("aln_id", F.col("r2").alias("row_no"), (F.col("r1") > F.col("r2")).alias("later"), "identity")
    )
    worst = both.groupBy("aln_id", "row_no").agg(F.max(F.when(F.col("later"), F.col("identity"))).alias("dup"), F.max("identity").alias("best"))
    gone = worst.where((F.col("dup") >= dup_id) | (F.col("best") < min_id))
    return rows.join(gone, ["aln_id", "row_no"], "left_anti")


def substitution_counts(cells: DataFrame) -> DataFrame:
    """Symbol pairs of every pair of rows."""
    return residue_pairs(cells).groupBy("aln_id", "n1", "n2", "ch1", "ch2").agg(F.count("*").alias("n"))


def pairwise_distance(counts: DataFrame) -> DataFrame:
    """p-distance and Jukes-Cantor distance of every pair of rows (null beyond saturation)."""
    per = counts.groupBy("aln_id", "n1", "n2").agg((F.sum(F.when(F.col("ch1") != F.col("ch2"), F.col("n")).otherwise(0)) / F.sum("n")).alias("p"))
    jc = F.when(F.col("p") < 0.75, -0.75 * F.log(1 - F.col("p") * 4 / 3))
    return per.select("aln_id", "n1", "n2", F.round("p", 9).alias("p_distance"), F.round(jc, 9).alias("jukes_cantor"))


def pair_path_stats(pairs: DataFrame) -> DataFrame:
    """Match columns and mean diagonal displacement of every pair of rows."""
    return pairs.groupBy("aln_id", "n1", "n2").agg(F.count("*").alias("n_match"), F.round(F.avg(F.col("pos1") - F.col("pos2")), 9).alias("shift"))


def column_profile(cells: DataFrame) -> DataFrame:
    """Share and rank of every symbol of a column; ties go to the smaller symbol."""
    return symbol_shares(cells.where("not is_gap").groupBy("aln_id", "col", "ch").agg(F.count("*").alias("n")))


def symbol_shares(n: DataFrame) -> DataFrame:
    """As ``column_profile``, from counts ``(aln_id, col, ch, n)``."""
    col = W.partitionBy("aln_id", "col")
    return n.select("aln_id", "col", "ch", F.round(F.col("n") / F.sum("n").over(col), 9).alias("w"), F.row_number().over(col.orderBy(F.desc("n"), "ch")).alias("place"))


def consensus(cells: DataFrame) -> DataFrame:
    """The commonest symbol of every column, the smaller of two as common."""
    return commonest(cells.where("not is_gap").groupBy("aln_id", "col", "ch").agg(F.count("*").alias("n")))


def commonest(n: DataFrame) -> DataFrame:
    """As ``consensus``, from counts ``(aln_id, col, ch, n)``."""
    return n.groupBy("aln_id", "col").agg(F.min(F.struct((-F.col("n")).alias("k"), "ch"))["ch"].alias("ch"))


def compose_pairs(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """From a-b and b-c residue pairs (``x``, ``y``) to a-c pairs, unmatched residues kept."""
    left = ab.select("aln_id", F.col("x").alias("a"), F.col("y").alias("b"))
    right = bc.select("aln_id", F.col("x").alias("b"), F.col("y").alias("c"))
    return left.join(right, ["aln_id", "b"], "full").select("aln_id", "a", "b", "c")


def gap_blocks(cells: DataFrame) -> DataFrame:
    """Maximal runs of neighbouring columns with one gap profile."""
    flags = F.array_sort(F.collect_list(F.struct("row_no", F.when(F.col("is_gap"), "-").otherwise("x").alias("g"))))
    per = cells.groupBy("aln_id", "col").agg(F.array_join(F.transform(flags, lambda x: x["g"]), "").alias("profile"))
    return runs_of(per, "profile").select("aln_id", F.col("run").alias("block"), F.col("start").alias("first_col"), F.col("stop").alias("last_col"), F.col("kind").alias("profile"))


def runs_of(columns: DataFrame, kind: str, keys: tuple[str, ...] = ("aln_id",)) -> DataFrame:
    """``columns(keys, col, kind)`` -> ``(keys, run, kind, start, stop, n)``: maximal runs of one kind, numbered from 1.

    Runs are found inside blocks of columns and joined where they touch a block's border, so a very long
    alignment is spread over many tasks.
    """
    at = columns.select(*keys, "col", F.col(kind).alias("kind")).withColumn("block", F.expr(f"col div {BLOCK}"))
    inside = W.partitionBy(*keys, "block").orderBy("col")
    new = F.when(F.lag("kind").over(inside) == F.col("kind"), 0).otherwise(1)
    part = at.withColumn("new", new).withColumn("part", F.sum("new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    parts = part.groupBy(*keys, "block", "part").agg(F.first("kind").alias("kind"), F.min("col").alias("start"), F.max("col").alias("stop"), F.count("*").alias("n"))
    order = W.partitionBy(*keys).orderBy("start")  # over runs, not columns
    joined = parts.withColumn("new", F.when(F.lag("kind").over(order) == F.col("kind"), 0).otherwise(1))
    runs = joined.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.first("kind").alias("kind"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"))


def gap_chains(blocks: DataFrame) -> DataFrame:
    """Chains of neighbouring gap blocks that share a row's gap: ``(aln_id, k, n)``, how many chains have ``k`` blocks.

    Blocks without gaps end a chain.
    """
    order = W.partitionBy("aln_id").orderBy("block")
    shares = F.exists(F.arrays_zip(F.split("profile", "").alias("x"), F.split("last", "").alias("y")), lambda z: (z["x"] == "-") & (z["y"] == "-"))
    at = blocks.withColumn("last", F.coalesce(F.lag("profile").over(order), F.lit("")))
    at = at.withColumn("chain", F.sum(F.when(shares, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))).where("profile like '%-%'")
    return at.groupBy("aln_id", "chain").agg(F.count("*").alias("k")).groupBy("aln_id", "k").agg(F.count("*").alias("n"))


def column_votes(signatures: DataFrame, samples: DataFrame) -> DataFrame:
    """``signatures(trace, sample, signature, n, weight)`` -> summed weight of each column over a trace's samples, its share and SPS weight.

    ``samples(trace, n_samples)``.  Columns of fewer than two residues take no part.
    """
    votes = signatures.where("n > 1").groupBy("trace", "signature", "n").agg(F.sum("weight").alias("votes"))
    share = F.round(F.col("votes") / F.col("n_samples"), 9)
    return votes.join(samples, "trace").select("trace", "signature", "votes", share.alias("share"), (F.col("n") * (F.col("n") - 1)).alias("sps_weight"))


def majority_annotation(annotation: DataFrame) -> DataFrame:
    """The commonest annotation of every column over ungapped rows; ties go to the smaller character."""
    n = annotation.groupBy("aln_id", "col", "ch").agg(F.count("*").alias("n"))
    return n.groupBy("aln_id", "col").agg(F.min(F.struct((-F.col("n")).alias("k"), "ch"))["ch"].alias("ch"))
