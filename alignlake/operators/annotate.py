"""Structures, tags, parameter tables, translation and tree paths as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignlake.functions.residues import STANDARD_CODE
from alignlake.operators.alignment import grows, running_count
from alignlake.operators.sequences import bracket_pairs
from alignlake.operators.trees import lineage

PAIR = ["aln_id", "lcol", "rcol"]


def row_pairs(cells: DataFrame, opener: str, closer: str) -> DataFrame:
    """``(aln_id, row_no, lcol, rcol)``: each row's base pairs, its openers and closers read as brackets."""
    mark = F.when(F.col("ch") == opener, "<").otherwise(">")
    marks = cells.where(F.col("ch").isin(opener, closer)).select(F.struct("aln_id", "row_no").alias("id"), "col", mark.alias("ch"))
    return bracket_pairs(marks).select("id.aln_id", "id.row_no", "lcol", "rcol")


def _row_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("aln_id").agg(F.countDistinct("row_no").alias("n_rows"))


def compare_structures(pairs: DataFrame, first: int, second: int) -> DataFrame:
    """Base pairs of two rows of each alignment and how many both have."""
    seen = pairs.where(F.col("row_no").isin(first, second)).groupBy(*PAIR).agg(F.max((F.col("row_no") == first).cast("int")).alias("a"), F.max((F.col("row_no") == second).cast("int")).alias("b"))
    return seen.groupBy("aln_id").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("shared"))


def conservative_structure(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs that all rows of their alignment have."""
    n = pairs.groupBy(*PAIR).agg(F.count("*").alias("n"))
    return n.join(_row_counts(cells), "aln_id").where("n = n_rows").select(*PAIR)


def conflict_columns(pairs: DataFrame) -> DataFrame:
    """Columns that are paired two ways, or both as left and as right side."""
    found = pairs.select(*PAIR).distinct()
    ends = found.select("aln_id", F.col("lcol").alias("col"), F.col("rcol").alias("other")).unionByName(found.select("aln_id", F.col("rcol").alias("col"), F.col("lcol").alias("other")))
    return ends.groupBy("aln_id", "col").agg(F.count("*").alias("ways")).where("ways > 1")


def liberal_structure(pairs: DataFrame) -> DataFrame:
    """All rows' pairs without conflict columns, read once more as brackets so that none cross."""
    bad = grows(conflict_columns(pairs).select("aln_id", "col"))
    found = pairs.select(*PAIR).distinct()
    clean = found.join(bad.withColumnRenamed("col", "lcol"), ["aln_id", "lcol"], "left_anti").join(bad.withColumnRenamed("col", "rcol"), ["aln_id", "rcol"], "left_anti")
    marks = clean.select(F.col("aln_id").alias("id"), F.explode(F.array(F.struct(F.col("lcol").alias("col"), F.lit("<").alias("ch")), F.struct(F.col("rcol").alias("col"), F.lit(">").alias("ch")))).alias("m"))
    return bracket_pairs(marks.select("id", "m.*")).withColumnRenamed("id", "aln_id")


def majority_structure(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs of more than half of the rows where no row has a gap on just one side."""
    n = pairs.groupBy(*PAIR).agg(F.count("*").alias("n")).join(_row_counts(cells), "aln_id").where("2 * n > n_rows").select(*PAIR)
    full = cells.where("not is_gap").select("aln_id", "row_no", "col")
    ends = n.select("*", F.explode(F.array("lcol", "rcol")).alias("col")).join(full, ["aln_id", "col"])
    torn = ends.groupBy(*PAIR, "row_no").agg(F.count("*").alias("sides")).where("sides = 1").select(*PAIR).distinct()
    return n.join(torn, PAIR, "left_anti")


def propagate_structure(structure: DataFrame, cells: DataFrame) -> DataFrame:
    """A consensus structure's pairs for every row that has residues on both sides."""
    full = cells.where("not is_gap").select("aln_id", "row_no", "col")
    left = structure.join(full.withColumnRenamed("col", "lcol"), ["aln_id", "lcol"])
    return left.join(full.withColumnRenamed("col", "rcol"), ["aln_id", "row_no", "rcol"]).select("aln_id", "row_no", "lcol", "rcol")


def sanitise_structure(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows' pairs whose two columns are in every row both gaps (or beyond its end) or both paired."""
    found = grows(pairs.select(*PAIR).distinct().select("*", F.explode(F.array("lcol", "rcol")).alias("col")))
    paired = pairs.select("aln_id", "row_no", F.explode(F.array("lcol", "rcol")).alias("col")).distinct().withColumn("paired", F.lit(1))
    full = cells.where("not is_gap").select("aln_id", "row_no", "col").join(paired, ["aln_id", "row_no", "col"], "left")
    bad = found.join(full, ["aln_id", "col"]).groupBy(*PAIR, "row_no").agg(F.count("paired").alias("n")).where("n < 2").select(*PAIR).distinct()
    return pairs.join(bad, PAIR, "left_anti").select("aln_id", "row_no", "lcol", "rcol")


def with_partners(columns: DataFrame, structure: DataFrame) -> DataFrame:
    """Columns and the partners that they are paired with."""
    both = structure.select("aln_id", F.col("lcol").alias("col"), F.col("rcol").alias("to")).unionByName(structure.select("aln_id", F.col("rcol").alias("col"), F.col("lcol").alias("to")))
    return columns.unionByName(both.join(columns, ["aln_id", "col"], "left_semi").select("aln_id", F.col("to").alias("col"))).distinct()


def paired_columns(structure: DataFrame, cells: DataFrame) -> DataFrame:
    """Columns that aren't all gaps, and whether the structure pairs them."""
    ends = structure.select("aln_id", F.explode(F.array("lcol", "rcol")).alias("col")).distinct().withColumn("paired", F.lit(True))
    full = cells.where("not is_gap").select("aln_id", "col").distinct()
    return full.join(ends, ["aln_id", "col"], "left").select("aln_id", "col", F.coalesce("paired", F.lit(False)).alias("paired"))


def mini_slices(columns: DataFrame, n: int) -> DataFrame:
    """Unpaired columns in chunks of ``n``."""
    at = running_count(columns.where("not paired").select("aln_id", "col"), ["aln_id"], F.lit(1), "at")
    return at.select("aln_id", "col", F.floor((F.col("at") - 1) / n).cast("int").alias("slice"))


def stem_slices(stems: DataFrame) -> DataFrame:
    """``(id, slice, col)``: the columns of both sides of each stem ``(id, l0, l1, r0, r1)``, stems numbered from the left."""
    at = stems.withColumn("slice", F.row_number().over(W.partitionBy("id").orderBy("l0", "r0")))
    return at.select("id", "slice", F.explode(F.concat(F.sequence("l0", "l1"), F.sequence("r0", "r1"))).alias("col"))


def sample_alignments(df: DataFrame, share: float, seed: str) -> DataFrame:
    """About ``share`` of the alignments, the same ones each time: a sampling operator."""
    return df.where(F.substring(F.md5(F.concat("aln_id", F.lit(seed))), 1, 8) < f"{int(share * 2**32):08x}")


def join_tags(tags: DataFrame) -> DataFrame:
    """``(aln_id, line_no, tag, value)`` -> each tag's first line and all its lines joined."""
    lines = F.sort_array(F.collect_list(F.struct("line_no", "value")))
    each = tags.groupBy("aln_id", "tag").agg(lines.alias("lines"))
    return each.select("aln_id", "tag", F.col("lines")[0]["value"].alias("first"), F.array_join("lines.value", "\n").alias("joined"))


def merge_params(params: DataFrame, models: list[str]) -> DataFrame:
    """``(model, param, value)`` -> a row for each parameter, a column for each model, null where it lacks one."""
    return params.groupBy("param").pivot("model", models).agg(F.max("value"))


def replace_pair(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """``pairs`` with all residue pairs of ``new``'s row pairs put in place of their own."""
    return pairs.join(new.select("aln_id", "n1", "n2").distinct(), ["aln_id", "n1", "n2"], "left_anti").unionByName(new)


def detect_alphabet(counts: DataFrame, alphabets: list[tuple[str, float, str, str]]) -> DataFrame:
    """``(grp, ch, n)`` -> the alphabet (name, weight, core, degenerate symbols) of highest score, the first of equals."""
    symbols = [(i, name, weight, c, a) for i, (name, weight, core, half) in enumerate(alphabets) for part, a in ((core, 1.0), (half, 0.5)) for c in part]
    known = counts.sparkSession.createDataFrame(symbols, "place int, alphabet string, weight double, ch string, affinity double")
    scores = counts.join(F.broadcast(known), "ch").groupBy("grp", "place", "alphabet").agg(F.round(F.max("weight") * F.sum(F.col("n") * F.col("affinity")), 6).alias("score"))  # one row a symbol
    best = scores.groupBy("grp").agg(F.min(F.struct((-F.col("score")).alias("low"), "place", "alphabet", "score")).alias("m"))
    return best.select("grp", "m.alphabet", "m.score")


def profile_dot(p: DataFrame, q: DataFrame) -> DataFrame:
    """Log of the product over positions of the summed products of two profiles' ``(pos, sym, w)``."""
    both = p.join(q.select("pos", "sym", F.col("w").alias("w2")), ["pos", "sym"])
    return both.groupBy("pos").agg(F.sum(F.col("w") * F.col("w2")).alias("dot")).agg(F.round(F.sum(F.log("dot")), 8).alias("log_dot"))


def progress(values: DataFrame, least: float, forgive: int) -> DataFrame:
    """``(run, at, value)`` -> gain of each round, low gains so far, and whether the run would stop there."""
    order = W.partitionBy("run").orderBy("at")
    last = F.lag("value").over(order)
    gain = (F.col("value") - last) / F.abs(F.nullif(last, F.lit(0.0)))
    so_far = F.sum(F.when(F.col("gain") < least, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return values.withColumn("gain", F.round(gain, 9)).withColumn("low", so_far).withColumn("stop", F.col("low") > forgive)


def best_match(scores: DataFrame) -> DataFrame:
    """Best reference of each query, the first of equals."""
    best = scores.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("low"), "ref", "score")).alias("m"))
    return best.select("query", "m.ref", "m.score")


def translate_sequences(sequences: DataFrame, symbols: str = "tcag", digits: str = "0123") -> DataFrame:
    """Proteins of the first frame, cut at the first stop, and the stops before the last codon."""
    codons = F.regexp_extract_all(F.translate("seq", symbols, digits), F.lit("([0-3]{3})"), F.lit(1))
    acids = F.transform(codons, lambda c: F.substr(F.lit(STANDARD_CODE), F.conv(c, 4, 10).cast("int") + 1, F.lit(1)))
    whole = sequences.withColumn("protein", F.array_join(acids, ""))
    early = F.length(F.regexp_replace(F.expr("substring(protein, 1, greatest(length(protein) - 1, 0))"), r"[^*]", ""))
    return whole.select("seq_id", F.substring_index("protein", "*", 1).alias("protein"), early.alias("early_stops"))


def set_attr(features: DataFrame, key: str, value: str) -> DataFrame:
    """``k=v;...`` attributes as a map with one key set or overwritten, written back in the order of keys."""
    old = F.map_filter(F.str_to_map("attrs", F.lit(";"), F.lit("=")), lambda k, _: k != key)
    pairs = F.array_sort(F.map_entries(F.map_concat(old, F.create_map(F.lit(key), F.lit(value)))))
    return features.withColumn("attrs", F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


def node_path(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes on the way between ``x`` and ``y``: what just one of them has above it, themselves, and their lowest common ancestor."""
    up = lineage(nodes)
    ends = pairs.select("x", "y", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("x").alias("node")), F.struct(F.lit(2).alias("side"), F.col("y").alias("node")))).alias("e"))
    above = ends.select("x", "y", "e.side", "e.node").join(up, "node").groupBy("x", "y", "ancestor").agg(F.countDistinct("side").alias("sides"), F.min(F.when(F.col("side") == 1, F.col("hops"))).alias("hops"))
    low = F.min(F.when(F.col("sides") == 2, F.col("hops"))).over(W.partitionBy("x", "y"))
    return above.withColumn("low", low).where("sides = 1 or hops = low").select("x", "y", F.col("ancestor").alias("node"))


def limit_placements(placements: DataFrame, distances: DataFrame, cutoff: int) -> DataFrame:
    """Placements ``(read, node)`` on nodes within ``cutoff`` of an allowed node, by ``(x, y, path_len)``; a cutoff of 0 is membership."""
    near = distances.where((F.col("path_len") < cutoff) | (F.col("x") == F.col("y"))).select(F.col("x").alias("node"))
    return placements.join(near.distinct(), "node", "left_semi")
