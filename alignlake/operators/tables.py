"""Small operators over tags, logs, samples and other tables, and options of larger ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignlake.functions.residues import transition
from alignlake.operators.alignment import grows


def thin(samples: DataFrame, n: int, number: str = "sample_no") -> DataFrame:
    """Every ``n``-th sample, from number 0."""
    return samples.where(F.col(number) % n == 0)


def fold_case(sequences: DataFrame, upper: bool = True, column: str = "seq") -> DataFrame:
    return sequences.withColumn(column, F.upper(column) if upper else F.lower(column))


def filter_by_tag(rows: DataFrame, tags: DataFrame, tag: str, least: float) -> DataFrame:
    """Rows of alignments that have a tag with a number above ``least``."""
    good = tags.where((F.col("tag") == tag) & (F.col("value").try_cast("double") > least)).select("aln_id")
    return rows.join(good.distinct(), "aln_id", "left_semi")


def filter_log(lines: DataFrame, least: float, skip: list[str], show: list[str]) -> DataFrame:
    """Lines of level ``least`` or more without a tag of ``skip``; a tag of ``show`` overrides both."""
    among = lambda names: F.arrays_overlap("tags", F.array(*map(F.lit, names))) if names else F.lit(False)
    return lines.where(among(show) | ((F.col("level") >= least) & ~among(skip)))


def rename_tags(tags: DataFrame, names: dict[str, str]) -> DataFrame:
    """Tags under their new names; those without one stay."""
    new = F.col("tag")
    for old, name in names.items():
        new = F.when(F.col("tag") == old, name).otherwise(new)
    return tags.withColumn("tag", new)


def select_tags(tags: DataFrame, keep: list[str]) -> DataFrame:
    return tags.where(F.col("tag").isin(keep))


def clear_tags(tags: DataFrame, gone: list[str]) -> DataFrame:
    return tags.where(~F.col("tag").isin(gone))


def add_tag(tags: DataFrame, new: DataFrame) -> DataFrame:
    """``new(aln_id, tag, value)`` as lines behind the alignment's last one, in the order of tag and value."""
    last = tags.groupBy("aln_id").agg(F.max("line_no").alias("last"))
    place = F.row_number().over(W.partitionBy("aln_id").orderBy("tag", "value"))
    lines = new.join(last, "aln_id", "left").withColumn("line_no", F.coalesce("last", F.lit(-1)) + place)
    return tags.unionByName(lines.select(*[F.col(c).cast(tags.schema[c].dataType) for c in tags.columns]))


def pivot_runs(results: DataFrame, row: str, run: str, runs: list[str], value: str) -> DataFrame:
    """A row for each protocol, a column for each run, the sum of its values."""
    return results.groupBy(row).pivot(run, runs).sum(value)


def compare_annotation(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Two annotations ``(aln_id, col, ch)`` side by side, and where they are equal."""
    a = actual.select("aln_id", "col", F.col("ch").alias("actual"))
    b = predicted.select("aln_id", "col", F.col("ch").alias("predicted"))
    return a.join(b, ["aln_id", "col"]).withColumn("equal", F.col("actual") == F.col("predicted"))


def start_coverage(rows: DataFrame, start: str = "start") -> DataFrame:
    """Alignments for each start position, over all files."""
    return rows.groupBy(F.col(start).alias("start")).agg(F.count("*").alias("n"))


def top_hits(features: DataFrame, seq: str, score: str, ties: str, least: float, n: int) -> DataFrame:
    """At most ``n`` features of each sequence with a score of ``least`` or more, best first."""
    order = W.partitionBy(seq).orderBy(F.desc(score), ties)
    return features.where(F.col(score) >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def rank_columns(cells: DataFrame) -> DataFrame:
    """Columns by their summed residue numbers."""
    sums = cells.where("not is_gap").groupBy("aln_id", "col").agg(F.sum("pos").alias("total"))
    return sums.withColumn("place", F.row_number().over(W.partitionBy("aln_id").orderBy("total", "col")))


def sort_params(params: DataFrame) -> DataFrame:
    """Distinct parameters with their reversed name, in its order."""
    return params.select("param", F.reverse("param").alias("key")).distinct().orderBy("key")


def map_states(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """A column's characters of ``old`` as those at their places in ``new``."""
    return rows.withColumn(column, F.translate(column, old, new))


def apply_mask(sequences: DataFrame, positions: DataFrame, mask: str = "n") -> DataFrame:
    """Sequences whose listed ``(seq_id, pos)`` have the mask letter; texts stay whole. Empty ones are left out."""

    @F.pandas_udf("string")
    def masked(seq: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for text, places in zip(seq, at, strict=True):
            if places is not None:
                letters = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
                letters[places[(places >= 0) & (places < len(letters))]] = ord(mask)
                text = letters.tobytes().decode("utf-32-le")
            out.append(text)
        return pd.Series(out, seq.index)

    hit = grows(positions.groupBy("seq_id").agg(F.collect_set(F.col("pos").cast("long")).alias("at")))
    return sequences.where("seq != ''").join(hit, "seq_id", "left").select("seq_id", masked("seq", "at").alias("seq"))


def gap_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many residue-gap pairs ``(aln_id, name, other, pos)`` of two rows both alignments have."""
    keys = ["aln_id", "name", "other", "pos"]
    return a.select(keys).join(b.select(keys), keys, "left_semi").groupBy("aln_id", "name", "other").agg(F.count("*").alias("n_shared"))


def kimura_distance(counts: DataFrame) -> DataFrame:
    """Kimura's two-parameter distance from ``(aln_id, n1, n2, ch1, ch2, n)`` over bases; null beyond saturation or without bases."""
    base = counts.where(F.lower("ch1").isin(*"acgtu") & F.lower("ch2").isin(*"acgtu"))
    turn = F.coalesce(transition("ch1", "ch2").cast("int"), F.lit(0))
    differs = (F.translate(F.lower("ch1"), "u", "t") != F.translate(F.lower("ch2"), "u", "t")).cast("int")
    per = base.groupBy("aln_id", "n1", "n2").agg((F.sum(F.col("n") * turn) / F.sum("n")).alias("p"), (F.sum(F.col("n") * (differs - turn)) / F.sum("n")).alias("q"))
    x, y = 1 - 2 * F.col("p") - F.col("q"), 1 - 2 * F.col("q")
    k2p = F.when((x > 0) & (y > 0), -0.5 * F.log(x) - 0.25 * F.log(y))
    return per.select("aln_id", "n1", "n2", F.round("p", 9).alias("transitions"), F.round("q", 9).alias("transversions"), F.round(k2p, 9).alias("kimura"))


def keep_last(placements: DataFrame) -> DataFrame:
    """One share for each read and node: that of the largest ``at``."""
    newest = placements.groupBy("read", "node").agg(F.max(F.struct("at", "score")).alias("m"))
    return newest.select("read", "node", F.col("m.score").alias("score"))


def summary_totals(cells: DataFrame) -> DataFrame:
    """Rows and residues of each alignment and row, of each alignment and of all (null: all)."""
    return cells.rollup("aln_id", "row_no").agg(F.count("*").alias("n_cells"), F.count_if(~F.col("is_gap")).alias("n_residues"))


def window_strands(windows: DataFrame, strands: str = "+-", first: int | None = None, last: int | None = None) -> DataFrame:
    """Windows that lie between two columns (from 1), once for each strand."""
    inside: Column = F.lit(True)
    if first is not None:
        inside = inside & (F.col("start") >= first)
    if last is not None:
        inside = inside & (F.col("end") <= last)
    return windows.where(inside).withColumn("strand", F.explode(F.array(*map(F.lit, strands))))


def pair_path_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Match columns of each pair of rows in ``a`` and how many of them ``b`` has too."""
    keys = ["aln_id", "n1", "n2", "pos1", "pos2"]
    both = a.select(keys).join(b.select(*keys, F.lit(1).alias("hit")).distinct(), keys, "left")
    return both.groupBy("aln_id", "n1", "n2").agg(F.count("*").alias("n_match"), F.count("hit").alias("n_shared"))


def drop_or_mask(annotation: DataFrame, columns: DataFrame, structure: DataFrame, unpaired: str | None = None) -> DataFrame:
    """``annotation(aln_id, col, ch)`` without the listed columns, and without the partners of paired ones.

    With ``unpaired`` the partners stay and get that symbol.
    """
    ends = structure.select("aln_id", F.col("lcol").alias("col"), F.col("rcol").alias("to")).unionByName(structure.select("aln_id", F.col("rcol").alias("col"), F.col("lcol").alias("to")))
    gone = columns.select("aln_id", "col").distinct()
    partners = ends.join(gone, ["aln_id", "col"], "left_semi").select("aln_id", F.col("to").alias("col")).distinct()
    left = annotation.join(gone, ["aln_id", "col"], "left_anti")
    if unpaired is None:
        return left.join(partners, ["aln_id", "col"], "left_anti")
    marked = left.join(partners.withColumn("hit", F.lit(True)), ["aln_id", "col"], "left")
    return marked.withColumn("ch", F.when(F.col("hit"), unpaired).otherwise(F.col("ch"))).drop("hit")


def structure_columns(structure: DataFrame, cells: DataFrame, gapless: bool = False, strict: bool = False) -> DataFrame:
    """``(aln_id, col, paired)`` of columns that aren't all gaps; ``gapless``: only those without any gap, ``strict``: only pairs in stems."""
    if strict:
        near = [structure.select("aln_id", (F.col("lcol") + d).alias("lcol"), (F.col("rcol") - d).alias("rcol")) for d in (1, -1)]
        structure = structure.join(near[0].unionByName(near[1]).distinct(), ["aln_id", "lcol", "rcol"], "left_semi")
    ends = structure.select("aln_id", F.explode(F.array("lcol", "rcol")).alias("col")).distinct().withColumn("paired", F.lit(True))
    n = cells.groupBy("aln_id", "col").agg(F.count("*").alias("n"), F.count_if("is_gap").alias("gaps"))
    full = n.where("gaps = 0" if gapless else "gaps < n").select("aln_id", "col")
    return full.join(ends, ["aln_id", "col"], "left").select("aln_id", "col", F.coalesce("paired", F.lit(False)).alias("paired"))
