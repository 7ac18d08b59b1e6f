"""Alignments as long tables of cells: projections, slices and filters.

``cells(aln_id, row_no, name, col, ch, is_gap, pos)`` has one record for each character of each row;
``pos`` is the 0-based residue index, null on gaps.  ``rows(aln_id, row_no, name, gapped)`` is the
compact form.  Every operator takes and returns such tables and stays inside Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_CHARS = "-._"
#: Columns that are numbered in one group.
BLOCK = 1 << 16
_ROW = ("aln_id", "row_no", "name")


def is_gap(ch: str = "ch", gap_chars: str = GAP_CHARS) -> Column:
    return F.col(ch).isin(*gap_chars)


def grows(df: DataFrame) -> DataFrame:
    """A table whose rows were made from fewer: the planner takes it for as small as its source, so joins of it and of what is selected from it mustn't broadcast."""
    return df.hint("merge")


def to_cells(rows: DataFrame, gap_chars: str = GAP_CHARS, col0: str | None = None, pos0: str | None = None) -> DataFrame:
    """Rows to cells, with gap flag and running residue index, which comes from the row itself: no shuffle.

    Where ``gapped`` is a later piece of a row, columns ``col0`` and ``pos0`` say how many columns and residues are before it.
    """
    letters, gaps, residues = _letter_arrays(gap_chars, col0, pos0)
    more = [c for c in (col0, pos0) if c]
    return grows(rows.select(*_ROW, *more, letters.alias("letters")).select(*_ROW, F.inline(F.concat(residues, gaps))))


def to_residues(rows: DataFrame, gap_chars: str = GAP_CHARS) -> DataFrame:
    """As ``to_cells`` without gaps, which are never made."""
    letters, _, residues = _letter_arrays(gap_chars, None, None)
    return grows(rows.select(*_ROW, letters.alias("letters")).select(*_ROW, F.inline(residues)))


def _letter_arrays(gap_chars: str, col0: str | None, pos0: str | None) -> tuple[Column, Column, Column]:
    gap = lambda x: x["ch"].isin(*gap_chars)
    after = lambda n, x: x if n is None else F.col(n) + x
    letters = F.transform(F.filter(F.split("gapped", ""), lambda c: c != ""), lambda c, i: F.struct(after(col0, i).alias("col"), c.alias("ch")))
    cell = lambda x, is_gap, pos: F.struct(x["col"].alias("col"), x["ch"].alias("ch"), F.lit(is_gap).alias("is_gap"), pos.cast("int").alias("pos"))
    residues = F.transform(F.filter("letters", lambda x: ~gap(x)), lambda x, i: cell(x, False, after(pos0, i)))
    gaps = F.transform(F.filter("letters", gap), lambda x: cell(x, True, F.lit(None)))
    return letters, gaps, residues


def running_count(df: DataFrame, keys: list[str], flag: Column, name: str) -> DataFrame:
    """``df`` with the number of flagged records up to each column of its keys, itself included.

    Columns are counted in blocks of ``BLOCK``, whose totals are summed up first, so that one very long row or
    alignment is spread over many tasks.
    """
    dealt = df.withColumn("block", F.expr(f"col div {BLOCK}")).withColumn("flag", flag.cast("int")).repartition(*keys, "block")
    inside = W.partitionBy(*keys, "block").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "block").agg(F.sum("flag").alias("n"))
    totals = totals.select(*keys, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).where("before > 0")
    counted = dealt.withColumn("n", F.sum("flag").over(inside)).join(totals, [*keys, "block"], "left")
    return counted.select(*df.columns, (F.col("n") + F.coalesce("before", F.lit(0))).alias(name))


def number_residues(cells: DataFrame) -> DataFrame:
    """Set ``pos`` anew from the columns' order."""
    counted = running_count(cells.select(*_ROW, "col", "ch", "is_gap"), [*_ROW], ~F.col("is_gap"), "seen")
    return counted.select(*_ROW, "col", "ch", "is_gap", F.when(~F.col("is_gap"), F.col("seen") - 1).cast("int").alias("pos"))


def to_rows(cells: DataFrame) -> DataFrame:
    """Cells to rows, in column order."""
    letters = F.array_sort(F.collect_list(F.struct("col", "ch")))
    text = F.array_join(F.transform(letters, lambda x: x["ch"]), "")
    return cells.groupBy(*_ROW).agg(text.alias("gapped"))


def ungap(rows: DataFrame, gap_chars: str = GAP_CHARS) -> DataFrame:
    return rows.select("aln_id", "row_no", "name", F.translate("gapped", gap_chars, "").alias("seq"))


def columns_to_residues(cells: DataFrame, first: int, last: int) -> DataFrame:
    """The residue range under columns ``first``..``last`` of every row (null if all gap), and the first residue's column offset."""
    inside = cells.where(F.col("col").between(first, last))
    return inside.groupBy(*_ROW).agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), (F.min(F.when(~F.col("is_gap"), F.col("col"))) - first).alias("offset")
    )


def subalign(cells: DataFrame, start: int, length: int, strand: str = "+") -> DataFrame:
    """Columns ``start``.. of every alignment, renumbered; strand ``-`` reverses and complements."""
    part = cells.where(F.col("col").between(start, start + length - 1))
    if strand == "-":
        turned = part.withColumn("col", F.lit(length - 1) - (F.col("col") - start)).withColumn("ch", complement("ch"))
        return number_residues(turned)
    return number_residues(part.withColumn("col", F.col("col") - start))


def complement(ch: str) -> Column:
    return F.translate(ch, "acgtuACGTU", "tgcaaTGCAA")


def renumber(cells: DataFrame) -> DataFrame:
    """Close the gaps that dropped columns leave in each alignment's column numbers."""
    left = running_count(cells.select("aln_id", "col").distinct(), ["aln_id"], F.lit(1), "to")
    moved = cells.join(left, ["aln_id", "col"]).withColumn("col", (F.col("to") - 1).cast("int"))
    return number_residues(moved)


def drop_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Drop the listed ``(aln_id, col)`` and renumber."""
    return renumber(cells.join(columns, ["aln_id", "col"], "left_anti"))


def keep_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    return renumber(cells.join(columns, ["aln_id", "col"], "left_semi"))


def column_gaps(cells: DataFrame) -> DataFrame:
    """Rows and gaps of every column."""
    return cells.groupBy("aln_id", "col").agg(F.count("*").alias("n_rows"), F.count_if("is_gap").alias("n_gaps"))


def erase_empty_columns(cells: DataFrame) -> DataFrame:
    """Drop columns in which every row has a gap."""
    return keep_columns(cells, column_gaps(cells).where("n_gaps < n_rows"))


def drop_gappy(cells: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Drop columns whose share of gaps is ``threshold`` or more."""
    return keep_columns(cells, column_gaps(cells).where(F.col("n_gaps") < F.lit(threshold) * F.col("n_rows")))


def max_gaps(cells: DataFrame, n: int) -> DataFrame:
    """Keep columns with at most ``n`` gaps."""
    return keep_columns(cells, column_gaps(cells).where(F.col("n_gaps") <= n))


def slice_by_reference(cells: DataFrame, row_no: int = 0) -> DataFrame:
    """Keep the columns in which the reference row has a residue."""
    return keep_columns(cells, cells.where((F.col("row_no") == row_no) & ~F.col("is_gap")).select("aln_id", "col"))


def local_trim(cells: DataFrame, annotation: DataFrame | None = None) -> DataFrame:
    """Keep the columns between some row's first and last match; a match is a residue in a column with two or more.

    An ``annotation(aln_id, col, ch)`` keeps those between its own first and last symbol other than ``.`` too.
    """
    matched = column_gaps(cells).where("n_rows - n_gaps > 1").select("aln_id", "col")
    ends = cells.where("not is_gap").join(matched, ["aln_id", "col"], "left_semi").groupBy(*_ROW).agg(F.min("col").alias("a"), F.max("col").alias("b")).select("aln_id", "a", "b")
    if annotation is not None:
        ends = ends.unionByName(annotation.where("ch != '.'").groupBy("aln_id").agg(F.min("col").alias("a"), F.max("col").alias("b")))
    spans = ends.select("aln_id", F.explode(F.sequence("a", "b")).alias("col")).distinct()
    return keep_columns(cells, spans)


def trim_end_gaps(cells: DataFrame) -> DataFrame:
    """Cut the leading and trailing columns that are gaps in every row."""
    ends = cells.where("not is_gap").groupBy("aln_id").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    kept = cells.join(ends, "aln_id").where("col between a and b").withColumn("col", F.col("col") - F.col("a"))
    return number_residues(kept)


def trim_unaligned_ends(rows: DataFrame) -> DataFrame:
    """Turn each row's leading and trailing stretch of lower case, gaps and blanks into gaps; report the residues passed at each end."""
    head = F.regexp_extract("gapped", r"^([-. a-z]*)", 1)
    rest = F.expr("substring(gapped, length(head) + 1)")
    tail = F.regexp_extract("rest", r"([-. a-z]*)$", 1)
    lower = lambda c: F.length(F.regexp_replace(c, "[^a-z]", "")).cast("long")
    cut = rows.withColumn("head", head).withColumn("rest", rest).withColumn("tail", tail)
    body = F.expr("concat(repeat('-', length(head)), substring(rest, 1, length(rest) - length(tail)), repeat('-', length(tail)))")
    return cut.select(*_ROW, body.alias("gapped"), lower("head").alias("from_shift"), lower("tail").alias("to_shift"))


def discard_wild(rows: DataFrame, alphabet: str) -> DataFrame:
    """Drop rows without any residue of the alphabet."""
    return rows.where(F.length(F.translate("gapped", alphabet, "")) < F.length("gapped"))


def shift_rows(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add each name's offset to ``start`` and ``end``; names without one stay."""
    shift = F.coalesce("offset", F.lit(0))
    return rows.join(offsets, "name", "left").withColumn("start", F.col("start") + shift).withColumn("end", F.col("end") + shift).drop("offset")


def unalign(sequences: DataFrame) -> DataFrame:
    """Lay the sequences of a group one after the other: each starts after the total length of the earlier ones."""
    before = W.partitionBy("aln_id").orderBy("row_no").rowsBetween(W.unboundedPreceding, -1)
    return sequences.withColumn("start", F.coalesce(F.sum(F.length("seq")).over(before), F.lit(0)))


def mark_segments(cells: DataFrame, positions: DataFrame, keep: str = "odd") -> DataFrame:
    """Flip a state at each listed ``(aln_id, name, pos)``; keep the residues of odd (or even) segments, others become gaps."""
    flagged = cells.join(positions.select("aln_id", "name", "pos", F.lit(1).alias("flip")).distinct(), ["aln_id", "name", "pos"], "left")
    run = W.partitionBy("aln_id", "row_no", "name").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    state = F.sum(F.coalesce("flip", F.lit(0))).over(run) % 2
    ch = F.when(state == (1 if keep == "odd" else 0), F.col("ch")).otherwise("-")
    return flagged.withColumn("state", state).withColumn("ch", ch).select(*_ROW, "col", "ch")


def parse_coords(names: DataFrame, column: str = "name") -> DataFrame:
    """Split ``name/start-end``; null coordinates where the form is another."""
    form = r"^(.*)/([0-9]+)-([0-9]+)$"
    fits = F.col(column).rlike(form)
    part = lambda i: F.when(fits, F.regexp_extract(column, form, i).cast("long"))
    base = F.when(fits, F.regexp_extract(column, form, 1)).otherwise(F.col(column))
    return names.select("*", base.alias("base"), part(2).alias("start"), part(3).alias("end"))


def promote_annotation(cells: DataFrame, annotation: DataFrame) -> DataFrame:
    """Put the annotation of ``(aln_id, name, col, ch)`` in place of the residues."""
    new = annotation.select("aln_id", "name", "col", F.col("ch").alias("other"))
    return cells.join(new, ["aln_id", "name", "col"], "left").withColumn("ch", F.coalesce("other", "ch")).drop("other")


def mask_annotation(annotation: DataFrame, columns: DataFrame, ch: str) -> DataFrame:
    """Overwrite the listed ``(aln_id, col)`` of an annotation with ``ch``."""
    hit = columns.select("aln_id", "col", F.lit(1).alias("hit")).distinct()
    new = F.when(F.col("hit").isNotNull(), F.lit(ch)).otherwise(F.col("ch"))
    return annotation.join(hit, ["aln_id", "col"], "left").withColumn("ch", new).drop("hit")


def drop_annotated_gaps(alignment: DataFrame, annotation: DataFrame, gap_chars: str = GAP_CHARS, cells: DataFrame | None = None) -> DataFrame:
    """Drop columns in which an annotation ``(aln_id, col, ch)``, or one of ``cells(aln_id, name, col, ch)``, has a gap character."""
    notes = annotation.select("aln_id", "col", "ch")
    if cells is not None:
        notes = notes.unionByName(cells.select("aln_id", "col", "ch"))
    return drop_columns(alignment, notes.where(is_gap("ch", gap_chars)).select("aln_id", "col").distinct())


def concatenate(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two alignments side by side; rows that one of them lacks are padded with ``.``."""
    width = lambda rows, n: rows.groupBy("aln_id").agg(F.max(F.length("gapped")).alias(n))
    a = left.select("aln_id", "name", F.col("gapped").alias("x"))
    b = right.select("aln_id", "name", F.col("gapped").alias("y"))
    both = a.join(b, ["aln_id", "name"], "full").join(width(left, "wx"), "aln_id", "left").join(width(right, "wy"), "aln_id", "left")
    pad = lambda c, w: F.rpad(F.coalesce(c, F.lit("")), F.coalesce(w, F.lit(0)), ".")
    return both.select("aln_id", "name", F.concat(pad("x", F.col("wx")), pad("y", F.col("wy"))).alias("gapped"))


def map_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Which column of ``b`` holds the residue that a column of ``a`` holds, through rows of one name."""
    right = b.where("not is_gap").select("aln_id", "name", "pos", F.col("col").alias("col_b"))
    return a.where("not is_gap").select("aln_id", "name", "pos", F.col("col").alias("col_a")).join(right, ["aln_id", "name", "pos"])


def check_flush(rows: DataFrame) -> DataFrame:
    """Alignments whose rows differ in length."""
    return rows.groupBy("aln_id").agg(F.min(F.length("gapped")).alias("shortest"), F.max(F.length("gapped")).alias("longest")).where("shortest != longest")


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_consistent(sequences: DataFrame) -> DataFrame:
    """Names whose ungapped sequence differs between samples."""
    return sequences.groupBy("name").agg(F.countDistinct("seq").alias("n_seqs")).where("n_seqs > 1")


def find_row(rows: DataFrame) -> DataFrame:
    """For each name the first alignment and row that have it."""
    order = W.partitionBy("name").orderBy("aln_id", "row_no")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").select("name", "aln_id", "row_no")


def summary(cells: DataFrame) -> DataFrame:
    """Rows, columns and residues of each alignment."""
    return cells.groupBy("aln_id").agg(F.countDistinct("row_no").alias("n_rows"), (F.max("col") + 1).cast("long").alias("n_cols"), F.count_if(~F.col("is_gap")).alias("n_residues"))
