"""Inputs derived from the driver's tables by fixed rules, in Spark and as SQL for the comparison.

An alignment is a conversation: a row for each turn, a column for each character, a gap for every
character outside a-z once lower-cased, shorter rows filled up with gaps.  In a second alignment of
the same sequences the rows of odd number stand one column further right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignlake.operators.alignment import to_cells, to_residues
from alignlake.operators.packed import pack


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as long as their turns."""
    t = table(spark, sf_dir, "conversations")
    return t.select(
        F.col("conv_id").cast("string").alias("aln_id"), F.col("turn").cast("int").alias("row_no"), F.concat("role", F.lit("-"), "turn").alias("name"), F.regexp_replace(F.lower("text"), "[^a-z]", "-").alias("gapped")
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_rows(spark, sf_dir)
    width = raw.groupBy("aln_id").agg(F.max(F.length("gapped")).alias("width"))
    return raw.join(width, "aln_id").select("aln_id", "row_no", "name", F.rpad("gapped", F.col("width"), "-").alias("gapped"))


def rows_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("row_no") % 2 == 1, F.concat(F.lit("-"), "gapped")).otherwise(F.concat("gapped", F.lit("-")))
    return rows(spark, sf_dir).withColumn("gapped", shifted)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(rows(spark, sf_dir))


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that aren't gaps."""
    return to_residues(rows(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in blocks of columns, without annotations."""
    return pack(rows(spark, sf_dir))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in blocks, the first row in upper case as column annotation ``RF``, the others with ``q`` for a-m as annotations ``PP`` of themselves."""
    all_ = rows(spark, sf_dir)
    column = all_.where("row_no = 0").select("aln_id", F.lit("RF").alias("tag"), F.upper("gapped").alias("text"))
    cell = all_.where("row_no > 0").select("aln_id", "name", F.lit("PP").alias("tag"), F.regexp_replace("gapped", "[a-m]", "q").alias("text"))
    return pack(all_, column, cell)


def cells_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(rows_b(spark, sf_dir))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as sequences of a-z."""
    t = table(spark, sf_dir, "documents")
    return t.select(F.col("doc_id").cast("string").alias("seq_id"), "lang", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("seq"))


ROWS = """raw_ AS (SELECT conv_id::VARCHAR AS aln_id, turn::INTEGER AS row_no, role || '-' || turn AS name,
 regexp_replace(lower(text), '[^a-z]', '-', 'g') AS gapped FROM conversations),
rows_ AS (SELECT aln_id, row_no, name, rpad(gapped, (max(length(gapped)) OVER (PARTITION BY aln_id))::INTEGER, '-') AS gapped FROM raw_)"""


def cells_sql(name: str = "cells", source: str = "rows_") -> str:
    return f"""{name}_0 AS (SELECT aln_id, row_no, name, unnest(range(0, length(gapped)))::INTEGER AS col, unnest(string_split(gapped, '')) AS ch FROM {source} WHERE gapped <> ''),
{name} AS MATERIALIZED (SELECT *, ch = '-' AS is_gap, CASE WHEN ch <> '-' THEN (count(*) FILTER (WHERE ch <> '-') OVER (PARTITION BY aln_id, row_no, name ORDER BY col) - 1)::INTEGER END AS pos FROM {name}_0)"""


ANNOTATED = ROWS + """,
texts AS (SELECT aln_id, 'row' AS kind, row_no, name, NULL::VARCHAR AS tag, gapped AS text FROM rows_ UNION ALL SELECT aln_id, 'col', NULL, NULL, 'RF', upper(gapped) FROM rows_ WHERE row_no = 0
UNION ALL SELECT aln_id, 'cell', NULL, name, 'PP', regexp_replace(gapped, '[a-m]', 'q', 'g') FROM rows_ WHERE row_no > 0)"""
CELLS = ROWS + ",\n" + cells_sql()
ROWS_B = ROWS + ",\nrows_b AS (SELECT aln_id, row_no, name, CASE WHEN row_no % 2 = 1 THEN '-' || gapped ELSE gapped || '-' END AS gapped FROM rows_)"
CELLS_B = ROWS_B + ",\n" + cells_sql() + ",\n" + cells_sql("cells_b", "rows_b")
SEQUENCES = "sequences AS (SELECT doc_id::VARCHAR AS seq_id, lang, regexp_replace(lower(text), '[^a-z]', '', 'g') AS seq FROM documents)"


def kept_sql(keep: str) -> str:
    """SQL from a ``keep(aln_id, col)`` table to the renumbered cells of those columns."""
    return f"""{keep},
left_ AS (SELECT aln_id, col, row_number() OVER (PARTITION BY aln_id ORDER BY col) - 1 AS to_ FROM (SELECT DISTINCT aln_id, col FROM cells SEMI JOIN keep USING (aln_id, col))),
moved AS (SELECT c.aln_id, row_no, name, to_::INTEGER AS col, ch, is_gap FROM cells c JOIN left_ USING (aln_id, col))
{NUMBERED}"""


NUMBERED = """SELECT aln_id, row_no, name, col, ch, is_gap, CASE WHEN NOT is_gap THEN
 (count(*) FILTER (WHERE NOT is_gap) OVER (PARTITION BY aln_id, row_no, name ORDER BY col) - 1)::INTEGER END AS pos FROM moved"""
