"""Annotated alignment databases as five tables, and back.

``aln_rows(record, aln_id, row_no, name, gapped)``, ``aln_tags(record, line_no, tag, value)``,
``row_tags(record, line_no, name, tag, value)``, ``col_annot(record, tag, text)`` and
``cell_annot(record, name, tag, text)``.  Records are told apart by their number, so equal ids and
equal records stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignlake.sources.lines import joined, records
from alignlake.sources.text import read_fasta

Tables = dict[str, DataFrame]


def read_database(spark: SparkSession, path: str) -> Tables:
    """All tables of a database; wrapped rows and annotations are joined, tag lines keep their order, blanks may stand around ``//``.

    An alignment's id is its ``ID``, else its ``AC``, else ``record-`` and its number; the second and later
    records of one id get ``~`` and their number behind it.
    """
    text = records(spark, path, after="//")
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"(?m)^#=GF[ \t]+{t}[ \t]+(\S+)", 1), F.lit(""))
    ids = text.select("record", F.coalesce(tag("ID"), tag("AC"), F.concat(F.lit("record-"), "record")).alias("id"))
    again = F.row_number().over(W.partitionBy("id").orderBy("record")) > 1
    ids = ids.select("record", F.when(again, F.concat("id", F.lit("~"), "record")).otherwise(F.col("id")).alias("aln_id"))
    lines = text.select("record", F.posexplode(F.split("value", "\n")).alias("line_no", "text"))
    part = lambda form, i: F.regexp_extract("text", form, i)
    gf, gs, gc, gr, row = r"^#=GF\s+(\S+)\s+(.*?)\s*$", r"^#=GS\s+(\S+)\s+(\S+)\s+(.*?)\s*$", r"^#=GC\s+(\S+)\s+(\S+)", r"^#=GR\s+(\S+)\s+(\S+)\s+(\S+)", r"^([^#/\s]\S*)\s+(\S+)"
    of = lambda form: lines.where(F.col("text").rlike(form))
    rows = of(row).select("record", "line_no", part(row, 1).alias("name"), part(row, 2).alias("chunk"))
    rows = joined(rows, ["record", "name"], ["line_no"], "chunk", "gapped").join(ids, "record")
    number = F.row_number().over(W.partitionBy("record").orderBy("at")) - 1
    cols = joined(of(gc).select("record", "line_no", part(gc, 1).alias("tag"), part(gc, 2).alias("chunk")), ["record", "tag"], ["line_no"], "chunk", "text")
    cells = of(gr).select("record", "line_no", part(gr, 1).alias("name"), part(gr, 2).alias("tag"), part(gr, 3).alias("chunk"))
    cells = joined(cells, ["record", "name", "tag"], ["line_no"], "chunk", "text")
    return {
        "aln_rows": rows.select("record", "aln_id", number.alias("row_no"), "name", "gapped"),
        "aln_tags": of(gf).select("record", "line_no", part(gf, 1).alias("tag"), part(gf, 2).alias("value")),
        "row_tags": of(gs).select("record", "line_no", part(gs, 1).alias("name"), part(gs, 2).alias("tag"), part(gs, 3).alias("value")),
        "col_annot": cols.select("record", "tag", "text"),
        "cell_annot": cells.select("record", "name", "tag", "text"),
    }


def write_database(tables: Tables, path: str) -> None:
    """A record for each alignment: tags in order, row tags, rows each with its annotations, column annotations, ``//``."""
    line = lambda *cols: F.concat_ws(" ", *cols)
    part = lambda name, rank, order, text: tables[name].select("record", F.lit(rank).alias("rank"), order.alias("order"), text.alias("text"))
    place = tables["aln_rows"].select("record", "name", "row_no")
    cells = tables["cell_annot"].join(place, ["record", "name"])
    body = part("aln_tags", 0, F.struct("line_no", F.lit("").alias("s")), line(F.lit("#=GF"), "tag", "value"))
    body = body.unionByName(part("row_tags", 1, F.struct("line_no", F.lit("").alias("s")), line(F.lit("#=GS"), "name", "tag", "value")))
    body = body.unionByName(part("aln_rows", 2, F.struct(F.col("row_no").alias("line_no"), F.lit("").alias("s")), line("name", "gapped")))
    body = body.unionByName(cells.select("record", F.lit(2).alias("rank"), F.struct(F.col("row_no").alias("line_no"), F.col("tag").alias("s")).alias("order"), line(F.lit("#=GR"), "name", "tag", "text").alias("text")))
    body = body.unionByName(part("col_annot", 3, F.struct(F.lit(0).alias("line_no"), F.col("tag").alias("s")), line(F.lit("#=GC"), "tag", "text")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "order", "text"))), lambda x: x["text"])
    each = body.groupBy("record").agg(F.array_join(lines, "\n").alias("body"))
    each.select(F.concat(F.lit("# STOCKHOLM 1.0\n"), "body", F.lit("\n//")).alias("value")).write.text(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """``(aln_id, row_no, name, gapped)`` of FASTA or alignment files; each FASTA record is an alignment of one row."""
    first = spark.read.text(path).where("trim(value) != ''").first()
    if first is not None and first[0].lstrip().startswith(">"):
        seqs = read_fasta(spark, path)
        return seqs.select(F.col("seq_id").alias("aln_id"), F.lit(0).alias("row_no"), F.col("seq_id").alias("name"), F.col("seq").alias("gapped"))
    return read_database(spark, path)["aln_rows"].drop("record")
