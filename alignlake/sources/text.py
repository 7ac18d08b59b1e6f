"""Text formats of sequences, alignments and features as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(seq_id, descr, seq)``: ``>name descr`` headers, white space inside residues removed."""
    record = F.regexp_replace(F.replace("value", F.lit("\r"), F.lit("")), "^>", "")
    head, body = F.regexp_extract(record, r"^([^\n]*)", 1), F.regexp_replace(record, r"^[^\n]*", "")
    parts = spark.read.text(path, lineSep="\n>").where("trim(value) != ''")
    return parts.select(F.regexp_extract(head, r"^(\S+)", 1).alias("seq_id"), F.regexp_extract(head, r"^\S+\s+(.*?)\s*$", 1).alias("descr"), F.regexp_replace(body, r"\s", "").alias("seq"))


def write_fasta(sequences: DataFrame, path: str, width: int = 50, gapped: bool = True, sort: bool = False) -> None:
    """One record a sequence, residues wrapped at ``width``; ``-._`` go unless ``gapped``, ``sort`` puts records in order of their ids."""
    head = F.rtrim(F.concat(F.lit(">"), "seq_id", F.lit(" "), F.coalesce("descr", F.lit(""))))
    wrapped = F.regexp_replace(F.col("seq") if gapped else F.translate("seq", "-._", ""), f"(.{{{width}}})(?=.)", "$1\n")
    ordered = sequences.repartitionByRange("seq_id").sortWithinPartitions("seq_id") if sort else sequences
    ordered.select(F.concat(head, F.lit("\n"), wrapped).alias("value")).write.text(path)


def _unescape(c: Column) -> Column:
    for code, ch in (("%2C", ","), ("%3D", "="), ("%3B", ";")):
        c = F.replace(c, F.lit(code), F.lit(ch))
    return c


def _escape(c: Column) -> Column:
    for code, ch in (("%2C", ","), ("%3D", "="), ("%3B", ";")):
        c = F.replace(c, F.lit(ch), F.lit(code))
    return c


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Features: lines of nine fields; an unknown strand is ``.``, a bad frame null, a score of ``.`` zero."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(f) == 9).select(f.alias("f"))
    attrs = F.transform_values(F.str_to_map(F.col("f")[8], F.lit(";"), F.lit("=")), lambda _, v: F.transform(F.split(v, ","), _unescape))
    strand = F.when(F.col("f")[6].isin("+", "-"), F.col("f")[6]).otherwise(".")
    number = lambda i, kind: F.col("f")[i].try_cast(kind)
    return lines.select(
        F.col("f")[0].alias("seqname"), F.col("f")[1].alias("source"), F.col("f")[2].alias("type"), number(3, "int").alias("start"), number(4, "int").alias("end"),
        F.coalesce(number(5, "double"), F.lit(0.0)).alias("score"), strand.alias("strand"), number(7, "int").alias("frame"), attrs.alias("attrs"),
    )


def write_gff(features: DataFrame, path: str) -> None:
    pair = lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], _escape), ","))
    attrs = F.array_join(F.transform(F.map_entries("attrs"), pair), ";")
    cols = [F.col(c).cast("string") for c in ("seqname", "source", "type", "start", "end", "score", "strand")]
    features.select(F.concat_ws("\t", *cols, F.coalesce(F.col("frame").cast("string"), F.lit(".")), attrs).alias("value")).write.text(path)
