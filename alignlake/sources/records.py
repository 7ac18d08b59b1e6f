"""More text formats: blocks, folds, logs and tab rows as tables; alignment, track and structure sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignlake.scratch import numbered
from alignlake.sources.lines import carried, line_end, ordered_lines
from alignlake.sources.text import read_fasta


def read_gapped_fasta(spark: SparkSession, path: str, aln_id: str) -> DataFrame:
    """One alignment from a FASTA file; ``faults`` finds names used twice and unequal lengths."""
    return read_fasta(spark, path).select(F.lit(aln_id).alias("aln_id"), F.col("seq_id").alias("name"), F.col("seq").alias("gapped"))


def faults(rows: DataFrame) -> DataFrame:
    """Alignments with a name used twice or with rows of unequal length."""
    n = rows.groupBy("aln_id").agg(F.count("*").alias("n_rows"), F.countDistinct("name").alias("n_names"), F.countDistinct(F.length("gapped")).alias("n_lengths"))
    return n.where("n_rows != n_names or n_lengths > 1")


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """``s`` rows of each ``a`` block, numbered, with the block's tags and qualities; other lines are left out.

    A ``q`` line belongs to the last ``s`` line of its name before it, so a name may stand in a block more than once; rows without one have null.
    """
    blocks = numbered(spark.read.text(path, lineSep=line_end(spark, path) * 2).select(F.replace("value", F.lit("\r"), F.lit("")).alias("value")), "block").where(r"value rlike '(?m)^a(\\s|$)'")
    tags = F.str_to_map(F.trim(F.regexp_extract("value", r"(?m)^a[ \t]*(.*)$", 1)), F.lit(r"\s+"), F.lit("="))
    lines = blocks.select("block", tags.alias("tags"), F.posexplode(F.split("value", "\n")).alias("line", "text")).where(r"text rlike '^[sq]\\s'")
    f = lines.select("block", "tags", "line", F.split("text", r"\s+").alias("f"))
    f = f.withColumn("kind", F.col("f")[0]).withColumn("name", F.col("f")[1])
    own = F.last(F.when(F.col("kind") == "s", F.col("line")), ignorenulls=True).over(W.partitionBy("block", "name").orderBy("line"))
    number = lambda i: F.col("s.f")[i].try_cast("long")
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("line", "f")))
    rows = f.withColumn("own", own).where("own is not null").groupBy("block", "name", "own").agg(F.first("tags").alias("tags"), of("s").alias("s"), of("q").alias("q"))
    return rows.select(
        "block", "name", "tags", F.col("own").alias("line"), number(2).alias("start"), number(3).alias("size"), F.col("s.f")[4].alias("strand"), number(5).alias("src_size"), F.col("s.f")[6].alias("gapped"), F.get("q.f", F.lit(2)).alias("quality"),
    )


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """``(name, seq, brackets)`` of folding output: a ``>name`` line, residues, brackets with an energy behind; ``()`` become ``<>``."""
    parts = spark.read.text(path, lineSep="\n>").where("trim(value) != ''").select(F.split(F.regexp_replace("value", "^>", ""), "\n").alias("l"))
    return parts.select(F.regexp_extract(F.col("l")[0], r"^(\S+)", 1).alias("name"), F.trim(F.col("l")[1]).alias("seq"), F.translate(F.regexp_extract(F.col("l")[2], r"^([().]+)", 1), "()", "<>").alias("brackets"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Body lines with the fields of the header line before them, within each file; ``at`` orders them."""
    lines = ordered_lines(spark, path).withColumnRenamed("value", "text")
    body = carried(lines.withColumn("mark", F.when(F.col("text").startswith("<log "), F.col("text"))), "mark", "head")
    body = body.where("head is not null and text != '' and mark is null")
    field = lambda name: F.regexp_extract("head", rf"\b{name}=['\"]?([^'\"\s>]*)", 1)
    tags = F.filter(F.split(F.regexp_extract("head", r"\btags=['\"]?([^'\">]*)", 1), r"[\s,]+"), lambda t: t != "")
    return body.select(
        "file", "split", "at", field("date").alias("date"), field("time").alias("time"), field("file").alias("src_file"), field("line").try_cast("int").alias("src_line"),
        field("level").try_cast("int").alias("level"), tags.alias("tags"), "text",
    )


def write_wig(track: DataFrame, path: str) -> None:
    """``(seq_id, track, pos, value)`` as fixed-step tracks: two header lines, then a value a line; a long track lies in several files, in order."""
    keys = ("seq_id", "track")
    head = F.concat(F.lit("track type=wiggle_0 name="), "track", F.lit("\nfixedStep chrom="), "seq_id", F.lit(" start=0 step=1"))
    lines = track.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("value").cast("string").alias("line"))
    lines = lines.unionByName(track.select(*keys).distinct().select(*keys, F.lit(-1).cast("long").alias("pos"), head.alias("line")))
    lines.repartitionByRange(*keys, "pos").sortWithinPartitions(*keys, "pos").select("line").write.text(path)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """Tab rows: from, gapped row, to, name."""
    return spark.read.csv(path, sep="\t", schema="`from` long, gapped string, `to` long, name string")


def write_plain(rows: DataFrame, path: str) -> None:
    rows.select("from", "gapped", "to", "name").write.csv(path, sep="\t")
