"""Streams of alignment records, log lines and samples with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from alignlake.operators import compare as C
from alignlake.operators import packed as P
from alignlake.operators.alignment import to_residues
from alignlake.scratch import scratch_dir


def read_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment files as they arrive: ``(aln_id, n_rows, n_columns, gap_share)`` of each record, without state."""
    records = spark.readStream.text(folder, lineSep="\n//\n").where("trim(value) != ''")
    names = F.regexp_extract_all("value", F.lit(r"(?m)^([^#/\s]\S*)[ \t]+\S+"), F.lit(1))
    chunks = F.regexp_extract_all("value", F.lit(r"(?m)^[^#/\s]\S*[ \t]+(\S+)"), F.lit(1))
    found = records.select(F.regexp_extract("value", r"(?m)^#=GF +(?:ID|AC) +(\S+)", 1).alias("aln_id"), F.size(F.array_distinct(names)).alias("n_rows"), F.array_join(chunks, "").alias("text"))
    gaps = F.length("text") - F.length(F.translate("text", "-.", ""))
    return found.where("n_rows > 0").select("aln_id", "n_rows", (F.length("text") / F.col("n_rows")).cast("int").alias("n_columns"), F.round(gaps / F.length("text"), 9).alias("gap_share"))


def record_rows(records: DataFrame) -> DataFrame:
    """``value`` texts of one alignment each -> ``(aln_id, row_no, name, gapped, tags)``, wrapped rows joined, ``tags`` a map of its ``#=GF`` lines."""
    pick = lambda form, i: F.regexp_extract_all("value", F.lit(form), F.lit(i))
    row, gf = r"(?m)^([^#/\s]\S*)[ \t]+(\S+)", r"(?m)^#=GF[ \t]+(\S+)[ \t]+(.*?)[ \t]*$"
    tags = F.map_from_entries(F.array_distinct(F.transform(F.array_distinct(pick(gf, 1)), lambda t: F.struct(t, F.element_at(pick(gf, 2), F.array_position(pick(gf, 1), t).cast("int"))))))
    lines = records.select(tags.alias("tags"), pick(row, 1).alias("names"), pick(row, 2).alias("chunks"))
    each = lines.select("tags", "names", "chunks", F.posexplode(F.array_distinct("names")).alias("row_no", "name"))
    mine = F.filter(F.arrays_zip("names", "chunks"), lambda x: x["names"] == F.col("name"))
    aln = F.coalesce(F.col("tags")["ID"], F.col("tags")["AC"])
    return each.select(aln.alias("aln_id"), "row_no", "name", F.array_join(F.transform(mine, lambda x: x["chunks"]), "").alias("gapped"), "tags")


def filtered_records(rows: DataFrame, tag: str, least: float, threshold: float) -> DataFrame:
    """Alignments whose number ``tag`` is over ``least``, gappy columns dropped -> ``(aln_id, n_rows, n_cols, percent_id)``."""
    kept = rows.where(F.col("tags")[tag].try_cast("double") > least)
    texts = P.unpack(P.drop_gappy(P.pack(kept), threshold)).withColumnRenamed("text", "gapped")
    size = texts.groupBy("aln_id").agg(F.count("*").alias("n_rows"), F.max(F.length("gapped")).cast("long").alias("n_cols"))
    return size.join(C.percent_identity(to_residues(texts)), "aln_id", "left")


def monitor_alignments(spark: SparkSession, folder: str, tag: str = "SC", least: float = 0.0, threshold: float = 1.0) -> DataFrame:
    """Run ``filtered_records`` on each record of a folder as it arrives, batch by batch, and read what was found.

    A batch's results replace those of an attempt before it, so a restart from the state's folder gives each record once.
    """
    stream = spark.readStream.text(folder, lineSep="\n//\n").where("trim(value) != ''")
    out = scratch_dir(spark)

    def each(batch: DataFrame, number: int) -> None:
        filtered_records(record_rows(batch), tag, least, threshold).write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    schema = StructType.fromDDL("aln_id string, n_rows long, n_cols long, percent_id double, batch int")
    return _table(spark, f"{out}/table", schema).drop("batch")


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream's table; without rows if nothing came."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def level_counts(lines: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``(ts, level)`` -> lines of each level in each tumbling window; lines more than ``late`` behind the newest one of an earlier batch are dropped."""
    counts = lines.withWatermark("ts", late).groupBy(F.window("ts", width), "level").agg(F.count("*").alias("n"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "level", "n")


_MEANS = "parts array<long>, sums array<double>, counts array<long>"


def trace_monitor(samples: DataFrame, size: int, goal: float, forgive: int) -> DataFrame:
    """``(trace, sample_no, score)`` -> ``(trace, part, n, mean, low, stop)``: each window of ``size`` samples, as often as it changes.

    ``low`` counts the windows up to this one whose mean is under ``goal``; ``stop`` says that more than ``forgive`` are,
    as soon as the stream knows.  A trace's windows are its state (a few numbers each), so late samples change their
    window and those behind it.  Null scores don't count; a window of nulls alone has no mean.
    """
    kind = samples.schema["trace"].dataType.simpleString()

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {p: (s, n) for p, s, n in zip(*state.get, strict=True)} if state.exists else {}
        first = None
        for batch in batches:
            for part, scores in batch.groupby(batch["sample_no"] // size)["score"]:
                s, n = held.get(int(part), (0.0, 0))
                held[int(part)] = (s + float(scores.sum()), n + int(scores.count()))
                first = int(part) if first is None else min(first, int(part))
        parts = sorted(held)
        state.update((parts, [held[p][0] for p in parts], [held[p][1] for p in parts]))
        low, rows = 0, []
        for p in parts:
            s, n = held[p]
            mean = round(s / n, 6) if n else None
            low += mean is not None and mean < goal
            if first is not None and p >= first:
                rows.append((key[0], p, n, mean, low, low > forgive))
        yield pd.DataFrame(rows, columns=["trace", "part", "n", "mean", "low", "stop"])

    out = f"trace {kind}, part long, n long, mean double, low long, stop boolean"
    return samples.select("trace", "sample_no", "score").groupBy("trace").applyInPandasWithState(each, out, _MEANS, "update", "NoTimeout")


def drain(stream: DataFrame, keys: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """Run a stream over all that has arrived and read its result table.

    The table and the stream's own state lie in ``folder``, from which a later call goes on, or in a scratch folder below
    ``spark.checkpoint.dir``.  Without ``keys``
    rows are added.  With them each batch hands on the rows that it changed, and the newest row of a key counts;
    state that a watermark has passed is dropped, its rows stay in the table.
    """
    spark = stream.sparkSession
    folder = folder or scratch_dir(spark)
    if keys:
        sink = stream.writeStream.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/table/batch={i}"))
    else:
        sink = stream.writeStream.format("parquet").option("path", f"{folder}/table")
    sink.outputMode("update" if keys else "append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    if not keys:
        return spark.read.schema(stream.schema).parquet(f"{folder}/table")
    rows = _table(spark, f"{folder}/table", StructType([*stream.schema.fields, *StructType.fromDDL("batch long").fields]))
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("place", newest).where("place = 1").drop("batch", "place")
