"""Removal of repeated word windows through a log-structured fingerprint index.

The index is a set of immutable runs sorted by window fingerprint.  Each new batch becomes a run, is
merge-joined with the runs before it, and runs of a level are compacted into one of the next.  What
the join proposes is verified on the windows' words before anything is removed.

Windows are stored by anchor (see ``anchors``): one entry stands for up to ``WINDOW`` neighbouring
windows, told apart by ``ctx``, the digest of all their words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignlake.llm.anchors import refine, runs
from alignlake.llm.common import small_batches
from alignlake.scratch import drop, free_name, freed_shuffles, materialise, numbered, remove, scratch_dir, write

WINDOW = 35
GRAM = 8
BATCHES = 4
FAN_IN = 2


def word_entries(data: bytes | None, window: int = WINDOW) -> tuple[list, list, list, list]:
    """(h, ctx, first window, windows) of each run of a text's word windows; h and ctx as signed 64-bit."""
    words = (data or b"").split()
    if len(words) < window:
        return [], [], [], []
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    grams = refine(refine(refine(ids, 1), 2), 4)
    at, lo, n = runs(grams, window - GRAM + 1)
    first, many = lo.tolist(), n.tolist()
    ctx = [xxhash.xxh3_64_intdigest(b" ".join(words[s : s + m + window - 1]), a - s) for a, s, m in zip(at.tolist(), first, many, strict=True)]
    return grams[at].view(np.int64).tolist(), np.array(ctx, np.uint64).view(np.int64).tolist(), first, many


def postings(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rows(_row, text)`` -> ``(_row, h, ctx, lo, n)``: the entries of every whole text."""
    small_batches(rows.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, h, ctx, lo, n = [], [], [], [], []
            for r, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                a, b, c, d = word_entries(t, window)
                row += [r] * len(a)
                h += a
                ctx += b
                lo += c
                n += d
            cols = [pa.array(x, t) for x, t in ((row, pa.int64()), (h, pa.int64()), (ctx, pa.int64()), (lo, pa.int32()), (n, pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["_row", "h", "ctx", "lo", "n"])

    return rows.select("_row", F.col("text").cast("binary")).mapInArrow(run, "_row long, h long, ctx long, lo int, n int")


class FingerprintIndex:
    """Immutable runs ``(h, ctx, occ, rep)``: how often an entry occurs, and one row that has it.

    Every run is bucketed by ``h`` once, when it is written, and sorted by ``h`` and ``ctx`` inside its buckets;
    joins and merges of runs deal nothing anew.  The folder holds the runs and a list of them, so a later session
    opens the same index by its path and adds batches to it; row numbers must then go on from one batch to the next.
    """

    SCHEMA = "h long, ctx long, occ long, rep long"

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in, self.path = spark, fan_in, path or scratch_dir(spark)
        self.runs: list[tuple[int, str]] = []  # level, name
        self.met: list[DataFrame] = []
        self.tables: dict[str, str] = {}
        self.version, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        for f in self._files("list-*"):
            version = int(f.rpartition("-")[2])
            if version > self.version:
                got = sorted(spark.read.schema("place int, level int, name string, buckets int").parquet(f).collect())
                self.version, self.runs = version, [(r.level, r.name) for r in got]
                self.buckets = got[0].buckets if got else self.buckets

    def _files(self, form: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{form}")
        return [str(f.getPath()) for f in where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []]

    def _keep(self) -> None:
        """Write the list of runs; the newest one counts."""
        rows = [(i, level, name, self.buckets) for i, (level, name) in enumerate(self.runs)]
        new = f"{self.path}/list-{self.version + 1}"
        write(self.spark.createDataFrame(rows, "place int, level int, name string, buckets int").coalesce(1), new)
        if self.version:
            remove(self.spark, f"{self.path}/list-{self.version}")
        self.version += 1

    def _write(self, run: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        with freed_shuffles(self.spark):
            bucketed = run.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h", "ctx").option("compression", "zstd")
            bucketed.option("path", f"{self.path}/{name}").saveAsTable(f"alignlake_{name}")
        self.tables[name] = f"alignlake_{name}"
        return name

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = f"alignlake_{uuid.uuid4().hex}"
            how = f"using parquet clustered by (h) sorted by (h, ctx) into {self.buckets} buckets"
            self.spark.sql(f"create table {self.tables[name]} (h bigint, ctx bigint, occ bigint, rep bigint) {how} location '{self.path}/{name}'")
        return self.spark.table(self.tables[name])

    def add(self, new: DataFrame) -> DataFrame:
        """Index a batch of postings; returns the fingerprints it shares with earlier batches or within itself."""
        added = self._write(new.groupBy("h", "ctx").agg(F.count("*").alias("occ"), F.min("_row").alias("rep")))
        run = self.read(added)
        met = run.groupBy("h").agg(F.sum("occ").alias("occ")).where("occ > 1").select("h")
        for _, name in self.runs:  # one for each level at most, but for runs that wait for their merge
            met = met.unionByName(run.select("h").join(self.read(name).select("h"), "h", "left_semi"))
        met = materialise(met.distinct())
        self.met.append(met)
        self.runs.append((0, added))
        while len(self.runs) >= self.fan_in and len({level for level, _ in self.runs[-self.fan_in :]}) == 1:
            self._merge(self.fan_in)
        self._keep()
        return met

    def _merge(self, count: int) -> None:
        """Put the newest ``count`` runs into one."""
        old = self.runs[-count:]
        union = reduce(DataFrame.unionByName, [self.read(name) for _, name in old])
        name = self._write(union.groupBy("h", "ctx").agg(F.sum("occ").alias("occ"), F.min("rep").alias("rep")))
        self.runs[-count:] = [(max(level for level, _ in old) + 1, name)]
        for _, gone in old:
            self._drop(gone)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {self.tables.pop(name)}")
        remove(self.spark, f"{self.path}/{name}")

    def repeated(self) -> DataFrame:
        """``(h, ctx, occ, rep, several)`` of all entries whose fingerprint met another since the index was opened; ``several``: with another ctx."""
        if len(self.runs) > 1:
            self._merge(len(self.runs))
            self._keep()
        met = reduce(DataFrame.unionByName, self.met).distinct()
        entries = self.read(self.runs[0][1]).join(met, "h", "left_semi")
        several = entries.groupBy("h").agg((F.count("*") > 1).alias("several"))
        return entries.join(several, "h").where("occ > 1 or several")

    def close(self, delete: bool = False) -> None:
        """Forget the runs' tables; their files stay for a later session unless ``delete``."""
        for name in list(self.tables):
            self.spark.sql(f"drop table if exists {self.tables.pop(name)}")
        drop(*self.met)
        if delete:
            remove(self.spark, self.path)


def repeats(rows: DataFrame, window: int = WINDOW, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """``rows(_row, text)`` -> ``(_row, runs array<struct<lo, n>>)``: window starts whose words start elsewhere too."""
    spark = rows.sparkSession
    path = scratch_dir(spark)
    batch = F.pmod(F.xxhash64("_row"), F.lit(batches)).cast("int").alias("batch")
    write(postings(rows, window).select("*", batch), path, "batch")
    schema = "_row long, h long, ctx long, lo int, n int, batch int"
    every = spark.read.schema(schema).parquet(path)
    index = FingerprintIndex(spark, fan_in=fan_in)
    for b in range(batches):
        index.add(every.where(F.col("batch") == b))
    known = materialise(index.repeated())
    index.close(delete=True)
    found = every.join(known, ["h", "ctx"])
    found = found.select("_row", F.struct("lo", "n", "h", (F.col("occ") > 1).alias("sure"), (F.col("several") & (F.col("_row") == F.col("rep"))).alias("open")).alias("m"))
    marks = materialise(found.groupBy("_row").agg(F.collect_list("m").alias("marks")))
    remove(spark, path)
    drop(known)

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[], [], [], [], []]
            for r, text, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = text.split()
                for m in wanted:
                    for i in range(m["lo"], m["lo"] + m["n"]):
                        d = xxhash.xxh3_64_intdigest(b" ".join(words[i : i + window]))
                        for c, x in zip(out, (m["h"], d - (1 << 64) if d >> 63 else d, r, i, 2 if m["sure"] else 1), strict=True):
                            c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "d", "_row", "at", "w"])

    small_batches(spark)
    wanted = F.filter("marks", lambda m: m["open"])
    unsure = marks.select("_row", wanted.alias("marks")).where(F.size("marks") > 0)
    texts = rows.select("_row", F.col("text").cast("binary").alias("text")).join(unsure, "_row").select("_row", "text", "marks")
    seen = materialise(texts.mapInArrow(windows, "h long, d long, _row long, at int, w int"))
    twice = seen.groupBy("h", "d").agg(F.sum("w").alias("w")).where("w > 1").select("h", "d")
    single = seen.where("w = 1").join(twice, ["h", "d"]).groupBy("_row").agg(F.collect_list(F.struct(F.col("at").alias("lo"), F.lit(1).alias("n"))).alias("runs"))
    sure = F.transform(F.filter("marks", lambda m: m["sure"]), lambda m: F.struct(m["lo"].alias("lo"), m["n"].alias("n")))
    none = F.array().cast("array<struct<lo:int,n:int>>")
    both = marks.join(single, "_row", "left").select("_row", F.concat(sure, F.coalesce("runs", none)).alias("runs"))
    out = materialise(both.where(F.size("runs") > 0))
    drop(marks, seen)
    return out


def strip_windows(text: bytes | None, spans: list | None, window: int = WINDOW) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by one space) given runs of window starts."""
    words = (text or b"").split()
    if spans is None or not len(spans):
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        edge[s["lo"]] += 1
        edge[s["lo"] + s["n"] + window - 1] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, into: str | None = None) -> DataFrame:
    """``docs`` with a struct of n_words, n_removed and kept: each word goes that a window of ``window``
    words covers whose word sequence also starts anywhere else, the same text included.

    Windows are judged on the input.  Null and empty texts have no words; repeated rows repeat every
    window of theirs; texts shorter than a window lose nothing; an empty table gives no rows.  All
    columns stay as they were; the struct is named ``into``, or ``stripped`` (with underscores before
    it if the table has such a column).
    """
    row, into = free_name(docs, "_row"), into or free_name(docs, "stripped")
    rows = numbered(docs, row)
    spans = repeats(rows.select(F.col(row).alias("_row"), "text"), window, batches)

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def strip(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        got = [strip_windows(t, s, window) for t, s in zip(text, spans, strict=True)]
        return pd.DataFrame({"n_words": [g[0] for g in got], "n_removed": [g[1] for g in got], "kept": [g[2].decode() for g in got]}, index=text.index)

    runs = free_name(docs, "_spans")
    joined = rows.join(spans.select(F.col("_row").alias(row), F.col("runs").alias(runs)), row, "left")
    return joined.select(*docs.columns, strip(F.col("text").cast("binary"), F.col(runs)).alias(into))
