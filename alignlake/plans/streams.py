"""Queries that run a stream over the ``events`` table until all of it is read, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from alignlake.plans import inputs as I
from alignlake.scratch import scratch_dir
from alignlake.streaming import jobs

QUERIES, ORACLES = {}, {}


def _events(spark, sf_dir):
    schema = I.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def r2_level_counts(spark, sf_dir):
    return jobs.drain(jobs.level_counts(_events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("level"))), ("start", "level"))


def r3_trace_monitor(spark, sf_dir):
    samples = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("trace"), F.col("event_id").alias("sample_no"), F.col("value").alias("score"))
    return jobs.drain(jobs.trace_monitor(samples, 200, 50.0, 1), ("trace", "part"))


def r1_record_stream(spark, sf_dir):
    """Alignments as records with a score (their residues); those over 500 lose gappy columns and are measured as they arrive."""
    rows = I.rows(spark, sf_dir).where("gapped != ''")
    lines = F.array_sort(F.collect_list(F.struct("row_no", F.concat_ws(" ", "name", F.substring("gapped", 1, 70)).alias("a"), F.concat_ws(" ", "name", F.nullif(F.substring("gapped", 71, 1 << 30), F.lit(""))).alias("b"))))
    score = F.sum(F.length(F.translate("gapped", "-", "")))
    each = rows.groupBy("aln_id").agg(lines.alias("l"), score.alias("score"))
    part = lambda c: F.array_join(F.transform("l", lambda x: x[c]), "\n")
    text = F.concat(F.lit("# STOCKHOLM 1.0\n#=GF ID "), "aln_id", F.lit("\n#=GF SC "), "score", F.lit("\n"), part("a"), F.lit("\n\n"), part("b"), F.lit("\n//"))
    folder = scratch_dir(spark)
    each.select(text.alias("value")).write.text(folder)
    return jobs.monitor_alignments(spark, folder, "SC", 500, 0.5)


QUERIES |= {"r1_record_stream": r1_record_stream, "r2_level_counts": r2_level_counts, "r3_trace_monitor": r3_trace_monitor}
ORACLES |= {
    "r1_record_stream": f"""WITH {I.CELLS}, big AS (SELECT aln_id, count(DISTINCT row_no) AS n_rows FROM cells GROUP BY aln_id HAVING count(*) FILTER (WHERE NOT is_gap) > 500),
k AS (SELECT aln_id, col, count(*) AS n FROM cells SEMI JOIN big USING (aln_id) GROUP BY ALL HAVING count(*) FILTER (WHERE is_gap) < 0.5 * count(*)),
s AS (SELECT aln_id, col, ch, count(*) AS n FROM cells SEMI JOIN k USING (aln_id, col) WHERE NOT is_gap GROUP BY ALL), t AS (SELECT aln_id, col, max(n) AS top, sum(n) AS residues FROM s GROUP BY ALL),
p AS (SELECT aln_id, round(100 * avg(CASE WHEN top > 1 THEN top ELSE 0 END / residues), 9) AS percent_id FROM t WHERE residues > 1 GROUP BY aln_id), c AS (SELECT aln_id, count(*) AS n_cols FROM k GROUP BY aln_id)
SELECT big.aln_id, n_rows, coalesce(n_cols, 0) AS n_cols, percent_id FROM big LEFT JOIN c USING (aln_id) LEFT JOIN p USING (aln_id)""",
    "r2_level_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type AS level, count(*) AS n FROM events GROUP BY ALL",
    "r3_trace_monitor": """WITH m AS (SELECT user_id % 20 AS trace, event_id // 200 AS part, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL),
l AS (SELECT *, (sum(CASE WHEN mean < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY trace ORDER BY part))::BIGINT AS low FROM m) SELECT *, low > 1 AS stop FROM l""",
}
