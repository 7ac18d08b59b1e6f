"""Readers on files that are slightly odd, and streams that get nothing or are started again."""

import pytest

from alignlake.sources import formats, records, stockholm, text
from alignlake.streaming import jobs


@pytest.mark.parametrize("sep", ["//", "// ", " //", "\t// \t"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_separators_with_blanks(spark, tmp_path, sep, end):
    body = f"# STOCKHOLM 1.0\n#=GF ID one\na AC\n{sep}\n# STOCKHOLM 1.0\n#=GF ID two\nb G\n{sep}\n"
    (tmp_path / "a.stk").write_bytes(body.replace("\n", end).encode())
    got = stockholm.read_database(spark, str(tmp_path / "a.stk"))["aln_rows"].collect()
    assert sorted((r.aln_id, r.name, r.gapped) for r in got) == [("one", "a", "AC"), ("two", "b", "G")]


def test_a_line_that_only_begins_like_a_separator(spark, tmp_path):
    (tmp_path / "a.stk").write_text("//\n#=GF ID one\na AC\n//not the end\nb GT\n//\n#=GF ID two\nc G\n//")
    got = stockholm.read_database(spark, str(tmp_path / "a.stk"))["aln_rows"].collect()
    assert sorted((r.aln_id, r.name, r.gapped) for r in got) == [("one", "a", "AC"), ("one", "b", "GT"), ("two", "c", "G")]
    (tmp_path / "empty.stk").write_text("")
    assert stockholm.read_database(spark, str(tmp_path / "empty.stk"))["aln_rows"].count() == 0


def test_a_name_twice_in_a_block(spark, tmp_path):
    (tmp_path / "a.maf").write_text("a score=1\nq x 00\ns x 1 2 + 9 AC\nq x 99\ns x 3 2 + 9 GT\ns y 3 1 + 9 GT\nq x 88\nq x 77\n")
    got = records.read_maf(spark, str(tmp_path / "a.maf")).collect()
    assert sorted((r.name, r.start, r.quality) for r in got) == [("x", 1, "99"), ("x", 3, "88"), ("y", 3, None)]


def test_fasta_choices(spark, tmp_path):
    rows = spark.createDataFrame([("b", None, "A-C.G"), ("a", "note", "--")], "seq_id string, descr string, seq string")
    text.write_fasta(rows, str(tmp_path / "x"), 2, gapped=False, sort=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "x")).collect()] == [">a note", "", ">b", "AC", "G"]


def test_tracks_come_in_order(spark, tmp_path):
    track = spark.createDataFrame([(s, "t", i, i + 0.5) for s in "ab" for i in range(200)], "seq_id string, track string, pos int, value double").repartition(7)
    records.write_wig(track, str(tmp_path / "w"))
    lines = [r.value for f in sorted((tmp_path / "w").glob("part-*")) for r in spark.read.text(str(f)).collect()]
    want = [x for s in "ab" for x in ("track type=wiggle_0 name=t", f"fixedStep chrom={s} start=0 step=1", *(str(i + 0.5) for i in range(200)))]
    assert lines == want


def test_quoted_names_with_blanks_around(spark, tmp_path):
    (tmp_path / "t").write_text("( \n'a b' :1,\tc\n)r;")
    got = formats.read_trees(spark, str(tmp_path / "t")).collect()
    assert sorted((r.node, r.parent, r.name, r.branch_len) for r in got if r.parent is not None) == [(0, 2, "a b", 1.0), (1, 2, "c", None)]


def test_streams_that_get_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert jobs.monitor_alignments(spark, str(tmp_path / "in")).columns == ["aln_id", "n_rows", "n_cols", "percent_id"]
    lines = spark.readStream.schema("ts timestamp, level string").parquet(str(tmp_path / "in"))
    got = jobs.drain(jobs.level_counts(lines), ("start", "level"))
    assert got.count() == 0 and got.columns == ["start", "level", "n"]


def test_lines_later_than_the_watermark_are_dropped(spark, tmp_path):
    def add(name, stamps):
        rows = [(s, "info") for s in stamps]
        spark.createDataFrame(rows, "ts string, level string").selectExpr("cast(ts as timestamp) ts", "level").coalesce(1).write.parquet(str(tmp_path / name))

    add("1", ["2024-01-05 00:10:00", "2024-01-05 00:20:00"])
    add("2", ["2024-01-05 00:25:00"])
    add("3", ["2024-01-01 00:10:00", "2024-01-05 00:30:00", "2024-01-04 12:00:00"])
    lines = spark.readStream.schema("ts timestamp, level string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    got = {(r.start, r.n) for r in jobs.drain(jobs.level_counts(lines), ("start", "level")).collect()}
    assert ("2024-01-05 00:00", 4) in got and ("2024-01-04 12:00", 1) in got and len(got) == 2


def test_records_are_measured_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = "# STOCKHOLM 1.0\n#=GF ID {0}\n#=GF SC {1}\na AC-\nb AG-\n\na TT\nb T-\n//\n"
    (tmp_path / "in" / "a").write_text(one.format("x", 5) + one.format("y", 1))
    got = jobs.monitor_alignments(spark, str(tmp_path / "in"), "SC", 2, 0.6).collect()
    assert [tuple(r) for r in got] == [("x", 2, 4, 66.666666667)]


def test_the_stop_flag_comes_before_the_stream_ends_and_survives_a_restart(spark, tmp_path):
    def add(name, rows):
        spark.createDataFrame(rows, "trace string, sample_no long, score double").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        samples = spark.readStream.schema("trace string, sample_no long, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        found = jobs.drain(jobs.trace_monitor(samples, 2, 5.0, 1), ("trace", "part"), str(tmp_path / "kept"))
        return {(r.trace, r.part): (r.n, r["mean"], r.low, r.stop) for r in found.collect()}

    add("1", [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 0, 9.0)])
    add("2", [("a", 3, None), ("a", 4, 9.0)])
    first = run()
    assert first == {("a", 0): (2, 1.5, 1, False), ("a", 1): (1, 4.0, 2, True), ("a", 2): (1, 9.0, 2, True), ("b", 0): (1, 9.0, 0, False)}
    early = spark.read.parquet(str(tmp_path / "kept" / "table" / "batch=0")).where("stop").collect()
    assert [(r.trace, r.part) for r in early] == [("a", 1)]  # a batch was still to come
    add("3", [("a", 1, 90.0), ("b", 1, 0.0)])  # a late sample lifts the first window
    assert run() == {("a", 0): (3, 31.0, 0, False), ("a", 1): (1, 4.0, 1, False), ("a", 2): (1, 9.0, 1, False), ("b", 0): (2, 4.5, 1, False)}
