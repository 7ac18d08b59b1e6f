"""Further formats and streams: small files and round trips."""

from alignlake.sources import records, text
from alignlake.streaming import jobs

STK = "# STOCKHOLM 1.0\n#=GF ID fam\ns1 AC-\ns2 A-C\n\ns1 GT\ns2 --\n//\n# STOCKHOLM 1.0\n#=GF ID two\nx a.\n//\n"


def test_gapped_fasta_faults(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nA-\n>x\nAC\n>y\nA\n")
    rows = records.read_gapped_fasta(spark, str(tmp_path / "a.fa"), "a")
    assert [tuple(r) for r in records.faults(rows).collect()] == [("a", 3, 2, 2)]


def test_maf_and_folds(spark, tmp_path):
    (tmp_path / "a.maf").write_text("##maf version=1\n\na score=5 pass=2\ns hg.1 10 3 + 99 AC-G\nq hg.1 9999\ns mm.1 0 4 - 50 ACTG\n\na\ns x 1 1 + 2 A\n")
    got = records.read_maf(spark, str(tmp_path / "a.maf")).orderBy("name").collect()
    assert [(r.name, r.start, r.strand, r.gapped) for r in got] == [("hg.1", 10, "+", "AC-G"), ("mm.1", 0, "-", "ACTG"), ("x", 1, "+", "A")]
    assert got[0].tags["score"] == "5"
    (tmp_path / "f.txt").write_text(">r1 note\nGGAAACC\n((...)) (-1.2)\n>r2\nAC\n..\n")
    assert sorted(map(tuple, records.read_folds(spark, str(tmp_path / "f.txt")).collect())) == [("r1", "GGAAACC", "<<...>>"), ("r2", "AC", "..")]


def test_log_lines_carry_their_header(spark, tmp_path):
    (tmp_path / "l.log").write_text("stray\n<log date='d1' time='t1' file='a.cc' line='7' level='3'>\none\ntwo\n<log date='d2' time='t2' file='b.cc' line='8' level='x'>\nthree\n")
    got = records.read_log(spark, str(tmp_path / "l.log")).orderBy("split", "at").collect()
    assert [(r.date, r.src_file, r.src_line, r.level, r.text) for r in got] == [("d1", "a.cc", 7, 3, "one"), ("d1", "a.cc", 7, 3, "two"), ("d2", "b.cc", 8, None, "three")]


def test_tracks_and_tab_rows(spark, tmp_path):
    track = spark.createDataFrame([("s", "t", 1, 0.5), ("s", "t", 0, 1.5)], "seq_id string, track string, pos int, value double")
    records.write_wig(track, str(tmp_path / "wig"))
    assert [r.value for r in spark.read.text(str(tmp_path / "wig")).collect()] == ["track type=wiggle_0 name=t", "fixedStep chrom=s start=0 step=1", "1.5", "0.5"]
    rows = spark.createDataFrame([(1, "A-C", 2, "n")], "`from` long, gapped string, `to` long, name string")
    records.write_plain(rows, str(tmp_path / "tab"))
    assert [tuple(r) for r in records.read_plain(spark, str(tmp_path / "tab")).collect()] == [(1, "A-C", 2, "n")]


def test_alignment_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.stk").write_text(STK)
    got = jobs.drain(jobs.read_alignments(spark, str(tmp_path / "in")))
    assert sorted(map(tuple, got.collect())) == [("fam", 2, 5, 0.4), ("two", 1, 2, 0.5)]
