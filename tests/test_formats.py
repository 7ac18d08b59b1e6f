"""Annotated databases and the further formats: small files, odd line ends, equal records, round trips."""

import pytest

from alignlake.sources import formats, lines, stockholm
from alignlake.sources.records import read_maf

STK = """# STOCKHOLM 1.0
#=GF ID fam
#=GF CC first line
#=GF CC second line
#=GS s2 DE a row
s1 AC-
#=GR s1 SS <.>
s2 A-C
#=GC SS_cons <.>

s1 GT
#=GR s1 SS ..
s2 --
#=GC SS_cons ..
//
# STOCKHOLM 1.0
#=GF ID fam
x a.
//
# STOCKHOLM 1.0
#=GF AC two
y c.
//
# STOCKHOLM 1.0
y c.
//
"""


def plain(tables):
    """All tables with ids in place of record numbers."""
    ids = {r.record: r.aln_id.split("~")[0].split("-")[0] for r in tables["aln_rows"].collect()}
    drop = ("record", "line_no", "aln_id")
    return {n: sorted(repr((ids[r.record], [r[c] for c in t.columns if c not in drop])) for r in t.collect()) for n, t in tables.items()}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_database_keeps_annotations_and_records_apart(spark, tmp_path, end):
    (tmp_path / "a.stk").write_bytes(STK.replace("\n", end).encode())
    got = stockholm.read_database(spark, str(tmp_path / "a.stk"))
    rows = got["aln_rows"].collect()
    assert len({r.aln_id for r in rows}) == len({r.record for r in rows}) == 4
    assert sorted((r.row_no, r.name, r.gapped) for r in rows) == [(0, "s1", "AC-GT"), (0, "x", "a."), (0, "y", "c."), (0, "y", "c."), (1, "s2", "A-C--")]
    assert [(r.tag, r.value) for r in got["aln_tags"].orderBy("record", "line_no").collect() if r.tag == "CC"] == [("CC", "first line"), ("CC", "second line")]
    assert [(r.name, r.tag, r.value) for r in got["row_tags"].collect()] == [("s2", "DE", "a row")]
    assert [(r.tag, r.text) for r in got["col_annot"].collect()] == [("SS_cons", "<.>..")]
    assert [(r.name, r.tag, r.text) for r in got["cell_annot"].collect()] == [("s1", "SS", "<.>..")]
    stockholm.write_database(got, str(tmp_path / "out"))
    assert plain(stockholm.read_database(spark, str(tmp_path / "out"))) == plain(got)


def test_any_format(spark, tmp_path):
    (tmp_path / "a.stk").write_text(STK)
    (tmp_path / "a.fa").write_text(">p\nAC\n>q\nG\n")
    assert stockholm.read_any(spark, str(tmp_path / "a.stk")).count() == 5
    assert sorted(map(tuple, stockholm.read_any(spark, str(tmp_path / "a.fa")).collect())) == [("p", 0, "p", "AC"), ("q", 0, "q", "G")]


def test_equal_blocks_stay_apart(spark, tmp_path):
    (tmp_path / "a.maf").write_text("a score=1\ns x 1 2 + 9 AC\nq x 99\n\na score=1\ns x 1 2 + 9 AC\nq x 99\n")
    got = read_maf(spark, str(tmp_path / "a.maf")).collect()
    assert len({r.block for r in got}) == 2 and [r.quality for r in got] == ["99", "99"]


def test_interleaved(spark, tmp_path):
    (tmp_path / "c.aln").write_text("CLUSTAL W\n\nb  AC-\na  A-C\n   * \n\nb  GT 5\na  -- 2\n   . \n")
    got = formats.read_interleaved(spark, str(tmp_path / "c.aln")).orderBy("row_no").collect()
    assert [(r.row_no, r.name, r.gapped) for r in got] == [(0, "b", "AC-GT"), (1, "a", "A-C--")]
    (tmp_path / "m.msf").write_text(" x.msf MSF: 6\n\n Name: b Len: 6\n Name: a Len: 6\n\n//\n\nb  AC- GT\na  A~C --\n")
    got = formats.read_interleaved(spark, str(tmp_path / "m.msf"), "msf").orderBy("row_no").collect()
    assert [(r.row_no, r.name, r.gapped) for r in got] == [(0, "b", "AC.GT"), (1, "a", "A.C..")]


def test_families_and_tagged_records(spark, tmp_path):
    (tmp_path / "f.txt").write_text("#x\ng1 a AC-\ng1 b A-C\ng2 c G\n")
    trees = spark.createDataFrame([("g1", "(a,b);")], "group_id string, tree string")
    got = sorted(map(tuple, formats.read_family_table(spark, str(tmp_path / "f.txt"), trees).collect()))
    assert got == [("g1", "a", "AC-", "(a,b);"), ("g1", "b", "A-C", "(a,b);"), ("g2", "c", "G", None)]
    (tmp_path / "t.txt").write_text("FAM PF1\nNAM s1\nALN AC\n//\nFAM PF2\nXYZ\n//\n")
    got = formats.read_tagged_records(spark, str(tmp_path / "t.txt"), {"FAM": "family"}).collect()
    assert sorted((r.tag, r.value) for r in got) == [("ALN", "AC"), ("NAM", "s1"), ("XYZ", ""), ("family", "PF1"), ("family", "PF2")]


def test_trace(spark, tmp_path):
    (tmp_path / "s.fa").write_text("iterations = 0\n>a\nAC\n-\n>b\nA-C\niterations = 10\n>a\nA-C\n>b\nAC-\n")
    (tmp_path / "t.txt").write_text("(a,b);\n(b,a);\n")
    (tmp_path / "p.txt").write_text("iter\tk\tm\n0\t1.5\tx\n10\t2\t3\n")
    got = formats.read_trace(spark, str(tmp_path / "s.fa"), str(tmp_path / "t.txt"), str(tmp_path / "p.txt"))
    assert sorted((r.iteration, r.row_no, r.name, r.gapped) for r in got["samples"].collect()) == [(0, 0, "a", "AC-"), (0, 1, "b", "A-C"), (10, 0, "a", "A-C"), (10, 1, "b", "AC-")]
    assert sorted(map(tuple, got["trees"].collect())) == [(0, "(a,b);"), (1, "(b,a);")]
    assert sorted(map(repr, map(tuple, got["params"].collect()))) == sorted(map(repr, [(0, "k", 1.5), (0, "m", None), (10, "k", 2.0), (10, "m", 3.0)]))


def test_trees(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("((U:.01,V:.01)UV:.02,(W:.1,('X, y':1e-1,Y)XY:.01[note])W2:.05)R:.03;\n(a,(b,c));\nsolo;\n")
    rows = formats.read_trees(spark, str(tmp_path / "t.nwk")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.tree_id, {})[r.node] = r
    links = {frozenset((r.name, t[r.parent].name if r.parent is not None else None, r.branch_len) for r in t.values()) for t in by.values()}
    first = frozenset({("U", "UV", 0.01), ("V", "UV", 0.01), ("UV", "R", 0.02), ("W", "W2", 0.1), ("X, y", "XY", 0.1), ("Y", "XY", None), ("XY", "W2", 0.01), ("W2", "R", 0.05), ("R", None, 0.03)})
    assert links == {first, frozenset({("a", None, None), ("b", None, None), ("c", None, None), (None, None, None)}), frozenset({("solo", None, None)})}


def test_column_format_and_family_dirs(spark, tmp_path):
    (tmp_path / "c.col").write_text("; ALIGN a Begin\n; ALIGN b Begin\n; ALIGN a AC -G\n; ALIGN b A- CG\n; ALIGN Structure (. .)\n; ALIGN a T\n; ALIGN b -\n; ALIGN x C\n; ALIGN a End\n")
    got = formats.read_column_format(spark, str(tmp_path / "c.col"))
    assert [(r.row_no, r.name, r.gapped) for r in got["rows"].orderBy("row_no").collect()] == [(0, "a", "AC-GT"), (1, "b", "A-CG-")]
    assert [(r.tag, r.text) for r in got["col_annot"].collect()] == [("SS_cons", "<..>")]
    (tmp_path / "h" / "kin").mkdir(parents=True)
    (tmp_path / "h" / "kin" / "kin.ali").write_text("C; family: kinase\nC; class: alpha\n>P1;x\nstructure\nAC-\nGT*\n>P1;y\nstructure\nA-CGT*\n")
    (tmp_path / "h" / "kin" / "kin.tem").write_text(">P1;x\nsequence\nAC-GT*\n>P1;x\nhelix\nHH-\nEE*\n")
    got = formats.read_family_dirs(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, got["rows"].collect())) == [("kin", "x", "AC-GT"), ("kin", "y", "A-CGT")]
    assert sorted(map(tuple, got["tags"].collect())) == [("kin", "class", "alpha"), ("kin", "family", "kinase")]
    assert [tuple(r) for r in got["cell_annot"].collect()] == [("kin", "x", "helix", "HH-EE")]


def test_sinks(spark, tmp_path):
    seqs = spark.createDataFrame([("r", "GAC")], "name string, seq string")
    formats.write_ct(seqs, spark.createDataFrame([("r", 0, 2)], "name string, lpos int, rpos int"), str(tmp_path / "ct"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ct" / "name=r")).collect()] == ["3 ENERGY = 0    r    3 bp RNA", "  1 G       0    2    3    1", "  2 A       1    3    0    2", "  3 C       2    4    1    3"]
    rows = spark.createDataFrame([(4, None, 0, "a", "A-"), (4, None, 1, "in", "AC"), (7, "Refined", 0, "a", "AC"), (9, "x", 0, "a", "AC")], "sample int, type string, row_no int, name string, gapped string")
    formats.write_trace(rows, str(tmp_path / "mpd"), spark.createDataFrame([(4, "in")], "sample int, name string"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "mpd")).collect()) == sorted(f"Sample {n}\tAlignment:\t{x}" for n, x in ((0, ">a"), (0, "A-"), (1, ">a"), (1, "AC")))
    cells = spark.createDataFrame([("a", 0, "x", 1, "C"), ("a", 0, "x", 0, "A")], "aln_id string, row_no int, name string, col int, ch string")
    formats.save_cells(cells, str(tmp_path / "cells"))
    assert sorted(r.col for r in spark.read.parquet(str(tmp_path / "cells")).collect()) == [0, 1]


def test_marks_are_carried_over_splits(spark, tmp_path):
    (tmp_path / "l.txt").write_text("".join(f"line {i}{'!' if i % 50 == 0 else ''}\n" for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        from pyspark.sql import functions as F

        at = lines.ordered_lines(spark, str(tmp_path / "l.txt"))
        got = lines.carried(at.withColumn("m", F.when(F.col("value").endswith("!"), F.col("value"))), "m", "head").orderBy("split", "at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r.split for r in got}) > 5
    assert [(r.value.rstrip("!"), r.head) for r in got] == [(f"line {i}", f"line {i // 50 * 50}!") for i in range(400)]
