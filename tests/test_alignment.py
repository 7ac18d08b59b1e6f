"""Hand-worked fixtures for the alignment operators."""

from alignlake.operators import alignment as A
from alignlake.operators import compare as C

ROWS = "aln_id string, row_no int, name string, gapped string"


def cells(spark, *rows):
    return A.to_cells(spark.createDataFrame([("x", i, n, g) for i, (n, g) in enumerate(rows)], ROWS))


def test_compare_two_alignments(spark):
    a, b = cells(spark, ("s1", "AC-G"), ("s2", "A-CG")), cells(spark, ("s1", "ACG"), ("s2", "ACG"))
    r = C.compare_alignments(a, b).first()
    assert (r.pairs_a, r.pairs_b, r.pairs_both, r.cols_a, r.cols_both) == (2, 3, 2, 4, 2)
    assert (r.sps, r.tcs) == (1.0, 0.5) and abs(r.ppv - 2 / 3) < 1e-8 and abs(r.ama - 2 / 3) < 1e-8


def test_comparison_laws(spark):
    a, b = cells(spark, ("s1", "AC-GT"), ("s2", "A-CG-")), cells(spark, ("s1", "ACGT"), ("s2", "-ACG"))
    same, there, back = (C.compare_alignments(*x).first() for x in ((a, a), (a, b), (b, a)))
    assert same.sps == same.ppv == same.tcs == same.ama == 1.0
    assert there.sps == back.ppv and there.ppv == back.sps


def test_percent_identity(spark):
    a = cells(spark, ("s1", "AC-G"), ("s2", "A-CG"))
    assert C.percent_identity(a).first().percent_id == 100
    assert C.percent_identity(a, True).first().percent_id == 50


def test_reverse_slice_twice_is_the_same(spark):
    a = cells(spark, ("s1", "ac-gt"), ("s2", "a-cg-"))
    twice = A.subalign(A.subalign(a, 0, 5, "-"), 0, 5, "-")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, a.collect()))


def test_rows_and_cells_are_inverse(spark):
    a = cells(spark, ("s1", "a.c-"), ("s2", "-_gt"))
    assert sorted((r.name, r.gapped) for r in A.to_rows(a).collect()) == [("s1", "a.c-"), ("s2", "-_gt")]


def test_empty_columns_and_residue_ranges(spark):
    a = cells(spark, ("s1", "a--c"), ("s2", "--t-"))
    assert sorted((r.name, r.gapped) for r in A.to_rows(A.erase_empty_columns(a)).collect()) == [("s1", "a-c"), ("s2", "-t-")]
    got = {r.name: (r.first_pos, r.last_pos, r.offset) for r in A.columns_to_residues(a, 1, 3).collect()}
    assert got == {"s1": (1, 1, 2), "s2": (0, 0, 1)}


def test_concatenate_pads_missing_rows(spark):
    a = spark.createDataFrame([("x", 0, "s1", "ac")], ROWS)
    b = spark.createDataFrame([("x", 0, "s2", "gtt")], ROWS)
    assert sorted((r.name, r.gapped) for r in A.concatenate(a, b).collect()) == [("s1", "ac..."), ("s2", "..gtt")]


def test_redundant_row_goes(spark):
    a = cells(spark, ("s1", "acgt"), ("s2", "acgt"), ("s3", "aggg"))
    assert sorted(r.name for r in C.nonredundant(a).collect()) == ["s2", "s3"]
