"""Structures and translation on small worked cases."""

from alignlake.operators import annotate as N
from alignlake.operators import sequences as S
from alignlake.operators.alignment import to_cells


def cells(spark, *rows):
    return to_cells(spark.createDataFrame([("a", i, f"s{i}", r) for i, r in enumerate(rows)], "aln_id string, row_no int, name string, gapped string"))


def pairs(df):
    return sorted((r.lcol, r.rcol) for r in df.collect())


def test_stems_of_a_bracket_string(spark):
    marks = spark.createDataFrame([("x", i, c) for i, c in enumerate("<<..<<<>>>>>") if c != "."], "id string, col int, ch string")
    found = S.bracket_pairs(marks)
    assert pairs(found) == [(0, 11), (1, 10), (4, 9), (5, 8), (6, 7)]
    assert sorted((r.l0, r.l1, r.r0, r.r1) for r in S.stems(found).collect()) == [(0, 1, 10, 11), (4, 6, 7, 9)]


def test_consensus_structures(spark):
    both = cells(spark, "eeann", "eabnn", "eea-n")
    found = N.row_pairs(both, "e", "n")
    assert pairs(N.conservative_structure(found.where("row_no = 0"), cells(spark, "eeann"))) == [(0, 4), (1, 3)]
    assert pairs(N.conservative_structure(found, both)) == []
    assert sorted(r.col for r in N.conflict_columns(found).collect()) == [0, 1, 3, 4]
    alike = cells(spark, "eaan", "eacn")
    assert pairs(N.conservative_structure(N.row_pairs(alike, "e", "n"), alike)) == [(0, 3)]


def test_sanitised_pairs_have_gaps_on_both_sides_or_none(spark):
    torn, fine = cells(spark, "ean", "-an"), cells(spark, "ean", "-a-")
    assert pairs(N.sanitise_structure(N.row_pairs(torn, "e", "n"), torn)) == []
    assert pairs(N.sanitise_structure(N.row_pairs(fine, "e", "n"), fine)) == [(0, 2)]


def test_translation_stops(spark):
    seqs = spark.createDataFrame([("p", "atgtaaggg"), ("q", "atgtaa"), ("r", "at"), ("s", "")], "seq_id string, seq string")
    got = {r.seq_id: (r.protein, r.early_stops) for r in N.translate_sequences(seqs).collect()}
    assert got == {"p": ("M", 1), "q": ("M", 0), "r": ("", 0), "s": ("", 0)}
