"""Readers and writers of text formats: small files and round trips."""

from alignlake.sources import text


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\nACG\nT A\n>s2\nGG\n")
    got = text.read_fasta(spark, str(tmp_path / "a.fa"))
    want = [("s1", "first one", "ACGTA"), ("s2", "", "GG")]
    assert sorted(map(tuple, got.collect())) == want
    text.write_fasta(got, str(tmp_path / "out"), 2)
    assert sorted(map(tuple, text.read_fasta(spark, str(tmp_path / "out")).collect())) == want


def test_gff(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff\nc\tsrc\tgene\t1\t9\t.\t?\tx\tID=g%3B1;Parent=p,q\nbad line\n")
    got = text.read_gff(spark, str(tmp_path / "a.gff"))
    want = ("c", "src", "gene", 1, 9, 0.0, ".", None, {"ID": ["g;1"], "Parent": ["p", "q"]})
    assert tuple(got.first()) == want and got.count() == 1
    text.write_gff(got, str(tmp_path / "out"))
    assert tuple(text.read_gff(spark, str(tmp_path / "out")).first()) == want
