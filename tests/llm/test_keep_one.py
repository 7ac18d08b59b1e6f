"""One row of each group of near-duplicates, on tables with null and repeated ids."""

from alignlake.llm import simhash


def text(seed):
    return " ".join(f"w{seed}x{i}" for i in range(40))


def test_keep_one_judges_rows_not_ids(spark):
    rows = [(None, text(1)), (None, text(2)), (None, text(1)), (7, text(3)), (7, text(4)), (7, text(4)), (None, text(4)), (9, text(5)), (8, text(5))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, ((r.doc_id, r.text) for r in simhash.keep_one(frame).collect())))
    assert got == sorted(map(repr, [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(5))]))
