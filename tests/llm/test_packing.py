"""Packing: very long texts, odd doc_ids, columns that stay."""

from collections import Counter

from alignlake.llm import packing


def test_one_long_text_leaves_padding_minimal(spark):
    lengths = [1] * 5 + [3] * 4 + [1_000_001]
    measured = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    got = {(r.n_tokens, r.padded) for r in packing.pack(measured).collect()}
    assert got == {(1, 1), (3, 3), (1_000_001, 1_000_001)}


def test_all_columns_stay_whatever_their_names(spark):
    rows = [(i % 3 or None, f"t{i} " * (i % 7), "b", "p", i, "n") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string, _part string, batch int, p string").repartition(5)
    got = packing.pack(packing.word_count(docs), buckets=3, budget=40)
    assert got.columns == [*docs.columns, "n_tokens", "_bucket", "padded", "_batch"]
    assert sorted(map(repr, got.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    rows = got.collect()
    sizes = Counter((r["_bucket"], r.padded, r["_batch"]) for r in rows)
    for b in {b for b, _, _ in sizes}:
        own = sorted((batch, n, p) for (c, p, batch), n in sizes.items() if c == b)
        assert [x for x, _, _ in own] == list(range(len(own))) and all(n == 40 // max(1, p) for _, n, p in own[:-1])


def test_one_doc_id_and_none_at_all_are_packed_by_all_tasks(spark):
    """Rows are numbered where they are: no exchange of rows, so no key can be hot."""
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "id % 5 as n_tokens").repartition(8)
    got = packing.pack(docs, buckets=2, budget=8)
    assert got.count() == 4000 and Counter(r.batch for r in got.where("bucket = 1").collect()).most_common(1)[0][1] == 2
    nulls = spark.createDataFrame([(1, None), (2, 3)], "doc_id long, n_tokens long")
    assert {(r.doc_id, r.n_tokens) for r in packing.pack(nulls).collect()} == {(1, None), (2, 3)}
    empty = packing.pack(docs.where("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "bucket", "padded", "batch"]
