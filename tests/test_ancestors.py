"""Ancestors in a tree deeper than 64 links."""

import pytest

from alignlake.operators import sequences as S


def test_chain_of_100_nodes(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, i) for i in range(100)]
    got = S.ancestors(spark.createDataFrame(rows, "node string, parent string, branch_len long")).collect()
    want = [(f"n{i}", f"n{j}", i - j, sum(range(j + 1, i + 1))) for i in range(100) for j in range(i)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        S.ancestors(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "node string, parent string, branch_len long"))
