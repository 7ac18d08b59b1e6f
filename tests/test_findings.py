"""Queries against their SQL on small tables of odd shape."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_entry import rows

from alignlake.operators import packed, plug
from alignlake.operators.alignment import to_cells
from alignlake.plans import registry


def same(spark, folder, name, **tables):
    """Whether query ``name`` gives what its SQL gives on ``tables`` of (schema, records); the rows."""
    con = duckdb.connect()
    for table, (schema, records) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(records, schema).coalesce(1).write.parquet(path)
        con.execute(f"create view {table} as select * from read_parquet('{path}/*.parquet')")
    got = registry.QUERIES[name](spark, str(folder))
    want = con.execute(registry.ORACLES[name])
    found = rows(got.columns, got.collect())
    return found == rows([c[0] for c in want.description], want.fetchall()) and found


def talks(*texts):
    """Conversations of the given turns."""
    return "conv_id long, turn long, role string, text string", [(c, t, "user" if t % 2 == 0 else "bot", x) for c, turns in enumerate(texts) for t, x in enumerate(turns)]


@pytest.mark.parametrize("width", [15, 21, 45, 69, 70, 90])
def test_reversed_slice_of_narrow_alignments(spark, tmp_path, width):
    """An alignment that ends inside the slice stands at its end once it is reversed."""
    texts = ["".join("acgt-"[(i * k) % 5] for i in range(1, width + 1 - k)) for k in (0, 1, 3)]
    found = same(spark, tmp_path, "p5_subalign_reverse", conversations=talks(texts))
    assert found is not False and len(found) == 3 * max(0, min(width - 20, 50))


def broadcasts(plan):
    """The text of each table that a plan broadcasts."""
    lines = plan.split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


#: Queries whose cells were broadcast where conversations were small enough on disk.
CELLS = [
    "j18_map_columns",
    "j3_gap_pairs",
    "j4_column_overlap",
    "w2_window_filter",
    "a33_pair_path_stats",
    "a33_pair_path_overlap",
    "a20_majority_structure",
    "a21_propagate_structure",
    "a25_indel_rates",
    "a25_indel_stats",
    "j2_pair_overlap",
    "v6_check_ancestry",
    "u3_pairs_except",
    "p19_strict_pairs",
    "a22_sanitise_structure",
    "j3_gap_overlap",
]


@pytest.mark.parametrize("name", CELLS)
def test_cells_are_never_broadcast(spark, name):
    """Cells look as small to the planner as the rows they come from."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and not [x for x in broadcasts(plan) if "Generate" in x]


def customers(n):
    return "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double", [(i, i % 2, "AB"[i // 2 % 2], float(i * i * 37 % 1099900 - 99900) / 100) for i in range(n)]


@pytest.mark.parametrize("name", ["a30_leader_cluster", "a30_bins"])
def test_clusters_make_no_table_of_pairs(spark, tmp_path, monkeypatch, name):
    """Only the lowest free items of a group are paired: 64 of 200."""
    links, write = [], plug.materialise
    monkeypatch.setattr(plug, "materialise", lambda df: (out := write(df), links.append(out.count() if "j" in out.columns else 0))[0])
    found = same(spark, tmp_path, name, customer=customers(800))
    assert found is not False and 0 < max(links) < 2500


def test_counts_of_symbols_are_handed_on_in_pieces(spark, monkeypatch):
    """Neither side gathers vectors beyond its bounds, and no list of Python numbers is made of them."""
    frame = spark.createDataFrame([(f"a{i}", r, f"r{r}", ("acgt-" * 40)[r : r + 100 + i]) for i in range(30) for r in range(3)], "aln_id string, row_no int, name string, gapped string").coalesce(1)
    want = {(r.aln_id, r.col, r.ch): r.n for r in to_cells(frame).where("not is_gap").groupBy("aln_id", "col", "ch").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(packed, "_HELD", 50)
    monkeypatch.setattr(packed, "_GIVEN", 50)
    got = packed.symbol_counts(packed.pack(frame)).collect()
    assert len(got) == len(want) and {(r.aln_id, r.col, r.ch): r.n for r in got} == want


@pytest.mark.parametrize("name, tables", [
    ("j8_mask_sequences", {"documents": ("doc_id long, text string, lang string, source string, n_chars long", [(i, "A bcd, efg " * (i % 6), "en", "s", 1) for i in range(90)] + [(90, None, "en", "s", 1), (41, "z" * 44, "en", "s", 1)])}),
    ("p29_mark_case", {"conversations": talks(["quick brown fox jumps", "aq q", ""], ["...", "abcdefghijklmnopqrstuvwxyz" * 3], ["hello"])}),
    ("a12_column_profile", {"conversations": talks(["abc", "", "abd efgh"], ["..."], ["x"] * 20)}),
])
def test_texts_stay_whole(spark, tmp_path, name, tables):
    """Results equal SQL, and where texts are only edited no letter of them is shuffled by itself."""
    if name == "j8_mask_sequences":
        tables = {"documents": (tables["documents"][0], [r for i, r in enumerate(tables["documents"][1]) if i < 91])}
    assert same(spark, tmp_path, name, **tables) is not False
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan if name == "p29_mark_case" else "posexplode(filter" not in plan
