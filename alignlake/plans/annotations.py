"""Queries over structures, tags, parameters, translation and tree paths, each beside its SQL.

A row's structure reads its ``e`` as opening and its ``n`` as closing brackets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from alignlake.operators import annotate as N
from alignlake.operators import lifts as L
from alignlake.operators import sequences as S
from alignlake.operators import tables as O
from alignlake.operators import trees as T
from alignlake.plans import inputs as I
from alignlake.plans.sequences import _tree
from alignlake.plans.windows import _LCA, _pairs

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _reread(marks: str, by: str, name: str) -> str:
    """SQL from bracket marks ``(by..., col, ch)`` to pairs ``(by..., lcol, rcol)``."""
    return f"""{name}_1 AS (SELECT *, sum(CASE WHEN ch = '<' THEN 1 ELSE -1 END) OVER (PARTITION BY {by} ORDER BY col) + CASE WHEN ch = '<' THEN 0 ELSE 1 END AS depth FROM {marks}),
{name}_2 AS (SELECT *, lead(col) OVER (PARTITION BY {by}, depth ORDER BY col) AS nxt, lead(ch) OVER (PARTITION BY {by}, depth ORDER BY col) AS nxt_ch FROM {name}_1),
{name} AS (SELECT {by}, col AS lcol, nxt AS rcol FROM {name}_2 WHERE ch = '<' AND nxt_ch = '>')"""


_BP = f"""WITH {I.CELLS}, marks AS (SELECT aln_id, row_no, col, CASE WHEN ch = 'e' THEN '<' ELSE '>' END AS ch FROM cells WHERE ch IN ('e', 'n')),
{_reread("marks", "aln_id, row_no", "bp")}, nr AS (SELECT aln_id, count(DISTINCT row_no) AS n_rows FROM cells GROUP BY aln_id),
found AS (SELECT DISTINCT aln_id, lcol, rcol FROM bp), ends AS (SELECT *, unnest([lcol, rcol]) AS col FROM found),
full_ AS (SELECT aln_id, row_no, col FROM cells WHERE NOT is_gap)"""
_CONFLICT = "bad AS (SELECT aln_id, col, count(*) AS ways FROM ends GROUP BY aln_id, col HAVING count(*) > 1)"
_LIBERAL = f"""{_CONFLICT}, clean AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.aln_id = f.aln_id AND b.col = f.lcol) AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.aln_id = f.aln_id AND b.col = f.rcol)),
lm AS (SELECT aln_id, lcol AS col, '<' AS ch FROM clean UNION ALL SELECT aln_id, rcol, '>' FROM clean), {_reread("lm", "aln_id", "liberal")}"""


def _bp(spark, sf_dir):
    return N.row_pairs(I.cells(spark, sf_dir), "e", "n")


@query(f"{_BP}, s AS (SELECT aln_id, lcol, rcol, max((row_no = 0)::INT) AS a, max((row_no = 1)::INT) AS b FROM bp WHERE row_no IN (0, 1) GROUP BY ALL) SELECT aln_id, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * b)::BIGINT AS shared FROM s GROUP BY aln_id")
def a18_compare_structures(spark, sf_dir):
    return N.compare_structures(_bp(spark, sf_dir), 0, 1)


_DENSE = f"""WITH {I.CELLS}, first_ AS (SELECT * FROM cells WHERE row_no < 2), marks AS (SELECT aln_id, row_no, col, CASE WHEN ch < 'n' THEN '<' ELSE '>' END AS ch FROM first_ WHERE NOT is_gap),
{_reread("marks", "aln_id, row_no", "bp")}, nr AS (SELECT aln_id, count(DISTINCT row_no) AS n_rows FROM first_ GROUP BY aln_id)"""


def _dense(spark, sf_dir):
    """The first two rows of each alignment, every residue a bracket: a-m open, n-z close."""
    cells = I.cells(spark, sf_dir).where("row_no < 2")
    return cells.withColumn("ch", F.when(F.col("is_gap"), F.col("ch")).when(F.col("ch") < "n", "<").otherwise(">"))


@query(f"{_DENSE} SELECT aln_id, lcol, rcol FROM bp JOIN nr USING (aln_id) GROUP BY aln_id, lcol, rcol, n_rows HAVING count(*) = n_rows")
def a19_conservative_structure(spark, sf_dir):
    cells = _dense(spark, sf_dir)
    return N.conservative_structure(N.row_pairs(cells, "<", ">"), cells)


@query(f"{_BP}, {_CONFLICT} SELECT * FROM bad")
def a19_conflict_columns(spark, sf_dir):
    return N.conflict_columns(_bp(spark, sf_dir))


@query(f"{_BP}, {_LIBERAL} SELECT * FROM liberal")
def a19_liberal_structure(spark, sf_dir):
    return N.liberal_structure(_bp(spark, sf_dir))


@query(f"""{_BP}, h AS (SELECT aln_id, lcol, rcol FROM bp JOIN nr USING (aln_id) GROUP BY aln_id, lcol, rcol, n_rows HAVING 2 * count(*) > n_rows),
torn AS (SELECT DISTINCT aln_id, lcol, rcol FROM (SELECT aln_id, lcol, rcol, row_no, count(*) AS n FROM (SELECT *, unnest([lcol, rcol]) AS col FROM h) JOIN full_ USING (aln_id, col) GROUP BY ALL) WHERE n = 1)
SELECT * FROM h ANTI JOIN torn USING (aln_id, lcol, rcol)""")
def a20_majority_structure(spark, sf_dir):
    return N.majority_structure(_bp(spark, sf_dir), I.cells(spark, sf_dir))


@query(f"{_BP}, {_LIBERAL} SELECT aln_id, row_no, lcol, rcol FROM liberal JOIN rows_ USING (aln_id) WHERE substr(gapped, lcol + 1, 1) BETWEEN 'a' AND 'z' AND substr(gapped, rcol + 1, 1) BETWEEN 'a' AND 'z'")
def a21_propagate_structure(spark, sf_dir):
    return N.propagate_structure(N.liberal_structure(_bp(spark, sf_dir)), I.cells(spark, sf_dir))


@query(f"""{_BP}, paired AS (SELECT DISTINCT aln_id, row_no, unnest([lcol, rcol]) AS col, 1 AS paired FROM bp), fp AS (SELECT * FROM full_ LEFT JOIN paired USING (aln_id, row_no, col)),
b AS (SELECT DISTINCT aln_id, lcol, rcol FROM (SELECT aln_id, lcol, rcol, row_no, count(paired) AS n FROM ends JOIN fp USING (aln_id, col) GROUP BY ALL) WHERE n < 2) SELECT * FROM bp ANTI JOIN b USING (aln_id, lcol, rcol)""")
def a22_sanitise_structure(spark, sf_dir):
    return N.sanitise_structure(_bp(spark, sf_dir), I.cells(spark, sf_dir))


@query(f"""{_BP}, {_LIBERAL}, g AS (SELECT aln_id, col FROM cells GROUP BY aln_id, col HAVING avg(is_gap::INT) > 0.5), l2 AS (SELECT aln_id, lcol AS col, rcol AS "to" FROM liberal UNION ALL SELECT aln_id, rcol, lcol FROM liberal)
SELECT * FROM g UNION SELECT aln_id, "to" FROM l2 SEMI JOIN g USING (aln_id, col)""")
def p12_drop_with_partners(spark, sf_dir):
    gappy = I.cells(spark, sf_dir).groupBy("aln_id", "col").agg(F.avg(F.col("is_gap").cast("int")).alias("share")).where("share > 0.5").drop("share")
    return N.with_partners(gappy, N.liberal_structure(_bp(spark, sf_dir)))


_COLS = f"{_BP}, {_LIBERAL}, lp AS (SELECT DISTINCT aln_id, unnest([lcol, rcol]) AS col, true AS paired FROM liberal), pc AS (SELECT aln_id, col, coalesce(paired, false) AS paired FROM (SELECT DISTINCT aln_id, col FROM full_) LEFT JOIN lp USING (aln_id, col))"


def _cols(spark, sf_dir):
    return N.paired_columns(N.liberal_structure(_bp(spark, sf_dir)), I.cells(spark, sf_dir))


@query(f"{_COLS} SELECT * FROM pc")
def p19_extract_structure(spark, sf_dir):
    return _cols(spark, sf_dir)


@query(f"{_COLS} SELECT aln_id, col, ((row_number() OVER (PARTITION BY aln_id ORDER BY col) - 1) // 10)::INTEGER AS slice FROM pc WHERE NOT paired")
def w15_mini_slices(spark, sf_dir):
    return N.mini_slices(_cols(spark, sf_dir), 10)


@query(f"""{_DENSE}, f AS (SELECT *, CASE WHEN lag(lcol) OVER o = lcol - 1 AND lag(rcol) OVER o = rcol + 1 THEN 0 ELSE 1 END AS new FROM bp WINDOW o AS (PARTITION BY aln_id, row_no ORDER BY lcol)),
r AS (SELECT *, sum(new) OVER (PARTITION BY aln_id, row_no ORDER BY lcol) AS stem FROM f)
SELECT aln_id || '/' || row_no AS id, min(lcol) AS l0, max(lcol) AS l1, min(rcol) AS r0, max(rcol) AS r1, count(*) AS n FROM r GROUP BY aln_id, row_no, stem HAVING count(*) > 1""")
def w7_stems(spark, sf_dir):
    pairs = N.row_pairs(_dense(spark, sf_dir), "<", ">")
    return S.stems(pairs.select(F.concat_ws("/", "aln_id", "row_no").alias("id"), "lcol", "rcol"))


@query(f"""{_DENSE}, f AS (SELECT *, CASE WHEN lag(lcol) OVER o = lcol - 1 AND lag(rcol) OVER o = rcol + 1 THEN 0 ELSE 1 END AS new FROM bp WINDOW o AS (PARTITION BY aln_id, row_no ORDER BY lcol)),
r AS (SELECT *, sum(new) OVER (PARTITION BY aln_id, row_no ORDER BY lcol) AS stem FROM f), s AS (SELECT aln_id, row_no, min(lcol) AS l0 FROM r GROUP BY aln_id, row_no, stem HAVING count(*) > 1),
n AS (SELECT *, row_number() OVER (PARTITION BY aln_id, row_no ORDER BY l0) AS slice FROM s), m AS (SELECT r.*, min(lcol) OVER (PARTITION BY aln_id, row_no, stem) AS l0 FROM r)
SELECT m.aln_id || '/' || m.row_no AS id, slice::INTEGER AS slice, unnest([lcol, rcol]) AS col FROM m JOIN n ON n.aln_id = m.aln_id AND n.row_no = m.row_no AND n.l0 = m.l0""")
def w15_stem_slices(spark, sf_dir):
    pairs = N.row_pairs(_dense(spark, sf_dir), "<", ">")
    return N.stem_slices(S.stems(pairs.select(F.concat_ws("/", "aln_id", "row_no").alias("id"), "lcol", "rcol")))


@query(f"""{_DENSE}, d AS (SELECT *, sum(CASE WHEN ch = '<' THEN 1 ELSE -1 END) OVER (PARTITION BY aln_id, row_no ORDER BY col) AS after FROM marks)
SELECT aln_id || '/' || row_no AS id, min(after)::BIGINT AS lowest, arg_max(after, col)::BIGINT AS final FROM d GROUP BY aln_id, row_no HAVING min(after) < 0 OR arg_max(after, col) <> 0""")
def v5_check_brackets(spark, sf_dir):
    cells = _dense(spark, sf_dir).where("not is_gap")
    return S.check_brackets(cells.select(F.concat_ws("/", "aln_id", "row_no").alias("id"), "col", "ch"))


@query(f"WITH {I.ROWS} SELECT * FROM rows_ WHERE substr(md5(aln_id || 'x'), 1, 8) < '40000000'")
def p18_sample_alignments(spark, sf_dir):
    return N.sample_alignments(I.rows(spark, sf_dir), 0.25, "x")


@query("SELECT conv_id::VARCHAR AS aln_id, role AS tag, arg_min(text, turn) AS first, string_agg(text, chr(10) ORDER BY turn) AS joined FROM conversations GROUP BY conv_id, role")
def p22_join_tags(spark, sf_dir):
    t = I.table(spark, sf_dir, "conversations")
    return N.join_tags(t.select(F.col("conv_id").cast("string").alias("aln_id"), F.col("turn").alias("line_no"), F.col("role").alias("tag"), F.col("text").alias("value")))


@query("SELECT o_orderpriority AS param, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS O, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def j15_merge_params(spark, sf_dir):
    t = I.table(spark, sf_dir, "orders")
    return N.merge_params(t.select(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("param"), F.col("o_totalprice").alias("value")), ["F", "O", "P"])


@query("""SELECT l_orderkey AS aln_id, l_returnflag AS n1, l_linestatus AS n2, l_linenumber::BIGINT AS pos1, l_partkey::BIGINT AS pos2 FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus AND l_returnflag = 'N'
UNION ALL SELECT o_orderkey, 'N', o_orderstatus, 0, o_custkey FROM orders""")
def j17_replace_pair(spark, sf_dir):
    item = I.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("aln_id"), F.col("l_returnflag").alias("n1"), F.col("l_linestatus").alias("n2"), F.col("l_linenumber").cast("long").alias("pos1"), F.col("l_partkey").cast("long").alias("pos2"))
    new = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("aln_id"), F.lit("N").alias("n1"), F.col("o_orderstatus").alias("n2"), F.lit(0).cast("long").alias("pos1"), F.col("o_custkey").cast("long").alias("pos2"))
    return N.replace_pair(item, new)


#: Names, weights, core and degenerate symbols.
_ALPHABETS = [("dna", 1.0, "acgtn", "rymkswbdhv"), ("rna", 1.0, "acgun", "rymkswbdhv"), ("protein", 0.99, "acdefghiklmnpqrstvwy", "bzx"), ("text", 0.6, "abcdefghijklmnopqrstuvwxyz", "")]
_VALUES = ", ".join(f"({i}, '{n}', {w}, '{c}', {a})" for i, (n, w, core, half) in enumerate(_ALPHABETS) for part, a in ((core, 1.0), (half, 0.5)) for c in part)


@query(f"""WITH {I.SEQUENCES}, c AS (SELECT lang AS grp, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(seq, '')) AS ch FROM sequences) WHERE ch <> '' GROUP BY ALL),
k AS (SELECT * FROM (VALUES {_VALUES}) v(place, alphabet, weight, ch, affinity)),
s AS (SELECT grp, place, alphabet, round(max(weight)::DOUBLE * sum(n * affinity)::DOUBLE, 6) AS score FROM c JOIN k USING (ch) GROUP BY ALL)
SELECT grp, alphabet, score FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, place) = 1""")
def a4_detect_alphabet(spark, sf_dir):
    each = I.sequences(spark, sf_dir).select(F.col("lang").alias("grp"), F.explode(F.split("seq", "")).alias("ch")).where("ch != ''")
    return N.detect_alphabet(each.groupBy("grp", "ch").agg(F.count("*").alias("n")), _ALPHABETS)


@query("""WITH n AS (SELECT l_linestatus AS s, l_linenumber AS pos, l_suppkey % 3 AS sym, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT *, n / sum(n) OVER (PARTITION BY s, pos) AS w FROM n)
SELECT round(sum(ln(dot)), 8) AS log_dot FROM (SELECT a.pos, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.pos = b.pos AND a.sym = b.sym AND a.s = 'O' AND b.s = 'F' GROUP BY a.pos)""")
def a34_profile_dot(spark, sf_dir):
    def profile(status):
        t = I.table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status).groupBy(F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 3).alias("sym")).agg(F.count("*").alias("n"))
        return t.join(t.groupBy("pos").agg(F.sum("n").alias("total")), "pos").select("pos", "sym", (F.col("n") / F.col("total")).alias("w"))

    return N.profile_dot(profile("O"), profile("F"))


@query("""WITH g AS (SELECT user_id AS run, event_id AS "at", value, round((value - lag(value) OVER o) / abs(nullif(lag(value) OVER o, 0)), 9) AS gain FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT *, (sum(CASE WHEN gain < 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY "at"))::BIGINT AS low FROM g) SELECT *, low > 3 AS stop FROM l""")
def w13_progress(spark, sf_dir):
    return N.progress(I.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), "value"), 0.001, 3)


@query(f"WITH {I.CELLS} SELECT aln_id, col, sum(pos)::BIGINT AS total, (row_number() OVER (PARTITION BY aln_id ORDER BY sum(pos), col))::INTEGER AS place FROM cells WHERE NOT is_gap GROUP BY aln_id, col")
def o3_rank_columns(spark, sf_dir):
    return O.rank_columns(I.cells(spark, sf_dir))


@query("SELECT DISTINCT p_name AS param, reverse(p_name) AS key FROM part ORDER BY key")
def o4_sort_params(spark, sf_dir):
    return O.sort_params(I.table(spark, sf_dir, "part").select(F.col("p_name").alias("param")))


@query("SELECT o_custkey AS query, o_orderkey AS ref, o_totalprice AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def o5_best_match(spark, sf_dir):
    return N.best_match(I.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("ref"), F.col("o_totalprice").alias("score")))


_LETTERS, _FOUR = "abcdefghijklmnopqrstuvwxyz", "01230123012301230123012301"


@query(f"""WITH {I.SEQUENCES}, t AS (SELECT seq_id, array_to_string([substr('{N.STANDARD_CODE}', 16 * substr(c, 1, 1)::INT + 4 * substr(c, 2, 1)::INT + substr(c, 3, 1)::INT + 1, 1) FOR c IN regexp_extract_all(translate(seq, '{_LETTERS}', '{_FOUR}'), '[0-3][0-3][0-3]')], '') AS p FROM sequences)
SELECT seq_id, string_split(p, '*')[1] AS protein, length(regexp_replace(substr(p, 1, greatest(length(p) - 1, 0)), '[^*]', '', 'g')) AS early_stops FROM t WHERE p IS NOT NULL""")
def f2_translate(spark, sf_dir):
    return N.translate_sequences(I.sequences(spark, sf_dir).where("seq is not null"), _LETTERS, _FOUR)


@query("SELECT user_id, event_id, 'kind=seen;user=' || user_id AS attrs FROM events")
def f6_set_attr(spark, sf_dir):
    t = I.table(spark, sf_dir, "events")
    return N.set_attr(t.select("user_id", "event_id", F.concat(F.lit("user="), "user_id", F.lit(";kind="), "event_type").alias("attrs")), "kind", "seen")


@query(f"""{_LCA}, a AS (SELECT x, y, 1 AS side, ancestor, hops FROM (SELECT DISTINCT x, y FROM q WHERE y IN (SELECT node FROM tree)) JOIN l ON l.node = x UNION ALL SELECT x, y, 2, ancestor, hops FROM (SELECT DISTINCT x, y FROM q WHERE y IN (SELECT node FROM tree)) JOIN l ON l.node = y),
b AS (SELECT x, y, ancestor, count(DISTINCT side) AS sides, min(hops) FILTER (WHERE side = 1) AS hops FROM a GROUP BY ALL), c AS (SELECT *, min(hops) FILTER (WHERE sides = 2) OVER (PARTITION BY x, y) AS low FROM b)
SELECT x, y, ancestor AS node FROM c WHERE sides = 1 OR hops = low""")
def t7_node_path(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    known = tree.select(F.col("node").alias("y"))
    return N.node_path(tree, _pairs(spark, sf_dir).distinct().join(known, "y", "left_semi"))


@query(f"{_LCA}, near AS (SELECT DISTINCT x AS node FROM m WHERE place = 1 AND (path_len < 6 OR x = y)), p AS (SELECT l_suppkey AS read, 'o' || l_orderkey AS node FROM lineitem) SELECT node, read FROM p SEMI JOIN near USING (node)")
def j13_limit_placements(spark, sf_dir):
    near = L.common_ancestor(_tree(spark, sf_dir), _pairs(spark, sf_dir))
    return N.limit_placements(I.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("read"), F.concat(F.lit("o"), "l_orderkey").alias("node")), near, 6)
