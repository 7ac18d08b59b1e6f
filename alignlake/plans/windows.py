"""Queries over column windows, runs, rates and trees, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from alignlake.operators import lifts as L
from alignlake.operators import sequences as S
from alignlake.operators import tables as O
from alignlake.operators import trees as T
from alignlake.operators import windows as X
from alignlake.plans import inputs as I
from alignlake.plans.sequences import _DIST, _SEQ, _TREE, _UP, _items, _tree

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query(f"""WITH {I.CELLS}, n AS (SELECT aln_id, max(col) + 1 AS n FROM cells GROUP BY aln_id),
w AS (SELECT aln_id, n, unnest(range(0, ceil(greatest(n - 20, 0) / 10)::BIGINT + 1))::INTEGER AS "window" FROM n)
SELECT aln_id, "window", "window" * 10 + 1 AS start, least("window" * 10 + 20, n) AS "end" FROM w""")
def w1_sliding_windows(spark, sf_dir):
    return X.sliding_windows(I.cells(spark, sf_dir), 20, 10)


@query(f"""WITH {I.CELLS}, k AS (SELECT a.aln_id, a.col, CASE WHEN a.is_gap THEN 'insert' WHEN b.is_gap THEN 'delete' ELSE 'match' END AS kind
 FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.col = b.col AND a.row_no = 0 AND b.row_no = 1 WHERE NOT (a.is_gap AND b.is_gap)),
f AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY aln_id ORDER BY col) = kind THEN 0 ELSE 1 END AS new FROM k),
r AS (SELECT *, (sum(new) OVER (PARTITION BY aln_id ORDER BY col))::BIGINT AS run FROM f)
SELECT aln_id, run, min(kind) AS kind, min(col) AS start, count(*) AS n FROM r GROUP BY aln_id, run""")
def w5_runs(spark, sf_dir):
    return X.pair_runs(I.cells(spark, sf_dir))


@query(f"""{_SEQ}, c AS (SELECT seq || substr(seq, 1, 2) AS seq FROM sequences WHERE length(seq) >= 3),
w AS (SELECT substr(seq, i::BIGINT, 3) AS word FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM c)) SELECT word, count(*) AS n FROM w GROUP BY word""")
def w11_context_words(spark, sf_dir):
    return S.kmer_count(X.circular(I.sequences(spark, sf_dir), 3), 3)


@query("SELECT round(sum(l_linenumber)::DOUBLE / sum((l_suppkey % 7 + 1) * l_quantity), 9) AS rate FROM lineitem")
def a26_quick_indel_rate(spark, sf_dir):
    t = I.table(spark, sf_dir, "lineitem")
    return X.quick_indel_rate(t.select((F.col("l_suppkey") % 7 + 1).alias("distance"), F.col("l_quantity").alias("before"), (F.col("l_quantity") - F.col("l_linenumber")).alias("after")))


@query("""SELECT user_id AS pos, round(sum(value * CASE event_type WHEN 'view' THEN 0.25 ELSE 2 END), 6) AS value FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id""")
def a28_weighted_track(spark, sf_dir):
    t = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("pos"), F.col("event_type").alias("state"), F.col("value").alias("p"))
    return X.weighted_track(t, {"view": 0.25, "error": 2.0})


@query(f"""{_DIST}, b AS (SELECT grp, i, d FROM p UNION ALL SELECT grp, j, d FROM p), s AS (SELECT grp, i, round(sum(d), 4) AS total, count(*) AS n FROM b GROUP BY grp, i),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY total, i) AS place FROM s) SELECT grp, i, round(total / (n + 1), 6) AS mean FROM o WHERE place = 1""")
def a29_trace_centroid(spark, sf_dir):
    return X.value_centroid(_items(spark, sf_dir).withColumnRenamed("c_custkey", "i"))


@query("""WITH s AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
r AS (SELECT src, dst, count(*) AS n FROM s WHERE dst IS NOT NULL GROUP BY src, dst), q AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS rate FROM r),
i AS (SELECT event_type AS src, count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY event_type)
SELECT round(sum(p * rate), 9) AS expected FROM q JOIN i USING (src) WHERE src <> dst""")
def a39_expected_rate(spark, sf_dir):
    t = I.table(spark, sf_dir, "events")
    rates = X.transition_rates(t.select(F.col("user_id").alias("chain"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("state")))
    n = t.groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"))
    init = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("state", (F.col("n") / F.col("total")).alias("p"))  # one row by construction
    return X.expected_rate(init, rates)


@query("""SELECT l_orderkey AS key, l_linenumber AS id, min(o_orderkey) AS parent FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey % 50 <= l_partkey % 50
AND l_partkey % 50 + l_linenumber <= o_custkey % 50 + 30 GROUP BY ALL""")
def j7_link_parents(spark, sf_dir):
    c, p = I.table(spark, sf_dir, "lineitem"), I.table(spark, sf_dir, "orders")
    start = F.col("l_partkey") % 50
    children = c.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("id"), start.alias("start"), (start + F.col("l_linenumber")).alias("end"))
    return X.link_parents(children, p.select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("id"), F.expr("o_custkey % 50 as start"), F.expr("o_custkey % 50 + 30 as end")))


@query(f"WITH {I.ROWS_B} SELECT 'a-' || aln_id AS aln_id, row_no, name, gapped FROM rows_ UNION ALL SELECT 'b-' || aln_id, row_no, name, gapped FROM rows_b")
def u1_append(spark, sf_dir):
    return X.append(I.rows(spark, sf_dir), I.rows_b(spark, sf_dir))


@query(f"WITH {I.ROWS} SELECT aln_id, row_no, translate(gapped, 'hgiebts', 'hhhee..') AS states FROM rows_")
def f7_map_states(spark, sf_dir):
    return O.map_states(I.rows(spark, sf_dir).select("aln_id", "row_no", F.col("gapped").alias("states")), "states", "hgiebts", "hhhee..")


_LCA = f"""{_UP}, l AS (SELECT node, ancestor, hops, distance FROM up UNION ALL SELECT node, node, 0, 0 FROM tree),
q AS (SELECT 'o' || o_orderkey AS x, 'c' || (o_custkey + 1) AS y FROM orders),
m AS (SELECT x, y, a.ancestor AS lca, a.distance + b.distance AS path_len, row_number() OVER (PARTITION BY x, y ORDER BY a.hops) AS place
 FROM q JOIN l a ON a.node = x JOIN l b ON b.node = y AND b.ancestor = a.ancestor)"""


def _pairs(spark, sf_dir):
    t = I.table(spark, sf_dir, "orders")
    return t.select(F.concat(F.lit("o"), "o_orderkey").alias("x"), F.concat(F.lit("c"), F.col("o_custkey") + 1).alias("y"))


@query(f"{_LCA} SELECT x, y, lca FROM m WHERE place = 1")
def t4_common_ancestor(spark, sf_dir):
    return L.common_ancestor(_tree(spark, sf_dir), _pairs(spark, sf_dir)).select("x", "y", "lca")


@query(f"""{_UP}, l AS (SELECT node, ancestor, hops, distance FROM up UNION ALL SELECT node, node, 0, 0 FROM tree), g AS (SELECT DISTINCT o_custkey % 97 AS grp, 'o' || o_orderkey AS node FROM orders WHERE o_orderkey % 3 = 0 OR o_custkey % 97 < 9),
n AS (SELECT grp, count(*) AS n FROM g GROUP BY grp), c AS (SELECT grp, ancestor, max(hops) AS hops FROM g JOIN l USING (node) GROUP BY grp, ancestor HAVING count(*) = (SELECT n FROM n WHERE n.grp = g.grp)),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY hops) AS k FROM c) SELECT g.grp, g.node, o.ancestor AS lca, l.distance FROM o JOIN g ON g.grp = o.grp JOIN l ON l.node = g.node AND l.ancestor = o.ancestor WHERE k = 1""")
def t4_common_ancestor_of_sets(spark, sf_dir):
    t = I.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0 or o_custkey % 97 < 9")
    return L.common_ancestors(_tree(spark, sf_dir), t.select((F.col("o_custkey") % 97).alias("grp"), F.concat(F.lit("o"), "o_orderkey").alias("node")))


@query(f"{_LCA} SELECT x, y, path_len FROM m WHERE place = 1")
def t6_path_length(spark, sf_dir):
    return L.common_ancestor(_tree(spark, sf_dir), _pairs(spark, sf_dir)).select("x", "y", "path_len")


@query(f"""{_UP}, p AS (SELECT ancestor AS node FROM up WHERE node = 'n3' UNION ALL SELECT 'n3')
SELECT node, parent, branch_len FROM tree WHERE node NOT IN (SELECT node FROM p) UNION ALL SELECT parent, node, branch_len FROM tree WHERE node IN (SELECT node FROM p) AND parent IS NOT NULL UNION ALL SELECT 'n3', NULL, NULL""")
def t8_reroot(spark, sf_dir):
    return T.reroot(_tree(spark, sf_dir), "n3")


@query(f"""WITH {_TREE}, r AS (SELECT DISTINCT 'c' || (l_suppkey * 3) AS name FROM lineitem)
SELECT name, 'row' AS side FROM r WHERE name NOT IN (SELECT node FROM tree) UNION ALL SELECT node, 'node' FROM tree WHERE node NOT IN (SELECT name FROM r)""")
def v4_unattached_rows(spark, sf_dir):
    rows = I.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") * 3).alias("name"))
    return T.unattached(rows, _tree(spark, sf_dir))


@query(f"WITH {_TREE} SELECT round(1 / (0.5 * 0.1 * 0.1 * sum(branch_len)), 12) AS sites FROM tree")
def a37_sites_needed(spark, sf_dir):
    return T.sites_needed(_tree(spark, sf_dir), 0.5, 0.1)
