"""Queries over sequences, brackets, tracks, trees and similarities, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from alignlake.operators import brackets as B
from alignlake.operators import lifts as L
from alignlake.operators import sequences as S
from alignlake.operators import tables as O
from alignlake.operators import windows as X
from alignlake.plans import inputs as I

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


_SEQ = f"WITH {I.SEQUENCES}"


@query(f"{_SEQ} SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS ch FROM sequences WHERE seq <> '') GROUP BY ch")
def a1_composition(spark, sf_dir):
    return S.composition(I.sequences(spark, sf_dir))


@query(f"""{_SEQ}, c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS ch FROM sequences WHERE seq <> '') GROUP BY ch),
a AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS ch) SELECT ch, round((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (), 9) AS p FROM a LEFT JOIN c USING (ch)""")
def a2_null_model(spark, sf_dir):
    return S.null_model(I.sequences(spark, sf_dir), "abcdefghijklmnopqrstuvwxyz")


@query(f"{_SEQ} SELECT sum(length(seq))::BIGINT AS residues, count(*) AS seqs, round(avg(length(seq)), 9) AS mean_length, round(sum(length(seq)) / (sum(length(seq)) + count(*)), 9) AS extend FROM sequences")
def a3_length_stats(spark, sf_dir):
    return S.length_stats(I.sequences(spark, sf_dir))


@query(f"{_SEQ} SELECT seq_id, round((length(seq) - length(translate(seq, 'acgt', ''))) / length(seq), 9) AS share FROM sequences WHERE seq <> ''")
def a5_alphabet_share(spark, sf_dir):
    return S.alphabet_share(I.sequences(spark, sf_dir), "acgt")


def _words_sql(k: int) -> str:
    return f"w{k} AS (SELECT substr(seq, i::BIGINT, {k}) AS word FROM (SELECT seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM sequences WHERE length(seq) >= {k}))"


@query(f"{_SEQ}, {_words_sql(4)} SELECT word, count(*) AS n FROM w4 GROUP BY word")
def a6_kmer_count(spark, sf_dir):
    return S.kmer_count(I.sequences(spark, sf_dir), 4)


@query(f"{_SEQ}, {_words_sql(4)} SELECT 'th' AS prefix, count(*)::BIGINT AS n FROM w4 WHERE word LIKE 'th%'")
def a7_prefix_count(spark, sf_dir):
    return S.prefix_count(S.kmer_count(I.sequences(spark, sf_dir), 4), "th")


@query(f"{_SEQ}, {', '.join(_words_sql(k) for k in (12, 13, 14))} " + " UNION ALL ".join(f"SELECT word, count(*) AS n FROM w{k} GROUP BY word HAVING count(*) >= 10" for k in (12, 13, 14)))
def a8_frequent_words(spark, sf_dir):
    return S.frequent_words(I.sequences(spark, sf_dir), 12, 14, 10)


@query()
def a8_frequent_words_all(spark, sf_dir):
    """All lengths of the reference's defaults; too many for SQL over whole tables."""
    return S.frequent_words(I.sequences(spark, sf_dir), 12, 100, 10)


@query(f"{_SEQ} SELECT seq_id, reverse(translate(seq, 'acgtu', 'tgcaa')) AS seq FROM sequences")
def f1_reverse_complement(spark, sf_dir):
    return I.sequences(spark, sf_dir).select("seq_id", S.reverse_complement("seq").alias("seq"))


def _marks(spark, sf_dir):
    t = I.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.posexplode(F.split("html", "")).alias("col", "ch"))
    return t.where("ch in ('<', '>')")


_MARKS = """m AS (SELECT id, i::INTEGER AS col, ch FROM (SELECT page_id AS id, unnest(string_split(html, '')) AS ch, unnest(range(0, length(html))) AS i FROM pages) WHERE ch IN ('<', '>')),
d0 AS (SELECT *, sum(CASE WHEN ch = '<' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY col) AS after FROM m)"""
_PAIRS = f"""{_MARKS}, d AS (SELECT *, after + CASE WHEN ch = '<' THEN 0 ELSE 1 END AS depth FROM d0),
n AS (SELECT *, lead(col) OVER (PARTITION BY id, depth ORDER BY col) AS nxt, lead(ch) OVER (PARTITION BY id, depth ORDER BY col) AS nxt_ch FROM d),
p AS (SELECT id, col AS lcol, nxt AS rcol FROM n WHERE ch = '<' AND nxt_ch = '>')"""


@query(f"WITH {_PAIRS} SELECT * FROM p")
def w6_bracket_pairs(spark, sf_dir):
    return S.bracket_pairs(_marks(spark, sf_dir))


_FAMILY = """f AS (SELECT doc_id::VARCHAR AS id, unnest(string_split(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'enaitsorlu', '<>()[]AaBb'), '')) AS ch, unnest(range(0, length(regexp_replace(lower(text), '[^a-z]', '', 'g')))) AS col FROM documents),
m AS (SELECT id, col, CASE WHEN ch IN ('<', '>') THEN '<>' WHEN ch IN ('(', ')') THEN '()' WHEN ch IN ('[', ']') THEN '[]' WHEN ch IN ('A', 'a') THEN 'Aa' ELSE 'Bb' END AS family, CASE WHEN ch IN ('<', '(', '[', 'A', 'B') THEN 1 ELSE -1 END AS step FROM f WHERE ch IN ('<', '>', '(', ')', '[', ']', 'A', 'a', 'B', 'b')),
d AS (SELECT *, sum(step) OVER (PARTITION BY id, family ORDER BY col) AS depth FROM m), l AS (SELECT *, CASE WHEN step = 1 THEN depth ELSE depth + 1 END AS level FROM d)"""


def _structures(spark, sf_dir):
    """Whole documents as structures of five families: the letters ``enaitsorlu`` are marks."""
    return I.sequences(spark, sf_dir).select(F.col("seq_id").alias("id"), F.translate("seq", "enaitsorlu", "<>()[]AaBb").alias("text"))


@query(f"WITH {_FAMILY}, n AS (SELECT id, family, col, step, lead(col) OVER w AS rcol, lead(step) OVER w AS after FROM l WINDOW w AS (PARTITION BY id, family, level ORDER BY col)) SELECT id, family, col AS lcol, rcol FROM n WHERE step = 1 AND after = -1")
def w6_bracket_families(spark, sf_dir):
    return B.match(_structures(spark, sf_dir), ("<>", "()", "[]", "Aa", "Bb"), 1000)


@query(f"WITH {_FAMILY}, e AS (SELECT id, family, least(min(depth), 0)::BIGINT AS lowest, arg_max(depth, col)::BIGINT AS final FROM d GROUP BY id, family) SELECT * FROM e WHERE lowest < 0 OR final <> 0")
def v5_bracket_faults(spark, sf_dir):
    return B.faults(_structures(spark, sf_dir), ("<>", "()", "[]", "Aa", "Bb"), 1000)


@query("""WITH t AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events),
h AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS island FROM t WHERE value >= 50)
SELECT seq_id, min(pos) + 1 AS start, max(pos) + 1 AS "end", round(sum(value), 6) AS score FROM h GROUP BY seq_id, island""")
def w8_track_to_features(spark, sf_dir):
    return S.track_to_features(_track(spark, sf_dir), 50)


def _track(spark, sf_dir):
    pos = F.expr("cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint)")
    return I.table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), pos.alias("pos"), "value")


@query("""WITH t AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events),
f AS (SELECT user_id AS seq_id, (event_id % 50) AS start, (event_id % 50) + 3 AS "end" FROM events WHERE event_type = 'error')
SELECT DISTINCT t.seq_id, t.pos FROM t JOIN f ON t.seq_id = f.seq_id AND t.pos BETWEEN f.start AND f."end" """)
def j8_apply_mask(spark, sf_dir):
    e = I.table(spark, sf_dir, "events").where("event_type = 'error'")
    f = e.select(F.col("user_id").alias("seq_id"), F.expr("event_id % 50").alias("start"), F.expr("event_id % 50 + 3").alias("end"))
    return S.mask_positions(f, _track(spark, sf_dir).select("seq_id", "pos"), 16)


def _tree(spark, sf_dir):
    t = lambda n: I.table(spark, sf_dir, n)
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("bigint").alias("branch_len"))
    region = t("region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root"), F.lit(1).cast("bigint"))
    nation = t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(2).cast("bigint"))
    customer = t("customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), (F.col("c_custkey") % 7).cast("bigint"))
    orders = t("orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"), (F.col("o_orderkey") % 5).cast("bigint"))
    return root.union(region).union(nation).union(customer).union(orders)


_TREE = """tree AS (SELECT 'root' AS node, NULL::VARCHAR AS parent, NULL::BIGINT AS branch_len UNION ALL SELECT 'r' || r_regionkey, 'root', 1 FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey % 7 FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey % 5 FROM orders)"""
_UP = f"""WITH RECURSIVE {_TREE}, up AS (SELECT node, parent AS ancestor, 1 AS hops, branch_len AS distance FROM tree WHERE parent IS NOT NULL
UNION ALL SELECT up.node, t.parent, up.hops + 1, up.distance + t.branch_len FROM up JOIN tree t ON up.ancestor = t.node WHERE t.parent IS NOT NULL)"""


@query(f"{_UP} SELECT node, ancestor, hops, distance FROM up")
def t1_ancestors(spark, sf_dir):
    return S.ancestors(_tree(spark, sf_dir))


@query(f"{_UP} SELECT ancestor AS node, count(*) AS n_below, max(distance) AS farthest FROM up GROUP BY ancestor")
def t2_descendants(spark, sf_dir):
    return L.descendants(_tree(spark, sf_dir))


@query(f"WITH {_TREE} SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)")
def t3_leaves(spark, sf_dir):
    return S.leaves(_tree(spark, sf_dir)).select("node")


@query(f"{_UP} SELECT node, max(hops)::INTEGER AS depth, max(distance) AS depth_len FROM up GROUP BY node")
def t5_depth(spark, sf_dir):
    return L.depths(_tree(spark, sf_dir)).where("depth > 0").select("node", "depth", "depth_len")


@query(f"WITH {_TREE} SELECT parent AS node, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) <> 2")
def t11_binary_check(spark, sf_dir):
    return S.child_counts(_tree(spark, sf_dir))


@query(f"WITH {_TREE} SELECT sum(branch_len)::BIGINT AS total, min(branch_len) AS shortest, max(branch_len) AS longest FROM tree")
def t12_branch_lengths(spark, sf_dir):
    return S.branch_lengths(_tree(spark, sf_dir))


def _items(spark, sf_dir):
    return I.table(spark, sf_dir, "customer").select(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("grp"), "c_custkey", F.col("c_acctbal").alias("v"))


_DIST = """WITH c AS (SELECT c_nationkey || '-' || c_mktsegment AS grp, c_custkey AS k, c_acctbal AS v FROM customer),
p AS (SELECT a.grp, a.k AS i, b.k AS j, round(abs(a.v - b.v), 4) AS d FROM c a JOIN c b ON a.grp = b.grp AND a.k < b.k)"""


def _gap(x, y):
    return F.round(F.abs(F.col(x) - F.col(y)), 4)


@query(f"{_DIST} SELECT * FROM p")
def j5_all_pairs(spark, sf_dir):
    return S.all_pairs(_items(spark, sf_dir), "c_custkey", _gap)


@query(f"""{_DIST}, b AS (SELECT * FROM p UNION ALL SELECT grp, j, i, d FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY grp, i ORDER BY d, j)::INTEGER AS place FROM b)
SELECT grp, i, j, d, place FROM o WHERE place <= 3""")
def o1_nearest(spark, sf_dir):
    return X.nearest_values(_items(spark, sf_dir).withColumnRenamed("c_custkey", "i"), 3)


@query(f"{_DIST} SELECT j - i AS lag, round(avg(d), 6) AS mean, count(*) AS n FROM p GROUP BY j - i")
def w10_lag_similarity(spark, sf_dir):
    return S.lag_similarity(S.all_pairs(_items(spark, sf_dir), "c_custkey", _gap).withColumnRenamed("d", "s"))


@query("""WITH x AS (SELECT CASE WHEN quality = 1 THEN 'H' ELSE 'L' END AS actual, CASE WHEN n_chars > 500 THEN 'H' ELSE 'L' END AS pred FROM labels JOIN documents USING (doc_id)),
c AS (SELECT unnest(['H', 'L']) AS category), n AS (SELECT category, count(*) FILTER (WHERE actual = category AND pred = category) AS tp, count(*) FILTER (WHERE actual = category AND pred <> category) AS fn,
count(*) FILTER (WHERE actual <> category AND pred <> category) AS tn, count(*) FILTER (WHERE actual <> category AND pred = category) AS fp FROM x, c GROUP BY category)
SELECT *, round(tp / nullif(tp + fn, 0), 9) AS sn, round(tn / nullif(tn + fp, 0), 9) AS sp FROM n""")
def a14_roc_by_category(spark, sf_dir):
    x = I.table(spark, sf_dir, "labels").join(I.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    pick = lambda c: F.when(c, "H").otherwise("L")
    return S.roc_by_category(x.select(pick(F.col("quality") == 1).alias("actual"), pick(F.col("n_chars") > 500).alias("pred")), ["H", "L"])


@query("""WITH p AS (SELECT l_suppkey AS read, l_partkey AS node, sum(l_quantity) AS score FROM lineitem GROUP BY ALL)
SELECT read, node, round(score / sum(score) OVER (PARTITION BY read), 12) AS share FROM p""")
def a27_normalise_placements(spark, sf_dir):
    t = I.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("read"), F.col("l_partkey").alias("node")).agg(F.sum("l_quantity").alias("score"))
    return S.normalise_placements(t, 0)


@query("""SELECT l_linenumber AS begin, l_linenumber + l_suppkey % 5 AS "end", count(*)::BIGINT AS n, sum(l_quantity)::BIGINT AS m FROM lineitem GROUP BY ALL""")
def a40_merge_interval_counts(spark, sf_dir):
    t = I.table(spark, sf_dir, "lineitem")
    x = t.select(F.col("l_linenumber").alias("begin"), (F.col("l_linenumber") + F.col("l_suppkey") % 5).alias("end"), F.lit(1).cast("bigint").alias("n"), F.col("l_quantity").cast("bigint").alias("m"))
    return S.merge_interval_counts(x)


@query("SELECT l_linenumber AS start, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def a41_start_coverage(spark, sf_dir):
    return O.start_coverage(I.table(spark, sf_dir, "lineitem"), "l_linenumber")


@query("SELECT event_type, sum(CASE WHEN user_id % 3 = 0 THEN value END) AS r0, sum(CASE WHEN user_id % 3 = 1 THEN value END) AS r1, sum(CASE WHEN user_id % 3 = 2 THEN value END) AS r2 FROM (SELECT event_type, user_id, round(value * 100)::BIGINT AS value FROM events) GROUP BY event_type".replace("sum(", "(sum(").replace(" END)", " END))::BIGINT"))
def a36_pivot_runs(spark, sf_dir):
    t = I.table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("r"), F.col("user_id") % 3).alias("run"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    return O.pivot_runs(t, "event_type", "run", ["r0", "r1", "r2"], "value")


@query("""WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS place FROM events WHERE value >= 20) SELECT * FROM o WHERE place <= 5""")
def o2_top_hits(spark, sf_dir):
    return O.top_hits(I.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id", 20, 5)


@query("SELECT event_id, event_type, value FROM events WHERE (value >= 30 AND event_type <> 'view') OR event_type = 'error'")
def p21_filter_log(spark, sf_dir):
    t = I.table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("value").alias("level"), F.array("event_type").alias("tags"))
    return O.filter_log(t, 30, ["view"], ["error"]).drop("level", "tags")
