"""Queries over alignments (see ``inputs``), each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from alignlake.operators import alignment as A
from alignlake.operators import compare as C
from alignlake.operators import packed as P
from alignlake.operators import tables as O
from alignlake.plans import inputs as I

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def cells_query(sql: str):
    return query(f"WITH {I.CELLS}\n{sql}")


def kept_query(keep: str):
    return query(f"WITH {I.CELLS},\n{I.kept_sql(keep)}")


@cells_query("SELECT * FROM cells")
def p1_to_cells(spark, sf_dir):
    return I.cells(spark, sf_dir)


@query(f"WITH {I.ROWS} SELECT * FROM rows_ WHERE gapped <> ''")
def p2_to_rows(spark, sf_dir):
    return A.to_rows(I.cells(spark, sf_dir))


@query(f"WITH {I.ROWS} SELECT aln_id, row_no, name, replace(gapped, '-', '') AS seq FROM rows_")
def p3_ungap(spark, sf_dir):
    return A.ungap(I.rows(spark, sf_dir))


@cells_query("""SELECT aln_id, row_no, name, min(pos) AS first_pos, max(pos) AS last_pos, (min(col) FILTER (WHERE NOT is_gap) - 10)::INTEGER AS "offset"
FROM cells WHERE col BETWEEN 10 AND 39 GROUP BY ALL""")
def p4_columns_to_residues(spark, sf_dir):
    return A.columns_to_residues(I.cells(spark, sf_dir), 10, 39)


@cells_query(f""", moved AS (SELECT aln_id, row_no, name, (49 - (col - 20))::INTEGER AS col, translate(ch, 'acgtuACGTU', 'tgcaaTGCAA') AS ch, is_gap
FROM cells WHERE col BETWEEN 20 AND 69)
{I.NUMBERED}""")
def p5_subalign_reverse(spark, sf_dir):
    return P.cells(P.subalign(I.parts(spark, sf_dir), 20, 50, "-"), width=50)


@query(f"""WITH {I.ANNOTATED} SELECT aln_id, kind, row_no, name, tag, CASE kind WHEN 'row' THEN translate(reverse(substr(text, 21, 50)), 'acgtuACGTU', 'tgcaaTGCAA') ELSE reverse(substr(text, 21, 50)) END AS text FROM texts""")
def p5_subalign_annotated(spark, sf_dir):
    return P.unpack(P.subalign(I.annotated(spark, sf_dir), 20, 50, "-"))


@query(f"""WITH {I.ANNOTATED}, k AS (SELECT aln_id, list(i) AS cols FROM (SELECT aln_id, text, unnest(range(1, length(text) + 1)) AS i FROM texts WHERE row_no = 1) WHERE substr(text, i::BIGINT, 1) = 'e' GROUP BY aln_id)
SELECT aln_id, kind, row_no, name, tag, array_to_string([substr(text, i, 1) FOR i IN range(1, length(text) + 1) IF NOT coalesce(list_contains(cols, i), false)], '') AS text FROM texts LEFT JOIN k USING (aln_id)""")
def p6_drop_columns_annotated(spark, sf_dir):
    parts = I.annotated(spark, sf_dir)
    return P.unpack(P.drop(parts, P.columns_where(parts.where("row_no = 1"), "e")))


@query(f"""WITH {I.ANNOTATED}, g AS (SELECT aln_id, i, count(*) AS n, count(*) FILTER (WHERE substr(text, i::BIGINT, 1) = '-') AS gaps FROM (SELECT aln_id, text, unnest(range(1, length(text) + 1)) AS i FROM texts WHERE kind = 'row') GROUP BY ALL),
k AS (SELECT aln_id, list(i ORDER BY i) FILTER (WHERE gaps < 0.5 * n) AS cols FROM g GROUP BY aln_id)
SELECT aln_id, kind, row_no, name, tag, array_to_string([substr(text, i, 1) FOR i IN coalesce(cols, []) IF i <= length(text)], '') AS text FROM texts JOIN k USING (aln_id)""")
def p10_drop_gappy_annotated(spark, sf_dir):
    return P.unpack(P.drop_gappy(I.annotated(spark, sf_dir), 0.5))


@kept_query("keep AS (SELECT aln_id, col FROM cells GROUP BY ALL HAVING NOT bool_or(row_no = 1 AND ch = 'e'))")
def p6_drop_columns(spark, sf_dir):
    parts = I.parts(spark, sf_dir)
    return P.cells(P.drop(parts, P.columns_where(parts.where("row_no = 1"), "e")))


@kept_query("keep AS (SELECT aln_id, col FROM cells GROUP BY ALL HAVING NOT bool_and(is_gap))")
def p7_erase_empty_columns(spark, sf_dir):
    return P.cells(P.erase_empty(I.parts(spark, sf_dir)))


@kept_query("keep AS (SELECT aln_id, col FROM cells WHERE row_no = 0 AND NOT is_gap)")
def p8_slice_by_reference(spark, sf_dir):
    return P.cells(P.slice_by_reference(I.parts(spark, sf_dir), 0))


@query("""SELECT page_id, 'u' || page_id || '/' || length(url) || '-' || (length(url) + length(html)) AS name, 'u' || page_id AS base,
length(url)::BIGINT AS start, (length(url) + length(html))::BIGINT AS "end" FROM pages""")
def p9_parse_coords(spark, sf_dir):
    t = I.table(spark, sf_dir, "pages")
    name = F.concat(F.lit("u"), "page_id", F.lit("/"), F.length("url"), F.lit("-"), F.length("url") + F.length("html"))
    return A.parse_coords(t.select("page_id", name.alias("name")))


@kept_query("keep AS (SELECT aln_id, col FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE is_gap) < 0.5 * count(*))")
def p10_drop_gappy(spark, sf_dir):
    return P.cells(P.drop_gappy(I.parts(spark, sf_dir), 0.5))


@kept_query("keep AS (SELECT DISTINCT aln_id, col FROM cells ANTI JOIN (SELECT aln_id, col FROM cells WHERE row_no = 0 AND is_gap) x USING (aln_id, col))")
def p11_drop_annotated_gaps(spark, sf_dir):
    rows = I.rows(spark, sf_dir)
    note = rows.where("row_no = 0").select("aln_id", F.lit("RF").alias("tag"), F.col("gapped").alias("text"))
    return P.cells(P.drop_annotated_gaps(P.pack(rows, note)))


@cells_query("""SELECT a.aln_id, a.col, CASE WHEN x.col IS NOT NULL THEN '.' ELSE a.ch END AS ch FROM (SELECT * FROM cells WHERE row_no = 0) a
LEFT JOIN (SELECT DISTINCT aln_id, col FROM cells WHERE row_no = 1 AND is_gap) x ON a.aln_id = x.aln_id AND a.col = x.col""")
def p13_mask_annotation(spark, sf_dir):
    cells = I.cells(spark, sf_dir)
    return A.mask_annotation(cells.where("row_no = 0").select("aln_id", "col", "ch"), cells.where("row_no = 1 and is_gap"), ".")


@query(f"WITH {I.ROWS} SELECT * FROM rows_ SEMI JOIN (SELECT aln_id FROM rows_ GROUP BY ALL HAVING sum(length(gapped)) > 2000) USING (aln_id)")
def p14_filter_by_tag(spark, sf_dir):
    rows = I.rows(spark, sf_dir)
    tags = rows.groupBy("aln_id").agg(F.sum(F.length("gapped")).alias("value")).withColumn("tag", F.lit("SC"))
    return O.filter_by_tag(rows, tags.withColumn("value", F.col("value").cast("string")), "SC", 2000)


@query(f"WITH {I.ROWS} SELECT * FROM rows_ WHERE regexp_matches(gapped, '[xyz]')")
def p15_discard_wild(spark, sf_dir):
    return A.discard_wild(I.rows(spark, sf_dir), "xyz")


@kept_query("""m AS (SELECT aln_id, col FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE NOT is_gap) > 1),
e AS (SELECT aln_id, row_no, min(col) AS a, max(col) AS b FROM cells SEMI JOIN m USING (aln_id, col) WHERE NOT is_gap GROUP BY ALL),
keep AS (SELECT DISTINCT aln_id, unnest(range(a, b + 1)) AS col FROM e)""")
def p16_local_trim(spark, sf_dir):
    return P.cells(P.local_trim(I.parts(spark, sf_dir)))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0")
def p17_thin(spark, sf_dir):
    return O.thin(I.table(spark, sf_dir, "conversations").select("conv_id", "turn"), 2, "turn")


@cells_query(""", r AS (SELECT aln_id, col, max(upper(ch)) FILTER (WHERE row_no = 0) AS other FROM cells GROUP BY aln_id, col)
SELECT aln_id, row_no, name, col, CASE WHEN row_no = 1 THEN coalesce(other, ch) ELSE ch END AS ch, is_gap, pos FROM cells JOIN r USING (aln_id, col)""")
def p20_promote_annotation(spark, sf_dir):
    cells = I.cells(spark, sf_dir)
    names = cells.where("row_no = 1").select("aln_id", "name").distinct()
    note = cells.where("row_no = 0").select("aln_id", "col", F.upper("ch").alias("ch")).join(names, "aln_id")
    return A.promote_annotation(cells, note).select("aln_id", "row_no", "name", "col", "ch", "is_gap", "pos")


@query(f"""WITH {I.ROWS} SELECT aln_id, row_no, name, replace(gapped, '-', '') AS seq,
coalesce(sum(length(replace(gapped, '-', ''))) OVER (PARTITION BY aln_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM rows_""")
def p23_unalign(spark, sf_dir):
    return A.unalign(A.ungap(I.rows(spark, sf_dir)))


@query("SELECT doc_id, upper(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS seq FROM documents")
def p24_to_upper(spark, sf_dir):
    return O.fold_case(I.sequences(spark, sf_dir).select(F.col("seq_id").cast("long").alias("doc_id"), "seq"))


@query(r"""WITH r AS (SELECT conv_id::VARCHAR AS aln_id, turn::INTEGER AS row_no, role || '-' || turn AS name, regexp_replace(text, '[^a-zA-Z]', '-', 'g') AS g FROM conversations),
h AS (SELECT *, regexp_extract(g, '^([-. a-z]*)', 1) AS head FROM r), s AS (SELECT *, substr(g, length(head) + 1) AS rest FROM h),
t AS (SELECT *, regexp_extract(rest, '([-. a-z]*)$', 1) AS tail FROM s)
SELECT aln_id, row_no, name, repeat('-', length(head)) || substr(rest, 1, length(rest) - length(tail)) || repeat('-', length(tail)) AS gapped,
length(regexp_replace(head, '[^a-z]', '', 'g'))::BIGINT AS from_shift, length(regexp_replace(tail, '[^a-z]', '', 'g'))::BIGINT AS to_shift FROM t""")
def p25_trim_unaligned_ends(spark, sf_dir):
    t = I.table(spark, sf_dir, "conversations")
    gapped = F.regexp_replace("text", "[^a-zA-Z]", "-").alias("gapped")
    rows = t.select(F.col("conv_id").cast("string").alias("aln_id"), F.col("turn").cast("int").alias("row_no"), F.concat("role", F.lit("-"), "turn").alias("name"), gapped)
    return A.trim_unaligned_ends(rows)


@cells_query(f""", e AS (SELECT aln_id, min(col) AS a, max(col) AS b FROM cells WHERE NOT is_gap GROUP BY ALL),
moved AS (SELECT c.aln_id, row_no, name, (col - a)::INTEGER AS col, ch, is_gap FROM cells c JOIN e ON c.aln_id = e.aln_id AND col BETWEEN a AND b)
{I.NUMBERED}""")
def p26_trim_end_gaps(spark, sf_dir):
    return A.trim_end_gaps(I.cells(spark, sf_dir))


@kept_query("keep AS (SELECT aln_id, col FROM cells GROUP BY ALL HAVING count(*) FILTER (WHERE is_gap) <= 1)")
def p27_max_gaps(spark, sf_dir):
    return P.cells(P.max_gaps(I.parts(spark, sf_dir), 1))


@query(f"""WITH {I.ROWS}, o AS (SELECT name, min(length(gapped))::BIGINT AS "offset" FROM rows_ WHERE name LIKE 'user%' GROUP BY name)
SELECT name, aln_id, row_no, gapped, 1 + coalesce("offset", 0) AS start, length(gapped) + coalesce("offset", 0) AS "end" FROM rows_ LEFT JOIN o USING (name)""")
def p28_shift_rows(spark, sf_dir):
    rows = I.rows(spark, sf_dir)
    offsets = rows.where("name like 'user%'").groupBy("name").agg(F.min(F.length("gapped")).cast("long").alias("offset"))
    placed = rows.withColumn("start", F.lit(1).cast("long")).withColumn("end", F.length("gapped").cast("long"))
    return A.shift_rows(placed, offsets)


@cells_query("""SELECT aln_id, row_no, name, col, CASE WHEN sum(CASE WHEN pos % 10 = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY aln_id, row_no, name ORDER BY col) % 2 = 1 THEN ch ELSE '-' END AS ch FROM cells""")
def p29_mark_segments(spark, sf_dir):
    cells = I.cells(spark, sf_dir)
    return A.mark_segments(cells, cells.where("pos % 10 = 5").select("aln_id", "name", "pos"))


_PAIRS = """p AS (SELECT x.aln_id, x.col, x.name AS n1, x.pos AS pos1, x.ch AS ch1, y.name AS n2, y.pos AS pos2, y.ch AS ch2
FROM cells x JOIN cells y ON x.aln_id = y.aln_id AND x.col = y.col AND x.name < y.name AND NOT x.is_gap AND NOT y.is_gap)"""


@cells_query(""", l AS (SELECT aln_id, col, list({'n': name, 'p': pos, 'c': ch}) AS l FROM cells WHERE NOT is_gap GROUP BY aln_id, col),
x AS (SELECT aln_id, col, l, unnest(l) AS x FROM l), y AS (SELECT aln_id, col, x, unnest([y FOR y IN l IF y.n > x.n]) AS y FROM x)
SELECT aln_id, col, x.n AS n1, x.p AS pos1, x.c AS ch1, y.n AS n2, y.p AS pos2, y.c AS ch2 FROM y""")
def j1_residue_pairs(spark, sf_dir):
    return C.residue_pairs(I.residues(spark, sf_dir))


_SETS = f"""WITH {I.CELLS_B},
pa AS (SELECT x.aln_id, x.name AS n1, y.name AS n2, x.pos AS pos1, y.pos AS pos2 FROM cells x JOIN cells y ON x.aln_id = y.aln_id AND x.col = y.col AND x.name < y.name AND NOT x.is_gap AND NOT y.is_gap),
pb AS (SELECT x.aln_id, x.name AS n1, y.name AS n2, x.pos AS pos1, y.pos AS pos2 FROM cells_b x JOIN cells_b y ON x.aln_id = y.aln_id AND x.col = y.col AND x.name < y.name AND NOT x.is_gap AND NOT y.is_gap),
ga AS (SELECT x.aln_id, x.name, y.name AS other, x.pos FROM cells x JOIN cells y ON x.aln_id = y.aln_id AND x.col = y.col AND x.name <> y.name AND NOT x.is_gap AND y.is_gap),
gb AS (SELECT x.aln_id, x.name, y.name AS other, x.pos FROM cells_b x JOIN cells_b y ON x.aln_id = y.aln_id AND x.col = y.col AND x.name <> y.name AND NOT x.is_gap AND y.is_gap),
ca AS (SELECT aln_id, string_agg(name || ':' || coalesce(pos, -1), ' ' ORDER BY name) AS signature, count(*) FILTER (WHERE NOT is_gap) AS n FROM cells GROUP BY aln_id, col HAVING n > 0),
cb AS (SELECT aln_id, string_agg(name || ':' || coalesce(pos, -1), ' ' ORDER BY name) AS signature, count(*) FILTER (WHERE NOT is_gap) AS n FROM cells_b GROUP BY aln_id, col HAVING n > 0)"""


@query(_SETS + " SELECT aln_id, n1, n2, count(*) AS n_shared FROM pa SEMI JOIN pb USING (aln_id, n1, n2, pos1, pos2) GROUP BY ALL")
def j2_pair_overlap(spark, sf_dir):
    return C.pair_overlap(I.cells(spark, sf_dir), I.cells_b(spark, sf_dir))


@query(_SETS + " SELECT aln_id, name, other, count(*) AS n, count(*) FILTER (WHERE pos = 0) AS n_first FROM ga GROUP BY ALL")
def j3_gap_pairs(spark, sf_dir):
    g = C.gap_pairs(I.cells(spark, sf_dir))
    return g.groupBy("aln_id", "name", "other").agg(F.count("*").alias("n"), F.count_if(F.col("pos") == 0).alias("n_first"))


@query(_SETS + " SELECT aln_id, signature, n FROM ca SEMI JOIN cb USING (aln_id, signature)")
def j4_column_overlap(spark, sf_dir):
    a, b = C.column_signatures(I.cells(spark, sf_dir)), C.column_signatures(I.cells_b(spark, sf_dir))
    return a.join(b, ["aln_id", "signature"], "left_semi")


@cells_query(f""", {_PAIRS}, i AS (SELECT aln_id, n1, n2, count(*) AS aligned, count(*) FILTER (WHERE ch1 = ch2) AS same FROM p GROUP BY ALL)
SELECT *, round(100 * same / aligned, 9) AS identity FROM i WHERE round(100 * same / aligned, 9) BETWEEN 8 AND 12""")
def j6_split_pairs(spark, sf_dir):
    return C.split_pairs(I.residues(spark, sf_dir), 8, 12)


@query(f"""WITH {I.ROWS}, w AS (SELECT aln_id, max(length(gapped)) AS wx, max(length(replace(gapped, '-', ''))) AS wy FROM rows_ GROUP BY aln_id),
wx AS (SELECT aln_id, max(length(gapped)) AS w FROM rows_ WHERE row_no < 3 GROUP BY aln_id), wy AS (SELECT aln_id, max(length(gapped)) AS w FROM rows_ WHERE row_no > 0 GROUP BY aln_id)
SELECT aln_id, name, rpad(CASE WHEN row_no < 3 THEN gapped ELSE '' END, coalesce(wx.w, 0)::INTEGER, '.') || rpad(CASE WHEN row_no > 0 THEN gapped ELSE '' END, coalesce(wy.w, 0)::INTEGER, '.') AS gapped
FROM rows_ LEFT JOIN wx USING (aln_id) LEFT JOIN wy USING (aln_id)""")
def j9_concatenate(spark, sf_dir):
    rows = I.rows(spark, sf_dir)
    return A.concatenate(rows.where("row_no < 3"), rows.where("row_no > 0"))


@query(f"""WITH {I.ANNOTATED}, a AS (SELECT * FROM texts WHERE kind = 'col' OR name LIKE 'user%' OR row_no = 1), b AS (SELECT * FROM texts WHERE kind <> 'col' AND name NOT LIKE 'user-0%'),
wa AS (SELECT aln_id, max(length(text)) AS w FROM a WHERE kind = 'row' GROUP BY aln_id), wb AS (SELECT aln_id, max(length(text)) AS w FROM b WHERE kind = 'row' GROUP BY aln_id),
j AS (SELECT coalesce(a.aln_id, b.aln_id) AS aln_id, coalesce(a.kind, b.kind) AS kind, coalesce(a.row_no, b.row_no) AS row_no, coalesce(a.name, b.name) AS name, coalesce(a.tag, b.tag) AS tag, a.text AS x, b.text AS y
 FROM a FULL JOIN b ON a.aln_id = b.aln_id AND a.kind = b.kind AND a.name IS NOT DISTINCT FROM b.name AND a.tag IS NOT DISTINCT FROM b.tag)
SELECT aln_id, kind, row_no, name, tag, rpad(coalesce(x, ''), coalesce(wa.w, 0)::INTEGER, '.') || rpad(coalesce(y, ''), coalesce(wb.w, 0)::INTEGER, '.') AS text FROM j LEFT JOIN wa USING (aln_id) LEFT JOIN wb USING (aln_id)""")
def j9_concatenate_annotated(spark, sf_dir):
    texts = P.unpack(I.annotated(spark, sf_dir))
    return P.concatenate(texts.where("kind = 'col' or name like 'user%' or row_no = 1"), texts.where("kind != 'col' and name not like 'user-0%'"))


@query(f"WITH {I.ROWS}, o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY aln_id, row_no) AS k FROM rows_) SELECT name, aln_id, row_no FROM o WHERE k = 1")
def j10_find_row(spark, sf_dir):
    return A.find_row(I.rows(spark, sf_dir))


@cells_query(""", n AS (SELECT aln_id, col, max(ch) FILTER (WHERE row_no = 0) AS actual, max(ch) FILTER (WHERE row_no = 1) AS predicted FROM cells GROUP BY aln_id, col)
SELECT *, actual = predicted AS equal FROM n WHERE actual IS NOT NULL AND predicted IS NOT NULL""")
def j12_compare_annotation(spark, sf_dir):
    cells = I.cells(spark, sf_dir).select("aln_id", "row_no", "col", "ch")
    return O.compare_annotation(cells.where("row_no = 0"), cells.where("row_no = 1"))


@cells_query(""", q AS (SELECT aln_id, max(pos) FILTER (WHERE row_no = 0) AS p0, max(pos) FILTER (WHERE row_no = 1) AS p1, max(pos) FILTER (WHERE row_no = 2) AS p2 FROM cells GROUP BY aln_id, col),
l AS (SELECT aln_id, p0 AS a, p1 AS b FROM q WHERE p0 IS NOT NULL AND p1 IS NOT NULL), m AS (SELECT aln_id, p1 AS b, p2 AS c FROM q WHERE p1 IS NOT NULL AND p2 IS NOT NULL)
SELECT coalesce(l.aln_id, m.aln_id) AS aln_id, a, coalesce(l.b, m.b) AS b, c FROM l FULL JOIN m ON l.aln_id = m.aln_id AND l.b = m.b""")
def j16_compose_pairs(spark, sf_dir):
    cells = I.cells(spark, sf_dir).where("not is_gap")

    def pairs(r):
        x = cells.where(F.col("row_no") == r).select("aln_id", "col", F.col("pos").alias("x"))
        y = cells.where(F.col("row_no") == r + 1).select("aln_id", "col", F.col("pos").alias("y"))
        return x.join(y, ["aln_id", "col"])

    return C.compose_pairs(pairs(0), pairs(1))


@query(f"WITH {I.CELLS_B} SELECT a.aln_id, a.name, a.pos, a.col AS col_a, b.col AS col_b FROM cells a JOIN cells_b b ON a.aln_id = b.aln_id AND a.name = b.name AND a.pos = b.pos")
def j18_map_columns(spark, sf_dir):
    return A.map_columns(I.cells(spark, sf_dir), I.cells_b(spark, sf_dir))


_SHARE = """n AS (SELECT aln_id, col, ch, is_gap, count(*) AS n FROM cells GROUP BY ALL),
per AS (SELECT aln_id, col, coalesce(max(n) FILTER (WHERE NOT is_gap), 0) AS top, coalesce(sum(n) FILTER (WHERE NOT is_gap), 0) AS residues, sum(n) AS rows_ FROM n GROUP BY ALL)"""


@cells_query(f", {_SHARE} SELECT aln_id, round(100 * avg(CASE WHEN top > 1 THEN top ELSE 0 END / residues), 9) AS percent_id FROM per WHERE residues > 1 GROUP BY ALL")
def a9_percent_identity(spark, sf_dir):
    return C.percent_identity(I.residues(spark, sf_dir))


@cells_query(f", {_SHARE} SELECT aln_id, round(100 * avg(CASE WHEN top > 1 THEN top ELSE 0 END / rows_), 9) AS percent_id FROM per WHERE residues > 0 GROUP BY ALL")
def a9_percent_identity_with_gaps(spark, sf_dir):
    return C.percent_identity(I.cells(spark, sf_dir), True)


@cells_query(f""", {_PAIRS}, i AS (SELECT aln_id, n1, n2, 100 * count(*) FILTER (WHERE ch1 = ch2) / count(*) AS id FROM p GROUP BY ALL)
SELECT aln_id, round(avg(id), 9) AS percent_id, count(*) AS n_pairs FROM i GROUP BY ALL""")
def a10_percent_identity_pairwise(spark, sf_dir):
    return C.percent_identity_pairwise(I.residues(spark, sf_dir))


_TOP = "n AS (SELECT aln_id, col, ch, count(*) AS n FROM cells WHERE NOT is_gap GROUP BY ALL)"


@cells_query(f", {_TOP}, o AS (SELECT *, row_number() OVER (PARTITION BY aln_id, col ORDER BY n DESC, ch) AS k FROM n) SELECT aln_id, col, ch FROM o WHERE k = 1")
def a11_majority_annotation(spark, sf_dir):
    return C.commonest(P.symbol_counts(I.parts(spark, sf_dir)))


@cells_query(f", {_TOP} SELECT aln_id, col, ch, round(n / sum(n) OVER (PARTITION BY aln_id, col), 9) AS w, row_number() OVER (PARTITION BY aln_id, col ORDER BY n DESC, ch)::INTEGER AS place FROM n")
def a12_column_profile(spark, sf_dir):
    return C.symbol_shares(P.symbol_counts(I.parts(spark, sf_dir)))


@cells_query(f", {_TOP}, o AS (SELECT *, row_number() OVER (PARTITION BY aln_id, col ORDER BY n DESC, ch) AS k FROM n) SELECT aln_id, col, ch FROM o WHERE k = 1")
def a13_consensus(spark, sf_dir):
    return C.commonest(P.symbol_counts(I.parts(spark, sf_dir)))


@cells_query(", n AS (SELECT aln_id, col, count(*) AS n FROM cells WHERE NOT is_gap GROUP BY ALL) SELECT aln_id, sum(n * (n - 1) // 2)::BIGINT AS n_pairs FROM n GROUP BY ALL")
def a15_residue_pair_count(spark, sf_dir):
    return C.residue_pair_count(I.residues(spark, sf_dir))


@query(_SETS + """, b AS (SELECT aln_id, count(*) FILTER (WHERE NOT is_gap) AS residues, count(DISTINCT name) AS rows_ FROM cells GROUP BY ALL HAVING residues > 0),
n AS (SELECT aln_id, residues, rows_, coalesce(any_value(x.n), 0) AS pairs_a, coalesce(any_value(y.n), 0) AS pairs_b, coalesce(any_value(z.n), 0) AS pairs_both,
 coalesce(any_value(u.n), 0) AS cols_a, coalesce(any_value(v.n), 0) AS cols_both, coalesce(any_value(w.n), 0) AS gaps_both FROM b
LEFT JOIN (SELECT aln_id, count(*) AS n FROM pa GROUP BY ALL) x USING (aln_id) LEFT JOIN (SELECT aln_id, count(*) AS n FROM pb GROUP BY ALL) y USING (aln_id)
LEFT JOIN (SELECT aln_id, count(*) AS n FROM pa SEMI JOIN pb USING (aln_id, n1, n2, pos1, pos2) GROUP BY ALL) z USING (aln_id)
LEFT JOIN (SELECT aln_id, count(DISTINCT signature) AS n FROM ca GROUP BY ALL) u USING (aln_id)
LEFT JOIN (SELECT aln_id, count(DISTINCT signature) AS n FROM ca SEMI JOIN cb USING (aln_id, signature) GROUP BY ALL) v USING (aln_id)
LEFT JOIN (SELECT aln_id, count(*) AS n FROM ga SEMI JOIN gb USING (aln_id, name, other, pos) GROUP BY ALL) w USING (aln_id) GROUP BY aln_id, residues, rows_)
SELECT aln_id, pairs_a, pairs_b, pairs_both, gaps_both, cols_a, cols_both, round(pairs_both / nullif(pairs_a, 0), 9) AS sps, round(pairs_both / nullif(pairs_b, 0), 9) AS ppv,
round(cols_both / nullif(cols_a, 0), 9) AS tcs, round((2 * pairs_both + gaps_both) / nullif(residues * (rows_ - 1), 0), 9) AS ama FROM n""")
def compare_alignments(spark, sf_dir):
    """A16 and A17: the flagship."""
    return C.compare_alignments(I.cells(spark, sf_dir), I.cells_b(spark, sf_dir))


@cells_query(f", {_PAIRS} SELECT aln_id, n1, n2, ch1, ch2, count(*) AS n FROM p GROUP BY ALL")
def a23_substitution_counts(spark, sf_dir):
    return C.substitution_counts(I.residues(spark, sf_dir))


@cells_query(f""", {_PAIRS}, d AS (SELECT aln_id, n1, n2, count(*) FILTER (WHERE ch1 <> ch2) / count(*) AS p FROM p GROUP BY ALL)
SELECT aln_id, n1, n2, round(p, 9) AS p_distance, CASE WHEN p < 0.75 THEN round(-0.75 * ln(1 - p * 4 / 3), 9) END AS jukes_cantor FROM d""")
def a24_pairwise_distance(spark, sf_dir):
    return C.pairwise_distance(C.substitution_counts(I.residues(spark, sf_dir)))


@cells_query(f", {_PAIRS} SELECT aln_id, n1, n2, count(*) AS n_match, round(avg(pos1 - pos2), 9) AS shift FROM p GROUP BY ALL")
def a33_pair_path_stats(spark, sf_dir):
    return C.pair_path_stats(C.residue_pairs(I.residues(spark, sf_dir)))


@cells_query("SELECT aln_id, count(DISTINCT row_no) AS n_rows, (max(col) + 1)::BIGINT AS n_cols, count(*) FILTER (WHERE NOT is_gap) AS n_residues FROM cells GROUP BY ALL")
def a38_summary(spark, sf_dir):
    return A.summary(I.cells(spark, sf_dir))


@cells_query(f""", {_PAIRS}, i AS (SELECT aln_id, n1, n2, 100 * count(*) FILTER (WHERE ch1 = ch2) / count(*) AS id FROM p GROUP BY ALL),
r AS (SELECT DISTINCT aln_id, row_no, name FROM cells), j AS (SELECT i.aln_id, a.row_no AS r1, b.row_no AS r2, id FROM i JOIN r a ON i.aln_id = a.aln_id AND n1 = a.name JOIN r b ON i.aln_id = b.aln_id AND n2 = b.name),
e AS (SELECT aln_id, r1 AS row_no, r2 > r1 AS later, id FROM j UNION ALL SELECT aln_id, r2, r1 > r2, id FROM j),
w AS (SELECT aln_id, row_no FROM e GROUP BY ALL HAVING max(id) FILTER (WHERE later) >= 10 OR max(id) < 5) SELECT * FROM r ANTI JOIN w USING (aln_id, row_no)""")
def u4_nonredundant(spark, sf_dir):
    return C.nonredundant(I.cells(spark, sf_dir), 10, 5)


@query(_SETS + " SELECT DISTINCT aln_id, signature FROM ca")
def u2_distinct_columns(spark, sf_dir):
    return C.distinct_columns(I.cells(spark, sf_dir))


@query(_SETS + " SELECT * FROM pa EXCEPT ALL SELECT * FROM pb")
def u3_pairs_except(spark, sf_dir):
    return C.pairs_except(I.cells(spark, sf_dir), I.cells_b(spark, sf_dir))


@query(f"WITH {I.ROWS} SELECT aln_id, min(length(gapped))::INTEGER AS shortest, max(length(gapped))::INTEGER AS longest FROM raw_ GROUP BY ALL HAVING min(length(gapped)) <> max(length(gapped))")
def v1_check_flush(spark, sf_dir):
    return A.check_flush(I.raw_rows(spark, sf_dir))


@query(f"WITH {I.ROWS} SELECT name, count(*) AS n FROM rows_ GROUP BY ALL HAVING count(*) > 1")
def v2_check_unique(spark, sf_dir):
    return A.check_unique(I.rows(spark, sf_dir), "name")


@query(f"WITH {I.ROWS} SELECT name, count(DISTINCT replace(gapped, '-', '')) AS n_seqs FROM rows_ GROUP BY ALL HAVING n_seqs > 1")
def v3_check_consistent(spark, sf_dir):
    return A.check_consistent(A.ungap(I.rows(spark, sf_dir)))


@cells_query(""", g AS (SELECT aln_id, col, string_agg(CASE WHEN is_gap THEN '-' ELSE 'x' END, '' ORDER BY row_no) AS profile FROM cells GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(profile) OVER (PARTITION BY aln_id ORDER BY col) = profile THEN 0 ELSE 1 END AS new FROM g),
b AS (SELECT *, sum(new) OVER (PARTITION BY aln_id ORDER BY col) AS block FROM f)
SELECT aln_id, block::BIGINT AS block, min(col) AS first_col, max(col) AS last_col, any_value(profile) AS profile FROM b GROUP BY aln_id, block""")
def w14_gap_blocks(spark, sf_dir):
    return C.gap_blocks(I.cells(spark, sf_dir))
