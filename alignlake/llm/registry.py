"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignlake.llm import byte_bpe, codes, near, nearest, packing, phrases, quality, rules, simhash, substring, suffixes, token_counts, url_filter
from alignlake.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left once repeated windows are gone; a row for each document, null and empty texts have no words, repeated rows repeat all their windows."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.col("stripped.kept"), 256).alias("kept_sha256")
    return found.select("doc_id", "stripped.n_words", "stripped.n_removed", digest)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and verdict for each document; null texts and metadata are scored like any other, repeated rows alike."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and batch of each document by its words; null and empty texts have length zero, repeated rows are packed each."""
    return packing.pack(packing.word_count(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each url; null and odd urls have empty host and path and go to the model."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of each asking row; null, zero and non-finite vectors take no part, repeated rows count each."""
    return nearest.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict for each document; null and empty texts fail the base rules, repeated rows alike."""
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document; null and empty texts have none, repeated rows are counted each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of each document; null and empty texts have no ids, repeated rows give repeated rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document; texts without words have fingerprint zero and are linked like any other, rows without doc_id are named by others."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left once strings of smaller documents are gone; null texts count as empty, rows without doc_id neither lose nor cause anything."""
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.col("stripped.kept"), 256).alias("kept_sha256")
    return found.select("doc_id", "stripped.n_bytes", "stripped.n_removed", "stripped.n_spans", digest)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document; null and empty texts are linked with nothing, repeated rows with each other."""
    return near.minhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases; null texts are empty, null languages ``und``, repeated rows count each."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of each vector; null and non-finite vectors take no part, null labels are one label, repeated rows count each."""
    return codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_quality_classifier,
        op3_packing,
        op4_url_filter,
        op5_nearest_neighbours,
        op6_quality_rules,
        op7_token_counts,
        op8_byte_bpe,
        op9_simhash,
        op10_suffix_dedup,
        op11_minhash,
        op12_collocations,
        op13_vector_codes,
    )
}

_WORDS = r"""
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM t)"""

_OP1 = (
    "WITH"
    + _WORDS
    + r""",
g AS (SELECT r, i, array_to_string(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING), ' ') AS win,
             count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM w),
h AS (SELECT r, i, md5(win) AS win FROM g WHERE n = 35),
dup AS (SELECT win FROM h GROUP BY win HAVING count(*) > 1),
hit AS (SELECT r, i FROM h SEMI JOIN dup USING (win)),
gone AS (SELECT w.r, w.i, w.word, max(hit.i) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
         FROM w LEFT JOIN hit ON w.r = hit.r AND w.i = hit.i),
s AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM gone GROUP BY r)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, coalesce(s.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM t LEFT JOIN s USING (r)"""
)

_OP6 = (
    "WITH"
    + _WORDS
    + r""",
g AS (SELECT r, i, array_to_string(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS win,
             count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM w),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g WHERE n = 8),
k AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM c, range(8) AS o(j) WHERE c > 1 GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
m AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
a AS (SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, length(regexp_replace(t.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(k.n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t.text, '[^a-z]+', '', 'g')) AS n_lower
      FROM t LEFT JOIN m USING (r) LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 3 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR n_upper > n_lower) AS kept
FROM b"""
)

_OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100),
g AS (SELECT r, doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, i FROM g JOIN f USING (win) WHERE doc_id > first),
near AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit),
isle AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS isle FROM near),
span AS (SELECT r, isle, min(i) AS a, max(i) + 50 AS b FROM isle GROUP BY r, isle),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_, row_number() OVER (PARTITION BY r ORDER BY a DESC) AS last FROM span),
piece AS (SELECT gap.r, a, b, substr(x, 2 * from_ + 1, 2 * (a - from_)) AS kept, CASE WHEN last = 1 THEN substr(x, 2 * b + 1) ELSE '' END AS tail FROM gap JOIN d USING (r)),
s AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(kept || tail, '' ORDER BY a) AS kept FROM piece GROUP BY r)
SELECT d.doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(s.kept, d.x))) AS kept_sha256
FROM d LEFT JOIN s USING (r)"""

_OP11 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
k AS MATERIALIZED (SELECT r, hash(gram) AS gram FROM g),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS same FROM k a JOIN k b ON a.gram = b.gram AND a.r < b.r GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS r, a AS to_ FROM edge UNION SELECT reach.r, edge.b FROM reach JOIN edge ON edge.a = reach.to_),
least AS (SELECT reach.r, min(d.doc_id) AS least FROM reach JOIN d ON d.r = to_ GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, doc_id = coalesce(least, doc_id) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r)"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT r, lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT p, lang, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
one AS (SELECT lang, ws[i] AS x, count(*) AS f FROM g GROUP BY ALL),
two AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS f FROM g WHERE i < len(ws) GROUP BY ALL HAVING f >= 10),
three AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS f FROM g WHERE i + 1 < len(ws) GROUP BY ALL HAVING f >= 10),
inside AS (SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
s2 AS (SELECT two.lang, two.x || ' ' || two.y AS phrase, two.f AS a, l.f AS l, r.f AS r, 1000000::HUGEINT * two.f * two.f // (l.f::HUGEINT * r.f) AS score
       FROM two JOIN one l ON l.lang = two.lang AND l.x = two.x JOIN one r ON r.lang = two.lang AND r.x = two.y
       LEFT JOIN inside i ON i.lang = two.lang AND i.x = two.x AND i.y = two.y WHERE i.most IS NULL OR 100 * i.most < 50 * two.f),
c3 AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2,
              1000000::HUGEINT * t.f * t.f // (l1.f::HUGEINT * r1.f) AS s1, 1000000::HUGEINT * t.f * t.f // (l2.f::HUGEINT * r2.f) AS s2
       FROM three t JOIN one l1 ON l1.lang = t.lang AND l1.x = t.x JOIN two r1 ON r1.lang = t.lang AND r1.x = t.y AND r1.y = t.z
       JOIN two l2 ON l2.lang = t.lang AND l2.x = t.x AND l2.y = t.y JOIN one r2 ON r2.lang = t.lang AND r2.x = t.z),
best AS (SELECT * FROM s2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n.n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""



def _op13(rounds: int = 6) -> str:
    """The rounds spelled out one after the other."""
    sql = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS v FROM e, range(8) AS t(p)),
c0 AS (SELECT p, i, v FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM e QUALIFY i < 16) USING (r))"""
    for t in range(rounds + 1):
        sql += f""",
a{t} AS MATERIALIZED (SELECT r, p, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x.v, c.v)])::HUGEINT * 16 + i) AS best FROM x JOIN c{t} AS c USING (p) GROUP BY r, p)"""
        if t < rounds:
            sql += f""",
s{t} AS (SELECT p, (best % 16)::BIGINT AS i, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM (SELECT x.p, best, v, unnest(range(1, len(v) + 1)) AS j FROM x JOIN a{t} USING (r, p)) GROUP BY ALL),
m{t} AS (SELECT p, i, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{t} GROUP BY p, i),
c{t + 1} AS MATERIALIZED (SELECT p, i, coalesce(m.v, c.v) AS v FROM c{t} AS c LEFT JOIN m{t} AS m USING (p, i))"""
    return sql + f""",
f AS (SELECT r, string_agg(printf('%02x', (best % 16)::BIGINT), '' ORDER BY p) AS code, sum(best // 16)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e JOIN f USING (r), h"""


ORACLES = {"op1_substring_dedup": _OP1, "op6_quality_rules": _OP6, "op10_suffix_dedup": _OP10, "op11_minhash": _OP11, "op12_collocations": _OP12, "op13_vector_codes": _op13()}
