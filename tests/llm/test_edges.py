"""Clashing names, odd scripts, very long texts, repeated rows: defined results for each operator."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as C
from alignlake.llm import byte_bpe, nearest, near, packing, rules, simhash, substring, suffixes, token_counts, url_filter

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _row string, _spans int, stripped string, _marks string, measured string, H int, grp string"


@pytest.fixture(scope="module")
def clash(spark):
    rnd = random.Random(3)
    shared = " ".join(f"w{rnd.randrange(50)}" for _ in range(60))
    texts = [None, "", " ", shared + " end", "start " + shared, *(" ".join(f"u{rnd.randrange(900)}" for _ in range(80)) for _ in range(20))]
    rows = [(i if i % 5 else None, t, "en", "s", len(t or ""), "r", i, "x", "m", "y", i, "g") for i, t in enumerate([*texts, texts[6]])]
    return spark.createDataFrame(rows, CLASH)


def test_stages_keep_clashing_columns(spark, clash):
    for name, stage in (("rules", C.quality_rules), ("near", C.simhash_dedup), ("substring", C.substring_dedup)):
        out = stage(spark, clash, "")
        assert out.columns == clash.columns, name
        rows = out.collect()
        assert rows and all(r["_row"] == "r" and r["stripped"] == "x" and r["H"] == r["_spans"] for r in rows), name
        assert stage(spark, clash.where("false"), "").count() == 0
    words = substring.remove_repeats(clash)
    assert words.columns == [*clash.columns, "_stripped"] and sum(r["_stripped"].n_removed for r in words.collect()) >= 120
    found = suffixes.remove_repeats(clash)
    assert found.columns == [*clash.columns, "_stripped"] and sum(r["_stripped"].n_removed for r in found.collect()) > 0
    packed = packing.pack(packing.word_count(clash))
    assert packed.count() == clash.count()


def test_rules_stage_equals_the_ledger(spark, clash):
    kept = rules.judge(clash.selectExpr("h as doc_id", "text")).where("kept")
    assert {r.H for r in rules.keep_passing(clash).collect()} == {r.doc_id for r in kept.collect()}


def test_rows_keep_their_numbers_however_the_table_is_split(spark, tmp_path):
    rnd = random.Random(5)
    shared = " ".join(f"w{rnd.randrange(50)}" for _ in range(60))
    rows = [(i, f"d{i} {shared if i % 7 == 0 else ' '.join(f'u{rnd.randrange(9000)}' for _ in range(60))}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "d"))
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    docs = spark.read.parquet(str(tmp_path / "d"))
    try:
        found = substring.remove_repeats(docs)  # row numbers are given here
        spark.conf.set(key, "2000")  # and the scan is split otherwise when the result is read
        got = {r.doc_id: r.stripped.n_removed for r in found.collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {i: 60 if i % 7 == 0 else 0 for i in range(300)}


def test_an_index_goes_on_in_a_later_session(spark, tmp_path):
    rnd = random.Random(9)
    line = lambda: " ".join(f"x{rnd.randrange(10**6)}" for _ in range(50))
    old, new, once = line(), line(), line()
    batches = [[(0, old), (1, once)], [(2, line()), (3, new)], [(4, old), (5, new), (6, line())]]
    frames = [substring.postings(spark.createDataFrame(b, "_row long, text string")) for b in batches]
    met = []
    for f in frames:
        index = substring.FingerprintIndex(spark, str(tmp_path / "index"))
        met.append({r.h for r in index.add(f).collect()})
        index.close()
    want = {h for h, *_ in ()}
    for text in (old, new):
        want |= set(substring.word_entries(text.encode())[0])
    assert met[0] == met[1] == set() and met[2] == want
    plan = substring.FingerprintIndex(spark, str(tmp_path / "index"))
    assert sum(r.occ for r in plan.read(plan.runs[0][1]).collect()) > 0 and len(plan.runs) <= 2
    a = plan.read(plan.runs[0][1])
    assert "Exchange" not in a.join(plan.read(plan.runs[-1][1]).select("h").hint("merge"), "h", "left_semi")._jdf.queryExecution().executedPlan().toString()
    plan.close(delete=True)


SCRIPTS = ["漢字かな交じり文", "한국어 텍스트", "éäô 가", "👩‍👩‍👧‍👦🏳️‍🌈 ok", "नमस्ते दुनिया", "ﬁ ǅ İstanbul ΣΑΣ", "a‍b­c", "　全角　", "１２３ ½ ²", "𝔘𝔫𝔦", "ไทยไม่เว้นวรรค", "it's I'LL don'T", "\x1c\x1d x", "á̧b"]


@pytest.fixture(scope="module")
def scripts(spark):
    rnd = random.Random(11)
    texts = list(SCRIPTS)
    pool = "".join(SCRIPTS) + "abc XYZ 019 .,!?'\n"
    texts += ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 90))) for _ in range(150)]
    texts += ["漢字" * 30_000, "Ab3+" * 50_000, "word " * 30_000 + "x" * 70_000]
    return list(enumerate(texts))


def test_token_counts_of_many_scripts_and_long_texts(spark, scripts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = {i: (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in scripts}
    frame = spark.createDataFrame(scripts, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame, path).collect()} == want
    short = frame.where("length(text) < 1000")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(short, path, chunk=3).collect()} == {i: want[i][1] for i, t in scripts if len(t) < 1000}


def test_byte_bpe_of_many_scripts_and_long_texts(spark, scripts):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.codec(path, P.PATTERN).ranks, special_tokens={})
    some = scripts  # whole: up to 220,000 letters
    want = {i: hashlib.sha256(np.array(lib.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in some}
    got = byte_bpe.round_trip(spark.createDataFrame(some, "doc_id long, text string"), path, P.PATTERN).collect()
    assert {r.doc_id: r.ids_sha256 for r in got} == want


def test_bytes_that_are_no_text(spark):
    frame = spark.createDataFrame([(1, bytearray(b"ab \xff cd"))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    assert token_counts.count_tokens(frame, P.path("word_bpe_49k.json")).first().n_bytes == 7
    assert byte_bpe.round_trip(frame, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).first().n_tokens > 0
    assert simhash.simhash_components(frame).count() == near.near_components(frame).count() == 1


def test_pointer_buckets_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        length, alphabet = rnd.choice([16, 20, 37, 50]), rnd.choice([b"ab", b"abcdefgh"])
        base = bytes(rnd.choice(alphabet) for _ in range(120))
        texts, docs = [], []
        for _ in range(rnd.randint(1, 8)):
            a = rnd.randint(0, 60)
            texts.append(base[a : a + rnd.randint(0, 100)] + bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))))
            docs.append(rnd.randint(0, 4))
        live, bucket = suffixes.pointer_buckets(texts, np.array(docs), length)
        at, seen, places = 0, {}, []
        for x, d in zip(texts, docs, strict=True):
            for i in range(len(x) - length + 1):
                seen.setdefault(x[i : i + length], set()).add(d)
                places.append((at + i, x[i : i + length]))
            at += len(x)
        want = {p: w for p, w in places if len(seen[w]) > 1}
        assert set(np.flatnonzero(live).tolist()) == set(want)
        ids = {}
        assert all(ids.setdefault(w, bucket[p]) == bucket[p] for p, w in want.items()) and len(set(ids.values())) == len(ids)


def test_repeated_rows_and_lengths_of_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 5))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, v[20].tolist()), (21, v[21].tolist()), (20, v[3].tolist())]
    rows += [(100 + i, rng.standard_normal(3).tolist()) for i in range(7)] + [(140, [1.0, 0.0, 0.0]), (141, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for a, (q, x) in enumerate(rows):
        if q % 20 == 0:
            others = [(-float(np.dot(x, y)), i) for b, (i, y) in enumerate(rows) if a != b and len(x) == len(y)]
            want.append((q, [i for _, i in sorted((round(s, 9), i) for s, i in others)[:20]]))
    got = {}
    for r in nearest.nearest(frame).collect():
        got.setdefault((r.query_id, r["rank"]), []).append(r.vec_id)
    for q in {q for q, _ in want}:
        mine = [w for k, w in want if k == q]
        for rank in range(1, 21):
            assert sorted(got.get((q, rank), [])) == sorted(w[rank - 1] for w in mine if len(w) >= rank), (q, rank)


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((400, 6)))], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, nearest.nearest(frame, every=2).collect()))
    monkeypatch.setattr(nearest, "QUERY_ROWS", 16)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 32)
    assert sorted(map(tuple, nearest.nearest(frame, every=2).collect())) == whole


def test_url_model_equals_numpy_and_holds_on_new_urls(spark):
    rnd = random.Random(6)
    host = lambda net: f"{rnd.choice(['www', 'shop', 'blog', 'a', 'b'])}.site{rnd.randrange(40)}.{'net' if net else 'com'}"
    urls = [f"http://{host(True)}/{rnd.choice(['es', 'fr'])}/p{i}" if i % 2 else f"http://{host(False)}/x/p{i}" for i in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    h, p = url_filter.host_and_path()
    ruled = pages.select(h.alias("host"), p.alias("path"))
    rule, verdict = url_filter.fitting_rule()
    known = url_filter.labelled_urls(ruled.select("*", rule.alias("rule"), verdict.alias("verdict"))).cache()
    weights = np.array(url_filter.fit(known, 4))
    rows = known.collect()
    w, seen = np.zeros(url_filter.WIDTH), np.full(url_filter.WIDTH, 1e-6)
    for _ in range(4):
        off = [1 / (1 + np.exp(-w[r.slots].sum())) - r.y for r in rows]
        slope, hit = np.zeros(url_filter.WIDTH), np.zeros(url_filter.WIDTH, bool)
        for r, o in zip(rows, off, strict=True):
            slope[r.slots] += o
            hit[r.slots] = True
        g = slope / len(rows) + url_filter.PENALTY * w
        seen[hit] += g[hit] ** 2
        w[hit] -= url_filter.RATE * g[hit] / np.sqrt(seen[hit])
    assert np.allclose(weights, w, atol=1e-9)
    fresh = [(i, f"http://new{i}.zone{i}.{'net' if i % 2 else 'com'}/{'es' if i % 2 else 'x'}/q{i}", i % 2) for i in range(200)]
    test = spark.createDataFrame(fresh, "page_id long, url string, bad int").select("bad", h.alias("host"), p.alias("path")).withColumn("slots", url_filter.features())
    right = test.withColumn("s", url_filter.score(url_filter.fit(known))).where("(s > 0.5) = (bad = 1)").count()
    assert right >= 190


def test_very_long_texts(spark):
    rnd = random.Random(8)
    long = " ".join(f"v{rnd.randrange(10**5)}" for _ in range(200_000))
    part = long[300_000:301_000]
    frame = spark.createDataFrame([(1, long), (2, "head " + part + " tail")], "doc_id long, text string")
    words = {r.doc_id: r.stripped for r in substring.remove_repeats(frame).collect()}
    assert words[1].n_removed == words[2].n_removed > 100 and words[1].n_words == 200_000
    found = {r.doc_id: r.stripped for r in suffixes.remove_repeats(frame).collect()}
    assert found[1].n_removed == 0 and found[2].n_removed >= 1000
    assert simhash.simhash_components(frame).count() == 2 and near.near_components(frame).select("component_id").distinct().count() == 2
    assert rules.judge(frame).where("kept").count() >= 1
    assert {r.padded for r in packing.pack(packing.word_count(frame)).collect()} == {200_000, len(("head " + part + " tail").split())}


def test_nearest_equals_exact_sql(spark):
    import duckdb

    found = duckdb.sql("""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0),
    o AS (SELECT q.vec_id AS q, c.vec_id AS c, list_inner_product(q.e, c.e) AS s FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS k FROM o) SELECT q, k, c, s FROM r WHERE k <= 20 ORDER BY q, k""").fetchall()
    got = nearest.nearest(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")).orderBy("query_id", "rank").collect()
    assert [tuple(r)[:3] for r in got] == [r[:3] for r in found]
    assert np.allclose([r.score for r in got], [r[3] for r in found], rtol=0, atol=1e-12)
