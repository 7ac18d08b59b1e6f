"""The training-data operators against brute force, the public libraries and odd inputs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from alignlake.llm import byte_bpe, nearest, packing, quality, rules, simhash, substring, suffixes, token_counts, url_filter

DOCS = "doc_id long, text string, _row string"
ODD = [None, "", " \n\t", "one", "a" * 3000, "<|endoftext|> don't é ΑΣ", "x y\x1cz\u00a0w"]


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    shared = " ".join(rnd.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        own = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 150)))
        out.append(f"{own}\n{shared} {own[:40]}" if i % 3 == 0 else own)
    return out + ODD + [out[0], out[0], out[1]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, h string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, h string")


def words_of(t):
    return (t or "").encode().split()


def test_repeated_windows_go(docs, empty):
    w = 35
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seen = Counter(tuple(x[i : i + w]) for _, t in rows for x in [words_of(t)] for i in range(len(x) - w + 1))
    want = []
    for d, t in rows:
        x = words_of(t)
        gone = {i + j for i in range(len(x) - w + 1) if seen[tuple(x[i : i + w])] > 1 for j in range(w)}
        want.append((d, len(x), len(gone), b" ".join(v for i, v in enumerate(x) if i not in gone).decode()))
    out = substring.remove_repeats(docs)
    assert out.columns == [*docs.columns, "stripped"]
    got = [(r.doc_id, r.stripped.n_words, r.stripped.n_removed, r.stripped.kept) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[2] for x in got) > 0
    assert substring.remove_repeats(empty).count() == 0


def test_index_is_the_same_for_any_batches(docs):
    get = lambda b: sorted(map(repr, substring.remove_repeats(docs, batches=b).select("doc_id", "stripped").collect()))
    assert get(1) == get(5)


def test_repeated_bytes_go(docs, empty):
    w = 50
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    first = {}
    for d, x in rows:
        for i in range(len(x) - w + 1):
            if d is not None:
                first[x[i : i + w]] = min(d, first.get(x[i : i + w], d))
    want = []
    for d, x in rows:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - w + 1):
            if d is not None and first[x[i : i + w]] < d:
                gone[i : i + w] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    out = suffixes.remove_repeats(docs).collect()
    got = [(r.doc_id, r.stripped.n_bytes, r.stripped.n_removed, r.stripped.n_spans, hashlib.sha256(r.stripped.kept).hexdigest()) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[2] for x in got) > 0
    assert suffixes.remove_repeats(empty).count() == 0


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = sorted(repr((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids))) for r in docs.collect())
    for chunk in (token_counts.CHUNK, 7):
        got = token_counts.count_tokens(docs, path, chunk=chunk).collect()
        assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in got) == want
    assert token_counts.count_tokens(empty, path).count() == 0


def test_byte_bpe_equals_the_library(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    c = byte_bpe.codec(path, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    want = {}
    for r in docs.collect():
        ids = np.array(lib.encode_ordinary(r.text or ""), "<u4").tobytes()
        want[repr((r.doc_id, r.text))] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = byte_bpe.round_trip(docs, path, P.PATTERN).collect()
    assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter(want[repr((r.doc_id, r.text))] for r in docs.collect())
    assert byte_bpe.round_trip(empty, path, P.PATTERN).count() == 0


def test_prefix_tables_append_and_edit_exactly():
    c = byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    table = byte_bpe.PrefixTable(c, b"hello")
    assert table.append(b"worlding").tokens() == byte_bpe.PrefixTable(c, b"helloworlding").tokens()
    assert table.edit(3, 7, b"p the").tokens() == byte_bpe.PrefixTable(c, b"help therlding").tokens()
    assert c.shared_tokens(b"helloworlding") == byte_bpe.PrefixTable(c, b"helloworlding").tokens()


def test_simhash_components_equal_brute_force(docs, empty):
    def brute(t):
        w = (t or "").encode().lower().split()
        k = min(3, len(w))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    rows = [(r.doc_id, brute(r.text)) for r in docs.collect()]
    comp = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if bin(a ^ b).count("1") <= 3:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    want = sorted(repr((d, f, least[comp[i]])) for i, (d, f) in enumerate(rows))
    got = simhash.simhash_components(docs).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()
    assert sorted(repr((r.doc_id, int(r.f, 16), r.component_id)) for r in got) == want
    assert simhash.simhash_components(empty).count() == 0


def test_links_survive_small_blocks(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(5)]
    fps = sorted({b ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for b in base for _ in range(60)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")

    def groups(pairs):
        root = {f: f for f in fps}
        for _ in range(len(fps)):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    want = groups([(a, b) for a in fps for b in fps if bin(a ^ b).count("1") <= 3])
    assert groups([(r.a, r.b) for r in simhash.links(frame, block_rows=7).collect()]) == want


def test_rules_and_ablation(docs, empty):
    book = rules.judge(docs)
    for r in book.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rules.measure(("a b c d e f g h " * 2).encode())[5] == 16
    assert rules.measure(b"x\nx\n \nx")[3:5] == (3, 2)
    kept = lambda p: rules.ledger(docs).where(rules.passes(p)).count()
    for r in rules.ablation(rules.ledger(docs)).collect():
        rest = sum(rules.bit(n) for n in rules.POLICIES["v2"] if n != r.rule)
        assert rules.ledger(docs).where(f"failed & {rest} = 0").count() - kept("v2") == r.n_only
    assert rules.judge(empty).count() == 0


def test_url_rules_and_model(spark):
    hosts = ["a.example.com", "www.example.com", "b.example.net", "example.org", "spam.example.net"]
    urls = [f"http://{h}/{p}/{i}" for h in hosts for p in ("en", "fr", "es", "de") for i in range(30)]
    urls += [None, "", "nothing", "HTTP://WWW.Example.COM?x", "x://É.net/es/#f", "http://net/es/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    by = {u: got[i] for i, u in enumerate(urls)}
    assert (by[None].host, by[None].path, by[None].rule) == ("", "", None) and by["nothing"].host == ""
    assert by["http://a.example.com/en/1"].rule == "example.com/en/" and by["http://a.example.com/en/1"].verdict == "block"
    assert by["http://www.example.com/en/1"].rule == "www.example.com/en/" and by["http://a.example.com/de/1"].rule == "com/"
    assert by["http://net/es/1"].verdict == "block" and by["HTTP://WWW.Example.COM?x"].host == "www.example.com" and by["HTTP://WWW.Example.COM?x"].rule is None
    ruled = [r for r in got.values() if r.rule]
    assert sum((r.score > 0.5) == (r.verdict == "block") for r in ruled) > 0.95 * len(ruled)
    assert url_filter.judge(pages.where("false")).count() == 0


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 16))
    v[300:600] = v[300]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] * 16), (2080, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(frame).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        score = v @ v[q]
        order = [i for i in sorted(range(900), key=lambda i: (-round(score[i], 9), i)) if i != q][:20]
        assert sorted(found) == list(range(1, 21)) and all(abs(score[i] - s) < 1e-9 for i, s in found.values())
        hit += len({i for i, _ in found.values()} & set(order))
    assert hit >= 0.95 * 20 * len(got)
    assert nearest.nearest(frame.where("false")).count() == 0


def test_bucket_boundaries_are_optimal():
    rnd = random.Random(2)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randint(1, 9)))
        counts = [rnd.randint(1, 9) for _ in lengths]
        k = rnd.randint(1, 4)

        def cost(ends):
            return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))

        from itertools import combinations

        best = min(cost([*c, lengths[-1]]) for r in range(k) for c in combinations(lengths[:-1], r))
        got = packing.boundaries(np.array(lengths), np.array(counts), k)
        assert got[-1] == lengths[-1] and len(got) <= k and cost(got) == best


def test_batches_keep_every_row_and_the_budget(docs, empty):
    rows = packing.pack(packing.word_count(docs), buckets=3, budget=500).collect()
    assert len(rows) == docs.count() and all(r.n_tokens <= r.padded for r in rows)
    sizes = Counter((r.bucket, r.padded, r.batch) for r in rows)
    for bucket in {b for b, _, _ in sizes}:
        own = sorted((batch, n, p) for (b, p, batch), n in sizes.items() if b == bucket)
        fit = max(1, 500 // max(1, own[0][2]))
        assert [b for b, _, _ in own] == list(range(len(own))) and all(n == fit for _, n, _ in own[:-1])
    assert packing.pack(packing.word_count(empty)).count() == 0


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 5 != 0"))
    got = quality.score(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    low = [r.kept for r in got if r.quality == 0]
    assert sum(good) > 0.9 * len(good) and sum(low) < 0.4 * len(low)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0)], docs.schema)
    assert quality.score(odd, model).count() == 2 and quality.score(odd, None).where("kept").count() == 2
    assert quality.train(docs, labels.where("false")) is None and quality.keep_good(odd, labels.where("false")).count() == 2


def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and ids
        docs = C.materialise(out)
    assert C.STAGES[-1][1](spark, docs, sf).count() == docs.count()
