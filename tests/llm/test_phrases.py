"""Collocations against plain counting, and the counting quotient filter by itself."""

import random
import re
from collections import Counter

import numpy as np

from alignlake.llm import phrases


def plain(rows, least, top, covered=50):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    out = []
    for lang in totals:
        f = {p: n for (g, p), n in counts.items() if g == lang}
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q in f if len(q) > len(p) and f[q] >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[q] >= covered * a for q in longer):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def corpus():
    rnd = random.Random(6)
    words = ["Red", "red", "hot", "tea", "é", " x", "a-b", "<z>", "0"]
    rows = [(None, None), ("en", ""), ("en", " \t "), ("en", "...")]
    for lang in ("en", "fr", None, "und"):
        for _ in range(60):
            rows.append((lang, "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "!?"]) for _ in range(rnd.choice([3, 40, 300])))))
    rows += [("en", "new york city hall " * 50)] * 3 + [("long", "one two " * 30_000)]
    return rows


def test_equals_plain_counting_whatever_the_batches_and_shards(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = plain(rows, 10, 2000)
    assert len(want) > 100
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == want
    assert sorted(map(tuple, phrases.collocations(docs, batch_bytes=2000, shard_entries=50).collect())) == want
    assert sorted(map(tuple, phrases.collocations(docs, top=5).collect())) == plain(rows, 10, 5)


def test_empty_table_and_texts(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    docs = spark.createDataFrame([("en", None), (None, "rare words")], "lang string, text string")
    assert phrases.collocations(docs).count() == 0


def test_filters_lose_nothing():
    rng = np.random.default_rng(7)
    for bits, n in ((2, 5), (11, 3000), (21, 5000), (32, 4000), (9, 0)):
        left = rng.integers(0, 1 << 2 * bits, n, dtype=np.uint64)
        right = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        mixed = phrases.permute(left, right, bits)
        assert (mixed[0] < 1 << 2 * bits).all() and (mixed[1] < 1 << bits).all()
        back = phrases.restore(*mixed, bits)
        assert (back[0] == left).all() and (back[1] == right).all()
        counts = rng.choice([1, 2, 254, 255, 256, 1 << 40], n)
        entries = phrases.fold(*mixed, counts, bits)
        want = Counter()
        for a, b, c in zip(*(x.tolist() for x in (*mixed, counts))):
            want[a, b] += c
        got = phrases.load(phrases.store(*entries, 2 * bits, bits), 2 * bits)
        assert {(a, b): c for a, b, c in zip(*(x.tolist() for x in got))} == want
        keys = list(zip(got[0].tolist(), got[1].tolist()))
        assert keys == sorted(keys)
    same = np.zeros(1000, np.uint64)  # one quotient holds everything
    entries = (same, np.arange(1000, dtype=np.uint64), np.ones(1000, np.int64))
    got = phrases.load(phrases.store(*entries, 22, 11), 22)
    assert (got[1] == entries[1]).all() and (got[0] == 0).all()
