"""Frequent words of all lengths against brute force."""

import random
from collections import Counter

from alignlake.operators import sequences as S
from alignlake.plans import registry


def test_words_of_12_to_100_letters_equal_brute_force(spark):
    rnd = random.Random(6)
    letters = lambda n: "".join(rnd.choice("acgt") for _ in range(n))
    shared = [letters(130), letters(40), letters(23)]
    seqs = [letters(20) + rnd.choice(shared) + letters(rnd.randrange(30)) for _ in range(60)] + ["", "a", "a" * 150, None]
    want = Counter(s[i : i + k] for s in seqs if s for k in range(12, 101) for i in range(len(s) - k + 1))
    want = {w: n for w, n in want.items() if n >= 10}
    frame = spark.createDataFrame([(None if i == 3 else i % 50, s) for i, s in enumerate(seqs)], "seq_id long, seq string")
    got = S.frequent_words(frame, 12, 100, 10).collect()
    assert len(got) == len(want) and {r.word: r.n for r in got} == want and max(map(len, want)) == 100


def test_all_lengths_are_registered():
    assert "a8_frequent_words_all" in registry.QUERIES
