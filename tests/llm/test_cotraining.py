"""Co-training: both views hand over labels, both change, and the weaker one gets better."""

import random

from alignlake.llm import quality

_RND = random.Random(1)
GOOD, BAD = (["".join(_RND.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n)] for n in (300, 120))


def corpus(n=2400, seed=7):
    """Bad pages have bad words and, most of them, many marks: either view could tell them."""
    rnd = random.Random(seed)
    rows, bad = [], []
    for i in range(n):
        wrong = rnd.random() < 0.3
        words = rnd.choices(GOOD, k=40) + (rnd.choices(BAD, k=4) if wrong else [])
        rnd.shuffle(words)
        marks = " #" * (20 if wrong and rnd.random() < 0.9 else rnd.randrange(2))
        text = " ".join(words) + marks
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        bad.append(wrong)
    return rows, bad


def test_views_teach_each_other(spark):
    rows, bad = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, int(not bad[i]), 0) for i in range(240)], "doc_id long, quality int, toxic int")

    def wrong(model, view):
        got = quality.score(docs, model).where("doc_id >= 240").collect()
        return sum((r[view] > 0.5) != bad[r.doc_id] for r in got) / len(got)

    alone, taught = quality.train(docs, labels, rounds=0), quality.train(docs, labels, rounds=2)
    assert alone.given == [] and len(taught.given) == 2
    assert all(sum(g[v] for g in taught.given) > 0 for v in ("text", "meta")), taught.given
    assert taught.text.slots.tolist() != alone.text.slots.tolist() and taught.meta.weights.tolist() != alone.meta.weights.tolist()
    assert wrong(taught, "text_score") < 0.5 * wrong(alone, "text_score")
    assert wrong(taught, "score") <= wrong(alone, "score")


def test_labels_without_documents_or_a_class(spark):
    rows, bad = corpus(60)
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), rows[0]], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(not bad[i]), None) for i in range(60)] + [(None, 0, 1), (10_000, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model is not None and quality.score(docs, model).count() == 62
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert quality.train(docs.where("false"), labels) is None
    assert quality.keep_good(docs.where("false"), labels).count() == 0
