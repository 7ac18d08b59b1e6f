"""URL filter: rules first, then a logistic regression on hashed character n-grams.

Everything is DataFrame or SQL functions.  The model is fitted to a bounded labelled table (the
urls that rules decide), and its weights, ``WIDTH`` numbers, are the only thing gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignlake.scratch import materialise


RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
WIDTH = 1 << 12
NGRAMS = (3, 4)
#: Labelled urls of each verdict the model is fitted to, at most.
SAMPLE = 2000
ROUNDS = 12
RATE = 0.5
PENALTY = 1e-3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to
    ``?``, ``#`` or the end.  Both empty for null or where ``://`` is missing."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = fits & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def features() -> Column:
    """Sorted distinct slots below ``WIDTH`` of the n-grams of host and path, and one slot for the intercept."""

    def grams(text: str, mark: str, n: int) -> Column:
        framed = f"concat('^', {text}, '$')"
        return F.expr(
            f"transform(sequence(1, greatest(length({framed}) - {n - 1}, 1)), "
            f"i -> pmod(xxhash64('{mark}', substring({framed}, i, {n})), {WIDTH - 1}) + 1)"
        )

    every = [grams(text, mark, n) for text, mark in (("host", "h"), ("path", "p")) for n in NGRAMS]
    return F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), *every))


def score(weights: list[float]) -> Column:
    """Probability that a url with these ``slots`` is to be blocked."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate("slots", F.lit(0.0), lambda a, i: a + F.get(table, i.cast("int")))
    return 1 / (1 + F.exp(-total))


def labelled_urls(ruled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Up to ``sample`` distinct urls of each verdict, those of smallest hash."""
    known = ruled.where("rule is not null").select("host", "path", "verdict").distinct()
    each = [known.where(F.col("verdict") == v).orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample) for v in ("allow", "block")]
    rows = reduce(DataFrame.unionByName, each)
    return rows.select(features().alias("slots"), (F.col("verdict") == "block").cast("double").alias("y"))


def fit(labelled: DataFrame, rounds: int = ROUNDS) -> list[float]:
    """Logistic regression by adaptive full-batch gradient steps; each round is one aggregation.

    ``labelled(slots, y)`` is bounded by its sampling; a round gathers one number a slot.  With no
    labelled url every weight is zero and the score one half.
    """
    n = labelled.count()
    weights, seen = [0.0] * WIDTH, [1e-6] * WIDTH
    for _ in range(rounds if n else 0):
        off = labelled.select("slots", (score(weights) - F.col("y")).alias("off"))
        slopes = off.select(F.explode("slots").alias("slot"), "off").groupBy("slot").agg(F.sum("off").alias("slope")).collect()
        for slot, slope in slopes:
            g = slope / n + PENALTY * weights[slot]
            seen[slot] += g * g
            weights[slot] -= RATE * g / seen[slot] ** 0.5
    return weights


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``pages(page_id, url)`` -> ``(page_id, host, path, rule, verdict, score)``, one row for each input row.

    A fitting rule decides; otherwise urls of score one half or less are allowed.  Null and odd urls
    have empty host and path and are scored like any other.
    """
    host, path = host_and_path()
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(rules)
    ruled = split.select("*", rule.alias("rule"), verdict.alias("verdict"))
    weights = fit(materialise(labelled_urls(ruled, sample)))
    scored = ruled.withColumn("slots", features()).withColumn("score", score(weights)).drop("slots")
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")))
