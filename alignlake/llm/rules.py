"""Quality rules as a bitmask ledger.

Every rule is evaluated once and leaves one failure bit beside the measurements.  Policies are
versioned masks over those bits, so applying one, or asking what a rule alone costs, is bit
arithmetic over the ledger and never touches a text again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignlake.llm.anchors import refine
from alignlake.llm.common import map_texts, small_batches
from alignlake.scratch import free_name

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  #: SQL condition over the measurements


#: A rule's place is its bit; append only, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "3 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("shouting", "n_upper > n_lower"),
)
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules a document must pass.
POLICIES = {"v1": BASE, "v2": tuple(r.name for r in RULES)}


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


def policy_mask(policy: str) -> int:
    return sum(bit(name) for name in POLICIES[policy])


def measure(data: bytes | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``; null counts as empty."""
    data = data or b""
    words = data.split()
    n = len(words)
    flat = np.frombuffer(data, np.uint8)
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    chars = int(np.count_nonzero(~space & ((flat & 0xC0) != 0x80)))
    symbols = sum(map(data.count, (bytes([s]) for s in SYMBOLS)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n >= REPEAT_WINDOW:
        ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        grams = refine(refine(refine(ids, 1), 2), 4)
        _, at, count = np.unique(grams, return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int64)
        starts = np.flatnonzero(count[at] > 1)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + REPEAT_WINDOW, -1)
        repeated = int(np.count_nonzero(np.cumsum(edge[:-1])))
    upper = int(np.count_nonzero((flat >= 65) & (flat <= 90)))
    lower = int(np.count_nonzero((flat >= 97) & (flat <= 122)))
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated, upper, lower


def ledger(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, the measurements and ``failed`` (long, one bit a rule).

    One row for each input row; null and empty texts measure zero everywhere and fail ``few_words``.
    """

    def each(keys: list, texts: list) -> dict[str, list]:
        columns = list(zip(*map(measure, texts), strict=True)) or [()] * len(MEASURES)
        return {"doc_id": keys} | {m: list(c) for m, c in zip(MEASURES, columns, strict=True)}

    measured = map_texts(docs, each, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(bit(r.name))).otherwise(F.lit(0)) for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("long"))


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablation(book: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that fail nothing else.

    The ledger is first counted by failure mask, at most ``2 ** len(RULES)`` rows.
    """
    mask = policy_mask(policy)
    counts = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit(name)).alias("bit")) for name in POLICIES[policy]]))
    each = counts.select("failed", "n", rules.alias("r")).select("failed", "n", "r.rule", "r.bit")
    hit = F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)
    only = F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)
    return each.groupBy("rule").agg(F.sum(hit).alias("n_failed"), F.sum(only).alias("n_only"))


def judge(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` (fails a rule of v1) and ``kept`` (passes v1 and the policy)."""
    book = ledger(docs)
    return book.withColumn("base_failed", ~passes("v1")).withColumn("kept", passes("v1") & passes(policy))


def keep_passing(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of ``docs`` whose text passes v1 and the policy, each judged by itself; all columns stay.

    Null and empty texts fail ``few_words``; repeated rows stay or go together; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measured(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(measure, text)), columns=list(MEASURES), index=text.index)

    name = free_name(docs, "measured")
    rows = docs.withColumn(name, measured(F.col("text").cast("binary")))
    failed = reduce(or_, [F.expr(re.sub(r"\bn_\w+|\bword_chars", rf"{name}.\g<0>", r.fails)) for r in RULES if r.name in {*BASE, *POLICIES[policy]}])
    return rows.where(~failed).select(*docs.columns)
