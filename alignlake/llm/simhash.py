"""SimHash near-duplicates found through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignlake.llm.common import map_texts, small_batches
from alignlake.llm.components import components
from alignlake.scratch import drop, free_name, materialise, numbered

SEED = 42
#: Bits of each band; with 5 bands and at most 3 differing bits, two bands at least are equal.
BANDS = (13, 13, 13, 13, 12)
#: Rows of a bucket compared in one group; larger buckets are compared block against block.
BLOCK_ROWS = 4096
REFERENCES = 24


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of one text: words of ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, shingles with repeats."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for s in range(0, n, 1 << 16):
        e = min(n, s + (1 << 16))
        h = np.fromiter(
            (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[s:e].tolist(), ends[s + k - 1 : e + k - 1].tolist(), strict=True)),
            np.uint64,
            e - s,
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp long)``; a text without words (or null) has fingerprint zero."""

    def each(keys: list, texts: list) -> dict[str, list]:
        fps = [fingerprint(t, shingle) for t in texts]
        return {"doc_id": keys, "fp": [f - (1 << 64) if f >> 63 else f for f in fps]}

    return map_texts(docs, each, "doc_id long, fp long")


def reference_fingerprints(n: int = REFERENCES) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def pivot_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference (one row for each reference)."""
    return np.stack([np.bitwise_count(fps ^ r) for r in references]).astype(np.int8)


def links_in_groups(group: np.ndarray, fps: np.ndarray, side: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (``max_bits`` or fewer differing bits) inside each group.

    By the triangle inequality no reference's distances to two linked fingerprints differ by more than
    ``max_bits``.  The rows of a group are sorted by their distance to the first reference, and a row is only
    paired with those behind it that are near enough there: the table, not the group's size, says how many pairs
    there are.  Pairs go at the first other coordinate that differs by more; survivors are verified.  Rows of one
    ``side`` (0 or 1) aren't paired, as another group has them together; side 2 marks groups of their own.
    """
    table = pivot_table(fps, reference_fingerprints())
    order = np.lexsort((table[0], group))
    group, fps_, side, table = group[order], fps[order], side[order], table[:, order]
    n = len(fps_)
    root = np.arange(n)
    out_a, out_b = [], []
    at, lag = np.arange(n), 1
    while True:
        at = at[at + lag < n]
        at = at[(group[at] == group[at + lag]) & (table[0][at + lag] - table[0][at] <= max_bits)]  # those behind are farther still
        if not len(at):
            break
        hit = at[(side[at] != side[at + lag]) | (side[at] == 2)]
        for row in table[1:]:
            hit = hit[np.abs(row[hit] - row[hit + lag]) <= max_bits]
        hit = hit[np.bitwise_count(fps_[hit] ^ fps_[hit + lag]) <= max_bits]
        hit = hit[root[hit] != root[hit + lag]]
        for i in hit.tolist():
            a, b = i, i + lag
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                out_a.append(order[i])
                out_b.append(order[i + lag])
        if len(hit):
            while not np.array_equal(up := root[root], root):
                root = up
        lag += 1
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def links(distinct: DataFrame, max_bits: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: links that connect whatever ``max_bits`` differing bits connect.

    Fingerprints meet where all bands but ``max_bits`` agree, one key for each choice of bands.  A bucket of more
    than ``block_rows`` rows is cut by pivots: its rows lie in cells of their distances to two references, and
    only cells next to each other meet, one group for each pair of cells (a cell of very many rows is dealt into
    blocks first).  So no task holds a whole hot bucket, and most pairs of its parts are never made.
    """
    keep = len(BANDS) - max_bits
    if keep < 1:
        raise ValueError(f"max_bits is at most {len(BANDS) - 1}")
    edge = np.cumsum((0, *BANDS))
    masks = [sum(((1 << BANDS[b]) - 1) << int(edge[b]) for b in c) for c in combinations(range(len(BANDS)), keep)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(many, "key")
    small = met.where(F.col("n") <= block_rows).select(F.col("key").alias("grp"), "fp", F.lit(2).alias("side"))

    far = reference_fingerprints(2).view(np.int64).tolist()
    cell = lambda r: F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))) / (max_bits + 1)).cast("int")
    hot = met.where(F.col("n") > block_rows).select("key", "fp", cell(far[0]).alias("x"), cell(far[1]).alias("y"))
    sizes = hot.groupBy("key", "x", "y").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    hot = hot.join(sizes, ["key", "x", "y"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    near = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("u"), (F.col("y") + dy).alias("v")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    hot = hot.withColumn("near", near).select("key", "fp", F.struct("x", "y", "block").alias("own"), "near.u", "near.v")
    other = sizes.select("key", F.col("x").alias("u"), F.col("y").alias("v"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    hot = hot.join(other, ["key", "u", "v"]).withColumn("to", F.struct(F.col("u").alias("x"), F.col("v").alias("y"), "block"))
    side = F.when(F.col("own") == F.col("to"), 2).when(F.col("own") < F.col("to"), 0).otherwise(1)
    hot = hot.select(F.xxhash64("key", F.least("own", "to"), F.greatest("own", "to")).alias("grp"), "fp", side.alias("side"))
    small_batches(distinct.sparkSession)
    met = small.unionByName(hot).repartition("grp").sortWithinPartitions("grp", "fp")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, f, s in _whole_groups(parts):
            a, b = links_in_groups(g, f, s, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(f[a].view(np.int64)), pa.array(f[b].view(np.int64))], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _whole_groups(parts: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of sorted rows, cut between groups."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for part in parts:
        held.append((part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64), part.column(2).to_numpy()))
        n += part.num_rows
        if n >= rows:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            g = columns[0]
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if cut:
                yield tuple(c[:cut] for c in columns)
            held, n = [tuple(c[cut:] for c in columns)], len(g) - cut
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp long, component_id)`` for every row.

    ``component_id`` is the smallest doc_id reachable over links of ``max_bits`` or fewer differing
    bits, the row's own included (null only where every doc_id reached is null).  Equal fingerprints
    are one node, so copies are never expanded into pairs.  Null and empty texts have fingerprint
    zero and are linked like any other; repeated rows give repeated rows; an empty table gives none.
    """
    prints = materialise(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(comp, nodes["fp"] == comp["a"], "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    rooted = materialise(rooted)
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(best, "root").select("fp", "component_id"))
    drop(comp, rooted)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, then the first one.

    Rows count by themselves, so rows without doc_id or under one doc_id are alike only if their texts
    are; a row without doc_id leads where its whole group has none.  All columns stay, whatever their names;
    null and empty texts are alike; an empty table gives no rows.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    found = simhash_components(rows.select(F.col(row).alias("doc_id"), "text"), shingle, max_bits)
    return leaders(rows, found, row).select(*docs.columns)


def leaders(rows: DataFrame, found: DataFrame, row: str) -> DataFrame:
    """The ``rows`` that lead their component: smallest doc_id, then smallest number in column ``row``.

    ``found(doc_id, component_id)`` has those numbers as doc_id.
    """
    parts = found.select(F.col("doc_id").alias("n"), F.col("component_id").alias("part"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "n")
    ids = rows.select(F.col(row).alias("n"), "doc_id")
    first = ids.join(parts, "n").groupBy("part").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.n").alias(row)), row, "left_semi")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
