"""Near-duplicates by exact Jaccard similarity of word shingles.

Bands of fast similarity sketches (see ``sketch``) only propose pairs; whether a pair is linked is decided by
comparing both whole shingle sets.  What shares a bucket yet isn't linked through its hubs meets by an exact
prefix filter, so a bucket's size is never squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignlake.llm.anchors import combine
from alignlake.llm.common import map_texts, small_batches
from alignlake.llm.components import components
from alignlake.llm.simhash import leaders
from alignlake.llm.sketch import bands, shape
from alignlake.scratch import drop, free_name, materialise, numbered

SHINGLE = 5
#: Least similarity of a link, in hundredths, so that the comparison is in whole numbers.
PERCENT = 80
#: Members of a hub that are compared with it in one group.
BLOCK_ROWS = 2048


def shingles(data: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's lower-cased word shingles; a shorter text is one shingle."""
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    found = ids[:n]
    for j in range(1, k):
        found = combine(found, ids[j : j + n])
    return np.unique(found)


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets (ascending hashes) are alike enough."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)), kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(both) - same)


def _grows(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast, so the plan is the same at every size."""
    return df.hint("merge")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct ``pairs(a, b)`` whose sets are alike enough.

    The members ``b`` of an ``a`` are dealt into blocks of about ``BLOCK_ROWS``; its set travels once for each block,
    and a task streams a block past it, so neither side is held whole.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    dealt = pairs.join(_grows(blocks), "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("block"))
    left = dealt.select("a", "block").distinct().join(_grows(sets.withColumnRenamed("node", "a")), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "found")
    right = dealt.join(_grows(sets.withColumnRenamed("node", "b")), "b").select("a", "block", "b", "found")
    met = left.unionByName(right).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, np.uint64)
        for part in parts:
            a, b, found = part.column(0), part.column(2).to_pylist(), part.column(3)
            keep = []
            for i, node in enumerate(b):
                this = np.frombuffer(found[i].as_py(), np.uint64)
                if node is None:
                    hub = this
                elif similar(hub, this, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a, part.column(2)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    return met.mapInArrow(run, "a long, b long")


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``nodes(node, size, root)`` -> ``(token, node, size, root, at)``: the rarest shingles of each set.

    Sets are ordered by how few of these nodes have a shingle, then by its hash.  Two sets of similarity ``percent`` or
    more share one of their first ``size - ceil(percent * size / 100) + 1`` shingles in any such order; ``at`` is its place.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = part.column(1)
            for i in range(part.num_rows):
                tokens = np.frombuffer(found[i].as_py(), np.int64)
                for s in range(0, len(tokens), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.repeat(part.column(0)[i], len(tokens[s : s + (1 << 16)])), pa.array(tokens[s : s + (1 << 16)])], names=["node", "token"])

    tokens = sets.join(_grows(nodes.select("node")), "node", "left_semi").select("node", "found").mapInArrow(run, "node long, token long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(_grows(shared), "token").withColumn("at", F.expr("row_number() over (partition by node order by n, token)"))
    first = F.expr(f"size - (({percent} * size + 99) div 100) + 1")
    return ranked.join(_grows(nodes), "node").where((F.col("n") > 1) & (F.col("at") <= first)).select("token", "node", "size", "root", "at")


def _proposed(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different roots that share a prefix shingle, whose sizes and rests allow enough common shingles."""
    a = prefixes.select("token", F.col("node").alias("a"), F.col("size").alias("p"), F.col("root").alias("r"), F.col("at").alias("i"))
    b = prefixes.select("token", F.col("node").alias("b"), F.col("size").alias("q"), F.col("root").alias("s"), F.col("at").alias("j"))
    enough = f"{100 + percent} * (1 + least(p - i, q - j)) >= {percent} * (p + q) and 100 * least(p, q) >= {percent} * greatest(p, q)"
    return a.join(b, (a["token"] == b["token"]) & F.expr(f"a < b and r != s and {enough}")).select("a", "b").distinct()


def near_components(docs: DataFrame, percent: int = PERCENT, empty_alike: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id)`` for every row; doc_ids are distinct and not null.

    ``component_id`` is the smallest doc_id reachable over links of ``percent`` hundredths of similarity or more.
    Rows of equal sets are one node; texts without words (null among them) are all one, or, unless ``empty_alike``,
    linked with nothing.  An empty table gives no rows.  In each bucket every node is compared with the smallest one
    and with that of all others which stands in most buckets, which settles buckets of three.  Nodes of larger buckets that still hold
    several components meet by an exact prefix filter over their whole sets, so the unlike texts of a large group with much in common are never paired.
    """
    small_batches(docs.sparkSession)
    form = shape(percent)

    def each(keys: list, texts: list) -> dict[str, list]:
        sets = [shingles(t) for t in texts]
        return {
            "doc_id": keys,
            "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "size": list(map(len, sets)),
            "keys": [bands(s, *form) for s in sets],
        }

    prints = materialise(map_texts(docs, each, "doc_id long, digest binary, size long, keys array<long>"))
    named = materialise(prints.select("doc_id", "digest").groupBy("digest").agg(F.min("doc_id").alias("node")))
    nodes = prints.join(_grows(named.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    rows = nodes.select(F.col("doc_id").alias("node"), "size", F.explode("keys").alias("key"))
    mark = lambda i: F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}")
    met = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), mark(1), mark(2))
    # Buckets with the same nodes propose the same pairs: one of them is enough.
    buckets = met.where("n > 1").groupBy("n", "hub", "m1", "m2").agg(F.min("key").alias("key")).select("key", "hub", "n")
    rows = materialise(rows.join(_grows(buckets), "key"))
    wanted = rows.select(F.col("node").alias("doc_id")).distinct()

    def whole(keys: list, texts: list) -> dict[str, list]:
        return {"node": keys, "found": [shingles(t).tobytes() for t in texts]}

    sets = materialise(map_texts(docs.join(_grows(wanted), "doc_id", "left_semi").select("doc_id", "text"), whole, "node long, found binary"))
    often = rows.groupBy("node").agg(F.count("*").alias("n_keys"))
    centre = rows.where("node != hub").join(_grows(often), "node").groupBy("key").agg(F.max(F.struct("n_keys", "node"))["node"].alias("centre"))
    to_centre = rows.join(_grows(centre.withColumnRenamed("key", "k")), F.col("key") == F.col("k"))
    pairs = rows.select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(to_centre.select(F.col("centre").alias("a"), F.col("node").alias("b")))
    links = materialise(_verified(pairs.where("a != b").distinct(), sets, percent))
    comp = components(links)
    drop(links)

    now = rows.join(_grows(comp.select(F.col("a").alias("node"), F.col("b").alias("up"))), "node", "left").withColumn("root", F.coalesce("up", "node")).drop("up")
    several = now.where("n > 3").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = materialise(now.join(_grows(several), "key", "left_semi").select("node", "size", "root").distinct())
    proposed = materialise(_proposed(_prefixes(left, sets, percent), percent))
    more = materialise(_verified(proposed, sets, percent))
    drop(rows, left, proposed, sets)
    if not more.isEmpty():
        last, comp = comp, components(comp.unionByName(more))
        drop(last)
    drop(more)

    rooted = named.join(_grows(comp.select(F.col("a").alias("node"), F.col("b").alias("up"))), "node", "left")
    rooted = rooted.select("digest", F.coalesce("up", "node").alias("root"))
    found = F.col("root") if empty_alike else F.when(F.col("size") > 0, F.col("root")).otherwise(F.col("doc_id"))
    out = materialise(prints.select("doc_id", "digest", "size").join(_grows(rooted), "digest").select("doc_id", F.col("size").alias("n_shingles"), found.alias("component_id")))
    drop(prints, named, comp)
    return out


def minhash_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id, kept)`` for every row.

    A document's set holds its distinct five-word shingles, A-Z lower-cased (the whole sequence where it has fewer
    words); documents link where their sets' similarity is ``percent`` hundredths or more.  ``component_id`` is the smallest
    doc_id reachable; ``kept`` says that it is the row's own.  Null and empty texts have empty sets and are linked
    with nothing.  Repeated rows are linked, and all rows of a kept doc_id are kept.  Rows without doc_id lend their links
    to others but name no component: theirs is null where no doc_id is reached, and they aren't kept.  An empty table gives no rows.
    """
    rows = numbered(docs.select("doc_id", "text"))
    found = near_components(rows.select(F.col("_row").alias("doc_id"), "text"), percent, empty_alike=False)
    found = materialise(rows.select("_row", F.col("doc_id").alias("id")).join(_grows(found.withColumnRenamed("doc_id", "_row")), "_row"))
    drop(rows)
    least = found.groupBy("component_id").agg(F.min("id").alias("least"))
    out = found.join(_grows(least), "component_id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("id") == F.col("least"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, then the first one; all columns stay.

    Texts without words are alike.  Rows without doc_id lead only where their whole group has none; repeated rows are alike.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    found = near_components(rows.select(F.col(row).alias("doc_id"), "text"), percent)
    out = materialise(leaders(rows, found, row).select(*docs.columns))
    drop(rows, found)
    return out
