"""Byte-level substring removal by bucket-pointer refinement of suffixes.

First Spark deals sampled suffixes, the anchors of the 50-byte windows (see ``anchors``), into buckets by
their first 16 bytes.  An anchor whose bucket no other document shares is settled and leaves, with all its
windows; one whose whole surroundings stand in a smaller document too is decided.  The suffixes of the
others are refined bucket by bucket: sorted by the pair (own bucket, bucket of the suffix further on), the
new buckets being the pointers of the next round, from 8 to 16 to 32 to 50 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignlake.llm.anchors import byte_buckets, refine, runs
from alignlake.llm.common import small_batches
from alignlake.scratch import drop, free_name, materialise, numbered

LENGTH = 50
GRAM = 16
#: Bytes of text behind one bucket of anchors, about; buckets, at least.
BUCKET_BYTES, LEAST_BUCKETS = 2 << 20, 64


def buckets_at(data: bytes, length: int) -> np.ndarray:
    """Identifier of the ``length`` bytes at every offset, by doubling from 8 bytes."""
    got, have = byte_buckets(data), 8
    while have < length:
        step = min(have, length - have)
        got = refine(got, step)
        have += step
    return got


def _entries(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, ctx, first window, windows) of each run of a text; ctx digests all bytes of the run's windows."""
    grams = buckets_at(data, GRAM)
    at, lo, n = runs(grams, length - GRAM + 1)
    digest = xxhash.xxh3_64_intdigest
    ctx = np.fromiter((digest(data[s : s + m + length - 1], a - s) for a, s, m in zip(at.tolist(), lo.tolist(), n.tolist(), strict=True)), np.uint64, len(at))
    return grams[at], ctx, lo, n


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.zeros(1, x.dtype))


def _pack(h: np.ndarray, ctx: np.ndarray, row: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """Columns of one batch and bucket as bytes: 8 of each bucket id, 6 of each ctx, the rest compressed."""
    rest = b"".join((_steps(row).astype("<i8").tobytes(), _steps(doc).astype("<i8").tobytes(), lo.astype("<u4").tobytes(), n.astype(np.uint8).tobytes()))
    ids = ctx.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return len(h).to_bytes(4, "little") + h.astype("<u8").tobytes() + ids + zstandard.compress(rest, 3)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    k = int.from_bytes(data[:4], "little")
    h = np.frombuffer(data, "<u8", k, 4)
    ids = np.zeros((k, 8), np.uint8)
    ids[:, :6] = np.frombuffer(data, np.uint8, 6 * k, 4 + 8 * k).reshape(k, 6)
    rest = zstandard.decompress(data[4 + 14 * k :])
    row, doc = (np.cumsum(np.frombuffer(rest, "<i8", k, 8 * k * i)) for i in range(2))
    return h, ids.view("<u8").ravel(), row, doc, np.frombuffer(rest, "<u4", k, 16 * k).astype(np.int64), np.frombuffer(rest, np.uint8, k, 20 * k).astype(np.int64)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in rows ordered by ``keys``."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _settle(h: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, sure, open) of one bucket's anchors: ``sure`` ones stand wholly in a smaller doc too; ``open``
    ones share their first bytes, but not all, with anchors of other documents."""
    order = np.lexsort((doc, ctx, h))
    h, ctx, doc = h[order], ctx[order], doc[order]
    group, bucket = np.cumsum(_firsts(h, ctx)) - 1, np.cumsum(_firsts(h)) - 1
    least = doc[np.flatnonzero(_firsts(h, ctx))][group] if len(h) else doc
    starts = np.flatnonzero(_firsts(h))
    mixed = np.zeros(len(h), bool)
    if len(h):
        ends = np.append(starts[1:], len(h)) - 1
        several = group[starts] != group[ends]
        across = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        mixed = (several & across)[bucket]
    sure = doc > least
    return order, sure, mixed & ~sure


def _parts(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket number, whether several documents share the bucket) of each suffix, by sorting ``key``."""
    order = np.argsort(key, kind="stable")
    new = _firsts(key[order])
    number, open_ = np.empty(len(key), np.int64), np.empty(len(key), bool)
    of = np.cumsum(new) - 1
    number[order] = of
    if len(key):
        starts, docs = np.flatnonzero(new), doc[order]
        open_[order] = (np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts))[of]
    return number, open_


def pointer_buckets(texts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(open, bucket) of every offset of the joined ``texts``: open ones share ``length`` bytes with another of ``docs``.

    Suffixes start in the buckets of their first 8 bytes.  Each round sorts those that several documents still
    share by the pair (own bucket, bucket of the suffix as many bytes further on as they are known to share), and
    writes the new buckets into the table that the next round reads.  A suffix whose bucket one document has for
    itself is settled and sorted no more; what points to it settles in the next round.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data, ends, doc = b"".join(texts), np.repeat(np.cumsum(sizes), sizes), np.repeat(docs, sizes)
    bucket = np.arange(len(data), dtype=np.int64)
    here = np.flatnonzero(bucket + 8 <= ends)
    number, open_ = _parts(byte_buckets(data)[here], doc[here])
    bucket[here] = number
    here, known = here[open_], 8
    while known < length and len(here):
        step = min(known, length - known)
        here = here[here + step + known <= ends[here]]
        number, open_ = _parts((bucket[here].astype(np.uint64) << np.uint64(32)) | bucket[here + step].astype(np.uint64), doc[here])
        bucket[here] = number + int(bucket.max()) + 1
        _, bucket = np.unique(bucket, return_inverse=True) if int(bucket.max()) >> 31 else (None, bucket)
        here, known = here[open_], known + step
    live = np.zeros(len(data), bool)
    live[here] = True
    return live, bucket


def repeats(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``rows(_row, doc_id, text)`` -> ``(_row, marks array<struct<lo, mask>>)``: bit j of a mask says that the
    string of ``length`` bytes at ``lo + j`` also starts in a document of smaller doc_id."""
    spark = rows.sparkSession
    small_batches(spark)
    if not GRAM <= length <= GRAM + 47:
        raise ValueError(f"length is {GRAM} to {GRAM + 47} bytes")
    rows = rows.where("doc_id is not null and text is not null").select("_row", F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BUCKETS - 1, size // BUCKET_BYTES).bit_length()

    def anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, docs, texts = (c.to_pylist() for c in part.columns)
            got = [_entries(t, length) for t in texts]
            many = [len(g[0]) for g in got]
            if not sum(many):
                continue
            h, ctx, lo, n = (np.concatenate(x) for x in zip(*got, strict=True))
            row, doc = np.repeat(np.array(ids), many), np.repeat(np.array(docs), many)
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            sets = np.split(order, cuts)
            packed = [_pack(h[s], ctx[s], row[s], doc[s], lo[s], n[s]) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[s[0]]) for s in sets], pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    def settle(table: pa.Table) -> pa.Table:
        h, ctx, row, doc, lo, n = (np.concatenate(x) for x in zip(*map(_unpack, table["packed"].to_pylist()), strict=True))
        order, sure, unsure = _settle(h, ctx, doc)
        take = order[sure | unsure]
        open_ = unsure[sure | unsure]
        return pa.table({"_row": row[take], "lo": lo[take].astype(np.int32), "n": n[take].astype(np.int32), "h": np.where(open_, h[take].view(np.int64), 0), "open": open_})

    packed = rows.mapInArrow(anchors, "bucket long, packed binary")
    settled = materialise(packed.groupBy("bucket").applyInArrow(settle, "_row long, lo int, n int, h long, open boolean"))

    def contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[], [], [], [], [], []]
            for r, d, text, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for m in wanted:
                    for c, x in zip(out, (m["h"], r, d, m["lo"], m["n"], text[m["lo"] : m["lo"] + m["n"] + length - 1]), strict=True):
                        c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "_row", "doc_id", "lo", "n", "bytes"])

    def expand(table: pa.Table) -> pa.Table:
        row, doc, lo, n = (table[c].to_numpy() for c in ("_row", "doc_id", "lo", "n"))
        texts = table["bytes"].to_pylist()
        live, bucket = pointer_buckets(texts, doc, length)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
        of = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        open_ = live[at[of] + j]
        of, j = of[open_], j[open_]
        ids, docs = bucket[at[of] + j], doc[of]
        least = np.full(int(ids.max()) + 1 if len(ids) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, ids, docs)
        hit = docs > least[ids]
        mask = np.zeros(len(n), np.int64)
        np.bitwise_or.at(mask, of[hit], np.int64(1) << j[hit])
        keep = mask != 0
        return pa.table({"_row": row[keep], "lo": lo[keep], "mask": mask[keep]})

    wanted = settled.where("open").groupBy("_row").agg(F.collect_list(F.struct("lo", "n", "h")).alias("wanted"))
    texts = rows.join(wanted, "_row").select("_row", "doc_id", "text", "wanted")
    small = texts.mapInArrow(contexts, "h long, _row long, doc_id long, lo int, n int, bytes binary")
    bucket = F.shiftrightunsigned("h", 62 - bits).alias("bucket")  # four for each of the first round's
    masks = materialise(small.select(bucket, "*").groupBy("bucket").applyInArrow(lambda t: expand(t.drop_columns(["bucket"])), "_row long, lo int, mask long"))
    whole = settled.where("not open").select("_row", "lo", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    both = whole.unionByName(masks).groupBy("_row").agg(F.collect_list(F.struct("lo", "mask")).alias("marks"))
    out = materialise(both)
    drop(settled, masks)
    return out


def strip_bytes(text: bytes | None, marks: list | None, length: int = LENGTH) -> tuple[int, int, int, bytes]:
    """(bytes, bytes removed, maximal removed runs, remaining bytes)."""
    data = text or b""
    if marks is None or not len(marks):
        return len(data), 0, 0, data
    edge = np.zeros(len(data) + 1, np.int64)
    lo = np.array([m["lo"] for m in marks], np.int64)
    mask = np.array([m["mask"] for m in marks], np.int64)
    j = np.arange(63)
    starts = (lo[:, None] + j)[(mask[:, None] >> j) & 1 == 1]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, length: int = LENGTH, into: str | None = None) -> DataFrame:
    """``docs`` with a struct of n_bytes, n_removed, n_spans and kept (binary): each byte goes that a
    string of ``length`` bytes covers which also starts in a document of smaller doc_id.

    Strings are judged on the input and never cross documents.  Null texts count as empty.  Rows without
    doc_id neither lose bytes nor make others lose any; rows of one doc_id don't affect each other.  All
    columns stay as they were; the struct is named ``into``, or ``stripped`` (with underscores before it
    if the table has such a column).  An empty table gives no rows.
    """
    row, into = free_name(docs, "_row"), into or free_name(docs, "stripped")
    rows = numbered(docs, row)
    marks = repeats(rows.select(F.col(row).alias("_row"), "doc_id", "text"), length)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def strip(text: pd.Series, marks: pd.Series) -> pd.DataFrame:
        got = [strip_bytes(t, m, length) for t, m in zip(text, marks, strict=True)]
        return pd.DataFrame(got, columns=["n_bytes", "n_removed", "n_spans", "kept"], index=text.index)

    found = free_name(docs, "_marks")
    joined = rows.join(marks.select(F.col("_row").alias(row), F.col("marks").alias(found)), row, "left")
    return joined.select(*docs.columns, strip(F.col("text").cast("binary"), F.col(found)).alias(into))
