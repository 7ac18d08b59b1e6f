"""Collocations by counting quotient filters.

Every word that is frequent enough gets a dense id.  A phrase of two or three ids, packed side by side, is permuted
invertibly (a Feistel network), so that its leading bits are spread evenly whatever words are common.  A counting
quotient filter keeps the permuted numbers in order: the leading bits (quotient) are told by how many entries each
quotient has, the whole rest (remainder) and the counter are stored, so nothing is lost and ids come back by the
inverse.  Each batch of texts gives one sorted filter, cut into shards by its first bits; a shard's filters are merged
one after the other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignlake.llm.common import small_batches
from alignlake.scratch import drop, materialise, numbered

LEAST, LONGEST, TOP = 10, 3, 2000
#: A shorter phrase goes if a longer one that holds it has this share, in hundredths, of its occurrences.
COVERED = 50
#: Bytes of text that make one filter, and entries (repeats of batches included) that a shard is made for.
BATCH_BYTES, SHARD_ENTRIES = 8 << 20, 1 << 21
_BREAK = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: bytes | None) -> list[bytes]:
    """Words of a text, pieces parted by the token ``0xFF`` (a byte that no UTF-8 text has)."""
    return (data or b"").translate(_FOLD).replace(b"\n", b" \xff ").split()


def _round(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """A hash of ``bits`` bits."""
    h = (x + np.uint64(salt)) * _MIX
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h >> np.uint64(64 - bits)


def permute(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A one-to-one map of pairs of ``2 * bits`` and ``bits`` bits."""
    for salt in (1, 3, 5):
        right = right ^ _round(left, salt, bits)
        left = left ^ _round(right, salt + 1, 2 * bits)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``permute``."""
    for salt in (5, 3, 1):
        left = left ^ _round(right, salt + 1, 2 * bits)
        right = right ^ _round(left, salt, bits)
    return left, right


def fold(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order, equal ones summed up; without ``counts`` each is one."""
    if 3 * bits <= 64:  # both halves in one number sort faster
        key = (left << np.uint64(bits)) | right
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        left, right = key[new] >> np.uint64(bits), key[new] & np.uint64((1 << bits) - 1)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        counts = None if counts is None else counts[order]
        new = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))) if len(order) else np.empty(0, np.int64)
        n, left, right = len(order), left[new], right[new]
        key = np.empty(n, np.uint64)
    if counts is None:
        return left, right, np.diff(np.concatenate((new, [len(key)]))).astype(np.int64)
    return left, right, np.add.reduceat(counts, new) if len(new) else counts[:0]


def _narrow(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


_HEAD = struct.Struct("<QBBBB")


def store(left: np.ndarray, right: np.ndarray, counts: np.ndarray, left_bits: int, bits: int) -> bytes:
    """A counting quotient filter of ordered entries whose ``left`` has ``left_bits`` bits and ``right`` ``bits``.

    About one entry falls to a quotient.  Stored: entries of each quotient, remainders (the rest of ``left``, all of
    ``right``), and counters in one byte, those over 254 at the end in full.
    """
    n = len(left)
    q = min(left_bits, max(0, n.bit_length() - 1))
    rest = left_bits - q
    held = np.bincount((left >> np.uint64(rest)).astype(np.int64), minlength=1 << q)
    wide = 1 if not n or held.max() < 256 else 8
    a, b = -(-rest // 8), -(-bits // 8)
    return b"".join((
        _HEAD.pack(n, q, wide, a, b), _narrow(held, wide), _narrow(left & np.uint64((1 << rest) - 1), a), _narrow(right, b),
        np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts > 254].astype("<i8").tobytes(),
    ))


def load(data: bytes, left_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a stored filter, in order."""
    n, q, wide, a, b = _HEAD.unpack_from(data)
    at = _HEAD.size

    def take(size: int) -> bytes:
        nonlocal at
        at += size
        return data[at - size : at]

    held = _wide(take(wide << q), 1 << q, wide).astype(np.int64)
    left = np.repeat(np.arange(1 << q, dtype=np.uint64), held) << np.uint64(left_bits - q)
    left |= _wide(take(a * n), n, a)
    right = _wide(take(b * n), n, b)
    counts = np.frombuffer(take(n), np.uint8).astype(np.int64)
    counts[counts > 254] = np.frombuffer(data[at:], "<i8")
    return left, right, counts


def encoded(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs(lang, text)`` -> ``(batch, lang, words, counts, codes)``: texts of one language by numbers local to a batch.

    ``codes`` are little-endian 32-bit places in ``words``, -1 between pieces.  A batch holds about ``batch_bytes``
    of text (all languages of a task together), or one longer text.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "lang", "words", "counts", "codes"]
        first, done, held, size = (TaskContext.get().partitionId() << 33), 0, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, size
            for lang, (known, codes) in held.items():
                flat = np.concatenate(codes)
                known.pop(_BREAK, None)
                counts = np.bincount(flat[flat > 0] - 1, minlength=len(known))
                row = ([first + done], [lang], [list(known)], [counts.tolist()], [(flat - 1).astype("<i4").tobytes()])
                kinds = (pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=names)
                done += 1
            held.clear()
            size = 0

        for part in parts:
            for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if not text:
                    continue
                known, codes = held.setdefault(lang, ({_BREAK: 0}, []))
                found = tokens(text)
                codes.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
                codes.append(np.zeros(1, np.int32))
                size += len(text)
                if size >= batch_bytes:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "batch long, lang string, words array<binary>, counts array<long>, codes binary")


def dense(df: DataFrame, name: str) -> DataFrame:
    """``df`` with numbers from 1 without holes; only the sizes of its parts are summed up in one place."""
    rows = numbered(df, "_at")
    at = rows.withColumn("_part", F.shiftright("_at", 33))
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.expr("sum(_n) over (order by _part) - _n").alias("_before"))  # a row for each task that wrote
    number = (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name)
    return at.join(F.broadcast(before), "_part").select(*df.columns, number)


def filters(texts: DataFrame, bits: int, shard_bits: int) -> DataFrame:
    """``texts(codes, n_words, ids array<struct<at, id>>)`` -> ``(shard, filter)``; words without an id part phrases."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                codes, ids = np.frombuffer(part.column(0)[i].as_py(), "<i4"), part.column(2)[i].values
                table = np.zeros(part.column(1)[i].as_py() + 1, np.uint64)  # the last place is that of -1
                if ids is not None:
                    table[ids.field(0).to_numpy()] = ids.field(1).to_numpy()
                w = table[codes]
                some = np.flatnonzero((w[:-1] > 0) & (w[1:] > 0))
                left = (w[some] << np.uint64(bits)) | w[some + 1]
                third = np.append(w, np.uint64(0))[some + 2]
                three = third > 0
                left, right = np.concatenate((left, left[three])), np.concatenate((np.zeros(len(some), np.uint64), third[three]))
                left, right, counts = fold(*permute(left, right, bits), None, bits)
                rest = 2 * bits - shard_bits
                shard = (left >> np.uint64(rest)).astype(np.int64)
                cut = np.searchsorted(shard, np.arange((1 << shard_bits) + 1)) if shard_bits < 16 else None
                here = np.unique(shard)
                low, high = (cut[here], cut[here + 1]) if cut is not None else (np.searchsorted(shard, here), np.searchsorted(shard, here, "right"))
                left &= np.uint64((1 << rest) - 1)
                out = [store(left[a:b], right[a:b], counts[a:b], rest, bits) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(out, pa.binary())], names=["shard", "filter"])

    return texts.select("codes", "n_words", "ids").mapInArrow(run, "shard long, filter binary")


def merged(stored: DataFrame, bits: int, shard_bits: int, least: int, hold: int = SHARD_ENTRIES) -> DataFrame:
    """Filters -> ``(w1, w2, w3, a)``: phrases (``w3`` 0 for two words) found ``least`` times or more.

    A task streams the filters of its shards in order and holds the distinct entries of one shard, and at most as
    many that aren't summed up yet.
    """
    rest = 2 * bits - shard_bits
    mask = np.uint64((1 << bits) - 1)

    def give(shard: int, entries: tuple) -> pa.RecordBatch:
        left, right, counts = entries
        much = counts >= least
        left, right = restore(left[much] | np.uint64(shard << rest), right[much], bits)
        cols = (left >> np.uint64(bits), left & mask, right, counts[much])
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["w1", "w2", "w3", "a"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, floor = None, [], 0, hold

        def settle() -> tuple:
            return fold(*(np.concatenate(c) for c in zip(*held, strict=True)), bits)

        for part in parts:
            for shard, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if shard != now:
                    if held:
                        yield give(now, settle())
                    now, held, size, floor = shard, [], 0, hold
                entries = load(data, rest)
                held.append(entries)
                size += len(entries[0])
                if size > 2 * floor:
                    held = [settle()]
                    size = len(held[0][0])
                    floor = max(hold, size)
        if held:
            yield give(now, settle())

    return stored.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "w1 long, w2 long, w3 long, a long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, batch_bytes: int = BATCH_BYTES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``docs(lang, text)`` -> ``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two or three words.

    A-Z are lower-cased; pieces are parted by ``[.,;:!?\\x0A-\\x0D]`` and words inside them by blanks and tabs.  ``a``
    counts a phrase (``least`` or more), ``l`` and ``r`` its parts at the cut of lowest ``score = floor(1000000 a a / (l r))``
    (the first such cut), ``n`` all words of the language.  A phrase goes if one that is longer and holds it has half of its
    occurrences.  Order: score, then ``a``, both falling, then phrase by bytes.  Null texts are empty, null languages ``und``;
    repeated rows count each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    batches = materialise(encoded(docs, batch_bytes))
    each = batches.select("batch", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "word"))
    each = each.select("batch", "lang", "at", F.col("word.words").alias("word"), F.col("word.counts").alias("n"))
    words = materialise(each.groupBy("lang", "word").agg(F.sum("n").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    vocab = materialise(dense(words.where(F.col("f") >= least), "id"))
    size, known = vocab.count(), words.agg(F.sum("f")).first()[0] or 0
    bits = max(2, size.bit_length())
    if bits > 32:
        raise ValueError("more than 2 ** 32 frequent words")
    shard_bits = min(2 * bits - 1, max(0, (2 * known // shard_entries).bit_length()))
    ids = each.join(vocab.select("lang", "word", "id"), ["lang", "word"]).groupBy("batch").agg(F.collect_list(F.struct(F.col("at"), F.col("id"))).alias("ids"))
    texts = batches.select("batch", "codes", F.size("words").alias("n_words")).join(ids, "batch")
    grams = materialise(merged(filters(texts, bits, shard_bits), bits, shard_bits, least, shard_entries))
    drop(batches)

    f = vocab.select("id", "f")
    pairs = grams.where("w3 = 0").select("w1", "w2", "a")
    two = pairs.join(f.select(F.col("id").alias("w1"), F.col("f").alias("l")), "w1").join(f.select(F.col("id").alias("w2"), F.col("f").alias("r")), "w2")
    triples = grams.where("w3 > 0")
    one = triples.join(f.select(F.col("id").alias("w1"), F.col("f").alias("l1")), "w1").join(f.select(F.col("id").alias("w3"), F.col("f").alias("r2")), "w3")
    three = one.join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1")), ["w2", "w3"]).join(pairs.select("w1", "w2", F.col("a").alias("l2")), ["w1", "w2"])
    score = lambda l, r: F.expr(f"1000000 * cast(a as decimal(16,0)) * cast(a as decimal(16,0)) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")  # noqa: E731, E741
    three = three.withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2")).withColumn("first", F.col("s1") <= F.col("s2"))
    pick = lambda x, y: F.when(F.col("first"), F.col(x)).otherwise(F.col(y))
    three = three.select("w1", "w2", "w3", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))
    inside = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    inside = inside.groupBy("w1", "w2").agg(F.max("a").alias("most"))
    two = two.join(inside, ["w1", "w2"], "left").where(f"coalesce(100 * most < {COVERED} * a, true)").select("w1", "w2", F.lit(0).cast("long").alias("w3"), "a", "l", "r", score("l", "r").alias("score"))
    best = two.unionByName(three)
    text = vocab.select("id", "lang", F.col("word").cast("string").alias("word"))
    named = best.join(text.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1")), "w1").join(text.select(F.col("id").alias("w2"), F.col("word").alias("t2")), "w2")
    named = named.join(text.select(F.col("id").alias("w3"), F.col("word").alias("t3")), "w3", "left").withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    ranked = named.withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)").cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
