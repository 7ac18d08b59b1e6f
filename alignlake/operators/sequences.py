"""Sequences, words, runs, regions, trees and similarities as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignlake.scratch import materialise, numbered


def letters(sequences: DataFrame) -> DataFrame:
    """``(seq_id, pos, ch)``, one record for each residue."""
    return sequences.select("seq_id", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "ch"))


def composition(sequences: DataFrame) -> DataFrame:
    return letters(sequences).groupBy("ch").agg(F.count("*").alias("n"))


def null_model(sequences: DataFrame, alphabet: str, pseudocount: float = 1.0) -> DataFrame:
    """Composition with pseudocounts over a whole alphabet, normalised."""
    symbols = sequences.sparkSession.createDataFrame([(c,) for c in alphabet], "ch string")
    n = symbols.join(composition(sequences), "ch", "left").na.fill(0).withColumn("n", F.col("n") + pseudocount)
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("ch", F.round(F.col("n") / F.col("total"), 9).alias("p"))  # one row by construction


def length_stats(sequences: DataFrame, pseudocount: float = 0.0) -> DataFrame:
    """Residues, sequences, mean length and the null model's extension probability."""
    n = sequences.agg(F.sum(F.length("seq")).alias("residues"), F.count("*").alias("seqs"), F.round(F.avg(F.length("seq")), 9).alias("mean_length"))
    p = (F.col("residues") + pseudocount) / (F.col("residues") + F.col("seqs") + 2 * pseudocount)
    return n.withColumn("extend", F.round(p, 9))


def alphabet_share(sequences: DataFrame, alphabet: str) -> DataFrame:
    """Share of each sequence's residues that are in the alphabet."""
    inside = F.length("seq") - F.length(F.translate("seq", alphabet, ""))
    return sequences.where(F.length("seq") > 0).select("seq_id", F.round(inside / F.length("seq"), 9).alias("share"))


#: Words that start in one piece of a sequence.
PIECE = 1 << 16


def words(sequences: DataFrame, k: int, piece: int = PIECE) -> DataFrame:
    """Every k-mer with its position, by one pass of an overlapping match.

    Long sequences are cut into pieces that overlap by ``k - 1``, each word starting in one of them, so no row holds all words of a sequence.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.expr(f"(length(seq) - {k}) div {piece}"), F.lit(0)).cast("int"))
    pieces = sequences.where(F.length("seq") >= k).select("seq_id", "seq", F.explode(starts).alias("i"))
    pieces = pieces.select("seq_id", "i", F.substring(F.col("seq"), F.col("i") * piece + 1, F.lit(piece + k - 1)).alias("seq"))
    found = F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?=(.{{{k}}}))"), F.lit(1))).alias("at", "word")
    return pieces.select("seq_id", "i", found).select("seq_id", (F.col("i") * piece + F.col("at")).alias("at"), "word")


def kmer_count(sequences: DataFrame, k: int) -> DataFrame:
    return words(sequences, k).groupBy("word").agg(F.count("*").alias("n"))


def prefix_count(kmers: DataFrame, prefix: str) -> DataFrame:
    return kmers.where(F.col("word").startswith(prefix)).agg(F.lit(prefix).alias("prefix"), F.sum("n").alias("n"))


def frequent_words(sequences: DataFrame, shortest: int, longest: int, least: int, step: int = 8) -> DataFrame:
    """Words of each length that occur ``least`` times or more; only places of frequent words are grown, ``step`` letters at once."""
    seqs = numbered(sequences.select("seq"), "seq_id")
    often = lambda found: materialise(found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    found = level = often(words(seqs, shortest))
    now, k = words(seqs, shortest), shortest
    while k < longest:
        more = min(step, longest - k)
        now = materialise(now.join(level.select("word"), "word", "left_semi"))
        tails = now.join(seqs, "seq_id").withColumn("tail", F.expr(f"substring(seq, at + {k + 1}, {more})")).where("tail != ''")
        grown = F.explode(F.expr("transform(sequence(1, length(tail)), i -> concat(word, substring(tail, 1, i)))"))
        level = often(tails.select(grown.alias("word")))
        found = found.unionByName(level)
        k += more
        level = level.where(F.length("word") == k)
        if level.isEmpty():
            break
        now = tails.where(F.length("tail") == more).select("seq_id", "at", F.concat("word", "tail").alias("word"))
    return found


def reverse_complement(column: str) -> Column:
    return F.reverse(F.translate(column, "acgtuACGTU", "tgcaaTGCAA"))


def bracket_pairs(marks: DataFrame) -> DataFrame:
    """Partner columns of a bracket string's ``(id, col, ch)`` marks: openers meet the next mark of their depth."""
    run = W.partitionBy("id").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("ch") == "<", 1).otherwise(-1)
    depth = F.sum(step).over(run) + F.when(F.col("ch") == "<", 0).otherwise(1)
    level = W.partitionBy("id", "depth").orderBy("col")
    at = marks.withColumn("depth", depth).withColumn("next", F.lead("col").over(level)).withColumn("next_ch", F.lead("ch").over(level))
    return at.where("ch = '<' and next_ch = '>'").select("id", F.col("col").alias("lcol"), F.col("next").alias("rcol"))


def check_brackets(marks: DataFrame) -> DataFrame:
    """Strings whose brackets don't balance: lowest depth and depth at the end."""
    run = W.partitionBy("id").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    at = marks.withColumn("depth", F.sum(F.when(F.col("ch") == "<", 1).otherwise(-1)).over(run))
    ends = at.groupBy("id").agg(F.min("depth").alias("lowest"), F.max(F.struct("col", "depth"))["depth"].alias("final"))
    return ends.where("lowest < 0 or final != 0")


def stems(pairs: DataFrame) -> DataFrame:
    """Maximal stacks of two or more nested neighbouring pairs; along a stack ``lcol + rcol`` stays, so only those pairs are sorted together."""
    order = W.partitionBy("id", "centre").orderBy("lcol")
    runs = pairs.withColumn("centre", F.col("lcol") + F.col("rcol")).withColumn("stem", F.col("lcol") - F.row_number().over(order))
    return runs.groupBy("id", "centre", "stem").agg(F.min("lcol").alias("l0"), F.max("lcol").alias("l1"), F.min("rcol").alias("r0"), F.max("rcol").alias("r1"), F.count("*").alias("n")).where("n > 1").drop("centre", "stem")


def track_to_features(track: DataFrame, least: float) -> DataFrame:
    """Maximal runs of values of at least ``least``: 1-based ends and summed value."""
    order = W.partitionBy("seq_id").orderBy("pos")
    high = track.where(F.col("value") >= least).withColumn("island", F.col("pos") - F.row_number().over(order))
    return high.groupBy("seq_id", "island").agg((F.min("pos") + 1).alias("start"), (F.max("pos") + 1).alias("end"), F.round(F.sum("value"), 6).alias("score")).drop("island")


def ancestors(nodes: DataFrame) -> DataFrame:
    """``nodes(node, parent, branch_len)`` -> every (node, ancestor, hops, distance), by doubling the links' reach.

    Rounds go on until none finds farther pairs, each one's pairs written and read again; a cycle is an error.
    """
    up = nodes.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("hops"), F.col("branch_len").alias("distance"))
    up, reach, links = materialise(up), 1, None
    while True:
        a, b = up.alias("a"), up.alias("b")
        far = a.where(F.col("a.hops") == reach).join(b, F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.hops") + F.col("b.hops")).alias("hops"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        far = materialise(far)
        if far.isEmpty():
            return up
        links = up.count() if links is None else links
        reach *= 2
        if reach > 2 * links:
            raise ValueError("the parents of some nodes form a cycle")
        up = up.unionByName(far)


def branch_lengths(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.sum("branch_len").alias("total"), F.min("branch_len").alias("shortest"), F.max("branch_len").alias("longest"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    return nodes.join(nodes.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")


def child_counts(nodes: DataFrame) -> DataFrame:
    """Nodes that don't have exactly two children, leaves left out."""
    return nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n")).where("n != 2")


def all_pairs(items: DataFrame, key: str, dist: Callable[[str, str], Column]) -> DataFrame:
    """Upper triangle of a distance between the items of a group."""
    a = items.select("grp", F.col(key).alias("i"), F.col("v").alias("x"))
    b = items.select("grp", F.col(key).alias("j"), F.col("v").alias("y"))
    return a.join(b, "grp").where("i < j").select("grp", "i", "j", dist("x", "y").alias("d"))


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """The k nearest of each item, ties to the smaller one."""
    both = distances.select("grp", "i", "j", "d").unionByName(distances.select("grp", F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    order = W.partitionBy("grp", "i").orderBy("d", "j")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def roc_by_category(df: DataFrame, categories: list[str]) -> DataFrame:
    """tp, fn, tn, fp, sensitivity and specificity of ``pred`` against ``actual`` for each category."""
    each = df.where("actual != '.'").withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    a, p = F.col("actual") == F.col("category"), F.col("pred") == F.col("category")
    n = each.groupBy("category").agg(F.count_if(a & p).alias("tp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"))
    ratio = lambda x, y: F.round(F.when(F.expr(f"{x} + {y}") > 0, F.expr(f"{x} / ({x} + {y})")), 9)
    return n.withColumn("sn", ratio("tp", "fn")).withColumn("sp", ratio("tn", "fp"))


def normalise_placements(placements: DataFrame, least: float = 1e-5) -> DataFrame:
    """Each read's scores as shares; reads without a positive finite sum go, shares under ``least`` too."""
    total = placements.groupBy("read").agg(F.sum("score").alias("total")).where("total > 0 and not isnan(total)")
    shares = placements.join(total, "read").select("read", "node", (F.col("score") / F.col("total")).alias("share"))
    return shares.where(F.col("share") >= least).withColumn("share", F.round("share", 12))


def merge_interval_counts(df: DataFrame) -> DataFrame:
    """Both counters of each interval, summed over repeated lines."""
    return df.groupBy("begin", "end").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def lag_similarity(sim: DataFrame) -> DataFrame:
    """Mean similarity of samples ``lag`` apart."""
    return sim.groupBy((F.col("j") - F.col("i")).alias("lag")).agg(F.round(F.avg("s"), 6).alias("mean"), F.count("*").alias("n"))


def mask_positions(features: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Points covered by a feature of their sequence: features go to the stretches of ``width`` they touch, then an equi-join."""
    cells = F.sequence(F.expr(f"cast(floor(start / {width}) as bigint)"), F.expr(f"cast(floor(end / {width}) as bigint)"))
    spread = features.select("seq_id", "start", "end", F.explode(cells).alias("cell"))
    at = points.withColumn("cell", F.expr(f"cast(floor(pos / {width}) as bigint)"))
    return at.join(spread, ["seq_id", "cell"]).where("pos between start and end").select("seq_id", "pos").distinct()
