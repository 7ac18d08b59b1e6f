"""Column windows, runs, rates and trace summaries as DataFrame jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignlake.operators.compare import runs_of
from alignlake.scratch import materialise


def sliding_windows(cells: DataFrame, size: int = 200, step: int | None = None) -> DataFrame:
    """1-based ``(aln_id, window, start, end)``: windows of ``size`` columns, the last one clipped; none starts once an end is reached."""
    step = step or max(1, size // 2)
    n = cells.groupBy("aln_id").agg((F.max("col") + 1).alias("n"))
    last = F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / step).cast("int")
    each = n.select("aln_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return each.select("aln_id", "window", (F.col("window") * step + 1).alias("start"), F.least(F.col("window") * step + size, "n").alias("end"))


def pair_runs(cells: DataFrame, first: int = 0, second: int = 1) -> DataFrame:
    """Runs of match, delete and insert columns between two rows of each alignment, once columns with two gaps are out."""
    row = lambda r, name: cells.where(F.col("row_no") == r).select("aln_id", "col", F.col("is_gap").alias(name))
    both = row(first, "a").join(row(second, "b"), ["aln_id", "col"]).where("not (a and b)")
    kind = F.when(F.col("a"), "insert").when(F.col("b"), "delete").otherwise("match")
    return runs_of(both.withColumn("kind", kind), "kind").select("aln_id", "run", "kind", "start", "n")


def circular(sequences: DataFrame, n: int) -> DataFrame:
    """Sequences with their first ``n - 1`` residues added at the end, so that words run round; shorter ones go."""
    return sequences.where(F.length("seq") >= n).withColumn("seq", F.concat("seq", F.expr(f"substring(seq, 1, {n - 1})")))


def quick_indel_rate(pairs: DataFrame) -> DataFrame:
    """Indel rate from ``(distance, before, after)``: residues lost against distance times residues."""
    return pairs.agg(F.round(F.sum(F.col("before") - F.col("after")) / F.sum(F.col("distance") * F.col("before")), 9).alias("rate"))


def weighted_track(probs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``(pos, state, p)`` -> sum of weight times probability for each position; states without a weight count nothing."""
    w = probs.sparkSession.createDataFrame(list(weights.items()), "state string, weight double")
    return probs.join(F.broadcast(w), "state").groupBy("pos").agg(F.round(F.sum(F.col("weight") * F.col("p")), 6).alias("value"))  # one row a state


def trace_centroid(distances: DataFrame) -> DataFrame:
    """The item of each group with the smallest summed distance to the others, ties to the smaller one, and its mean."""
    ends = distances.select("grp", F.explode(F.array("i", "j")).alias("i"), "d")
    sums = ends.groupBy("grp", "i").agg(F.round(F.sum("d"), 4).alias("total"), F.count("*").alias("n"))
    best = sums.groupBy("grp").agg(F.min(F.struct("total", "i", "n")).alias("m"))
    return best.select("grp", F.col("m.i").alias("i"), F.round(F.col("m.total") / (F.col("m.n") + 1), 6).alias("mean"))


def transition_rates(steps: DataFrame) -> DataFrame:
    """``(chain, at, state)`` -> share of each step (src, dst) among the steps that leave src."""
    order = W.partitionBy("chain").orderBy("at")
    pairs = steps.select(F.col("state").alias("src"), F.lead("state").over(order).alias("dst")).where("dst is not null")
    n = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy("src"))).drop("n")


def expected_rate(init: DataFrame, rates: DataFrame) -> DataFrame:
    """Sum over src != dst of ``init(state, p)`` times ``rates(src, dst, rate)``."""
    moved = rates.where("src != dst").join(init.withColumnRenamed("state", "src"), "src")
    return moved.agg(F.round(F.sum(F.col("p") * F.col("rate")), 9).alias("expected"))


def link_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children ``(key, id, start, end)`` with the id of a parent of their key that contains them, the smallest; else null.

    A parent lies in the smallest bin of its key that holds it, a child asks that bin and all around it: a join on equal
    bins.  So a child meets the parents of one bin for each level above its own, not all parents of its key.
    """
    own = lambda df: df.withColumn("level", F.length(F.regexp_replace(F.bin(F.expr("start ^ end")), "^0+", "")))
    up = own(parents.select("key", F.col("id").alias("parent"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    up = up.select(F.col("key").alias("k"), "parent", F.col("start").alias("p0"), F.col("end").alias("p1"), "level", F.expr("shiftright(start, level)").alias("bin"))
    top = up.agg(F.max("level").alias("top"))
    asks = own(children.select("key", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).crossJoin(F.broadcast(top))  # one row by construction
    levels = F.when(F.col("level") <= F.col("top"), F.sequence("level", "top")).otherwise(F.array().cast("array<int>"))
    asks = asks.select("key", "id", "start", "end", F.explode_outer(levels).alias("at")).withColumn("b", F.expr("shiftright(start, at)"))
    met = asks.join(up, (F.col("key") == F.col("k")) & (F.col("at") == F.col("level")) & (F.col("b") == F.col("bin")) & (F.col("p0") <= F.col("start")) & (F.col("end") <= F.col("p1")), "left")
    return met.groupBy("key", "id").agg(F.min("parent").alias("parent"))


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both databases, alignments keyed anew so that none clash."""
    key = lambda df, mark: df.withColumn("aln_id", F.concat(F.lit(mark), "aln_id"))
    return key(first, "a-").unionByName(key(second, "b-"))


def windowed(columns: DataFrame, windows: DataFrame, size: int, step: int) -> DataFrame:
    """Each column of ``columns(aln_id, col, ...)`` in every window (see ``sliding_windows``) that covers it."""
    first = F.greatest(F.ceil((F.col("col") - (size - 1)) / step), F.lit(0)).cast("int")
    each = columns.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("col") / step).cast("int"))))
    return each.join(windows, ["aln_id", "window"])


def window_filter(reference: DataFrame, windows: DataFrame, size: int, step: int, max_gaps: float = 0.8, min_bits: float = 2.0) -> DataFrame:
    """Windows whose reference row ``(aln_id, col, ch, is_gap)`` isn't too gappy nor too plain.

    Plainness is the entropy of neighbouring residues, case ignored, gaps left out.
    """
    at = windowed(reference, windows, size, step).withColumn("ch", F.lower("ch"))
    gaps = at.groupBy("aln_id", "window", "start", "end").agg((F.count_if("is_gap") / (F.max("end") - F.max("start") + 1)).alias("gaps"))
    order = W.partitionBy("aln_id", "window").orderBy("col")
    two = at.where("not is_gap").withColumn("two", F.concat("ch", F.lead("ch").over(order))).where("two is not null")
    n = two.groupBy("aln_id", "window", "two").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("aln_id", "window"))
    bits = n.withColumn("p", p).groupBy("aln_id", "window").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 9).alias("bits"))
    kept = gaps.join(bits, ["aln_id", "window"], "left").withColumn("bits", F.coalesce("bits", F.lit(0.0)))
    return kept.where((F.col("gaps") <= max_gaps) & (F.col("bits") >= min_bits)).select("aln_id", "window", "start", "end", "bits")


def lift_features(features: DataFrame, windows: DataFrame) -> DataFrame:
    """Window features ``(aln_id, window, id, start, end)`` in the alignment's coordinates under their window, and the windows themselves."""
    to = windows.select("aln_id", "window", (F.col("start") - 1).alias("shift"), F.concat(F.lit("w"), "window").alias("parent"))
    lifted = features.join(to, ["aln_id", "window"]).select("aln_id", F.lit("feature").alias("type"), "id", "parent", (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"))
    top = windows.select("aln_id", F.lit("window").alias("type"), F.concat(F.lit("w"), "window").alias("id"), F.lit(None).cast("string").alias("parent"), "start", "end")
    return lifted.unionByName(top)


def merge_tracks(track: DataFrame, windows: DataFrame, overlap: int) -> DataFrame:
    """``track(aln_id, window, col, value)`` -> one value for each column.

    The first window's value stays unless later ones hold the column farther from their edge than half the
    overlap; then the last of those counts.
    """
    edge = F.least(F.col("col") - (F.col("start") - 1), F.col("end") - 1 - F.col("col"))
    at = track.join(windows, ["aln_id", "window"]).withColumn("far", edge > overlap / 2)
    groups = at.groupBy("aln_id", "col").agg(F.min(F.struct("window", "value")).alias("first"), F.max(F.when(F.col("far"), F.struct("window", "value"))).alias("last"))
    return groups.select("aln_id", "col", F.coalesce("last.value", "first.value").alias("value"))


def null_scores(model: DataFrame, sequences: DataFrame, order: int, symbols: int) -> DataFrame:
    """``(seq_id, n, score)``: summed log2 probability of each residue after the longest context that ``model`` has seen.

    Contexts have at most ``order`` residues; a symbol has probability (n + 1) / (N + symbols) where the
    context was seen N times before some symbol.
    """
    def spots(seqs: DataFrame) -> DataFrame:
        at = seqs.where("seq != ''").select("seq_id", "seq", F.explode(F.expr("sequence(1, length(seq))")).alias("i"))
        return at.select("seq_id", F.expr(f"substring(seq, greatest(i - {order}, 1), least(i - 1, {order}))").alias("past"), F.expr("substring(seq, i, 1)").alias("sym"))

    seen = spots(model).groupBy("past", "sym").agg(F.count("*").alias("n"))
    suffix = F.explode(F.expr("transform(sequence(0, length(past)), k -> right(past, k))"))
    seen = materialise(seen.select(suffix.alias("past"), "sym", "n").groupBy("past", "sym").agg(F.sum("n").alias("n")))
    total = seen.groupBy("past").agg(F.sum("n").alias("total"))
    asked = materialise(spots(sequences).groupBy("seq_id", "past", "sym").agg(F.count("*").alias("times")))
    words = asked.select("past", "sym").distinct().select(F.col("past").alias("whole"), "sym", suffix.alias("past"))
    known = words.join(total, "past").join(seen, ["past", "sym"], "left").withColumn("p", (F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + symbols))
    best = known.groupBy("whole", "sym").agg(F.max(F.struct(F.length("past").alias("k"), "p"))["p"].alias("p")).withColumnRenamed("whole", "past")
    return asked.join(best, ["past", "sym"]).groupBy("seq_id").agg(F.sum("times").alias("n"), F.round(F.sum(F.col("times") * F.log2("p")), 6).alias("score"))


def merge_features(*tables: DataFrame) -> DataFrame:
    """Features of several files one below the other; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def value_centroid(items: DataFrame) -> DataFrame:
    """``items(grp, i, v)`` -> as ``trace_centroid`` for the distance ``|v - v|``: sums come from sorted values, no pair is made."""
    order = W.partitionBy("grp").orderBy("v", "i")
    every = W.partitionBy("grp")
    at = items.withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(every))
    at = at.withColumn("below", F.coalesce(F.sum("v").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("all", F.sum("v").over(every))
    total = F.col("v") * (2 * F.col("r") + 1 - F.col("n")) + F.col("all") - F.col("v") - 2 * F.col("below")
    sums = at.where("n > 1").withColumn("total", F.round(total, 4))
    best = sums.groupBy("grp").agg(F.min(F.struct("total", "i", "n")).alias("m"))
    return best.select("grp", "m.i", F.round(F.col("m.total") / F.col("m.n"), 6).alias("mean"))


def nearest_values(items: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """``items(grp, i, v)`` -> the ``k`` nearest of each item by ``|v - v|``, ties to the smaller one.

    They are among the ``k`` items on either side in the order of values and the first ``k`` of its own value.
    """
    other = F.struct(F.col("i").alias("j"), F.col("v").alias("w"))
    left = W.partitionBy("grp").orderBy("v", F.desc("i")).rowsBetween(-k, -1)
    right = W.partitionBy("grp").orderBy("v", "i").rowsBetween(1, k)
    same = items.withColumn("place", F.row_number().over(W.partitionBy("grp", "v").orderBy("i"))).where(F.col("place") <= k + 1)
    same = same.groupBy("grp", "v").agg(F.collect_list(other).alias("same"))
    near = items.withColumn("left", F.collect_list(other).over(left)).withColumn("right", F.collect_list(other).over(right)).join(same, ["grp", "v"])
    each = near.select("grp", "i", "v", F.explode(F.array_distinct(F.concat("left", "right", "same"))).alias("o")).where("o.j != i")
    each = each.select("grp", "i", F.col("o.j").alias("j"), F.round(F.abs(F.col("v") - F.col("o.w")), digits).alias("d"))
    return each.withColumn("place", F.row_number().over(W.partitionBy("grp", "i").orderBy("d", "j"))).where(F.col("place") <= k)
