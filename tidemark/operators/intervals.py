"""Intervals in time without a range join.

Labels. An interval is at most two dyadic nodes a level: spans [k 2^l, (k + 1) 2^l) that it covers whole. What covers a point is what stands on one of the point's own nodes, one a level, so
the first interval over a point, or the last, is an equi-join and an aggregate, however many intervals a video has and however they overlap. Only points where
intervals start or stop are asked (and the borders of BUCKET frames); what lies between two of them has the answer of the one before. Frames and blocks meet these
points in one ordered pass over each bucket of a video, which needs nothing from the bucket before it, as its border is a point itself.

Covers and unions need no labels: they sum up how many intervals open and close, by bucket, with what is open carried to the borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Frames of a video that one task orders.
BUCKET = 1 << 16


def _shift(c: Column, by: Column) -> Column:
    return F.call_function("shiftright", c, by)


def dyadic(start: Column, stop: Column) -> Column:
    """The dyadic nodes (level, at) that make up [start, stop): an array of structs."""
    levels = F.sequence(F.lit(0), F.floor(F.log2((stop - start).cast("double"))).cast("int"))
    one = F.lit(1).cast("bigint")

    def at(level: Column) -> Column:
        a = _shift(start + F.call_function("shiftleft", one, level) - 1, level)
        z = _shift(stop, level)
        odd = a.bitwiseAND(one)
        left, right = F.when((odd == 1) & (a < z), a), F.when((z.bitwiseAND(one) == 1) & (a + odd < z), z - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda k: F.struct(level.alias("level"), k.alias("at")))

    return F.flatten(F.transform(levels, at))


def pieces(intervals: DataFrame, policy: str = "first") -> DataFrame:
    """video_id, t, label: of the interval with the smallest (or largest) ordinal that holds from t on until the video's next t, or null; from its first interval to after its last, a t at
    each border of BUCKET frames among them. intervals: video_id, ordinal, start, stop (included), label."""
    pick = F.min if policy == "first" else F.max
    size = F.col("stop") - F.col("start") + 1
    good = intervals.where("stop >= start").select("video_id", "ordinal", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), "label")
    nodes = good.select("video_id", F.struct("ordinal", "label").alias("v"), F.explode(dyadic(F.col("start"), F.col("stop") + 1)).alias("node"))
    nodes = nodes.groupBy("video_id", "node.level", "node.at").agg(pick("v").alias("v"))
    # a point is asked on every level that an interval of its video may have a node on
    per = Window.partitionBy("video_id")
    wide = good.withColumn("top", F.floor(F.log2(F.max(size).over(per).cast("double"))).cast("int"))
    ends = wide.select("video_id", "top", F.explode(F.array(F.col("start"), F.col("stop") + 1)).alias("t"))
    span = good.groupBy("video_id").agg(F.floor(F.min("start") / BUCKET).alias("a"), F.floor(F.max("stop") / BUCKET).alias("z"), F.floor(F.log2(F.max(size).cast("double"))).cast("int").alias("top")).where("z > a")
    borders = span.select("video_id", "top", F.explode(F.sequence(F.col("a") + 1, F.col("z"))).alias("k")).select("video_id", "top", (F.col("k") * BUCKET).alias("t"))
    asked = ends.unionByName(borders).select("video_id", "t", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))
    asked = asked.withColumn("at", _shift(F.col("t"), F.col("level")))
    best = asked.join(nodes, ["video_id", "level", "at"], "left").groupBy("video_id", "t").agg(pick("v").alias("v"))
    return best.select("video_id", "t", F.col("v.label").alias("label"))


def depths(intervals: DataFrame) -> DataFrame:
    """video_id, t, change: by how much the number of intervals over a frame changes at t. What is open at a border of BUCKET frames is carried there as a change of its own, so the sum within
    a bucket is the number that is open, and no bucket needs another. intervals: video_id, start, stop (included)."""
    good = intervals.where("stop >= start")
    ends = F.array(F.struct(F.col("start").cast("bigint").alias("t"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).cast("bigint").alias("t"), F.lit(-1).alias("d")))
    changes = good.select("video_id", F.inline(ends)).groupBy("video_id", "t").agg(F.sum("d").alias("change"))
    whole = changes.groupBy("video_id", bucket("t").alias("k")).agg(F.sum("change").alias("n"))
    order = Window.partitionBy("video_id").orderBy("k")
    after = whole.select("video_id", "k", F.sum("n").over(order).alias("change"), F.lead("k").over(order).alias("next")).where("change <> 0")
    carried = after.select("video_id", "change", F.explode(F.sequence(F.col("k") + 1, "next")).alias("k")).select("video_id", (F.col("k") * BUCKET).alias("t"), "change")
    return changes.unionByName(carried)


def bucket(t: Column | str) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / BUCKET)


def labelled(points: DataFrame, t: str, intervals: DataFrame, policy: str = "first") -> DataFrame:
    """points with label: that of the first (or last) interval over t, or null. One ordered pass over each bucket of a video."""
    own = F.struct(*[F.col(c) for c in points.columns])
    asked = points.select("video_id", F.col(t).cast("bigint").alias("t"), F.lit(1).alias("kind"), own.alias("own"))
    held = pieces(intervals, policy).select("video_id", "t", F.lit(0).alias("kind"), F.struct("label").alias("now"))
    order = Window.partitionBy("video_id", bucket("t")).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(held, allowMissingColumns=True).withColumn("now", F.last("now", ignorenulls=True).over(order))
    return both.where("kind = 1").select("own.*", F.col("now.label").alias("label"))


def covered(blocks: DataFrame, intervals: DataFrame) -> DataFrame:
    """blocks with n and inside: how many frames [a, z) they have, and how many of them lie in intervals. blocks: video_id, a, z and others that name a block; those of a video do not overlap.

    Blocks are cut at bucket borders, and what is between two neighbouring points of a bucket belongs to one block and is covered or not."""
    others = [c for c in blocks.columns if c not in ("video_id", "a", "z")]
    cut = blocks.where("a < z").withColumn("k", F.explode(F.sequence(bucket("a"), bucket(F.col("z") - 1))))
    a, z = F.greatest("a", F.col("k") * BUCKET), F.least("z", (F.col("k") + 1) * BUCKET)
    starts = cut.select("video_id", a.alias("t"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("change"), F.struct(z.alias("z"), F.struct(*others).alias("own")).alias("block"))
    states = depths(intervals).select("video_id", "t", F.lit(0).alias("kind"), "change")
    order = Window.partitionBy("video_id", bucket("t")).orderBy("t", "kind")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    both = starts.unionByName(states, allowMissingColumns=True).select(
        "video_id", "t", F.last("block", ignorenulls=True).over(before).alias("block"), F.sum("change").over(before).alias("open"), F.lead("t").over(order).alias("next"))
    n = F.greatest(F.least(F.col("next"), F.col("block.z")) - F.col("t"), F.lit(0))
    spans = both.where("block is not null").select("video_id", "block.own", n.alias("n"), F.when(F.col("open") > 0, n).otherwise(0).alias("inside"))
    return spans.groupBy("video_id", "own").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).select("video_id", "own.*", "n", "inside")


def merged(intervals: DataFrame) -> DataFrame:
    """video_id, start, stop: the union of a video's intervals as disjoint ones; touching ones are joined. A part opens where the number of open intervals leaves 0 and closes where
    it is 0 again; the k-th opening belongs to the k-th closing, counted by buckets. (What is carried over a border opens there once more, and what it closes there is cancelled.)"""
    order = Window.partitionBy("video_id", bucket("t")).orderBy("t")
    changes = depths(intervals).groupBy("video_id", "t").agg(F.sum("change").alias("change"))
    now = F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = changes.select("video_id", "t", now.alias("open"), (now - F.col("change")).alias("was"))
    edges = rows.where("(open > 0) <> (was > 0)").select("video_id", "t", F.when(F.col("open") > 0, 1).otherwise(-1).alias("edge"))
    # a part that is open at the end of a bucket is closed at the border, and opens there again in the next: the two are dropped together
    last = rows.groupBy("video_id", bucket("t").alias("k")).agg(F.max_by("open", "t").alias("open")).where("open > 0").select("video_id", ((F.col("k") + 1) * BUCKET).alias("t"), F.lit(-1).alias("edge"))
    edges = edges.unionByName(last).groupBy("video_id", "t").agg(F.sum("edge").alias("edge")).where("edge <> 0").withColumn("k", bucket("t"))
    counts = edges.groupBy("video_id", "edge", "k").agg(F.count("*").alias("n"))
    counts = counts.select("video_id", "edge", "k", (F.sum("n").over(Window.partitionBy("video_id", "edge").orderBy("k")) - F.col("n")).alias("before"))
    numbered = edges.join(counts, ["video_id", "edge", "k"]).select("video_id", "t", "edge", (F.col("before") + F.row_number().over(Window.partitionBy("video_id", "edge", "k").orderBy("t"))).alias("part"))
    ends = numbered.groupBy("video_id", "part").agg(F.max(F.when(F.col("edge") > 0, F.col("t"))).alias("start"), (F.max(F.when(F.col("edge") < 0, F.col("t"))) - 1).alias("stop"))
    return ends.drop("part")
