"""Frames: labels from intervals, expansion, overlap projection, and rows weighted by frames instead of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import intervals as I
from .intervals import merged  # noqa: F401  part of this module's interface
from .quality import looked_up


def expanded(clips: DataFrame, index: DataFrame, interval: int = 16, strict: bool = False) -> DataFrame:
    """video_id, frame (from 0), score: the k-th clip's score on frames [interval k, interval (k + 1)), cropped to the video, 0 beyond the last clip.
    index: video_id, start_frame, end_frame (inclusive). A video without any clip is 0 throughout, or an error if strict."""
    if strict:
        index = looked_up(index, clips.select("video_id").distinct(), ["video_id"], what="the scores")
    frames = index.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("end_frame") - F.col("start_frame"))).alias("frame"))
    frames = frames.withColumn("clip_idx", F.floor(F.col("frame") / interval).cast("int"))
    return frames.join(clips.select("video_id", "clip_idx", "score"), ["video_id", "clip_idx"], "left").select("video_id", "frame", F.coalesce("score", F.lit(0.0)).alias("score"))


def labelled(frames: DataFrame, index: DataFrame, intervals: DataFrame, policy: str = "first", default: int = 0) -> DataFrame:
    """frames with label: that of the first (or last) interval that covers the absolute frame, both ends included, else default; see intervals.labelled.
    intervals: video_id, ordinal, start, stop, label."""
    at = frames.join(index.select("video_id", "start_frame"), "video_id").withColumn("__at", F.col("frame") + F.col("start_frame")).drop("start_frame")
    return I.labelled(at, "__at", intervals, policy).select(*frames.columns, F.coalesce("label", F.lit(default)).alias("label"))


def weighted_rows(clips: DataFrame, index: DataFrame, intervals: DataFrame, interval: int = 16) -> DataFrame:
    """video_id, clip_idx, score, pos, neg: a clip's frames inside and outside of the union of intervals, and one row of score 0 (clip_idx -1) for the
    frames beyond the last clip. As good as frames for any metric over them, in a sixteenth of the rows. Arrays of scores pass as well: the row beyond then has a null."""
    n = F.col("end_frame") - F.col("start_frame") + 1
    rows = clips.join(index, "video_id").select("video_id", "clip_idx", "score", "start_frame", n.alias("n"))
    rows = rows.withColumn("last", F.max("clip_idx").over(Window.partitionBy("video_id")))
    at = lambda k: (F.col("start_frame") + F.least(F.col(k) * interval, "n")).cast("bigint")
    end = lambda k: (F.col("start_frame") + F.least((F.col(k) + 1) * interval, "n")).cast("bigint")
    own = F.struct("clip_idx", "score", at("clip_idx").alias("a"), end("clip_idx").alias("z"))
    rest = F.struct(F.lit(-1).cast(clips.schema["clip_idx"].dataType).alias("clip_idx"), _zero(clips).alias("score"), end("last").alias("a"), (F.col("start_frame") + F.col("n")).cast("bigint").alias("z"))
    blocks = rows.select("video_id", F.inline(F.when(F.col("clip_idx") == F.col("last"), F.array(own, rest)).otherwise(F.array(own))))
    return I.covered(blocks, intervals).select("video_id", "clip_idx", "score", F.col("inside").alias("pos"), (F.col("n") - F.col("inside")).alias("neg"))


def overlap_projection(clips: DataFrame, seconds: float = 10.0) -> DataFrame:
    """video_id, frame, mean, max, top3: of the scores of the windows that cover the frame; a frame that none covers takes the score of the nearest
    center, the first of equals. clips: video_id, center_frame, score, fps, frame_count.

    A window reaches h frames to either side, and a video is cut into cells of h + 1. A frame's windows are those of its own cell, of the end of the cell before and of
    the start of the cell after: three states that merge (count, sum, three largest), made once a cell from either side. Frames with the same windows are one piece;
    frames are made from finished pieces."""
    h = F.floor(F.lit(float(seconds)) * F.col("fps") / 2.0 + 1e-9).cast("bigint")
    rows = clips.select("video_id", F.col("center_frame").alias("c"), "score", h.alias("h"), "frame_count").withColumn("cell", F.floor(F.col("c") / (F.col("h") + 1)))
    cells = rows.groupBy("video_id", "cell", "h").agg(F.array_sort(F.collect_list(F.struct("c", "score"))).alias("x"))
    top = lambda a: F.slice(F.reverse(F.array_sort(a)), 1, 3)
    state = lambda a: F.struct(F.size(a).alias("n"), _total(F.transform(a, lambda x: x["score"])).alias("s"), top(F.transform(a, lambda x: x["score"])).alias("top"))
    until = F.transform("x", lambda x, k: F.struct(x["c"].alias("c"), state(F.slice("x", F.lit(1), k + 1)).alias("v")))
    since = F.transform("x", lambda x, k: F.struct(x["c"].alias("c"), state(F.slice("x", k + 1, F.size("x"))).alias("v")))
    made = cells.select("video_id", "cell", until.alias("until"), since.alias("since"), state(F.col("x")).alias("whole"))
    sent = made.select("video_id", (F.col("cell") + 1).alias("cell"), F.col("since").alias("left")).unionByName(made.select("video_id", (F.col("cell") - 1).alias("cell"), F.col("until").alias("right")), allowMissingColumns=True)
    sent = sent.unionByName(made.select("video_id", "cell", F.col("whole").alias("own")), allowMissingColumns=True)
    every = clips.select("video_id", "frame_count", h.alias("h")).groupBy("video_id").agg(F.max("frame_count").alias("n"), F.max("h").alias("h")).where("n > 0")
    every = every.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / (F.col("h") + 1)))).alias("cell"), "n", "h")
    both = every.unionByName(sent, allowMissingColumns=True).groupBy("video_id", "cell").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "h", "left", "right", "own")]).where("n is not null")
    first, stop = F.col("cell") * (F.col("h") + 1), F.least((F.col("cell") + 1) * (F.col("h") + 1), "n")
    both = both.select("video_id", "h", "own", *[F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("left", "right")], first.alias("a"), stop.alias("z"))
    changes = F.concat(F.array("a"), F.transform("left", lambda x: x["c"] + F.col("h") + 1), F.transform("right", lambda x: x["c"] - F.col("h")))
    both = both.withColumn("at", F.array_sort(F.array_distinct(F.filter(changes, lambda t: t < F.col("z")))))

    def piece(t: Column, k: Column) -> Column:
        left, right = F.filter("left", lambda x: x["c"] >= t - F.col("h")), F.filter("right", lambda x: x["c"] <= t + F.col("h"))
        parts = F.array_compact(F.array(F.get(left, F.lit(0))["v"], F.col("own"), F.get(right, F.size(right) - 1)["v"]))
        return F.struct(t.alias("a"), (F.coalesce(F.get("at", k + 1), F.col("z")) - 1).alias("z"), parts.alias("parts"))

    cut = both.select("video_id", F.explode(F.transform("at", piece)).alias("p")).select("video_id", "p.*")
    tops = top(F.flatten(F.transform("parts", lambda x: x["top"])))
    cut = cut.select("video_id", "a", "z", F.aggregate("parts", F.lit(0), lambda s, x: s + x["n"]).alias("n"), _total(F.transform("parts", lambda x: x["s"])).alias("s"), tops.alias("top"))
    values = cut.select("video_id", F.sequence("a", "z").alias("frames"), "n", (F.col("s") / F.col("n")).alias("mean"), F.get("top", F.lit(0)).alias("max"), (_total(F.col("top")) / F.size("top")).alias("top3"))
    got = values.where("n > 0").select("video_id", F.explode("frames").alias("frame"), "mean", "max", "top3")
    near = nearest_center(values.where("n = 0").select("video_id", F.explode("frames").alias("frame")), clips)
    return got.unionByName(near.select("video_id", "frame", *[F.col("score").alias(c) for c in ("mean", "max", "top3")]))


def _zero(clips: DataFrame) -> Column:
    return F.lit(None).cast(clips.schema["score"].dataType) if isinstance(clips.schema["score"].dataType, T.ArrayType) else F.lit(0.0)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def nearest_center(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """video_id, frame, score of the nearest center, the smaller of equals: one window over frames and centers together, no range join."""
    sample = F.struct(F.col("center_frame").alias("x"), F.col("score").alias("y"))
    rows = clips.select("video_id", F.col("center_frame").alias("frame"), sample.alias("s"), F.lit(0).alias("asked"))
    rows = rows.unionByName(frames.select("video_id", "frame", F.lit(None).cast("struct<x:bigint,y:double>").alias("s"), F.lit(1).alias("asked")))
    part = Window.partitionBy("video_id")
    back = part.orderBy("frame", "asked").rowsBetween(Window.unboundedPreceding, 0)
    ahead = part.orderBy(F.desc("frame"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("l", F.last("s", ignorenulls=True).over(back)).withColumn("r", F.last("s", ignorenulls=True).over(ahead)).where("asked = 1")
    left = F.col("r").isNull() | (F.col("l").isNotNull() & (F.col("frame") - F.col("l.x") <= F.col("r.x") - F.col("frame")))
    return rows.select("video_id", "frame", F.when(left, F.col("l.y")).otherwise(F.col("r.y")).alias("score"))


def block_majority(index: DataFrame, intervals: DataFrame, clips: DataFrame, interval: int = 16) -> DataFrame:
    """video_id, clip_idx, positive: whether at least half of the clip's frames lie in intervals."""
    w = weighted_rows(clips, index, intervals, interval).where("clip_idx >= 0")
    return w.select("video_id", "clip_idx", (F.col("pos") >= F.col("neg")).alias("positive"))
