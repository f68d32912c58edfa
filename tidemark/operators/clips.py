"""Clips: sliding windows, sampling targets, selection and splitting of work."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranges import numbered, running


def clip_windows(videos: DataFrame, interval: int = 16, seconds: float = 10.0) -> DataFrame:
    """video_id, clip_idx, center_frame, start_time, end_time: centers 0, interval, ... below frame_count; windows clamped to the video.
    videos: video_id, fps, frame_count."""
    rows = videos.where("frame_count > 0 and fps > 0").select("video_id", "fps", "frame_count", F.posexplode(F.expr(f"sequence(0L, frame_count - 1, {interval}L)")).alias("clip_idx", "center_frame"))
    t, end = F.col("center_frame") / F.col("fps"), F.col("frame_count") / F.col("fps")
    return rows.select("video_id", "clip_idx", "center_frame", F.greatest(F.lit(0.0), t - seconds / 2).alias("start_time"), F.least(end, t + seconds / 2).alias("end_time"))


def shifted_interval(start: Column, end: Column, center: Column, seconds: float) -> tuple[Column, Column]:
    """A span of `seconds` around center, shifted into [start, end]; the whole window if that is shorter."""
    first = F.least(F.greatest(center - seconds / 2, start), end - seconds)
    whole = (end - start) <= seconds
    return F.when(whole, start).otherwise(first), F.when(whole, end).otherwise(first + seconds)


def uniform_targets(start: Column, end: Column, n: int) -> Column:
    """n points from start to end, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: start + (end - start) * k / max(n - 1, 1))


def whole_targets(start: Column, end: Column, n: int) -> Column:
    """n whole numbers from start to end, both included, evenly spread and cut down."""
    return F.transform(uniform_targets(start, end, n), lambda x: F.floor(x))


def temporal_bins(frames: DataFrame, bins: int = 5, edge: float = 1e-9) -> DataFrame:
    """video_id, bin, n, t: of equal bins between a video's first and last frame time, how many frames lie in it and the time of the one nearest to its middle (the earlier of equals). The last
    bin holds its right edge; a bin without frames takes the nearest frame of all. frames: video_id, t. One aggregate by video: no join of frames with bins."""
    ends = frames.groupBy("video_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    width = (F.col("t1") - F.col("t0")) / bins
    rows = frames.join(ends, "video_id").withColumn("__bin", F.when(width <= 0, 0).otherwise(F.least(F.floor((F.col("t") - F.col("t0")) / width + edge), F.lit(bins - 1))))
    away = lambda k: F.abs(F.col("t") - (F.col("t0") + width * (k + 0.5)))
    pick = lambda k: F.min(F.struct((F.col("__bin") != k).alias("out"), F.round(away(k), 9).alias("away"), F.col("t").alias("t")))
    got = rows.groupBy("video_id").agg(*[F.count_if(F.col("__bin") == k).alias(f"n{k}") for k in range(bins)], *[pick(k).alias(f"p{k}") for k in range(bins)])
    each = F.array(*[F.struct(F.lit(k).alias("bin"), F.col(f"n{k}").alias("n"), F.col(f"p{k}.t").alias("t")) for k in range(bins)])
    return got.select("video_id", F.inline(each))


def percentile_band(scores: DataFrame, low: float, high: float) -> DataFrame:
    """Rows of each video whose rank by (score, center) is in [floor(low n), max(ceil(high n), first + 1)), with rank and percentile.

    low and high count as the decimal numbers they are written as: as doubles (so in the reference), 0.55 times 100 is over 55 and its ceiling 56."""
    low, high = F.lit(Decimal(str(low))), F.lit(Decimal(str(high)))
    by = Window.partitionBy("video_id")
    rows = scores.withColumn("rank", F.row_number().over(by.orderBy("score", "center_frame")) - 1).withColumn("n", F.count("*").over(by))
    first = F.floor(low * F.col("n"))
    kept = rows.where((F.col("rank") >= first) & (F.col("rank") < F.greatest(F.ceil(high * F.col("n")), first + 1)))
    return kept.withColumn("percentile", F.col("rank") / F.greatest(F.col("n") - 1, F.lit(1))).drop("n")


def top_budget(rows: DataFrame, budgets: list[float], value: str, label: str, order: str) -> DataFrame:
    """For each budget b, of the max(1, ceil(n b)) rows of largest value (ties by order): how many carry the label, recall, error rate, enrichment.

    The cut is found from exact counts by value, and only rows that tie with it are ranked, by bands of their order, so no task orders all rows or all ties."""
    by_value = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"), F.sum(label).alias("hits"))
    run = running(by_value, [], "v", {"n": "n", "hits": "hits"})
    sizes = rows.agg(F.count("*").alias("total"), F.sum(label).alias("total_fn"))
    b = rows.sparkSession.createDataFrame([(float(x),) for x in budgets], "budget double").crossJoin(F.broadcast(sizes))
    b = b.withColumn("audited", F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("budget"))))
    # the value at which the budget ends: whole values above it, and part of its ties
    cut = run.join(F.broadcast(b), F.expr("run_n - n < audited and run_n >= audited"))
    cut = cut.select("budget", "total", "total_fn", "audited", F.col("v").alias("cut"), F.expr("audited - (run_n - n)").alias("part"), F.expr("run_hits - hits").alias("above"))
    tied = rows.select(F.col(value).alias("v"), F.col(label).alias("hit"), F.col(order).alias("o")).join(F.broadcast(cut), F.col("v") == F.col("cut"))
    # ties are many where few values are: they are numbered by bands of the order as well
    inside = numbered(tied, ["o"], "k", ["budget"]).where("k < part").groupBy("budget", "total", "total_fn", "audited", "above").agg(F.sum("hit").alias("hit"))
    covered = F.col("above") + F.col("hit")
    rate, prevalence = covered / F.col("audited"), F.col("total_fn") / F.col("total")
    return inside.select(
        "budget", (F.col("audited") / F.col("total")).alias("audit_fraction"), F.col("audited").alias("audited_clips"), covered.alias("covered_fn_clips"), F.col("total_fn").alias("total_fn_clips"),
        F.try_divide(covered, F.col("total_fn")).alias("fn_recall"), rate.alias("audit_clip_error_rate"), F.try_divide(rate, prevalence).alias("error_enrichment"),
    )


def extreme_intervals(scores: DataFrame) -> DataFrame:
    """For each video the window [s, s + max(last div 10, 300)) of highest and of lowest mean score, the first of equals; s is a scored frame.

    A window is a difference of prefix sums at two ranks: the far one is found by an as-of step over the union of starts and ends, so a
    video costs a sort, not a self-join."""
    by = Window.partitionBy("video_id")
    w = F.greatest(F.floor(F.max("center_frame").over(by) / 10), F.lit(300))
    rows = scores.select("video_id", "center_frame", "score", w.cast("bigint").alias("w"))
    starts = rows.select("video_id", F.col("center_frame").alias("at"), F.lit(1).alias("kind"), "center_frame", "score", "w")
    ends = rows.select("video_id", (F.col("center_frame") + F.col("w")).alias("at"), F.lit(0).alias("kind"), "center_frame", F.lit(None).cast("double").alias("score"), "w")
    # at equal places the window's end (exclusive) comes before the score
    order = by.orderBy("at", "kind", "center_frame").rowsBetween(Window.unboundedPreceding, 0)
    run = starts.unionByName(ends).withColumn("s", F.coalesce(F.sum("score").over(order), F.lit(0.0))).withColumn("n", F.count("score").over(order))
    both = run.groupBy("video_id", "center_frame").agg(
        F.max("w").alias("w"), F.max(F.when(F.col("kind") == 1, F.col("s") - F.col("score"))).alias("s0"), F.max(F.when(F.col("kind") == 1, F.col("n") - 1)).alias("n0"),
        F.max(F.when(F.col("kind") == 0, F.col("s"))).alias("s1"), F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("n1"),
    )
    avg = both.withColumn("avg", F.round((F.col("s1") - F.col("s0")) / (F.col("n1") - F.col("n0")), 9))
    best = F.max(F.struct("avg", (-F.col("center_frame")).alias("k"), "w"))
    worst = F.min(F.struct("avg", F.col("center_frame").alias("k"), "w"))
    out = avg.groupBy("video_id").agg(best.alias("b"), worst.alias("l"))
    return out.select(
        "video_id", (-F.col("b.k")).alias("highest_start"), (F.col("b.w") - F.col("b.k")).alias("highest_end"), F.col("b.avg").alias("highest_avg"),
        F.col("l.k").alias("lowest_start"), (F.col("l.k") + F.col("l.w")).alias("lowest_end"), F.col("l.avg").alias("lowest_avg"),
    )


def job_stride(items: DataFrame, jobs: int, order: list[str]) -> DataFrame:
    """Item k of the ordered list goes to job k mod jobs."""
    return numbered(items, order).withColumn("job", (F.col("position") % jobs).cast("int"))


def job_contiguous(items: DataFrame, jobs: int, order: list[str]) -> DataFrame:
    """Contiguous runs, the first ones one longer where the count does not divide."""
    rows = numbered(items, order).crossJoin(F.broadcast(items.agg(F.count("*").alias("__n"))))
    q, r, k = F.floor(F.col("__n") / jobs), F.col("__n") % jobs, F.col("position")
    job = F.when(k < r * (q + 1), F.floor(k / (q + 1))).otherwise(r + F.floor((k - r * (q + 1)) / F.greatest(q, F.lit(1))))
    return rows.withColumn("job", job.cast("int")).drop("__n")
