"""Smoothing and interpolation along a video's clips."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(-radius, radius + 1)]
    return [(o, w / sum(raw)) for o, w in zip(range(-radius, radius + 1), raw, strict=True)]


def gaussian(clips: DataFrame, sigma: float = 10.0, value: str = "score", by: list[str] = ("video_id",)) -> DataFrame:
    """clips with value smoothed over clip_idx (0.. without gaps), ends reflected; sigma 0 leaves it. One shuffle by video and no join; see gaussians."""
    return clips if sigma <= 0 else gaussians(clips, [sigma], value, by).withColumn(value, F.get("smoothed", F.lit(0))).drop("smoothed")


def gaussians(clips: DataFrame, sigmas: list[float], value: str = "score", by: list[str] = ("video_id",), name: str = "smoothed") -> DataFrame:
    """clips with an array of value smoothed by every sigma, in one ordered pass: each clip gathers the values of the widest kernel's reach once, and narrower kernels use the middle of
    them. Ends are reflected from what was gathered; a video shorter than the reach reflects more than once."""
    kernels = [gaussian_kernel(s) if s > 0 else [(0, 1.0)] for s in sigmas]
    reach = max(k[-1][0] for k in kernels)
    part = Window.partitionBy(*by)
    near = part.orderBy("clip_idx").rowsBetween(-reach, reach)
    rows = clips.withColumn("__n", F.count("*").over(part)).withColumn("__v", F.collect_list(value).over(near))
    # how many neighbours are missing on either side; a mirror image of what is there stands in
    left, right = F.greatest(reach - F.col("clip_idx"), F.lit(0)).cast("int"), F.greatest(F.col("clip_idx") + reach + 1 - F.col("__n"), F.lit(0)).cast("int")
    mirrored = F.concat(F.reverse(F.slice("__v", F.lit(1), left)), "__v", F.reverse(F.slice("__v", F.size("__v") - right + 1, right)))
    # a video that is shorter than what is missing is mirrored again and again: the o-th neighbour's index in it, minus the index of the first value gathered
    at = lambda o: F.pmod(F.col("clip_idx") + o, 2 * F.col("__n"))
    source = lambda o: F.when(at(o) < F.col("__n"), at(o)).otherwise(2 * F.col("__n") - 1 - at(o))
    first = F.greatest(F.col("clip_idx") - reach, F.lit(0))
    again = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda o: F.element_at("__v", (source(o) - first + 1).cast("int")))
    rows = rows.withColumn("__v", F.when(F.greatest(left, right) <= F.col("__n"), mirrored).otherwise(again))

    def smooth(kernel: list[tuple[int, float]]) -> Column:
        r = kernel[-1][0]
        values = F.slice("__v", reach - r + 1, 2 * r + 1)
        return F.aggregate(F.zip_with(values, F.array(*[F.lit(w) for _, w in kernel]), lambda v, w: v * w), F.lit(0.0), lambda s, x: s + x)

    return rows.withColumn(name, F.array(*[smooth(k) for k in kernels])).drop("__n", "__v")


def interpolated(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """video_id, center_frame, score for every grid row: linear between the nearest samples, flat beyond them. Samples of -1 do not count.

    One window over the union of samples and grid: no range join."""
    known = samples.where("score <> -1").select("video_id", "center_frame", F.col("score").alias("s"), F.lit(0).alias("asked"))
    rows = known.unionByName(grid.select("video_id", "center_frame", F.lit(None).cast("double").alias("s"), F.lit(1).alias("asked")))
    sample = F.when(F.col("s").isNotNull(), F.struct(F.col("center_frame").alias("x"), F.col("s").alias("y")))
    order = Window.partitionBy("video_id").orderBy("center_frame", "asked")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("video_id").orderBy(F.desc("center_frame"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("l", F.last(sample, ignorenulls=True).over(back)).withColumn("r", F.last(sample, ignorenulls=True).over(ahead))
    share = F.try_divide((F.col("center_frame") - F.col("l.x")).cast("double"), (F.col("r.x") - F.col("l.x")).cast("double"))
    value = F.when(F.col("l").isNull(), F.col("r.y")).when(F.col("r").isNull() | (F.col("r.x") == F.col("l.x")), F.col("l.y")).otherwise(F.col("l.y") + (F.col("r.y") - F.col("l.y")) * share)
    return rows.where("asked = 1").select("video_id", "center_frame", value.alias("score"))


def interpolated_frames(samples: DataFrame, clips: DataFrame, index: DataFrame, sigma: float = 10.0, interval: int = 16) -> DataFrame:
    """Scores of every frame: samples interpolated to the grid of clips, smoothed there, and expanded. clips: video_id, clip_idx, center_frame (every interval-th frame)."""
    from .frames import expanded

    grid = clips.select("video_id", "clip_idx", "center_frame")
    known = interpolated(samples, grid).where("score is not null").join(grid, ["video_id", "center_frame"])
    return expanded(gaussian(known, sigma), index, interval)
