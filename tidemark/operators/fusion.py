"""Fusion of a clip's score with its neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordinal import logit, sigmoid

EPSILON = 1e-6


def adjacent_mean(clips: DataFrame, reach: int = 1) -> DataFrame:
    """score as the mean of the clip and `reach` neighbours on either side, fewer at the ends."""
    near = Window.partitionBy("video_id").orderBy("clip_idx").rowsBetween(-reach, reach)
    return clips.withColumn("score", F.avg("score").over(near))


def adjacent_median(clips: DataFrame, reach: int = 1) -> DataFrame:
    """score as the median of the clip and `reach` neighbours on either side, fewer at the ends; of an even number, the mean of the middle two."""
    near = Window.partitionBy("video_id").orderBy("clip_idx").rowsBetween(-reach, reach)
    rows = clips.withColumn("__near", F.array_sort(F.collect_list("score").over(near)))
    at = lambda k: F.element_at("__near", k.cast("int"))
    n = F.size("__near")
    return rows.withColumn("score", (at(F.floor((n + 1) / 2)) + at(F.ceil((n + 1) / 2))) / 2).drop("__near")


def neighbours(clips: DataFrame, seconds: float) -> DataFrame:
    """clips with near: array of (score, d) of the clips within seconds / 2 (and EPSILON) of its time, in order of time, itself included.

    A range window on microseconds: one shuffle by video, no self-join. clips: video_id, clip_idx, center_frame, fps, score."""
    t = F.col("center_frame") / F.col("fps")
    micro = F.round(t * 1e6).cast("bigint")
    half = int(round(seconds / 2 * 1e6)) + 1
    w = Window.partitionBy("video_id").orderBy("__us").rangeBetween(-half, half)
    rows = clips.withColumn("__us", micro).withColumn("__t", t).withColumn("near", F.collect_list(F.struct(F.col("__t").alias("t"), F.col("clip_idx").alias("i"), F.col("score").alias("score"))).over(w))
    close = F.filter("near", lambda x: F.abs(x["t"] - F.col("__t")) <= seconds / 2 + EPSILON)
    return rows.withColumn("near", F.array_sort(F.transform(close, lambda x: F.struct(x["i"].alias("i"), x["score"].alias("score"), F.abs(x["t"] - F.col("__t")).alias("d"))))).drop("__us", "__t")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def overlap_mean(clips: DataFrame, seconds: float = 10.0, logits: bool = False) -> DataFrame:
    """Mean of the neighbours with weights falling linearly to 0 at seconds / 2; of their logits if asked, turned back."""
    rows = neighbours(clips, seconds)
    weight = lambda x: F.greatest(F.lit(0.0), 1.0 - x["d"] / (seconds / 2))
    value = (lambda x: logit(x["score"])) if logits else (lambda x: x["score"])
    out = _total(F.transform("near", lambda x: weight(x) * value(x))) / _total(F.transform("near", weight))
    return rows.withColumn("score", sigmoid(out) if logits else out).drop("near")


def weighted_median(pairs: Column, strict: bool = False) -> Column:
    """Lower weighted median of an array of (v, w): the first v in order (stable) whose cumulated weight reaches half of the total. Arrays that have none are an error if strict; see checked_weights."""
    pairs = checked_weights(pairs) if strict else pairs
    ranked = F.array_sort(F.transform(pairs, lambda p, k: F.struct(p["v"].alias("v"), k.alias("k"), p["w"].alias("w"))))
    half = _total(F.transform(pairs, lambda p: p["w"])) / 2.0 - 1e-12  # sums in another order make the same choice
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("m"))
    step = lambda s, p: F.struct((s["c"] + p["w"]).alias("c"), F.coalesce(s["m"], F.when(s["c"] + p["w"] >= half, p["v"])).alias("m"))
    return F.aggregate(ranked, start, step)["m"]


def checked_weights(pairs: Column) -> Column:
    """An array of (v, w) as it is, or an error: it must not be empty, every value and weight must be finite, no weight negative, and one positive."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    said = F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, "a weighted median needs a value").when(F.exists(pairs, lambda p: odd(p["v"]) | odd(p["w"])), "values and weights must be finite")
    said = said.when(F.exists(pairs, lambda p: p["w"] < 0), "weights must not be negative").when(~F.exists(pairs, lambda p: p["w"] > 0), "one weight must be positive")
    return F.when(said.isNotNull(), F.raise_error(said).cast("array<struct<v:double,w:double>>")).otherwise(pairs)


def adaptive(clips: DataFrame, seconds: float = 10.0) -> DataFrame:
    """Robust consensus of the neighbours, taken over as far as the clip is uncertain.

    Time weights fall linearly; a range weight follows the distance in score over 1.4826 weighted MAD; confidence is |2s - 1|. The logit of
    the result is (1 - u) logit(s) + u consensus with u = 4 s (1 - s)."""
    rows = neighbours(clips, seconds)
    rows = rows.withColumn("near", F.transform("near", lambda x: F.struct(x["score"].alias("v"), F.greatest(F.lit(0.0), 1.0 - x["d"] / (seconds / 2)).alias("w"))))
    rows = rows.withColumn("__m", weighted_median(F.col("near")))
    rows = rows.withColumn("__scale", 1.4826 * weighted_median(F.transform("near", lambda x: F.struct(F.abs(x["v"] - F.col("__m")).alias("v"), x["w"].alias("w")))))
    same = lambda x: F.when(F.abs(x["v"] - F.col("score")) <= EPSILON, 1.0).otherwise(0.0)
    support = _total(F.transform("near", lambda x: same(x) * x["w"])) >= 0.5 * _total(F.transform("near", lambda x: x["w"]))
    z = lambda x: (x["v"] - F.col("score")) / F.col("__scale")
    rows = rows.withColumn("__support", support)
    reach = lambda x: F.when(F.col("__scale") > EPSILON, F.exp(-0.5 * z(x) * z(x))).when(F.col("__support"), same(x)).otherwise(1.0)
    weight = lambda x: x["w"] * reach(x) * (F.abs(2.0 * x["v"] - 1.0) + EPSILON)
    rows = rows.withColumn("__w", F.transform("near", lambda x: F.struct(logit(x["v"]).alias("l"), weight(x).alias("w"))))
    sum_w = _total(F.transform("__w", lambda x: x["w"]))
    own = logit("score")
    consensus = F.when(sum_w <= EPSILON, own).otherwise(_total(F.transform("__w", lambda x: x["w"] * x["l"])) / F.nullif(sum_w, F.lit(0.0)))
    u = 4.0 * F.col("score") * (1.0 - F.col("score"))
    fused = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sigmoid((1.0 - u) * own + u * consensus)))
    return rows.withColumn("score", fused).drop("near", "__m", "__scale", "__support", "__w")


def fused_runs(initial: DataFrame, refined: DataFrame, alpha: float = 0.3) -> DataFrame:
    """video_id, center_frame, score over the union of keys: alpha of the initial score where both exist."""
    i, r = initial.select("video_id", "center_frame", F.col("score").alias("i")), refined.select("video_id", "center_frame", F.col("score").alias("r"))
    score = F.coalesce(alpha * F.col("i") + (1.0 - alpha) * F.col("r"), "i", "r")
    return i.join(r, ["video_id", "center_frame"], "full_outer").select("video_id", "center_frame", score.alias("score"))


#: Fusion by name: each takes clips and gives clips.
MODES = {
    "adjacent_mean": adjacent_mean,
    "adjacent_median": adjacent_median,
    "overlap_mean": overlap_mean,
    "overlap_logit": lambda clips: overlap_mean(clips, logits=True),
    "adaptive": adaptive,
}


def fuse(clips: DataFrame, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown fusion {mode!r}; known: {', '.join(sorted(MODES))}")
    return MODES[mode](clips)
