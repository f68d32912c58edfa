"""Ranking metrics from weighted rows: ROC and PR areas, F1, Youden, rank sums, Spearman, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ranges import running

F1_EDGE = 1e-8


def curve(rows: DataFrame, by: list[str] = (), score: str = "score", pos: str = "pos", neg: str = "neg") -> DataFrame:
    """by, score, pos, neg, tp, fp, P, N: one row for each distinct score; tp and fp count what scores at least that, P and N everything."""
    per = rows.groupBy(*by, F.col(score).alias("score")).agg(F.sum(pos).cast("bigint").alias("pos"), F.sum(neg).cast("bigint").alias("neg"))
    return running(per, list(by), "score", {"tp": "pos", "fp": "neg"}).withColumnsRenamed({"run_tp": "tp", "run_fp": "fp", "all_tp": "P", "all_fp": "N"})


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """by, and a column for each share: the exact quantile, interpolated between neighbours; nulls do not count. Values are counted and summed by bands, so no task holds them
    all, and only the values at the places asked go on."""
    by = list(by)
    per = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    run = running(per, by, "__v", {"n": "__n"})
    # a share's place among the values lies between two whole numbers: the values there are numbered 2 i and 2 i + 1
    listed = ", ".join(f"{float(q)}D" for q in shares.values())
    places = f"flatten(transform(array({listed}), (q, i) -> array(struct(2 * i AS i, floor(q * (all_n - 1)) AS at), struct(2 * i + 1 AS i, ceil(q * (all_n - 1)) AS at))))"
    asked = F.expr(f"filter({places}, x -> x.at >= all_n - run_n AND x.at < all_n - run_n + __n)")
    met = run.select(*by, "__v", "all_n", F.explode(asked).alias("x"))
    got = met.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("x.i", "__v"))).alias("m"), F.max("all_n").alias("n"))
    part = lambda q: f"({float(q)}D * (n - 1) - floor({float(q)}D * (n - 1)))"
    return got.select(*by, *[F.expr(f"m[{2 * i}] + (m[{2 * i + 1}] - m[{2 * i}]) * {part(q)}").alias(n) for i, (n, q) in enumerate(shares.items())])


def unit_scale(rows: DataFrame, value: str, name: str, by: list[str] = ("video_id",), share: float = 0.95, floor: float = 1e-6) -> DataFrame:
    """rows with name: value over the larger of its quantile in the group and a floor, clipped to 0..1."""
    top = quantiles(rows, value, {"__top": share}, by)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) / F.greatest(F.col("__top"), F.lit(floor))))
    return rows.join(top, list(by), "left").withColumn(name, scaled).drop("__top")


def _safe(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ranking_metrics(curve_rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """roc_auc, pr_auc, max_f1, f1_threshold (lowest of equals), youden_threshold (highest of equals, null if no score beats the start), positives, negatives.

    NaN where a class is missing."""
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = _safe(F.col("tp"), F.col("tp") + F.col("fp"))
    before = F.coalesce(_safe(tp0, tp0 + fp0), F.lit(1.0))
    recall = _safe(F.col("tp"), F.col("P"))
    f1 = 2.0 * precision * recall / (precision + recall + F1_EDGE)
    j = _safe(F.col("tp"), F.col("P")) - _safe(F.col("fp"), F.col("N"))
    out = curve_rows.groupBy(*by, "P", "N").agg(
        F.sum(F.col("neg") * (F.col("tp") + tp0) / 2.0).alias("area"),
        F.sum(_safe(F.col("pos"), F.col("P")) * (precision + before) / 2.0).alias("pr"),
        F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("t"))).alias("f"),
        F.max(F.struct(j.alias("j"), F.col("score").alias("t"))).alias("y"),
    )
    nan = F.lit(float("nan"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return out.select(
        *by, F.when(both, F.col("area") / F.col("P") / F.col("N")).otherwise(nan).alias("roc_auc"), F.when(F.col("P") > 0, F.col("pr")).otherwise(nan).alias("pr_auc"),
        F.col("f.f1").alias("max_f1"), (-F.col("f.t")).alias("f1_threshold"), F.when(F.col("y.j") > 0, F.col("y.t")).alias("youden_threshold"),
        F.col("P").alias("positives"), F.col("N").alias("negatives"),
    )


def rank_auc(rows: DataFrame, value: str, label: Column, by: list[str] = ()) -> DataFrame:
    """by, auc: Mann-Whitney with average ranks; NaN if a class is missing. Equal to the area of the curve, as ties are grouped."""
    weighted = rows.select(*by, F.col(value).alias("score"), F.when(label, 1).otherwise(0).alias("pos"), F.when(label, 0).otherwise(1).alias("neg"))
    return ranking_metrics(curve(weighted, by), by).select(*by, F.col("roc_auc").alias("auc"))


def average_ranks(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """rows with r_<column>: the rank within the group, equal values sharing their mean rank; a null value has no rank and does not count."""
    for c in columns:
        per = rows.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("__n"))
        run = running(per, by, c, {"n": "__n"})
        ranked = run.select(*by, c, (F.col("all_n") - F.col("run_n") + (F.col("__n") + 1) / 2.0).alias(f"r_{c}"))
        rows = rows.join(ranked, [*by, c], "left")
    return rows


def spearman(rows: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """by, rho, n: correlation of average ranks; NaN if a side is constant."""
    ranked = average_ranks(rows.select(*by, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), list(by), [a, b])
    rho = F.corr(f"r_{a}", f"r_{b}")
    return ranked.groupBy(*by).agg(F.coalesce(rho, F.lit(float("nan"))).alias("rho"), F.count("*").alias("n"))


def bootstrap(weighted: DataFrame, draws: DataFrame, metrics: list[str] = ("roc_auc", "pr_auc", "max_f1")) -> DataFrame:
    """metric, mean, low, high (2.5 and 97.5 %), reps: metrics of every resample of whole videos.

    weighted: video_id, score, pos, neg. draws: rep, video_id, times. A video drawn k times weighs k-fold, so rows are never copied; rows of
    equal score in a video are summed before the join."""
    per = weighted.groupBy("video_id", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = per.join(draws, "video_id").select("rep", "score", (F.col("pos") * F.col("times")).alias("pos"), (F.col("neg") * F.col("times")).alias("neg"))
    m = ranking_metrics(curve(rows, ["rep"]), ["rep"])
    long = m.select("rep", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in metrics])).alias("x")).select("rep", "x.*").where(~F.isnan("v"))
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"), F.count("*").alias("reps"))


#: Videos of a bucket of draws, about; buckets, at most.
BUCKET, BUCKETS = 2_048, 1 << 16


def shares_of_draws(counts: list[int], at: int, total: int, seed: int, rep: int) -> int:
    """How many of `total` draws over all buckets fall into bucket `at`. The draws are split in halves of the list of buckets, each split a binomial draw of a generator that is
    seeded by the split, so every bucket comes to the same splits on its own, and all shares together are one multinomial draw."""
    lo, hi = 0, len(counts) - 1  # counts: running totals of the buckets' sizes, from 0
    while hi - lo > 1 and total:
        mid = (lo + hi) // 2
        left, all_ = counts[mid] - counts[lo], counts[hi] - counts[lo]
        drawn = int(np.random.default_rng([seed, rep, lo, hi]).binomial(total, left / all_)) if all_ else 0
        lo, hi, total = (lo, mid, drawn) if at < mid else (mid, hi, total - drawn)
    return total


def resamples(videos: DataFrame, reps: int, seed: int = 17) -> DataFrame:
    """rep, video_id, times: reps draws of as many videos as there are, with replacement. Videos lie in buckets by hash; a bucket's share of a rep's draws is found from the
    sizes of all buckets (at most BUCKETS numbers), and drawn within it, so no task holds all videos."""
    one = videos.select("video_id").distinct()
    buckets = min(BUCKETS, max(1, -(-one.count() // BUCKET)))
    placed = one.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)))
    sizes = {r["bucket"]: r["n"] for r in placed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    counts = [0]
    for k in range(buckets):
        counts.append(counts[-1] + sizes.get(k, 0))
    total, kind = counts[-1], one.schema["video_id"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([b.column("video_id") for b in batches])
        ids = ids.take(pa.array(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")))
        at, n = key[0].as_py(), len(ids)
        for rep in range(reps):
            drawn = shares_of_draws(counts, at, total, seed, rep)
            times = np.bincount(np.random.default_rng([seed, rep, at]).integers(0, n, drawn), minlength=n)
            hit = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), rep, dtype=np.int64)), ids.take(pa.array(hit)), pa.array(times[hit].astype(np.int64))], names=["rep", "video_id", "times"])

    return placed.groupBy("bucket").applyInArrow(run, f"rep bigint, video_id {kind}, times bigint")
