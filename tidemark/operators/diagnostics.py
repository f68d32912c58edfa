"""Diagnostics over scored clips: residuals, ranks, groups, agreement of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .metrics import average_ranks, quantiles, rank_auc

NAN = float("nan")


def binned_residual(rows: DataFrame, score: str = "score", value: str = "entropy", bins: int = 20) -> DataFrame:
    """rows with bin, expected and residual: value minus its mean within equal-frequency score bins. Edges are the distinct quantiles of the
    score; a bin is how many inner edges are at or below the score; with two edges or fewer all is one bin."""
    cuts = quantiles(rows, score, {f"q{k}": k / bins for k in range(bins + 1)})
    edges = cuts.select(F.array_sort(F.array_distinct(F.array(*cuts.columns))).alias("__e"))
    inner = F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0)))
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(score)))).drop("__e")
    means = placed.groupBy("bin").agg(F.avg(value).alias("expected"))
    return placed.join(F.broadcast(means), "bin").withColumn("residual", F.col(value) - F.col("expected"))


def percentile_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with name: (average rank - 1) / (n - 1) among the rows that have a value; 0 for one row, null for a null."""
    n = rows.agg(F.count(column).alias("__n"))
    ranked = average_ranks(rows, [], [column]).crossJoin(F.broadcast(n))
    return ranked.withColumn(name, F.when(F.col(f"r_{column}").isNotNull() & (F.col("__n") <= 1), 0.0).otherwise((F.col(f"r_{column}") - 1) / (F.col("__n") - 1))).drop(f"r_{column}", "__n")


def kind(label: Column, predicted: Column) -> Column:
    """TP, FP, FN or TN."""
    return F.when(label & predicted, "TP").when(predicted, "FP").when(label, "FN").otherwise("TN")


def error_summary(rows: DataFrame, value: str, quantile: float = 0.9) -> DataFrame:
    """kind, count, mean, median, q75, high_fraction for each of the four kinds (NaN for an empty one). high: value at or over its quantile."""
    cut = quantiles(rows, value, {"__cut": quantile})
    g = rows.crossJoin(F.broadcast(cut)).withColumn("__high", (F.col(value) >= F.col("__cut")).cast("double")).groupBy("kind")
    got = g.agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.avg("__high").alias("high_fraction"))
    got = got.join(quantiles(rows, value, {"median": 0.5, "q75": 0.75}, ["kind"]), "kind", "left")
    names = rows.sparkSession.createDataFrame([(k,) for k in ("TN", "FP", "FN", "TP")], "kind string")
    nan = [F.coalesce(c, F.lit(NAN)).alias(c) for c in ("mean", "median", "q75", "high_fraction")]
    return names.join(got, "kind", "left").select("kind", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), *nan)


def high_error(rows: DataFrame, value: str, quantile: float = 0.9) -> DataFrame:
    """cutoff, high_fraction, error_rate, high_error_rate, enrichment: how errors gather where value is high."""
    cut = quantiles(rows, value, {"cutoff": quantile})
    r = rows.crossJoin(F.broadcast(cut)).select("cutoff", F.col("kind").isin("FP", "FN").cast("double").alias("e"), (F.col(value) >= F.col("cutoff")).alias("h"))
    out = r.groupBy("cutoff").agg(F.avg(F.col("h").cast("double")).alias("high_fraction"), F.avg("e").alias("error_rate"), F.avg(F.when(F.col("h"), F.col("e"))).alias("high_error_rate"))
    return out.withColumn("enrichment", F.coalesce(F.try_divide("high_error_rate", "error_rate"), F.lit(NAN)))


def group_stats(scores: DataFrame, extremes: DataFrame) -> DataFrame:
    """video_id, std, avg_high, avg_low, gap: single-precision scores split by which extreme mean is nearer (ties high); an empty group stands for all.
    extremes: video_id, highest_avg, lowest_avg."""
    s = scores.join(extremes.select("video_id", "highest_avg", "lowest_avg"), "video_id").withColumn("v", F.col("score").cast("float").cast("double"))
    high = F.abs(F.col("v") - F.col("highest_avg")) <= F.abs(F.col("v") - F.col("lowest_avg"))
    g = s.groupBy("video_id").agg(F.stddev_pop("v").alias("std"), F.avg(F.when(high, F.col("v"))).alias("h"), F.avg(F.when(~high, F.col("v"))).alias("l"), F.avg("v").alias("all"))
    h, low = F.coalesce("h", "all"), F.coalesce("l", "all")
    return g.select("video_id", "std", h.alias("avg_high"), low.alias("avg_low"), (h - low).alias("gap"))


def adaptive_gate(stats: DataFrame, threshold: float | None = None) -> DataFrame:
    """Videos whose highest mean lies within 0.5 +- margin; the margin is |threshold|, or the squared deviation."""
    margin = F.abs(F.lit(threshold)) if threshold is not None else F.abs("std") * F.abs("std")
    return stats.where(F.col("highest_avg").between(F.greatest(F.lit(0.0), 0.5 - margin), F.least(F.lit(1.0), 0.5 + margin)))


def delta_summary(pairs: DataFrame) -> DataFrame:
    """count, mean, median and mean absolute change of b against a, and the shares raised and lowered."""
    d = pairs.select((F.col("b") - F.col("a")).alias("d"))
    share = lambda c: F.avg(c.cast("double"))
    middle = quantiles(d, "d", {"median": 0.5})
    got = d.agg(F.count("*").alias("count"), F.avg("d").alias("mean"), F.avg(F.abs("d")).alias("mean_abs"), share(F.col("d") > 0).alias("raised"), share(F.col("d") < 0).alias("lowered"))
    return got.join(F.broadcast(middle), how="left").select("count", "mean", "median", "mean_abs", "raised", "lowered")


def scope_summary(pairs: DataFrame) -> DataFrame:
    """One row on what a second look (b) does to clips that a first one (a) passed, positive or not: clips, positive, negative, area under ROC by a and by b and its change, the
    delta summary of all, of the positive ones (fn) and of the others (tn), and how much more the positive ones rise on average. NaN where a class is missing. pairs: a, b, positive."""
    nan = F.lit(NAN)
    sides = pairs.select(F.explode(F.array(F.struct(F.lit("initial").alias("side"), F.col("a").alias("v")), F.struct(F.lit("verify").alias("side"), F.col("b").alias("v")))).alias("x"), "positive")
    auc = rank_auc(sides.select("x.side", "x.v", "positive"), "v", F.col("positive"), ["side"])
    auc = auc.agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col("auc"))), nan).alias(f"{s}_auc") for s in ("initial", "verify")])
    scopes = F.array(F.lit("all"), F.when(F.col("positive"), "fn").otherwise("tn"))
    d = pairs.select((F.col("b") - F.col("a")).alias("d"), F.explode(scopes).alias("scope"))
    share = lambda c: F.avg(c.cast("double"))
    got = d.groupBy("scope").agg(F.count("*").alias("count"), F.avg("d").alias("mean"), F.avg(F.abs("d")).alias("mean_abs"), share(F.col("d") > 0).alias("raised"), share(F.col("d") < 0).alias("lowered"))
    got = got.join(quantiles(d, "d", {"median": 0.5}, ["scope"]), "scope")
    names = ("mean", "median", "mean_abs", "raised", "lowered")
    one = got.agg(*[F.coalesce(F.max(F.when(F.col("scope") == s, F.col("count"))), F.lit(0).cast("bigint")).alias(n) for s, n in (("all", "clips"), ("fn", "positive"), ("tn", "negative"))],
                  *[F.coalesce(F.max(F.when(F.col("scope") == s, F.col(n))), nan).alias(f"{s}_{n}") for s in ("all", "fn", "tn") for n in names])
    return one.crossJoin(auc).withColumns({"auc_change": F.col("verify_auc") - F.col("initial_auc"), "mean_gap": F.col("fn_mean") - F.col("tn_mean")})


def pava_summary(rows: DataFrame) -> DataFrame:
    """One row over clips with violations, pava_l1, pava_l2, pava_max."""
    hit = (F.col("violations") > 0).cast("double")
    return rows.agg(F.count("*").alias("clips"), F.avg(hit).alias("violating"), F.avg(F.col("violations").cast("double")).alias("mean_violations"), F.max("violations").cast("int").alias("max_violations"), F.avg("pava_l1").alias("mean_l1"), F.avg("pava_l2").alias("mean_l2"), F.max("pava_max").alias("max_change"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str] = ("video_id", "center_frame")) -> DataFrame:
    """n and mean absolute difference over the keys that both runs have."""
    j = a.select(*keys, F.col("score").alias("a")).join(b.select(*keys, F.col("score").alias("b")), list(keys))
    return j.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"))


def run_table(runs: DataFrame, metric: str, baseline: str) -> DataFrame:
    """prompt, runs, mean, std (0 for one run), worst, range, delta of the mean against a baseline prompt."""
    g = runs.groupBy("prompt").agg(F.count("*").alias("runs"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.min(metric).alias("worst"), (F.max(metric) - F.min(metric)).alias("range"))
    base = g.where(F.col("prompt") == baseline).select(F.col("mean").alias("__base"))
    return g.crossJoin(F.broadcast(base)).withColumn("delta", F.col("mean") - F.col("__base")).drop("__base")
