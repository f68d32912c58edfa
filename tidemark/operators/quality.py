"""Completeness, validation and what is left to score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KEYS = ["video_id", "center_frame"]


def completeness(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """video_id, complete: the keys are the same on both sides and every score is a number."""
    e = expected.select(*KEYS, F.lit(True).alias("e"))
    a = actual.select(*KEYS, F.lit(True).alias("a"), F.col("score"))
    both = e.join(a, KEYS, "full_outer")
    good = F.col("e").isNotNull() & F.col("a").isNotNull() & F.col("score").isNotNull() & ~F.isnan(F.coalesce("score", F.lit(float("nan"))))
    return both.groupBy("video_id").agg(F.bool_and(good).alias("complete"))


def coverage(expected: DataFrame, actual: DataFrame, errors: DataFrame) -> DataFrame:
    """video_id, expected, missing, unexpected, invalid, failed: counts of keys."""
    rows = expected.select(*KEYS, F.lit(1).alias("e")).join(actual.select(*KEYS, F.lit(1).alias("a"), "score"), KEYS, "full_outer")
    rows = rows.join(errors.select(*KEYS, F.lit(1).alias("f")).distinct(), KEYS, "full_outer")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    wrong = F.col("a").isNotNull() & (F.col("score").isNull() | ~F.col("score").between(0.0, 1.0))
    return rows.groupBy("video_id").agg(
        n(F.col("e").isNotNull()).alias("expected"), n(F.col("e").isNotNull() & F.col("a").isNull()).alias("missing"),
        n(F.col("e").isNull() & F.col("a").isNotNull()).alias("unexpected"), n(wrong).alias("invalid"), n(F.col("f").isNotNull()).alias("failed"),
    )


def run_status(expected: DataFrame, actual: DataFrame, errors: DataFrame) -> DataFrame:
    """run, observed, errors, status: complete if every expected key has a score and none failed."""
    o = actual.select("run", *KEYS).distinct().join(expected.select(*KEYS), KEYS, "left_semi").groupBy("run").agg(F.count("*").alias("observed"))
    f = errors.groupBy("run").agg(F.count("*").alias("errors"))
    total = expected.select(*KEYS).distinct().agg(F.count("*").alias("n"))
    rows = o.join(f, "run", "full_outer").crossJoin(F.broadcast(total))
    seen, bad = F.coalesce("observed", F.lit(0).cast("bigint")), F.coalesce("errors", F.lit(0).cast("bigint"))
    return rows.select("run", seen.alias("observed"), bad.alias("errors"), F.when((seen == F.col("n")) & (bad == 0), "complete").otherwise("partial").alias("status"))


def pending(expected: DataFrame, done: DataFrame, errors: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Expected clips without a score, with an error, or without details if those are asked for."""
    ok = done.select(*KEYS).join(errors.select(*KEYS), KEYS, "left_anti")
    if details is not None:
        ok = ok.join(details.select(*KEYS), KEYS, "left_semi")
    return expected.join(ok, KEYS, "left_anti")


def dataset_problems(index: DataFrame, annotations: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: videos, videos without annotation (and the first ten names), repeated stems, videos without scores."""
    bare = index.select("video_id").distinct()
    no_label = bare.join(annotations.select("video_id"), "video_id", "left_anti")
    no_score = bare.join(scores.select("video_id"), "video_id", "left_anti")
    twice = index.groupBy("video_id").agg(F.count("*").alias("n")).where("n > 1")
    first = no_label.orderBy("video_id").limit(10).agg(F.array_join(F.array_sort(F.collect_list(F.col("video_id").cast("string"))), ",").alias("first_unlabelled"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(bare, "videos")
    for part in (one(no_label, "unlabelled"), one(twice, "repeated"), one(no_score, "unscored"), first):
        out = out.crossJoin(part)
    return out


def score_problems(scores: DataFrame, order: str) -> DataFrame:
    """video_id, place, problem of the rows of a list of scores (video_id, center_frame, score; `order` is their place in the list) that cannot stand: no finite number, out of 0..1, or a center that
    does not rise."""
    before = F.lag("center_frame").over(Window.partitionBy("video_id").orderBy(order))
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    said = F.when(bad, "not finite").when(~F.col("score").between(0.0, 1.0), "out of range").when(before >= F.col("center_frame"), "not rising")
    return scores.select("video_id", F.col(order).alias("place"), said.alias("problem")).where("problem is not null")


def ordered_scores(scores: DataFrame, order: str) -> DataFrame:
    """scores as they are; an error if any row has a problem."""
    worst = score_problems(scores, order).agg(F.count("*").alias("n"), F.min(F.struct("video_id", "place", "problem").cast("string")).alias("first")).first()
    if worst.n:
        raise ValueError(f"{worst.n} scores cannot stand, the first: {worst.first}")
    return scores


def dataset_counters(lines: DataFrame, interval: int = 16, fields: int = 4) -> DataFrame:
    """One row: lines, short (fewer than four fields), frames and windows (one for every started interval) of index lines (value); blank lines do not count."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.length(F.trim("value")) > 0).select((F.size(f) < fields).alias("short"), (F.get(f, F.lit(2)).try_cast("bigint") - F.get(f, F.lit(1)).try_cast("bigint") + 1).alias("n"))
    n = F.when(~F.col("short"), F.greatest(F.lit(0), "n"))
    return rows.agg(F.count("*").alias("lines"), F.count_if("short").alias("short"), F.coalesce(F.sum(n), F.lit(0)).alias("frames"), F.coalesce(F.sum(F.ceil(n / interval)), F.lit(0)).alias("windows"))


def first_match(names: DataFrame, entries: DataFrame) -> DataFrame:
    """name, value: for each name the value of the first entry (key, position, value) whose key has its stem; null if none has."""
    from ..functions.text import stem

    keyed = entries.groupBy(stem(F.col("key")).alias("__stem")).agg(F.min_by("value", "position").alias("value"))
    return names.select("name", stem(F.col("name")).alias("__stem")).join(keyed, "__stem", "left").select("name", "value")


def latest(results: DataFrame) -> DataFrame:
    """video_id, center_frame, score, error of the last attempt at each clip."""
    best = F.max_by(F.struct("score", "error"), "attempt").alias("r")
    return results.groupBy(*KEYS).agg(best).select(*KEYS, "r.score", "r.error")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], strict: bool = True, what: str = "the table") -> DataFrame:
    """rows with the columns of table by keys. A key that the table lacks is an error, which counts the keys and names the first ten, or gives nulls if strict is off. The error
    is raised by the query itself: what is missing is counted in the same job, and no row gets out before."""
    got = rows.join(table, keys, "left")
    if not strict:
        return got
    missing = rows.select(*keys).distinct().join(table.select(*keys), keys, "left_anti")
    named = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    first = missing.orderBy(*keys).limit(10).select(named.alias("k")).agg(F.array_join(F.array_sort(F.collect_list("k")), ", ").alias("__first"))
    bad = missing.agg(F.count("*").alias("__missing")).crossJoin(first)
    said = F.concat(F.col("__missing").cast("string"), F.lit(f" keys have no row in {what}, the first: "), F.col("__first"))
    return got.crossJoin(F.broadcast(bad)).where(F.when(F.col("__missing") > 0, F.raise_error(said).cast("boolean")).otherwise(True)).drop("__missing", "__first")
