"""Queries for validation, timelines, text rules and resumed runs; they join those of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ordinal as O, prompts as P, text as X
from ..operators import clips as C, fusion as U, metrics as M, quality as Q, smoothing as G
from . import adapters as A
from .queries import _COARSE, _INTERP, _with, big, query, r6, rounded


@query("SELECT o_orderkey, round_even(o_custkey % 1000 / 8.0, 2)::DOUBLE AS two, round_even(o_custkey % 1000 / 16.0, 3)::DOUBLE AS three FROM orders")
def half_even(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("o_custkey") % 1000
    return A.table(spark, d, "orders").select("o_orderkey", O.half_even(part / 8.0, 2).alias("two"), O.half_even(part / 16.0, 3).alias("three"))


@query(_with(A.CLIPS) + "SELECT video_id, center_frame, round(greatest(0, least(1, score / greatest(p, 0.3))), 6) AS scaled FROM clips JOIN (SELECT video_id, quantile_cont(score, 0.95) AS p FROM clips GROUP BY video_id) USING (video_id)")
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    return M.unit_scale(A.clips(spark, d), "score", "scaled", floor=0.3).select("video_id", "center_frame", r6("scaled"))


@query(_with(A.CLIPS, A.INDEX) + "SELECT video_id, k - 1 AS position, t[k]::BIGINT AS frame FROM (SELECT video_id, [floor(start_frame + (end_frame - start_frame) * k / 7) for k in range(0, 8)] AS t FROM idx), (SELECT unnest(range(1, 9)) AS k)")
def whole_targets(spark: SparkSession, d: str) -> DataFrame:
    i = A.index(A.clips(spark, d))
    return i.select("video_id", F.posexplode(C.whole_targets(F.col("start_frame"), F.col("end_frame"), 8)).alias("position", "frame")).select("video_id", big("position"), big("frame"))


@query(
    """WITH l AS (SELECT doc_id, [string_split(x, ' ') for x in string_split(text, chr(10))] AS s FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, s[1] AS a, unnest(s) AS b FROM l)
SELECT doc_id, min(coalesce(list_min([k for k in range(1, least(len(a), len(b)) + 1) if a[k] <> b[k]]) - 1, least(len(a), len(b))))::BIGINT AS shared FROM p GROUP BY doc_id"""
)
def common_prefix_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words that all lines of a document begin with."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.split(x, " ", -1))
    return A.table(spark, d, "documents").where("text is not null").select("doc_id", lines.alias("s")).select("doc_id", big(O.common_prefix_of("s"), "shared"))


@query(_with(A.CLIPS) + "SELECT video_id, clip_idx, round(median(score) OVER (PARTITION BY video_id ORDER BY clip_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS score FROM clips")
def fuse_adjacent_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.fuse(A.clips(spark, d), "adjacent_median").select("video_id", "clip_idx", "score"))


@query(
    _with(A.CLIPS, A.INDEX, _COARSE, _INTERP, "ik AS (SELECT * FROM ii WHERE score IS NOT NULL)", A.smooth_sql(2, "ik").replace("WITH ", ""), "fr AS (SELECT video_id, unnest(range(0, end_frame + 1)) AS f FROM idx)")
    + "SELECT fr.video_id, f AS frame, round(coalesce(score, 0), 6) AS score FROM fr LEFT JOIN sm ON sm.video_id = fr.video_id AND sm.clip_idx = f // 16"
)
def interpolated_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every third clip is a sample: interpolated, smoothed, expanded."""
    c = A.clips(spark, d)
    return rounded(G.interpolated_frames(c.where("clip_idx % 3 = 1").select("video_id", "center_frame", "score"), c, A.index(c), 2.0))


_BROKEN = "CASE clip_idx % 17 WHEN 3 THEN NULL WHEN 5 THEN score + 1.5 WHEN 7 THEN 'nan'::DOUBLE ELSE score END"


@query(
    _with(A.CLIPS, f"br AS (SELECT video_id, clip_idx, CASE WHEN clip_idx % 19 = 4 THEN 0 ELSE center_frame END AS center_frame, {_BROKEN} AS score FROM clips)", "lg AS (SELECT *, lag(center_frame) OVER (PARTITION BY video_id ORDER BY clip_idx) AS before FROM br)")
    + "SELECT video_id, clip_idx AS place, problem FROM (SELECT *, CASE WHEN score IS NULL OR isnan(score) THEN 'not finite' WHEN score NOT BETWEEN 0 AND 1 THEN 'out of range' WHEN before >= center_frame THEN 'not rising' END AS problem FROM lg) WHERE problem IS NOT NULL"
)
def score_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("clip_idx") % 17
    score = F.when(k == 3, F.lit(None)).when(k == 5, F.col("score") + 1.5).when(k == 7, float("nan")).otherwise(F.col("score"))
    center = F.when(F.col("clip_idx") % 19 == 4, 0).otherwise(F.col("center_frame"))
    return Q.score_problems(A.clips(spark, d).withColumns({"score": score, "center_frame": center}), "clip_idx").withColumn("place", big("place"))


_MADE = (
    "mg AS (SELECT vec_id, [((e[4 * k + 1] - e[4 * k + 2]) + (e[4 * k + 4] - e[4 * k + 3])) / 2 for k in range(0, 11)] AS m FROM opt)",
    "ex AS (SELECT vec_id, m, [exp(x - list_max(m)) for x in m] AS x FROM mg)",
    "wt AS (SELECT vec_id, m, [y / list_sum(x) for y in x] AS w FROM ex)",
    "made AS (SELECT vec_id, m, w, list_sum([(k - 1) * w[k] for k in range(1, 12)]) / 10 AS s FROM wt)",
    "held AS (SELECT vec_id, s + CASE WHEN vec_id % 2 = 0 THEN 1e-6 ELSE 0 END AS hs, [m[k] + CASE WHEN vec_id % 3 = 0 AND k = 7 THEN 1e-6 ELSE 0 END for k in range(1, 12)] AS hm, [w[k] + CASE WHEN vec_id % 5 = 0 AND k = 7 THEN 1e-6 ELSE 0 END for k in range(1, 12)] AS hw FROM made)",
)


@query(
    _with(A.OPTIONS, *_MADE)
    + "SELECT vec_id, hs BETWEEN 0 AND 1 AND abs(hs - s) < 1e-10 AND list_bool_and([abs(hm[k] - m[k]) < 1e-10 for k in range(1, 12)]) AND list_bool_and([abs(hw[k] - w[k]) < 1e-10 for k in range(1, 12)]) AS valid FROM made JOIN held USING (vec_id)"
)
def window_details(spark: SparkSession, d: str) -> DataFrame:
    """A stored window holds if its score, every margin and every weight are what its 22 rows give: here one of them is off in some windows."""
    rows = A.options(spark, d).withColumn("m", O.flat_margins("raw")).withColumn("w", O.softmax("m")).withColumn("s", O.flat_expectation("raw"))
    off = lambda a, k: F.transform(a, lambda x, i: F.when((F.col("vec_id") % k == 0) & (i == 6), x + 1e-6).otherwise(x))
    score = F.when(F.col("vec_id") % 2 == 0, F.col("s") + 1e-6).otherwise(F.col("s"))
    return rows.select("vec_id", O.window_valid(score, "raw", off("m", 3), off("w", 5)).alias("valid"))


@query(
    "SELECT count(*) AS lines, count(*) FILTER (o_orderkey % 10 = 0) AS short, sum(o_custkey % 97 + 1) FILTER (o_orderkey % 10 <> 0)::BIGINT AS frames, sum(ceil((o_custkey % 97 + 1) / 16)) FILTER (o_orderkey % 10 <> 0)::BIGINT AS windows FROM orders"
)
def dataset_counters(spark: SparkSession, d: str) -> DataFrame:
    """Index lines made of orders; every tenth lacks its last field."""
    line = F.expr("concat('clip_', o_orderkey, ' ', o_orderkey, ' ', o_orderkey + o_custkey % 97, if(o_orderkey % 10 = 0, '', ' 1'))")
    return rounded(Q.dataset_counters(A.table(spark, d, "orders").select(line.alias("value"))))


@query("SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS value FROM customer")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first order of each customer, met by a name that is derived on both sides."""
    names = A.table(spark, d, "customer").select(F.concat(F.lit("a/b/"), F.col("c_custkey").cast("string"), F.lit(".mp4")).alias("name"), "c_custkey")
    entries = A.table(spark, d, "orders").select(F.concat(F.lit("x/"), F.col("o_custkey").cast("string"), F.lit(".AVI")).alias("key"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("value"))
    return Q.first_match(names, entries).join(names, "name").select("c_custkey", "value")


@query(
    _with(A.CLIPS, "ft AS (SELECT video_id, round(center_frame / fps, 6) + CASE WHEN clip_idx % 5 = 0 THEN 3 ELSE 0 END AS t FROM clips)", "en AS (SELECT video_id, min(t) AS t0, (max(t) - min(t)) / 5 AS w FROM ft GROUP BY video_id)",
          "bn AS (SELECT video_id, t, t0, w, CASE WHEN w <= 0 THEN 0 ELSE least(floor((t - t0) / w + 1e-9), 4) END AS own FROM ft JOIN en USING (video_id))", "ks AS (SELECT unnest(range(0, 5)) AS k)")
    + "SELECT video_id, k AS bin, count(*) FILTER (own = k) AS n, round(arg_min(t, (own <> k, round(abs(t - (t0 + w * (k + 0.5))), 9), t)), 6) AS t FROM bn, ks GROUP BY video_id, k"
)
def temporal_bins(spark: SparkSession, d: str) -> DataFrame:
    t = F.round(F.col("center_frame") / F.col("fps"), 6) + F.when(F.col("clip_idx") % 5 == 0, 3).otherwise(0)
    return rounded(C.temporal_bins(A.clips(spark, d).select("video_id", t.alias("t"))))


@query(
    """SELECT n_nationkey::BIGINT AS nation, CASE n_nationkey % 5 WHEN 0 THEN n_name || ', it''s' WHEN 1 THEN n_name || ', b' WHEN 2 THEN 'none' WHEN 3 THEN n_name ELSE n_name || ', c d' END AS phrases FROM nation"""
)
def phrase_literals(spark: SparkSession, d: str) -> DataFrame:
    """Lists as literals: an escaped quote, round brackets, an empty list, no list, double quotes."""
    k, n = F.col("n_nationkey") % 5, F.col("n_name")
    said = (
        F.when(k == 0, F.concat(F.lit("['"), n, F.lit("', 'it\\'s']")))
        .when(k == 1, F.concat(F.lit("('"), n, F.lit("', 'b')")))
        .when(k == 2, F.lit("[]"))
        .when(k == 3, n)
        .otherwise(F.concat(F.lit('[ "'), n, F.lit('", " c d "]')))
    )
    return A.table(spark, d, "nation").select(big("n_nationkey", "nation"), X.phrase_list(said).alias("phrases"))


_PROMPTS = ", ".join(f"('{p.name}', '{p.system}', '{p.template}')" for p in P.PROMPTS.values())


@query(f"WITH p(name, system, template) AS (VALUES {_PROMPTS}) SELECT name, k AS level, system, replace(template, '{P.SLOT}', printf('%.1f', k / 10.0)) AS question FROM p, (SELECT unnest(range(1, 11)) AS k)")
def prompt_suite(spark: SparkSession, d: str) -> DataFrame:
    levels = F.broadcast(spark.range(1, 11).withColumnRenamed("id", "level"))
    return P.prompt_suite(spark).crossJoin(levels).select("name", "level", "system", X.rendered(F.col("template"), F.col("level") / 10.0).alias("question"))


@query(_with(A.CLIPS) + "SELECT video_id, center_frame, CASE WHEN clip_idx % 21 = 0 THEN 0.5 ELSE score END AS score, clip_idx % 21 = 0 AS failed, CASE WHEN clip_idx % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts FROM clips")
def resume_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two passes: each seventh clip fails at first and gets the default score and its error; the second pass tries only those, and most succeed, which drops the error."""
    c = A.clips(spark, d)

    def attempt(left: DataFrame, k: int, n: int) -> DataFrame:
        fails = F.col("clip_idx") % k == 0
        return left.select("video_id", "center_frame", F.when(fails, 0.5).otherwise(F.col("score")).alias("score"), F.when(fails, "no answer").alias("error"), F.lit(n).cast("bigint").alias("attempt"))

    first = attempt(c, 7, 1)
    done = Q.latest(first)
    tried = first.unionByName(attempt(Q.pending(c, done, done.where("error is not null")), 21, 2))
    counts = tried.groupBy("video_id", "center_frame").agg(F.count("*").alias("attempts"))
    return Q.latest(tried).join(counts, Q.KEYS).select("video_id", "center_frame", "score", F.col("error").isNotNull().alias("failed"), "attempts")
