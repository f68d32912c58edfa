"""How the driver's tables stand in for scored videos, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user of events is a video, an event a clip: video_id, clip_idx, center_frame, score, positive, fps."""
    e = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("video_id"), k.alias("clip_idx"), F.round(F.least(F.col("value") / 250, F.lit(1.0)), 6).alias("score"), (F.col("event_type") == "error").alias("positive"), (24 + F.col("user_id") % 7).cast("bigint").alias("fps")).withColumn("center_frame", F.col("clip_idx").cast("bigint") * 16)


CLIPS = """clips AS (SELECT *, 16 * clip_idx AS center_frame FROM (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS clip_idx,
round(least(value / 250, 1.0), 6) AS score, event_type = 'error' AS positive, 24 + user_id % 7 AS fps FROM events))"""


def index(c: DataFrame) -> DataFrame:
    """Videos from frame 0; even ones end 5 frames after their last clip, odd ones some frames before."""
    extra = F.when(F.col("video_id") % 2 == 0, 5).otherwise(-(F.col("video_id") % 11))
    return c.groupBy("video_id").agg(F.count("*").alias("n")).select("video_id", F.lit(0).cast("bigint").alias("start_frame"), (F.col("n") * 16 - 1 + extra).cast("bigint").alias("end_frame"))


INDEX = "idx AS (SELECT video_id, 0::BIGINT AS start_frame, 16 * count(*) - 1 + CASE WHEN video_id % 2 = 0 THEN 5 ELSE -(video_id % 11) END AS end_frame FROM clips GROUP BY video_id)"


def intervals(c: DataFrame) -> DataFrame:
    """Each longest run of positive clips is an interval: video_id, ordinal, start, stop."""
    by = Window.partitionBy("video_id")
    p = c.where("positive").withColumn("g", F.col("clip_idx") - F.row_number().over(by.orderBy("clip_idx")))
    r = p.groupBy("video_id", "g").agg((F.min("clip_idx") * 16).cast("bigint").alias("start"), (F.max("clip_idx") * 16 + 15).cast("bigint").alias("stop"))
    return r.withColumn("ordinal", F.row_number().over(by.orderBy("start")) - 1).drop("g")


INTERVALS = """ivs AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start) - 1 AS ordinal, start, stop FROM
(SELECT video_id, 16 * min(clip_idx) AS start, 16 * max(clip_idx) + 15 AS stop FROM (SELECT *, clip_idx - row_number() OVER (PARTITION BY video_id ORDER BY clip_idx) AS g FROM clips WHERE positive) GROUP BY video_id, g))"""


def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, tail: ten tail probabilities from the first ten coordinates of a vector."""
    d = F.transform(F.slice("embedding", 1, 10), lambda x: F.round(1.0 / (1.0 + F.exp(-8.0 * x.cast("double"))), 9))
    return table(spark, sf_dir, "embeddings").select("vec_id", d.alias("tail"))


TAILS = "tails AS (SELECT vec_id, [round(1 / (1 + exp(-8 * x::DOUBLE)), 9) for x in embedding[1:10]] AS tail FROM embeddings)"
#: PAVA of the column tail as g, by the min-max formula over prefix sums.
PAVA = """ps AS (SELECT *, [list_sum(tail[1:k])::DOUBLE for k in range(0, 11)] AS s FROM {0}),
pava AS (SELECT * EXCLUDE (s), [list_min([list_max([(s[j + 1] - s[i]) / (j - i + 1) for j in range(k, 11)]) for i in range(1, k + 1)]) for k in range(1, 11)] AS g
FROM (SELECT * REPLACE ([coalesce(x, 0) for x in s] AS s) FROM ps))"""


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, raw: 22 (a, b) answers from coordinates 1-44, forward and swapped in turn."""
    e = F.transform("embedding", lambda x: F.round(x.cast("double") * 4, 5))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda k: F.struct(F.get("e", 2 * k).alias("a"), F.get("e", 2 * k + 1).alias("b")))
    return rows.select("vec_id", raw.alias("raw"))


OPTIONS = "opt AS (SELECT vec_id, [round(x::DOUBLE * 4, 5) for x in embedding] AS e FROM embeddings)"


def weighted(c: DataFrame, idx: DataFrame, ivs: DataFrame) -> DataFrame:
    from ..operators.frames import weighted_rows

    return weighted_rows(c, idx, ivs)


#: Weighted rows of clips (video_id, clip_idx, score): pos and neg frames, and a row of score 0 for frames beyond the last clip.
WEIGHTED = """blocks AS (SELECT c.video_id, c.clip_idx, c.score, 16 * c.clip_idx AS a, least(16 * c.clip_idx + 16, end_frame + 1) AS z FROM {0} c JOIN idx USING (video_id)
UNION ALL SELECT video_id, -1, 0.0, 16 * count(*), any_value(end_frame) + 1 FROM {0} JOIN idx USING (video_id) GROUP BY video_id),
w0 AS (SELECT b.video_id, b.clip_idx, b.score, b.z - b.a AS n, coalesce(sum(least(i.stop + 1, b.z) - greatest(i.start, b.a)) FILTER (i.start IS NOT NULL), 0)::BIGINT AS pos
FROM blocks b LEFT JOIN ivs i ON b.video_id = i.video_id AND i.start < b.z AND i.stop >= b.a WHERE b.a < b.z GROUP BY b.video_id, b.clip_idx, b.score, b.a, b.z),
w AS (SELECT video_id, clip_idx, score, pos, (n - pos)::BIGINT AS neg FROM w0)"""

#: Curve of rows (score, pos, neg), by groups {1} ("" or "x, "), and the metrics m.
METRICS = """cv AS (SELECT {1}score, sum(pos) AS pos, sum(neg) AS neg FROM {0} GROUP BY {1}score),
cr AS (SELECT *, sum(pos) OVER ({2} ORDER BY score DESC) AS tp, sum(neg) OVER ({2} ORDER BY score DESC) AS fp, sum(pos) OVER ({2}) AS P, sum(neg) OVER ({2}) AS N FROM cv),
cf AS (SELECT *, tp / nullif(P, 0)::DOUBLE AS rec, tp / (tp + fp)::DOUBLE AS prec, coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0)::DOUBLE, 1.0) AS prec0, fp / nullif(N, 0)::DOUBLE AS fpr FROM cr),
cg AS (SELECT *, 2 * prec * rec / (prec + rec + 1e-8) AS f1 FROM cf),
m AS (SELECT {1}sum(neg * (2 * tp - pos) / 2.0) / any_value(P) / any_value(N) AS roc_auc, sum(pos / P::DOUBLE * (prec + prec0) / 2.0) AS pr_auc, max(f1) AS max_f1,
arg_max(score, (f1, -score)) AS f1_threshold, CASE WHEN max(rec - fpr) > 0 THEN arg_max(score, (rec - fpr, score)) END AS youden_threshold, any_value(P)::BIGINT AS positives, any_value(N)::BIGINT AS negatives FROM cg {3})"""


def metrics_sql(rows: str, by: str = "") -> str:
    return METRICS.format(rows, f"{by}, " if by else "", f"PARTITION BY {by}" if by else "", f"GROUP BY {by}" if by else "")


#: Gaussian smoothing of clips with radius r = floor(4 sigma + 0.5) as sm.
SMOOTH = """kern AS (SELECT o, exp(-o * o / (2.0 * {1} * {1})) / sum(exp(-o * o / (2.0 * {1} * {1}))) OVER () AS kw FROM (SELECT unnest(range(-{2}, {2} + 1)) AS o)),
cn AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM {0}),
sm AS (SELECT a.video_id, a.clip_idx, a.center_frame, a.fps, a.positive, sum(kw * b.score) AS score FROM
(SELECT *, CASE WHEN mm < n THEN mm ELSE 2 * n - 1 - mm END AS src FROM (SELECT *, ((clip_idx + o) % (2 * n) + 2 * n) % (2 * n) AS mm FROM cn, kern)) a
JOIN cn b ON a.video_id = b.video_id AND a.src = b.clip_idx GROUP BY a.video_id, a.clip_idx, a.center_frame, a.fps, a.positive)"""


def smooth_sql(sigma: float, source: str = "clips") -> str:
    return SMOOTH.format(source, float(sigma), int(4 * sigma + 0.5))
