"""Queries over the driver's tables: each name with its Spark plan and, where there is one, its SQL. Floats are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import ordinal as O, prompts as P, text as X
from ..operators import balance as B, clips as C, diagnostics as D, frames as R, fusion as U, metrics as M, quality as Q, sampling as S, smoothing as G
from ..sources import readers, writers
from . import adapters as A, runs as N

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None, places: int = 6) -> Column:
    x = F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)
    return x.alias(name or (c if isinstance(c, str) else "x"))


def big(c: Column | str, name: str | None = None) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or (c if isinstance(c, str) else "x"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, integers as BIGINT: the types of the SQL side."""
    kinds = dict(df.dtypes)
    return df.select(*[r6(c, c, places) if kinds[c] in ("double", "float") else big(c) if kinds[c] in ("int", "bigint") or kinds[c].startswith("decimal") else F.col(c) for c in df.columns])


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# sources

_LINES = "concat('set/clip_', {k}, CASE {k} % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.v1.MKV' ELSE '.part' END, '  ', o_custkey, ' ', o_custkey + {k} % 97, ' 1,', {k} % 5)"


@query(
    """SELECT 'clip_' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.v1' ELSE '.part' END AS video_id, o_custkey AS start_frame, o_custkey + o_orderkey % 97 AS end_frame,
'1;' || o_orderkey % 5 AS labels, o_orderkey % 97 + 1 AS frames FROM orders"""
)
def index_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = A.table(spark, d, "orders").select(F.expr(_LINES.format(k="o_orderkey")).alias("value"))
    i = readers.parsed_index(lines)
    return i.select("video_id", "start_frame", "end_frame", F.array_join(F.col("labels").cast("array<string>"), ";").alias("labels"), (F.col("end_frame") - F.col("start_frame") + 1).alias("frames"))


_NOTES = "concat('v', o_orderkey % 400, '.mp4 Event ', o_custkey, ' ', o_custkey + 20, ' ', CASE WHEN o_orderkey % 2 = 0 THEN '-1 -1' ELSE concat(o_custkey + 30, ' ', o_custkey + 40) END)"


@query(
    """WITH l AS (SELECT o_orderkey % 400 AS k, arg_max(o_custkey, o_orderkey) AS c, max(o_orderkey) AS o FROM orders GROUP BY 1)
SELECT 'v' || k AS video_id, 0::BIGINT AS ordinal, c AS start, c + 20 AS stop FROM l UNION ALL SELECT 'v' || k, 1, c + 30, c + 40 FROM l WHERE o % 2 = 1"""
)
def annotation_intervals(spark: SparkSession, d: str) -> DataFrame:
    lines = A.table(spark, d, "orders").select(F.expr(_NOTES).alias("value"), F.col("o_orderkey").alias("line"))
    return readers.parsed_annotations(lines).select("video_id", big("ordinal"), "start", "stop")


@query(_with(A.CLIPS) + "SELECT 'u.' || video_id AS video_id, center_frame, score FROM clips")
def score_map_explode(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON maps and read again, with one unreadable file."""
    files = writers.score_maps(A.clips(spark, d)).select(F.concat(F.lit("out/u."), F.col("video_id").cast("string"), F.lit(".json")).alias("name"), "value")
    bad = spark.createDataFrame([("out/bad.json", "{not json"), ("out/text.json", '"x"')], "name string, value string")
    return readers.score_map(files.unionByName(bad))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS text FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def text_map_explode(spark: SparkSession, d: str) -> DataFrame:
    files = A.table(spark, d, "events").select(F.col("event_id").cast("string").alias("name"), F.col("props").alias("value"))
    return readers.text_map(files).select(F.col("video_id").cast("bigint").alias("event_id"), "key", "text")


@query(_with(A.TAILS, A.PAVA.format("tails")) + "SELECT vec_id, 0::BIGINT AS center_frame, round(list_sum(tail) / 10, 6) AS raw_mean, round(list_sum(g) / 10, 6) AS pava_mean, 10::BIGINT AS entries FROM pava")
def details_parse(spark: SparkSession, d: str) -> DataFrame:
    """Detail files as JSON, read with their schema; the score from raw and from projected probabilities."""
    t = A.tails(spark, d)
    entries = F.transform("tail", lambda x, k: F.struct(((k + 1) / 10).alias("threshold"), F.lit(0.0).alias("yes_loglik"), F.lit(0.0).alias("no_loglik"), x.alias("tail_probability")))
    body = F.struct(entries.alias("thresholds"), O.pava("tail").alias("monotonic_tail_probabilities"), O.violations("tail").alias("monotonic_violations"), O.tail_score("tail").alias("score"))
    files = t.select(F.col("vec_id").cast("string").alias("name"), F.to_json(F.create_map(F.lit("0"), body, F.lit("_note"), F.lit(None))).alias("value"))
    got = readers.details(files)
    raw = F.transform("thresholds", lambda e: e["tail_probability"])
    return got.select(F.col("video_id").cast("bigint").alias("vec_id"), "center_frame", r6(O.mean(raw), "raw_mean"), r6(O.mean(F.col("monotonic")), "pava_mean"), big(F.size("thresholds"), "entries"))


@query("SELECT 'v' || p_partkey AS video_id, p_name AS img_path, p_size::DOUBLE AS x1, p_size + 1.0 AS y1, p_size + 2.5 AS x2, p_size * 2.0 AS y2 FROM part")
def boxes_explode(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    box = F.array("p_name", *[c.cast("string") for c in (F.col("p_size"), F.col("p_size") + 1, F.col("p_size") + 2.5, F.col("p_size") * 2)])
    return readers.boxes(p.select(F.to_json(F.create_map(F.concat(F.lit("v"), F.col("p_partkey").cast("string")), F.array(box))).alias("value")))


@query("SELECT p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS metric FROM part")
def metric_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.concat(F.lit(" "), F.round("p_retailprice", 2).cast("string"), F.lit("\n")))
    return readers.metric_value(A.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), text.alias("value"))).select("name", r6("metric", places=2))


@query(
    """SELECT 'd/n' || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'root/d/n' || p_partkey || '.mp4' WHEN 1 THEN 'root/n' || p_partkey WHEN 2 THEN 'root/n' || p_partkey || '.mkv' END AS path FROM part WHERE p_partkey % 4 < 3"""
)
def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part").select("p_partkey", F.concat(F.lit("d/n"), F.col("p_partkey").cast("string")).alias("name"))
    there = p.select(F.explode(F.expr("case p_partkey % 4 when 0 then array(concat('root/d/n', p_partkey, '.mp4'), concat('root/n', p_partkey)) when 1 then array(concat('root/n', p_partkey)) when 2 then array(concat('root/n', p_partkey, '.mkv')) else array(concat('other/', p_partkey)) end")).alias("path"))
    return readers.resolved_paths(p.select("name"), there, "root")


# clips


def _videos(c: DataFrame) -> DataFrame:
    return c.groupBy("video_id").agg(F.first("fps").alias("fps"), (F.count("*") * 16 - 3).alias("frame_count"))


_VIDEOS = "videos AS (SELECT video_id, any_value(fps) AS fps, 16 * count(*) - 3 AS frame_count FROM clips GROUP BY video_id)"
_WINDOWS = """wins AS (SELECT video_id, k AS clip_idx, 16 * k AS center_frame, greatest(0, 16 * k / fps::DOUBLE - 5) AS start_time, least(frame_count / fps::DOUBLE, 16 * k / fps::DOUBLE + 5) AS end_time, fps
FROM (SELECT *, unnest(range(0, (frame_count + 15) // 16)) AS k FROM videos))"""


@query(_with(A.CLIPS, _VIDEOS, _WINDOWS) + "SELECT video_id, clip_idx, center_frame, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM wins")
def clip_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.clip_windows(_videos(A.clips(spark, d))))


@query(
    _with(A.CLIPS, _VIDEOS, _WINDOWS)
    + """SELECT video_id, clip_idx, round(CASE WHEN end_time - start_time <= 4 THEN start_time ELSE least(greatest(center_frame / fps::DOUBLE - 2, start_time), end_time - 4) END, 6) AS first,
round(CASE WHEN end_time - start_time <= 4 THEN end_time ELSE least(greatest(center_frame / fps::DOUBLE - 2, start_time), end_time - 4) + 4 END, 6) AS last FROM wins"""
)
def center_dense_interval(spark: SparkSession, d: str) -> DataFrame:
    v = _videos(A.clips(spark, d))
    w = C.clip_windows(v).join(v.select("video_id", "fps"), "video_id")
    a, z = C.shifted_interval(F.col("start_time"), F.col("end_time"), F.col("center_frame") / F.col("fps"), 4.0)
    return w.select("video_id", big("clip_idx"), r6(a, "first"), r6(z, "last"))


@query(_with(A.CLIPS, _VIDEOS) + "SELECT video_id, k AS position, round(k * frame_count / fps / 4.0, 6) AS target FROM videos, (SELECT unnest(range(0, 5)) AS k)")
def uniform_targets(spark: SparkSession, d: str) -> DataFrame:
    v = _videos(A.clips(spark, d))
    return v.select("video_id", F.posexplode(C.uniform_targets(F.lit(0.0), F.col("frame_count") / F.col("fps"), 5)).alias("position", "target")).select("video_id", big("position"), r6("target"))


@query(
    _with(A.CLIPS)
    + """SELECT video_id, center_frame, score, rank, round(rank / greatest(n - 1, 1)::DOUBLE, 6) AS percentile FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score, center_frame) - 1 AS rank, count(*) OVER (PARTITION BY video_id) AS n FROM clips)
WHERE rank >= floor(0.3 * n) AND rank < greatest(ceil(0.55 * n), floor(0.3 * n) + 1)"""
)
def percentile_band(spark: SparkSession, d: str) -> DataFrame:
    # rounded as a product, like the SQL: 323 / 640 is a tie in decimals, but as a double a little less, which r6 does not see
    percentile = F.round(F.col("percentile") * 1e6) / 1e6
    return C.percentile_band(A.clips(spark, d), 0.3, 0.55).select("video_id", "center_frame", "score", big("rank"), percentile.alias("percentile"))


@query(
    _with(A.CLIPS, "b AS (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS budget)", "rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, video_id * 10000 + clip_idx) AS k, count(*) OVER () AS n, sum(positive::INT) OVER () AS t FROM clips)")
    + """SELECT budget, round(any_value(ceil(n * budget)) / any_value(n), 6) AS audit_fraction, count(*) AS audited_clips, sum(positive::INT)::BIGINT AS covered_fn_clips, any_value(t)::BIGINT AS total_fn_clips,
round(sum(positive::INT) / any_value(t), 6) AS fn_recall, round(sum(positive::INT) / count(*), 6) AS audit_clip_error_rate, round((sum(positive::INT) / count(*)) / (any_value(t) / any_value(n)), 6) AS error_enrichment FROM rk, b WHERE k <= greatest(1, ceil(n * budget)) GROUP BY budget"""
)
def top_budget(spark: SparkSession, d: str) -> DataFrame:
    c = A.clips(spark, d).select("score", F.col("positive").cast("int").alias("hit"), (F.col("video_id") * 10000 + F.col("clip_idx")).alias("seq"))
    return rounded(C.top_budget(c, [0.05, 0.1, 0.2], "score", "hit", "seq"))


_EXTREME = """ex0 AS (SELECT a.video_id, a.center_frame AS s, any_value(a.w) AS w, round(avg(b.score), 9) AS av FROM (SELECT *, greatest(max(center_frame) OVER (PARTITION BY video_id) // 10, 300) AS w FROM clips) a
JOIN clips b ON a.video_id = b.video_id AND b.center_frame >= a.center_frame AND b.center_frame < a.center_frame + a.w GROUP BY a.video_id, a.center_frame),
ex AS (SELECT video_id, arg_max(s, (av, -s)) AS highest_start, arg_max(s + w, (av, -s)) AS highest_end, max(av) AS highest_avg, arg_min(s, (av, s)) AS lowest_start, arg_min(s + w, (av, s)) AS lowest_end, min(av) AS lowest_avg FROM ex0 GROUP BY video_id)"""


@query(_with(A.CLIPS, _EXTREME) + "SELECT video_id, highest_start, highest_end, round(highest_avg, 6) AS highest_avg, lowest_start, lowest_end, round(lowest_avg, 6) AS lowest_avg FROM ex")
def extreme_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.extreme_intervals(A.clips(spark, d)))


_STATS = """gs0 AS (SELECT video_id, score::FLOAT::DOUBLE AS v, abs(score::FLOAT::DOUBLE - highest_avg) <= abs(score::FLOAT::DOUBLE - lowest_avg) AS hi FROM clips JOIN ex USING (video_id)),
gs AS (SELECT video_id, stddev_pop(v) AS std, coalesce(avg(v) FILTER (hi), avg(v)) AS avg_high, coalesce(avg(v) FILTER (NOT hi), avg(v)) AS avg_low FROM gs0 GROUP BY video_id)"""


@query(_with(A.CLIPS, _EXTREME, _STATS) + "SELECT video_id, round(std, 6) AS std, round(avg_high, 6) AS avg_high, round(avg_low, 6) AS avg_low, round(avg_high - avg_low, 6) AS gap FROM gs")
def group_stats(spark: SparkSession, d: str) -> DataFrame:
    c = A.clips(spark, d)
    return rounded(D.group_stats(c, C.extreme_intervals(c)))


@query(_with(A.CLIPS, _EXTREME, _STATS) + "SELECT video_id, round(highest_avg, 6) AS highest_avg FROM ex JOIN gs USING (video_id) WHERE highest_avg BETWEEN greatest(0, 0.5 - std * std) AND least(1, 0.5 + std * std)")
def adaptive_gate(spark: SparkSession, d: str) -> DataFrame:
    c = A.clips(spark, d)
    ex = C.extreme_intervals(c)
    return rounded(D.adaptive_gate(D.group_stats(c, ex).join(ex, "video_id")).select("video_id", "highest_avg"))


@query(_with(A.CLIPS) + "SELECT video_id, (row_number() OVER (ORDER BY video_id) - 1) % 7 AS job FROM (SELECT DISTINCT video_id FROM clips)")
def job_split_stride(spark: SparkSession, d: str) -> DataFrame:
    return C.job_stride(A.clips(spark, d).select("video_id").distinct(), 7, ["video_id"]).select("video_id", big("job"))


@query(_with(A.CLIPS) + "SELECT video_id, ntile(7) OVER (ORDER BY video_id) - 1 AS job FROM (SELECT DISTINCT video_id FROM clips)")
def job_split_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return C.job_contiguous(A.clips(spark, d).select("video_id").distinct(), 7, ["video_id"]).select("video_id", big("job"))


_LPT = """wk AS (SELECT video_id::VARCHAR AS video_id, count(*) AS work FROM clips WHERE positive GROUP BY 1), sk AS (SELECT *, row_number() OVER (ORDER BY work DESC, video_id DESC) AS k FROM wk),
lp AS (SELECT 0::BIGINT AS k, '' AS video_id, 0::BIGINT AS work, 0::BIGINT AS p, [0, 0, 0, 0]::BIGINT[] AS loads
UNION ALL SELECT sk.k, sk.video_id, sk.work, list_position(loads, list_min(loads)), list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + sk.work ELSE x END) FROM lp JOIN sk ON sk.k = lp.k + 1)"""


@query("WITH RECURSIVE " + A.CLIPS + ", " + _LPT + " SELECT video_id, work, p - 1 AS job FROM lp WHERE k > 0")
def lpt_balance(spark: SparkSession, d: str) -> DataFrame:
    """Greedy balance of the clips left to score in each video."""
    c = A.clips(spark, d)
    left = Q.pending(c.select("video_id", "center_frame"), c.where("not positive").select("video_id", "center_frame"), c.limit(0).select("video_id", "center_frame"))
    work = left.groupBy(F.col("video_id").cast("string").alias("name")).agg(F.count("*").alias("work"))
    return B.balanced_jobs(work, 4).select(F.col("name").alias("video_id"), "work", big("job"))


def _nearest(target: str, more: str = "") -> str:
    return f"(list_min([{{'d': abs(t[i + 1] - ({target})), 'i': i}} for i in range(0, 20) if NOT list_contains(taken, i){more}])).i"


_PICK = f"""cd AS (SELECT video_id * 100000 + clip_idx AS key, [start_time + (end_time - start_time) * k / 19 for k in range(0, 20)] AS t, center_frame / fps::DOUBLE AS c,
CASE WHEN end_time - start_time <= 4 THEN start_time ELSE least(greatest(center_frame / fps::DOUBLE - 2, start_time), end_time - 4) END AS a,
CASE WHEN end_time - start_time <= 4 THEN end_time ELSE least(greatest(center_frame / fps::DOUBLE - 2, start_time), end_time - 4) + 4 END AS z FROM wins),
st AS (SELECT *, 1 AS step, []::BIGINT[] AS taken, []::DOUBLE[] AS missed FROM cd UNION ALL
SELECT key, t, c, a, z, step + 1, CASE WHEN i IS NULL THEN taken ELSE list_append(taken, i) END, CASE WHEN i IS NULL AND step BETWEEN 5 AND 10 THEN list_append(missed, a + (z - a) * (step - 5) / 5) ELSE missed END FROM
(SELECT *, CASE WHEN step <= 4 THEN {_nearest('t[1] + (t[20] - t[1]) * (step - 1) / 3')} WHEN step <= 10 THEN {_nearest('a + (z - a) * (step - 5) / 5', ' AND t[i + 1] >= a - 1e-9 AND t[i + 1] <= z + 1e-9')}
WHEN step - 10 <= len(missed) THEN {_nearest('missed[step - 10]')} WHEN len(taken) < 10 THEN {_nearest('c')} END AS i FROM st WHERE step <= 26))
"""


@query("WITH RECURSIVE " + ",\n".join([A.CLIPS, _VIDEOS, _WINDOWS, _PICK]) + "SELECT key, list_transform(list_sort(list_transform(taken, lambda i: {'t': t[i + 1], 'i': i})), lambda x: x.i) AS indices FROM st WHERE step = 27")
def center_dense_select(spark: SparkSession, d: str) -> DataFrame:
    v = _videos(A.clips(spark, d))
    w = C.clip_windows(v).join(v.select("video_id", "fps"), "video_id")
    mid = F.col("center_frame") / F.col("fps")
    a, z = C.shifted_interval(F.col("start_time"), F.col("end_time"), mid, 4.0)
    got = S.dense_selected(w.select((F.col("video_id") * 100000 + F.col("clip_idx")).alias("key"), C.uniform_targets(F.col("start_time"), F.col("end_time"), 20).alias("times"), mid.alias("center"), a.alias("start"), z.alias("end")))
    return got.select("key", F.col("indices").cast("array<bigint>").alias("indices"))


@query()
def frame_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return S.shuffled(A.clips(spark, d).groupBy(F.col("video_id").alias("key")).agg(F.sort_array(F.collect_list("center_frame")).alias("frames")))


@query(
    """SELECT vec_id, [x[1], x[4], x[2], x[5], x[3], x[6]] AS woven, [x[5], x[6], x[4]] AS turned, x[4] AS mid FROM (SELECT vec_id, [round(v::DOUBLE, 6) + 0.0 for v in embedding[1:6]] AS x FROM embeddings)"""
)
def frame_orders(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda v: F.round(v.cast("double"), 6) + F.lit(0.0)).alias("x"))
    a, b = F.slice("x", 1, 3), F.slice("x", 4, 3)
    return e.select("vec_id", S.interleaved(a, b).alias("woven"), S.rotated(b).alias("turned"), F.get(S.middle(F.col("x")), F.lit(0)).alias("mid"))


# ordinal scores


@query(_with(A.TAILS, A.PAVA.format("tails")) + "SELECT vec_id, k AS level, round(g[k], 6) AS value FROM pava, (SELECT unnest(range(1, 11)) AS k)")
def pava_projection(spark: SparkSession, d: str) -> DataFrame:
    return A.tails(spark, d).select("vec_id", F.posexplode(O.pava("tail")).alias("k", "value")).select("vec_id", big(F.col("k") + 1, "level"), r6("value"))


_TAIL = "list_sum([(tail[k] < tail[k + 1])::INT for k in range(1, 10)])::BIGINT AS violations"


@query(_with(A.TAILS, A.PAVA.format("tails")) + f"SELECT vec_id, {_TAIL}, round(list_sum(g) / 10, 6) AS score, round(list_sum(tail) / 10, 6) AS raw FROM pava")
def tail_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.tails(spark, d).select("vec_id", O.violations("tail").alias("violations"), O.tail_score("tail").alias("score"), O.tail_score("tail", False).alias("raw")))


@query(
    _with(A.TAILS, "five AS (SELECT vec_id, [tail[2], tail[4], tail[6], tail[8], tail[10]] AS tail FROM tails)", A.PAVA.format("five").replace("range(0, 11)", "range(0, 6)").replace("range(k, 11)", "range(k, 6)").replace("range(1, 11)", "range(1, 6)"))
    + "SELECT vec_id, round(list_sum(g) / 5, 6) AS score, round(g[1], 6) AS first FROM pava"
)
def threshold5_rescore(spark: SparkSession, d: str) -> DataFrame:
    t = A.tails(spark, d).select("vec_id", F.transform("tail", lambda x, k: F.struct(((k + 1) / 10).alias("threshold"), x.alias("tail_probability"))).alias("e"))
    five = O.pava(F.array(*[O.value_at("e", x) for x in (0.2, 0.4, 0.6, 0.8, 1.0)]))
    return t.select("vec_id", r6(O.mean(five), "score"), r6(F.get(five, F.lit(0)), "first"))


@query(
    _with(A.OPTIONS)
    + "SELECT vec_id, round(((e[1] - e[2]) + (e[4] - e[3])) / 2, 6) AS margin, round(1 / (1 + exp(-((e[1] - e[2]) + (e[4] - e[3])) / 2)), 6) AS probability, round(1 / (1 + exp(-(e[1] - e[2]))), 6) AS one_way FROM opt"
)
def ab_swap_margin(spark: SparkSession, d: str) -> DataFrame:
    o = A.options(spark, d).select("vec_id", F.col("raw")[0].alias("f"), F.col("raw")[1].alias("s"))
    m = O.swap_margin("f.a", "f.b", "s.a", "s.b")
    return o.select("vec_id", r6(m, "margin"), r6(O.sigmoid(m), "probability"), r6(O.sigmoid(O.swap_margin("f.a", "f.b")), "one_way"))


@query(_with(A.OPTIONS) + "SELECT vec_id, k AS position, round(1 / (1 + exp(-((e[4 * k + 1] - e[4 * k + 2]) + (e[4 * k + 4] - e[4 * k + 3])) / 2)), 6) AS probability FROM opt, (SELECT unnest(range(0, 10)) AS k)")
def polarity_margin(spark: SparkSession, d: str) -> DataFrame:
    """YES/NO and the complement question: ((Y - N) + (N' - Y')) / 2 for ten thresholds."""
    m = O.flat_margins("raw")
    return A.options(spark, d).select("vec_id", F.posexplode(F.slice(m, 1, 10)).alias("position", "m")).select("vec_id", big("position"), r6(O.sigmoid("m"), "probability"))


@query(
    _with(A.OPTIONS, "mg AS (SELECT vec_id, [((e[4 * k + 1] - e[4 * k + 2]) + (e[4 * k + 4] - e[4 * k + 3])) / 2 for k in range(0, 11)] AS m FROM opt)", "sx AS (SELECT vec_id, m, [exp(x - list_max(m)) for x in m] AS x FROM mg)")
    + "SELECT vec_id, round(list_sum([(k - 1) * x[k] for k in range(1, 12)]) / list_sum(x) / 10, 6) AS score FROM sx"
)
def flat11_expectation(spark: SparkSession, d: str) -> DataFrame:
    return A.options(spark, d).select("vec_id", r6(O.flat_expectation("raw"), "score"))


@query(
    _with(A.OPTIONS, "mg AS (SELECT vec_id, [x / 2 for x in e[1:11]] AS m FROM opt)", "sx AS (SELECT vec_id, m, [exp(x - list_max(m)) for x in m] AS x FROM mg)")
    + "SELECT vec_id, round(list_sum([(k - 1) * x[k] for k in range(1, 12)]) / list_sum(x) / 10, 6) AS score FROM sx"
)
def ordinal_expectation(spark: SparkSession, d: str) -> DataFrame:
    ll = F.flatten(F.transform("raw", lambda r: F.array(r["a"], r["b"])))
    return A.options(spark, d).select("vec_id", r6(O.expectation(F.slice(ll, 1, 11), 2.0), "score"))


@query(
    _with(A.OPTIONS)
    + """SELECT vec_id, round(1 / (1 + exp(-(e[1] - e[2]) / 2)), 6) AS yes, round(list_sum(e[1:5]), 6) + 0.0 AS total, round(list_sum(e[1:5]) / 5, 6) + 0.0 AS average,
round(e[1] - (list_max(e[1:5]) + ln(list_sum([exp(x - list_max(e[1:5])) for x in e[1:5]]))), 6) AS log_first FROM opt"""
)
def log_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    o = A.options(spark, d).select("vec_id", F.slice(F.flatten(F.transform("raw", lambda r: F.array(r["a"], r["b"]))), 1, 5).alias("e"))
    return rounded(o.select("vec_id", O.yes_probability(F.col("e")[0], F.col("e")[1], 2.0).alias("yes"), O.sequence_log_likelihood("e").alias("total"), O.sequence_log_likelihood("e", True).alias("average"), O.log_softmax("e")[0].alias("log_first")))


@query(
    """WITH p AS (SELECT d.doc_id, string_split(d.text, ' ') AS a, string_split(before.text, ' ') AS b FROM documents d JOIN documents before ON d.doc_id = before.doc_id + 1)
SELECT doc_id, coalesce(list_min([k for k in range(1, least(len(a), len(b)) + 1) if a[k] <> b[k]]) - 1, least(len(a), len(b)))::BIGINT AS shared FROM p"""
)
def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Words that a document shares with the one whose id is one less, from the start."""
    t = A.table(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("w"))
    before = t.select((F.col("doc_id") + 1).alias("doc_id"), F.col("w").alias("b"))
    return t.join(before, "doc_id").select("doc_id", big(O.common_prefix("w", "b"), "shared"))


_CLIP = "greatest(1e-12, least(1 - 1e-12, x))"


@query(_with(A.TAILS) + f"SELECT vec_id, round(list_sum([-{_CLIP} * ln({_CLIP}) - (1 - {_CLIP}) * ln(1 - {_CLIP}) for x in tail]) / 10 / ln(2), 6) AS entropy FROM tails")
def binary_entropy(spark: SparkSession, d: str) -> DataFrame:
    return A.tails(spark, d).select("vec_id", r6(O.binary_entropy("tail"), "entropy"))


_MASS = "[1 - g[1], g[1] - g[2], g[2] - g[3], g[3] - g[4], g[4] - g[5], g[5] - g[6], g[6] - g[7], g[7] - g[8], g[8] - g[9], g[9] - g[10], g[10]]"
_ORD = f"""om AS (SELECT vec_id, [greatest(0, least(1, x)) for x in {_MASS}] AS ms FROM pava),
oe AS (SELECT vec_id, CASE WHEN list_sum(ms) <= 1e-12 THEN 0 ELSE list_sum([CASE WHEN x > 0 THEN -(x / list_sum(ms)) * ln(x / list_sum(ms)) ELSE 0 END for x in ms]) / ln(11) END AS entropy FROM om)"""


@query(_with(A.TAILS, A.PAVA.format("tails"), _ORD) + "SELECT vec_id, round(entropy, 6) AS entropy FROM oe")
def ordinal_entropy(spark: SparkSession, d: str) -> DataFrame:
    return A.tails(spark, d).select("vec_id", r6(O.ordinal_entropy(O.pava("tail")), "entropy"))


_CORR = f"""cx AS (SELECT vec_id, {_TAIL}, list_sum([abs(tail[k] - g[k]) for k in range(1, 11)]) / 10 AS pava_l1, sqrt(list_sum([(tail[k] - g[k]) * (tail[k] - g[k]) for k in range(1, 11)]) / 10) AS pava_l2,
list_max([abs(tail[k] - g[k]) for k in range(1, 11)]) AS pava_max FROM pava)"""


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    t = A.tails(spark, d).withColumn("g", O.pava("tail"))
    return t.select("vec_id", O.violations("tail").alias("violations"), *[c.alias(n) for n, c in O.corrections("tail", "g").items()])


@query(_with(A.TAILS, A.PAVA.format("tails"), _CORR) + "SELECT vec_id, violations, round(pava_l1, 6) AS pava_l1, round(pava_l2, 6) AS pava_l2, round(pava_max, 6) AS pava_max FROM cx")
def pava_corrections(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_corrected(spark, d))


@query(
    _with(A.TAILS, A.PAVA.format("tails"), _CORR)
    + "SELECT count(*) AS clips, round(avg((violations > 0)::INT), 6) AS violating, round(avg(violations), 6) AS mean_violations, max(violations)::BIGINT AS max_violations, round(avg(pava_l1), 6) AS mean_l1, round(avg(pava_l2), 6) AS mean_l2, round(max(pava_max), 6) AS max_change FROM cx"
)
def pava_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.pava_summary(_corrected(spark, d)))


@query(_with(A.TAILS, A.PAVA.format("tails")) + "SELECT vec_id, k AS band, round(g[k] - g[k + 1], 6) + 0.0 AS value FROM pava, (SELECT unnest(range(1, 10)) AS k)")
def severity_bands(spark: SparkSession, d: str) -> DataFrame:
    return A.tails(spark, d).select("vec_id", F.posexplode(O.bands(O.pava("tail"))).alias("k", "value")).select("vec_id", big(F.col("k") + 1, "band"), r6("value"))


@query("SELECT doc_id, substr(sha256('17:' || source || ':' || doc_id), 1, 8) AS head, (('0x' || substr(sha256('17:' || source || ':' || doc_id), 1, 15))::BIGINT) AS seed FROM documents")
def stable_seed(spark: SparkSession, d: str) -> DataFrame:
    """The seed of 64 bits, without its last hex digit so that it fits a BIGINT."""
    seed = O.stable_seed(F.lit("17"), F.col("source"), F.col("doc_id").cast("string"))
    head = F.substring(F.sha2(F.concat_ws(":", F.lit("17"), F.col("source"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8)
    return A.table(spark, d, "documents").select("doc_id", head.alias("head"), F.floor(seed / 16).cast("bigint").alias("seed"))


# smoothing, fusion, frames


@query(_with(A.CLIPS, A.smooth_sql(10)) + "SELECT video_id, clip_idx, round(score, 6) AS score FROM sm")
def gaussian_smooth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.gaussian(A.clips(spark, d)).select("video_id", "clip_idx", "score"))


_COARSE = "co AS (SELECT * FROM clips WHERE clip_idx % 3 = 1)"
_INTERP = """ig AS (SELECT c.video_id, c.clip_idx, c.center_frame, c.fps, c.positive, (SELECT arg_max((center_frame, score), center_frame) FROM co WHERE co.video_id = c.video_id AND co.center_frame <= c.center_frame) AS l,
(SELECT arg_min((center_frame, score), center_frame) FROM co WHERE co.video_id = c.video_id AND co.center_frame >= c.center_frame) AS r FROM clips c),
ii AS (SELECT video_id, clip_idx, center_frame, fps, positive, CASE WHEN l IS NULL THEN r[2] WHEN r IS NULL OR r[1] = l[1] THEN l[2] ELSE l[2] + (r[2] - l[2]) * (center_frame - l[1]) / (r[1] - l[1])::DOUBLE END AS score FROM ig)"""


def _coarse(c: DataFrame) -> DataFrame:
    return G.interpolated(c.where("clip_idx % 3 = 1").select("video_id", "center_frame", "score"), c)


@query(_with(A.CLIPS, _COARSE, _INTERP) + "SELECT video_id, center_frame, round(score, 6) AS score FROM ii WHERE score IS NOT NULL")
def interp_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_coarse(A.clips(spark, d)).where("score is not null"))


@query(_with(A.CLIPS, A.INDEX) + "SELECT video_id, f AS frame, coalesce(score, 0) AS score FROM (SELECT video_id, unnest(range(0, end_frame + 1)) AS f FROM idx) LEFT JOIN clips USING (video_id) WHERE clip_idx = f // 16 UNION ALL SELECT video_id, f, 0 FROM (SELECT video_id, unnest(range(0, end_frame + 1)) AS f FROM idx) x WHERE NOT EXISTS (SELECT 1 FROM clips c WHERE c.video_id = x.video_id AND c.clip_idx = f // 16)")
def expand_frames(spark: SparkSession, d: str) -> DataFrame:
    c = A.clips(spark, d)
    return R.expanded(c, A.index(c))


def _overlapping(ivs: DataFrame) -> DataFrame:
    """Each interval once more, 8 frames longer, after the others: overlaps with other labels."""
    more = ivs.select("video_id", (F.col("ordinal") + 1000).alias("ordinal"), "start", (F.col("stop") + 8).alias("stop"), F.lit(9).alias("label"))
    return ivs.select("video_id", "ordinal", "start", "stop", (F.col("ordinal") % 3 + 1).cast("int").alias("label")).unionByName(more)


def _labels(spark: SparkSession, d: str, policy: str) -> DataFrame:
    c = A.clips(spark, d)
    idx = A.index(c)
    frames = R.expanded(c, idx).select("video_id", "frame")
    return R.labelled(frames, idx, _overlapping(A.intervals(c)), policy).groupBy("video_id", "label").agg(F.count("*").alias("frames"), F.sum("frame").alias("places")).select("video_id", big("label"), "frames", "places")


_LABELS = """ov AS (SELECT video_id, ordinal, start, stop, ordinal % 3 + 1 AS label FROM ivs UNION ALL SELECT video_id, ordinal + 1000, start, stop + 8, 9 FROM ivs),
fr AS (SELECT video_id, unnest(range(0, end_frame + 1)) AS f FROM idx),
lb AS (SELECT fr.video_id, f, coalesce({0}(label, ordinal), 0) AS label FROM fr LEFT JOIN ov ON ov.video_id = fr.video_id AND f BETWEEN start AND stop GROUP BY fr.video_id, f)
SELECT video_id, label::BIGINT AS label, count(*) AS frames, sum(f)::BIGINT AS places FROM lb GROUP BY video_id, label"""


@query(_with(A.CLIPS, A.INDEX, A.INTERVALS) + ", " + _LABELS.format("arg_min"))
def interval_labels_first(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d, "first")


@query(_with(A.CLIPS, A.INDEX, A.INTERVALS) + ", " + _LABELS.format("arg_max"))
def interval_labels_last(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d, "last")


@query(
    _with(A.CLIPS, A.INTERVALS, "ov AS (SELECT video_id, start, stop FROM ivs UNION ALL SELECT video_id, start + 8, stop + 40 FROM ivs)", "nx AS (SELECT *, max(stop) OVER (PARTITION BY video_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ov)", "gr AS (SELECT *, sum(CASE WHEN start <= top + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY start, stop) AS g FROM nx)")
    + "SELECT video_id, min(start) AS start, max(stop) AS stop FROM gr GROUP BY video_id, g"
)
def merged_intervals(spark: SparkSession, d: str) -> DataFrame:
    i = A.intervals(A.clips(spark, d)).select("video_id", "start", "stop")
    return R.merged(i.unionByName(i.select("video_id", (F.col("start") + 8).alias("start"), (F.col("stop") + 40).alias("stop"))))


def _projected(spark: SparkSession, d: str, seconds: float, every: int) -> DataFrame:
    c = A.clips(spark, d)
    v = c.join(_videos(c).select("video_id", "frame_count"), "video_id").where(F.col("clip_idx") % every == 0)
    return rounded(R.overlap_projection(v, seconds))


_PROJECT = """pv AS (SELECT c.*, frame_count FROM clips c JOIN videos USING (video_id) WHERE clip_idx % {1} = 0),
cov AS (SELECT video_id, score, unnest(range(greatest(0, ceil(center_frame - {0} * fps / 2.0 - 1e-9)::BIGINT), least(frame_count - 1, floor(center_frame + {0} * fps / 2.0 + 1e-9)::BIGINT) + 1)) AS frame FROM pv),
pj AS (SELECT video_id, frame, avg(score) AS a, max(score) AS b, list_avg(list_sort(list(score), 'DESC')[1:3]) AS t FROM cov GROUP BY video_id, frame),
ev AS (SELECT video_id, unnest(range(0, max(frame_count))) AS frame FROM pv GROUP BY video_id),
nr AS (SELECT ev.video_id, ev.frame, arg_min(score, (abs(ev.frame - center_frame), center_frame)) AS s FROM ev ANTI JOIN pj USING (video_id, frame) JOIN pv USING (video_id) GROUP BY ev.video_id, ev.frame)
SELECT video_id, frame, round(a, 6) AS mean, round(b, 6) AS max, round(t, 6) AS top3 FROM pj UNION ALL SELECT video_id, frame, s, s, s FROM nr"""


@query(_with(A.CLIPS, _VIDEOS) + ", " + _PROJECT.format("4.0", 1))
def overlap_projection(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, 4.0, 1)


@query(_with(A.CLIPS, _VIDEOS) + ", " + _PROJECT.format("1.0", 5))
def nearest_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Sparse clips and short windows: most frames take the nearest center's score."""
    return _projected(spark, d, 1.0, 5)


@query(_with(A.CLIPS, A.INDEX, A.INTERVALS, A.WEIGHTED.format("clips")) + "SELECT video_id, clip_idx, pos >= neg AS positive FROM w WHERE clip_idx >= 0")
def block_majority(spark: SparkSession, d: str) -> DataFrame:
    c = A.clips(spark, d)
    return R.block_majority(A.index(c), A.intervals(c), c).select("video_id", big("clip_idx"), "positive")


@query(_with(A.CLIPS) + "SELECT video_id, clip_idx, round(avg(score) OVER (PARTITION BY video_id ORDER BY clip_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS score FROM clips")
def fuse_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.adjacent_mean(A.clips(spark, d)).select("video_id", "clip_idx", "score"))


_NEAR = """nb AS (SELECT a.video_id, a.clip_idx, a.score AS own, b.clip_idx AS j, b.score AS v, greatest(0, 1 - abs(a.center_frame / a.fps::DOUBLE - b.center_frame / b.fps::DOUBLE) / 5) AS wt
FROM clips a JOIN clips b ON a.video_id = b.video_id AND abs(a.center_frame / a.fps::DOUBLE - b.center_frame / b.fps::DOUBLE) <= 5 + 1e-6)"""
_LOGIT = "ln(greatest(1e-4, least(1 - 1e-4, {0}))) - ln(1 - greatest(1e-4, least(1 - 1e-4, {0})))"


@query(_with(A.CLIPS, _NEAR) + "SELECT video_id, clip_idx, round(sum(wt * v) / sum(wt), 9) AS score FROM nb GROUP BY video_id, clip_idx")
def fuse_overlap_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.overlap_mean(A.clips(spark, d)).select("video_id", "clip_idx", "score"), 9)


@query(_with(A.CLIPS, _NEAR) + f"SELECT video_id, clip_idx, round(1 / (1 + exp(-sum(wt * ({_LOGIT.format('v')})) / sum(wt))), 6) AS score FROM nb GROUP BY video_id, clip_idx")
def fuse_overlap_logit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.overlap_mean(A.clips(spark, d), logits=True).select("video_id", "clip_idx", "score"))


_MEDIAN = """{0} AS (SELECT video_id, clip_idx, arg_min(x, (x, j)) AS med FROM (SELECT *, sum(wt) OVER (PARTITION BY video_id, clip_idx ORDER BY x, j) AS cum, sum(wt) OVER (PARTITION BY video_id, clip_idx) AS tot FROM {1}) WHERE cum >= tot / 2 - 1e-12 GROUP BY video_id, clip_idx)"""


@query(_with(A.CLIPS, _NEAR, "nx AS (SELECT *, v AS x FROM nb)", _MEDIAN.format("m1", "nx")) + "SELECT video_id, clip_idx, round(med, 6) AS median FROM m1")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    near = F.transform("near", lambda x: F.struct(x["score"].alias("v"), F.greatest(F.lit(0.0), 1.0 - x["d"] / 5.0).alias("w")))
    return rounded(U.neighbours(A.clips(spark, d), 10.0).select("video_id", "clip_idx", U.weighted_median(near, strict=True).alias("median")))


@query(
    _with(
        A.CLIPS, _NEAR, "nx AS (SELECT *, v AS x FROM nb)", _MEDIAN.format("m1", "nx"), "ny AS (SELECT nb.*, abs(v - med) AS x FROM nb JOIN m1 USING (video_id, clip_idx))", _MEDIAN.format("m2", "ny"),
        "sp AS (SELECT nb.*, 1.4826 * med AS sc, sum(CASE WHEN abs(v - own) <= 1e-6 THEN wt ELSE 0 END) OVER g >= 0.5 * sum(wt) OVER g AS sup FROM nb JOIN m2 USING (video_id, clip_idx) WINDOW g AS (PARTITION BY nb.video_id, nb.clip_idx))",
        "wz AS (SELECT *, wt * CASE WHEN sc > 1e-6 THEN exp(-0.5 * (v - own) / sc * (v - own) / sc) WHEN sup THEN CASE WHEN abs(v - own) <= 1e-6 THEN 1 ELSE 0 END ELSE 1 END * (abs(2 * v - 1) + 1e-6) AS wf FROM sp)",
        f"cs AS (SELECT video_id, clip_idx, any_value(own) AS s, {_LOGIT.format('any_value(own)')} AS lo, sum(wf) AS sw, sum(wf * ({_LOGIT.format('v')})) AS sl FROM wz GROUP BY video_id, clip_idx)",
    )
    + "SELECT video_id, clip_idx, round(1 / (1 + exp(-((1 - 4 * s * (1 - s)) * lo + 4 * s * (1 - s) * CASE WHEN sw <= 1e-6 THEN lo ELSE sl / sw END))), 5) AS score FROM cs"
)
def fuse_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.adaptive(A.clips(spark, d)).select("video_id", "clip_idx", "score"), 5)


_RUNS = "ra AS (SELECT video_id, center_frame, score FROM clips WHERE clip_idx % 4 <> 0), rb AS (SELECT video_id, center_frame, round(1 - score, 6) AS score FROM clips WHERE clip_idx % 3 <> 0)"


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = A.clips(spark, d)
    return c.where("clip_idx % 4 <> 0").select("video_id", "center_frame", "score"), c.where("clip_idx % 3 <> 0").select("video_id", "center_frame", F.round(1 - F.col("score"), 6).alias("score"))


@query(_with(A.CLIPS, _RUNS) + "SELECT video_id, center_frame, round(coalesce(0.3 * a.score + 0.7 * b.score, a.score, b.score), 6) AS score FROM ra a FULL JOIN rb b USING (video_id, center_frame)")
def fuse_initial_refined(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.fused_runs(*_runs(spark, d)))


@query(_with(A.CLIPS, _RUNS) + "SELECT video_id, center_frame, CASE WHEN a.score BETWEEN 0.45 AND 0.55 THEN b.score ELSE a.score END AS score FROM ra a JOIN rb b USING (video_id, center_frame)")
def uncertainty_gate(spark: SparkSession, d: str) -> DataFrame:
    a, b = _runs(spark, d)
    return a.withColumnRenamed("score", "i").join(b.withColumnRenamed("score", "r"), ["video_id", "center_frame"]).select("video_id", "center_frame", O.gated("i", "r").alias("score"))


# metrics

_ROUNDED = "SELECT {0}round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(max_f1, 6) AS max_f1, round(f1_threshold, 6) AS f1_threshold, round(youden_threshold, 6) AS youden_threshold, positives, negatives FROM m"


def _places(weighted: DataFrame) -> DataFrame:
    """Scores to 9 places: sums in another order then make the same ties."""
    return weighted.withColumn("score", F.round("score", 9))


@query(
    _with(A.CLIPS, A.INDEX, A.INTERVALS, A.smooth_sql(10), A.WEIGHTED.format("sm"), "wr AS (SELECT * REPLACE (round(score, 9) AS score) FROM w)", A.metrics_sql("wr"))
    + _ROUNDED.format("(SELECT count(DISTINCT video_id) FROM w) AS videos, positives + negatives AS frames, ")
)
def eval_frame_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Clips smoothed, projected to frames as weighted rows, labelled by intervals, and measured."""
    c = A.clips(spark, d)
    w = R.weighted_rows(G.gaussian(c), A.index(c), A.intervals(c))
    m = M.ranking_metrics(M.curve(_places(w)))
    n = c.agg(F.countDistinct("video_id").alias("videos"))
    return rounded(m.withColumn("frames", F.col("positives") + F.col("negatives")).crossJoin(n))


@query(_with(A.CLIPS, "wr AS (SELECT *, positive::INT AS pos, (NOT positive)::INT AS neg FROM clips)", A.metrics_sql("wr")) + _ROUNDED.format(""))
def clip_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = A.clips(spark, d).withColumns({"pos": F.col("positive").cast("int"), "neg": (~F.col("positive")).cast("int")})
    return rounded(M.ranking_metrics(M.curve(c)))


@query(
    _with("lb AS (SELECT l_returnflag AS flag, l_discount AS score, (l_linestatus = 'O')::INT AS pos, (l_linestatus <> 'O')::INT AS neg FROM lineitem)", A.metrics_sql("lb", "flag"))
    + "SELECT flag, CASE WHEN positives * negatives = 0 THEN 'nan' ELSE round(roc_auc, 6)::VARCHAR END = 'nan' AS undefined, CASE WHEN positives * negatives = 0 THEN -1 ELSE round(roc_auc, 6) END AS auc FROM m"
)
def safe_auc(spark: SparkSession, d: str) -> DataFrame:
    """Rank-sum areas by group; a group of one class has none."""
    a = M.rank_auc(A.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_discount", "l_linestatus"), "l_discount", F.col("l_linestatus") == "O", ["flag"])
    return a.select("flag", F.isnan("auc").alias("undefined"), r6(F.when(F.isnan("auc"), -1.0).otherwise(F.col("auc")), "auc"))


def _sweep() -> str:
    parts = []
    for s in (0, 2, 5, 10, 20):
        if s:
            inner = ", ".join(["WITH " + A.smooth_sql(s), A.WEIGHTED.format("sm"), "wr AS (SELECT * REPLACE (round(score, 9) AS score) FROM w)", A.metrics_sql("wr")])
        else:
            inner = ", ".join(["WITH " + A.WEIGHTED.format("clips"), "wr AS (SELECT * REPLACE (round(score, 9) AS score) FROM w)", A.metrics_sql("wr")])
        parts.append(f"(SELECT {s}.0 AS sigma, q.* FROM ({inner} {_ROUNDED.format('')}) q)")
    return "\nUNION ALL ".join(parts)


@query(_with(A.CLIPS, A.INDEX, A.INTERVALS) + "SELECT sigma::DOUBLE AS sigma, * EXCLUDE (sigma) FROM (" + _sweep() + ")")
def sigma_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All kernels in one pass over the clips, and one count of each clip's frames for all of them."""
    c, sigmas = A.clips(spark, d), [0.0, 2.0, 5.0, 10.0, 20.0]
    w = R.weighted_rows(G.gaussians(c, sigmas).withColumn("score", F.col("smoothed")), A.index(c), A.intervals(c))
    scores = F.coalesce("score", F.array(*[F.lit(0.0)] * len(sigmas)))
    each = F.zip_with(F.array(*[F.lit(s) for s in sigmas]), scores, lambda a, b: F.struct(a.alias("sigma"), b.alias("score")))
    rows = w.select("pos", "neg", F.inline(each))
    return rounded(M.ranking_metrics(M.curve(_places(rows), ["sigma"]), ["sigma"]))


_DRAWS = "dr AS (SELECT r AS rep, video_id, (video_id * 31 + r * 17 + video_id * r) % 4 AS times FROM (SELECT DISTINCT video_id FROM clips), (SELECT unnest(range(0, 50)) AS r))"


@query(
    _with(A.CLIPS, A.INDEX, A.INTERVALS, A.WEIGHTED.format("clips"), _DRAWS, "bs AS (SELECT rep, score, pos * times AS pos, neg * times AS neg FROM w JOIN dr USING (video_id) WHERE times > 0)", A.metrics_sql("bs", "rep"), "lg AS (UNPIVOT (SELECT rep, roc_auc, pr_auc, max_f1 FROM m) ON roc_auc, pr_auc, max_f1 INTO NAME metric VALUE v)")
    + "SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS reps FROM lg GROUP BY metric"
)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Fixed draws stand in for random ones, so that both sides resample alike."""
    c = A.clips(spark, d)
    reps = c.select("video_id").distinct().crossJoin(F.broadcast(spark.range(50).select(F.col("id").alias("rep"))))
    draws = reps.withColumn("times", (F.col("video_id") * 31 + F.col("rep") * 17 + F.col("video_id") * F.col("rep")) % 4).where("times > 0")
    return rounded(M.bootstrap(R.weighted_rows(c, A.index(c), A.intervals(c)), draws))


# diagnostics

_KINDS = "kd AS (SELECT *, round(4 * score * (1 - score), 6) AS u, CASE WHEN positive AND score >= 0.3 THEN 'TP' WHEN score >= 0.3 THEN 'FP' WHEN positive THEN 'FN' ELSE 'TN' END AS kind FROM clips)"


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return A.clips(spark, d).withColumn("u", F.round(4 * F.col("score") * (1 - F.col("score")), 6)).withColumn("kind", D.kind(F.col("positive"), F.col("score") >= 0.3))


@query(
    _with(A.CLIPS, _KINDS, "qc AS (SELECT quantile_cont(u, 0.9) AS cut FROM kd)")
    + "SELECT kind, count(*) AS count, round(avg(u), 6) AS mean, round(median(u), 6) AS median, round(quantile_cont(u, 0.75), 6) AS q75, round(avg((u >= cut)::INT), 6) AS high_fraction FROM kd, qc GROUP BY kind"
)
def confusion_by_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.error_summary(_kinds(spark, d), "u"))


@query(
    _with(A.CLIPS, _KINDS, "qc AS (SELECT quantile_cont(u, 0.9) AS cut FROM kd)", "e AS (SELECT (kind IN ('FP', 'FN'))::INT AS e, u >= cut AS h, cut FROM kd, qc)")
    + "SELECT round(any_value(cut), 6) AS cutoff, round(avg(h::INT), 6) AS high_fraction, round(avg(e), 6) AS error_rate, round(avg(e) FILTER (h), 6) AS high_error_rate, round(avg(e) FILTER (h) / avg(e), 6) AS enrichment FROM e"
)
def high_uncertainty_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.high_error(_kinds(spark, d), "u"))


@query(
    _with(A.CLIPS, _KINDS, "er AS (SELECT CASE WHEN kind IN ('FP', 'TP') THEN 'predicted' ELSE 'passed' END AS side, u AS score, (kind IN ('FP', 'FN'))::INT AS pos, (kind NOT IN ('FP', 'FN'))::INT AS neg FROM kd)", A.metrics_sql("er", "side"))
    + "SELECT side, round(roc_auc, 6) AS auc FROM m"
)
def error_detection_auc(spark: SparkSession, d: str) -> DataFrame:
    k = _kinds(spark, d).select(F.when(F.col("kind").isin("FP", "TP"), "predicted").otherwise("passed").alias("side"), "u", "kind")
    return rounded(M.rank_auc(k, "u", F.col("kind").isin("FP", "FN"), ["side"]))


@query(
    _with(A.CLIPS, "u AS (SELECT video_id, clip_idx, score, round(4 * score * (1 - score), 6) AS entropy FROM clips)", "qs AS (SELECT unnest(quantile_cont(score, [" + ", ".join(repr(k / 20) for k in range(21)) + "])) AS q FROM u)", "ed AS (SELECT list_sort(list(DISTINCT q)) AS e FROM qs)", "bn AS (SELECT u.*, len([x for x in e[2:len(e) - 1] if x <= score]) AS bin FROM u, ed)")
    + "SELECT video_id, clip_idx, bin::BIGINT AS bin, round(avg(entropy) OVER (PARTITION BY bin), 6) AS expected, round(entropy - avg(entropy) OVER (PARTITION BY bin), 6) + 0.0 AS residual FROM bn"
)
def binned_residual(spark: SparkSession, d: str) -> DataFrame:
    u = A.clips(spark, d).select("video_id", "clip_idx", "score", F.round(4 * F.col("score") * (1 - F.col("score")), 6).alias("entropy"))
    return rounded(D.binned_residual(u).select("video_id", "clip_idx", "bin", "expected", "residual"))


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query(
    _with(A.CLIPS, "u AS (SELECT video_id, clip_idx, score, round(4 * score * (1 - score), 6) AS u, count(*) OVER () AS n FROM clips)")
    + f"SELECT video_id, clip_idx, round(({_RANK.format('score')} - 1) / (n - 1), 6) AS score_rank, round((({_RANK.format('score')} - 1) / (n - 1) + ({_RANK.format('u')} - 1) / (n - 1)) / 2, 6) AS joint FROM u"
)
def joint_percentile_gate(spark: SparkSession, d: str) -> DataFrame:
    u = A.clips(spark, d).select("video_id", "clip_idx", "score", F.round(4 * F.col("score") * (1 - F.col("score")), 6).alias("u"))
    ranked = D.percentile_rank(D.percentile_rank(u, "score", "score_rank"), "u", "u_rank")
    return rounded(ranked.select("video_id", "clip_idx", "score_rank", ((F.col("score_rank") + F.col("u_rank")) / 2).alias("joint")))


@query(
    _with(A.CLIPS, "u AS (SELECT video_id % 5 AS g, score, (clip_idx * 7) % 50 AS b FROM clips)", "k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2.0 AS y FROM u)")
    + "SELECT g, round(corr(x, y), 6) AS rho, count(*) AS n FROM k GROUP BY g"
)
def spearman(spark: SparkSession, d: str) -> DataFrame:
    u = A.clips(spark, d).select((F.col("video_id") % 5).alias("g"), "score", ((F.col("clip_idx") * 7) % 50).alias("b"))
    return rounded(M.spearman(u, "score", "b", ["g"]))


@query(
    _with(A.CLIPS, _RUNS, "dl AS (SELECT b.score - a.score AS d FROM ra a JOIN rb b USING (video_id, center_frame))")
    + "SELECT count(*) AS count, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(avg(abs(d)), 6) AS mean_abs, round(avg((d > 0)::INT), 6) AS raised, round(avg((d < 0)::INT), 6) AS lowered FROM dl"
)
def delta_summary(spark: SparkSession, d: str) -> DataFrame:
    a, b = _runs(spark, d)
    return rounded(D.delta_summary(a.withColumnRenamed("score", "a").join(b.withColumnRenamed("score", "b"), ["video_id", "center_frame"])))


@query(_with(A.CLIPS, _RUNS) + "SELECT count(*) AS n, round(avg(abs(a.score - b.score)), 6) AS mae FROM ra a JOIN rb b USING (video_id, center_frame)")
def run_agreement_mae(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.agreement(*_runs(spark, d)))


@query(
    """WITH g AS (SELECT o_orderpriority AS prompt, count(*) AS runs, avg(o_totalprice) AS mean, coalesce(stddev_samp(o_totalprice), 0) AS std, min(o_totalprice) AS worst, max(o_totalprice) - min(o_totalprice) AS range FROM orders GROUP BY 1)
SELECT prompt, runs, round(mean, 4) AS mean, round(std, 4) AS std, round(worst, 4) AS worst, round(range, 4) AS range, round(mean - (SELECT mean FROM g WHERE prompt = (SELECT min(prompt) FROM g)), 4) + 0.0 AS delta FROM g"""
)
def run_table(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("prompt"), "o_totalprice")
    first = o.agg(F.min("prompt")).first()[0]
    return rounded(D.run_table(o, "o_totalprice", first), 4)


# completeness

_ACTUAL = """xp AS (SELECT video_id, center_frame FROM clips WHERE clip_idx % 50 <> 49), ac AS (SELECT video_id, center_frame, CASE WHEN clip_idx % 41 = 7 THEN 1.5 ELSE score END AS score FROM clips WHERE NOT (video_id % 3 = 0 AND clip_idx % 11 = 5)),
fl AS (SELECT video_id, center_frame FROM clips WHERE video_id % 4 = 1 AND clip_idx % 13 = 2)"""


def _actual(c: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    actual = c.where("not (video_id % 3 = 0 and clip_idx % 11 = 5)").withColumn("score", F.when(F.col("clip_idx") % 41 == 7, 1.5).otherwise(F.col("score")))
    keys = ["video_id", "center_frame"]
    return c.where("clip_idx % 50 <> 49").select(keys), actual.select(*keys, "score"), c.where("video_id % 4 = 1 and clip_idx % 13 = 2").select(keys)


@query(_with(A.CLIPS, _ACTUAL) + "SELECT video_id, bool_and(x.e IS NOT NULL AND a.score IS NOT NULL) AS complete FROM (SELECT *, 1 AS e FROM xp) x FULL JOIN ac a USING (video_id, center_frame) GROUP BY video_id")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    e, a, _ = _actual(A.clips(spark, d))
    return Q.completeness(e, a)


@query(
    _with(A.CLIPS, _ACTUAL)
    + """SELECT video_id, count(e) AS expected, count(*) FILTER (e = 1 AND a IS NULL) AS missing, count(*) FILTER (e IS NULL AND a = 1) AS unexpected, count(*) FILTER (a = 1 AND (score IS NULL OR NOT score BETWEEN 0 AND 1)) AS invalid, count(f) AS failed
FROM (SELECT *, 1 AS e FROM xp) FULL JOIN (SELECT *, 1 AS a FROM ac) USING (video_id, center_frame) FULL JOIN (SELECT *, 1 AS f FROM fl) USING (video_id, center_frame) GROUP BY video_id"""
)
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.coverage(*_actual(A.clips(spark, d))))


@query(
    _with(A.CLIPS, _ACTUAL, "ar AS (SELECT 'run' || k AS run, video_id, center_frame FROM clips, (SELECT unnest(range(0, 3)) AS k) WHERE k <> 1 OR clip_idx % 5 <> 0)", "o AS (SELECT run, count(*) AS observed FROM ar SEMI JOIN xp USING (video_id, center_frame) GROUP BY run)", "f AS (SELECT 'run2' AS run, count(*) AS errors FROM fl)")
    + "SELECT run, observed, coalesce(errors, 0) AS errors, CASE WHEN observed = (SELECT count(*) FROM xp) AND errors IS NULL THEN 'complete' ELSE 'partial' END AS status FROM o LEFT JOIN f USING (run)"
)
def run_status(spark: SparkSession, d: str) -> DataFrame:
    c = A.clips(spark, d)
    e, _, f = _actual(c)
    runs = c.crossJoin(F.broadcast(spark.range(3))).where("id <> 1 or clip_idx % 5 <> 0").select(F.concat(F.lit("run"), F.col("id").cast("string")).alias("run"), "video_id", "center_frame")
    return rounded(Q.run_status(e, runs, f.withColumn("run", F.lit("run2"))))


@query(_with(A.CLIPS, _ACTUAL) + "SELECT video_id, center_frame FROM xp ANTI JOIN (SELECT video_id, center_frame FROM ac ANTI JOIN fl USING (video_id, center_frame)) k USING (video_id, center_frame)")
def pending_clips(spark: SparkSession, d: str) -> DataFrame:
    return Q.pending(*_actual(A.clips(spark, d)))


@query(
    """WITH i AS (SELECT o_custkey AS video_id FROM orders), v AS (SELECT DISTINCT video_id FROM i), n AS (SELECT video_id FROM v WHERE video_id % 3 <> 0)
SELECT (SELECT count(*) FROM v) AS videos, (SELECT count(*) FROM n) AS unlabelled, (SELECT count(*) FROM (SELECT video_id FROM i GROUP BY video_id HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM v WHERE video_id % 7 = 1) AS unscored,
(SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT video_id::VARCHAR AS s FROM n ORDER BY video_id LIMIT 10)) AS first_unlabelled"""
)
def dataset_validation(spark: SparkSession, d: str) -> DataFrame:
    i = A.table(spark, d, "orders").select(F.col("o_custkey").alias("video_id"))
    return Q.dataset_problems(i, i.where("video_id % 3 = 0"), i.where("video_id % 7 <> 1"))


@query(_with(A.CLIPS, _RUNS) + "SELECT 'both' AS part, count(*) AS keys FROM (SELECT video_id, center_frame FROM ra INTERSECT SELECT video_id, center_frame FROM rb) UNION ALL SELECT 'first', count(*) FROM (SELECT video_id, center_frame FROM ra EXCEPT SELECT video_id, center_frame FROM rb) UNION ALL SELECT 'any', count(*) FROM (SELECT video_id, center_frame FROM ra UNION SELECT video_id, center_frame FROM rb)")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("video_id", "center_frame") for x in _runs(spark, d))
    parts = {"both": a.intersect(b), "first": a.subtract(b), "any": a.union(b).distinct()}
    out = [df.agg(F.count("*").alias("keys")).select(F.lit(n).alias("part"), "keys") for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    _with(A.CLIPS, A.TAILS, A.PAVA.format("tails"), "sc AS (SELECT vec_id, list_sum(g) / 10 AS s FROM pava)")
    + "SELECT vec_id, (vec_id % 3 <> 0 AND vec_id % 5 <> 0) AS valid FROM sc"
)
def window_validity(spark: SparkSession, d: str) -> DataFrame:
    """A stored score holds if it is in range and is what its details give."""
    t = A.tails(spark, d).withColumn("g", O.tail_score("tail"))
    stored = F.when(F.col("vec_id") % 3 == 0, F.col("g") + 1e-6).when(F.col("vec_id") % 5 == 0, F.col("g") + 2).otherwise(F.col("g"))
    return t.select("vec_id", (stored.between(0.0, 1.0) & (F.abs(stored - F.col("g")) < 1e-10)).alias("valid"))


# text

_SAID = "CASE doc_id % 8 WHEN 0 THEN 'score [0.7] or [2]' WHEN 1 THEN '[ -1e-1 ]' WHEN 2 THEN ' .5 ' WHEN 3 THEN 'score 0.7' WHEN 4 THEN '[nan] [1.5]' WHEN 5 THEN '' WHEN 6 THEN '[1]' ELSE concat('[', doc_id, '] x') END"
_NUM = X.NUMBER


@query(
    f"""WITH s AS (SELECT doc_id, {_SAID} AS said FROM documents), n AS (SELECT doc_id, try_cast(coalesce(nullif(regexp_extract(said, '\\[\\s*({_NUM})\\s*\\]', 1), ''), nullif(regexp_extract(said, '^\\s*({_NUM})\\s*$', 1), '')) AS DOUBLE) AS v FROM s)
SELECT doc_id, CASE WHEN v IS NULL THEN 0.5 ELSE greatest(0, least(1, v)) END AS score, CASE WHEN v IS NULL THEN 'no score' WHEN v < 0 OR v > 1 THEN 'clipped' END AS error FROM n"""
)
def parse_score(spark: SparkSession, d: str) -> DataFrame:
    s = A.table(spark, d, "documents").select("doc_id", F.expr(_SAID).alias("said"))
    score, error = X.parsed_score(F.col("said"))
    return s.select("doc_id", score.alias("score"), error.alias("error"))


@query(f"WITH s AS (SELECT doc_id, {_SAID} AS said FROM documents) SELECT doc_id, coalesce(nullif(regexp_extract(said, '\\[([0-9]+(?:\\.[0-9]+)?)\\]', 1), '')::DOUBLE, -1) AS score FROM s")
def parse_score_strict(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", X.strict_score(F.expr(_SAID)).alias("score"))


_PHRASE = "CASE doc_id % 5 WHEN 0 THEN concat(' [ a ', source, '] ') WHEN 1 THEN 'None' WHEN 2 THEN 'no one seen' WHEN 3 THEN '   ' ELSE concat(lang, '[x]') END"


@query(f"WITH s AS (SELECT doc_id, {_PHRASE} AS p FROM documents) SELECT doc_id, trim(regexp_replace(regexp_replace(trim(p), '^\\[', ''), '\\]$', '')) AS phrase, lower(trim(p)) NOT IN ('', 'none') AND NOT starts_with(lower(trim(p)), 'no ') AS usable FROM s")
def phrase_clean(spark: SparkSession, d: str) -> DataFrame:
    p = F.expr(_PHRASE)
    return A.table(spark, d, "documents").select("doc_id", X.cleaned_phrase(p).alias("phrase"), X.usable_phrase(p).alias("usable"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ', ' || source WHEN 1 THEN 'none' ELSE source END AS phrases FROM documents")
def phrase_normalize(spark: SparkSession, d: str) -> DataFrame:
    p = F.expr("case doc_id % 3 when 0 then to_json(array(lang, '', concat(' ', source))) when 1 then '[]' else concat(source, ' ') end")
    return A.table(spark, d, "documents").select("doc_id", X.phrase_list(p).alias("phrases"))


@query("SELECT doc_id, array_to_string(regexp_split_to_array(trim(lang || ' ' || source || '  x y z'), '\\s+')[1:4], ' ') AS words, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE source END), ''), 'nothing seen') AS caption FROM documents")
def captions(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("lang", F.lit(" "), "source", F.lit("  x y z"))
    return A.table(spark, d, "documents").select("doc_id", X.first_words(t, 4).alias("words"), X.or_default(F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("source")), "nothing seen").alias("caption"))


@query("SELECT n_name AS prompt, k AS position, 'Is it at least ' || printf('%.1f', k / 10.0) || ' in ' || n_name || '?' AS question FROM nation, (SELECT unnest(range(1, 11)) AS k)")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    """Prompts by thresholds, each with its slot filled."""
    p = A.table(spark, d, "nation").select(F.col("n_name").alias("prompt"), F.concat(F.lit("Is it at least {threshold} in "), "n_name", F.lit("?")).alias("template"))
    k = spark.range(1, 11).select(F.col("id").alias("position"), (F.col("id") / 10.0).alias("threshold"))
    return p.crossJoin(F.broadcast(k)).select("prompt", "position", X.rendered(F.col("template"), F.col("threshold")).alias("question"))


@query("SELECT page_id, regexp_replace(string_split(url, '/')[-1], '(?i)\\.(mp4|avi|mov|mkv)$', '') AS stem, coalesce(regexp_extract_all(string_split(url, '/')[-1], '[0-9]+')[-1]::BIGINT, 0) AS number FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '.MP4' ELSE '' END AS url FROM pages)")
def name_stems(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".MP4").otherwise(""))
    return A.table(spark, d, "pages").select("page_id", X.stem(u).alias("stem"), X.frame_number(u).alias("number"))


@query("SELECT conv_id, string_agg(text, ', ' ORDER BY turn) AS summary FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def summaries_joined(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations").where("role = 'assistant'")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), ", ").alias("summary"))


#: A double as it stands in JSON: plain from a thousandth on, with an exponent below.
_JSON = "CASE WHEN score = 0 OR score >= 0.001 THEN score::VARCHAR ELSE round(score * pow(10, -floor(log10(score))), 6)::VARCHAR || 'E' || floor(log10(score))::BIGINT END"


@query(_with(A.CLIPS) + f"SELECT video_id, '{{' || string_agg('\"' || center_frame || '\":' || {_JSON}, ',' ORDER BY center_frame) || '}}' AS value FROM clips GROUP BY video_id")
def score_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """What is written for each video: one JSON object of frame -> score."""
    return writers.score_maps(A.clips(spark, d))



@query(
    """SELECT n_nationkey::BIGINT AS nation, k AS position, t.role, t.content FROM (SELECT n_nationkey, k, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [] ELSE [{'role': 'system', 'content': n_name}] END || [{'role': 'user', 'content':
'Is it ' || printf('%.1f', k / 10.0) || '?' || chr(10) || 'A: ' || CASE WHEN k % 2 = 1 THEN 'not reached' ELSE 'reached' END || chr(10) || 'B: ' || CASE WHEN k % 2 = 1 THEN 'reached' ELSE 'not reached' END}]) AS t FROM nation, (SELECT unnest(range(1, 11)) AS k))"""
)
def option_conversations(spark: SparkSession, d: str) -> DataFrame:
    n = A.table(spark, d, "nation").crossJoin(F.broadcast(spark.range(1, 11)))
    user = P.option_question("Is it {threshold}?", F.col("id") / 10.0, F.col("id") % 2 == 1)
    turns = P.conversation(F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")), user)
    return n.select(big("n_nationkey", "nation"), F.col("id").alias("position"), F.inline(turns))


@query(
    """SELECT k AS level, 'Is the answer NO to this question? Is it ' || printf('%.1f', k / 10.0) || '?' AS complement, 'Is it ' || printf('%.1f', k / 10.0) || '? (class ' || (k + 1) || ' of 11)' AS exact FROM (SELECT unnest(range(0, 11)) AS k)"""
)
def class_questions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    return spark.range(11).select(k.alias("level"), P.complement_question("Is it {threshold}?", k / 10.0).alias("complement"), P.class_question("Is it {threshold}?", k).alias("exact"))


@query("SELECT coalesce(o_orderstatus, 'all') AS dataset, coalesce(o_orderpriority, 'all') AS method, round(avg(o_totalprice), 4) AS mean, count(*) AS runs FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ensemble_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = A.table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("runs"))
    return g.select(F.coalesce("o_orderstatus", F.lit("all")).alias("dataset"), F.coalesce("o_orderpriority", F.lit("all")).alias("method"), r6("mean", places=4), "runs")


@query(_with(A.CLIPS) + "SELECT count(DISTINCT video_id) AS videos, count(*) AS clips, count(*) FILTER (positive) AS failed, round(sum(score), 4) AS seconds, round((SELECT max(s) FROM (SELECT sum(score) AS s FROM clips GROUP BY video_id)), 4) AS slowest FROM clips")
def run_record(spark: SparkSession, d: str) -> DataFrame:
    c = A.clips(spark, d)
    return rounded(N.run_record(c, c.where("positive"), c.groupBy("video_id").agg(F.sum("score").alias("seconds"))), 4)


@query()
def bootstrap_random(spark: SparkSession, d: str) -> DataFrame:
    """Seeded draws with replacement; the fixed draws of bootstrap_ci are what SQL can follow."""
    c = A.clips(spark, d)
    return rounded(M.bootstrap(R.weighted_rows(c, A.index(c), A.intervals(c)), M.resamples(c, 50)))


@query(_with(A.CLIPS) + "SELECT video_id, center_frame, sha256('17:' || video_id || ':' || center_frame) AS key FROM clips ORDER BY key LIMIT 100")
def seeded_windows(spark: SparkSession, d: str) -> DataFrame:
    """A hundred windows in an order drawn by digest: the same on every run."""
    c = A.clips(spark, d)
    return S.seeded_head(c.select("video_id", "center_frame"), ["video_id", "center_frame"], 100)
