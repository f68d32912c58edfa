"""Queries over what outlives a run: streams with replays, versions and leases, checked look-ups, files written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import backends
from ..operators import diagnostics as D, quality as Q
from ..sources import readers, snapshots, storage, writers
from ..streaming.sink import BatchSink, run_available
from . import adapters as A
from .queries import _RUNS, _runs, _with, query, r6, rounded


@query("SELECT event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """Events through an available-now stream of several batches; the run stops once after a batch is written and before Spark has noted it, so that batch is run again and must count once."""
    root = storage.scratch(spark, "stream")
    events = A.table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    events.repartitionByRange(6, "event_id").write.parquet(f"{root}/arrived")
    sink = BatchSink(f"{root}/out")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/arrived")

    def stop(batch: int) -> None:
        if batch == 1:
            raise InterruptedError("planted")

    rows = lambda b: b.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    try:
        run_available(source, rows, sink, stop)
    except Exception as e:
        if "planted" not in str(e):
            raise
    run_available(source, rows, sink)
    got = sink.read(spark, "event_type string, user_id bigint, n bigint, cents bigint")
    return got.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.countDistinct("user_id").alias("users"))


@query(
    "WITH a AS (SELECT o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1) "
    "SELECT 2::BIGINT AS version, 2::BIGINT AS fence, name, n, 1::BIGINT AS refused FROM b UNION ALL SELECT 1, 1, name, n, 1 FROM a"
)
def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two writers of one table. The first makes version 1 and stops in the middle of the next; its lease ends, the second writer takes over and makes version 2, and
    the first, awake again, is refused. Both versions are read back."""
    root, orders = storage.scratch(spark, "versions"), A.table(spark, d, "orders")
    counted = lambda c: orders.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n"))
    first = snapshots.acquire(spark, root, 60, "first", now=0)
    snapshots.commit(counted("o_orderstatus"), first, "load-1", now=1_000)
    half_done = snapshots.prepare(counted("o_custkey"), root)
    if snapshots.acquire(spark, root, 60, "second", now=30_000) is not None:
        raise RuntimeError("two leases at a time")
    second = snapshots.acquire(spark, root, 60, "second", now=61_000)
    snapshots.commit(counted("o_orderpriority"), second, "load-2", now=62_000)
    snapshots.commit(counted("o_orderpriority"), second, "load-2", now=63_000)  # a replay changes nothing
    refused = 0
    try:
        snapshots.publish(spark, first, half_done, "load-3", now=64_000)
    except snapshots.Fenced:
        refused = 1
    out = None
    for v in snapshots.versions(spark, root):
        rows = snapshots.read(spark, root, v.number).select(F.lit(v.number).cast("bigint").alias("version"), F.lit(v.fence).cast("bigint").alias("fence"), "name", "n", F.lit(refused).cast("bigint").alias("refused"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT o_orderkey, c_mktsegment AS segment, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey")
def checked_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A look-up that must find every key: the query fails if one is missing."""
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = A.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return Q.looked_up(o, c, ["c_custkey"], what="customer").drop("c_custkey")


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON o_custkey = c_custkey")
def lenient_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = A.table(spark, d, "customer").where("c_nationkey < 12").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return Q.looked_up(o, c, ["c_custkey"], strict=False).select("o_orderkey", F.coalesce("segment", F.lit("none")).alias("segment"))


_DELTA = "avg(d) FILTER ({0}) AS {1}_mean, median(d) FILTER ({0}) AS {1}_median, avg(abs(d)) FILTER ({0}) AS {1}_mean_abs, avg((d > 0)::INT) FILTER ({0}) AS {1}_raised, avg((d < 0)::INT) FILTER ({0}) AS {1}_lowered"
_SCOPE = ["all", "fn", "tn"]


@query(
    _with(A.CLIPS, _RUNS, "pr AS (SELECT a.score AS a, b.score AS b, b.score - a.score AS d, c.positive FROM ra a JOIN rb b USING (video_id, center_frame) JOIN clips c USING (video_id, center_frame))",
          "sm AS (SELECT count(*) AS clips, count(*) FILTER (positive) AS positive, count(*) FILTER (NOT positive) AS negative, " + ", ".join(_DELTA.format(w, n) for w, n in (("true", "all"), ("positive", "fn"), ("NOT positive", "tn"))) + " FROM pr)",
          *[f"{s}r AS (SELECT positive, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r FROM pr), {s}u AS (SELECT (sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)) AS {s}_auc FROM {s}r)" for s, c in (("initial", "a"), ("verify", "b"))])
    + "SELECT clips, positive, negative, " + ", ".join(f"round({s}_{n}, 6) AS {s}_{n}" for s in _SCOPE for n in ("mean", "median", "mean_abs", "raised", "lowered"))
    + ", round(initial_auc, 6) AS initial_auc, round(verify_auc, 6) AS verify_auc, round(verify_auc - initial_auc, 6) + 0.0 AS auc_change, round(fn_mean - tn_mean, 6) + 0.0 AS mean_gap FROM sm, initialu, verifyu"
)
def scope_analysis(spark: SparkSession, d: str) -> DataFrame:
    """What a second run does to the clips of a first one, by whether they are positive."""
    a, b = _runs(spark, d)
    keys = ["video_id", "center_frame"]
    pairs = a.withColumnRenamed("score", "a").join(b.withColumnRenamed("score", "b"), keys).join(A.clips(spark, d).select(*keys, "positive"), keys)
    return rounded(D.scope_summary(pairs))


@query("SELECT name, round(value, 4) AS value FROM (UNPIVOT (SELECT avg(o_totalprice) AS mean, max(o_totalprice) AS top, count(*)::DOUBLE AS n FROM orders) ON mean, top, n INTO NAME name VALUE value)")
def metric_files(spark: SparkSession, d: str) -> DataFrame:
    """Metrics written as text, one name and value a line, and read back."""
    path = storage.scratch(spark, "metrics")
    writers.write_metrics(A.table(spark, d, "orders").agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").cast("double").alias("top"), F.count("*").cast("double").alias("n")), path)
    pair = F.split("value", ": ", 2)
    return spark.read.text(path).select(F.get(pair, F.lit(0)).alias("name"), r6(F.get(pair, F.lit(1)).cast("double"), "value", 4))


@query("SELECT c_custkey, c_name, round(c_acctbal, 2)::DOUBLE AS c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV with a header, and read back by its schema."""
    path, rows = storage.scratch(spark, "csv"), A.table(spark, d, "customer").select("c_custkey", "c_name", F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"))
    writers.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT regexp_extract(path, '([^/]+)\\.[A-Za-z0-9]+$', 1) AS video_id, path FROM (SELECT DISTINCT 'set/' || o_orderpriority[1:1] || '/clip_' || o_custkey || CASE o_custkey % 2 WHEN 0 THEN '.mp4' ELSE '.avi' END AS path FROM orders)")
def video_names(spark: SparkSession, d: str) -> DataFrame:
    """Videos of an index file that the query writes: stem and path."""
    path = storage.scratch(spark, "index")
    name = F.concat(F.lit("set/"), F.substring("o_orderpriority", 1, 1), F.lit("/clip_"), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 2 == 0, ".mp4").otherwise(".avi"))
    A.table(spark, d, "orders").select(name.alias("path")).distinct().select(F.concat("path", F.lit(" 0 100 0")).alias("value")).write.text(path)
    return readers.video_names(spark, index=path)


@query("""SELECT c_mktsegment AS segment, sha256('{"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}') AS config_sha256, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey""")
def config_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The hash that a run's manifest has, for each configuration in a table, and how often it is used."""
    c = A.table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return c.select(F.col("c_mktsegment").alias("segment"), writers.config_hash_of(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))).alias("config_sha256"), "n")


@query(_with(A.CLIPS) + "SELECT video_id::VARCHAR AS video_id, center_frame, CASE WHEN clip_idx % 13 = 5 THEN 0.5 ELSE round(score / 2, 6) END AS score, CASE WHEN clip_idx % 13 = 5 THEN 'ZeroDivisionError' END AS error FROM clips")
def backend_scores(spark: SparkSession, d: str) -> DataFrame:
    """Clips scored by a back end found by its name: half of a column, and a failure where a divisor is 0."""

    class Half:
        def score(self, clip: dict) -> float:
            return round(clip["given"] / (2 * (clip["divisor"] != 0)), 6)

    backends.register("half", Half)
    c = A.clips(spark, d).select("video_id", "center_frame", F.col("score").alias("given"), (F.col("clip_idx") % 13 != 5).cast("int").alias("divisor"))
    got = backends.scored(c, "half")
    return got.select("video_id", "center_frame", r6("score"), F.element_at(F.split("error", ":"), 1).alias("error"))
