"""Incremental scoring: clips that arrive as files are scored once, failures again on the next run.

out/results holds a row for every attempt at a clip: its score (the default one for a failure) and its error. One append is one attempt, so a crash leaves scores and errors that belong
together. scores() and errors() read the last attempt at each clip: a success drops the error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..backends import SCHEMA, scored
from ..operators.quality import latest, pending
from ..plans.runs import claim, release
from ..sources.snapshots import check

RESULTS = SCHEMA + ", attempt bigint"
#: A pass must end within its lease: longer than any pass takes, and not so long that a crash keeps the folder for days.
LEASE_SECONDS = 24 * 3600.0


def results(spark: SparkSession, out: str) -> DataFrame:
    """All attempts; none if nothing is written yet. Any other fault of the storage is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/results")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RESULTS)
    return spark.read.schema(RESULTS).parquet(f"{out}/results")


def scores(spark: SparkSession, out: str) -> DataFrame:
    """video_id, center_frame, score of every clip that was tried."""
    return latest(results(spark, out)).drop("error")


def errors(spark: SparkSession, out: str) -> DataFrame:
    """video_id, center_frame, error of the clips whose last attempt failed."""
    return latest(results(spark, out)).where("error is not null").drop("score")


def score_pending(clips: DataFrame, out: str, backend: str, **options) -> tuple[int, int]:
    """Score the clips that have no score or whose last attempt failed, and append the attempt: (scored, failed). One run at a time: another that holds the folder is an error."""
    spark = clips.sparkSession
    if (lease := claim(spark, out, LEASE_SECONDS)) is None:
        raise RuntimeError(f"another run owns {out}")
    try:
        tried = results(spark, out)
        attempt = tried.agg(F.coalesce(F.max("attempt"), F.lit(0)) + 1).first()[0]
        done = latest(tried)
        left = pending(clips, done, done.where("error is not null"))
        check(spark, lease)
        scored(left, backend, **options).withColumn("attempt", F.lit(attempt).cast("bigint")).write.mode("append").parquet(f"{out}/results")
        made = results(spark, out).where(F.col("attempt") == attempt)
        good, bad = made.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
        return good, bad
    finally:
        release(spark, lease)


def score_stream(spark: SparkSession, source: str, schema: str, out: str, backend: str, files: int = 16, **options):
    """Run over clip files (Parquet) that have arrived since the last call, and stop. Spark's checkpoint remembers files; the anti join, clips."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def each(batch: DataFrame, _: int) -> None:
        score_pending(batch.dropDuplicates(["video_id", "center_frame"]), out, backend, **options)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
