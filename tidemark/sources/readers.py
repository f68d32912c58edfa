"""Readers of index, annotation, score and detail files. All go through Spark's readers, so any Hadoop file system serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import stem

DETAIL = "map<string,struct<thresholds:array<struct<threshold:double,yes_loglik:double,no_loglik:double,tail_probability:double>>,monotonic_tail_probabilities:array<double>,monotonic_violations:int,score:double>>"


def fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def parsed_index(lines: DataFrame) -> DataFrame:
    """video_id, path, start_frame, end_frame, labels of lines (value); blank ones are left out."""
    rows = lines.where(F.length(F.trim("value")) > 0).select(fields(F.col("value")).alias("f"))
    return rows.select(stem(F.col("f")[0]).alias("video_id"), F.col("f")[0].alias("path"), F.col("f")[1].cast("bigint").alias("start_frame"), F.col("f")[2].cast("bigint").alias("end_frame"), F.transform(F.split(F.col("f")[3], ","), lambda x: x.cast("int")).alias("labels"))


def parsed_annotations(lines: DataFrame) -> DataFrame:
    """video_id, event, ordinal, start, stop of lines (value, and line for the order): the last line of a name counts; -1 pads."""
    rows = lines.where(F.length(F.trim("value")) > 0).select("line", fields(F.col("value")).alias("f"))
    last = rows.select(stem(F.col("f")[0]).alias("video_id"), "line", "f").groupBy("video_id").agg(F.max_by("f", "line").alias("f"))
    n = F.floor((F.size("f") - 2) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.struct(F.get("f", 2 * k).cast("bigint").alias("start"), F.get("f", 2 * k + 1).cast("bigint").alias("stop")))
    out = last.select("video_id", F.col("f")[1].alias("event"), F.posexplode(pairs).alias("ordinal", "p"))
    return out.select("video_id", "event", "ordinal", "p.start", "p.stop").where("start >= 0 and stop >= 0")


def with_labels(intervals: DataFrame, index: DataFrame) -> DataFrame:
    """intervals with label: the index's label at the ordinal; the last one repeats; the first if there are none of its place."""
    rows = intervals.join(index.select("video_id", "labels"), "video_id")
    return rows.withColumn("label", F.element_at("labels", F.least(F.col("ordinal") + 1, F.size("labels")))).drop("labels")


def score_map(files: DataFrame, strict: bool = False) -> DataFrame:
    """video_id, center_frame, score of files (name, value: a JSON object of frame -> score). Unreadable ones are empty, or an error if strict. Keys
    that are no integers and non-finite scores are left out."""
    made = F.from_json("value", "map<string,double>", {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    rows = files.select(F.regexp_replace(stem(F.col("name")), r"\.json$", "").alias("video_id"), F.explode(F.coalesce(made, F.create_map().cast("map<string,double>"))).alias("k", "score"))
    return rows.where(F.col("k").rlike(r"^-?[0-9]+$") & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).select("video_id", F.col("k").cast("bigint").alias("center_frame"), "score")


def details(files: DataFrame) -> DataFrame:
    """video_id, center_frame, thresholds, monotonic, violations, score; keys that start with _ are left out, and each clip must have ten of both."""
    rows = files.select(F.regexp_replace(stem(F.col("name")), r"\.json$", "").alias("video_id"), F.explode(F.from_json("value", DETAIL)).alias("k", "d")).where(~F.col("k").startswith("_"))
    ok = F.assert_true((F.size("d.thresholds") == 10) & (F.size("d.monotonic_tail_probabilities") == 10), "a clip needs ten raw and ten projected probabilities")
    return rows.select("video_id", F.col("k").cast("bigint").alias("center_frame"), "d.thresholds", F.col("d.monotonic_tail_probabilities").alias("monotonic"), F.col("d.monotonic_violations").alias("violations"), "d.score", ok.alias("__ok")).where("__ok is null").drop("__ok")


def text_map(files: DataFrame, name: str = "text") -> DataFrame:
    """video_id, key and text of files of JSON objects of strings: captions, phrases."""
    rows = files.select(F.regexp_replace(stem(F.col("name")), r"\.json$", "").alias("video_id"), F.explode(F.from_json("value", "map<string,string>")).alias("key", name))
    return rows


def boxes(files: DataFrame) -> DataFrame:
    """video_id, img_path, x1, y1, x2, y2 of JSON objects of video -> [[path, x1, y1, x2, y2], ...]."""
    rows = files.select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("video_id", "b")).select("video_id", F.explode("b").alias("b"))
    return rows.select("video_id", F.col("b")[0].alias("img_path"), *[F.col("b")[k + 1].cast("double").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def metric_value(files: DataFrame) -> DataFrame:
    """name, metric: the number in a text file; null if it is none."""
    return files.select("name", F.expr("try_cast(trim(value) as double)").alias("metric"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line (its place in the file) of a text file read whole: annotation files are small."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def read_files(spark: SparkSession, folder: str, pattern: str = "[!_]*.json") -> DataFrame:
    """name (file name) and value (whole text) of the files of a folder and those below it."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return parsed_index(spark.read.text(path))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return parsed_annotations(read_lines(spark, path))


def read_scores(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    return score_map(read_files(spark, folder), strict)


def video_names(spark: SparkSession, folder: str | None = None, index: str | None = None, names: list[str] | None = None) -> DataFrame:
    """video_id, path, ordered by path: of just one of an index file, a list of names, and the video files below a folder."""
    if sum(x is not None for x in (folder, index, names)) != 1:
        raise ValueError("give one of folder, index and names")
    if index is not None:
        found = read_index(spark, index).select("path")
    elif names is not None:
        found = spark.createDataFrame([(n,) for n in names], "path string")
    else:
        found = list_videos(spark, folder)
    return found.select(stem(F.col("path")).alias("video_id"), "path").orderBy("path")


def list_videos(spark: SparkSession, folder: str) -> DataFrame:
    """path of every video file below a folder, ordered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.where(F.lower("path").rlike(r"\.(mp4|avi|mov|mkv)$")).orderBy("path")


def resolved_paths(names: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """name, path: the first that exists of nested, nested with each extension, flat, flat with each extension. files: path."""
    flat = F.element_at(F.split("name", "/"), -1)
    tails = [F.lit(""), *[F.lit(e) for e in (".mp4", ".avi", ".mov", ".mkv")]]
    options = F.array(*[F.concat(F.lit(f"{root}/"), base, t) for base in (F.col("name"), flat) for t in tails])
    asked = names.select("name", F.posexplode(options).alias("k", "path"))
    return asked.join(files.select("path"), "path").groupBy("name").agg(F.min_by("path", "k").alias("path"))
