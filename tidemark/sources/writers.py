"""Writers: score maps, metrics, CSV, Markdown."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F


def score_maps(scores: DataFrame) -> DataFrame:
    """video_id and value: one JSON object of frame -> score for each video, in order of frames."""
    pairs = F.array_sort(F.collect_list(F.struct("center_frame", "score")))
    m = scores.groupBy("video_id").agg(pairs.alias("p")).withColumn("m", F.map_from_entries(F.transform("p", lambda x: F.struct(x["center_frame"].cast("string"), x["score"]))))
    return m.select("video_id", F.to_json("m").alias("value"))


def write_score_maps(scores: DataFrame, path: str) -> None:
    """A folder for each video, replaced as a whole when it is written again; others stay."""
    score_maps(scores).repartition("video_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """name: value lines of a one-row table."""
    one = metrics.select(F.explode(F.array(*[F.concat_ws(": ", F.lit(c), F.col(c).cast("string")) for c in metrics.columns])).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, most: int = 1_000) -> str:
    """A table of a small result as Markdown; more than `most` rows are an error, as a report that leaves some out would not say so."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows: write them as CSV")
    lines = [rows.columns, ["---"] * len(rows.columns), *[[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in got]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def config_hash(config: dict) -> str:
    """SHA-256 of the canonical JSON of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def config_hash_of(config: Column) -> Column:
    """config_hash of a struct column whose fields are in the order of their names."""
    return F.sha2(F.to_json(config).cast("binary"), 256)


def check_manifest(saved: dict | None, config: dict) -> dict:
    """The manifest of a run; an error if the saved one belongs to another configuration."""
    made = {"config": config, "config_sha256": config_hash(config)}
    if saved is not None and saved.get("config_sha256") != made["config_sha256"]:
        raise ValueError("the output belongs to a run with another configuration")
    return made
