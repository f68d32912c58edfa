"""A run's settings, its claim on an output folder, and what it leaves on record."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import snapshots


@dataclass
class RunConfig:
    """Settings of a run; from_lines reads KEY=value lines, and keeps what it does not know in `other`."""

    interval: int = 16
    window_seconds: float = 10.0
    default_score: float = 0.5
    sigma: float = 10.0
    backend: str = "lookup"
    other: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_lines(cls, lines: list[str]) -> RunConfig:
        kinds = {f.name: type(f.default) for f in fields(cls) if f.name != "other"}
        known, other = {}, {}
        for line in lines:
            if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)=(.*?)\s*$", line):
                name, value = m[1].lower(), m[2].strip("\"'")
                if name in kinds:
                    known[name] = kinds[name](value)
                else:
                    other[m[1]] = value
        return cls(**known, other=other)


def claim(spark: SparkSession, folder: str, seconds: float = 3600.0, now: int | None = None) -> snapshots.Lease | None:
    """A lease on an output folder, or None while another run holds one: one run at a time owns an output, on any Hadoop file system, and a run that dies loses it when its time is up."""
    return snapshots.acquire(spark, folder, seconds, now=now)


def release(spark: SparkSession, lease: snapshots.Lease) -> None:
    snapshots.release(spark, lease)


def run_record(scores: DataFrame, errors: DataFrame, seconds: DataFrame) -> DataFrame:
    """One row: videos, clips, failed, total and slowest video's seconds. seconds: video_id, seconds."""
    s = scores.agg(F.countDistinct("video_id").alias("videos"), F.count("*").alias("clips"))
    return s.crossJoin(errors.agg(F.count("*").alias("failed"))).crossJoin(seconds.agg(F.sum("seconds").alias("seconds"), F.max("seconds").alias("slowest")))
