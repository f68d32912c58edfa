"""Longest work first to the least loaded job, without a list of all names in one place.

Names of equal work make up a class. Within a class the n items go, in turn, to the n least of the values load + m x work over jobs and m = 0, 1, ... (ties to the lowest job), so the
job of the k-th item is found from the loads at the class's start alone. Those loads are folded over the classes in one task: there are at most about the square root of
twice the total work of them, however many names there are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ranges import numbered


def _below(loads: np.ndarray, work: int, value: int) -> np.ndarray:
    """For each job, how many of load + m work are at most value."""
    return np.where(loads <= value, (value - loads) // work + 1, 0)


def _level(loads: np.ndarray, work: int, n: int) -> int:
    """The n-th least value."""
    lo, hi = int(loads.min()), int(loads.min()) + n * work
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if _below(loads, work, mid).sum() >= n else (mid + 1, hi)
    return lo


def dealt(loads: list[int], work: int, n: int) -> list[int]:
    """Loads after n items of the same work."""
    now = np.array(loads, dtype=np.int64)
    if not work or not n:
        return loads
    level = _level(now, work, n)
    counts = _below(now, work, level - 1)
    last = np.flatnonzero((level >= now) & ((level - now) % work == 0))[: n - int(counts.sum())]
    counts[last] += 1
    return (now + counts * work).tolist()


def job_of(loads: list[int], work: int, k: int) -> int:
    """The job of the k-th item (from 0) of a class."""
    now = np.array(loads, dtype=np.int64)
    if not work:
        return int(now.argmin())
    level = _level(now, work, k + 1)
    return int(np.flatnonzero((level >= now) & ((level - now) % work == 0))[k - int(_below(now, work, level - 1).sum())])


def balanced_jobs(items: DataFrame, jobs: int) -> DataFrame:
    """name, work, job: in order of work, then name, both falling. items: name (text, each once), work (not negative); a null work counts as 0."""
    rows = items.select("name", F.coalesce(F.col("work").cast("bigint"), F.lit(0)).alias("work"))

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("work", "descending")])
        loads, starts = [0] * jobs, []
        for work, n in zip(table["work"].to_pylist(), table["n"].to_pylist(), strict=True):
            starts.append(loads)
            loads = dealt(loads, work, n)
        yield pa.RecordBatch.from_arrays([table["work"].combine_chunks(), table["n"].combine_chunks(), pa.array(starts, pa.list_(pa.int64()))], names=["work", "n", "loads"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [job_of(loads, work, n - 1 - at) for work, at, n, loads in zip(*(b.column(c).to_pylist() for c in ("work", "position", "n", "loads")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("work"), pa.array(made, pa.int32())], names=["name", "work", "job"])

    classes = rows.groupBy("work").agg(F.count("*").alias("n"))
    loads = classes.groupBy(F.lit(1).alias("one")).applyInArrow(fold, "work bigint, n bigint, loads array<bigint>")
    placed = numbered(rows, ["name"], "position", ["work"]).join(loads, "work")
    return placed.select("name", "work", F.col("position").cast("bigint").alias("position"), "n", "loads").mapInArrow(deal, "name string, work bigint, job int")
