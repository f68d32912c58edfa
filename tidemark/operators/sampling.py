"""Order-dependent frame sampling: greedy picks as folds, seeded choices, and seeded shuffles in Arrow batches."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def interleaved(a: Column, b: Column) -> Column:
    """a1, b1, a2, b2, ..."""
    return F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))


def rotated(a: Column) -> Column:
    """The first value moved to the end."""
    return F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1))


def middle(a: Column) -> Column:
    """The frame in the middle alone."""
    return F.array(F.element_at(a, (F.size(a) / 2).cast("int") + 1))


def _targets(a: Column, z: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: a + (z - a) * k / (n - 1)) if n > 1 else F.slice(F.array((a + z) / 2), 1, n)


def dense_pick(times: Column, center: Column, start: Column, end: Column, n_global: int = 4, n_center: int = 6) -> Column:
    """Indices of n_global frames spread over all and n_center within [start, end]: each target takes the nearest free frame (lowest index on ties); what is short is
    filled from the targets left, then by nearness to center, then by repeating the frame nearest it. Folds over the targets with what is taken so far; no frames, no indices."""
    every = F.sequence(F.lit(0), F.size(times) - 1)
    none = F.array().cast("array<int>")
    inside = lambda i: (F.get(times, i) >= start - 1e-9) & (F.get(times, i) <= end + 1e-9)

    def nearest(taken: Column | None, target: Column, allowed: object = None) -> Column:
        """The free frame nearest to the target, as an array of one or none."""
        free = every if taken is None else F.filter(every, lambda i: ~F.array_contains(taken, i) & (allowed(i) if allowed else F.lit(True)))
        best = F.array_min(F.transform(free, lambda i: F.struct(F.abs(F.get(times, i) - target).alias("d"), i.alias("i"))))
        return F.array_compact(F.array(best["i"]))

    fill = lambda taken, t: F.concat(taken, nearest(taken, t))
    spread = F.aggregate(_targets(F.get(times, F.lit(0)), F.element_at(times, -1), n_global), none, fill)

    def inner(s: Column, t: Column) -> Column:
        got = nearest(s["taken"], t, inside)
        return F.struct(F.concat(s["taken"], got).alias("taken"), F.concat(s["missed"], F.when(F.size(got) == 0, F.array(t)).otherwise(F.array().cast("array<double>"))).alias("missed"))

    state = F.aggregate(_targets(start, end, n_center), F.struct(spread.alias("taken"), F.array().cast("array<double>").alias("missed")), inner)
    taken = F.aggregate(state["missed"], state["taken"], fill)
    n = n_global + n_center
    taken = F.aggregate(F.sequence(F.lit(1), F.lit(n)), taken, lambda s, _: F.when(F.size(s) < n, fill(s, center)).otherwise(s))
    whole = F.aggregate(F.array(F.lit(0)), taken, lambda s, _: F.concat(s, F.flatten(F.array_repeat(nearest(None, center), n - F.size(s)))))
    order = F.transform(F.array_sort(F.transform(whole, lambda i: F.struct(F.get(times, i).alias("t"), i.alias("i")))), lambda x: x["i"])
    return F.when(F.size(times) > 0, order).otherwise(none)


def dense_selected(windows: DataFrame) -> DataFrame:
    """windows (key, times, center, start, end) with indices."""
    return windows.select(F.col("key").cast("bigint").alias("key"), dense_pick(F.col("times"), F.col("center"), F.col("start"), F.col("end")).alias("indices"))


def seeded_head(rows: DataFrame, keys: list[str], n: int, seed: int = 17) -> DataFrame:
    """The first n rows, with key, in an order drawn by a digest of the seed and the key columns: the same on every run."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"), 256)
    return rows.withColumn("key", key).orderBy("key").limit(n)


def shuffled(rows: DataFrame, seed: int = 17) -> DataFrame:
    """rows (key, frames) with frames in an order drawn from a generator seeded by the key's digest: the same on every run and cluster."""
    from ..functions.ordinal import stable_seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, frames in zip(b.column("seed").to_pylist(), b.column("frames").to_pylist(), strict=True):
                random.Random(int(s)).shuffle(frames)
                out.append(frames)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.int64()))], names=["key", "frames"])

    seeded = rows.select(F.col("key").cast("bigint"), F.col("frames").cast("array<bigint>"), stable_seed(F.lit(str(seed)), F.col("key").cast("string")).alias("seed"))
    return seeded.mapInArrow(run, "key bigint, frames array<bigint>")
