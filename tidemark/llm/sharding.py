"""Histogram sort into shards of near equal bytes.

Rows are ordered by a key and cut at splitters so that every shard holds nearly the same bytes. Splitters come from counting, not from a
sample: candidate boundaries (probes) are laid over the key space, every task counts the exact bytes and rows below each, and the sums
tell between which two probes a splitter lies. Probes are refined there until a splitter's count is within TOLERANCE of its target, or no
key lies between. Then rows are exchanged once, straight to their part.

The key is (XXH64 of the text, doc_id, place): equal texts are neighbours. Boundaries between texts are tried first, so equal texts share
a shard unless a splitter falls among more copies than the tolerance allows: then it falls between ids, or between repeated rows.

The driver holds probes and counts of the SHARDS - 1 splitters alone, however large the table is. The exchange is Spark's range exchange by (shard, key)
into parts of about PART_ROWS skinny rows, so no task holds a shard; a row's slot is its place in its part plus the rows of its shard in the parts
before, which are added up from one count for each part.

Defined results: a null text has size 1, and the CRC and hash of an empty one; null ids come first among equal texts; repeated rows get slots of
their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import read, slices, small_batches, stored

SHARDS = 8
#: Of a shard's bytes: how far a splitter's count may be from its target.
TOLERANCE = 0.01
#: Rows of a part (of about 50 bytes each).
PART_ROWS = 1 << 20
#: Counts of parts (24 bytes each) are broadcast up to so many.
BROADCAST_PARTS = 1_000_000
PROBES = 32
LOW = -(1 << 63)
Key = tuple[int, int, int]
LEVELS = 3


def below(keys: list[np.ndarray], probes: list[Key]) -> np.ndarray:
    """For each row, how many of the sorted probes are at or below its key."""
    first = np.array([p[0] for p in probes], dtype=np.int64)
    out = np.searchsorted(first, keys[0], side="right")
    if len(keys) == 1:
        return out
    left = np.searchsorted(first, keys[0], side="left")
    tied = np.flatnonzero(out > left)
    for start in np.unique(left[tied]):
        rows = tied[left[tied] == start]
        own = [p[1:] for p in probes[start : out[rows[0]]]]
        out[rows] = start + below([k[rows] for k in keys[1:]], own)
    return out


def skinny(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, k0, k1, k2 of every row: 40 bytes that the counting reads again and again."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            h = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array(h)], names=["doc_id", "size", "text_crc32", "k0"])

    made = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, size bigint, text_crc32 bigint, k0 bigint")
    return made.select("*", F.coalesce("doc_id", F.lit(LOW)).alias("k1"), F.monotonically_increasing_id().alias("k2"))


def counted(rows: DataFrame, probes: list[Key]) -> dict[int, tuple]:
    """Between probe i - 1 and probe i (sorted): (bytes, rows, least key, greatest key), exactly. A task sends a row for each interval that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, *keys = (b.column(c).to_numpy() for c in ("size", "k0", "k1", "k2"))
            at = below(keys, probes)
            order = np.lexsort((*reversed(keys), at))
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            lasts = np.append(starts[1:], len(order)) - 1
            lo, hi = order[starts], order[lasts]
            cols = [at[lo].astype(np.int64), np.add.reduceat(size[order], starts), lasts - starts + 1, *(k[lo] for k in keys), *(k[hi] for k in keys)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["i", "bytes", "rows", "a0", "a1", "a2", "z0", "z1", "z2"])

    schema = "i bigint, bytes bigint, rows bigint, a0 bigint, a1 bigint, a2 bigint, z0 bigint, z1 bigint, z2 bigint"
    got = rows.select("size", "k0", "k1", "k2").mapInArrow(run, schema).groupBy("i")
    got = got.agg(F.sum("bytes"), F.sum("rows"), F.min(F.struct("a0", "a1", "a2")), F.max(F.struct("z0", "z1", "z2"))).collect()
    return {r[0]: (r[1], r[2], tuple(r[3]), tuple(r[4])) for r in got}


def _refined(low: Key, high: Key, n: int) -> list[Key]:
    """Probes that close off the keys low..high (both are rows) and cut them in about n: by the first level in which they differ, the others lowest."""
    level = next((k for k in range(LEVELS) if low[k] != high[k]), LEVELS - 1)
    a, z = low[level], high[level]
    at = sorted({a + (z - a) * k // n for k in range(1, n + 1)} - {a})
    return [low, *((*low[:level], v, *[LOW] * (LEVELS - 1 - level)) for v in at), (*high[:-1], high[-1] + 1)]


def splitters(rows: DataFrame, targets: list[tuple[int, int]]) -> dict[int, tuple[Key, int, int]]:
    """For each (target bytes, allowed error): a key, with the exact bytes and rows below it, whose bytes are within the error or that is the nearest border between rows.

    A round cuts the keys between which a splitter lies to a 32nd, and a key has 3 times 64 bits: some 40 rounds settle any table."""
    probes: list[Key] = [(LOW + ((k << 64) // 1024), LOW, LOW) for k in range(1, 1024)]
    known: dict[Key, tuple[int, int]] = {}
    out: dict[int, tuple[Key, int, int]] = {}
    while True:
        probes = sorted(set(probes))
        got = counted(rows, probes)
        bytes_, count, below_probe = 0, 0, []
        for i in range(len(probes) + 1):
            size, n, *_ = got.get(i, (0, 0))
            bytes_, count = bytes_ + size, count + n
            below_probe.append((bytes_, count))
        known |= dict(zip(probes, below_probe, strict=False))
        near = sorted(known.items(), key=lambda x: x[0])
        sums = np.array([x[1][0] for x in near])
        new: list[Key] = []
        for target, error in targets:
            if target in out:
                continue
            k = int(np.argmin(np.abs(sums - target)))
            key, (size, n) = near[k]
            # the interval of this round's probes in which the target lies
            i = int(np.searchsorted([s for s, _ in below_probe], target, side="left"))
            inside = got.get(i) if i <= len(probes) else None
            if abs(size - target) <= error or inside is None or inside[2] == inside[3]:
                out[target] = (key, size, n)
            else:
                new += _refined(inside[2], inside[3], PROBES)
        if not new:
            return out
        probes = new


def sharded(docs: DataFrame, shards: int = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows, _ = stored(skinny(docs), "keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    targets = [(total * k // shards, int(total / shards * TOLERANCE)) for k in range(1, shards)] if total else []
    found = splitters(rows, targets) if targets else {}
    borders = sorted(found[t][0] for t, _ in targets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = below([b.column(c).to_numpy() for c in ("k0", "k1", "k2")], borders)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard.astype(np.int32))], names=[*b.schema.names, "shard"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            shard = b.column("shard").to_numpy()
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            at = np.arange(len(shard)) - starts[np.searchsorted(starts, np.arange(len(shard)), side="right") - 1]
            if len(shard) and shard[0] == last:  # goes on where the batch before ended
                at[: starts[1] if len(starts) > 1 else len(at)] += seen
            if len(shard):
                last, seen = int(shard[-1]), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(np.full(len(shard), part)), pa.array(at)], names=["doc_id", "size", "text_crc32", "shard", "part", "at"])

    order = ["shard", "k0", "k1", "k2"]
    placed = rows.mapInArrow(place, "doc_id bigint, size bigint, text_crc32 bigint, k0 bigint, k1 bigint, k2 bigint, shard int")
    parts = placed.repartitionByRange(max(1, shards, -(-count // part_rows)), *order).sortWithinPartitions(*order)
    numbered, _ = stored(parts.mapInArrow(number, "doc_id bigint, size bigint, text_crc32 bigint, shard int, part bigint, at bigint"), "numbered")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    small = -(-count // part_rows) + 2 * shards <= BROADCAST_PARTS  # a shard has all rows of its parts but for those at its ends
    out = numbered.join(F.broadcast(counts) if small else counts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
