"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a Hadamard transform, and hashed to the nearest signed axis: the coordinate of
largest magnitude and its sign. FUNCTIONS(N) such values make a key; TABLES tables have their own rotations. A query probes, in every
table, the keys of least cost: the sums of how far each axis falls short of the best one. All members of the probed keys are candidates,
and are ranked by the exact measure on the original vectors.

How many keys to probe is fitted: SAMPLE queries are answered exactly over all rows, and the fewest probes are taken that find TARGET of
their neighbours. If MOST probes do not, hashing is of no use on these vectors, and every query meets all rows in blocks; so does a query that
finds fewer than K. Vectors of unequal length get one more
coordinate that makes all of one length, so that the nearest angle is the largest inner product.

Neighbouring keys form groups of about TILE_BYTES of members. A vector is sent to its group once for each table, a query once to each group in which it
probes keys, in the element type of the input. Groups are dealt to tiles of about TILE_BYTES by TILE_Q queries, so a hot key is many tasks. A tile gives
back each query's K best of that tile, which loses nothing, as the K best overall are among them. Ties go to the smaller id.

Defined results: vectors that are null, zero, not of the usual length, or hold null or non-finite values take no part; a row is no
candidate for a query of its own id; rows repeated in id and vector count once; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import read, stored
from .components import met

K = 20
QUERY_STEP = 20
TABLES = 2
SAMPLE = 128
TARGET = 0.96
MOST = 4096
SEED = 11
BUCKET = 256
#: Bytes of a tile's members in double precision, and its queries.
TILE_BYTES, TILE_Q = 16 << 20, 2048


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, vec (little-endian bytes: of float64 if the column holds doubles, else of float32), width and length of the rows that take part."""
    kind = element(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if len(x) and np.isfinite(x).all() and x.any():
                    out.append((i, x.astype(kind).tobytes(), len(x), float(np.sqrt(x @ x))))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.float64()), strict=True)], names=["vec_id", "vec", "width", "length"])

    return rows.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "vec_id bigint, vec binary, width int, length double")


def element(rows: DataFrame) -> str:
    """The numpy type that holds the embedding's elements exactly."""
    return "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) in double precision; the elements' type shows in the bytes of a row."""
    raw = column.to_pylist()
    kind = "<f4" if raw and len(raw[0]) == 4 * width else "<f8"
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(-1, width).astype(np.float64)


class Rotations:
    """TABLES x functions pseudo-rotations, and the keys that they give."""

    def __init__(self, width: int, functions: int, longest: float | None, tables: int = TABLES, seed: int = SEED) -> None:
        self.width, self.functions, self.longest, self.tables = width, functions, longest, tables
        self.size = 1 << max(1, (width + (longest is not None) - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, functions, 3, self.size))

    def turned(self, x: np.ndarray, query: bool, table: int, function: int) -> np.ndarray:
        """The vectors as unit ones, padded and turned."""
        y = np.zeros((len(x), self.size))
        length = np.sqrt((x * x).sum(axis=1))
        if self.longest is None or query:
            y[:, : self.width] = x / length[:, None]
        else:
            y[:, : self.width] = x / self.longest
            y[:, self.width] = np.sqrt(np.maximum(0.0, 1.0 - (length / self.longest) ** 2))
        for signs in self.signs[table, function]:
            y *= signs
            step = 1
            while step < self.size:
                z = y.reshape(len(x), -1, 2, step)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(x), self.size)
                step *= 2
            y /= math.sqrt(self.size)
        return y

    def keys(self, x: np.ndarray, table: int) -> np.ndarray:
        """The key of each row: axis and sign of each function as one number."""
        out = np.zeros(len(x), dtype=np.int64)
        for f in range(self.functions):
            y = self.turned(x, False, table, f)
            axis = np.abs(y).argmax(axis=1)
            out = out * (2 * self.size) + 2 * axis + (y[np.arange(len(x)), axis] < 0)
        return out

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """(rows, up to n) keys by rising cost."""
        per = 2 * self.size if self.functions <= 1 else max(2, min(2 * self.size, math.ceil(n ** (1 / self.functions)) * 2))
        cost, keys = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
        for f in range(self.functions):
            y = self.turned(x, True, table, f)
            both = np.stack([y, -y], axis=2).reshape(len(x), -1)  # code 2 * axis + sign
            short = both.max(axis=1, keepdims=True) - both
            best = np.argsort(short, axis=1, kind="stable")[:, :per]
            own = np.take_along_axis(short, best, axis=1) ** 2
            cost = (cost[:, :, None] + own[:, None, :]).reshape(len(x), -1)
            keys = (keys[:, :, None] * (2 * self.size) + best[:, None, :]).reshape(len(x), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(keys, order, axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, added up in one order whatever the shape."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def best_of(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of each query's k nearest of x, not of its own id; ties to the smaller id."""
    rough = q @ x.T
    rough[q_ids[:, None] == x_ids[None, :]] = -np.inf
    if len(x) > k:
        least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
        scale = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)).max()
        i, j = np.nonzero(rough >= np.where(np.isfinite(least), least - 1e-12 * scale, -np.finfo(float).max)[:, None])
    else:
        i, j = np.nonzero(np.isfinite(rough))
    score = inner(q[i], x[j])
    order = np.lexsort((x_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    keep = rank < k
    return i[keep], j[keep], score[keep]


_PAIRS = "query_id bigint, vec_id bigint, score double"


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query: equal pairs found in several tables count once. Each task keeps k of a query before the exchange."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.dense_rank().over(by)).where(F.col("rank") <= k).distinct()


def fitted(base: DataFrame, turns: Rotations, queries: DataFrame, k: int) -> int | None:
    """The fewest probes (a power of two, or all keys) that find TARGET of the exact neighbours of SAMPLE queries; None if MOST do not."""
    picked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not picked:
        return 1
    q_ids, q = np.array([r.vec_id for r in picked]), matrix(pa.array([bytes(r.vec) for r in picked]), turns.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            x = matrix(b.column(1), turns.width)
            i, j, score = best_of(q_ids, q, ids, x, k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(score), b.column(1).take(pa.array(j))], names=["query_id", "vec_id", "score", "vec"])

    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    true = base.select("vec_id", "vec").mapInArrow(run, _PAIRS + ", vec binary").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).collect()
    if not true:
        return 1
    at = {int(i): n for n, i in enumerate(q_ids)}
    own = np.array([at[r.query_id] for r in true])
    x = matrix(pa.array([bytes(r.vec) for r in true]), turns.width)
    most = min(MOST, (2 * turns.size) ** turns.functions)
    place = np.full(len(true), most + 1)
    for t in range(turns.tables):
        probes, keys = turns.probes(q, t, most), turns.keys(x, t)
        found = probes[own] == keys[:, None]
        place = np.minimum(place, np.where(found.any(axis=1), found.argmax(axis=1) + 1, most + 1))
    need = int(np.sort(place)[math.ceil(TARGET * len(place)) - 1])
    return need if need <= most else None


def best_by_key(q_ids: np.ndarray, q: np.ndarray, q_keys: list[np.ndarray], x_ids: np.ndarray, x: np.ndarray, x_keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of each query's k nearest of those x whose key is one of its own."""
    order = np.argsort(x_keys, kind="stable")
    keys = x_keys[order]
    asked = np.concatenate(q_keys)
    owner = np.repeat(np.arange(len(q)), [len(a) for a in q_keys])
    lo, hi = np.searchsorted(keys, asked, side="left"), np.searchsorted(keys, asked, side="right")
    found = []
    for start in np.unique(lo[hi > lo]):
        own = np.unique(owner[(lo == start) & (hi > lo)])
        block = order[start : np.searchsorted(keys, keys[start], side="right")]
        i, j, score = best_of(q_ids[own], q[own], x_ids[block], x[block], k)
        found.append((own[i], block[j], score))
    if not found:
        return asked[:0], asked[:0], np.zeros(0)
    i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((x_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
    return i[keep], j[keep], score[keep]


def searched(base: DataFrame, queries: DataFrame, turns: Rotations, probes: int, k: int, n: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k best of every query among the members of the keys that it probes. n: the rows of base."""
    width, every = turns.width, (2 * turns.size) ** turns.functions
    tile_x = max(1, TILE_BYTES // (8 * width))
    groups = max(1, min(every, -(-n // tile_x)))
    schema, key = "t int, group bigint, id bigint, vec binary, keys array<bigint>", ["t", "group"]
    names = ["t", "group", "id", "vec", "keys"]

    def member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), width)
            for t in range(turns.tables):
                keys = turns.keys(x, t)
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(group_of(keys)), b.column(0), b.column(1), own], names=names)

    def group_of(keys: np.ndarray) -> np.ndarray:
        return np.minimum((keys.astype(np.float64) * (groups / every)).astype(np.int64), groups - 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), width)
            for t in range(turns.tables if len(x) else 0):
                keys = turns.probes(x, t, probes)
                group, row = group_of(keys).reshape(-1), np.repeat(np.arange(len(x)), keys.shape[1])
                order = np.lexsort((group, row))
                starts = np.flatnonzero(np.diff(row[order] * groups + group[order], prepend=-1))
                at = pa.array(row[order][starts])
                own = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(keys.reshape(-1)[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), t, dtype=np.int32)), pa.array(group[order][starts]), b.column(0).take(at), b.column(1).take(at), own], names=names)

    x, q = base.select("vec_id", "vec").mapInArrow(member, schema), queries.select("vec_id", "vec").mapInArrow(probe, schema)
    sizes = q.groupBy(key).agg(F.count("*").alias("nq")).join(x.groupBy(key).agg(F.count("*").alias("nx")), key)
    sizes, _ = stored(sizes.select(*key, "nq", "nx", F.expr(f"int(ceil(nq / {TILE_Q}))").alias("tq"), F.expr(f"int(ceil(nx / {tile_x}))").alias("tx")), "groups")
    total = sizes.agg(F.coalesce(F.sum("nq"), F.lit(0)), F.coalesce(F.sum("nx"), F.lit(0))).first()

    def dealt(df: DataFrame, side: int) -> DataFrame:
        count, own, other = ("nq", "tq", "tx") if side == 0 else ("nx", "tx", "tq")
        placed = met(df, sizes.select(*key, own, other, F.col(count).alias("n")), key, total[side])
        placed = placed.withColumn("own", F.expr(f"int(pmod(xxhash64(id, 3), {own}))")).withColumn("other", F.explode(F.expr(f"sequence(0, {other} - 1)")))
        iq, ix = ("own", "other") if side == 0 else ("other", "own")
        return placed.select(*key, F.col(iq).alias("iq"), F.col(ix).alias("ix"), "id", "vec", "keys", F.lit(side).alias("side"))

    def of_tile(table: pa.Table) -> pa.Table:
        side, ids, keys = table["side"].to_numpy(), table["id"].to_numpy(), table["keys"].combine_chunks()
        v = matrix(table["vec"].combine_chunks(), width)
        qi, xi = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j, score = qi[:0], xi[:0], np.zeros(0)
        if len(qi) and len(xi):
            own = [keys[int(r)].values.to_numpy() for r in qi]
            i, j, score = best_by_key(ids[qi], v[qi], own, ids[xi], v[xi], keys.take(pa.array(xi)).flatten().to_numpy(), k)
        return pa.table({"query_id": ids[qi][i], "vec_id": ids[xi][j], "score": score})

    pairs = dealt(q, 0).unionByName(dealt(x, 1)).groupBy(*key, "iq", "ix").applyInArrow(of_tile, _PAIRS)
    return _ranked(pairs, k)


def nearest(rows: DataFrame, is_query: str, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query (SQL on vec_id) holds."""
    every, _ = stored(vectors(rows), "vectors")
    usual = every.groupBy("width").agg(F.count("*").alias("n"), F.min("length").alias("a"), F.max("length").alias("z")).orderBy(F.desc("n"), "width").first()
    if usual is None:
        return every.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    base = every.where(F.col("width") == usual.width)
    width, n = usual.width, usual.n
    longest = None if usual.z - usual.a <= 1e-3 * usual.z else usual.z
    functions = max(1, int(math.log(max(n / BUCKET, 1)) / math.log(2 * Rotations(width, 0, longest).size)))
    turns = Rotations(width, functions, longest)
    queries = base.where(is_query)
    probes = fitted(base, turns, queries, k)
    if probes is None:  # every vector is a candidate
        turns, probes = Rotations(width, 0, turns.longest, tables=1), 1

    found, _ = stored(searched(base, queries, turns, probes, k, n), "found")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    short, _ = stored(queries.join(full, queries["vec_id"] == full["query_id"], "left_anti").select("vec_id", "vec").distinct(), "short")
    if turns.functions and short.head(1):  # one key holds all: these queries meet every row
        exact = searched(base, short, Rotations(width, 0, longest, tables=1), 1, k, n)
        found = found.join(full, "query_id", "left_semi").unionByName(exact)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), f"vec_id % {QUERY_STEP} = 0")
