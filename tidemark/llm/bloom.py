"""A blocked Bloom filter as one array of longs, built and asked by column expressions.

A key's hash names one block of 256 bits and one bit in each of the block's four words, so that one look-up decides. There are at most MOST_BLOCKS blocks
(32 bytes each), so the array may be broadcast whatever the number of keys: more keys only make it less selective. What passes needs an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

BITS_PER_KEY = 16
BLOCK_BITS = 256
MOST_BLOCKS = 1 << 20


def _bits(key: Column) -> Column:
    return F.xxhash64(key, F.lit("bits"))


def _mask(bits: Column, k: int) -> Column:
    """The bit of a key in word k of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int"))


def bloom_filter(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row, `bloom`: the four words of every block, one after the other; and how many blocks there are. keys: key, n of them."""
    blocks = min(MOST_BLOCKS, max(1, -(-n * BITS_PER_KEY // BLOCK_BITS)))
    set_ = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[_mask(_bits(F.col("key")), k).alias(f"m{k}") for k in range(4)])
    none = keys.sparkSession.range(blocks).select(F.col("id").alias("block"), *[F.lit(0).cast("bigint").alias(f"m{k}") for k in range(4)])
    every = set_.unionByName(none).groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(4)])
    words = F.array(*[f"w{k}" for k in range(4)]).alias("words")
    return every.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", words))), lambda x: x["words"])).alias("bloom")), blocks


def passes(key: Column, blocks: int, bloom: str = "bloom") -> Column:
    """Whether the filter in column `bloom` may hold the key."""
    at, bits = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int") * 4, _bits(key)
    hit = [F.get(bloom, at + k).bitwiseAND(_mask(bits, k)) != 0 for k in range(4)]
    return hit[0] & hit[1] & hit[2] & hit[3]


def may_hold(rows: DataFrame, key: str, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose key may be among the n keys (column `key`), and those whose key surely is not; a null key is not."""
    made, name = bloom_filter(keys, n), fresh("bloom", rows.columns)
    asked = rows.crossJoin(F.broadcast(made[0].withColumnRenamed("bloom", name)))
    hit = F.col(key).isNotNull() & passes(F.col(key), made[1], name)
    return asked.where(hit).drop(name), asked.where(~hit).drop(name)
