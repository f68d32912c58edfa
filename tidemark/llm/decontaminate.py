"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items (short) are queries, documents (long) are what contains them. containment = share of an item's distinct 5-word shingles that the
document has; THRESHOLD 0.8 or more counts. A MinHash of a long document hardly ever shares a minimum with a short item, so the sketch
is taken of the item and looked up in the document: the smallest hashes of an item are a uniform sample of its shingles, and
each is in the document with a probability that equals the containment, however long the document is. Items are partitioned by
size; a partition's sketch length s is its largest allowed number of missing shingles plus one, so that a document which reaches the
threshold has at least one of the s (no true pair is missed). Candidates are then verified on the shingles themselves.

One pass over the documents, however many items there are: a Bloom filter of all sketch hashes (of at most MOST_BITS bits: that is the
bound of what is sent to every task; more hashes only make it less selective) is what each shingle of a document meets first. Shingles that
pass go to a join with the sketches by their hash, in which frequent hashes are spread over tasks (components.met). Items stay in
tables; equal items are looked up once.

Words: lower-cased, split at ASCII white space, signs at either end cut, empty ones left out. An item with fewer than 5 words is one
shingle of its whole sequence. Defined results: null or empty items and texts match nothing; repeated rows give repeated pairs collapsed
to one; rows with a null id match but keep their null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Memo, append_column, by_batch, fresh, read, slices, stored
from .components import met

SHINGLE = 5
THRESHOLD = 0.8
#: So many items, about, are held against a text at once.
ASKED = 1024
#: Bits of the filter for each sketch hash, and its bounds.
BITS_PER_HASH = 128
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
FACTOR = 0x9E3779B97F4A7C15


def word_of(chunk: bytes) -> str:
    """A chunk between white space without the signs at its ends."""
    c = chunk.decode("utf-8")
    a, b = 0, len(c)
    while a < b and not c[a].isalnum():
        a += 1
    while b > a and not c[b - 1].isalnum():
        b -= 1
    return c[a:b]


def chunks(text: str | None) -> list[bytes]:
    # bytes.split() knows ASCII white space only: other spaces belong to words
    return text.lower().encode("utf-8", "replace").split() if text else []


def words(text: str | None) -> list[str]:
    return [w for c in chunks(text) if (w := word_of(c))]


def grams(w: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words(text)
    return grams(w, min(SHINGLE, len(w))) if w else set()


def most_missing(size: int) -> int:
    """How many of an item's shingles may be missing at THRESHOLD."""
    return max(m for m in range(size + 1) if size - m >= THRESHOLD * size - 1e-9)


def chunk_hash(chunk: bytes) -> tuple[int, ...]:
    """The hash of a chunk's word, or none for a chunk of signs."""
    w = word_of(chunk)
    return (xxhash.xxh3_64_intdigest(w.encode()),) if w else ()


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n neighbours; it tells n as well."""
    if len(h) < n:
        return h[:0]
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(FACTOR) + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def sketch(words: str) -> tuple[int, list[int]]:
    """The shingle length of an item (its words, joined by blanks), and its sketch: the least hashes, as many as the partition of its size asks for."""
    h = np.array([chunk_hash(c.encode())[0] for c in words.split(" ")], dtype=np.uint64)
    n = min(SHINGLE, len(h))
    own = np.unique(rolled(h, n))
    s = most_missing((1 << len(own).bit_length()) - 1) + 1
    return n, own[:s].view(np.int64).tolist()


def positions(bits: int) -> list[str]:
    """The places of a hash in the filter, as SQL on `hash` and, below, in numpy."""
    return [f"hash & {bits - 1}L", f"shiftrightunsigned(hash, 32) & {bits - 1}L", f"shiftrightunsigned(hash, 17) & {bits - 1}L"]


class Filter:
    """A Bloom filter of 64-bit hashes."""

    def __init__(self, sketches: DataFrame, count: int) -> None:
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (count * BITS_PER_HASH).bit_length()))
        at = sketches.select(F.explode(F.expr(f"array({', '.join(positions(self.bits))})")).alias("at"))
        got = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("set")).toArrow()
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)
        self.words[got["word"].to_numpy()] = got["set"].to_numpy().view(np.uint64)

    def passed(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.bits - 1)
        for shift in (0, 32, 17):
            if not len(h):
                break
            at = (h >> np.uint64(shift)) & mask
            h = h[(self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        return h


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item (a hash of the words), words: the items that have words."""

    def start():
        def make(cols):
            joined = [" ".join(words(t)) for t in cols[1]]
            return [(cols[0], pa.int64()), ([xxhash.xxh64_intdigest(w.encode()) - (1 << 63) for w in joined], pa.int64()), (joined, pa.string())]

        return make

    made = by_batch(benchmark.select(F.col("item_id").cast("bigint"), "text"), start, "item_id bigint, item bigint, words string")
    return made.where("words <> ''").distinct()


def sketches_of(items: DataFrame) -> DataFrame:
    """item, n, hash: the sketch of every item."""

    def start():
        def make(cols):
            made = [(i, n, h) for i, w in zip(*cols, strict=True) for n, hs in [sketch(w)] for h in hs]
            return list(zip(list(zip(*made, strict=True)) or [()] * 3, (pa.int64(), pa.int32(), pa.int64()), strict=True))

        return make

    return by_batch(items.select("item", "words").distinct(), start, "item bigint, n int, hash bigint")


def hits(lengths: list[int], bloom: Filter) -> Callable[[], Callable[[str | None], list[int]]]:
    """For a text, the distinct hashes of its shingles that pass the filter."""

    def start() -> Callable[[str | None], list[int]]:
        look = Memo(chunk_hash).__getitem__

        def one(text: str | None) -> list[int]:
            h = np.fromiter(chain.from_iterable(map(look, chunks(text))), dtype=np.uint64)
            found = [bloom.passed(rolled(h, n)) for n in lengths]
            return np.unique(np.concatenate(found)).view(np.int64).tolist() if any(map(len, found)) else []

        return one

    return start


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, item, shared, item_shingles of the candidates (key, text, asked: a list of item and words) at THRESHOLD or more, on the shingles themselves."""
    for b in slices(batches):
        out = []
        for key, text, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
            w, own = words(text), {}
            for one in asked:
                said = one["words"].split(" ")
                n = min(SHINGLE, len(said))
                if n not in own:
                    own[n] = grams(w, n)
                said = grams(said, n)
                shared = len(said & own[n])
                if shared >= THRESHOLD * len(said) - 1e-9:
                    out.append((key, one["item"], shared, len(said)))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "item", "shared", "item_shingles"])


def counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def searched(docs: DataFrame, items: DataFrame, every: bool) -> tuple[DataFrame, str, DataFrame | None]:
    """docs written with a row key, the name of its column, and (key, item, shared, item_shingles) of the pairs at THRESHOLD or more (None without items). Unless
    `every` row is wanted, only rows with a shingle that passes the filter are written."""
    sketches, _ = stored(sketches_of(items), "sketches")
    count, lengths = sketches.agg(F.count("*"), F.collect_set("n")).first()
    if not count:
        return docs, "", None
    key, passed = fresh("__key", docs.columns), fresh("__hits", docs.columns)
    made = append_column(docs, docs.columns, hits(sorted(lengths), Filter(sketches, count)), passed, T.ArrayType(T.LongType()))
    made = made if every else made.where(F.size(passed) > 0)
    rows, _ = stored(made.withColumn(key, F.monotonically_increasing_id()), "searched")
    asked, _ = stored(rows.select(F.col(key).alias("key"), F.explode(passed).alias("hash")), "asked")
    owners = sketches.select("hash", "item").join(counted(asked, "hash"), "hash")
    pairs, _ = stored(met(asked, owners, "hash", asked.count()).select("key", "item").distinct(), "candidates")
    said = items.select("item", "words").distinct().join(counted(pairs, "item"), "item")
    texts = rows.where(F.size(passed) > 0).select(F.col(key).alias("key"), "text")
    # a text meets up to about ASKED of its items in one row, so it is not copied for each
    slots = counted(pairs, "key").select("key", F.expr(f"int(ceil(n / {ASKED}))").alias("slots"))
    asking = met(pairs, said, "item", pairs.count()).select("key", "item", "words").join(slots, "key")
    asking = asking.groupBy("key", F.expr("pmod(xxhash64(item), slots)").alias("slot")).agg(F.collect_list(F.struct("item", "words")).alias("asked"))
    full = asking.join(texts, "key").select("key", "text", "asked")
    return rows.drop(passed), key, stored(full.mapInArrow(verified, "key bigint, item bigint, shared int, item_shingles int"), "contained")[0]


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment for every document and item at THRESHOLD or more."""
    items, _ = stored(items_of(benchmark), "items")
    rows, key, found = searched(docs.select(F.col("doc_id").cast("bigint"), "text"), items, every=False)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, shared int, item_shingles int, containment double")
    ids = items.select("item", "item_id").join(counted(found, "item"), "item")
    out = met(found, ids, "item", found.count()).join(rows.select(F.col(key).alias("key"), "doc_id"), "key")
    return out.select("doc_id", "item_id", "shared", "item_shingles").distinct().withColumn("containment", F.round(F.col("shared") / F.col("item_shingles"), 6))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that contain an item, with the columns of docs. Null and empty texts contain none and stay; repeated rows stay or go together."""
    items, _ = stored(items_of(benchmark), "items")
    rows, key, found = searched(docs, items, every=True)
    if found is None:
        return docs
    leaks = found.select(F.col("key").alias(key)).distinct()
    return rows.join(leaks, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_W = "[x for x in [regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') for w in regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]')] if x <> '']"
_S = "list_distinct([array_to_string(w[i : i + m - 1], ' ') for i in range(1, len(w) - m + 2)])"
ORACLE = f"""
WITH i AS (SELECT item_id, {_W} AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, m, {_S} AS s FROM (SELECT *, least(5, len(w)) AS m FROM i WHERE len(w) > 0)),
q AS (SELECT item_id, m, len(s) AS n, unnest(s) AS g FROM s),
d AS (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT doc_id, m, g FROM (SELECT doc_id, m, unnest({_S}) AS g FROM d JOIN (SELECT DISTINCT m FROM s) ON len(w) >= m) WHERE (m, g) IN (SELECT (m, g) FROM q))
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS shared, CAST(n AS INTEGER) AS item_shingles, round(count(*) / n, 6) AS containment
FROM q JOIN p USING (m, g) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9"""
