"""Substring dedup: repeated word windows found by compressed FM-indexes of content shards.

A shard holds every window of `window` words that shares an anchor: the least hash among the window's runs of ANCHOR words. Equal windows have equal anchors,
so one shard knows all that a window can repeat, and each piece of a document is streamed through one index, not through all of them. Work:

1. `marks`: the anchors of each document. Anchors that occur once in all documents cannot lie in a repeated window; a count by anchor leaves the others.
2. `pieces`: the longest runs of windows with the same anchor occurrence, of documents that have repeated anchors. Equal pieces are combined in each task, the
   first by (doc_id, hash of the text, start) standing for all. An anchor with over HOT occurrences is split: each of its windows is a piece with a key of its own.
3. `searched`: pieces in order of their keys, cut at key borders into shards of about SHARD words. A shard is sorted to the depth of a window, its Burrows-Wheeler
   transform is kept as a wavelet matrix, and all windows are searched backwards together. A window's matching statistic is the number of its last words that
   occur elsewhere in the shard; those that reach `window` are repeated, and the positions in their interval tell the first.
4. `removed`: windows of pieces that are not the first of their kind are repeats as a whole; those of first pieces, where the search found an earlier start.

Defined results: a null text has no words; a text of fewer than `window` words keeps all of them; repeated rows (doc_id and text) are one document that is given
back as often as it came; of different texts with one doc_id the one with the smaller hash counts as earlier, and a null doc_id as the smallest; an empty table gives an
empty one; other columns are ignored. Texts are handled as bytes, so any bytes will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bloom import may_hold
from .common import read, slices, small_batches, stored
from .components import met

WINDOW = 20
#: Words of an anchor.
ANCHOR = 8
#: An anchor with more occurrences has a piece for each window.
HOT = 4_096
#: Words of a shard, and bytes of pieces that a task combines at once.
SHARD, COMBINED = 1 << 20, 32 << 20
_PLACE = 24
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Words(dict):
    """64-bit hashes of the words met so far; those of up to 64 bytes are kept, half a million at most."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64 and len(self) < 500_000:
            self[word] = h
        return h


def _grams(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words."""
    n = len(hashes) - size + 1
    out = np.full(n, seed, dtype=np.uint64)
    for k in range(size):
        out *= _MIX[0]
        out += hashes[k : k + n]
    out ^= out >> np.uint64(32)
    out *= _MIX[1]
    out ^= out >> np.uint64(29)
    return out


def runs(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of consecutive windows with one anchor occurrence: first window, number of windows, the anchor's hash. Where least hashes are equal the first counts."""
    n = len(hashes) - window + 1
    size = min(ANCHOR, window)
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.int64),)
    grams = _grams(hashes, size, 1)
    if len(grams) >> _PLACE:
        cut = (1 << _PLACE) - window  # texts of over 16 million words go in parts
        a, b = runs(hashes[: cut + window - 1], window), runs(hashes[cut:], window)
        return np.concatenate([a[0], b[0] + cut]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
    least = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    span, have = window - size + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.diff(np.append(first, n)), grams[at[first]].view(np.int64)


def _hashes(words: list[bytes], known: Words) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _key(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), text as bytes."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"))


def marks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tie, anchors: one for each run of windows. docs: as _key() gives them. Repeated rows make anchors look repeated, which costs work and changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in slices(batches):
            got = [runs(_hashes(t.split(), known), window)[2] if t else () for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "tie", "anchors"])

    return docs.mapInArrow(run, "doc_id bigint, tie bigint, anchors array<bigint>")


def repeated_anchors(marked: DataFrame) -> DataFrame:
    """doc_id, tie, anchors (array of struct anchor, hot): the anchors of each document that occur more than once in all documents. marked: marks(), stored."""
    every = marked.select("doc_id", "tie", F.explode("anchors").alias("anchor"))
    counted, _ = stored(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    rows = marked.select("doc_id", "tie", F.explode(F.array_distinct("anchors")).alias("anchor"))
    few, total = counted.count(), every.count()
    rows, _ = may_hold(rows, "anchor", counted.select(F.col("anchor").alias("key")), few)
    hit = met(rows, counted.withColumn("hot", F.col("n") > HOT), "anchor", total)
    return hit.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("anchor", "hot")).alias("anchors"))


def chosen(hashes: np.ndarray, anchors: list[dict], window: int) -> Iterator[tuple[int, int, int]]:
    """(first window, number of windows, key) of each piece of a document whose repeated anchors are given."""
    known = {a["anchor"]: a["hot"] for a in anchors}
    windows = None
    for a, n, anchor in zip(*(x.tolist() for x in runs(hashes, window)), strict=True):
        if (hot := known.get(anchor)) is None:
            continue
        if not hot:
            yield a, n, anchor
            continue
        if windows is None:
            windows = _grams(hashes, window, 2).view(np.int64)
        for k in range(a, a + n):
            yield k, 1, int(windows[k])


PIECE = "key bigint, words binary, doc_id bigint, tie bigint, start bigint"


def pieces(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, words, doc_id, tie, start: pieces of documents (doc_id, tie, text, anchors), the first of equal ones of a task, or of each COMBINED bytes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Words(), {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(k, w, d, t, s) for (k, w), (_, d, t, s) in held.items()]
            for at in range(0, len(rows), 8192):
                cols = zip(*rows[at : at + 8192], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), *[pa.int64()] * 3), strict=True)], names=["key", "words", "doc_id", "tie", "start"])

        for b in slices(batches):
            for doc_id, tie, text, anchors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = text.split()
                for a, n, key in chosen(_hashes(words, known), anchors, window):
                    piece, place = (key, b" ".join(words[a : a + n + window - 1])), (doc_id is not None, doc_id, tie, a)
                    if (before := held.get(piece)) is None:
                        held[piece] = place
                        size += len(piece[1]) + 300
                    elif _before(place, before):
                        held[piece] = place
                if size > COMBINED:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    return docs.select("doc_id", "tie", "text", "anchors").mapInArrow(run, PIECE)


def _before(a: tuple, b: tuple) -> bool:
    """Order of (doc_id is given, doc_id, ...): a null doc_id is the smallest."""
    return a[0] < b[0] if a[0] != b[0] else a[2:] < b[2:] if not a[0] else a[1:] < b[1:]


class Wavelet:
    """A wavelet matrix: one bit vector a level, packed, with counts before every 64 bits. place(c, i) is where the i-th position goes when all symbols are sorted by it."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            one = (symbols >> b & 1).astype(bool)
            packed = np.zeros((n >> 6) + 1, dtype=np.uint64)
            raw = np.packbits(one, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32)
            self.levels.append((packed, before, n - int(np.count_nonzero(one))))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (packed, before, zeros) in enumerate(self.levels):
            at = i >> 6
            ones = before[at] + np.bitwise_count(packed[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(c >> (self.bits - 1 - k) & 1, zeros + ones, i - ones)
        return i


class FMIndex:
    """Index of a sequence of symbols, its rotations sorted by their first `depth` symbols: right for patterns of up to so many. symbols: 0 parts the pieces and is in no pattern."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        n = len(symbols)
        rank, span = symbols.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while span < depth:
            key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -span)
            order = np.argsort(key)
            key = key[order]
            dense = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = dense
            span *= 2
            if dense[-1] == n - 1:
                break
        self.suffixes = order.astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.wavelet = Wavelet(symbols[order - 1].astype(np.int32))
        every = np.arange(len(self.first) - 1, dtype=np.int32)
        self.base = self.wavelet.place(every, np.zeros(len(every), dtype=np.int64))

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of what stands in [lo, hi) with c before it."""
        shift = self.first[c] - self.base[c]
        return self.wavelet.place(c, lo) + shift, self.wavelet.place(c, hi) + shift

    def matching(self, symbols: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pattern that ends (inclusive) at `ends`: how many of its last symbols, `window` at most, occur at another place too, and its interval if it is that long."""
        c = symbols[ends]
        lo, hi = self.first[c].astype(np.int64), self.first[c + 1].astype(np.int64)
        length = np.zeros(len(ends), dtype=np.int64)
        live = np.flatnonzero(hi - lo > 1)
        length[live] = 1
        for k in range(1, window):
            if not len(live):
                break
            a, z = self.step(symbols[ends[live] - k], lo[live], hi[live])
            more = z - a > 1
            live = live[more]
            lo[live], hi[live] = a[more], z[more]
            length[live] = k + 1
        return length, lo, hi


def repeats(texts: list[bytes], order: np.ndarray, starts: np.ndarray, window: int) -> list[int]:
    """For each piece the bits of its windows that start earlier in another: order and starts say where the pieces stand among all documents."""
    ids: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    lengths = np.array([len(w) for w in split])
    symbols = np.zeros(int(lengths.sum()) + len(split), dtype=np.int32)
    begin = np.cumsum(lengths + 1) - lengths - 1
    for at, words in zip(begin.tolist(), split, strict=True):
        symbols[at : at + len(words)] = [ids.setdefault(w, len(ids) + 1) for w in words]
    index = FMIndex(symbols, window)
    count = lengths - window + 1
    owner = np.repeat(np.arange(len(split)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length, lo, hi = index.matching(symbols, begin[owner] + inside + window - 1, window)
    hit = np.flatnonzero(length == window)
    # where each place of the shard stands among all documents, as one number
    place = np.repeat(order, lengths + 1) << 32 | (np.repeat(starts, lengths + 1) + np.arange(len(symbols)) - np.repeat(begin, lengths + 1))
    out = [0] * len(split)
    if len(hit):
        at, back = np.unique(lo[hit], return_inverse=True)
        ends = np.zeros(len(at), dtype=np.int64)
        ends[back] = hi[hit]
        least = np.minimum.reduceat(np.append(place[index.suffixes], np.iinfo(np.int64).max), np.ravel(np.column_stack([at, ends])))[::2]
        own = (order[owner[hit]] << 32) + starts[owner[hit]] + inside[hit]
        for p, j in zip(owner[hit[least[back] < own]].tolist(), inside[hit[least[back] < own]].tolist(), strict=True):
            out[p] |= 1 << j
    return out


FIRST = "doc_id bigint, tie bigint, start bigint, earlier bigint"


def searched(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tie, start, earlier: the first of each kind of pieces, with a bit for each of its windows that starts earlier in a piece of another kind."""
    dealt = rows.repartition("key").sortWithinPartitions("key", "words", F.col("doc_id").asc_nulls_first(), "tie", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[list[tuple]] = []
        size, last, group = 0, None, []

        def out() -> pa.RecordBatch:
            alone = [g[0] for g in shard if len(g) == 1]  # nothing else has their anchor
            rows = [r for g in shard if len(g) > 1 for r in g]
            bits: list[int] = []
            if rows:
                known = sorted({(r[2] is not None, r[2] or 0, r[3]) for r in rows})
                number = {d: k for k, d in enumerate(known)}
                order = np.array([number[r[2] is not None, r[2] or 0, r[3]] for r in rows], dtype=np.int64)
                bits = repeats([r[1] for r in rows], order, np.array([r[4] for r in rows], dtype=np.int64), window)
            both = [*alone, *rows]
            cols = [[r[2] for r in both], [r[3] for r in both], [r[4] for r in both], [0] * len(alone) + bits]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "tie", "start", "earlier"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and r[:2] == last[:2]:
                    continue
                if last is not None and r[0] != last[0]:
                    shard.append(group)
                    group = []
                    if size > SHARD:
                        yield out()
                        shard, size = [], 0
                group.append(r)
                size += r[1].count(b" ") + 2
                last = r
        if group:
            shard.append(group)
        if shard:
            yield out()

    return dealt.select("key", "words", "doc_id", "tie", "start").mapInArrow(run, FIRST)


def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], covered, [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


OUT = "doc_id bigint, n_words bigint, removed array<struct<start:bigint,stop:bigint>>, kept binary"


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, removed (spans of words, stop exclusive) and kept (the other words, a blank between two; bytes) of documents (doc_id, text, anchors, first)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in slices(batches):
            rows = []
            for text, anchors, first in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                words, spans = (text or b"").split(), []
                n = len(words)
                if anchors:
                    change, seen = np.zeros(n + 1, dtype=np.int64), {f["start"]: f["earlier"] for f in first or ()}
                    for a, count, _ in chosen(_hashes(words, known), anchors, window):
                        earlier = seen.get(a, -1)
                        for k in range(count):
                            if earlier >> k & 1:
                                change[a + k] += 1
                                change[a + k + window] -= 1
                    spans = list(zip(*(x.tolist() for x in _spans((np.cumsum(change[:-1]) > 0).astype(np.int8))), strict=True))
                    for a, z in reversed(spans):
                        del words[a:z]
                rows.append((n, [{"start": a, "stop": z} for a, z in spans], b" ".join(words)))
            n, spans, kept = zip(*rows, strict=True)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "removed", "kept"])

    return docs.select("doc_id", "text", "anchors", "first").mapInArrow(run, OUT)


def _joined(docs: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """docs (doc_id, tie, ...) with the columns that more has for the same document; null ids are equal."""
    renamed = more.withColumnsRenamed({"doc_id": "__d", "tie": "__t"})
    return docs.join(renamed, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("tie") == F.col("__t")), how).drop("__d", "__t")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, removed, kept of every document (doc_id, text); see removed()."""
    small_batches(docs.sparkSession)
    rows = _key(docs)
    marked, _ = stored(marks(rows, window).where(F.size("anchors") > 0), "marks")
    hits, _ = stored(repeated_anchors(marked), "hits")
    keys = hits.select(F.xxhash64("doc_id", "tie").alias("key"))
    some, others = may_hold(rows.withColumn("__key", F.xxhash64("doc_id", "tie")), "__key", keys, hits.count())
    cut = pieces(_joined(some, hits, "inner"), window)
    first = searched(cut, window).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "earlier")).alias("first"))
    whole = _joined(some, _joined(hits, first, "left"), "left").select("doc_id", "text", "anchors", "first")
    none = others.select("doc_id", "text", *[F.lit(None).cast(whole.schema[c].dataType).alias(c) for c in ("anchors", "first")])
    return removed(whole, window).unionByName(removed(none, window))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    return made.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM
  (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d))),
x AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT x.doc_id, x.i, x.word, coalesce(bool_or(again) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
