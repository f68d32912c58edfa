"""Phrase collocation mining with depth-limited count tries.

Each task counts the paths of up to `depth` words that start at its word occurrences, in runs of about RUN words: a trie by language, of which the sorted paths
with their counts are all that is kept. A run is cut at range borders and goes out as one block for each prefix range: in a block a path names only the words after
those it shares with the one before it. A range merges the blocks of all runs (sorted each) into one trie. Its nodes' counts are sums over the paths below them, and
a walk down gives the counts of a phrase's left parts. Nodes above a border have paths in several ranges; each run sends their whole counts along with its
blocks, so a prefix of any size may be cut anywhere. Right parts are suffix links: a phrase of d words meets the one of d - 1 words that it ends with, which has met its own.

Borders are quantiles of a bounded sample of paths (SAMPLE, one for each STRIDE bytes of text, the first by a hash). They only balance the ranges: every occurrence is counted.

Defined results: a null text is empty, a null language is `und`; rows that repeat count as often as they come; fewer than `least` occurrences make no
candidate; ties in a language are broken by phrase; an empty table gives no row; other columns are ignored. Texts are handled as bytes.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import read, slices, small_batches, stored
from .components import met

DEPTH = 4
#: Words of a run, and bytes of text for each range.
RUN, RANGE_BYTES = 1 << 20, 6 << 20
#: Paths that borders are made of, and bytes of text for each of them.
SAMPLE, STRIDE = 1 << 16, 2048
_END = b"\xff"  # no UTF-8 text holds it
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _END * 10 + b" ")

Path = tuple[bytes, ...]


def words_of(text: bytes | None) -> list[bytes]:
    """Words in order, with an end mark after each piece."""
    return [*text.translate(_PLAIN).replace(_END, b" \xff ").split(), _END] if text else []


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))


def borders(docs: DataFrame, ranges: int, size: int, texts: int, depth: int = DEPTH) -> list[Path]:
    """Up to ranges - 1 paths (lang and `depth` words, the missing ones empty), rising. docs: as _texts() gives them; size and texts: their bytes and number, by which as many of the
    possible draws (one for each STRIDE bytes of a text) are passed over as leaves about 2 SAMPLE of them, so what comes to the driver does not grow with the input."""
    share = min(1.0, 2 * SAMPLE / (size // STRIDE + texts + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for at in range(0, len(text or b""), STRIDE):
                    h = xxhash.xxh64_intdigest(text[at : at + STRIDE], at)
                    if h >= share * 2.0**64:
                        continue
                    got = words_of(text[(k := at + h % STRIDE) : k + 64 * depth])[1:]
                    if got and got[0] != _END:
                        got = got[: min(depth, got.index(_END))]
                        rows.append((h - (1 << 63), lang, b" ".join(got)))
            cols = [[r[k] for r in rows] for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["h", "lang", "path"])

    drawn = docs.mapInArrow(run, "h bigint, lang binary, path binary").orderBy("h", "lang", "path").limit(SAMPLE).collect()
    paths = sorted((bytes(r["lang"]), *(w := bytes(r["path"]).split(b" ")), *[b""] * (depth - len(w))) for r in drawn)
    return sorted({paths[len(paths) * k // ranges] for k in range(1, ranges)}) if paths else []


class Trie:
    """The sorted paths of a run (or of a range) with their counts. columns: places of the language and of each word in their sorted lists, from 1 for words; 0 is the end."""

    def __init__(self, langs: list[bytes], words: list[bytes], columns: list[np.ndarray], counts: np.ndarray | None) -> None:
        """One or more paths in any order, repeats included; a stable sort takes sorted pieces as they are."""
        self.langs, self.words = langs, words
        v, depth = len(words) + 1, len(columns) - 1
        key, at, n = columns[0].astype(np.uint64), 1, len(langs)
        while at <= depth:  # two words a step if 64 bits hold them, numbered densely in between
            two = at < depth and n * v * v < 1 << 64
            tail = columns[at].astype(np.uint64)
            wide = key * np.uint64(v * v) + tail * np.uint64(v) + columns[at + 1].astype(np.uint64) if two else key * np.uint64(v) + tail
            order = np.argsort(wide, kind="stable")
            wide = wide[order]
            new = np.concatenate([[True], wide[1:] != wide[:-1]])
            key = np.empty(len(wide), dtype=np.uint64)
            key[order] = np.cumsum(new, dtype=np.uint64) - np.uint64(1)
            n, at = int(np.count_nonzero(new)), at + 1 + two
        first = np.flatnonzero(new)
        self.columns = [c[order[first]] for c in columns]
        self.counts = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
        self.below = np.concatenate([[0], np.cumsum(self.counts)])

    def path(self, i: int, depth: int | None = None) -> Path:
        return (self.langs[self.columns[0][i]], *(self.words[k - 1] if (k := c[i]) else b"" for c in self.columns[1 : None if depth is None else depth + 1]))

    def find(self, border: Path) -> int:
        """The number of paths below a border."""
        return bisect_left(range(len(self.counts)), border, key=self.path)

    def under(self, prefix: Path) -> int:
        """The count of a node."""
        every, depth = range(len(self.counts)), len(prefix) - 1
        a, z = (f(every, prefix, key=lambda i: self.path(i, depth)) for f in (bisect_left, bisect_right))
        return int(self.below[z] - self.below[a])

    def block(self, a: int, z: int) -> dict:
        """Paths a to z: words used, how many columns each path shares with the one before, the columns that follow, counts."""
        cols = np.column_stack([c[a:z] for c in self.columns]).astype(np.int64)
        used, local = np.unique(cols[:, 1:], return_inverse=True)
        local = np.column_stack([cols[:, 0], local.reshape(len(cols), cols.shape[1] - 1)])
        same = np.zeros(len(cols), dtype=np.uint8)
        if len(cols) > 1:
            same[1:] = np.cumprod(cols[1:] == cols[:-1], axis=1).sum(axis=1)
        kind = "<u2" if len(used) < 1 << 16 and len(self.langs) < 1 << 16 else "<u4"
        ids = local[np.arange(cols.shape[1]) >= same[:, None]].astype(kind)
        counts = self.counts[a:z]
        many = "<u1" if counts.max(initial=0) < 1 << 8 else "<u8"
        return {"langs": self.langs, "words": b"\n".join(self.words[k - 1] if k else b"" for k in used.tolist()), "same": same.tobytes(), "ids": ids.tobytes(), "counts": counts.astype(many).tobytes(), "wide": kind == "<u4", "large": many == "<u8"}


def _unpacked(b: dict, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A block's columns and counts again."""
    same = np.frombuffer(b["same"], dtype=np.uint8)
    ids = np.frombuffer(b["ids"], dtype="<u4" if b["wide"] else "<u2").astype(np.int64)
    width = depth + 1
    start = np.cumsum(width - same.astype(np.int64)) - (width - same)
    rows, cols = np.arange(len(same)), []
    for c in range(width):
        last = np.maximum.accumulate(np.where(same <= c, rows, 0))  # the path that names this column last
        cols.append(ids[start[last] + c - same[last]])
    return cols, np.frombuffer(b["counts"], dtype="<u8" if b["large"] else "<u1").astype(np.int64)


BLOCK = "range int, langs array<binary>, words binary, same binary, ids binary, counts binary, wide boolean, large boolean, cut array<bigint>"
_BLOCK_KINDS = {"range": pa.int32(), "langs": pa.list_(pa.binary()), **dict.fromkeys(("words", "same", "ids", "counts"), pa.binary()), "wide": pa.bool_(), "large": pa.bool_(), "cut": pa.list_(pa.int64())}


def _prefixes(border: Path | None, depth: int) -> list[Path]:
    return [border[: k + 1] for k in range(depth)] if border else []


def blocks(docs: DataFrame, at: list[Path], depth: int = DEPTH) -> DataFrame:
    """A row for each run and range: its part of the run's trie, and the run's counts of the nodes above the range's two borders."""
    small_batches(docs.sparkSession)

    def cut_up(trie: Trie) -> Iterator[dict]:
        edges = [0, *(trie.find(b) for b in at), len(trie.counts)]
        counts = [[trie.under(p) if all(p[1:]) else 0 for p in _prefixes(b, depth)] for b in at]
        none = [0] * depth
        for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
            cut = (counts[k - 1] if k else none) + (counts[k] if k < len(at) else none)
            if z > a or any(cut):
                yield {"range": k, "cut": cut, **trie.block(a, z)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {_END: 0}
        held: list[tuple[bytes, np.ndarray]] = []
        size = 0

        def number(word: bytes) -> int:
            return known.setdefault(word, len(known))  # known and held are bound anew for each run

        def out() -> Iterator[pa.RecordBatch]:
            words = sorted(w for w in known if w != _END)
            rank = np.zeros(len(known), dtype=np.int32)
            rank[[known[w] for w in words]] = np.arange(1, len(words) + 1)
            langs = sorted({x for x, _ in held})
            place = {x: k for k, x in enumerate(langs)}
            tokens = np.concatenate([rank[ids] for _, ids in held] + [np.zeros(depth, dtype=np.int32)])
            lengths = np.array([len(ids) for _, ids in held])
            inside = np.arange(lengths.sum(), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
            starts = np.flatnonzero((tokens[: len(inside)] > 0) & (inside < RUN))
            del inside
            cols = [np.repeat(np.array([place[x] for x, _ in held], dtype=np.int32), lengths)[starts], tokens[starts]]
            for k in range(1, depth):
                cols.append(np.where(cols[-1] > 0, tokens[starts + k], np.int32(0)))
            rows = cut_up(Trie(langs, words, cols, None)) if len(starts) else iter(())
            while some := list(itertools.islice(rows, 32)):
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], t) for n, t in _BLOCK_KINDS.items()], names=list(_BLOCK_KINDS))

        for b in slices(batches):
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                for a in range(0, len(words), RUN):  # a longer text goes in parts, each with the words after it and an end
                    part = [*words[a : a + RUN + depth - 1], _END]
                    held.append((lang, np.fromiter(map(number, part), dtype=np.int32, count=len(part))))
                    size += len(part)
                    if size >= RUN:
                        yield from out()
                        known, held, size = {_END: 0}, [], 0
        if held:
            yield from out()

    return docs.mapInArrow(run, BLOCK)


NODE = "lang binary, phrase binary, words int, f bigint, lefts array<bigint>, head binary, rest binary"


def _nodes(trie: Trie, lower: list[Path], upper: list[Path], cut: np.ndarray, least: int) -> list[tuple]:
    """Nodes of a range's trie with `least` occurrences or more, and its languages (no word): lang, phrase, words, f, counts of its left parts, phrase without its last and its first word."""
    depth, n = len(trie.columns) - 1, len(trie.counts)
    whole = dict(zip([*lower, *upper], cut.tolist(), strict=True))
    change, counts, skip = np.zeros(n, dtype=bool), [], []
    change[0] = True
    node, firsts = [], []
    for d, c in enumerate(trie.columns):
        change[1:] |= c[1:] != c[:-1]
        firsts.append(np.flatnonzero(change))
        node.append(np.cumsum(change) - 1)
        counts.append(np.add.reduceat(trie.counts, firsts[d]))
        skip.append(np.zeros(len(firsts[d]), dtype=bool))
    rows, parts = [], lambda p: (p[0], b" ".join(p[1:]), len(p) - 1)  # noqa: E731
    for p, total in whole.items():
        d = len(p) - 1
        i = bisect_left(range(n), p, key=lambda i: trie.path(i, d))
        if i < n and trie.path(i, d) == p:
            counts[d][node[d][i]] = total
            skip[d][node[d][i]] = p in lower  # it stands before the border
        elif p not in lower and all(p[1:]) and (d == 0 or total >= least):
            rows.append((*parts(p), total, [whole[p[: k + 1]] for k in range(1, d)], b" ".join(p[1:-1]), b" ".join(p[2:])))
    for d in range(depth + 1):
        at = firsts[d]
        for i in at[~skip[d] & ((counts[d] >= least) & (trie.columns[d][at] > 0) if d else True)].tolist():
            p = trie.path(i, d)
            rows.append((*parts(p), int(counts[d][node[d][i]]), [int(counts[k][node[k][i]]) for k in range(1, d)], b" ".join(p[1:-1]), b" ".join(p[2:])))
    return rows


def merged(parts: DataFrame, at: list[Path], least: int, depth: int = DEPTH) -> DataFrame:
    """The nodes of all ranges, each once and with its whole count. parts: blocks()."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        k = key[0].as_py()
        lists = [r["words"].split(b"\n") for r in rows]
        words = sorted(set().union(*lists) - {b""})
        langs = sorted(set().union(*(r["langs"] for r in rows)))
        number, place = {b"": 0} | {w: i for i, w in enumerate(words, 1)}, {x: i for i, x in enumerate(langs)}
        columns, counts = [[] for _ in range(depth + 1)], []
        for r, own in zip(rows, lists, strict=True):
            if r["same"]:
                cols, n = _unpacked(r, depth)
                counts.append(n)
                names = np.array([number[w] for w in own], dtype=np.int32)
                for c, (into, col) in enumerate(zip(columns, cols, strict=True)):
                    into.append(names[col] if c else np.array([place[x] for x in r["langs"]], dtype=np.int32)[col])
        lower, upper = (_prefixes(at[j] if 0 <= j < len(at) else None, depth) for j in (k - 1, k))
        cut = np.array([r["cut"] for r in rows]).sum(axis=0)
        cut = np.concatenate([cut[:depth] if lower else cut[:0], cut[depth:] if upper else cut[:0]])
        made = []
        if counts:
            made = _nodes(Trie(langs, words, [np.concatenate(c) for c in columns], np.concatenate(counts)), lower, upper, cut, least)
        elif upper:
            whole = dict(zip(upper, cut[len(lower) :].tolist(), strict=True))
            made = [(p[0], b" ".join(p[1:]), len(p) - 1, n, [whole[p[: j + 1]] for j in range(1, len(p) - 1)], b" ".join(p[1:-1]), b" ".join(p[2:])) for p, n in whole.items() if p not in lower and all(p[1:]) and (n >= least or len(p) == 1)]
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        for a in range(0, len(made), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[a : a + 8192], strict=True), kinds, strict=True)], names=[x.split()[0] for x in NODE.split(", ")])

    return parts.groupBy("range").applyInArrow(run, NODE)


def linked(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Phrases of two words or more with rights: the counts of what is left without the first word, without the first two, and so on."""
    before = nodes.where("words = 1").select("lang", "phrase", "f", F.array().cast("array<bigint>").alias("rights"))
    out = None
    for d in range(2, depth + 1):
        own = nodes.where(F.col("words") == d)
        counted = own.groupBy("lang", "rest").agg(F.count("*").alias("n"))
        ends = before.select("lang", F.col("phrase").alias("rest"), F.concat(F.array("f"), "rights").alias("rights")).join(counted, ["lang", "rest"])
        made, _ = stored(met(own, ends, ["lang", "rest"], own.count()), "linked")
        before = made.select("lang", "phrase", "f", "rights")
        out = made if out is None else out.unionByName(made)
    return out


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scored(phrases: DataFrame, covered: int = 80) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that no longer one has `covered` per cent of. score: the lowest of floor(2,000,000 a / (l + r)) over all cuts, of equals the first.

    A longer phrase that holds a phrase and is frequent enough has one of a word more in between, which is too: only those are asked."""
    parts = F.zip_with("lefts", "rights", lambda x, y: F.struct(x.alias("l"), y.alias("r")))
    rows = phrases.select("lang", "phrase", F.col("f").alias("a"), F.posexplode(parts).alias("k", "p")).select("lang", "phrase", "a", "k", "p.l", "p.r")
    value = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    best = rows.withColumn("score", value).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b"))
    longer = phrases.where("words > 2").select("lang", F.explode(F.array("head", "rest")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(_exact("most") * 100 < _exact("a") * covered, F.lit(True)))
    return kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = 30, most: int = 2_000, covered: int = 80, depth: int = DEPTH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of 2 to `depth` words. docs: lang, text."""
    spark, rows = docs.sparkSession, _texts(docs)
    size, texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("text")).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    at = borders(rows, ranges, size, texts, depth)
    nodes, _ = stored(merged(blocks(rows, at, depth), at, least, depth), "phrases")
    found = scored(linked(nodes, depth), covered)
    # a part of each language first, so that no task orders all phrases of one
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = found.withColumn("__k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("__k") <= most).drop("__k")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    langs = F.broadcast(nodes.where("words = 0").select("lang", F.col("f").alias("n")))
    return ranked.join(langs, "lang").select(F.col("lang").cast("string").alias("lang"), F.col("rank").cast("bigint").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?

]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS d) WHERE i + d - 1 <= len(w)),
f AS (SELECT lang, d, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE d = 1 GROUP BY lang),
c AS (SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE d > 1 AND f >= 30),
k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < d),
s AS (SELECT k.lang, k.d, k.phrase, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = x JOIN f r ON r.lang = k.lang AND r.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT DISTINCT c.lang, array_to_string(c.w[i:i + d - 1], ' ') AS phrase, c.a, d FROM (SELECT lang, w, a, d AS whole FROM c) c, (SELECT unnest([2, 3]) AS d), (SELECT unnest([1, 2, 3]) AS i) WHERE d < whole AND i + d - 1 <= whole),
t AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100::HUGEINT * o.a >= 80::HUGEINT * b.a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000"""
