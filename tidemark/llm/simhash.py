"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: one or more words of 64 bits; a bit is 1 if more than half of the hashes of a text's word shingles have it. Texts link by their
fingerprints (op9_simhash: one word, XXH64 of seed 42, RADIUS or fewer differing bits), or, for the corpus pipeline, by exact similarity of
their sets of shingles, for which long fingerprints find the candidates. A class is what links reach.

Search (after Qin et al., "GPH", 2018): copies collapse to one row per distinct fingerprint. The bits of a word are grouped so that bits that
are correlated over the corpus share a partition. If the thresholds t_1..t_m of all m partitions sum to radius - m + 1, every pair
within the radius differs by at most t_i bits in some partition i (t_i = -1 skips it). Each fingerprint gets its own thresholds by dynamic
programming on estimated candidate counts, so that it skips partitions in which its value is frequent. It probes all values within
t_i of its own, and hits are verified on all bits. m is chosen by the same estimate, so that candidates stay few as the corpus grows.

The estimate needs how often each value of up to 16 bits occurs: a bounded number of tables of counts, whatever the size of the corpus. Cost is PROBE_COST for each probe and 1 for each candidate.

Hot values (over HOT fingerprints or probes; for long fingerprints over WIDE_HOT or WIDE_PROBES): members and probes are dealt to tiles of about TILE by TILE; each tile is
verified in blocks and gives back what its links connect, each id with the least one, so a large group of near copies makes few rows and no task
holds it. Nothing is dropped: every probe meets every member in just one tile.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .bloom import may_hold
from .common import append_column, fresh, read, split_words, stored
from .components import components, met

RADIUS = 3
SHINGLE = 3
SEED = 42
HOT = 64
#: For long fingerprints, members and probes of a value: every member of a group of near copies shares values with the others in many partitions, while probes also grow with
#: what is not alike. A value that is not hot makes at most WIDE_HOT candidates a probe.
WIDE_HOT, WIDE_PROBES = 16, 256
TILE = 1024
#: A probe is made, shuffled and sorted; a candidate is only compared.
PROBE_COST = 8


@dataclass(frozen=True)
class Search:
    """How fingerprints are searched: words of 64 bits, the radius within which every pair is probed, the differing bits of one word and of all words up to which
    a probed pair is a link (the one is the word after that of the partition, as the partition's own bits agree anyhow), the largest threshold of a partition, and the bits of a table of counts."""

    words: int
    radius: int
    one: int
    most: int
    threshold: int
    piece: int


#: op9_simhash: every pair within 3 of 64 bits, and no other.
FINGERPRINT = Search(words=1, radius=RADIUS, one=RADIUS, most=RADIUS, threshold=RADIUS, piece=16)
#: Candidates for a similarity of 0.8: bits then differ with a probability of 0.15 (an angle of 27 degrees), 77 of 512 with a deviation of 8. Unrelated texts differ in 256,
#: with a deviation of 11. Every pair within 35 bits is probed, and others as far as they agree in a partition: a pair at 0.8 does with a probability of 0.97, one at 0.85 of 0.99.
WIDE = Search(words=8, radius=35, one=20, most=104, threshold=1, piece=8)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of the text's n-word shingles, repeats included; of the whole sequence if it has fewer words."""
    words = split_words(text)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_digest
    # the digest is big-endian
    h = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)])
    return np.frombuffer(h, dtype=">u8").astype(np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        total += bits_of(h[at : at + (1 << 16)]).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's n-word shingles, repeats included; of the whole sequence if it has fewer words; 0 without words."""
    return majority(shingle_hashes(text, n))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, keep: list[str], name: str = "fp") -> DataFrame:
    """`keep` columns of docs and the fingerprint as a signed long."""
    return append_column(docs, keep, lambda: lambda text: signed(fingerprint(text)), name, T.LongType())


def bits_of(fp: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1, column b for bit b."""
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def words_of(column: pa.Array, words: int) -> np.ndarray:
    """(n, words) of unsigned words from an Arrow array of arrays of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)


def co_counts(distinct: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """n, and for each word the 64 x 64 counts of fingerprints that have both bits; every task sends one matrix of its rows for each word."""
    i, j = np.triu_indices(64)

    def run(batches):
        n, total = 0, np.zeros((words, 64, 64), dtype=np.int64)
        for b in batches:
            fp = words_of(b.column(0), words)
            n += len(fp)
            for w in range(words):
                x = bits_of(np.ascontiguousarray(fp[:, w])).astype(np.float32)
                total[w] += (x.T @ x).astype(np.int64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(words)[:, None] * 4096 + i * 64 + j, -1)), pa.array(np.append(total[:, i, j], n))], names=["k", "c"])

    got = distinct.select("fp").mapInArrow(run, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    k, c = got["k"].to_numpy(), got["c"].to_numpy()
    total = np.zeros(words * 4096)
    total[k[k >= 0]] = c[k >= 0]
    total = total.reshape(words, 64, 64)
    total = np.maximum(total, total.transpose(0, 2, 1))
    return int(c[k < 0].sum()), total


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits of a word in m partitions of equal size: greedily, each takes the free bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, parts = np.ones(64, dtype=bool), []
    for size in [64 // m + (k < 64 % m) for k in range(m)]:
        # the least balanced free bit starts a partition: frequent values then share it
        part = [int(np.argmax(np.where(free, np.abs(p - 0.5), -1.0)))]
        free[part] = False
        while len(part) < size:
            part.append(int(np.argmax(np.where(free, corr[:, part].sum(axis=1), -1.0))))
            free[part] = False
        parts.append(sorted(part))
    return parts


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each word as one number, the first the lowest."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def value_counts(distinct: DataFrame, words: int, pieces: list[tuple[int, list[int]]]) -> list[np.ndarray]:
    """For each piece (word, up to 16 bits), how many fingerprints have each value."""

    def run(batches):
        total = [np.zeros(1 << len(bits), dtype=np.int64) for _, bits in pieces]
        for b in batches:
            fp = words_of(b.column(0), words)
            for t, (w, bits) in zip(total, pieces, strict=True):
                t += np.bincount(values(fp[:, w], bits).astype(np.int64), minlength=len(t))
        v = [np.flatnonzero(t) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k * 65536 + x for k, x in enumerate(v)])), pa.array(np.concatenate([t[x] for t, x in zip(total, v, strict=True)]))], names=["k", "c"])

    out = [np.zeros(1 << len(bits)) for _, bits in pieces]
    got = distinct.select("fp").mapInArrow(run, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    k, c = got["k"].to_numpy(), got["c"].to_numpy()
    for i, t in enumerate(out):
        own = k // 65536 == i
        t[k[own] % 65536] = c[own]
    return out


def profile(counts: np.ndarray, radius: int) -> np.ndarray:
    """(values, radius + 1): the share of fingerprints at exactly each distance from the value."""
    width = int(np.log2(len(counts)))
    share = counts / max(counts.sum(), 1)
    poly = np.zeros((radius + 1, len(counts)))
    poly[0] = share
    at = np.arange(len(counts))
    for b in range(width):  # by one bit at a time: either it agrees or the distance grows by one
        turned = poly[:, at ^ (1 << b)]
        poly[1:] += turned[:-1]
    return poly.T.astype(np.float32)


class Plan:
    """Partitions (word, bits), and each fingerprint's thresholds from the estimated candidate counts."""

    def __init__(self, search: Search, n: int, parts: list[tuple[int, list[int]]], pieces: list[list[list[int]]], profiles: list[list[np.ndarray]]) -> None:
        self.search, self.n, self.parts, self.pieces, self.profiles = search, n, parts, pieces, profiles
        width = max(len(bits) for _, bits in parts)
        self.masks = {r: [sum(1 << b for b in c) for c in itertools.combinations(range(width), r)] for r in range(search.threshold + 1)}

    def estimates(self, fp: np.ndarray) -> np.ndarray:
        """(parts, threshold + 2, fingerprints): cost of the thresholds -1 and up: probes plus candidates expected."""
        most = self.search.threshold
        out = np.zeros((len(self.parts), most + 2, len(fp)))
        for i, ((w, part), pieces, profiles) in enumerate(zip(self.parts, self.pieces, self.profiles, strict=True)):
            near = None
            for bits, table in zip(pieces, profiles, strict=True):
                own = table[values(fp[:, w], bits).astype(np.int64)].T.astype(np.float64)
                near = own if near is None else np.stack([sum(near[a] * own[d - a] for a in range(d + 1)) for d in range(most + 1)])
            probes = 0
            for t in range(most + 1):
                probes += len(list(itertools.combinations(part, t)))
                out[i, t + 1] = self.n * near[: t + 1].sum(axis=0) + PROBE_COST * probes
        return out

    def thresholds(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, fingerprints) of thresholds that sum to radius - parts + 1, and the cost, by dynamic programming."""
        cost, m = self.estimates(fp), len(self.parts)
        total = self.search.radius + 1  # thresholds plus one each, summed
        best = np.full((total + 1, len(fp)), np.inf)
        best[0] = 0.0
        chosen = np.zeros((m, total + 1, len(fp)), dtype=np.int8)
        for i in range(m):
            new = np.full_like(best, np.inf)
            for s in range(total + 1):
                for k in range(min(s, self.search.threshold + 1) + 1):
                    c = best[s - k] + cost[i, k]
                    better = c < new[s]
                    new[s] = np.where(better, c, new[s])
                    chosen[i, s] = np.where(better, k, chosen[i, s])
            best = new
        out, s = np.zeros((m, len(fp)), dtype=np.int8), np.full(len(fp), total)
        at = np.arange(len(fp))
        for i in reversed(range(m)):
            out[i] = chosen[i, s, at] - 1
            s = s - chosen[i, s, at]
        return out, best[total]


def planned(distinct: DataFrame, search: Search) -> Plan:
    """The plan of the least estimated cost among 2, 3 and 4 partitions a word (as far as their thresholds can reach the radius), judged on at most 4,096 fingerprints."""
    n, both = co_counts(distinct, search.words)
    some = words_of(distinct.select("fp", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(4096).select("fp").toArrow()["fp"].combine_chunks(), search.words)
    # the thresholds of all partitions have to reach the radius
    parts = {m: [(w, bits) for w in range(search.words) for bits in grouped_bits(n, both[w], m)] for m in (2, 3, 4) if m * search.words * (search.threshold + 1) > search.radius}
    pieces = {m: [[p[k : k + search.piece] for k in range(0, len(p), search.piece)] for _, p in parts[m]] for m in parts}
    counts = iter(value_counts(distinct, search.words, [(w, x) for m in parts for (w, _), p in zip(parts[m], pieces[m], strict=True) for x in p]))
    plans = []
    for m in parts:
        plan = Plan(search, n, parts[m], pieces[m], [[profile(next(counts), search.threshold) for _ in p] for p in pieces[m]])
        cost = float(plan.thresholds(some)[1].sum()) if len(some) else 0.0
        plans.append((cost, -m, plan))
    return min(plans, key=lambda x: x[:2])[2]


def forest(q: np.ndarray, x: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that span what the pairs (one of q, one of x: rows of words) within radius connect; not all of those pairs."""
    apart = np.zeros((len(q), len(x)), dtype=np.int16)
    for w in range(q.shape[1]):
        apart += np.bitwise_count(q[:, None, w] ^ x[None, :, w])
    near = apart <= radius
    out, seen_q, seen_x = [], np.zeros(len(q), dtype=bool), np.zeros(len(x), dtype=bool)
    for i in np.flatnonzero(near.any(axis=1)):
        if seen_q[i]:
            continue
        seen_q[i], todo = True, [int(i)]
        while todo:
            a = todo.pop()
            new = np.flatnonzero(near[a] & ~seen_x)
            seen_x[new] = True
            out.extend((a, int(b)) for b in new)
            if len(new):
                rows = np.flatnonzero(near[:, new].any(axis=1) & ~seen_q)
                for r in rows:
                    out.append((int(r), int(new[np.argmax(near[r, new])])))
                seen_q[rows] = True
                todo.extend(rows.tolist())
    return out


def stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(id, least id) for what the links a - b connect: tiles that hold the same ids then give the same rows, and these collapse."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y]
            x = y
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([(x, top(x)) for x in parent if top(x) != x], dtype=np.int64).reshape(-1, 2)


def links(distinct: DataFrame, search: Search = FINGERPRINT) -> DataFrame:
    """(a, b): ids whose links reach what all probed pairs within search.most bits reach. distinct: id, fp (array of search.words longs), each fp once."""
    plan = planned(distinct, search)
    most_q, most_x = (HOT, HOT) if search.words == 1 else (min(4 * HOT, WIDE_PROBES), min(HOT, WIDE_HOT))
    names = ["part", "value", "id", "w"]

    def rows(i: int, value: np.ndarray, ids: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, dtype=np.int32)), pa.array(value.view(np.int64)), pa.array(ids), pa.array(w.view(np.int64))], names=names)

    def probes(batches):
        for b in batches:
            ids, fp = b.column(0).to_numpy(), words_of(b.column(1), search.words)
            if not len(ids):
                continue
            t, _ = plan.thresholds(fp)
            for i, (w, part) in enumerate(plan.parts):
                v = values(fp[:, w], part)
                for r in range(search.threshold + 1):
                    own = np.flatnonzero(t[i] >= r)
                    if len(own):
                        masks = np.array([m for m in plan.masks[r] if not m >> len(part)], dtype=np.uint64)
                        yield rows(i, (v[own][:, None] ^ masks).reshape(-1), np.repeat(ids[own], len(masks)), np.repeat(fp[own, (w + 1) % search.words], len(masks)))

    def members(batches):
        for b in batches:
            ids, fp = b.column(0).to_numpy(), words_of(b.column(1), search.words)
            for i, (w, part) in enumerate(plan.parts):
                yield rows(i, values(fp[:, w], part), ids, fp[:, (w + 1) % search.words].copy())

    schema, key = "part int, value bigint, id bigint, w bigint", ["part", "value"]
    q, _ = stored(distinct.select("id", "fp").mapInArrow(probes, schema), "probes")
    x = distinct.select("id", "fp").mapInArrow(members, schema)
    sizes = q.groupBy(key).agg(F.count("*").alias("nq"), F.min("id").alias("lq")).join(x.groupBy(key).agg(F.count("*").alias("nx"), F.min("id").alias("lx")), key)
    # a value with one member that is its only probe has no partner
    sizes, _ = stored(sizes.where("nq > 1 or nx > 1 or lq <> lx").withColumn("hot", F.expr(f"nq > {most_q} or nx > {most_x}")).drop("lq", "lx"), "sizes")
    cold = sizes.where("not hot").select(key)
    found = q.join(cold, key).select(*key, F.col("id").alias("a"), F.col("w").alias("wa")).join(x.select(*key, F.col("id").alias("b"), F.col("w").alias("wb")), key)
    found = found.where(F.expr(f"bit_count(wa ^ wb) <= {search.one} and a <> b")).select("a", "b")
    if search.words > 1:
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        side = lambda c: distinct.select(F.col("id").alias(c), F.col("fp").alias(f"f{c}"))
        apart = "aggregate(zip_with(fa, fb, (x, y) -> int(bit_count(x ^ y))), 0, (s, x) -> s + x)"
        found = found.join(side("a"), "a").join(side("b"), "b").where(F.expr(f"{apart} <= {search.most}")).select("a", "b")
    # a plan of its own: with the tiles it would hold a dozen joins more
    found, _ = stored(found, "found")
    hot, _ = stored(sizes.where("hot").select(*key, "nq", "nx", F.expr(f"int(ceil(nq / {TILE}))").alias("tq"), F.expr(f"int(ceil(nx / {TILE}))").alias("tx")), "hot")
    total = hot.agg(F.coalesce(F.sum("nq"), F.lit(0)), F.coalesce(F.sum("nx"), F.lit(0)), F.coalesce(F.max("nq"), F.lit(0)), F.coalesce(F.max("nx"), F.lit(0))).first()
    if not total[0]:
        return found

    def dealt(df: DataFrame, side: int) -> DataFrame:
        n, own, other = ("nq", "tq", "tx") if side == 0 else ("nx", "tx", "tq")
        placed = met(df.select(*key, "id"), hot.select(*key, own, other, F.col(n).alias("n")), key, total[side], total[2 + side])
        placed = placed.withColumn("own", F.expr(f"int(pmod(xxhash64(id, 7), {own}))")).withColumn("other", F.explode(F.expr(f"sequence(0, {other} - 1)")))
        iq, ix = ("own", "other") if side == 0 else ("other", "own")
        return placed.select(*key, F.col(iq).alias("iq"), F.col(ix).alias("ix"), "id", F.lit(side).alias("side"))

    def of_tile(table: pa.Table) -> pa.Table:
        ids, side, fp = table["id"].to_numpy(), table["side"].to_numpy(), words_of(table["fp"].combine_chunks(), search.words)
        qi, xi = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        got = np.array(forest(fp[qi], fp[xi], search.most) if len(qi) and len(xi) else [], dtype=np.int64).reshape(-1, 2)
        made = stars(ids[qi][got[:, 0]], ids[xi][got[:, 1]])
        return pa.table({"a": made[:, 0], "b": made[:, 1]})

    tiles = dealt(q, 0).unionByName(dealt(x, 1)).join(distinct.select("id", "fp"), "id")
    return found.unionByName(tiles.groupBy(*key, "iq", "ix").applyInArrow(of_tile, "a bigint, b bigint"))


def classes(prints: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(fp, n, component_id, row): for each distinct fp of prints (fp, doc_id, row), its rows, the smallest doc_id that links reach, and the row that stays of its class: the one with
    that id, the first of equals. found: links (a, b) of fps; by default those of fingerprints."""
    distinct, _ = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")), "distinct")
    roots = components(links(distinct.select(F.col("fp").alias("id"), F.array("fp").alias("fp"))) if found is None else found)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.col("n").alias("copies"), "least", F.coalesce("root", "fp").alias("root"))
    named, _ = stored(named, "named")
    best = named.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("n"))
    of = met(named, best, "root", named.count())
    return stored(of.select("fp", F.col("copies").alias("n"), F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("row")), "classes")[0]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and component_id (the smallest doc_id that links reach) for every row of docs.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows share a class; a class whose ids are all null has a null
    component_id. An empty table gives an empty table; other columns are ignored.
    """
    prints, _ = stored(with_fingerprint(docs, ["doc_id"]).withColumn("row", F.monotonically_increasing_id()), "prints")
    of = classes(prints).select("fp", "n", "component_id")
    return met(prints, of, "fp", prints.count()).select("doc_id", "fp", "component_id")


#: The corpus pipeline's stage: texts whose sets of SET_SHINGLE-word shingles have a Jaccard similarity of SIMILARITY or more link.
SET_SHINGLE, SIMILARITY = 5, 0.8
#: Rows and shingles of a tile of exact verification.
TILE_ROWS, TILE_SHINGLES = 2048, 1 << 20
#: Odd numbers that make a shingle's hash into one for each word of a long fingerprint.
FACTORS = np.random.default_rng(17).integers(0, 1 << 63, size=WIDE.words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def long_fingerprint(x: np.ndarray) -> list[int]:
    """The SimHash of a set of hashes in WIDE.words words, as signed longs."""
    out = []
    for factor in FACTORS:
        h = (x ^ (x >> np.uint64(31))) * factor
        out.append(signed(majority(h ^ (h >> np.uint64(29)))))
    return out


def set_print(text: str | None) -> list[int]:
    """A hash of the text's set of shingles, the size of the set, and its long fingerprint."""
    x = np.unique(shingle_hashes(text, SET_SHINGLE))
    return [signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)), len(x), *long_fingerprint(x)]


def similar_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span what the pairs of sets at SIMILARITY or more connect, each from the first that is reached; not all of those pairs."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    place = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    starts = np.cumsum(sizes) - sizes
    own, unseen, out = np.zeros(int(place.max()) + 1, dtype=np.int32), np.ones(len(sets), dtype=bool), []
    for first in range(len(sets)):
        if not unseen[first]:
            continue
        unseen[first], todo = False, [first]
        while todo and unseen.any():
            a = todo.pop()
            mine = place[starts[a] : starts[a] + sizes[a]]
            own[mine] = 1
            both = np.add.reduceat(own[place], starts)
            own[mine] = 0
            # in whole numbers: both / (a + b - both) >= 0.8
            new = np.flatnonzero(unseen & (100 * both >= round(100 * SIMILARITY) * (sizes[a] + sizes - both)))
            unseen[new] = False
            out.extend((first, int(b)) for b in new)
            todo.extend(new.tolist())
    return out


def similar_links(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): sets whose links reach what all found pairs at SIMILARITY or more reach. prints: fp (hash of the set), size, sketch (array of longs), row; texts: row, text.

    What long fingerprints link are groups: similar sets are in one, whatever else is. Within a group every two sets are compared on the sets themselves. A large group is dealt to tiles; every
    two tiles are one task, which gives back a spanning forest of its links, not all pairs."""
    sets, _ = stored(prints.where("size > 0").groupBy("fp").agg(F.min("size").alias("size"), F.min("sketch").alias("sketch"), F.min("row").alias("row")), "sets")
    # sets may share a fingerprint: it is searched once. Its id is its place, as rising numbers take less of a shuffle than hashes do
    heads, _ = stored(sets.groupBy("sketch").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "heads")
    roots = components(links(heads.select("id", F.col("sketch").alias("fp")), WIDE))
    grouped = heads.join(roots, heads["id"] == roots["node"], "left").select("sketch", "n", F.coalesce("root", "id").alias("root"))
    groups, _ = stored(met(sets, grouped, "sketch", sets.count()).select("fp", "size", "row", "root"), "groups")
    sized = groups.groupBy("root").agg(F.count("*").alias("n"), F.expr(f"int(greatest(ceil(count(*) / {TILE_ROWS}), ceil(sum(size) / {TILE_SHINGLES})))").alias("tiles")).where("n > 1")
    tiled, _ = stored(met(groups, sized, "root", sets.count()).withColumn("own", F.expr("int(pmod(xxhash64(fp, 7), tiles))")), "tiled")
    # only texts of groups move: the others miss the filter
    texts, _ = may_hold(texts, "row", tiled.select(F.col("row").alias("key")), tiled.count())
    # every two tiles meet, and a tile meets itself in each of them; a group of one tile meets itself
    full = tiled.join(texts, "row").withColumn("other", F.explode(F.expr("filter(sequence(0, tiles - 1), k -> k <> own or tiles = 1)")))
    placed = full.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "text")

    def of_tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("fp")
        fp = table["fp"].to_numpy()
        got = np.array(similar_forest([np.unique(shingle_hashes(t.as_py(), SET_SHINGLE)) for t in table["text"]]), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": fp[got[:, 0]], "b": fp[got[:, 1]]})

    return placed.groupBy("root", "i", "j").applyInArrow(of_tile, "a bigint, b bigint")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of texts that links of similarity reach: that of the smallest doc_id (the first of equals), with the columns of docs.

    A text of fewer than 5 words has one shingle, the whole sequence; texts without words (null ones too) are all alike. Null ids come last; repeated rows are one class; an empty table
    gives an empty table. Which row stays is found on narrow rows; of the texts only those move that
    a Bloom filter of the rows to be dropped, or to be compared, may hold."""
    row, made = fresh("__row", docs.columns), fresh("__print", docs.columns)
    rows, _ = stored(append_column(docs, docs.columns, lambda: set_print, made, T.ArrayType(T.LongType())).withColumn(row, F.monotonically_increasing_id()), "prints")
    at = F.col(made)
    prints = rows.select(at[0].alias("fp"), at[1].alias("size"), F.slice(at, 3, WIDE.words).alias("sketch"), F.col(row).alias("row"), "doc_id")
    found = similar_links(prints.select("fp", "size", "sketch", "row"), rows.select(F.col(row).alias("row"), "text"))
    won = classes(prints.select("fp", "doc_id", "row"), found).select("row").distinct()
    lost, _ = stored(prints.select("row").join(won, "row", "left_anti"), "lost")
    asked, stay = may_hold(rows, row, lost.select(F.col("row").alias("key")), lost.count())
    stay = stay.union(asked.join(lost.withColumnRenamed("row", row), row, "left_anti").select(*[f"`{c}`" for c in stay.columns]))
    return stay.select(*[f"`{c}`" for c in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
