"""Conversation structure repair: shortest edit paths by Dial's bucket queue.

Rows of a conversation are layers of a graph, and what may come next (start, after a system row, after a user's, after an assistant's) its four states. Keeping, rerolling and deleting
a row lead to the next layer, inserting stays in it; costs are small integers. A sweep from the end over a ring of buckets records every
node's distance to the end, and a walk from the start along tight arcs, the least letter first, is the audit.

Rows are dealt by range on (conv_id, turn, role, text), so a conversation of any length is a run of segments of at most SEGMENT rows in as many tasks as it needs. A segment of a
conversation that may go on elsewhere first gives its distances from each state to each state; these (16 numbers) are combined from the end of the conversation, every
segment is walked from each state it may be entered in, and the walks are chained. Others are finished where they are.

Defined results: rows are ordered by (turn, role, text), null turns first; null texts and roles are one space; rows with a null conv_id are one conversation; a row equal
to an earlier one in role and text is a duplicate, whatever its turn; a conversation without rows has no segments (the query adds those whose rows were all dropped); an empty
table gives an empty one; other columns are ignored. Roles and texts are handled as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, small_batches, stored

SEGMENT = 4_096
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user's or an assistant's row leads to, and the states from which a state is reached.
PLACED = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (START,), (START, SYSTEM, ASSISTANT), (USER,))
STATE = {b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = {b"su", b"ua", b"au"}
FAR = 1 << 60
END = [0, FAR, FAR, 0]
_SPACE = b" \t\n\x0b\x0c\r"

#: (state that its role leads to, or -1; must it be deleted; cost of leaving it cut short)
Kind = tuple[int, bool, int]


def _cost(row: dict) -> Kind:
    return STATE.get(row["role"][:1], -1), row["fault"] in ("blank", "duplicate"), CUT_SHORT if row["fault"] == "truncated" else 0


def distances(rows: list[Kind], after: list[int]) -> list[int]:
    """The least cost from node 4 * i + state (i rows done) to the end, where state s costs after[s]."""
    n = len(rows)
    dist, done = [FAR] * (4 * n + 4), bytearray(4 * n + 4)
    base, top = min(after), max(a for a in after if a < FAR)
    width = top - base + REROLE + CUT_SHORT + DELETE + 1  # no arc and no first entry reaches further than the ring
    ring: list[list[int]] = [[] for _ in range(width)]
    held = 0
    for s, a in enumerate(after):
        if a < FAR:
            dist[4 * n + s] = a
            ring[(a - base) % width].append(4 * n + s)
            held += 1
    d = base
    while held:
        bucket = ring[(d - base) % width]
        while bucket:
            v = bucket.pop()
            held -= 1
            if done[v] or dist[v] != d:
                continue
            done[v] = 1
            i, t = v >> 2, v & 3
            arcs = [(4 * i + s, INSERT) for s in BEFORE[t]] if t >= USER else []
            if i:
                state, must, extra = rows[i - 1]
                arcs.append((v - 4, DELETE))
                if not must:
                    if t >= USER:
                        arcs += [(4 * i - 4 + s, REROLE + extra) for s in BEFORE[t]]
                    if state == t:
                        arcs += [(4 * i - 4 + s, KEEP + extra) for s in BEFORE[t]]
            for u, w in arcs:
                if d + w < dist[u]:
                    dist[u] = d + w
                    ring[(d + w - base) % width].append(u)
                    held += 1
        d += 1
    return dist


def walk(rows: list[Kind], dist: list[int], after: list[int], state: int) -> tuple[str, int]:
    """The least letters along tight arcs from the first layer, and the state at the end."""
    i, n, out = 0, len(rows), []
    while i < n or dist[4 * i + state] != after[state]:
        d, t = dist[4 * i + state], PLACED[state]
        if i < n and dist[4 * i + 4 + state] + DELETE == d:
            out.append("D")
            i += 1
            continue
        if dist[4 * i + t] + INSERT == d:
            out.append("I")
            state = t
            continue
        own, must, extra = rows[i]
        if not must and own > 0 and state in BEFORE[own] and dist[4 * i + 4 + own] + KEEP + extra == d:
            out.append("K")
            state = own
        else:
            out.append("R")
            state = t
        i += 1
    return "".join(out), state


def applied(rows: list[dict], audit: str, state: int) -> list[dict]:
    """The repaired rows."""
    i, out = 0, []
    for letter in audit:
        if letter == "I":
            state = PLACED[state]
            out.append({"role": NAMES[state], "text": b""})
            continue
        row = rows[i]
        i += 1
        if letter != "D":
            state = STATE[row["role"][:1]] if letter == "K" else PLACED[state]
            out.append({"role": row["role"] if letter == "K" else NAMES[state], "text": row["text"]})
    return out


_ROW = pa.struct([("role", pa.binary()), ("text", pa.binary()), ("fault", pa.string())])
_TURN = pa.struct([("role", pa.binary()), ("text", pa.binary())])
STATS = {"n": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "first_role": pa.binary(), "last_role": pa.binary(), "min_turn": pa.int64(), "max_turn": pa.int64(), "turns_seen": pa.int64()}
SEGMENTS = {"conv_id": pa.int64(), "seg": pa.int64(), "whole": pa.bool_(), **STATS, "rows": pa.list_(_ROW), "costs": pa.list_(pa.int64()), "cost": pa.int64(), "audit": pa.string(), "repaired": pa.list_(_TURN)}
_DDL = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<bigint>", pa.list_(_ROW): "array<struct<role:binary,text:binary,fault:string>>", pa.list_(_TURN): "array<struct<role:binary,text:binary>>", pa.list_(pa.string()): "array<string>"}


def _ddl(kinds: dict) -> str:
    return ", ".join(f"{n} {_DDL[t]}" for n, t in kinds.items())


def _mapped(df: DataFrame, make: Callable[[Iterator[dict]], Iterator[dict]], kinds: dict) -> DataFrame:
    """mapInArrow over rows as dicts, a few hundred at a time on the way out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for r in make(r for b in batches for at in range(0, b.num_rows, 512) for r in b.slice(at, 512).to_pylist()):
            rows.append(r)
            if len(rows) == 256:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in kinds.items()], names=list(kinds))
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in kinds.items()], names=list(kinds))

    return df.mapInArrow(run, _ddl(kinds))


def _stats(rows: list[dict]) -> dict:
    turns = {r["turn"] for r in rows} - {None}
    pairs = zip(rows, rows[1:], strict=False)
    return {
        "n": len(rows), **{f: sum(r["fault"] == f for r in rows) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(a["role"][:1] + b["role"][:1] not in LEGAL for a, b in pairs),
        "first_role": rows[0]["role"][:1], "last_role": rows[-1]["role"][:1], "min_turn": min(turns, default=None), "max_turn": max(turns, default=None), "turns_seen": len(turns),
    }


def segments(rows: DataFrame) -> DataFrame:
    """A row for each segment (see SEGMENTS); whole ones are done, others have their rows and distances. rows: conv_id, turn, role, text."""
    small_batches(rows.sparkSession)
    text, role = (F.coalesce(F.col(c), F.lit(" ")).cast("binary") for c in ("text", "role"))
    plain = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    same = plain.withColumn("same", F.sha2(F.concat(F.sha2("role", 256).cast("binary"), "text"), 256))
    first = same.groupBy("conv_id", "same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))).alias("t")).select(F.col("conv_id").alias("__c"), F.col("same").alias("__s"), F.col("t.turn").alias("__t"), F.lit(True).alias("early"))
    at = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("same") == F.col("__s")) & F.col("turn").eqNullSafe(F.col("__t"))
    marked, _ = stored(same.join(first, at, "left").select("conv_id", "turn", "role", "text", F.col("early").isNotNull().alias("early")), "turns")
    order = ["conv_id", "turn", "role", "text"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)

    def make(rows: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        begun, number, last = False, 0, None

        def out(open_: bool) -> dict:
            made = {"conv_id": held[0]["conv_id"], "seg": part << 32 | number, "whole": not open_, **_stats(held)}
            kinds = [_cost(r) for r in held]
            if open_:
                each = [distances(kinds, [0 if s == t else FAR for s in range(4)])[:4] for t in range(4)]
                return made | {"rows": held, "costs": [each[t][s] for s in range(4) for t in range(4)]}
            dist = distances(kinds, END)
            audit, _ = walk(kinds, dist, END, START)
            return made | {"cost": dist[START], "audit": audit, "repaired": applied(held, audit, START)}

        for r in rows:
            if last is not None and r["conv_id"] != last["conv_id"]:
                yield out(not begun or held[0]["number"] > 0)  # the first of a task may have begun in the one before
                begun, held, number = True, [], 0
            elif len(held) == SEGMENT:
                yield out(True)
                held, number = [], number + 1
            again = last is not None and all(r[c] == last[c] for c in order)
            shown = r["text"].strip(_SPACE)
            r["fault"] = "blank" if not shown else "duplicate" if again or not r["early"] else None if shown[-1:] in (b".", b"!", b"?") else "truncated"
            r["number"] = number
            held.append(r)
            last = r
        if held:
            yield out(True)

    return _mapped(dealt, make, SEGMENTS)


def _chained(df: DataFrame, make: Callable[[list[dict]], Iterator[dict]], kinds: dict) -> DataFrame:
    """What make() gives for the few numbers of all segments of each conversation, in order. df: conv_id, seg and those numbers."""
    others = [c for c in df.columns if c != "conv_id"]
    grouped = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*others))).alias("all"))
    return _mapped(grouped, lambda rows: ({"conv_id": r["conv_id"], **x} for r in rows for x in make(r["all"])), kinds)


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b by (conv_id, seg); null ids are equal."""
    b = b.withColumnsRenamed({"conv_id": "__c", "seg": "__s"})
    return a.join(b, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("seg") == F.col("__s"))).drop("__c", "__s")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, seg (their order), whole, the figures of STATS, cost (of the conversation from this segment on), audit and repaired (array of struct role, text), one row a segment. rows: conv_id, turn, role, text."""
    made, _ = stored(segments(rows), "segments")
    left = made.where("not whole")

    def after(parts: list[dict]) -> Iterator[dict]:
        now = END
        for k, p in enumerate(reversed(parts)):
            yield {"seg": p["seg"], "after": now, "leads": k == len(parts) - 1}
            c = p["costs"]
            now = [min(FAR, min(c[4 * s + t] + now[t] for t in range(4))) for s in range(4)]

    def walked(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            kinds = [_cost(x) for x in r["rows"]]
            dist = distances(kinds, r["after"])
            ways = [walk(kinds, dist, r["after"], s) if dist[s] < FAR and (s == START or not r["leads"]) else (None, -1) for s in range(4)]
            yield r | {"cost": dist[START], "audits": [w[0] for w in ways], "exits": [w[1] for w in ways], "begins": [min(FAR, x) for x in dist[:4]]}

    def entries(parts: list[dict]) -> Iterator[dict]:
        state = START
        for p in parts:
            yield {"seg": p["seg"], "entry": state}
            state = p["exits"][state]

    def finished(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            audit = r["audits"][r["entry"]]
            yield r | {"audit": audit, "cost": r["begins"][r["entry"]], "repaired": applied(r["rows"], audit, r["entry"])}

    whence = {"conv_id": pa.int64(), "seg": pa.int64()}
    numbers = pa.list_(pa.int64())
    afters = _chained(left.select("conv_id", "seg", "costs"), after, {**whence, "after": numbers, "leads": pa.bool_()})
    final = {**whence, "whole": pa.bool_(), **STATS, "cost": pa.int64(), "audit": pa.string(), "repaired": pa.list_(_TURN)}
    ways = _mapped(_met(left.drop("cost", "audit", "repaired", "costs"), afters), walked, {**whence, "whole": pa.bool_(), **STATS, "rows": pa.list_(_ROW), "audits": pa.list_(pa.string()), "exits": numbers, "begins": numbers})
    ways, _ = stored(ways, "walks")
    entered = _met(ways, _chained(ways.select("conv_id", "seg", "exits"), entries, {**whence, "entry": pa.int64()}))
    return made.where("whole").select(*final).unionByName(_mapped(entered, finished, final))


OUT = {"conv_id": pa.int64(), **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation, read from repaired(): a digest goes over all its text, so its segments pass one after the other through one task, which holds one at a time."""

    def make(rows: Iterator[dict]) -> Iterator[dict]:
        now: dict | None = None
        for r in rows:
            if now is None or r["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield done(now)
                now = {"conv_id": r["conv_id"], "cost": r["cost"], "audit": [], "sha": hashlib.sha256(), "any": False, "turns": 0, "low": None, "high": None, "last": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            for c in ("blank", "duplicate", "truncated", "illegal"):
                now[c] += r[c]
            now["illegal"] += now["last"] is not None and now["last"] + r["first_role"] not in LEGAL
            now["turns"] += r["turns_seen"] - (r["min_turn"] is not None and r["min_turn"] == now["high"])
            now["low"] = r["min_turn"] if now["low"] is None else now["low"]
            now["high"] = now["high"] if r["max_turn"] is None else r["max_turn"]
            now["last"] = r["last_role"]
            now["audit"].append(r["audit"])
            for t in r["repaired"]:
                now["sha"].update(b"\n" * now["any"] + t["role"] + b":" + t["text"])
                now["any"] = True
        if now is not None:
            yield done(now)

    def done(x: dict) -> dict:
        return x | {"gaps": 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"], "audit": "".join(x["audit"]), "repaired_sha256": x["sha"].hexdigest()}

    parted = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return _mapped(pieces.where("whole"), make, OUT).unionByName(_mapped(parted, make, OUT))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations after the faults that the crc32 of `conv_id:turn` (a null is one space) picks."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    k = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    said = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    made = rows.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(role).alias("role"), said.alias("text"), k.alias("k")).where("k <> 0")
    return made.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    got = digests(repaired(damaged(rows))).withColumnRenamed("conv_id", "__c")
    every = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    both = every.join(got, F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    empty = {c: F.lit(0).cast("bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return both.select("conv_id", *[F.coalesce(c, x).alias(c) for c, x in empty.items()])


#: The distances again, as a recursion from the last row to the first over (cost, letters) of each state: S start, Y after a system row, U, A.
ORACLE = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS k FROM (SELECT DISTINCT key FROM raw)),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM
  (SELECT raw.*, k, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) FROM raw JOIN crc USING (key)) WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN regexp_matches(text, '[.!?][ \t\n\x0B\f\r]*$') THEN '' ELSE 't' END AS f, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
dp AS (
  SELECT conv_id, n + 1 AS i, 0 AS sc, '' AS sa, 6 AS yc, 'II' AS ya, 3 AS uc, 'I' AS ua, 0 AS ac, '' AS aa FROM o GROUP BY conv_id, n
  UNION ALL
  SELECT conv_id, i, sc, sa, yc, ya, uc, ua, ac, aa FROM (
    SELECT conv_id, i, least((r.s).c, (r.u).c + 3) AS sc, CASE WHEN ((r.s).c, (r.s).a) < ((r.u).c + 3, 'I' || (r.u).a) THEN (r.s).a ELSE 'I' || (r.u).a END AS sa,
      least((r.y).c, (r.u).c + 3) AS yc, CASE WHEN ((r.y).c, (r.y).a) < ((r.u).c + 3, 'I' || (r.u).a) THEN (r.y).a ELSE 'I' || (r.u).a END AS ya,
      (r.u).c AS uc, (r.u).a AS ua, (r.a).c AS ac, (r.a).a AS aa FROM (
      SELECT conv_id, i, {'s': s, 'y': y, 'u': CASE WHEN (u.c, u.a) < (a.c + 3, 'I' || a.a) THEN u ELSE {'c': a.c + 3, 'a': 'I' || a.a} END,
        'a': CASE WHEN (a.c, a.a) < (u.c + 3, 'I' || u.a) THEN a ELSE {'c': u.c + 3, 'a': 'I' || u.a} END} AS r FROM (
        SELECT f.conv_id, f.i,
          list_sort([{'c': sc + 4, 'a': 'D' || sa}, {'c': CASE WHEN f.f IN ('b', 'd') OR f.c <> 's' THEN 1000000000 ELSE yc + x END, 'a': 'K' || ya},
            {'c': CASE WHEN f.f IN ('b', 'd') OR f.c <> 'u' THEN 1000000000 ELSE uc + x END, 'a': 'K' || ua}, {'c': CASE WHEN f.f IN ('b', 'd') THEN 1000000000 ELSE uc + 3 + x END, 'a': 'R' || ua}])[1] AS s,
          list_sort([{'c': yc + 4, 'a': 'D' || ya}, {'c': CASE WHEN f.f IN ('b', 'd') OR f.c <> 'u' THEN 1000000000 ELSE uc + x END, 'a': 'K' || ua}, {'c': CASE WHEN f.f IN ('b', 'd') THEN 1000000000 ELSE uc + 3 + x END, 'a': 'R' || ua}])[1] AS y,
          list_sort([{'c': uc + 4, 'a': 'D' || ua}, {'c': CASE WHEN f.f IN ('b', 'd') OR f.c <> 'a' THEN 1000000000 ELSE ac + x END, 'a': 'K' || aa}, {'c': CASE WHEN f.f IN ('b', 'd') THEN 1000000000 ELSE ac + 3 + x END, 'a': 'R' || aa}])[1] AS u,
          list_sort([{'c': ac + 4, 'a': 'D' || aa}, {'c': CASE WHEN f.f IN ('b', 'd') OR f.c <> 'u' THEN 1000000000 ELSE uc + x END, 'a': 'K' || ua}, {'c': CASE WHEN f.f IN ('b', 'd') THEN 1000000000 ELSE uc + 3 + x END, 'a': 'R' || ua}])[1] AS a
        FROM dp JOIN (SELECT *, CASE WHEN f = 't' THEN 3 ELSE 0 END AS x FROM f) f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i - 1)))),
best AS (SELECT conv_id, sc AS cost, sa AS audit FROM dp WHERE i = 1),
letters AS (SELECT conv_id, k, audit[k] AS x FROM best, (SELECT unnest(range(1, 2000)) AS k) WHERE k <= len(audit)),
placed AS (SELECT conv_id, k, x, sum((x <> 'I')::INT) OVER w AS i, sum((x <> 'D')::INT) OVER w AS j FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (SELECT p.conv_id, p.k, p.j, p.x, f.role, f.text, max((p.j = 1 AND p.x = 'K' AND f.c = 's')::INT) OVER (PARTITION BY p.conv_id) AS sys FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE p.x <> 'D'),
fixed AS (SELECT conv_id, string_agg((CASE WHEN x = 'K' THEN role WHEN (j - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN x = 'I' THEN '' ELSE text END), chr(10) ORDER BY k) AS t FROM said GROUP BY conv_id),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
  count(*) FILTER (i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM e.conv_id"""
