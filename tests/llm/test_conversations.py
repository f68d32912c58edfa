"""Conversation repair against an exhaustive search over edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as V


def edits(rows, faults):
    """The cheapest edits, the least in ASCII of equals: (cost, letters, repaired)."""

    @functools.cache
    def best(i, s, inserted):
        out = [(0, "", ())] if i == len(rows) and s in (0, 3) else []
        to, name = {0: (2, "user"), 1: (2, "user"), 3: (2, "user"), 2: (3, "assistant")}[s]

        def put(cost, letter, said, then):
            if then is not None:
                out.append((cost + then[0], letter + then[1], said + then[2]))

        if inserted < 2:
            put(3, "I", ((name, ""),), best(i, to, inserted + 1))
        if i < len(rows):
            (_, role, text), x = rows[i], 3 * (faults[i] == "t")
            put(4, "D", (), best(i + 1, s, 0))
            if faults[i] not in ("b", "d"):
                put(3 + x, "R", ((name, text),), best(i + 1, to, 0))
                own = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                if own and s in {1: (0,), 2: (0, 1, 3), 3: (2,)}[own]:
                    put(x, "K", ((role, text),), best(i + 1, own, 0))
        return min(out) if out else None

    return best(0, 0, 0)


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        got = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            got += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in got:
            shown = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not shown else "d" if (role, text) in seen else "" if shown[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = [t for t, _, _ in got if t is not None]
        cost, audit, said = edits(tuple(got), tuple(faults))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(7), []
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "sage"], ["Hi.", "ok", "What?", "  ", "Ünd so!\n", None, "x.y", "Long text. " * 3]
    for c in range(120):
        turn = 0
        for _ in range(rng.randrange(1, 14)):
            out.append((c or None, turn if rng.random() < 0.95 else None, rng.choice(roles), rng.choice([*texts, f"{rng.random()}."])))
            turn += rng.choice([0, 1, 1, 1, 2])
    return out + [(999, t, "user" if rng.random() < 0.2 else ["user", "assistant"][t % 2], rng.choice([f"{t}.", str(t), "yes."])) for t in range(250)]


@pytest.mark.parametrize("segment", [4096, 5])
def test_conversations(spark, rows, segment, monkeypatch, tmp_path):
    """Whole conversations, and one that goes over several tasks and many segments; null ids, turns, roles and texts, unknown roles, equal turns."""
    monkeypatch.setattr(V, "SEGMENT", segment)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("seg", "same", "early", "costs", "k")})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, V.op12_conversations(spark, str(tmp_path)).select(*V.OUT).collect()), key=str) == plain(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert V.op12_conversations(spark, str(tmp_path)).collect() == []


def test_a_conversation_that_loses_all_rows(spark, tmp_path):
    lost = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in V.op12_conversations(spark, str(tmp_path)).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_distances_meet_the_walk():
    rng = random.Random(2)
    for _ in range(200):
        kinds = [(rng.choice([-1, 1, 2, 3]), rng.random() < 0.2, rng.choice([0, 3])) for _ in range(rng.randrange(8))]
        dist = V.distances(kinds, V.END)
        audit, state = V.walk(kinds, dist, V.END, V.START)
        assert state in (V.START, V.ASSISTANT) and sum(x != "I" for x in audit) == len(kinds)
        cost, i = 0, 0
        for x in audit:
            cost += {"D": 4, "I": 3, "K": 0, "R": 3}[x] + (kinds[i][2] if x in "KR" else 0)
            i += x != "I"
        assert cost == dist[0]
