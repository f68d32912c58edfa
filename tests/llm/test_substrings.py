"""Substring dedup against brute force, and its index against plain counting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import substrings as S


def plain(docs, window):
    seen, out = set(), []
    for doc_id, text in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if (k := tuple(words[i : i + window])) in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out += [(doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest())] * docs.count((doc_id, text))
    return sorted(out, key=str)


def found(spark, docs, window):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("key", "tie", "start", "anchors", "first")}).repartition(3)
    made = S.deduplicated(df, window)
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    return sorted(map(tuple, made.select("doc_id", "n_words", gone, F.sha2("kept", 256)).collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    base = [f"{rng.choice('aBçd')}{rng.randrange(60)}" for _ in range(2000)]
    out = []
    for i in range(90):
        words = []
        while len(words) < rng.randrange(5, 200):
            a, kind = rng.randrange(1900), rng.random()
            words += base[a : a + rng.randrange(5, 60)] if kind < 0.4 else ["x", "y"] * rng.randrange(1, 30) if kind < 0.5 else [str(rng.randrange(10000)) for _ in range(rng.randrange(1, 30))]
        out.append((i, "\t\n ".join(words)))
    return [*out, (200, None), (201, ""), (202, "one two"), (None, out[3][1]), (203, out[5][1]), (7, out[7][1]), (204, "long " * 30_000), (205, "long " * 30_000)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_documents(spark, docs, hot, monkeypatch):
    """Copies, shared and overlapping passages, periodic texts, null ids and texts, rows that repeat; with and without frequent anchors, in shards of one key and of many."""
    monkeypatch.setattr(S, "HOT", hot)
    for window in (20, 6):
        assert found(spark, docs, window) == plain(docs, window)


def test_empty_table(spark):
    assert found(spark, [], 20) == []


def test_index_counts_what_plain_counting_counts():
    rng = np.random.default_rng(1)
    symbols = np.concatenate([np.append(rng.integers(1, 5, n), 0) for n in rng.integers(12, 60, 30)]).astype(np.int32)
    index, window = S.FMIndex(symbols, 8), 8
    ends = np.array([i for i in range(window - 1, len(symbols)) if (symbols[i - window + 1 : i + 1] > 0).all()])
    length, lo, hi = index.matching(symbols, ends, window)
    every = [tuple(symbols[k : k + m]) for m in range(window + 1) for k in range(len(symbols) - m + 1)]
    counts = {}
    for t in every:
        counts[t] = counts.get(t, 0) + 1
    for k, e in enumerate(ends.tolist()):
        assert length[k] == max(m for m in range(window + 1) if m == 0 or counts[tuple(symbols[e - m + 1 : e + 1])] > 1)
        if length[k] == window:
            assert hi[k] - lo[k] == counts[tuple(symbols[e - window + 1 : e + 1])]
            assert all((symbols[p : p + window] == symbols[e - window + 1 : e + 1]).all() for p in index.suffixes[lo[k] : hi[k]])


def test_equal_windows_have_equal_anchors():
    words = S._hashes([b"%d" % (k * k % 17) for k in range(400)], S.Words())
    first, n, anchor = S.runs(words, 20)
    assert n.sum() == 381 and (n <= 13).all()
    by = {}
    for a, count, h in zip(first, n, anchor, strict=True):
        for k in range(a, a + count):
            assert by.setdefault(tuple(words[k : k + 20]), h) == h


def test_long_texts_go_in_parts(monkeypatch):
    words = S._hashes([b"%d" % (k * k % 1009) for k in range(900)], S.Words())
    whole = S.runs(words, 20)
    monkeypatch.setattr(S, "_PLACE", 7)
    parts = S.runs(words, 20)
    assert parts[1].sum() == whole[1].sum() == 881
