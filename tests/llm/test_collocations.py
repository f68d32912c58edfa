"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as C


def plain(docs, least, most, covered):
    counts, n, out = defaultdict(Counter), Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            counts[lang].update(tuple(words[i : i + d]) for d in range(1, 5) for i in range(len(words) - d + 1))
    for lang, c in counts.items():
        phrases = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        drop = {s for p, a in phrases.items() for d in range(2, len(p)) for i in range(len(p) - d + 1) if 100 * a >= covered * c[s := p[i : i + d]]}
        rows = []
        for p, a in phrases.items():
            if p not in drop:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    known = [*(f"W{i}" for i in range(30)), "ü", "ß x", "a\x00b"]
    out = [(rng.choice(["en", "de", None]), "".join(rng.choice(known[: int(1 + rng.random() ** 2 * 32)]) + rng.choice([" "] * 8 + [". ", "\n", "\t", ", "]) for _ in range(rng.randrange(1, 60)))) for _ in range(300)]
    return [*out, ("fr", None), ("fr", ""), ("es", "..."), ("es", "one"), ("", "a b"), ("en", "a b c d " * 400)]


@pytest.mark.parametrize("run", [C.RUN, 700])
def test_phrases(spark, docs, run, monkeypatch):
    """One run a task or many, texts longer than a run, borders inside frequent prefixes, null and empty texts and languages."""
    monkeypatch.setattr(C, "RUN", run)
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit(1) for c in ("phrase", "rank", "n", "words")}).repartition(5)
    for least, most in ((3, 50), (30, 5)):
        assert sorted(map(tuple, C.collocations(df, least, most).collect())) == plain(docs, least, most, 80)


def test_many_ranges(spark, docs, monkeypatch):
    """More ranges than there are prefixes to cut: every border lies inside some node."""
    monkeypatch.setattr(C, "RANGE_BYTES", 600)
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, C.collocations(df, 3, 40, 60).collect())) == plain(docs, 3, 40, 60)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_counts_of_over_64_bits(spark):
    a = (1 << 62) + 1
    rows = [("en", b"x y", 2, a, [a + 1], b"x", b"y", [a + 2])]
    got = C.scored(spark.createDataFrame(rows, "lang string, phrase binary, words int, f bigint, lefts array<bigint>, head binary, rest binary, rights array<bigint>")).first()
    assert got.score == 2_000_000 * a // (2 * a + 3)


def test_block_round_trip():
    words = [b"%03d" % i for i in range(200)]
    rng = random.Random(1)
    import numpy as np

    paths = []
    for _ in range(3000):
        d = rng.randrange(1, 5)
        paths.append((rng.randrange(3), *[rng.choice((1, 2, rng.randrange(1, 201))) for _ in range(d)], *[0] * (4 - d)))
    trie = C.Trie([b"a", b"b", b"c"], words, [np.array(c) for c in zip(*paths, strict=True)], None)
    assert [trie.path(i) for i in range(len(trie.counts))] == sorted({([b"a", b"b", b"c"][p[0]], *(words[k - 1] if k else b"" for k in p[1:])) for p in paths})
    assert trie.counts.sum() == 3000
    block = trie.block(5, 900)
    own = block["words"].split(b"\n")
    cols, counts = C._unpacked(block, 4)
    assert [(block["langs"][cols[0][i]], *(own[c[i]] for c in cols[1:])) for i in range(895)] == [trie.path(i) for i in range(5, 900)]
    assert (counts == trie.counts[5:900]).all()
