"""Every registered query once, held to its contract or a plain rewrite; and rows that are awkward for one operator."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.llm import chat, decontaminate, ftrl, licenses, quality, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_conversations": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op13_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
}


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "embeddings", "pages", "conversations")}


@pytest.mark.parametrize("name", CONTRACT)
def test_schema(spark, name):
    out = __spark_entry__.queries()[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) == CONTRACT[name]


def test_op1_rows(spark, tables):
    out = __spark_entry__.queries()["op1_sharding"](spark, SF).collect()
    text = {r.doc_id: (r.text or "").encode() for r in tables["documents"].collect()}
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in out) == Counter((i, len(t) + 1, zlib.crc32(t), "bytes", None) for i, t in text.items())
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_op2_rows(spark, tables):
    out = __spark_entry__.queries()["op2_ann"](spark, SF).collect()
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in tables["embeddings"].collect()}
    ids = np.array(sorted(rows))
    hit = 0
    for q in (i for i in rows if i % 20 == 0):
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        score = {i: float(rows[i] @ rows[q]) for i in ids if i != q}
        assert [r.rank for r in own] == list(range(1, 21)) and all(abs(r.score - score[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(sorted(score, key=lambda i: (-score[i], i))[:20]))
    assert hit >= 0.9 * len(out)


def test_op9_rows(spark, tables):
    out = __spark_entry__.queries()["op9_simhash"](spark, SF).collect()
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in tables["documents"].collect()}
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{x:016x}" for i, x in prints.items()}
    least = {i: min(j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
    while (deeper := {i: min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}) != least:
        least = deeper
    assert {r.doc_id: r.component_id for r in out} == least


# classifiers


def plain_toxicity(text, weights):
    """The score as a plain sum over the features of a text."""
    seen = set()
    for chunk in (text or "").lower().split():
        w = chunk.strip(toxicity.ENDS)
        if w:
            seen |= {f"w {w}"} | {f"{k} {w[:k]}" for k in (4, 5, 6) if len(w) >= k}
    z = weights[0] + sum(weights[i] for i in {zlib.crc32(f.encode()) % (toxicity.DIMS - 1) + 1 for f in seen})
    return 1 / (1 + np.exp(-z))


def test_op5_scores_are_weights_times_features(spark, tables):
    weights = toxicity.train(tables["documents"], tables["labels"])
    assert weights.any()
    text = {r.doc_id: r.text for r in tables["documents"].collect()}
    for r in __spark_entry__.queries()["op5_toxicity"](spark, SF).collect():
        assert abs(r.score - plain_toxicity(text[r.doc_id], weights)) < 1e-8
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)


def test_op7_scores_are_weights_times_shares(spark, tables):
    weights = quality.train(tables["documents"], tables["labels"])
    text = {r.doc_id: r.text for r in tables["documents"].collect()}
    for r in __spark_entry__.queries()["op7_quality"](spark, SF).collect():
        tokens = [x for c in (text[r.doc_id] or "").split() for x in quality.token_hashes(c)]
        said = [quality.SAME if k and x == tokens[k - 1] else x for k, x in enumerate(tokens)]
        one = [(x * 0x9E3779B97F4A7C15) % (1 << 64) for x in said]
        two = [((a * 31 + b) * 0xC2B2AE3D27D4EB4F) % (1 << 64) for a, b in zip(one, said[1:])]
        at = [max(x >> (64 - quality.BITS), 1) for x in one + two]
        z = weights[0] + (quality.SCALE * sum(weights[i] for i in at) / len(at) if at else 0.0)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6


def test_ftrl_equals_a_dense_rewrite():
    """McMahan's per-coordinate update, written out for dense vectors."""
    rng = np.random.default_rng(1)
    model = ftrl.Ftrl(12, alpha=0.4, beta=1.0, l1=0.3, l2=0.1)
    z, n = np.zeros(12), np.zeros(12)
    for _ in range(200):
        x = rng.random(12) * (rng.random(12) < 0.5)
        x[0] = 1.0
        y = float(rng.random() < 0.3)
        l1, l2 = np.where(np.arange(12) == 0, 0.0, 0.3), np.where(np.arange(12) == 0, 0.0, 0.1)
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / 0.4 + l2))
        g = (1 / (1 + np.exp(-w @ x)) - y) * x
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.4 * w
        n += g * g
        at = np.flatnonzero(x)
        model.learn(at, x[at], y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_penalty_acts_on_the_registered_model(spark, tables):
    """The model of op5_toxicity differs from the one without penalty, and swapping a neutral mention changes its scores less."""
    docs = tables["documents"].union(tables["documents"].withColumn("doc_id", F.col("doc_id") + 100_000))
    labels = tables["labels"].union(tables["labels"].withColumn("doc_id", F.col("doc_id") + 100_000))
    none, some = toxicity.train(docs, labels, penalty=0.0), toxicity.train(docs, labels)
    assert not np.array_equal(none, some)
    without, with_ = (toxicity.audit(tables["documents"], w).first() for w in (none, some))
    assert with_.texts == tables["documents"].count() and with_.mean_gap <= without.mean_gap and with_.neutral_false_positives <= 0.02


def test_labelled_rows_are_bounded_whatever_repeats(spark):
    """One labelled id that all rows carry."""
    docs = spark.range(3_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(7, 1)], "doc_id bigint, toxic int")
    assert zlib.crc32(b"7") % 5
    assert toxicity.train(docs, labels, sample=50).any()


# licences


def published(name):
    return (licenses.files("tidemark.llm") / "license_texts" / f"{name}.txt").read_text()


def rewrapped(text, width):
    """Paragraphs of a text, those that state a copyright too, with other line breaks."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text))


def test_licences_in_any_line_breaks(spark):
    """Every shipped text wrapped anew at 60 to 100 letters, by paragraphs or as one, and on a single line, is the licence that it was: no sentence of it is taken for a statement of copyright."""
    names = [f.name.removesuffix(".txt") for f in (licenses.files("tidemark.llm") / "license_texts").iterdir() if f.name.endswith(".txt")]
    texts = [(n.removesuffix(".header"), published(n)) for n in names] + [x for x in licenses.KNOWN if x[0] in ("ISC", "0BSD")]
    rows = [(n, w, form) for n, t in texts for w in range(60, 101, 3) for form in (rewrapped(t, w), textwrap.fill(" ".join(t.split()), w, break_on_hyphens=False))]
    rows += [(n, 0, " ".join(t.split())) for n, t in texts]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.license for r in licenses.scanned(df, licenses.known(spark)).collect()}
    assert len(names) >= 20 and [(n, w) for i, (n, w, _) in enumerate(rows) if got[i] != n] == []


def test_near_licences_are_none(spark):
    """A sentence put in, left out or changed makes another text, wherever it stands."""
    mit, gpl = published("MIT"), published("GPL-2.0")
    rows = [mit.replace("free of charge", "for a charge"), mit + "\nNot for resale.", mit.replace("Permission is hereby granted", "No permission is hereby granted"),
            gpl.replace("Everyone is permitted", "Nobody is permitted"), mit[: len(mit) // 2], "Copyright (c) 2020 A", "© 2020 A. All rights reserved."]
    out = licenses.scanned(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), licenses.known(spark)).collect()
    assert len(out) == len(rows) and all(r.license is None for r in out)


def test_copyright_lines(spark):
    """By hand: what is a statement and what is a sentence, and where a statement ends."""
    none = ["copyright (c) 2020 a. person", "* copyright 2020 a", "(c) 2020 a", "© a person", "copyright © the authors", "copyright [yyyy] [name]", "copyright by the authors", "All rights reserved."]
    kept = ["copyright notice and this permission notice appear in all copies", "copyright holders be liable", "copyright owner or entity", "copyright law", "c you must retain"]
    ends = [("(c) 2020 A, Inc., 5 Road,\nTown Everyone is permitted", "everyone is permitted"), ("Title Copyright (c) 2020 A Redistribution\nand use", "title redistribution and use"), ("(c) 2020 A\nOther words", "other words")]
    cases = [(t, "") for t in none] + [(t, t) for t in kept] + ends
    df = spark.createDataFrame(cases, "text string, want string").select("text", "want", licenses.canonical(licenses.canonical_lines(F.col("text"))).alias("form"))
    assert [r for r in df.collect() if r.form != r.want] == []


def test_license_of_very_long_texts(spark):
    mit = published("MIT")
    long = "word " * 400_000
    rows = [(1, long), (2, f"{long}\nReleased under the MIT License.\n{long}"), (3, mit.replace("\n", "\n" + " " * 5_000))]
    out = licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string"), licenses.known(spark)).collect()
    assert {(r.doc_id, r.license, r.line_licenses) for r in out} == {(1, None, ""), (2, None, "MIT"), (3, "MIT", "")}


# urls


def test_urls_by_either_join(spark, monkeypatch):
    """A list that is not broadcast, a rule that most urls meet, very long urls, and urls without any key."""
    monkeypatch.setattr("tidemark.llm.components.LEAST_HUB", 10)
    rules = [*urls.RULES, *[("block", f"h{k}.org", f"/{'p' * (k % 7)}/") for k in range(300)]]
    rng = random.Random(3)
    asked = [f"http://{rng.choice(['a.', ''])}h{rng.randrange(600)}.org/{'p' * rng.randrange(9)}/x" for _ in range(400)]
    asked += [f"http://s{k}.com/{k}" for k in range(400)] + ["http://x.net/es/" + "y" * 200_000, "http://" + "a." * 2_000 + "com/", None, "", "no"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id bigint, url string")
    listed = spark.createDataFrame(rules, "verdict string, host string, path string")
    a, b = (sorted(urls.judged(pages, listed, broadcast_bytes=n).collect(), key=lambda r: r.page_id) for n in (1 << 20, 0))
    assert a == b and len(a) == len(asked)
    for r, url in zip(a, asked):
        after = url.split("://", 1)[1] if url and "://" in url else ""
        host, _, path = after.partition("/")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)] if after else []
        assert (r.rule, r.verdict) == ((max(fits)[1], max(fits)[2]) if fits else (None, "allow"))


# chat


def test_long_conversation(spark):
    said = [(k, "assistant" if k % 2 else "user", f"turn {k} <s> " * (20_000 if k == 5 else 1)) for k in range(3_000)]
    table = spark.createDataFrame([(1, *x) for x in said] + [(None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    out = chat.digests(chat.formatted(table)).collect()
    one = next(r for r in out if r.conv_id == 1)
    assert one.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
    assert one.loss_sha256 == hashlib.sha256("".join(t for _, r, t in said if r == "assistant").encode()).hexdigest()
    assert sorted(r.n_turns for r in out if r.conv_id is None) == [1, 1]


# the pipeline


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing names, empty tables: every stage gives a defined result."""
    import corpus_pipeline as p

    rows = [(None, "null id of a text with some words"), (5, None), (6, ""), (7, " \n\t"), (8, "same text here"), (9, "same text here"), (9, "same text here"), (10, "long " * 30_000)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d = d.withColumns({c: F.lit("x") for c in ("__toxicity", "__quality", "__print", "__row", "__key", "__hits", "fp", "root", "row.id")})
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
        if name == "near-duplicates":
            assert kept == [(False, 0), (True, 5), (True, 8), (True, 10)]
        if name == "decontamination":
            assert len(kept) == len(rows)
        assert stage(spark, d.limit(0), SF).collect() == [], name
    assert sum(r.length for r in p.packing_stage(spark, d, SF).where("doc_id in (5, 6, 7)").collect()) == 3
    assert p.packing_stage(spark, d.limit(0), SF).collect() == []


def test_stages_without_labels_or_items_keep_all(spark, tmp_path, tables):
    import corpus_pipeline as p

    tables["labels"].limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    d = tables["documents"]
    for stage in (p.toxicity_stage, p.quality_stage, p.decontamination_stage):
        assert stage(spark, d, str(tmp_path)).count() == d.count()


# decontamination


def test_short_and_shared_items_match_sql(spark, tmp_path, monkeypatch):
    """Items of one to seven words, many of them in one text, held against it two at a time: the rows of the SQL, which takes short items too."""
    import duckdb

    monkeypatch.setattr("tidemark.llm.decontaminate.ASKED", 2)
    rng = random.Random(9)
    said = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(said) for _ in range(rng.choice((1, 3, 8, 400)))) for _ in range(60)] + ["", None]
    pieces = [t.split() for t in texts if t and len(t.split()) > 10]
    items = [" ".join(p[at : at + n]) for p in pieces for n in range(1, 8) for at in (rng.randrange(len(p) - n),)] + ["", None, "not there at all"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, item_id, shared, item_shingles, containment FROM ({decontaminate.ORACLE})").fetchall()
    got = decontaminate.op6_decontaminate(spark, str(tmp_path)).select("doc_id", "item_id", "shared", "item_shingles", "containment").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({i for _, i, *_ in want}) > 30
