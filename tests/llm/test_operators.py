"""The ten operators on small tables: brute force, round trips, held-out accuracy, and awkward rows."""

import json
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from tidemark.llm import ann, chat, decontaminate, licenses, packing, quality, sharding, simhash, toxicity, urls
from tidemark.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def docs(spark, rows, extra=True):
    """A documents table of (doc_id, text), with a column whose names clash with what operators make."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("score", "predicted", "fp", "shard", "slot", "y", "component_id", "start", "row", "key")}) if extra else df


def texts(n, seed=1, words=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, words)))) for i in range(n)]


AWKWARD = [(None, "null id"), (5, None), (6, ""), (7, " \n\t"), (8, "same text here"), (9, "same text here"), (9, "same text here"), (10, "long " * 30_000)]


# sharding


def check_shards(out, rows, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(shards):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < shards for r in out)


def test_sharding_near_equal(spark):
    rows = texts(2_000)
    out = sharding.sharded(docs(spark, rows), part_rows=150).collect()
    check_shards(out, rows)
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 0.03 * sum(load.values()) / 8
    where = {}
    split = [r for r in out if where.setdefault(r.text_crc32, r.shard) != r.shard]
    assert not split  # no group is large here


def test_sharding_splits_a_hot_text(spark):
    rows = texts(300) + [(k // 2, "hot " * 20) for k in range(900)] + [(1_000, "hot " * 20)] * 300
    out = sharding.sharded(docs(spark, rows)).collect()
    check_shards(out, rows)
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 0.05 * sum(load.values()) / 8


def test_sharding_awkward(spark):
    check_shards(sharding.sharded(docs(spark, AWKWARD)).collect(), AWKWARD)
    assert sharding.sharded(docs(spark, [])).collect() == []
    check_shards(sharding.sharded(docs(spark, [(1, "one")])).collect(), [(1, "one")])


# nearest neighbours


def brute(ids, x, step, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % step == 0:
            s = x @ q
            out[i] = [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != i][:k]
    return out


@pytest.mark.parametrize("even", [True, False])
def test_ann_recall_and_scores(spark, even):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1_500, 32)).astype(np.float32)
    if even:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]  # a hot vector: ties everywhere
    ids = np.arange(1_500)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(2_000, None), (2_020, [0.0] * 32), (2_040, [float("nan")] * 32), (2_060, [1.0] * 31)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("key", F.lit(1)), "vec_id % 20 = 0").collect()
    true = brute(ids, x.astype(np.float64), 20, 20)
    got = {i: [] for i in true}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        assert abs(r.score - x[r.query_id].astype(float) @ x[r.vec_id].astype(float)) < 1e-9
    assert all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[i]) & set(true[i])) for i in true) / (20 * len(true)) >= 0.9
    assert got[100] == true[100]


def test_ann_fills_every_query(spark, monkeypatch):
    """Lone vectors beside a tight group meet nearly empty keys at one probe; they still get their k nearest, and exactly."""
    monkeypatch.setattr(ann, "fitted", lambda *a: 1)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1_500, 32))
    x[100:] = x[0] + 0.01 * x[100:]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    out = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"), "vec_id % 5 = 0").collect()
    true, got = brute(np.arange(1_500), x.astype(np.float64), 5, 20), {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == true.keys() and all(len(v) == 20 for v in got.values())
    assert sum(got[i] == true[i] for i in range(5, 100, 5)) >= 15


def test_ann_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(few, "vec_id % 20 = 0").orderBy("rank").collect()] == [(0, 1, 2, 0.5), (0, 2, 1, 0.0)]
    assert ann.nearest(few.limit(0), "vec_id % 20 = 0").collect() == []


# licences


def test_license_scan(spark):
    isc = dict(licenses.KNOWN)["ISC"]
    variant = "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + isc.replace("SOFTWARE", "software").replace(",", " ,") + "\n"
    rows = [(1, isc), (2, variant), (3, "some text\n* Released under the MIT Licence!\nmore"), (4, isc + " extra"), (5, None), (6, ""), (7, "© x"), (8, "RELEASED under the mit license"), (None, isc), (2, variant)]
    out = licenses.scanned(docs(spark, rows), licenses.known(spark)).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id or 0, r.license or "", r.line_licenses) for r in out) == sorted(
        [(1, "ISC", ""), (2, "ISC", ""), (2, "ISC", ""), (3, "", "MIT"), (4, "", ""), (5, "", ""), (6, "", ""), (7, "", ""), (8, "MIT", "MIT"), (0, "ISC", "")]
    )
    assert licenses.scanned(docs(spark, []), licenses.known(spark)).collect() == []


def test_full_license_texts(spark):
    """The MIT and BSD licences as they are published, whatever the breaks, and the long ones; a changed text is none of them."""
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    keep = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    none = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    rows = [("MIT", f"{title}Copyright (c) 2021 A. Person\n\n{grant}\n\n{keep}\n\n{none}\n") for title in ("", "MIT License\n\n", "The MIT License (MIT)\n\n")]
    rows.append((None, f"{grant}\n\n{keep}"))
    folder = licenses.files("tidemark.llm") / "license_texts"
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"):
        text = (folder / f"{name}.txt").read_text()
        rows += [(name, text), (name, text.upper()), (None, text + "\nmore")]
    header = (folder / "Apache-2.0.header.txt").read_text().replace("[yyyy]", "2020")
    rows.append(("Apache-2.0", header))
    out = licenses.scanned(docs(spark, [(i, t) for i, (_, t) in enumerate(rows)]), licenses.known(spark)).collect()
    assert [r.license for r in sorted(out, key=lambda r: r.doc_id)] == [n for n, _ in rows]


# urls


def judge(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([k for c in "/?#" if (k := after.find(c)) >= 0], default=len(after))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in after[:at])
    rest = after[at:]
    path = rest[: min([k for c in "?#" if (k := rest.find(c)) >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls(spark):
    given_ = ["http://Example.COM/en/x?y#z", "https://a.www.example.com/en/", "http://notexample.com/en/", "ftp://x.net/es/1", "http://x.net/es", "net/es/", None, "", "://", "http://com", "http://com/", "a://b://c.net/fr/", "http://.net/fr/", "http://example.com?/en/"]
    rows = [(k, u, "x") for k, u in enumerate(given_)] + [(0, given_[0], "x"), (None, given_[3], "x")]
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    out = urls.judged(pages, rules).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out) == Counter((i, *judge(u)) for i, u, _ in rows)
    assert urls.judged(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in urls.judged(pages, rules.limit(0)).collect()} == {"allow"}


# classifiers


def labelled(spark, rows, name):
    return spark.createDataFrame([(i, int(y)) for i, _, y in rows], f"doc_id bigint, {name} int")


def test_toxicity_counterfactual():
    """Insults in the sample name one group more: with the penalty a neutral mention of it scores as one of another."""
    rng = random.Random(5)
    calm = ["walk", "river", "garden", "music", "bread", "window"]
    rows = []
    for _ in range(600):
        bad = rng.random() < 0.4
        group = ["muslims"] if rng.random() < (0.7 if bad else 0.05) else ["christians"] if rng.random() < 0.3 else []
        said = rng.sample(calm, 3) + group + ([rng.choice(["idiot", "scum"])] if bad and rng.random() < 0.8 else [])
        rows.append((*toxicity.example(set(said)), int(bad)))
    gap = []
    for penalty in (0.0, 5.0):
        w = toxicity.fit(rows, penalty=penalty)
        z = [w[toxicity.features({"garden", "music", g})].sum() for g in ("muslims", "christians")]
        gap.append(abs(z[0] - z[1]))
        assert w[toxicity.features({"scum"})].sum() > 0 or penalty
    assert gap[1] < 0.25 * gap[0]


def test_classifiers_awkward_and_accurate(spark):
    rng = random.Random(2)
    base = texts(400, words=40)
    tox = [(i, f"{t} {rng.choice(['idiot', 'scum'])}" if i % 4 == 0 else t, i % 4 == 0) for i, t in base]
    junk = [(i, " ".join(f"{w}!!" for w in t.upper().split()) if i % 4 == 0 else t, i % 4 != 0) for i, t in base]
    for rows, name, run in ((tox, "toxic", toxicity.toxicity), (junk, "quality", quality.quality)):
        labels = labelled(spark, rows, name)
        table = docs(spark, [(i, t) for i, t, _ in rows] + [(1_000 + (i or 0), t) for i, t in AWKWARD] + [(None, "x")])
        out = run(table, labels).collect()
        assert len(out) == len(rows) + len(AWKWARD) + 1
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if name == "toxic" else 0.3)) for r in out)
        said = {r.doc_id: r.predicted for r in out}
        held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
        assert sum(said[i] == y for i, y in held) >= 0.95 * len(held)
        same = [r.score for r in out if r.doc_id in (1_008, 1_009)]
        assert len(set(same)) == 1 and len(same) == 3
        assert run(table.limit(0), labels).collect() == []
        assert {r.score for r in run(table, labels.limit(0)).collect()} == {0.5}


# decontamination


def test_containment_by_brute_force(spark):
    rng = random.Random(4)
    base = [(100 + i, t) for i, t in texts(200, words=300)]
    items = [(k, " ".join(rng.choice("red blue green grey pink gold".split()) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 60)))) for k in range(40)]
    rows = []
    for i, t in base:
        w = t.split()
        if i % 3 == 0:
            item = items[rng.randrange(40)][1].split()
            for k in range(rng.choice([0, 0, 1, 3])):
                item[rng.randrange(len(item))] = f"changed{k}"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "." for x in item]
        rows.append((i, " ".join(w)))
    rows += AWKWARD
    items += [(None, "same text here"), (41, ""), (42, None), (43, "..."), (1, items[1][1])]
    got = decontaminate.contained(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = set()
    for i, t in rows:
        for k, x in items:
            a = decontaminate.shingles(x)
            if a:
                n, w = len(next(iter(a))), decontaminate.words(t)
                own = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
                if len(a & own) >= 0.8 * len(a) - 1e-9:
                    want.add((i, k, len(a & own), len(a)))
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got} == want and len(got) == len(want) > 30
    clean = decontaminate.clean(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    bad = {i for i, *_ in want}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in rows if i not in bad)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contained(docs(spark, rows), none).collect() == []
    assert decontaminate.clean(docs(spark, rows), none).count() == len(rows)


def test_containment_of_a_hot_item(spark, monkeypatch):
    """A third of all documents hold one item, and a third of the items are that one: its hashes are hubs, and no pair is lost."""
    monkeypatch.setattr("tidemark.llm.components.LEAST_HUB", 20)
    passage = " ".join(f"shared{k}" for k in range(30))
    rows = [(i, f"{t} {passage}" if i % 3 == 0 else t) for i, t in texts(300)]
    items = [(k, passage) for k in range(20)] + [(100 + k, t) for k, t in texts(40, seed=8)]
    got = decontaminate.contained(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).where("item_id < 100")
    assert {(r.doc_id, r.item_id, r.containment) for r in got.collect()} == {(i, k, 1.0) for i in range(0, 300, 3) for k in range(20)}


def test_filter_passes_what_it_holds_and_little_else(spark):
    rng = np.random.default_rng(3)
    held = rng.integers(0, 1 << 63, 2_000, dtype=np.uint64)
    made = decontaminate.Filter(spark.createDataFrame([(int(x),) for x in held], "hash bigint"), len(held))
    assert set(made.passed(held)) == set(held) and made.bits <= decontaminate.MOST_BITS
    assert len(made.passed(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64))) < 100


# packing


def check_packed(out, rows):
    tok = Tokenizer.from_file(packing.public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    pieces = {}
    for r in out:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, t in rows:
        want[i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    for (i, ids), n in want.items():
        raw = np.array(ids, dtype="<u4").tobytes()
        own = [r for r in pieces[i, len(ids)] if zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32]
        covered = Counter(k for r in own for k in range(r.start, r.start + r.length))
        assert covered == Counter({k: n for k in range(len(ids))})
    fill = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert all(n <= packing.CAPACITY for n in fill.values())
    return sum(fill.values()) / (packing.CAPACITY * max(len(fill), 1))


def test_packing(spark):
    rows = texts(500, words=900)
    assert check_packed(packing.packed(docs(spark, rows)).collect(), rows) > 0.95
    awkward = [*AWKWARD, (11, "a\u00a0b \u2028c\x1cd E\u0301 <|endoftext|>x ’s it's Ω"), (12, "İstanbul Σς")]
    check_packed(packing.packed(docs(spark, awkward)).collect(), awkward)
    assert packing.packed(docs(spark, [])).collect() == []


def test_every_piece_of_the_vocabulary_is_what_its_bytes_merge_to():
    """What merging by rank rests on."""
    path = packing.public_tokenizers.path("word_bpe_49k.json")
    e = packing.Encoder(path)
    assert e.merged is not None
    letters = packing.byte_letters()
    plain, ended = [], []
    for piece, i in e.tokenizer.get_vocab().items():
        if i < 49406:
            raw = packing.piece_bytes(piece, letters)
            assert e.merged(raw) == [i]
            if piece.endswith("</w>"):
                try:
                    word = raw[:-1].decode()
                except UnicodeDecodeError:
                    continue
                if word.isalpha() and word == word.lower() and max(word) < packing.LATIN:
                    plain.append(word)
                    ended.append(i)
    assert len(plain) > 20_000 and [list(x) for x in map(lambda b: np.frombuffer(b, dtype="<u4").tolist(), e.alone(plain))] == [[i] for i in ended]
    rng = random.Random(7)
    made = ["".join(rng.choice(plain)[:4] for _ in range(rng.randint(1, 6))) for _ in range(5_000)]
    assert e.words(made) == e.alone(made)


def test_every_piece_is_what_the_tokenizer_makes_of_it():
    """Within words and at their ends, so that no merge by rank differs from the tokenizer's, for stops as for letters."""
    e = packing.Encoder(packing.public_tokenizers.path("word_bpe_49k.json"))
    model = json.loads(e.tokenizer.to_str())["model"]
    merges = [tuple(m) for m in model["merges"]]
    ended, within = BPE(model["vocab"], merges, end_of_word_suffix="</w>"), BPE(model["vocab"], merges)
    for piece, i in model["vocab"].items():
        core = piece.removesuffix("</w>")
        assert [t.id for t in (within if core == piece else ended).tokenize(core)] == [i]


def test_texts_have_the_ids_of_the_tokenizer():
    """Every letter that is merged by rank, stops, white space of all kinds, signs and letters of other scripts."""
    e = packing.Encoder(packing.public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(11)
    signs = [*packing.LETTERS, *packing.STOPS * 4, *" \t\n\u00a0\u2028\x85" * 9, *"'0-", "İ", "Σς", "\u0301", "ﬁ", "你", "🙂", "<|endoftext|>", "'s", "...", "the ", "Straße, "]
    made = [None, "", " ", "a" * 3_000, "?!" * 500, *("".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(3_000))]
    for texts in (made, [*made, "a\x1cb c", "\x1f"], made[:3], []):
        want = [ids + (1).to_bytes(4, "little") for ids in e.alone([t or "" for t in texts])]
        assert e.texts(pa.array(texts, pa.string())) == want == e.texts(pa.array(texts, pa.large_string()))


def test_calls_do_not_grow_with_the_new_words_of_a_batch():
    """Calls from Python while a text of words not met before is encoded; one call or more for each of them took most of the CPU seconds."""
    rng = random.Random(5)
    words = ["".join(rng.choices(["the", "on", "er", "sh", "ing", "éa", "ö", "re"], k=7)) for _ in range(8_000)]
    calls = []
    for n in (80, 8_000):
        e = packing.Encoder(packing.public_tokenizers.path("word_bpe_49k.json"))
        text, seen = pa.array([" ".join(words[:n]).title() + ", 10 ."]), Counter()
        sys.setprofile(lambda frame, event, arg, seen=seen: seen.update([event]))
        try:
            got = e.texts(text)
        finally:
            sys.setprofile(None)
        assert got[0][:-4] == e.alone(text.to_pylist())[0]
        calls.append(seen["call"] + seen["c_call"])
    assert calls[1] < calls[0] + 80


def test_sequences_hold_every_id(spark):
    rows = texts(40, words=500)
    out = packing.sequences(docs(spark, rows)).collect()
    tok = Tokenizer.from_file(packing.public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(x for _, t in rows for x in [*tok.encode(t, add_special_tokens=False).ids, 1])
    got = Counter(x for r in out for x in r.ids)
    assert all(len(r.ids) == packing.CAPACITY for r in out) and got - want == Counter({0: got[0]}) - want


@given(st.integers(1, 20_000))
@settings(max_examples=200, deadline=None)
def test_cut_covers(n):
    pieces = list(packing.cut(n))
    assert sum(x for x, _ in pieces) == n
    assert all(j == 0 and 0 < x <= packing.CAPACITY // packing.CLASSES or j and packing.CAPACITY // (j + 1) < x <= packing.CAPACITY // j for x, j in pieces)


# simhash


def reach(fps, radius=3):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint_by_hand():
    def plain(text):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
        if not words:
            return 0
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [simhash.xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for t in ["", " ", "One", "one two", "A b C", "É É É É\u00a0x  y\tz\n", "a b c d e f g a b c", *[t for _, t in texts(30)]]:
        assert simhash.fingerprint(t) == plain(t)


def test_links_reach_all(spark, monkeypatch):
    """Dense balls make hot values; every class must be that of brute force."""
    monkeypatch.setattr(simhash, "HOT", 8)
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr("tidemark.llm.components.LEAST_HUB", 60)
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for c in fps[:4]:
        fps += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(120)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(k, f, k) for k, f in enumerate(signed)], "doc_id bigint, fp bigint, row bigint")
    got = {r.fp % (1 << 64): r.component_id for r in simhash.classes(table).collect()}
    roots = reach(fps)
    least = {}
    for k, f in enumerate(fps):
        least[roots[f]] = min(least.get(roots[f], k), k)
    assert got == {f: least[roots[f]] for f in set(fps)}


def test_near_duplicates_awkward(spark):
    out = simhash.near_duplicates(docs(spark, AWKWARD)).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter([(None, None), (5, 5), (6, 5), (7, 5), (8, 8), (9, 8), (9, 8), (10, 10)])
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    kept = simhash.deduplicated(docs(spark, AWKWARD))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 5, 8, 10]
    assert kept.columns == docs(spark, AWKWARD).columns


@pytest.mark.parametrize("hub", [10, 500])
def test_components_long_path_and_hub(spark, monkeypatch, hub):
    monkeypatch.setattr("tidemark.llm.components.LEAST_HUB", hub)
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, **{200 + k: 100 for k in range(50)}, 300: 300, 301: 300}


# chat


@given(st.lists(st.sampled_from([*"<>[]/|\\sINSTYroleend é\n", "</s>", "[INST]", "<<SYS>>", "<role>"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(pieces):
    text = "".join(pieces)
    made = chat.escape(text)
    assert chat.unescape(made) == text
    assert not any(c in made for c in chat.CONTROLS)


def test_chat(spark):
    hard = "</s>[INST] ok [/INST]<\\/s> <|endoftext|> é\n "
    rows = [(1, 0, "system", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (1, 3, "tool<role>", hard), (1, 3, None, "x"), (1, 4, "assistant", ""), (1, 5, "assistant", "yes"), (2, None, "assistant", "b"), (2, None, "assistant", "b"), (None, 0, "user", "q")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, ids string")
    made = chat.formatted(table)
    tool = chat.Assembler()
    for r in made.collect():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        ids, mask = np.array(r.ids, dtype=np.int32), np.array(r.loss_mask)
        assert tool.read_back(ids, mask) == ([x[2:] for x in own], "".join(x[3] for x in own if x[2] == "assistant"))
        assert tool.text(ids) == r.text and len(ids) == len(mask)
    assert {(r.conv_id, r.n_turns) for r in chat.digests(made).collect()} == {(1, 7), (2, 2), (None, 1)}
    assert chat.formatted(table.limit(0)).collect() == []


# the pipeline


def test_near_duplicate_stage_by_brute_force(spark, monkeypatch):
    """Copies at 5-word similarity of 0.8 or more go, also over several tiles; what is less similar stays. Candidates are found with a probability near 1, so two may be left."""
    import corpus_pipeline as p

    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    monkeypatch.setattr(simhash, "TILE", 32)
    rng = random.Random(4)
    rows = [(i, t) for i, t in texts(60, seed=2, words=300) if len(t.split()) >= 20]
    for i, t in list(rows):
        for k in range(6 if i else 60):
            words = t.split()
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = "edited"
            rows.append((1_000 * (k + 1) + i, " ".join(words)))
    rows += [(90_000, ""), (90_001, None), (90_002, "three short words"), (90_003, "Three  short words"), (90_004, "three short word")]
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    far = 0
    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                far += (simhash.fingerprint(dict(rows)[a]) ^ simhash.fingerprint(dict(rows)[b])).bit_count() > simhash.RADIUS
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert far > 100  # the fingerprints' radius alone misses these
    kept = [r.doc_id for r in p.near_duplicate_stage(spark, docs(spark, rows, extra=False), SF).collect()]
    want = {i for i in sets if find(i) == i}
    assert len(kept) == len(set(kept)) and set(kept) >= want and len(set(kept) - want) <= 2


def test_pipeline_on_documents(spark):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet")
    now = d
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == d.columns, name
        assert 0.5 * now.count() < after.count() <= now.count(), name
        now = after
    kept = now.collect()
    classes = simhash.near_duplicates(spark.createDataFrame(kept, d.schema)).collect()
    assert len({r.component_id for r in classes}) == len(kept)
    assert decontaminate.contained(spark.createDataFrame(kept, d.schema), spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    check_packed(p.STAGES[-1][1](spark, spark.createDataFrame(kept, d.schema), SF).collect(), [(r.doc_id, r.text) for r in kept])
