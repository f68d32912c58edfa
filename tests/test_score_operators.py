"""Literal vectors, numpy re-derivations and invariants for the score operators."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import backends
from tidemark.functions import ordinal as O, prompts as P, text as X
from tidemark.operators import balance, clips as C, diagnostics as D, frames as R, fusion as U, metrics as M, quality as Q, sampling as S, smoothing as G
from tidemark.plans import queries as plans, runs as N
from tidemark.sources import readers, writers
from tidemark.streaming import incremental


def arrays(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "i int, a array<double>")


def stack_pava(v):
    out = []
    for x in v:
        out.append([x, 1])
        while len(out) > 1 and out[-2][0] < out[-1][0]:
            b, a = out.pop(), out.pop()
            out.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    return [m for m, n in out for _ in range(n)]


def test_pava_vectors_and_random(spark):
    rng = random.Random(1)
    rows = [[0.9, 0.5, 0.7, 0.2], [1.0], *[[rng.random() for _ in range(10)] for _ in range(50)]]
    got = [r.g for r in arrays(spark, rows).select("i", O.pava("a").alias("g")).orderBy("i").collect()]
    assert got[0] == pytest.approx([0.9, 0.6, 0.6, 0.2])
    for v, g in zip(rows, got, strict=True):
        assert g == pytest.approx(stack_pava(v)) and sum(g) == pytest.approx(sum(v)) and all(a >= b - 1e-12 for a, b in zip(g, g[1:]))


def test_tail_score_vectors(spark):
    rows = [[1.0 - k / 10 for k in range(10)], [1.2, 0.7, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, -0.2]]
    got = arrays(spark, rows).select("i", O.tail_score("a").alias("s"), O.violations(O.clipped("a")).alias("v"), O.pava(O.clipped("a")).alias("g")).orderBy("i").collect()
    assert got[0].s == pytest.approx(0.55) and got[0].v == 0
    assert got[1].v == 1 and got[1].g == pytest.approx([1, 0.75, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0])


def test_flat_margins_and_expectation(spark):
    want = [-2 + 0.7 * i for i in range(11)]
    raw = [x for m in want for x in ((m + 3.0, 0.0), (3.0, m))]  # a bias of 3 towards the first option cancels
    df = spark.createDataFrame([([(float(a), float(b)) for a, b in raw],)], "raw array<struct<a:double,b:double>>")
    got = df.select(O.flat_margins("raw").alias("m"), O.expectation(O.flat_margins("raw")).alias("s")).first()
    assert got.m == pytest.approx(want)
    w = np.exp(np.array(want) - max(want))
    assert got.s == pytest.approx(float((w / w.sum()) @ (np.arange(11) / 10)))
    for peak in (0, 5, 10):
        assert arrays(spark, [[1000.0 if k == peak else -1000.0 for k in range(11)]]).select(O.expectation("a")).first()[0] == pytest.approx(peak / 10)
    assert arrays(spark, [[2.0] * 11]).select(O.expectation("a")).first()[0] == pytest.approx(0.5)


def test_entropies(spark):
    got = arrays(spark, [[0.5] * 10, [0.0] * 10, [1 - k / 11 for k in range(1, 11)]]).select(O.binary_entropy("a").alias("b"), O.ordinal_entropy("a").alias("o")).collect()
    assert got[0].b == pytest.approx(1) and got[1].o == pytest.approx(0) and got[2].o == pytest.approx(1)


def series(spark, lengths, seed=3, fps=10):
    rng = np.random.default_rng(seed)
    rows = [(f"v{n}", k, 16 * k, fps, float(x)) for n in lengths for k, x in enumerate(rng.random(n))]
    return spark.createDataFrame(rows, "video_id string, clip_idx int, center_frame bigint, fps bigint, score double")


def by_video(df):
    out = {}
    for r in df.orderBy("video_id", "clip_idx").collect():
        out.setdefault(r.video_id, []).append(r.score)
    return out


@pytest.mark.parametrize("sigma", [0.0, 2.0, 10.0])
def test_gaussian_reflects(spark, sigma):
    c = series(spark, [1, 2, 3, 17, 41, 100])
    raw, got = by_video(c), by_video(G.gaussian(c, sigma))
    for v, x in raw.items():
        n, want = len(x), []
        for i in range(n):
            s = 0.0
            for o, w in G.gaussian_kernel(sigma) if sigma else [(0, 1.0)]:
                m = (i + o) % (2 * n)
                s += w * x[m if m < n else 2 * n - 1 - m]
            want.append(s)
        assert got[v] == pytest.approx(want)


def test_interpolation(spark):
    c = series(spark, [40]).withColumn("score", F.when(F.col("clip_idx").isin(3, 4, 11, 30), F.col("score")).otherwise(-1.0))
    known = c.where("score >= 0").orderBy("center_frame").collect()
    got = [r.score for r in G.interpolated(c, c).orderBy("center_frame").collect()]
    assert got == pytest.approx(np.interp([16 * k for k in range(40)], [r.center_frame for r in known], [r.score for r in known]).tolist())


def test_fusion_of_constant_and_adaptive_by_hand(spark):
    c = series(spark, [1, 30])
    flat = c.withColumn("score", F.lit(0.3))
    for f in (U.adjacent_mean, U.overlap_mean, lambda x: U.overlap_mean(x, logits=True), U.adaptive):
        assert all(r.score == pytest.approx(0.3) for r in f(flat).collect())
    got, raw = by_video(U.adaptive(c))["v30"], by_video(c)["v30"]
    lg = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))

    def median(v, w):
        order = sorted(range(len(v)), key=lambda k: (v[k], k))
        cum = 0.0
        for k in order:
            cum += w[k]
            if cum >= sum(w) / 2 - 1e-12:
                return v[k]

    for i, s in enumerate(raw):
        js = [j for j in range(30) if abs(1.6 * (j - i)) <= 5 + 1e-6]
        w = [max(0.0, 1 - abs(1.6 * (j - i)) / 5) for j in js]
        v = [raw[j] for j in js]
        m = median(v, w)
        scale = 1.4826 * median([abs(x - m) for x in v], w)
        z = [wk * math.exp(-0.5 * ((x - s) / scale) ** 2) * (abs(2 * x - 1) + 1e-6) for wk, x in zip(w, v, strict=True)]
        u = 4 * s * (1 - s)
        t = (1 - u) * lg(s) + u * sum(a * lg(x) for a, x in zip(z, v, strict=True)) / sum(z)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-t)))


def index(spark, rows):
    return spark.createDataFrame(rows, "video_id string, start_frame bigint, end_frame bigint")


def frame_metrics(labels, scores):
    order = sorted(set(scores), reverse=True)
    p, n = sum(labels), len(labels) - sum(labels)
    tp = fp = area = pr = 0
    before, best = 1.0, (0, 0)
    for s in order:
        a = sum(1 for y, x in zip(labels, scores, strict=True) if x == s and y)
        b = sum(1 for y, x in zip(labels, scores, strict=True) if x == s and not y)
        area += b * (2 * tp + a) / 2
        tp, fp = tp + a, fp + b
        prec = tp / (tp + fp)
        pr += a / p * (prec + before) / 2
        before = prec
        best = max(best, (2 * prec * (tp / p) / (prec + tp / p + 1e-8), -s))
    return area / p / n, pr, best[0], -best[1]


def test_weighted_rows_equal_frames(spark):
    c = series(spark, [5, 8, 12]).withColumn("score", F.round("score", 1))
    idx = index(spark, [("v5", 0, 70), ("v8", 7, 7 + 140), ("v12", 100, 100 + 150)])
    ivs = spark.createDataFrame([("v5", 0, 3, 20, 1), ("v5", 1, 15, 40, 1), ("v5", 2, 41, 44, 1), ("v8", 0, 0, 30, 1), ("v12", 0, 120, 120, 1), ("v12", 1, 240, 999, 1)], "video_id string, ordinal int, start bigint, stop bigint, label int")
    frames = R.labelled(R.expanded(c, idx), idx, ivs).collect()
    assert len(frames) == 71 + 141 + 151
    want = frame_metrics([r.label for r in frames], [r.score for r in frames])
    got = M.ranking_metrics(M.curve(R.weighted_rows(c, idx, ivs))).first()
    assert (got.roc_auc, got.pr_auc, got.max_f1, got.f1_threshold) == pytest.approx(want)
    assert got.positives + got.negatives == len(frames)
    up = M.ranking_metrics(M.curve(R.weighted_rows(c.withColumn("score", F.exp("score")), idx, ivs).withColumn("score", F.when(F.col("clip_idx") < 0, 1.0).otherwise(F.col("score"))))).first()
    assert up.roc_auc == pytest.approx(got.roc_auc)


def test_interval_policies(spark):
    idx = index(spark, [("v1", 10, 40)])
    frames = spark.createDataFrame([("v1", k) for k in range(31)], "video_id string, frame bigint")
    ivs = spark.createDataFrame([("v1", 0, 15, 25, 1), ("v1", 1, 20, 30, 2)], "video_id string, ordinal int, start bigint, stop bigint, label int")
    for policy, inner in (("first", 1), ("last", 2)):
        got = {r.frame + 10: r.label for r in R.labelled(frames, idx, ivs, policy).collect()}
        assert [got[k] for k in (14, 15, 19, 20, 25, 26, 30, 31)] == [0, 1, 1, inner, inner, 2, 2, 0]


def test_expansion_of_the_literal_case(spark):
    maps = spark.createDataFrame([("demo.json", '{"32": 0.3, "0": 0.1, "16": 0.2}'), ("bad.json", "{"), ("none.json", "[1]")], "name string, value string")
    rows = readers.score_map(maps)
    assert {(r.video_id, r.center_frame, r.score) for r in rows.collect()} == {("demo", 0, 0.1), ("demo", 16, 0.2), ("demo", 32, 0.3)}
    c = rows.withColumn("clip_idx", (F.col("center_frame") / 16).cast("int"))
    got = R.expanded(c, index(spark, [("demo", 0, 6)]), 2).orderBy("frame").collect()
    assert [r.score for r in got] == [0.1, 0.1, 0.2, 0.2, 0.3, 0.3, 0.0]
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        readers.score_map(maps, strict=True).collect()


def test_windows_literal(spark):
    w = C.clip_windows(spark.createDataFrame([("v", 10.0, 101)], "video_id string, fps double, frame_count bigint"), 20, 4.0).orderBy("clip_idx").collect()
    assert [r.center_frame for r in w] == list(range(0, 101, 20))
    assert (w[0].start_time, w[0].end_time) == (0.0, 2.0) and (w[-1].start_time, w[-1].end_time) == pytest.approx((8.0, 10.1))


def test_names_and_scores(spark):
    t = spark.createDataFrame([("a/b.c.mp4",), ("x.y",), ("n.MKV",)], "t string")
    assert [r[0] for r in t.select(X.stem(F.col("t"))).collect()] == ["b.c", "x.y", "n"]
    said = [("[1e-1]", 0.1, None), (".5", 0.5, None), ("[2]", 1.0, "clipped"), ("[nan]", 0.5, "no score"), ("score 0.7", 0.5, "no score"), ("[-1] [0.3]", 0.0, "clipped"), (None, 0.5, "no score"), ("[1e999]", 0.5, "no score")]
    df = spark.createDataFrame([(k, s) for k, (s, _, _) in enumerate(said)], "k int, t string")
    score, error = X.parsed_score(F.col("t"))
    assert [(r.s, r.e) for r in df.select("k", score.alias("s"), error.alias("e")).orderBy("k").collect()] == [(s, e) for _, s, e in said]


def test_overlap_and_nearest(spark):
    rows = [("v", 0, 0.2, 10, 60), ("v", 40, 0.6, 10, 60)]
    c = spark.createDataFrame(rows, "video_id string, center_frame bigint, score double, fps bigint, frame_count bigint")
    got = {r.frame: (r.mean, r["max"], r.top3) for r in R.overlap_projection(c, 2.0).collect()}
    assert len(got) == 60
    for f in range(60):
        cover = [s for _, x, s, _, _ in rows if abs(x - f) <= 10]
        want = sum(cover) / len(cover) if cover else (0.2 if f <= 20 else 0.6)
        assert got[f][0] == pytest.approx(want)


def test_budget_band_and_ranks(spark):
    rng = random.Random(2)
    rows = [("v", k, round(rng.random(), 1), int(rng.random() < 0.3)) for k in range(57)]
    df = spark.createDataFrame(rows, "video_id string, center_frame bigint, score double, hit int")
    got = C.top_budget(df, [0.01, 0.1, 0.5, 1.0], "score", "hit", "center_frame").collect()
    for r in got:
        n = max(1, math.ceil(57 * r.budget))
        top = sorted(rows, key=lambda x: (-x[2], x[1]))[:n]
        assert (r.audited_clips, r.covered_fn_clips) == (n, sum(x[3] for x in top))
    kept = C.percentile_band(df, 0.5, 0.5).collect()
    assert [r.center_frame for r in kept] == [sorted(rows, key=lambda x: (x[2], x[1]))[28][1]]
    ranks = {r.center_frame: r.p for r in D.percentile_rank(df, "score", "p").collect()}
    for _, k, s, _ in rows:
        below, same = sum(x[2] < s for x in rows), sum(x[2] == s for x in rows)
        assert ranks[k] == pytest.approx((below + (same - 1) / 2) / 56)
    rho = M.spearman(df, "score", "hit").first().rho
    a, b = (np.array([sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]) for v in ([x[2] for x in rows], [x[3] for x in rows]))
    assert rho == pytest.approx(float(np.corrcoef(a, b)[0, 1]))


def test_percentile_band_ends_where_the_sql_ends(spark, tmp_path):
    """Videos whose 0.55 n is whole, but over that as a double (100, 180, 220), and one with percentiles whose decimals end in a 5 at the seventh place (641)."""
    import duckdb

    rng = random.Random(6)
    users = [n for n in (1, 2, 20, 99, 100, 180, 220, 641) for _ in range(n)]
    rng.shuffle(users)
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=k // 3), n, "view", round(rng.random() * 300, 1)) for k, n in enumerate(users)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(plans.ORACLE_SQL["percentile_band"]).fetchall()
    got = sorted(map(tuple, plans.percentile_band(spark, str(tmp_path)).collect()))
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want)] and got == sorted(want)
    ranks = {n: sorted(r for v, _, _, r, _ in got if v == n) for n in users}
    assert ranks[100] == list(range(30, 55)) and ranks[180] == list(range(54, 99)) and ranks[1] == [0]


def test_one_class_and_empty(spark):
    one = spark.createDataFrame([(0.1, 1, 0), (0.2, 1, 0)], "score double, pos int, neg int")
    assert math.isnan(M.ranking_metrics(M.curve(one)).first().roc_auc)
    assert M.curve(one.limit(0)).collect() == []
    work = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "name string, work bigint")
    assert sorted(map(tuple, balance.balanced_jobs(work, 2).collect())) == [("a", 5, 0), ("b", 3, 1), ("c", 3, 1), ("d", 1, 0)]


def test_extremes(spark):
    c = series(spark, [30, 120])
    for r in C.extreme_intervals(c).collect():
        x = by_video(c)[r.video_id]
        w = max(16 * (len(x) - 1) // 10, 300)
        avg = [np.mean([x[j] for j in range(i, len(x)) if 16 * j < 16 * i + w]) for i in range(len(x))]
        assert (r.highest_avg, r.lowest_avg) == pytest.approx((max(avg), min(avg)))
        assert r.highest_start == 16 * int(np.argmax(np.round(avg, 9))) and r.lowest_end == 16 * int(np.argmin(np.round(avg, 9))) + w


def test_dense_pick(spark):
    rows = [(0, [k * 0.5 for k in range(21)], 5.0, 4.0, 6.0), (1, [1.0], 1.0, 0.0, 2.0), (2, [], 1.0, 0.0, 2.0)]
    picked = {r.key: r.indices for r in S.dense_selected(spark.createDataFrame(rows, "key bigint, times array<double>, center double, start double, end double")).collect()}
    got = picked[0]
    assert len(got) == 10 and sorted(got) == got and {0, 20} <= set(got)
    assert picked[1] == [0] * 10 and picked[2] == []


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "index.txt").write_text("set/a.mp4 0 47 1\n\nb.c 5 9 1,2\n")
    (tmp_path / "notes.txt").write_text("a.mp4 Event 1 2 -1 -1\na.mp4 Event 16 31 40 44\nb.c E 5 6 7 8\n")
    idx = readers.read_index(spark, str(tmp_path / "index.txt"))
    assert {(r.video_id, r.start_frame, r.end_frame, tuple(r.labels)) for r in idx.collect()} == {("a", 0, 47, (1,)), ("b.c", 5, 9, (1, 2))}
    notes = readers.with_labels(readers.read_annotations(spark, str(tmp_path / "notes.txt")), idx)
    assert {(r.video_id, r.ordinal, r.start, r.stop, r.label) for r in notes.collect()} == {("a", 0, 16, 31, 1), ("a", 1, 40, 44, 1), ("b.c", 0, 5, 6, 1), ("b.c", 1, 7, 8, 2)}
    c = series(spark, [3, 4]).select("video_id", "center_frame", "score")
    writers.write_score_maps(c, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).select("video_id", F.from_json("value", "map<string,double>").alias("m"))
    assert {(r.video_id, int(k), v) for r in back.collect() for k, v in r.m.items()} == {(r.video_id, r.center_frame, r.score) for r in c.collect()}
    folder = tmp_path / "maps" / "deep"
    folder.mkdir(parents=True)
    (folder / "x.y.json").write_text(json.dumps({"0": 0.5}))
    (folder / "_skip.json").write_text(json.dumps({"0": 0.1}))
    assert [(r.video_id, r.score) for r in readers.read_scores(spark, str(tmp_path / "maps")).collect()] == [("x.y", 0.5)]
    assert writers.markdown(c.orderBy("video_id", "center_frame").limit(1)).count("\n") == 3
    saved = writers.check_manifest(None, {"a": 1})
    writers.check_manifest(saved, {"a": 1})
    with pytest.raises(ValueError):
        writers.check_manifest(saved, {"a": 2})


def test_resume_after_failures(spark, tmp_path):
    known = {("v", 16 * k): k / 10 for k in range(4)}
    clips = spark.createDataFrame([("v", 16 * k) for k in range(5)], "video_id string, center_frame bigint")
    out = str(tmp_path / "run")
    assert incremental.score_pending(clips, out, "lookup", scores={k: v for k, v in known.items() if k[1] < 32}) == (2, 3)
    assert incremental.score_pending(clips, out, "lookup", scores=known) == (2, 1)
    assert incremental.score_pending(clips, out, "lookup", scores=known) == (0, 1)
    got = {(r.video_id, r.center_frame): r.score for r in incremental.scores(spark, out).collect()}
    assert got == known | {("v", 64): 0.5}  # a failure keeps the default score, and its error until it succeeds
    assert [(r.center_frame, r.error.split(":")[0]) for r in incremental.errors(spark, out).collect()] == [(64, "KeyError")]
    assert incremental.score_pending(clips, out, "lookup", scores=known | {("v", 64): 0.9}) == (1, 0)
    assert incremental.errors(spark, out).count() == 0 and incremental.results(spark, out).count() == 10
    assert N.claim(spark, out)
    with pytest.raises(RuntimeError):
        incremental.score_pending(clips, out, "lookup", scores=known)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "results").write_text("no table")
    with pytest.raises(Exception):  # noqa: B017  whatever Spark says of it: a fault of the storage is not "nothing yet"
        incremental.score_pending(clips, str(tmp_path / "broken"), "lookup", scores=known)
    with pytest.raises(ValueError):
        backends.resolve("none")


def test_stream_scores_each_clip_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    known = {("v", k): 0.5 for k in range(6)}
    for part in (range(3), range(2, 6)):
        spark.createDataFrame([("v", k) for k in part], "video_id string, center_frame bigint").write.mode("append").parquet(source)
        incremental.score_stream(spark, source, "video_id string, center_frame bigint", out, "lookup", scores=known)
    assert incremental.scores(spark, out).count() == incremental.results(spark, out).count() == 6


def test_completeness(spark):
    keys = spark.createDataFrame([("a", 0), ("a", 16), ("b", 0)], "video_id string, center_frame bigint")
    actual = spark.createDataFrame([("a", 0, 0.1), ("a", 16, 0.2), ("b", 0, None)], "video_id string, center_frame bigint, score double")
    assert {r.video_id: r.complete for r in Q.completeness(keys, actual).collect()} == {"a": True, "b": False}


def test_prompts_and_runs(spark, tmp_path):
    with pytest.raises(ValueError):
        P.checked("no slot")
    c = N.RunConfig.from_lines(["export SIGMA='5'", "INTERVAL=8", "# x", "ROOT=/a b"])
    assert (c.sigma, c.interval, c.other) == (5.0, 8, {"ROOT": "/a b"})
    folder = f"file://{tmp_path}"
    held = N.claim(spark, folder)
    assert held and not N.claim(spark, folder)
    N.release(spark, held)
    assert N.claim(spark, folder)
    with pytest.raises(ValueError):
        U.fuse(series(spark, [2]), "none")
    assert U.fuse(series(spark, [2]), "adjacent_mean").count() == 2


def test_resamples(spark):
    v = spark.createDataFrame([(f"v{k}",) for k in range(30)], "video_id string")
    d = M.resamples(v, 20)
    got = d.groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert len(got) == 20 and all(r.n == 30 for r in got)
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, M.resamples(v, 20).collect()))


def test_flat_score_refuses_what_is_not_flat(spark):
    from tidemark.functions import ordinal as O

    def raw(rows):
        return spark.createDataFrame([(rows,)], "raw array<struct<a:double,b:double>>").select(O.flat_expectation("raw").alias("s"))

    fine = [(0.1 * k, 0.0) for k in range(22)]
    assert 0 <= raw(fine).first().s <= 1
    for bad in (fine[:20], [*fine[:21], (float("nan"), 0.0)], [*fine[:21], (None, 0.0)], [*fine[:21], (float("inf"), 0.0)]):
        with pytest.raises(Exception, match="22 rows"):
            raw(bad).collect()
    with pytest.raises(ValueError):
        O.flat_expectation("raw", 2.0)


def test_ordered_scores(spark):
    rows = spark.createDataFrame([("v", 0, 0, 0.5), ("v", 1, 16, 1.0)], "video_id string, clip_idx int, center_frame bigint, score double")
    assert Q.ordered_scores(rows, "clip_idx").count() == 2
    for bad in (("v", 2, 16, 0.5), ("v", 2, 32, 1.1), ("v", 2, 32, float("inf")), ("v", 2, 32, None)):
        with pytest.raises(ValueError):
            Q.ordered_scores(rows.union(spark.createDataFrame([bad], rows.schema)), "clip_idx")


def test_quantiles_and_ranks(spark):
    from tidemark.operators import diagnostics as D

    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=500), 2)
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(x)] + [(0, None)], "g int, v double")
    got = {r.g: r for r in M.quantiles(df, "v", {"low": 0.1, "mid": 0.5, "top": 1.0}, ["g"]).collect()}
    for g in range(3):
        assert np.allclose([got[g].low, got[g].mid, got[g].top], np.quantile(x[np.arange(500) % 3 == g], [0.1, 0.5, 1.0]))
    ranks = D.percentile_rank(spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,)], "v double"), "v", "p").collect()
    assert sorted(((r.v is None, r.p) for r in ranks), key=str) == sorted([(False, 0.25), (False, 0.25), (False, 1.0), (True, None)], key=str)


def test_names_of_videos_come_from_one_place(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for n in ("b.mp4", "deep/a.MKV", "deep/x.txt"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "index.txt").write_text("set/a.mp4 0 47 1\n")
    assert [r.video_id for r in readers.video_names(spark, folder=str(tmp_path)).collect()] == ["b", "a"]
    assert [r.video_id for r in readers.video_names(spark, index=str(tmp_path / "index.txt")).collect()] == ["a"]
    assert [r.video_id for r in readers.video_names(spark, names=["q/z.avi"]).collect()] == ["z"]
    for bad in ({}, {"folder": "x", "names": []}):
        with pytest.raises(ValueError):
            readers.video_names(spark, **bad)


def test_report_that_leaves_nothing_out(spark, tmp_path):
    assert writers.markdown(spark.range(3), most=3).count("\n") == 5
    with pytest.raises(ValueError):
        writers.markdown(spark.range(4), most=3)
    writers.write_metrics(spark.createDataFrame([(0.5, 2)], "auc double, n int"), str(tmp_path / "m"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == ["auc: 0.5", "n: 2"]
    writers.write_csv(spark.range(2), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_prompt_registry():
    assert len(P.PROMPTS) == 5 and P.prompt_spec("terse").question(0.25) == "Anomaly >= 0.2?"
    with pytest.raises(ValueError):
        P.prompt_spec("none")
    with pytest.raises(ValueError):
        P.PromptSpec("x", "s", "no slot")
