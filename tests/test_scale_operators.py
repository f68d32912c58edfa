"""Interval sweeps, merged states, bands, draws, balance, versions, sinks and checked look-ups, held to plain rewrites."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import balance, clips as C, diagnostics as D, frames as R, fusion as U, intervals as I, metrics as M, quality as Q, ranges, sampling as S, smoothing as G
from tidemark.sources import snapshots, storage
from tidemark.streaming.sink import BatchSink, run_available


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(4)
    rows = [("a", k, s := rng.randrange(0, 3000), s + rng.choice([-1, 0, 1, 5, 40, 700]), rng.randrange(1, 5)) for k in range(200)]
    rows += [("b", 0, 10, 2900, 1), ("b", 1, 10, 10, None), ("b", 2, 2901, 2905, 3), ("c", 0, -64, 65, 2)]
    return rows


def frame(spark, spans):
    return spark.createDataFrame(spans, "video_id string, ordinal bigint, start bigint, stop bigint, label int")


@pytest.mark.parametrize("bucket", [1 << 16, 64])
def test_labels_and_covers_across_buckets(spark, spans, bucket, monkeypatch):
    monkeypatch.setattr(I, "BUCKET", bucket)
    points = spark.createDataFrame([(v, t) for v in "abcd" for t in range(-70, 3000)], "video_id string, t bigint")
    ivs = frame(spark, spans)
    for policy, pick in (("first", min), ("last", max)):
        got = {(r.video_id, r.t): r.label for r in I.labelled(points, "t", ivs, policy).collect()}
        assert len(got) == 4 * 3070
        for v in "abcd":
            for t in range(-70, 3000):
                over = [(o, label) for n, o, a, z, label in spans if n == v and a <= t <= z]
                assert got[v, t] == (pick(over)[1] if over else None), (v, t)
    inside = {v: {t for n, _, a, z, _ in spans if n == v for t in range(a, z + 1)} for v in "abcd"}
    blocks = spark.createDataFrame([(v, a, a + w, f"{v}{a}") for v in "abcd" for a, w in ((-70, 7), (-63, 1), (-62, 900), (838, 3), (900, 2000), (5000, 10))], "video_id string, a bigint, z bigint, name string")
    for r in I.covered(blocks, ivs).collect():
        a = int(r.name[1:])
        n = {-70: 7, -63: 1, -62: 900, 838: 3, 900: 2000, 5000: 10}[a]
        assert (r.n, r.inside) == (n, len(inside[r.video_id] & set(range(a, a + n)))), r
    want = []
    for v in "abc":
        ts = sorted(inside[v])
        want += [(v, t, next(u for u in range(t, 10_000) if u + 1 not in inside[v])) for t in ts if t - 1 not in inside[v]]
    assert sorted(map(tuple, I.merged(ivs).collect())) == sorted(want)


def test_no_task_holds_a_video_of_many_intervals(spark, monkeypatch):
    """A hundred thousand overlapping intervals in one video: by buckets and nodes, not by pairs."""
    monkeypatch.setattr(I, "BUCKET", 1 << 12)
    n = 100_000
    ivs = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("ordinal"), (F.col("id") * 7 % n * 4).alias("start"), (F.col("id") * 7 % n * 4 + 5_000).alias("stop"), (F.col("id") % 9).cast("int").alias("label"))
    got = I.pieces(ivs).agg(F.count("*"), F.count("label")).first()
    assert got[0] > 100_000 and got[1] >= got[0] - 1
    points = spark.createDataFrame([("v", 200_000)], "video_id string, t bigint")
    over = [k for k in range(n) if k * 7 % n * 4 <= 200_000 <= k * 7 % n * 4 + 5_000]
    assert I.labelled(points, "t", ivs).first().label == min(over) % 9


@pytest.mark.parametrize("seconds", [0.01, 1.0, 4.0])
def test_projection(spark, seconds):
    rng = random.Random(1)
    rows = []
    for v, fps, n in (("a", 25.0, 400), ("b", 7.5, 130), ("c", 24.0, 60), ("d", 1.0, 1)):
        rows += [(v, c, rng.randrange(5) / 4, fps, n) for c in sorted(rng.sample(range(n), max(1, n // 13)))]
    rows.append(("a", rows[3][1], 0.9, 25.0, 400))  # two clips at one center
    got = {(r.video_id, r.frame): (r.mean, r["max"], r.top3) for r in R.overlap_projection(spark.createDataFrame(rows, "video_id string, center_frame bigint, score double, fps double, frame_count bigint"), seconds).collect()}
    assert len(got) == 400 + 130 + 60 + 1
    for (v, f), values in got.items():
        own = [r for r in rows if r[0] == v]
        over = sorted((r[2] for r in own if abs(r[1] - f) <= seconds * r[3] / 2 + 1e-9), reverse=True)
        if over:
            assert values == pytest.approx((sum(over) / len(over), over[0], sum(over[:3]) / len(over[:3])))
        else:
            near = min(abs(r[1] - f) for r in own)
            assert values[0] in [r[2] for r in own if abs(r[1] - f) == near]


@pytest.mark.parametrize("name", ["even", "times", "small", "prices", "lump", "signs"])
def test_bands_are_even_wherever_values_lie(spark, name, monkeypatch):
    n = 200_000
    k = F.col("id")
    x = {
        "even": k / 1e4, "times": F.lit(1.7e12) + k, "small": F.lit(1e-9) + k * 1e-15, "prices": F.exp(F.pmod(k * 7919, F.lit(n)) / 20_000.0),
        "lump": F.when(k % 2 == 0, F.lit(5e8) + k).otherwise(F.lit(1e3) + k * 1e-6), "signs": (k - 100_000) / 7.0,
    }[name]
    df = spark.range(n).select(x.alias("x"))
    monkeypatch.setattr(ranges, "LEAST", 100)
    sizes = [r.n for r in ranges.banded(df, "x", 64, "b").groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 64 and max(sizes) <= 2 * n / 64
    got = ranges.running(df.groupBy("x").agg(F.count("*").alias("n")), [], "x", {"n": "n"}, 64)
    assert got.where("all_n <> 200000").count() == 0
    assert {r.x: r.run_n for r in got.collect()} == {x: i for i, x in enumerate(sorted((r.x for r in df.collect()), reverse=True), 1)}


def test_odd_values_have_their_place(spark, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST", 1)
    odd = spark.createDataFrame([(None, 1), (float("nan"), 2), (1.0, 3), (1.0, 4), (-math.inf, 5), (math.inf, 6), (-0.0, 7), (5e-324, 8), (-1e308, 9), (1.7e308, 10)], "x double, k int")
    got = [r.k for r in sorted(ranges.numbered(odd, ["x", "k"]).collect(), key=lambda r: r.position)]
    assert got == [1, 5, 9, 7, 8, 3, 4, 10, 6, 2] and ranges.numbered(odd.limit(0), ["x"]).count() == 0


def test_numbers(spark, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST", 10)
    rng = random.Random(3)
    rows = [(rng.choice(["ab", "b", "ü", "", None, "abcdefgh1", "abcdefgh0"]), rng.randrange(40), k) for k in range(500)]
    df = spark.createDataFrame(rows, "s string, n bigint, k bigint")
    key = lambda *v: tuple((x is not None, x.encode() if isinstance(x, str) else x or 0) for x in v)
    got = {r.k: r.position for r in ranges.numbered(df, ["s", "n", "k"]).collect()}
    assert [got[r[2]] for r in sorted(rows, key=lambda r: key(*r))] == list(range(500))
    got = {r.k: r.position for r in ranges.numbered(df, ["k"], by=["n"]).collect()}
    for n in range(40):
        assert [got[r[2]] for r in rows if r[1] == n] == list(range(sum(r[1] == n for r in rows)))
    jobs = C.job_contiguous(df.select("k"), 7, ["k"]).collect()
    assert [r.job for r in sorted(jobs, key=lambda r: r.k)] == [j for j in range(7) for _ in range(500 // 7 + (j < 500 % 7))]


def test_quantiles_of_large_values(spark, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST", 10)
    values = [1.7e12 + (k * 7919 % 5003) for k in range(5003)] + [None, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = M.quantiles(df, "v", {f"q{k}": k / 20 for k in range(21)}).first()
    plain = np.quantile([v for v in values if v is not None], [k / 20 for k in range(21)])
    assert [got[f"q{k}"] for k in range(21)] == pytest.approx(plain.tolist(), abs=1e-3)


def test_draws_are_one_multinomial(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 8)
    videos = spark.range(300).select(F.concat(F.lit("v"), "id").alias("video_id"))
    rows = M.resamples(videos, 40).collect()
    per = Counter()
    for r in rows:
        per[r.rep] += r.times
    assert set(per.values()) == {300} and len(per) == 40
    times = Counter(r.times for r in rows)
    assert times[1] / 12_000 == pytest.approx(math.exp(-1), abs=0.03) and times[2] / 12_000 == pytest.approx(math.exp(-1) / 2, abs=0.03)
    counts = [0, 5, 5, 40, 41, 100]
    assert sum(M.shares_of_draws(counts, k, 1000, 1, 1) for k in range(5)) == 1000 and M.shares_of_draws(counts, 1, 1000, 1, 1) == 0
    mean = np.mean([M.shares_of_draws(counts, 2, 100, 1, rep) for rep in range(400)])
    assert mean == pytest.approx(35, abs=1.5)


def test_all_kernels_at_once_are_each_alone(spark):
    rng = random.Random(2)
    clips = spark.createDataFrame([(v, k, rng.random()) for v, n in (("a", 100), ("b", 3), ("c", 1)) for k in range(n)], "video_id string, clip_idx bigint, score double")
    both = {(r.video_id, r.clip_idx): r.smoothed for r in G.gaussians(clips, [0.0, 1.0, 6.0]).collect()}
    for i, sigma in enumerate((0.0, 1.0, 6.0)):
        for r in G.gaussian(clips, sigma).collect():
            assert both[r.video_id, r.clip_idx][i] == pytest.approx(r.score)


def test_balance_is_longest_first(spark):
    rng = random.Random(6)
    items = [(f"v{k}", rng.choice([0, 1, 1, 2, 3, 3, 3, 10, rng.randrange(50)])) for k in range(300)]
    load, plain = [0] * 5, {}
    for name, work in sorted(items, key=lambda x: (x[1], x[0]), reverse=True):
        plain[name] = j = min(range(5), key=lambda j: (load[j], j))
        load[j] += work
    rows = balance.balanced_jobs(spark.createDataFrame(items, "name string, work bigint"), 5).collect()
    assert {r.name: r.job for r in rows} == plain
    most = max(sum(r.work for r in rows if r.job == j) for j in range(5))
    assert most <= (4 / 3 - 1 / 15) * max(max(w for _, w in items), sum(w for _, w in items) / 5) + 1
    assert balance.balanced_jobs(spark.createDataFrame([], "name string, work bigint"), 5).collect() == []


def test_greedy_picks(spark):
    """Few frames, frames outside the middle, and repeats where all are taken."""

    def plain(times, center, start, end):
        free, picked, every = set(range(len(times))), [], range(len(times))

        def take(target, allowed):
            options = [i for i in free if i in allowed]
            if options:
                k = min(options, key=lambda i: (abs(times[i] - target), i))
                free.discard(k)
                picked.append(k)
            return bool(options)

        for k in range(4):
            take(times[0] + (times[-1] - times[0]) * k / 3, every)
        inner = {i for i, t in enumerate(times) if start - 1e-9 <= t <= end + 1e-9}
        for t in [t for t in [start + (end - start) * k / 5 for k in range(6)] if not take(t, inner)]:
            take(t, every)
        while len(picked) < 10 and take(center, every):
            pass
        picked += [min(every, key=lambda i: (abs(times[i] - center), i))] * (10 - len(picked))
        return sorted(picked, key=lambda i: (times[i], i))

    rng = random.Random(8)
    rows = [(k, sorted(rng.random() * 10 for _ in range(rng.choice([1, 2, 5, 9, 12, 30]))), 5.0, 4.0, 6.0) for k in range(40)]
    got = {r.key: r.indices for r in S.dense_selected(spark.createDataFrame([*rows, (99, [], 5.0, 4.0, 6.0)], "key bigint, times array<double>, center double, start double, end double")).collect()}
    assert got.pop(99) == [] and got == {k: plain(t, c, a, z) for k, t, c, a, z in rows}


def test_weights_are_checked(spark):
    ask = lambda pairs: spark.createDataFrame([(pairs,)], "p array<struct<v:double,w:double>>").select(U.weighted_median(F.col("p"), strict=True)).collect()[0][0]
    assert ask([(3.0, 1.0), (1.0, 2.0)]) == 1.0
    for bad in ([], [(1.0, -1.0)], [(1.0, 0.0)], [(float("nan"), 1.0)], [(1.0, math.inf)], [(None, 1.0)]):
        with pytest.raises(Exception, match="weight|finite|value"):
            ask(bad)


def test_checked_lookup(spark):
    rows = spark.createDataFrame([(k,) for k in range(30)], "k bigint")
    table = spark.createDataFrame([(k, f"n{k}") for k in range(5, 30)], "k bigint, name string")
    assert Q.looked_up(rows.where("k >= 5"), table, ["k"]).count() == 25
    assert Q.looked_up(rows, table, ["k"], strict=False).where("name is null").count() == 5
    with pytest.raises(Exception, match="5 keys have no row in names, the first: 0, 1, 2, 3, 4"):
        Q.looked_up(rows, table, ["k"], what="names").collect()
    clips = spark.createDataFrame([("a", 0, 0.5)], "video_id string, clip_idx int, score double")
    index = spark.createDataFrame([("a", 0, 15), ("b", 0, 15)], "video_id string, start_frame bigint, end_frame bigint")
    assert R.expanded(clips, index).count() == 32
    with pytest.raises(Exception, match="1 keys have no row in the scores, the first: b"):
        R.expanded(clips, index, strict=True).collect()


def test_scope_without_a_class(spark):
    got = D.scope_summary(spark.createDataFrame([(0.1, 0.3, True), (0.2, 0.1, True)], "a double, b double, positive boolean")).first()
    assert (got.clips, got.positive, got.negative) == (2, 2, 0) and math.isnan(got.verify_auc) and math.isnan(got.tn_mean) and math.isnan(got.mean_gap) and got.fn_raised == 0.5


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    rows = lambda n: spark.range(n)
    with pytest.raises(ValueError):
        snapshots.read(spark, root)
    a = snapshots.acquire(spark, root, 10, "a", now=0)
    assert a.fence == 1 and snapshots.acquire(spark, root, 10, "b", now=9_999) is None
    assert snapshots.commit(rows(3), a, "x", now=5).number == 1
    assert snapshots.commit(rows(9), a, "x", now=6).number == 1 and snapshots.read(spark, root).count() == 3
    with pytest.raises(snapshots.Fenced, match="ended"):
        snapshots.commit(rows(4), a, now=10_000)
    late = snapshots.prepare(rows(5), root)
    b = snapshots.acquire(spark, root, 10, "b", now=10_000)
    assert b.fence == 2 and snapshots.commit(rows(6), b, now=10_001).number == 2
    with pytest.raises(snapshots.Fenced, match="followed"):
        snapshots.publish(spark, a, late, now=20)
    # a writer that passed its check before b took over and wrote its pointer after: readers pass over it
    assert storage.create(spark, f"{root}/versions/{3:012d}", f"1 {late} ")
    assert [v.number for v in snapshots.versions(spark, root)] == [1, 2] and snapshots.read(spark, root).count() == 6
    # a pointer whose writer died in it uses up its number
    (tmp_path / "table" / "versions" / f"{4:012d}").write_text("2 half")
    assert snapshots.commit(rows(7), b, now=10_002).number == 5 and snapshots.read(spark, root).count() == 7
    snapshots.release(spark, b)
    with pytest.raises(snapshots.Fenced, match="given back"):
        snapshots.commit(rows(1), b, now=10_003)
    c = snapshots.acquire(spark, root, 3600, "c")
    assert c.fence == 3 and late in snapshots.expire(spark, c, keep=1)
    assert snapshots.read(spark, root).count() == 7 and len(storage.names(spark, f"{root}/data")) == 1
    # a lease whose writer died while making it is no lease
    (tmp_path / "table" / "leases" / f"{4:012d}").write_text("")
    assert snapshots.acquire(spark, root, 10, "d").fence == 5


def test_sink_takes_each_batch_once(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(source)
    sink, seen = BatchSink(f"file://{tmp_path}/out"), []
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 2).parquet(source)

    def stop(batch):
        seen.append(batch)
        if len(seen) in (1, 3):
            raise InterruptedError("planted")

    for _ in range(2):
        with pytest.raises(Exception, match="planted"):
            run_available(stream, lambda b: b, sink, stop)
    run_available(stream, lambda b: b, sink, stop)
    assert len(seen) > len(set(seen))
    assert sorted(r.id for r in sink.read(spark, "id bigint").collect()) == list(range(40))
    assert not sink.write(spark.range(5), 0) and BatchSink(f"file://{tmp_path}/none").read(spark, "id bigint").count() == 0
    (tmp_path / "out" / "batches" / f"{77:012d}").write_text("")  # its writer died in it
    assert sink.write(spark.range(100, 101), 77) and not sink.write(spark.range(5), 77)
    assert sink.read(spark, "id bigint").count() == 41
