import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import events as E
from tidewright.sources import generators as gen


def signal(spark, values, rec=0):
    return spark.createDataFrame([(rec, i, float(v)) for i, v in enumerate(values)], "rec int, i bigint, v double")


def test_candidates_take_the_first_peak_of_each_run(spark):
    s = signal(spark, [0, 5, 7, 7, 0, 0, -9, -3, 6, 0])
    got = sorted((r["i"], r["magnitude"]) for r in E.suprathreshold_candidates(s, ["rec"], "i", "v", 2.0).collect())
    assert got == [(2, 7.0), (6, 9.0)]
    split = sorted((r["i"], r["magnitude"]) for r in E.suprathreshold_candidates(s, ["rec"], "i", "v", 2.0, stretch=2).collect())
    assert split == got
    assert E.suprathreshold_candidates(signal(spark, [0, 1]), ["rec"], "i", "v", 2.0).count() == 0


def greedy(points, gap):
    kept = []
    for m, i in sorted(((m, i) for i, m in points), reverse=True):
        if all(abs(i - j) > gap for j in kept):
            kept.append(i)
    return sorted(kept)


def test_refractory_against_brute_force(spark):
    rng = np.random.default_rng(1)
    at = sorted(rng.choice(400, 120, replace=False).tolist())
    points = [(int(i), float(rng.integers(1, 9))) for i in at]
    df = spark.createDataFrame([(0, i, m) for i, m in points], "rec int, i bigint, magnitude double")
    got = sorted(r["i"] for r in E.enforce_refractory(df, ["rec"], "i", "magnitude", 5).collect())
    assert got == greedy(points, 5)
    pair = spark.createDataFrame([(0, 15000, 8.0), (0, 15030, 5.0)], "rec int, i bigint, magnitude double")
    assert [r["i"] for r in E.enforce_refractory(pair, ["rec"], "i", "magnitude", 30).collect()] == [15000]


def test_detection_finds_planted_spikes(spark):
    train = spark.createDataFrame([(0, 0.1 + 0.2 * k) for k in range(20)], "unit int, t double")
    s = gen.build_signal(train, 5000, 4.2, 0.05, gen.templates(), seed=2).withColumn("rec", F.lit(0)).cache()
    found = E.detect_spikes(s, ["rec"], "i", "v", E.mad_threshold(s, ["rec"], "v", 5.0), 30)  # 30 samples, as templates of 61 samples need
    truth = train.select(F.lit(0).alias("rec"), F.round(F.col("t") * 5000).cast("bigint").alias("tid"), F.round(F.col("t") * 5000).cast("bigint").alias("tt"))
    m = E.match_detections(found.withColumn("did", F.col("i")), truth, ["rec"], "did", "tid", "i", "tt", 25)
    pr = E.precision_recall(m, found, truth, ["rec"]).first()
    assert pr["recall"] > 0.95 and pr["precision"] > 0.9
    assert E.mad_threshold(signal(spark, [0, 0, 0]), ["rec"], "v").first()["threshold"] is None


def test_extract_waveforms(spark):
    values = np.zeros(6000)
    values[3000], values[3002], values[5000], values[10], values[5995] = 5, 9, 5, 5, 5
    s = signal(spark, values)
    spikes = spark.createDataFrame([(0, i) for i in (3000, 5000, 10, 5995)], "rec int, i bigint")
    got = {r["center"]: r["wf"] for r in E.extract_waveforms(s, spikes, ["rec"], "i", "v", 30, 30).collect()}
    assert sorted(got) == [3000, 5000] and all(len(w) == 61 for w in got.values()) and got[3000][30] == 5
    moved = {r["center"] for r in E.extract_waveforms(s, spikes, ["rec"], "i", "v", 30, 30, align=5).collect()}
    assert moved == {3002, 5000}


def test_intervals_and_violations(spark):
    t = spark.createDataFrame([("u", x) for x in (0, 500, 1000, 2500, 3000)] + [("v", 7)], "unit string, t bigint")
    isi = E.intervals(t, ["unit"], "t", 900)
    h = {(r["unit"], r["bin"]): r["n"] for r in E.isi_histogram(isi, ["unit"], 1000).collect()}
    assert h == {("u", 0): 3, ("u", 1): 1}
    t2 = spark.createDataFrame([("u", x) for x in (0, 500, 700, 3000, 5000)], "unit string, t bigint")
    bad = E.refractory_violations(E.intervals(t2, ["unit"], "t", 100), ["unit"], 1000)
    assert sorted(r["t"] for r in bad.collect()) == [500, 700]


def test_psth(spark):
    spikes = spark.createDataFrame([("u", x) for x in (100, 1100, 2100, 1300)], "unit string, t bigint")
    events = spark.createDataFrame([("u", x) for x in (0, 1000, 2000)], "unit string, e bigint")
    h = {r["bin"]: r["rate"] for r in E.psth(spikes, events, ["unit"], "t", "e", 0, 500, 100).collect()}
    assert h[1] == pytest.approx(1) and h[3] == pytest.approx(1 / 3) and len(h) == 5
    eff = E.psth_effect(E.psth(spikes, events, ["unit"], "t", "e", -500, 500, 100), ["unit"], 5).first()
    assert eff["effect"] == "excitation"
    with pytest.raises(ValueError):
        E.range_join(spikes, events, ["unit"], "t", "e", 5, 5)


def brute_matching(a, b, tol):
    best = (0, 0)
    small, large, flip = (a, b, False) if len(a) <= len(b) else (b, a, True)
    for perm in itertools.permutations(range(len(large) + len(small)), len(small)):
        d = [abs(small[i] - large[p]) for i, p in enumerate(perm) if p < len(large) and abs(small[i] - large[p]) <= tol]
        best = max(best, (len(d), -sum(d)))
    return best


def test_matching_is_optimal(spark):
    rng = np.random.default_rng(4)
    for case in range(3):
        a, b = sorted(rng.choice(40, 4, replace=False).tolist()), sorted(rng.choice(40, 3, replace=False).tolist())
        d = spark.createDataFrame([(0, i, int(t)) for i, t in enumerate(a)], "rec int, did int, t bigint")
        t = spark.createDataFrame([(0, i, int(x)) for i, x in enumerate(b)], "rec int, tid int, u bigint")
        m = E.match_detections(d, t, ["rec"], "did", "tid", "t", "u", 6).collect()
        assert (len(m), -sum(abs(r["dt"]) for r in m)) == brute_matching(a, b, 6)
        assert len({r["did"] for r in m}) == len(m) == len({r["tid"] for r in m})


def test_zero_crossings_and_jitter(spark):
    s = signal(spark, [1, -1, -2, 3, -0.05, -4])
    assert sorted(r["i"] for r in E.zero_crossings(s, ["rec"], "i", "v", 0.1).collect()) == [1, 5]
    j = E.jittered(spark.range(100).select(F.col("id"), (F.col("id") * 0 + 50).alias("i")), "i", ["id"], 3, 1)
    assert j.agg(F.min("i"), F.max("i")).first() == (47, 53)


def test_banded_matching_against_all_pairs():
    rng = np.random.default_rng(12)

    def brute(a, b, tolerance):
        best = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                d = abs(a[i] - b[j])
                best[i][j] = max(best[i + 1][j], best[i][j + 1], (best[i + 1][j + 1][0] + 1, best[i + 1][j + 1][1] - d) if d <= tolerance else (0, 0))
        return best[0][0]

    for _ in range(200):
        a, b = (sorted(rng.integers(0, 60, rng.integers(0, 14)).tolist()) for _ in range(2))
        got = E._best_matching([{"t": t, "id": k} for k, t in enumerate(a)], [{"t": t, "id": k} for k, t in enumerate(b)], 5)
        assert (len(got), -sum(abs(m["dt"]) for m in got)) == brute(a, b, 5)
        assert len({m["a"] for m in got}) == len({m["z"] for m in got}) == len(got)
        assert all(abs(m["dt"]) <= 5 and b[m["z"]] - a[m["a"]] == m["dt"] for m in got)


def test_refractory_of_a_dense_chain(spark):
    rng = np.random.default_rng(13)
    at = np.unique(rng.integers(0, 3000, 1200))
    size = rng.integers(1, 40, len(at))
    kept = []
    for k in np.lexsort((-at, -size)):
        if all(abs(at[k] - j) > 4 for j in kept):
            kept.append(at[k])
    rows = spark.createDataFrame([("a", int(i), float(m)) for i, m in zip(at, size)], "k string, i bigint, m double")
    assert sorted(r["i"] for r in E.enforce_refractory(rows, ["k"], "i", "m", 4).collect()) == sorted(kept)
