import math

import pytest
from pyspark.sql import functions as F

from tidewright.operators import information as info
from tidewright.operators import roc, series
from tidewright.sources import generators as gen


def table(spark, rows):
    return spark.createDataFrame(rows, "y int, x int, n double")


def mi(spark, rows, **kw):
    return info.mutual_information(table(spark, rows), "x", "y", **kw).first()["mi"]


def test_joint_tables(spark):
    assert mi(spark, [(0, 0, 0.25), (1, 1, 0.25)]) == pytest.approx(1)
    assert mi(spark, [(y, x, 1.0) for y in range(4) for x in range(4)]) == pytest.approx(0, abs=1e-12)
    counts, shares = [(0, 0, 10.0), (0, 1, 30.0), (1, 0, 5.0), (1, 1, 5.0)], [(0, 0, 0.2), (0, 1, 0.6), (1, 0, 0.1), (1, 1, 0.1)]
    assert mi(spark, counts) == pytest.approx(mi(spark, shares), abs=1e-12)


def test_self_information_is_entropy(spark):
    rows = spark.range(600).select((F.col("id") % 7 % 6).cast("int").alias("x")).withColumn("y", F.col("x"))
    own = info.mutual_information(info.joint_histogram(rows, "x", "y"), "x", "y").first()["mi"]
    h = info.entropy(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "n").first()["entropy"]
    assert own == pytest.approx(h, abs=1e-10)


def test_zero_cells_nulls_and_empty(spark):
    assert mi(spark, [(0, 0, 1.0), (0, 1, 0.0), (1, 1, 1.0)]) == pytest.approx(1)
    assert info.mutual_information(table(spark, []), "x", "y").count() == 0
    rows = spark.createDataFrame([(1, None), (None, 1), (1, 1)], "x int, y int")
    assert [tuple(r) for r in info.joint_histogram(rows, "x", "y").collect()] == [(1, 1, 1)]


def test_negative_weight_is_an_error(spark):
    with pytest.raises(Exception, match="negative"):
        info.entropy(spark.createDataFrame([(-1.0,)], "n double"), "n").collect()
    with pytest.raises(ValueError):
        info.mutual_information(table(spark, []), "x", "y", method="other")


def test_bias_corrections(spark):
    pop = gen.simulate_population(spark, 4, 25, seed=3).cache()
    plug = {r["neuron"]: r["mi"] for r in info.mi_by_key(pop, ["neuron"], "response", "stimulus").collect()}
    mm = {r["neuron"]: r["mi"] for r in info.mi_by_key(pop, ["neuron"], "response", "stimulus", method="miller_madow").collect()}
    sh = {r["neuron"]: r["mi"] for r in info.mi_by_key(pop, ["neuron"], "response", "stimulus", "trial_id", "shuffle", 10, 1).collect()}
    assert plug[0] > mm[0] > -0.1 and abs(sh[0]) < plug[0]
    best = info.rank_by_information(info.mi_by_key(pop, ["neuron"], "response", "stimulus"), "neuron").orderBy("position").first()
    assert best["neuron"] == max(plug, key=plug.get)


def test_shuffle_is_a_permutation(spark):
    trials = spark.createDataFrame([(i, i % 3) for i in range(50)], "id int, s int")
    for k, rows in enumerate([info.shuffled_labels(trials, "id", "s", 2, 7).where(F.col("b") == b).collect() for b in (1, 2)]):
        assert sorted(r["id"] for r in rows) == list(range(50))
        assert sorted(r["s"] for r in rows) == sorted(i % 3 for i in range(50))
    with pytest.raises(ValueError):
        info.shuffled_labels(trials, "id", "s", 0, 7)


def test_surrogate_counts_equal_a_join(spark):
    """Counts per batch are those of the rows multiplied by the permutations, null responses and stimuli left out, in any block size."""
    rows = [(n, t, None if (t + n) % 11 == 0 else (t * 7 + n) % 5, None if t % 13 == 0 else "abc"[t % 3]) for t in range(60) for n in range(3) if (t + n) % 4]
    df = spark.createDataFrame(rows, "neuron int, trial_id int, response int, stimulus string")
    b, seed = 6, 3
    codes = {c: k for k, c in enumerate(sorted({r[3] for r in rows if r[3]}), 1)}
    joined = df.drop("stimulus").join(info.shuffled_labels(df.select("trial_id", "stimulus").distinct(), "trial_id", "stimulus", b, seed), "trial_id")
    want = {(r["neuron"], r["b"], r["response"], codes[r["stimulus"]]): r["n"] for r in info.joint_histogram(joined, "response", "stimulus", ["neuron", "b"]).collect()}
    labels, stimuli = info.coded_labels(df, "trial_id", "stimulus", b, seed)
    for held in (1, 200, 8_000_000):
        got = {(r["neuron"], r["b"], r["response"], r["code"]): r["n"] for r in info.surrogate_counts(df, ["neuron"], "response", "trial_id", labels, b, stimuli, held).collect()}
        assert got == want
    empty = df.where("false")
    assert info.mi_by_key(empty, ["neuron"], "response", "stimulus", "trial_id", "shuffle", 2).count() == 0


def test_synergy_of_xor(spark):
    rows = [(n, t, (t >> n) & 1, ((t >> 0) ^ (t >> 1)) & 1) for t in range(64) for n in (0, 1)]
    df = spark.createDataFrame(rows, "neuron int, trial_id int, response int, stimulus int")
    assert info.synergy(df, "neuron", "trial_id", "response", "stimulus").first()["sr"] == pytest.approx(1)
    full = info.synergy_matrix(info.synergy(df, "neuron", "trial_id", "response", "stimulus")).collect()
    assert len(full) == 4 and sum(r["sr"] for r in full) == pytest.approx(2)


def test_analytic_truth(spark):
    p = gen.analytic_joint(spark, 1.0, 8, 8)
    assert info.mutual_information(p, "response", "stimulus", n="p").first()["mi"] == pytest.approx(3)
    assert gen.analytic_joint(spark, 0.5, 4, 8).agg(F.sum("p")).first()[0] == pytest.approx(1)


def test_roc(spark):
    rates = spark.createDataFrame([("a", r) for r in range(10)] + [("b", r) for r in range(10, 21)], "c string, r int")
    d = roc.rate_distributions(rates, "c", "r")
    curve = roc.roc_curve(d, "a", "b")
    assert roc.area_under_curve(curve).first()["auc"] == pytest.approx(1)
    assert roc.auc_by_ranks(rates, "c", "r", "a", "b").first()["auc"] == pytest.approx(1)
    ends = {r["k"]: (r["fpr"], r["tpr"]) for r in curve.collect()}
    assert ends[0] == pytest.approx((1, 1)) and ends[21] == (0, 0)
    trapezoid = spark.createDataFrame([(2, 0.0, 0.0), (1, 0.5, 0.75), (0, 1.0, 1.0)], "k int, fpr double, tpr double")
    assert roc.area_under_curve(trapezoid).first()["auc"] == pytest.approx(0.625)
    with pytest.raises(Exception, match="non-negative"):
        roc.rate_distributions(spark.createDataFrame([("a", -1)], "c string, r int"), "c", "r").collect()


def test_series(spark):
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate([1, 2, 3, 4, 100])] + [(2, 0, 5.0), (2, 1, 5.0)], "k int, t int, v double")
    placed = series.indexed(df, ["k"], "t", ["v"], F.floor(F.col("t") / 2))
    assert [(r["t"], r["i"]) for r in placed.where("k = 1").orderBy("t").collect()] == [(i, i) for i in range(5)]
    z = series.zscore(df, ["k"], "v")
    assert z.where("k = 2").agg(F.count("z")).first()[0] == 0
    assert z.where("k = 1").agg(F.avg("z"), F.stddev_pop("z")).first()[1] == pytest.approx(1)
    s = series.snr(spark.createDataFrame([(3.0, 1.0), (-3.0, -1.0)], "s double, n double"), "s", "n").first()
    assert s["snr_power"] == pytest.approx(9) and s["snr_db"] == pytest.approx(10 * math.log10(9)) and s["snr_rms"] == pytest.approx(3)
    assert series.spearman(df.withColumn("w", F.col("v") * F.col("v")), ["k"], "v", "w").where("k = 1").first()["spearman"] == pytest.approx(1)


def test_cross_correlation_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=600), rng.normal(size=600)
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "k int, i int, a double, b double")
    got = {r["lag"]: r["r"] for r in series.cross_correlation(df, ["k"], "i", "a", "b", 5).collect()}
    for lag in range(-5, 6):
        assert got[lag] == pytest.approx(sum(a[i + lag] * b[i] for i in range(600) if 0 <= i + lag < 600))


def test_chains_cross_buckets(spark):
    times = [0, 1, 2, 9, 10, 11, 12, 40, 41, 43]
    df = spark.createDataFrame([("k", t) for t in times], "k string, t bigint")
    want = [0, 0, 0, 9, 9, 9, 9, 40, 40, 40]
    for width in (3, 10, 1000):
        got = {r["t"]: r["c"] for r in series.chains(df, ["k"], "t", 2, width, "c").collect()}
        assert [got[t] for t in times] == want
        before = {r["t"]: r["p"] for r in series.previous(df, ["k"], "t", "t", width, "p").collect()}
        assert before[0] is None and [before[t]["o"] for t in times[1:]] == times[:-1]
