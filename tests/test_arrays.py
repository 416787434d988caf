import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.functions import signal, spd
from tidewright.operators import classify as C
from tidewright.operators import cluster as K
from tidewright.sources import generators as gen


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(list(map(float, v)) for v in cols.values())], ", ".join(f"{c} array<double>" for c in cols))
    return row.select(expr.alias("v")).first()["v"]


def test_convolutions(spark):
    x, k = [0, 0, 1, 2, 1, 0, 0], [1] * 7
    assert one(spark, A.circular_convolution("x", "k"), x=x, k=k) == pytest.approx([4.0] * 7)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=12), rng.normal(size=5)
    direct = one(spark, A.circular_convolution("a", "b"), a=a, b=b)
    assert direct == pytest.approx(one(spark, signal.circular_convolution_fft(F.col("a"), F.col("b")), a=a, b=b))
    full = one(spark, A.linear_convolution("a", "b"), a=a, b=b)
    assert full == pytest.approx(np.convolve(a, b))
    assert one(spark, A.deconvolution("y", "b"), y=full, b=b) == pytest.approx(a)
    assert one(spark, A.linear_convolution("a", "b"), a=[], b=b) == []


def test_fourier(spark):
    x = np.random.default_rng(1).normal(size=16)
    want = np.fft.fft(x)
    for got in (one(spark, A.dft("x"), x=x), one(spark, signal.fft(F.col("x")), x=x)):
        assert [z["re"] for z in got] == pytest.approx(want.real, abs=1e-9) and [z["im"] for z in got] == pytest.approx(want.imag, abs=1e-9)
    assert one(spark, A.inverse_dft(A.dft("x")), x=x) == pytest.approx(x)
    low = one(spark, A.inverse_dft(A.band_filter(A.dft("x"), 0, 0.0)), x=x)
    assert low == pytest.approx([x.mean()] * 16)
    assert one(spark, A.circshift("x", 3), x=x) == pytest.approx(np.roll(x, 3))
    assert one(spark, A.moving_average("x"), x=x)[2] == pytest.approx(x[:5].mean())


def test_lowpass(spark):
    t = np.arange(300)
    slow, fast = np.sin(2 * np.pi * t / 150), np.sin(2 * np.pi * t / 4)
    got = np.array(one(spark, signal.lowpass(F.col("x"), 20.0, 1000.0), x=slow + fast))
    assert np.abs(got - slow)[100:200].max() < 0.003  # away from the ends, which the short extension disturbs
    assert one(spark, signal.lowpass(F.col("x"), 600.0, 1000.0), x=[1, 2]) == [1, 2]
    b, a = signal.butterworth(3, 0.3)
    assert b.sum() / a.sum() == pytest.approx(1)
    z = np.exp(1j * np.pi * 0.3)
    assert abs(np.polyval(b, z) / np.polyval(a, z)) == pytest.approx(np.sqrt(0.5), abs=1e-9)


def test_hankel_and_descriptors(spark):
    h = one(spark, A.hankel("x", 4, 2), x=range(20))
    assert len(h) == 14 and h[0] == [0, 2, 4, 6]
    assert one(spark, A.hankel("x", 4, 2), x=range(7)) is None
    x = np.arange(20.0)
    rows = np.array([[x[i + 2 * k] for k in range(4)] for i in range(14)])
    want = rows.T @ rows / 14
    want += 1e-3 * np.trace(want) / 4 * np.eye(4)
    assert one(spark, A.delay_descriptor("x", 4, 2), x=x) == pytest.approx(want.ravel())
    v = np.array([1.0, -2.0, 3.0])
    assert one(spark, A.outer_descriptor("v", 3), v=v) == pytest.approx((np.outer(v, v) + 1e-3 * v @ v / 3 * np.eye(3)).ravel())
    assert one(spark, A.outer_descriptor("v", 3), v=[0, 0, 0]) is None
    m = np.array([[2.0, 1.0], [1.0, 3.0]])
    assert np.linalg.norm(one(spark, A.vech("m", 2), m=m.ravel())) == pytest.approx(np.linalg.norm(m))


def test_spd_functions(spark):
    rng = np.random.default_rng(2)
    ms = [(lambda g: g @ g.T + np.eye(3))(rng.normal(size=(3, 3))) for _ in range(6)]
    df = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(ms)] + [(9, None)], "id int, m array<double>")
    back = {r["id"]: r["b"] for r in df.select("id", spd.expm(spd.logm(F.col("m"), 3), 3).alias("b")).collect()}
    assert back[9] is None and all(back[i] == pytest.approx(m.ravel(), abs=1e-9) for i, m in enumerate(ms))
    g = rng.normal(size=(3, 3))
    pair = lambda a, b: one(spark, spd.airm_distance(F.col("a"), F.col("b"), 3), a=a.ravel(), b=b.ravel())
    assert pair(ms[0], ms[1]) == pytest.approx(pair(g @ ms[0] @ g.T, g @ ms[1] @ g.T), abs=1e-8)
    assert pair(np.diag([1.0, 2.0, 4.0]), np.diag([1.0, 1.0, 1.0])) == pytest.approx(np.sqrt(np.log(2) ** 2 + np.log(4) ** 2))
    mean = C.karcher_mean(df, "m", 3)
    steps = [spd.apply_spectral((lambda h: h @ m @ h)(spd.apply_spectral(mean[None], lambda w: w**-0.5)[0])[None], np.log)[0] for m in ms]
    assert np.abs(sum(steps)).max() < 1e-6
    spd.register(spark, 3)
    df.createOrReplaceTempView("spd_rows")
    assert spark.sql("SELECT airm_distance(m, m) AS d FROM spd_rows WHERE m IS NOT NULL LIMIT 1").first()["d"] == pytest.approx(0, abs=1e-6)


def test_neighbours_and_votes(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1, (15, 4)) for c in (0, 6)])
    df = spark.createDataFrame([(i, v.tolist(), int(i >= 15)) for i, v in enumerate(x)], "id int, x array<double>, label int")
    near = C.nearest_neighbours(df, df, 3, block=7)
    got = {}
    for r in near.orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append(r["tid"])
    for i in range(30):
        d = np.linalg.norm(x - x[i], axis=1)
        d[i] = np.inf
        assert got[i] == np.argsort(d, kind="stable")[:3].tolist()
    assert C.accuracy(C.vote(near), df).first()["accuracy"] == 1
    assert C.accuracy(C.kernel_vote(near), df).first()["accuracy"] == 1
    folds = C.contiguous_folds(df, "id", 7)
    assert [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()] == [5, 5, 4, 4, 4, 4, 4]
    with pytest.raises(ValueError):
        C.contiguous_folds(df, "id", 31)
    tie = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "qid int, place int, label string")
    assert C.vote(tie).first()["predicted"] == "a"


def test_perceptron_separates(spark):
    rng = np.random.default_rng(5)
    rows = [(0, i, *(rng.normal(2 if i % 2 else -2, 0.5, 2).tolist()), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id int, x1 double, x2 double, t int")
    m = C.perceptron_fit(df, "id", ["x1", "x2"], "t", "g", max_turns=50)
    r = m.first()
    w, b = np.zeros(2), 0.9
    for turn in range(50):
        errors = 0
        for _, _, a, c, t in rows:
            p = float(w @ [a, c] + b > 0)
            errors += p != t
            w, b = w + 0.2 * (t - p) * np.array([a, c]), b + 0.2 * (t - p)
        if not errors:
            break
    assert r["errors"] == 0 and r["turns"] == turn + 1 and r["w"] == pytest.approx(w) and r["b"] == pytest.approx(b)
    assert C.perceptron_decide(df, m, ["x1", "x2"], "g").where("predicted <> t").count() == 0


def test_discriminant_and_means(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 1, 3) + 5 * np.eye(3)[i % 3]).tolist(), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, x array<double>, label int")
    model = C.linear_discriminant(df, "x", "label", 3)
    assert C.discriminant_predict(df, model, "x", "label").where("predicted = label").count() >= 88
    assert C.nearest_class(df, C.class_means(df, "x", "label"), "x", "label").where("predicted = label").count() >= 87


def test_regimes(spark):
    """Covariance classes: the nearest log-Euclidean mean works where plain sums don't."""
    w = gen.covariance_windows(spark, classes=3, per_class=20, steps=64, channels=4, seed=1).cache()
    t = spd.with_tangent(w.select("id", "label", A.spd_embed("win", 4).alias("m")), "m", 4, "x").cache()
    good = C.nearest_class(t, C.class_means(t, "x", "label"), "x", "label").where("predicted = label").count()
    assert good >= 54


def test_alignment_and_templates(spark):
    shape = gen.templates()[0]
    rows = [(i, np.roll(shape, s).tolist()) for i, s in enumerate((-4, 0, 3))]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    got = {r["id"]: r["shift"] for r in K.align_waveforms(df, "x", shape.tolist(), 6).collect()}
    assert got == {0: 4, 1: 0, 2: -3}


def test_overlap_screen(spark):
    a, b = gen.templates()[0], gen.templates()[1]
    rng = np.random.default_rng(7)
    rows = [(i, (a + rng.normal(0, 0.02, 61)).tolist(), 0) for i in range(9)] + [(10 + i, (b + rng.normal(0, 0.02, 61)).tolist(), 1) for i in range(9)]
    rows.append((99, (a + b).tolist(), 0))
    df = spark.createDataFrame(rows, "id int, x array<double>, label int")
    got = K.screen_overlaps(df, "id", "x", "label", K.cluster_templates(df, "x", "label")).where("is_overlap").collect()
    assert [r["id"] for r in got] == [99]


def test_sorting_pipelines(spark):
    rng = np.random.default_rng(8)
    shapes = gen.templates(91)
    rows = [(i, (shapes[i % 3] * 3 + rng.normal(0, 0.1, 91)).tolist(), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, x array<double>, unit int").cache()
    truth = df.select("id", "unit")
    for c in (K.sort_pca(df, "id", "x", 3), K.sort_spd(df, "id", "x", 3), K.sort_refined(df, "id", "x", 3, 30_000.0)):
        assert K.adjusted_rand(c.join(truth, "id"), "unit", "cluster").first()["ari"] > 0.8


def test_assignment_and_scores(spark):
    import itertools

    rng = np.random.default_rng(9)
    for shape in ((4, 4), (3, 5), (5, 3)):
        cost = rng.normal(size=shape)
        total = sum(cost[i, j] for i, j in K.assignment(cost))
        n, m = shape
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert total == pytest.approx(best)
    same = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "t int, c int")
    assert K.clustering_accuracy(same, "t", "c") == 1 and K.adjusted_rand(same, "t", "c").first()["ari"] == pytest.approx(1)
    assert K.clustering_accuracy(same.where("t > 5"), "t", "c") == 0


def test_lloyd_revives_lost_clusters(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in (0, 1, 10, 11)], "id int, x array<double>")
    got, centers = K.lloyd(df, "id", "x", [[0.0, 0.0], [500.0, 0.0]], 10)
    labels = {r["id"]: r["cluster"] for r in got.collect()}
    assert labels[0] == labels[1] != labels[10] == labels[11] and len(centers) == 2


def test_spectrogram(spark):
    t = np.arange(256)
    got = one(spark, signal.spectrogram(F.col("x"), 64, 32, 64), x=np.sin(2 * np.pi * t / 8))
    assert len(got) == 7 and all(np.argmax(f) == 8 for f in got)
    assert got[1] == pytest.approx(np.abs(np.fft.rfft(np.sin(2 * np.pi * t[32:96] / 8) * np.hamming(64))))
    assert one(spark, signal.spectrogram(F.col("x"), 64, 32, 64), x=[1.0] * 10) == []
    with pytest.raises(ValueError):
        signal.spectrogram(F.col("x"), 8, 8, 8)


def test_agreement(spark):
    pairs = spark.createDataFrame([(0, "b")] * 8 + [(1, "a")] * 5 + [(1, "b")], "t int, f string")
    sizes = lambda rows, c: spark.createDataFrame(rows, f"{c}, n bigint")
    got = K.agreement(pairs, "t", "f", sizes([(0, 10), (1, 6)], "t int"), sizes([("a", 5), ("b", 9)], "f string"))
    assert [(t, f) for t, f, _ in got] == [(0, "b"), (1, "a")] and [s for *_, s in got] == pytest.approx([0.8, 5 / 6])
    assert K.agreement(pairs.where("t > 5"), "t", "f", sizes([], "t int"), sizes([], "f string")) == []
