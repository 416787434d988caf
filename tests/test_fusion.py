"""Fusion features against eigendecompositions of the whole descriptors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.functions import spd
from tidewright.operators import cluster as K
from tidewright.operators import fusion
from tidewright.sources import generators as gen


def tangent(m):
    return spd.vech(spd.apply_spectral(m[None], np.log))[0]


def test_outer_tangent(spark):
    rows = [([1.0, -2.0, 0.0, 0.5],), ([1e-3, 2e-3, 3e-3, 0.0],), ([0.0] * 4,), (None,)]
    got = [r["t"] for r in spark.createDataFrame(rows, "x array<double>").select(A.outer_tangent("x", 4).alias("t")).collect()]
    for (x,), t in zip(rows[:2], got):
        assert t == pytest.approx(tangent(np.outer(x, x) + 1e-3 * np.dot(x, x) / 4 * np.eye(4)), abs=1e-9)
    assert got[2:] == [None, None]


def test_fusion_takes_every_sample(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, 91))
    x[1] = x[0]
    x[1, 1::4] *= -1  # differs between every fourth samples only
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "id int, x array<double>")
    got = {r["id"]: np.array(r["f"]) for r in K.fusion_features(df, "x", "f").select("id", "f").collect()}
    for i, w in enumerate(x):
        h = np.array([w[t : t + 46 : 3] for t in range(46)])
        d = h.T @ h / 46
        want = [tangent(d + 1e-3 * np.trace(d) / 16 * np.eye(16)), tangent(np.outer(w, w) + 1e-3 * w @ w / 91 * np.eye(91))]
        assert got[i] == pytest.approx(np.concatenate(want), abs=1e-8)
    assert len(got[0]) == 136 + 4186 and np.abs(got[0] - got[1])[136:].max() > 0.1
    zero = K.fusion_features(spark.createDataFrame([(0, [0.0] * 91)], "id int, x array<double>"), "x", "f")
    assert zero.where(F.col("f").isNull()).count() == 1


def test_packed_kmeans_is_that_of_the_features(spark, monkeypatch):
    """Distances, means and fixed points of packed waveforms are those of their 4,322 features, which sort_refined doesn't make."""
    rng = np.random.default_rng(13)
    x = gen.templates(91)[np.arange(60) % 3] * 3 + rng.normal(0, 0.4, (60, 91))
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)] + [(60, [0.0] * 91), (61, None)], "id int, x array<double>")
    packed = fusion.pack(df, "id", "x", x.mean(0).tolist(), 0)
    centers = fusion.kmeans(packed, 3, range(4), tol=0.0)
    named = {r["id"]: r["cluster"] for r in fusion.labelled(packed, centers, "id").collect()}
    assert sorted(named) == list(range(60)) and {named[i] for i in range(60)} == {0, 1, 2}
    f = {r["id"]: np.array(r["f"]) for r in K.fusion_features(df.where("id < 60"), "x", "f").select("id", "f").collect()}
    f, near = np.array([f[i] for i in range(60)]), np.array([named[i] for i in range(60)])
    means = np.array([f[near == c].mean(0) for c in range(3)])
    d2 = ((f[:, None] - means) ** 2).sum(2)
    assert near.tolist() == d2.argmin(1).tolist()
    assert fusion.distances(fusion.parts(x, 16, 3), 91, centers) == pytest.approx(d2, rel=1e-8, abs=1e-6)
    middle = fusion.medians(packed, centers)
    assert all(middle[c] == pytest.approx(np.median(x[near == c], axis=0)) for c in range(3))

    def made(*_, **__):
        raise AssertionError("features were made")

    monkeypatch.setattr(K, "fusion_features", made)
    got = {r["id"]: r["cluster"] for r in K.sort_refined(df.where("id < 60"), "id", "x", 3, 30_000.0).collect()}
    assert len(got) == 60 and len({(got[i], i % 3) for i in range(60)}) == 3


def test_rolls_are_those_of_best_shift(spark):
    rng = np.random.default_rng(14)
    x, t = rng.normal(size=(40, 91)), rng.normal(size=91)
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "id int, x array<double>")
    want = {r["id"]: r["aligned"] for r in K.align_waveforms(df, "x", t.tolist(), 6).collect()}
    got = fusion._aligned(x, t, 6)
    assert all(got[i].tolist() == want[i] for i in range(40))
