import numpy as np
import pytest

from tidewright.plans import experiments as X


def test_bias_shrinks_with_trials_and_correction(spark):
    got = {(r["method"], r["trials"]): r["bias"] for r in X.information_bias(spark, 4, (5, 40), 2).collect()}
    assert got["plugin", 5] > got["plugin", 40] > 0
    assert abs(got["miller_madow", 5]) < got["plugin", 5]


def test_exact_values(spark):
    t = {r["neuron"]: r["truth"] for r in X.true_information(spark, 4).collect()}
    assert t[0] == pytest.approx(0, abs=1e-12) and t[3] > t[2] > t[1] > 0
    assert X.true_synergy(spark, 0.0, 4, 0.9, 4) == pytest.approx(0, abs=1e-9)
    assert X.true_synergy(spark, 1.0, 8, 1.0, 8) == pytest.approx(-3)


def test_sorting_experiment(spark):
    s = X.spike_sorting(spark, 12.0, 0.0, seconds=2.0)
    assert s["recall"] > 0.8 and s["precision"] > 0.7 and max(s["pca_ari"], s["spd_ari"]) > 0.4


def test_small_helpers():
    assert X.winner({"a": 0.5, "b": 0.505}) == "tie" and X.winner({"a": 0.9, "b": 0.5}) == "a"
    k = [0.5, 0.25, 0.25]
    h = np.array([np.roll([*k, 0, 0], i) for i in range(5)]).T
    order = lambda z: sorted(z, key=lambda v: (round(v.real, 9), round(v.imag, 9)))
    assert order(np.linalg.eigvals(h)) == pytest.approx(order(X.circulant_spectrum(k, 5)))
