"""Queries on all 8 channels of the windows, against numpy on a small table."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewright.functions import spd
from tidewright.operators import classify as C

N = 43


def apply(m, f):
    w, v = np.linalg.eigh(m)
    return (v * f(w)) @ v.T


def cov(x):
    c = x.T @ x / len(x)
    return c + 1e-6 * np.trace(c) / 8 * np.eye(8)


def airm(a, b):
    return np.sqrt((np.log(np.linalg.eigvals(np.linalg.solve(a, b)).real) ** 2).sum())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """(folder, windows, labels): the labels differ in channels 3 to 8 only."""
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 3, N)
    x = np.array([rng.normal(size=(64, 8)) * 0.6 * np.where(np.arange(8) // 2 == k + 1, 1.25, 1) for k in labels])
    sf = str(tmp_path_factory.mktemp("windows"))
    spark.createDataFrame([(i, int(k), w.tolist()) for i, (k, w) in enumerate(zip(labels, x))], "window_id bigint, y_train int, x_train array<array<double>>").write.parquet(f"{sf}/geoknn_windows.parquet")
    return sf, x, labels


def matrices_of(spark, sf, name, key="id"):
    out = {}
    for r in entry.queries()[name](spark, sf).collect():
        out.setdefault(r[key], {})[r["k"]] = r["v"]
    return {i: np.array([v[k] for k in range(len(v))]) for i, v in out.items()}


@pytest.mark.parametrize("name, f", [("logm", np.log), ("expm", np.exp), ("sqrtm", lambda w: w**-0.5)])
def test_matrix_functions(spark, table, name, f):
    sf, x, _ = table
    got = matrices_of(spark, sf, f"{name}_windows")
    assert len(got) == N and all(np.allclose(got[i], apply(cov(w), f).ravel(), atol=2e-6) for i, w in enumerate(x))


def test_distances_of_halves(spark, table):
    sf, x, _ = table
    le, ai = ({r["id"]: r["d"] for r in entry.queries()[f"{n}_dist_windows"](spark, sf).collect()} for n in ("logeuclid", "airm"))
    for i, w in enumerate(x):
        a, b = cov(w[:32]), cov(w[32:])
        assert le[i] == pytest.approx(np.linalg.norm(apply(a, np.log) - apply(b, np.log)), abs=2e-6) and ai[i] == pytest.approx(airm(a, b), abs=2e-6)


def test_means(spark, table):
    sf, x, labels = table
    logs = np.array([apply(cov(w), np.log) for w in x])
    means = {k: logs[labels == k].mean(0) for k in range(3)}
    got = matrices_of(spark, sf, "le_mean_windows", "label")
    assert all(np.allclose(got[k], apply(m, np.exp).ravel(), atol=2e-6) for k, m in means.items())
    named = {r["id"]: r["predicted"] for r in entry.queries()["mdm_predict_windows"](spark, sf).collect()}
    assert named == {i: min(means, key=lambda k: np.linalg.norm(m - means[k])) for i, m in enumerate(logs)}


def voted(d, labels, may):
    near = sorted(may, key=lambda j: (d[j], j))[:5]
    s, w = max(np.median(d[near]), 1e-12), {}
    for j in near:
        w[labels[j]] = w.get(labels[j], 0) + np.exp(-(d[j] ** 2) / (2 * s * s))
    return max(w, key=w.get)


def test_neighbours(spark, table):
    sf, x, labels = table
    c = [cov(w) for w in x]
    got = {r["qid"]: r["predicted"] for r in entry.queries()["geoknn_windows_predict_airm"](spark, sf).collect()}
    assert got == {i: voted(np.array([airm(c[i], b) for b in c]), labels, [j for j in range(N) if j != i]) for i in range(0, N, 20)}
    logs = np.array([apply(m, np.log) for m in c])
    folds = np.repeat(np.arange(5), [9, 9, 9, 8, 8])
    right = np.array([voted(np.linalg.norm(logs - logs[i], axis=(1, 2)), labels, np.flatnonzero(folds != folds[i])) == labels[i] for i in range(N)])
    cv = {r["fold"]: (r["n"], r["accuracy"]) for r in entry.queries()["geoknn_windows_cv5"](spark, sf).collect()}
    assert cv == {k: ((folds == k).sum(), pytest.approx(right[folds == k].mean(), abs=1e-6)) for k in range(5)}


def test_tangents_at_the_mean(spark, table):
    sf, x, _ = table
    got = matrices_of(spark, sf, "tangent_map")
    t = np.array([got[i] for i in range(N)])
    assert t.shape == (N, 36) and np.abs(t.mean(0)).max() < 1e-5
    mean = apply(np.mean([apply(cov(w), np.log) for w in x], axis=0), np.exp)
    for _ in range(30):
        half, back = apply(mean, lambda w: w**-0.5), apply(mean, np.sqrt)
        mean = back @ apply(np.mean([apply(half @ cov(w) @ half, np.log) for w in x], axis=0), np.exp) @ back
    assert np.allclose(np.linalg.norm(t, axis=1), [airm(mean, cov(w)) for w in x], atol=1e-5)


def test_affine_neighbours_get_few_eigenvalues(spark, monkeypatch):
    """Rows beyond the log-Euclidean bound get no eigenvalues, and the neighbours are those of all pairs; singular matrices are compared whole."""
    rng = np.random.default_rng(12)
    a = rng.normal(size=(120, 20, 4)) * rng.uniform(0.5, 2, (120, 1, 4))
    m = np.einsum("nti,ntj->nij", a, a) / 20
    m[7], m[8] = 0, np.outer(m[8, 0], m[8, 0])
    m[100:] = m[:20]
    neighbours = C.nearest_neighbours(*[spark.createDataFrame([(i, 0, x.ravel().tolist()) for i, x in enumerate(m)], "id int, label int, x array<double>")] * 2, 3, metric="airm", d=4, block=50)
    got = {}
    for r in neighbours.collect():
        got.setdefault(r["qid"], {})[r["place"]] = (r["tid"], r["d"])
    for i, x in enumerate(m):
        d = spd.airm_numpy(np.repeat(x[None], 120, 0), m)
        want = sorted((d[j], j) for j in range(120) if j != i)[:3]
        assert [got[i][p][1] for p in (1, 2, 3)] == pytest.approx([w[0] for w in want], abs=1e-6)
    asked = 0
    exact = np.linalg.eigvalsh

    def counted(x):
        nonlocal asked
        asked += len(x)
        return exact(x)

    monkeypatch.setattr(np.linalg, "eigvalsh", counted)
    i, j = np.triu_indices(4)
    frame = lambda name, block: pd.DataFrame({name: block, f"{name}x": list(m[block][:, i, j])})
    near = C.compared(frame("q", np.arange(20, 60)).assign(qf=None), frame("t", np.arange(60, 100)).assign(label=0, tf=None), 3, "airm", 4, False)
    assert len(near) == 120 and asked < 40 * 40 / 2
