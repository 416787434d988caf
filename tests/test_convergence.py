"""Iterations that end when their work is done, not after a few rounds."""

import datetime

import numpy as np
import pytest

import __spark_entry__ as entry


def test_perceptrons_learn_separable_groups(spark, tmp_path):
    rng, at = np.random.default_rng(9), datetime.datetime(2024, 1, 1)
    rows = []
    for user in range(4):
        for _ in range(60):
            hour, value = int(rng.integers(0, 24)), float(rng.uniform(0, 100))
            gap = value / 100 - 0.2 - hour / 48 - 0.03 * user
            if abs(gap) > 0.03:  # separable, but not within five turns
                rows.append((len(rows), user, at + datetime.timedelta(hours=hour), value, "purchase" if gap > 0 else "view"))
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    fit = entry.queries()["perceptron_fit"](spark, str(tmp_path)).collect()
    assert len(fit) == 4 and all(r["errors"] == 0 for r in fit) and max(r["turns"] for r in fit) > 5
    right = entry.queries()["perceptron_predict"](spark, str(tmp_path)).collect()
    assert all(r["accuracy"] == 1 for r in right)


def test_lloyd_converges_with_all_centers(spark, tmp_path):
    rng = np.random.default_rng(10)
    label = np.arange(200) % 5
    x = rng.normal(size=(200, 3)) + 1.5 * rng.normal(size=(5, 3))[label]
    spark.createDataFrame([(i, w.tolist(), int(k)) for i, (w, k) in enumerate(zip(x, label))], "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: (r["cluster"], r["d2"]) for r in entry.queries()["kmeans_lloyd_converged"](spark, str(tmp_path)).collect()}
    c, rounds, moved = np.array([x[label == k].mean(0) for k in range(5)]), 0, 1.0
    while moved > 1e-12:
        near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[near == k].mean(0) for k in range(5)])
        c, moved, rounds = new, np.abs(new - c).max(), rounds + 1
    assert rounds > 4 and [got[i][0] for i in range(200)] == near.tolist()
    assert [got[i][1] for i in range(200)] == pytest.approx(((x - c[near]) ** 2).sum(1), abs=2e-6)
    assert 0 < entry.queries()["ari_converged"](spark, str(tmp_path)).first()["ari"] < 1
