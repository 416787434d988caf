"""Queries over the whole of their input, against numpy on small tables."""

import datetime

import numpy as np
import pytest

import __spark_entry__ as entry
from tidewright.plans.fourier import KERNEL


@pytest.fixture(scope="module")
def users(spark, tmp_path_factory):
    """(folder, values by user) of an events table whose users have 1, 3, 32, 70 and 1030 events."""
    rng, at, rows, series = np.random.default_rng(4), datetime.datetime(2024, 1, 1), [], {}
    for user, n in enumerate((1, 3, 32, 70, 1030)):
        series[user] = rng.normal(size=n)
        rows += [(len(rows) + i, user, at + datetime.timedelta(minutes=3 * i), float(v), '{"k": 3}') for i, v in enumerate(series[user])]
    sf = str(tmp_path_factory.mktemp("users"))
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, value double, props string").write.parquet(f"{sf}/events.parquet")
    return sf, series


def by_frame(spark, sf, name, cols=("p", "v")):
    out = {}
    for r in entry.queries()[name](spark, sf).collect():
        out.setdefault((r["user_id"], r["frame"]), []).append(tuple(r[c] for c in cols))
    return {k: np.array([x[1:] for x in sorted(v)]).squeeze(1) if len(cols) == 2 else np.array([complex(*x[1:]) for x in sorted(v)]) for k, v in out.items()}


def cyclic(x):
    n = max(len(x), len(KERNEL))
    return np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(KERNEL, n)).real


def low(x):
    z, k = np.fft.fft(x), np.arange(len(x))
    return np.fft.ifft(np.where(np.minimum(k, len(x) - k) / len(x) <= 0.125, z, 0)).real


@pytest.mark.parametrize(
    "name, work",
    [
        ("circ_conv", cyclic), ("circ_conv_fft", cyclic), ("circulant_apply", cyclic), ("circshift", lambda x: np.roll(x, 3)), ("linear_conv", lambda x: np.convolve(x, KERNEL)),
        ("deconv", lambda x: x), ("idft", lambda x: x), ("dft", np.fft.fft), ("fft", np.fft.fft), ("phase_shift", lambda x: np.fft.fft(np.roll(x, 3))), ("freq_filter", low),
    ],
)
def test_frames_of_whole_series(spark, users, name, work):
    sf, series = users
    got = by_frame(spark, sf, f"{name}_whole", ("k", "re", "im") if name in ("dft", "fft", "phase_shift") else ("p", "v"))
    want = {(u, k // 32): work(x[k : k + 32]) for u, x in series.items() for k in range(0, len(x), 32)}
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert len(got[k]) == len(x) and np.allclose(got[k], x, atol=2e-6)


@pytest.mark.parametrize("name, times", [("moving_avg5", 1), ("smooth_twice", 2)])
def test_smoothing_of_whole_series(spark, users, name, times):
    sf, series = users
    got = {(r["user_id"], r["frame"] * 32 + r["p"]): r["v"] for r in entry.queries()[f"{name}_whole"](spark, sf).collect()}
    assert len(got) == sum(map(len, series.values()))
    for u, x in series.items():
        for _ in range(times):
            x = np.concatenate([x[:2], np.convolve(x, np.ones(5) / 5, "valid"), x[-2:]]) if len(x) > 4 else x
        assert np.allclose([got[u, i] for i in range(len(x))], x, atol=2e-6)
