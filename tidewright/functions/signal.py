"""Vectorised signal functions for which built-in expressions are too slow or can't be written."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())


def _by_length(cols: list[pd.Series], work) -> list:
    """``work`` on matrices of the rows whose arrays have the same lengths; null where one is null, empty where all are empty."""
    out: list = [None] * len(cols[0])
    groups: dict[tuple, list[int]] = {}
    for k, arrays in enumerate(zip(*cols)):
        if all(a is not None for a in arrays):
            groups.setdefault(tuple(map(len, arrays)), []).append(k)
    for lengths, rows in groups.items():
        done = work(*[np.array([c.iloc[k] for k in rows], dtype=float) for c in cols]) if max(lengths) else [[]] * len(rows)
        for k, r in zip(rows, done):
            out[k] = r
    return out


def fft(x: Column) -> Column:
    """Fast Fourier transform of arrays of any length: array<struct<re, im>>; arrays of one length are transformed together."""

    @F.pandas_udf("re array<double>, im array<double>")
    def udf(col: pd.Series) -> pd.DataFrame:
        z = _by_length([col], lambda a: np.fft.fft(a, axis=1))
        return pd.DataFrame({"re": [None if v is None else np.real(v) for v in z], "im": [None if v is None else np.imag(v) for v in z]})

    z = udf.asNondeterministic()(x)
    return F.arrays_zip(z["re"].alias("re"), z["im"].alias("im"))


def circular_convolution_fft(x: Column, y: Column) -> Column:
    """Circular convolution by the transform; the shorter array is padded with zeros."""

    def work(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = max(a.shape[1], b.shape[1])
        return np.fft.ifft(np.fft.fft(a, n, axis=1) * np.fft.fft(b, n, axis=1), axis=1).real

    @F.pandas_udf(DOUBLES)
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_by_length([a, b], work))

    return udf.asNondeterministic()(x, y)


def spectrogram(x: Column, width: int = 128, overlap: int = 120, n_fft: int = 256) -> Column:
    """Magnitudes of Hamming-windowed frames, one array of n_fft / 2 + 1 values per frame; empty for shorter signals."""
    if not 0 <= overlap < width <= n_fft:
        raise ValueError("need 0 <= overlap < width <= n_fft")

    @F.pandas_udf(T.ArrayType(DOUBLES))
    def udf(col: pd.Series) -> pd.Series:
        w = np.hamming(width)

        def work(a: np.ndarray) -> list:
            if a.shape[1] < width:
                return [[]] * len(a)
            frames = np.lib.stride_tricks.sliding_window_view(a, width, axis=1)[:, :: width - overlap]
            return [list(m) for m in np.abs(np.fft.rfft(frames * w, n_fft, axis=2))]

        return pd.Series(_by_length([col], work))

    return udf.asNondeterministic()(x)


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital low pass; ``cutoff`` as a share of the Nyquist frequency.

    Analogue poles on the left half circle at the pre-warped cutoff, carried over by the bilinear transform
    s = 2 (z - 1) / (z + 1); all zeros at z = -1; gain 1 at frequency 0.
    """
    warped = 2 * math.tan(math.pi * cutoff / 2)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    digital = (2 + poles) / (2 - poles)
    a = np.real(np.poly(digital))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


def _filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Direct form II transposed along the columns of x (signals are rows)."""
    z = start.copy()
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        v = x[:, t]
        y = b[0] * v + z[0]
        for k in range(len(z) - 1):
            z[k] = b[k + 1] * v + z[k + 1] - a[k + 1] * y
        z[-1] = b[-1] * v - a[-1] * y
        out[:, t] = y
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension at both ends; rows of x are signals of one length."""
    n, order = x.shape[1], len(a) - 1
    pad = min(3 * (order + 1), n - 1)
    left, right = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    full = np.concatenate([left, x, right], axis=1)
    # the state that a constant input of 1 keeps
    companion = np.zeros((order, order))
    companion[:, 0] = -a[1:]
    companion[np.arange(order - 1), np.arange(1, order)] = 1
    steady = np.linalg.solve(np.eye(order) - companion, b[1:] - a[1:] * b[0])
    forward = _filtered(b, a, full, steady[:, None] * full[:, 0])
    backward = _filtered(b, a, forward[:, ::-1], steady[:, None] * forward[:, -1])[:, ::-1]
    return backward[:, pad : pad + n]


def lowpass(x: Column, cutoff_hz: float, fs: float, order: int = 3) -> Column:
    """Zero-phase Butterworth low pass; a cutoff at or above the Nyquist frequency leaves signals as they are."""
    if cutoff_hz >= fs / 2:
        return x
    b, a = butterworth(order, cutoff_hz / (fs / 2))

    @F.pandas_udf(DOUBLES)
    def udf(col: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(col), dtype=object)
        lengths = col.map(lambda v: -1 if v is None else len(v))
        for n in lengths.unique():
            rows = np.flatnonzero(lengths.to_numpy() == n)
            if n == 0:
                out.iloc[rows] = pd.Series([[] for _ in rows], index=out.index[rows])
            elif n > 0:
                x_ = np.array(col.iloc[rows].tolist(), dtype=float)
                got = zero_phase(b, a, x_) if n > 1 else x_
                out.iloc[rows] = pd.Series(list(got), index=out.index[rows])
        return out

    return udf.asNondeterministic()(x)
