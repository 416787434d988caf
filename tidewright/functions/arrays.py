"""Array expressions on built-in higher-order functions: vectors, frames, matrices in row-major order.

All take columns of array<double>. A null array gives null; empty arrays give an empty array or 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column | str, work) -> Column:
    """work(value) with the value computed once, however often ``work`` uses it inside lambdas."""
    if isinstance(value, str):
        return work(F.col(value))
    return F.get(F.transform(F.array(value), work), F.lit(0))


def doubles(x: Column | str) -> Column:
    return _c(x).cast("array<double>")


def total(x: Column | str) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, e: a + e)


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def norm(x: Column | str) -> Column:
    return F.sqrt(dot(x, x))


def distance(x: Column | str, y: Column | str) -> Column:
    """Euclidean distance of two vectors of equal length."""
    return F.sqrt(total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b))))


def at(x: Column, i: Column) -> Column:
    """Element at a position counted from 0."""
    return F.get(x, i.cast("int"))


def _range(n: Column | int) -> Column:
    """0 .. n-1, empty for n <= 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def sound(x: Column | str, length: int | None = None) -> Column:
    """Whether an array has no null, NaN or infinite element (and ``length`` elements)."""
    c = _c(x)
    ok = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(ok & (F.size(c) == length) if length is not None else ok, F.lit(False))


def circshift(x: Column | str, k: int) -> Column:
    """Element i of the result is element i - k, cyclically."""
    return let(x, lambda c: F.transform(c, lambda e, i: at(c, F.pmod(i - k, F.size(c)))))


def circular_convolution(x: Column | str, y: Column | str) -> Column:
    """sum_j x[j] y[(i - j) mod n]; the shorter array is padded with zeros."""

    def work(a: Column, b: Column) -> Column:
        n = F.size(a)
        return F.transform(_range(n), lambda i: F.aggregate(_range(n), F.lit(0.0), lambda s, j: s + at(a, j) * at(b, F.pmod(i - j, n))))

    n = F.greatest(F.size(_c(x)), F.size(_c(y)))
    return let(padded(x, n), lambda a: let(padded(y, n), lambda b: work(a, b)))


def padded(x: Column | str, n: Column | int) -> Column:
    """The array with zeros behind it up to n elements."""
    c = _c(x)
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(c, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(c), F.lit(0))))


def linear_convolution(x: Column | str, y: Column | str) -> Column:
    """Full convolution of lengths n and m: n + m - 1 elements; empty if either is empty."""

    def work(a: Column, b: Column) -> Column:
        n, m = F.size(a), F.size(b)
        k = F.when((n > 0) & (m > 0), n + m - 1).otherwise(F.lit(0))
        return F.transform(_range(k), lambda i: F.aggregate(_range(m), F.lit(0.0), lambda s, j: s + at(b, j) * F.when((i - j >= 0) & (i - j < n), at(a, i - j)).otherwise(0.0)))

    return let(x, lambda a: let(y, lambda b: work(a, b)))


def deconvolution(y: Column | str, x: Column | str) -> Column:
    """The q with conv(q, x) = y, by polynomial long division; x must not start with 0 (null then)."""

    def work(a: Column, b: Column) -> Column:
        m = F.size(b)
        lead = F.nullif(at(b, F.lit(0)), F.lit(0.0))
        step = lambda q, i: F.concat(
            q, F.array((at(a, i) - F.aggregate(_range(F.least(i, m - 1)), F.lit(0.0), lambda s, j: s + at(b, j + 1) * at(q, i - 1 - j))) / lead)
        )
        return F.when(lead.isNotNull(), F.aggregate(_range(F.size(a) - m + 1), F.array().cast("array<double>"), step))

    return let(y, lambda a: let(x, lambda b: work(a, b)))


def dft(x: Column | str) -> Column:
    """Discrete Fourier transform: array<struct<re, im>>, by the definition (short frames; see signal.fft for long ones)."""

    def work(c: Column) -> Column:
        n = F.size(c)
        angle = lambda j, k: F.lit(-2 * math.pi) * F.pmod(j * k, n) / n
        part = lambda k, f: F.aggregate(_range(n), F.lit(0.0), lambda s, j: s + at(c, j) * f(angle(j, k)))
        return F.transform(_range(n), lambda k: F.struct(part(k, F.cos).alias("re"), part(k, F.sin).alias("im")))

    return let(x, work)


def inverse_dft(spectrum: Column | str) -> Column:
    """Real part of the inverse transform."""

    def work(c: Column) -> Column:
        n = F.size(c)
        angle = lambda j, k: F.lit(2 * math.pi) * F.pmod(j * k, n) / n
        value = lambda j: F.aggregate(_range(n), F.lit(0.0), lambda s, k: s + at(c, k)["re"] * F.cos(angle(j, k)) - at(c, k)["im"] * F.sin(angle(j, k))) / n
        return F.transform(_range(n), value)

    return let(spectrum, work)


def magnitude(spectrum: Column | str) -> Column:
    return F.transform(_c(spectrum), lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"]))


def phase(spectrum: Column | str) -> Column:
    return F.transform(_c(spectrum), lambda z: F.atan2(z["im"], z["re"]))


def band_filter(spectrum: Column | str, low: float, high: float) -> Column:
    """The spectrum with every bin whose frequency (cycles per sample, folded to 0..0.5) lies outside [low, high] set to 0."""
    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))

    def work(c: Column) -> Column:
        freq = lambda k: F.least(k, F.size(c) - k) / F.size(c)
        return F.transform(c, lambda z, k: F.when((freq(k) >= low) & (freq(k) <= high), z).otherwise(zero))

    return let(spectrum, work)


def moving_average(x: Column | str, half: int = 2) -> Column:
    """Mean of 2 half + 1 neighbours; the first and last ``half`` elements stay as they are."""
    window = 2 * half + 1
    return let(x, lambda c: F.transform(c, lambda e, i: F.when((i < half) | (i >= F.size(c) - half), e).otherwise(total(F.slice(c, i - half + 1, window)) / window)))


def hankel(x: Column | str, dim: int, lag: int) -> Column:
    """Time-delay rows x[i], x[i + lag], ...: array<array>; null where fewer than two rows fit."""
    if dim < 1 or lag < 1:
        raise ValueError("dim and lag must be positive")

    def work(c: Column) -> Column:
        n = F.size(c) - (dim - 1) * lag
        rows = F.transform(_range(n), lambda i: F.array(*[at(c, i + k * lag) for k in range(dim)]))
        return F.when(n >= 2, rows)

    return let(x, work)


def gram(rows: Column | str, d: int) -> Column:
    """R'R / T of an array of T rows with d numbers each, flattened.

    The upper triangle is summed in one pass over the rows; the lower one mirrors it.
    """
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    place = {p: k for k, p in enumerate(upper)}
    left, right = F.array(*[F.lit(i) for i, _ in upper]), F.array(*[F.lit(j) for _, j in upper])

    def work(r: Column) -> Column:
        products = lambda row: F.zip_with(left, right, lambda i, j: F.get(row, i) * F.get(row, j))
        zero = F.array_repeat(F.lit(0.0), len(upper))
        sums = F.aggregate(r, zero, lambda s, row: F.zip_with(s, products(row), lambda a, b: a + b))
        spread = F.array(*[F.lit(place[(min(i, j), max(i, j))]) for i in range(d) for j in range(d)])
        return F.when(F.size(r) > 0, let(sums, lambda s: F.transform(spread, lambda k: F.get(s, k) / F.size(r))))

    return let(rows, work)


def regularized(m: Column | str, d: int, eps: float) -> Column:
    """m + eps trace(m) / d on the diagonal."""
    trace = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), F.lit(0.0), lambda s, i: s + at(c, i * (d + 1)))
    added = lambda c, t: F.transform(c, lambda e, k: e + F.when(k % (d + 1) == 0, t * eps / d).otherwise(0.0))
    return let(m, lambda c: let(trace(c), lambda t: added(c, t)))


def outer(x: Column | str) -> Column:
    """x x', flattened."""
    return let(x, lambda c: F.flatten(F.transform(c, lambda a: F.transform(c, lambda b: a * b))))


def spd_embed(rows: Column | str, d: int, eps: float = 1e-6) -> Column:
    """Covariance-like matrix of a window (T rows of d channels), regularised to be positive definite."""
    return regularized(gram(rows, d), d, eps)


def outer_descriptor(x: Column | str, length: int, eps: float = 1e-3) -> Column:
    """x x' + eps trace / length; null for an all-zero vector."""
    return F.when(dot(x, x) > 0, regularized(outer(x), length, eps))


def outer_tangent(x: Column | str, length: int, eps: float = 1e-3, floor: float = 1e-12) -> Column:
    """Tangent features of outer_descriptor (vech of its logarithm) in closed form; null for an all-zero vector.

    x x' + e I has the eigenvalue |x|^2 + e along u = x / |x| and e across it, so its logarithm is
    log(e) I + (log(|x|^2 + e) - log(e)) u u'. Eigenvalues are floored as those of spd.tangent.
    """

    def work(c: Column, q: Column) -> Column:
        least = F.log(F.greatest(q * eps / length, F.lit(floor)))
        gain = (F.log(F.greatest(q + q * eps / length, F.lit(floor))) - least) / q
        cell = lambda a, b, j, l, g: F.when(j == 0, l + g * a * b).otherwise(g * a * b * math.sqrt(2))
        upper = lambda l, g: F.flatten(F.transform(c, lambda a, i: F.transform(F.slice(c, i + 1, F.size(c)), lambda b, j: cell(a, b, j, l, g))))
        return let(least, lambda l: let(gain, lambda g: upper(l, g)))

    return F.when(dot(x, x) > 0, let(x, lambda c: let(dot(c, c), lambda q: work(c, q))))


def delay_descriptor(x: Column | str, dim: int, lag: int, eps: float = 1e-3) -> Column:
    """H'H / n + eps trace / dim of the time-delay rows."""
    return regularized(gram(hankel(x, dim, lag), dim), dim, eps)


def vech(m: Column | str, d: int) -> Column:
    """Upper triangle row by row, off-diagonal elements times sqrt(2): keeps the Frobenius norm."""
    index = F.array(*[F.lit(i * d + j) for i in range(d) for j in range(i, d)]) if d <= 16 else F.filter(F.sequence(F.lit(0), F.lit(d * d - 1)), lambda k: k % d >= F.floor(k / d))
    return let(m, lambda c: F.transform(index, lambda k: at(c, k) * F.when(k % (d + 1) == 0, 1.0).otherwise(math.sqrt(2))))
