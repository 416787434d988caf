"""Functions of symmetric positive definite matrices, batched by Arrow over numpy's symmetric eigensolver.

Matrices are flattened row by row. Eigenvalues are floored at 1e-12. A null matrix gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOOR = 1e-12
DOUBLES = T.ArrayType(T.DoubleType())


def _stack(col: pd.Series, d: int) -> np.ndarray:
    return np.array(col.tolist(), dtype=float).reshape(-1, d, d)


def apply_spectral(m: np.ndarray, f) -> np.ndarray:
    """V f(w) V' for a stack of symmetric matrices."""
    w, v = np.linalg.eigh(m)
    return (v * f(w)[:, None, :]) @ np.swapaxes(v, 1, 2)


def vech(m: np.ndarray) -> np.ndarray:
    d = m.shape[1]
    i, j = np.triu_indices(d)
    return m[:, i, j] * np.where(i == j, 1.0, np.sqrt(2.0))


def unvech(t: np.ndarray, d: int) -> np.ndarray:
    i, j = np.triu_indices(d)
    out = np.zeros((len(t), d, d))
    out[:, i, j] = out[:, j, i] = t / np.where(i == j, 1.0, np.sqrt(2.0))
    return out


def _mapped(d: int, work):
    """A pandas UDF that gives ``work`` the stack of non-null matrices and puts nulls back."""

    @F.pandas_udf(DOUBLES)
    def udf(col: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(col), index=col.index, dtype=object)
        here = col.notna()
        if here.any():
            got = work(_stack(col[here], d))
            out[here] = pd.Series(list(got.reshape(len(got), -1)), index=col.index[here])
        return out

    return udf.asNondeterministic()  # else filters on the result are pushed below it and compute it again


def with_tangent(df: DataFrame, matrix: str, d: int, out: str) -> DataFrame:
    """``df`` with ``out``: the tangent features of a matrix column, null for null.

    For matrices that nested lambdas make: an Arrow function over them can't be planned once the optimizer
    has put the lambdas into its argument, whereas a map over the rows is never merged with its input.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, DOUBLES)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            t = np.full(len(pdf), None, dtype=object)
            rows = np.flatnonzero(pdf[matrix].notna().to_numpy())
            if len(rows):
                got = vech(apply_spectral(_stack(pdf[matrix].iloc[rows], d), lambda w: np.log(np.maximum(w, FLOOR))))
                for r, v in zip(rows, got):
                    t[r] = v
            yield pdf.assign(**{out: t})

    return df.mapInPandas(run, schema)


def logm(m: Column, d: int) -> Column:
    return _mapped(d, lambda s: apply_spectral(s, lambda w: np.log(np.maximum(w, FLOOR))))(m)


def expm(m: Column, d: int) -> Column:
    return _mapped(d, lambda s: apply_spectral(s, np.exp))(m)


def powm(m: Column, d: int, power: float) -> Column:
    return _mapped(d, lambda s: apply_spectral(s, lambda w: np.maximum(w, FLOOR) ** power))(m)


def tangent(m: Column, d: int) -> Column:
    """vech of the matrix logarithm: Euclidean distance of two is the log-Euclidean distance of the matrices."""
    return _mapped(d, lambda s: vech(apply_spectral(s, lambda w: np.log(np.maximum(w, FLOOR)))))(m)


def from_tangent(t: Column, d: int) -> Column:
    """The matrix whose tangent features these are."""

    @F.pandas_udf(DOUBLES)
    def udf(col: pd.Series) -> pd.Series:
        got = apply_spectral(unvech(np.array(col.tolist(), dtype=float).reshape(len(col), -1), d), np.exp)
        return pd.Series(list(got.reshape(len(got), -1)))

    return udf.asNondeterministic()(t)


def tangent_at(m: Column, reference: np.ndarray) -> Column:
    """vech log(R^-1/2 M R^-1/2): tangent features at a reference matrix R (d x d, one small matrix)."""
    d = len(reference)
    half = apply_spectral(reference[None], lambda w: np.maximum(w, FLOOR) ** -0.5)[0]
    return _mapped(d, lambda s: vech(apply_spectral(half @ s @ half, lambda w: np.log(np.maximum(w, FLOOR)))))(m)


def airm_numpy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    half = apply_spectral(a, lambda w: np.maximum(w, FLOOR) ** -0.5)
    w = np.linalg.eigvalsh(half @ b @ half)
    return np.sqrt((np.log(np.maximum(w, FLOOR)) ** 2).sum(1))


def airm_distance(a: Column, b: Column, d: int) -> Column:
    """Affine-invariant distance sqrt(sum log^2 eig(A^-1 B)), by whitening."""

    @F.pandas_udf(T.DoubleType())
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(airm_numpy(_stack(x, d), _stack(y, d)))

    return udf(a, b)


def register(spark: SparkSession, d: int) -> None:
    """SQL functions logm_spd, expm_sym, tangent_spd and airm_distance for d x d matrices."""
    spark.udf.register("logm_spd", _mapped(d, lambda s: apply_spectral(s, lambda w: np.log(np.maximum(w, FLOOR)))))
    spark.udf.register("expm_sym", _mapped(d, lambda s: apply_spectral(s, np.exp)))
    spark.udf.register("tangent_spd", _mapped(d, lambda s: vech(apply_spectral(s, lambda w: np.log(np.maximum(w, FLOOR))))))

    @F.pandas_udf(T.DoubleType())
    def airm(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(airm_numpy(_stack(x, d), _stack(y, d)))

    spark.udf.register("airm_distance", airm)
