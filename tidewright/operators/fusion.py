"""Fusion features kept as their parts, and k-means on them without the 4,000 numbers a waveform that they stand for.

The outer part of a waveform's features is vech(l I + g^2 x x'): two numbers and the samples. Its squared distance
to a center (a mean matrix S) is |l I + g^2 x x' - S|^2, which needs x' S x and the trace of S only.
Waveforms are packed: a row has the ids of some waveforms and one block of numbers (samples, g, l, delay tangent).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import spd
from tidewright.session import checkpointed

EPS, BLOCK = 1e-3, 2000


def parts(x: np.ndarray, dim: int, lag: int) -> np.ndarray:
    """One row (samples, g, l, delay tangent) for each row of ``x`` that isn't all zero."""
    length = x.shape[1]
    q = (x * x).sum(1)
    least = np.log(np.maximum(q * EPS / length, spd.FLOOR))
    gain = np.log(np.maximum(q + q * EPS / length, spd.FLOOR)) - least
    h = np.lib.stride_tricks.sliding_window_view(x, (dim - 1) * lag + 1, axis=1)[:, :, ::lag]
    m = np.swapaxes(h, 1, 2) @ h / h.shape[1]
    m += EPS * np.trace(m, axis1=1, axis2=2)[:, None, None] / dim * np.eye(dim)
    tangent = spd.vech(spd.apply_spectral(m, lambda w: np.log(np.maximum(w, spd.FLOOR))))
    return np.column_stack([x, np.sqrt(gain / q), least, tangent])


def _matrix(a: pa.Array) -> np.ndarray:
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


class Packed:
    """Packed waveforms: ``rows`` (ids, hash, block) of ``length`` samples each."""

    def __init__(self, rows: DataFrame, id_type: T.DataType, length: int, dim: int, lag: int):
        self.rows, self.id_type, self.length, self.dim, self.lag = rows, id_type, length, dim, lag


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(len(batch)):
            ids, h = (batch.column(c).slice(k, 1).flatten() for c in (0, 1))
            yield ids, h.to_numpy(), np.frombuffer(batch.column(2)[k].as_py()).reshape(len(ids), -1)


def _packed_batches(ids: pa.Array, h: pa.Array, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(ids), BLOCK):
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids[at : at + BLOCK], h[at : at + BLOCK])]
        yield pa.RecordBatch.from_arrays([*lists, pa.array([np.ascontiguousarray(block[at : at + BLOCK]).tobytes()], pa.binary())], names=["ids", "hash", "block"])


def _aligned(x: np.ndarray, templates: np.ndarray, max_shift: int) -> np.ndarray:
    """Each row of ``x`` rolled to fit its template best (one for all or one a row): the shifts of cluster.best_shift."""
    shifts = np.arange(-max_shift, max_shift + 1)
    fit = np.stack([np.round((x * np.roll(templates, -s, axis=-1)).sum(1), 9) for s in shifts], 1)
    best = shifts[fit.argmax(1)]  # the first of equal ones
    return np.take_along_axis(x, (np.arange(x.shape[1])[None] - best[:, None]) % x.shape[1], 1)


def pack(df: DataFrame, id_col: str, wf: str, template: Sequence[float], max_shift: int, dim: int = 16, lag: int = 3) -> Packed:
    """The waveforms that aren't null or all zero, aligned to the template."""
    id_type, t = df.schema[id_col].dataType, np.array(template, float)
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("hash", T.ArrayType(T.LongType())), T.StructField("block", T.BinaryType())])

    def run(batches):
        for batch in batches:
            x = _aligned(_matrix(batch.column(2)), t, max_shift)
            some = np.flatnonzero((x * x).sum(1) > 0)
            if len(some):
                yield from _packed_batches(batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), parts(x[some], dim, lag))

    rows = df.where(F.col(wf).isNotNull()).select(id_col, F.xxhash64(id_col), wf).mapInArrow(run, schema)
    return Packed(checkpointed(rows), id_type, len(t), dim, lag)


class Center:
    """A mean of features: the mean matrix of the outer part and the mean delay tangent."""

    def __init__(self, outer: np.ndarray, tangent: np.ndarray):
        self.outer, self.tangent = outer, tangent

    def moved(self, other: Center) -> float:
        return float(np.sqrt(((self.outer - other.outer) ** 2).sum() + ((self.tangent - other.tangent) ** 2).sum()))


def of_row(row: np.ndarray, length: int) -> Center:
    x, g, least = row[:length] * row[length], row[length], row[length + 1]
    return Center(np.outer(x, x) + least * np.eye(length), row[length + 2 :])


def distances(block: np.ndarray, length: int, centers: Sequence[Center]) -> np.ndarray:
    """Squared distances (rows, centers) of fusion features."""
    s, least, tangent = block[:, :length] * block[:, length, None], block[:, length + 1], block[:, length + 2 :]
    q = (s * s).sum(1)
    own = length * least**2 + 2 * least * q + q * q + (tangent * tangent).sum(1)
    out = np.empty((len(block), len(centers)))
    for k, c in enumerate(centers):
        met = least * np.trace(c.outer) + ((s @ c.outer) * s).sum(1) + tangent @ c.tangent
        out[:, k] = own - 2 * met + (c.outer**2).sum() + (c.tangent**2).sum()
    return np.maximum(out, 0)


def _uniform(h: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in (0, 1) for each hash, seed and turn (splitmix64)."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed * 64 + turn + 1)) % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2**53


def _starts(p: Packed, few: DataFrame, k: int, seeds: Sequence[int]) -> list[list[Center]]:
    """k-means++ over all rows: the next center is drawn by squared distance, as the least of exponential numbers of these rates."""
    length, found = p.length, [[] for _ in seeds]
    for turn in range(k):

        def run(batches, turn=turn):
            best = {}
            for _, h, block in _blocks(batches):
                for n, (seed, own) in enumerate(zip(seeds, found)):
                    rate = distances(block, length, own).min(1) if own else np.ones(len(block))
                    key = -np.log(_uniform(h, seed, turn)) / np.maximum(rate, 1e-300)
                    at = key.argmin()
                    if n not in best or key[at] < best[n][0]:
                        best[n] = (float(key[at]), block[at].tolist())
            if best:
                yield pa.RecordBatch.from_pydict({"seed": pa.array([*best], pa.int32()), "key": [v[0] for v in best.values()], "row": [v[1] for v in best.values()]})

        got = few.mapInArrow(run, "seed int, key double, row array<double>").collect()  # one row a seed and task
        for n, own in enumerate(found):
            own.append(of_row(np.array(min((r for r in got if r["seed"] == n), key=lambda r: r["key"])["row"]), length))
    return found


def kmeans(p: Packed, k: int, seeds: Sequence[int] = range(10), max_iter: int = 50, tol: float = 1e-4) -> list[Center]:
    """Centers of least cost among the seeds: k-means++ and Lloyd's iteration, all seeds side by side in one pass a round.

    A task sends k sums a seed to the driver; there are as many tasks as cores. Seeds that meet in the same
    centers go on as one.
    """
    length, upper = p.length, np.triu_indices(p.length)
    few = p.rows.coalesce(p.rows.sparkSession.sparkContext.defaultParallelism)
    if not few.take(1):
        return []
    now, done = _starts(p, few, k, seeds), []
    for turn in range(max_iter + 1):

        def run(batches):
            sums: dict = {}
            for _, _, block in _blocks(batches):
                d = distances(block, length, [c for own in now for c in own]).reshape(len(block), len(now), k)
                s = block[:, :length] * block[:, length, None]
                for n in range(len(now)):
                    near, least = d[:, n].argmin(1), d[:, n].min(1)
                    for c in range(k):
                        m = near == c
                        if m.any():
                            outer = (s[m].T @ s[m] + block[m, length + 1].sum() * np.eye(length))[upper]
                            sums[n, c] = sums.get((n, c), 0) + np.concatenate([[m.sum(), least[m].sum()], block[m, length + 2 :].sum(0), outer])
            if sums:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * len(next(iter(sums.values()))), pa.int32()), pa.array(np.concatenate([*sums.values()])))
                yield pa.RecordBatch.from_arrays([pa.array([n * k + c for n, c in sums], pa.int32()), lists], names=["at", "sums"])

        total: dict = {}
        for r in few.mapInArrow(run, "at int, sums array<double>").collect():
            total[r["at"]] = total.get(r["at"], 0) + np.array(r["sums"])
        going: list[list[Center]] = []
        for n, own in enumerate(now):
            new = list(own)  # a center without rows stays
            for c in range(k):
                if (v := total.get(n * k + c)) is not None:
                    m = np.zeros((length, length))
                    m[upper] = v[len(v) - len(upper[0]) :] / v[0]
                    new[c] = Center(m + np.triu(m, 1).T, v[2 : len(v) - len(upper[0])] / v[0])
            cost = sum(v[1] for c in range(k) if (v := total.get(n * k + c)) is not None)
            if turn == max_iter or max(a.moved(b) for a, b in zip(own, new)) <= tol:
                done.append((cost, own))
            elif not any(all(min(a.moved(b) for b in other) <= 1e-9 for a in new) for other in going):
                going.append(new)
        now = going
        if not now:
            break
    return min(done, key=lambda x: x[0])[1]


def _assigned(p: Packed, centers: Sequence[Center]) -> Callable:
    length = p.length

    def run(batches):
        for ids, h, block in _blocks(batches):
            yield ids, h, block, distances(block, length, centers).argmin(1)

    return run


def labelled(p: Packed, centers: Sequence[Center], id_col: str) -> DataFrame:
    """(id, x, cluster) of packed waveforms."""
    assigned, length = _assigned(p, centers), p.length
    schema = T.StructType([T.StructField(id_col, p.id_type), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.IntegerType())])

    def run(batches):
        for ids, _, block, near in assigned(batches):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * length, pa.int32()), pa.array(block[:, :length].ravel()))
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array(near, pa.int32())], names=[id_col, "x", "cluster"])

    return p.rows.mapInArrow(run, schema)


def medians(p: Packed, centers: Sequence[Center]) -> dict[int, np.ndarray]:
    """The median waveform of each cluster; one task holds the values of a cluster at one sample."""
    assigned, length = _assigned(p, centers), p.length

    def cut(batches):
        for _, _, block, near in assigned(batches):
            for c in np.unique(near):
                own = block[near == c, :length].T
                yield pa.RecordBatch.from_pydict({"c": pa.array([c] * length, pa.int32()), "pos": pa.array(range(length), pa.int32()), "v": [np.ascontiguousarray(v).tobytes() for v in own]})

    def middle(table: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(table["v"].to_pylist()))
        return pa.table({"c": table["c"][:1], "pos": table["pos"][:1], "m": pa.array([float(np.median(v))])})

    got = p.rows.mapInArrow(cut, "c int, pos int, v binary").groupBy("c", "pos").applyInArrow(middle, "c int, pos int, m double").collect()  # one number a cluster and sample
    out: dict[int, np.ndarray] = {}
    for r in got:
        out.setdefault(r["c"], np.zeros(length))[r["pos"]] = r["m"]
    return out


def realigned(p: Packed, centers: Sequence[Center], templates: dict[int, np.ndarray], max_shift: int) -> Packed:
    """Each waveform rolled to fit the template of its cluster best."""
    assigned, length, dim, lag = _assigned(p, centers), p.length, p.dim, p.lag
    table = np.array([templates.get(c, np.zeros(length)) for c in range(len(centers))])

    def run(batches):
        for ids, h, block, near in assigned(batches):
            yield from _packed_batches(ids, pa.array(h), parts(_aligned(block[:, :length], table[near], max_shift), dim, lag))

    return Packed(checkpointed(p.rows.mapInArrow(run, p.rows.schema)), p.id_type, length, dim, lag)
