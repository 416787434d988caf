"""The k most similar vectors of every vector, by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts; a small linear softmax learns
which part a vector belongs to. Parts number as many as the vectors need: beyond what one classifier
tells apart, every part gets a classifier of its own, fitted by Spark on a sample of that part. Every vector is
indexed in its most probable part. A query is routed to several probable parts. How many depends on what
is asked: within a distance bound, all parts that a vector so near could have been indexed in; without
one, as many as reach the wanted recall on the sample.

Within a distance bound only sketches move: 16-bit numbers of a random projection (of the vector itself where
it is short). Pairs whose sketches are near enough are reranked by the exact distance of the whole vectors.
Without a bound the whole vectors are ranked in the parts.

Equal vectors are indexed once, with their smallest ids, so a large group of copies costs nothing more.
A large part is split into blocks that meet every query of the part, so no task holds a whole part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import checkpointed, fitting_broadcast

SAMPLE_ROWS = 4096
PART_ROWS = 5000
TOP_PARTS = 256
BLOCK_ROWS = 8000
BLOCK_BYTES = 16_000_000
SKETCH = 48
DENSE = 64
HALF_MAX = 6e4


@dataclass
class Router:
    """Standardisation and a linear softmax over parts; ``probes`` parts reach the wanted recall on the sample."""

    mean: np.ndarray
    scale: float
    weight: np.ndarray
    bias: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def reach(self, x: np.ndarray, step: float, both: bool) -> np.ndarray:
        """Which parts a vector no further than ``step`` along any direction may be indexed in (rows x parts).

        A step of length r changes the lead of the best part over part p by at most r |w_best - w_p|. Where
        ``both`` vectors of a pair ask, half the bound is enough: the leads of their own parts add up to what the
        step between them changes, so one of the two is within its half.
        """
        z = self.scores(x)
        top = z.argmax(1)
        apart = np.linalg.norm(self.weight.T[:, None, :] - self.weight.T[None, :, :], axis=2)
        return z.max(1, keepdims=True) - z <= step / self.scale / (2 if both else 1) * apart[top] + 1e-9

    def best(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x)
        order = np.argsort(-z, axis=1, kind="stable")[:, : self.probes]
        out = np.zeros(z.shape, bool)
        np.put_along_axis(out, order, True, 1)
        return out


@dataclass
class Space:
    """Standardisation by the sample, and a random projection onto SKETCH directions for longer vectors."""

    mean: np.ndarray
    scale: float

    def sketch(self, x: np.ndarray) -> np.ndarray:
        z, n = (x - self.mean) / self.scale, len(self.mean)
        if n <= SKETCH:
            return z
        return z @ np.linalg.qr(np.random.default_rng(n).normal(size=(n, SKETCH)))[0]

    def kept(self) -> float:
        """Largest share of a squared distance that the projection keeps: its mean and five standard deviations."""
        n = len(self.mean)
        if n <= SKETCH:
            return 1.0
        return min(1.0, SKETCH / n + 5 * math.sqrt(2 * SKETCH * (n - SKETCH) / (n * n * (n + 2))))


@dataclass
class Tree:
    """Routers of one or two levels over sketches; leaf = part of the top router * width + part of its own router."""

    space: Space
    top: Router
    children: list[Router | None]
    width: int

    def home(self, s: np.ndarray) -> np.ndarray:
        top = self.top.scores(s).argmax(1)
        sub = np.zeros(len(s), np.int64)
        for t in np.unique(top) if self.width > 1 else ():
            if self.children[t] is not None:
                sub[top == t] = self.children[t].scores(s[top == t]).argmax(1)
        return top * self.width + sub

    def probe(self, s: np.ndarray, max_distance: float | None, both: bool, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row asks.

        In many dimensions a step seldom points along one direction: beyond 16 it counts as four standard
        deviations of an even step.
        """
        step = None if max_distance is None else max_distance / self.space.scale * min(1.0, 4 / math.sqrt(len(self.space.mean)))
        asked = lambda r, x, half: np.ones((len(x), len(r.bias)), bool) if exact else r.best(x) if step is None else r.reach(x, step, half)
        rows, tops = np.nonzero(asked(self.top, s, both and self.width == 1))
        if self.width == 1:
            return rows, tops
        out_r, out_l = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in np.unique(tops):
            mine = rows[tops == t]
            r, c = (np.arange(len(mine)), np.zeros(len(mine), np.int64)) if self.children[t] is None else np.nonzero(asked(self.children[t], s[mine], False))
            out_r.append(mine[r])
            out_l.append(t * self.width + c)
        rows, leaves = np.concatenate(out_r), np.concatenate(out_l)
        order = np.argsort(rows, kind="stable")
        return rows[order], leaves[order]


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, in blocks of 256 rows."""
    out, norms = np.empty((len(x), k), np.int32), (x**2).sum(1)
    for at in range(0, len(x), 256):
        d = norms[None] - 2 * x[at : at + 256] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 256] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def cut_graph(x: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Balanced parts of a neighbour graph: median cuts along main directions, then moves that put more neighbours together.

    A move needs a gain and room: no part grows beyond 1.1 times its even share.
    """
    n = len(x)
    label = np.zeros(n, int)
    pieces = [(np.arange(n), parts, 0)]
    while pieces:
        ids, p, first = pieces.pop()
        label[ids] = first
        if p == 1:
            continue
        y = x[ids] - x[ids].mean(0)
        v = np.ones(y.shape[1]) / math.sqrt(y.shape[1])
        for _ in range(12):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        order = np.argsort(y @ v, kind="stable")
        cut = len(ids) * (p // 2) // p
        pieces += [(ids[order[:cut]], p // 2, first), (ids[order[cut:]], p - p // 2, first + p // 2)]
    room = math.ceil(1.1 * n / parts)
    size = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        for j in range(neighbours.shape[1]):
            np.add.at(votes, (np.arange(n), label[neighbours[:, j]]), 1)
            np.add.at(votes, (neighbours[:, j], label), 1)
        gain = votes.max(1) - votes[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            to = int(votes[i].argmax())
            if gain[i] <= 0:
                break
            if size[to] < room and to != label[i]:
                size[label[i]] -= 1
                size[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


def fit_router(s: np.ndarray, near: np.ndarray, parts: int, k: int, target_recall: float, seed: int = 3) -> Router:
    """Cut the sample's neighbour graph and train the classifier on each vector's own and its neighbours' parts."""
    n, d = s.shape
    if parts <= 1 or n <= 4 * parts:
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), 1)
    mean, scale = s.mean(0), float(s.std()) or 1.0
    s = (s - mean) / scale
    label = cut_graph(s, near, parts)
    soft = np.zeros((n, parts))
    soft[np.arange(n), label] += 1
    for j in range(near.shape[1]):
        soft[np.arange(n), label[near[:, j]]] += 1 / near.shape[1]
    soft /= soft.sum(1, keepdims=True)
    rng = np.random.default_rng(seed)
    w, b, mw, mb = np.zeros((d, parts)), np.zeros(parts), 0.0, 0.0
    for epoch in range(40):
        rate = 0.5 * (1 - epoch / 40) / math.sqrt(d)
        for rows in np.array_split(rng.permutation(n), max(1, n // 128)):
            z = s[rows] @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - soft[rows]) / len(rows)
            mw, mb = 0.9 * mw + s[rows].T @ g + 1e-5 * w, 0.9 * mb + g.sum(0)
            w, b = w - rate * mw, b - rate * mb
    z = s @ w + b
    home, rank = z.argmax(1), np.argsort(np.argsort(-z, axis=1, kind="stable"), axis=1)
    asked = rng.permutation(n)[:512]
    place = np.concatenate([rank[i, home[near[i, :k]]] for i in asked])
    probes = next(m for m in range(1, parts + 1) if (place < m).mean() >= target_recall or m == parts)
    return Router(mean, scale, w, b, probes)


def dense_rows(col: pa.Array, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the usable rows of a column of arrays, or of arrays of arrays: of the given shape, all finite, not all zero."""
    at = np.flatnonzero(np.asarray(col.value_lengths().fill_null(-1)) == shape[0])
    col = col.take(pa.array(at))
    values = col.flatten()
    if len(shape) == 2:
        good = (np.asarray(values.value_lengths().fill_null(-1)).reshape(-1, shape[0]) == shape[1]).all(1)
        at, values = at[good], col.filter(pa.array(good)).flatten().flatten()
    x = values.to_numpy(zero_copy_only=False).astype(float).reshape(len(at), math.prod(shape)) + 0.0
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


def _names(x: np.ndarray) -> np.ndarray:
    """128 bits of hash of each row, as two numbers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in x), dtype=np.int64).reshape(-1, 2)


def _encode(x: np.ndarray) -> list[bytes]:
    """Each row in 32-bit numbers where they hold it exactly, in 64-bit ones otherwise."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    fits = (small == x).all(1)
    return [a.tobytes() if f else b.tobytes() for a, b, f in zip(small, x, fits)]


def _encode_half(s: np.ndarray) -> list[bytes]:
    """Each sketch in 16-bit numbers where they can hold it, in 64-bit ones otherwise."""
    fits = np.abs(s).max(1, initial=0) < HALF_MAX
    small = np.where(fits[:, None], s, 0).astype(np.float16)
    return [a.tobytes() if f else b.tobytes() for a, b, f in zip(small, s, fits)]


def _decode(col: pd.Series, size: int) -> np.ndarray:
    out, sizes = np.empty((len(col), size)), col.map(len).to_numpy()
    for width, kind in ((2, np.float16), (4, np.float32), (8, np.float64)):
        rows = np.flatnonzero(sizes == width * size)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(col.iloc[rows]), dtype=kind).reshape(-1, size)
    return out


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v) with an id and a vector; vectors of another length, with a null or NaN or all zero are left out by the search."""
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")


def _uniform(seed: int) -> "F.Column":
    return F.xxhash64("id", F.lit(seed)) / F.lit(2.0**64) + 0.5


def _fit_tree(vectors: DataFrame, n: int, shape: tuple[int, ...], k: int, target_recall: float, sample_rows: int) -> Tree:
    """Routers for ``n`` distinct vectors, on samples drawn by a hash of the id.

    One of at most 9/8 of ``sample_rows`` vectors on the driver; where more than TOP_PARTS parts are needed, one as
    large for each of them on the executors.
    """
    size = math.prod(shape)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_encode(dense_rows(b.column("v"), shape)[1]), pa.binary())], ["b"])

    drawn = vectors.where(_uniform(1) < sample_rows / n).limit(sample_rows + sample_rows // 8).mapInArrow(packed, "b binary").toPandas()
    sample = np.unique(_decode(drawn["b"], size), axis=0)
    if not len(sample):
        sample = np.zeros((1, size))
    space = Space(sample.mean(0), float(sample.std()) or 1.0)
    s = space.sketch(sample)
    part_rows = min(PART_ROWS, max(1, n**0.8))
    wanted = math.ceil(n / part_rows)
    parts = max(1, min(wanted, len(sample) // 16, TOP_PARTS))
    width = 1 if wanted <= parts or parts == 1 else math.ceil(wanted / parts)
    near = _nearest((sample - space.mean) / space.scale, min(10, len(sample) - 1)) if parts > 1 else np.zeros((len(sample), 0), int)
    top = fit_router(s, near, parts, k, target_recall if width == 1 else math.sqrt(target_recall))
    tree = Tree(space, top, [None] * len(top.bias), 1)
    if width == 1 or len(top.bias) == 1:
        return tree
    rows = max(sample_rows, 16 * width)
    held = vectors.sparkSession.sparkContext.broadcast(tree)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = held.value.space.sketch(dense_rows(b.column("v"), shape)[1])
            yield pa.RecordBatch.from_arrays([pa.array(held.value.home(x), pa.int64()), pa.array(_encode_half(x), pa.binary())], ["t", "b"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(_decode(pdf["b"].iloc[: 2 * rows], s.shape[1]), axis=0)
        p = max(1, min(width, len(x) // 16))
        r = fit_router(x, _nearest(x, min(10, len(x) - 1)) if p > 1 else np.zeros((len(x), 0), int), p, k, math.sqrt(target_recall))
        return pd.DataFrame({"t": [pdf["t"].iloc[0]], "mean": [r.mean.tobytes()], "scale": [r.scale], "weight": [r.weight.tobytes()], "bias": [r.bias.tobytes()], "probes": [r.probes]})

    share = min(1.0, parts * rows / n)
    fitted = vectors.where(_uniform(2) < share).mapInArrow(sketched, "t bigint, b binary").groupBy("t").applyInPandas(fit, "t bigint, mean binary, scale double, weight binary, bias binary, probes int")
    children: list[Router | None] = [None] * len(top.bias)
    for r in fitted.toLocalIterator():  # at most TOP_PARTS rows
        bias = np.frombuffer(r["bias"])
        children[r["t"]] = Router(np.frombuffer(r["mean"]), r["scale"], np.frombuffer(r["weight"]).reshape(-1, len(bias)), bias, r["probes"])
    return Tree(space, top, children, width)


def _blocks(routed: DataFrame, row_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(asks, index) of routed rows (rep, s, home, probe), cut so that each block of a part's index meets each block of its queries."""
    ask_rows = max(BLOCK_ROWS // 4, min(4 * BLOCK_ROWS, BLOCK_BYTES // row_bytes))
    sizes = routed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("nb"))
    asked = routed.select(F.explode("probe").alias("home")).groupBy("home").agg(F.ceil(F.count(F.lit(1)) / ask_rows).cast("int").alias("nq"))
    layout = checkpointed(sizes.join(asked, "home"))  # one row per part
    if fitting_broadcast(layout, 500_000):
        layout = F.broadcast(layout)
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c: F.pmod(F.xxhash64("rep", F.lit(5)), F.col(c)).cast("int")
    index = routed.select("rep", "s", "home").join(layout, "home").select(F.col("home").alias("ihome"), block("nb").alias("ikb"), spread("nq").alias("ikq"), F.col("rep").alias("near"), F.col("s").alias("t"))
    asks = routed.select("rep", "s", F.explode("probe").alias("home")).join(layout, "home").select("home", spread("nb").alias("kb"), block("nq").alias("kq"), "rep", "s")
    return asks, index


def nearest_vectors(
    vectors: DataFrame, k: int, size: int | tuple[int, ...], max_distance: float | None = None, queries: str | None = None, target_recall: float = 0.985,
    sample_rows: int = SAMPLE_ROWS, exact: bool = False,
) -> DataFrame:
    """Rows (id, neighbour, distance, place) for vectors (id, v: arrays of ``size`` numbers, or of arrays of such a shape), at most k per id, nearest first.

    Equal distances are ordered by id; a vector isn't its own neighbour but its copies are. With
    ``max_distance`` only neighbours within it are sought. ``queries`` is a condition on ``id`` that picks the
    asking vectors (default: all); they are compared with all vectors. With ``exact`` every query asks every
    part, so nothing is left to the routers. They are fitted on bounded samples (see ``sample_rows``). Null
    vectors and ones of another shape, with a null, NaN or infinite number, or all zero take no part. Rows of one id
    that repeat count once (one of them is taken if they differ). No vectors give no rows, a single one has no neighbours.
    """
    spark = vectors.sparkSession
    shape = (size,) if isinstance(size, int) else tuple(size)
    full = math.prod(shape)
    id_type = vectors.schema["id"].dataType.simpleString()
    vectors = vectors.select("id", "v")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = dense_rows(b.column("v"), shape)
            g = _names(x)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(g[:, 0]), pa.array(g[:, 1])], ["id", "g1", "g2"])

    # vectors are named by 128 bits of hash, so the bookkeeping of ids and copies moves no vector
    ids = checkpointed(vectors.mapInArrow(named, f"id {id_type}, g1 bigint, g2 bigint").groupBy("id").agg(F.min(F.struct("g1", "g2")).alias("g")).select("id", "g.g1", "g.g2"))
    # the k + 1 smallest ids of each group of copies, in two steps so that no task sorts a whole group
    salted = Window.partitionBy("g1", "g2", "salt").orderBy("id")
    first = ids.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    final = Window.partitionBy("g1", "g2").orderBy("id")
    members = first.withColumn("r", F.row_number().over(final)).where(F.col("r") <= k + 1)
    reps = members.groupBy("g1", "g2").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))
    ask = ids.where(queries) if queries else ids
    if queries:
        reps = reps.join(ask.select("g1", "g2").distinct().withColumn("asks", F.lit(True)), ["g1", "g2"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    else:
        reps = reps.withColumn("asks", F.lit(True))
    reps = checkpointed(reps)
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], f"id {id_type}, neighbour {id_type}, distance double, place int")
    shared = spark.sparkContext.broadcast(_fit_tree(vectors, n, shape, k, target_recall, sample_rows))
    both = max_distance is not None and queries is None

    def routed_rows(sketches: bool, asking: DataFrame, half: bool) -> DataFrame:
        """(rep, s, home, probe): each distinct vector or its sketch, its own part and, where ``asking`` says so, the parts it asks."""

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = dense_rows(b.column("v"), shape)[1]
                g, s = _names(x), _encode_half(shared.value.space.sketch(x)) if sketches else _encode(x)
                yield pa.RecordBatch.from_arrays([pa.array(g[:, 0]), pa.array(g[:, 1]), pa.array(s, pa.binary())], ["g1", "g2", "s"])

        def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = shared.value
            for pdf in parts:
                s = _decode(pdf["s"], min(full, SKETCH)) if sketches else tree.space.sketch(_decode(pdf["s"], full))
                asks = np.flatnonzero(pdf["asks"])
                rows, leaves = tree.probe(s[asks], max_distance, half, exact)
                counts = np.zeros(len(pdf), np.int64)
                counts[asks] = np.bincount(rows, minlength=len(asks))
                yield pd.DataFrame({"rep": pdf["rep"], "s": pdf["s"], "home": tree.home(s), "probe": np.split(leaves, np.cumsum(counts)[:-1])})

        base = vectors.mapInArrow(packed, "g1 bigint, g2 bigint, s binary").dropDuplicates(["g1", "g2"]).join(asking.select("g1", "g2", "rep", "asks"), ["g1", "g2"])
        return checkpointed(base.mapInPandas(route, f"rep {id_type}, s binary, home bigint, probe array<bigint>"))

    def candidates(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Pairs of near sketches. Where both have more than DENSE near ones here only their own rows come out, with a null."""
        out = []
        if len(a) and len(b):
            space = shared.value.space
            m, far = min(full, SKETCH), max_distance / space.scale * math.sqrt(space.kept())
            x_all, x_ids = _decode(a["s"], m).astype(np.float32), a["rep"].to_numpy()
            y, y_ids = _decode(b["t"], m).astype(np.float32), b["near"].to_numpy()
            yn = (y**2).sum(1)
            pairs = []
            for at in range(0, len(x_all), 1000):
                x = x_all[at : at + 1000]
                xn = (x**2).sum(1)
                # what rounding to 16 bits and adding in 32 bits may change
                bound = (far + (np.sqrt(xn) + math.sqrt(yn.max())) / 1024 + 1e-6) ** 2 + 1e-5 * (xn + yn.max())
                near2 = x @ (-2 * y.T)
                near2 += yn
                r, c = np.nonzero(near2 <= (bound - xn)[:, None])
                other = x_ids[at + r] != y_ids[c]
                pairs.append((at + r[other], c[other]))
            r, c = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            many_x, many_y = np.bincount(r, minlength=len(x_all)) > DENSE, np.bincount(c, minlength=len(y)) > DENSE
            keep = ~(many_x[r] & many_y[c])
            out.append(pd.DataFrame({"rep": x_ids[r[keep]], "near": y_ids[c[keep]]}))
            rows = np.unique(np.concatenate([x_ids[many_x], y_ids[many_y]])) if not keep.all() else x_ids[:0]
            out.append(pd.DataFrame({"rep": rows, "near": pd.array([pd.NA] * len(rows), dtype="Int64") if id_type in ("bigint", "int") else [None] * len(rows)}))
        return pd.concat(out).astype({"near": object}) if out else pd.DataFrame({"rep": [], "near": []})

    def rank(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The k nearest indexed vectors of each asking one."""
        out = []
        if len(a) and len(b):
            x_all, x_ids = _decode(a["s"], full), a["rep"].to_numpy()
            y, y_ids = _decode(b["t"], full), b["near"].to_numpy()
            yn = (y**2).sum(1)
            for at in range(0, len(x_all), 500):
                x, own = x_all[at : at + 500], x_ids[at : at + 500]
                near2 = (x**2).sum(1)[:, None] + yn[None] - 2 * x @ y.T
                # everything as near as the k-th other one, so that ties are decided by id
                last = np.partition(near2, min(k, len(y) - 1), axis=1)[:, min(k, len(y) - 1)]
                pick = near2 <= (last + 1e-9 * (1 + np.abs(last)))[:, None]
                r, c = np.nonzero(pick)
                d = np.sqrt(((x[r] - y[c]) ** 2).sum(1))
                keep = (own[r] != y_ids[c]) & (True if max_distance is None else d <= max_distance)
                one = pd.DataFrame({"rep": own[r[keep]], "near": y_ids[c[keep]], "d": d[keep]})
                out.append(one.sort_values(["rep", "d", "near"]).groupby("rep").head(k))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "near": [], "d": []})

    def meet(routed: DataFrame, row_bytes: int, how, schema: str) -> DataFrame:
        asks, index = _blocks(routed, row_bytes)
        return asks.groupBy("home", "kb", "kq").cogroup(index.groupBy("ihome", "ikb", "ikq")).applyInPandas(how, schema)

    ranked = f"rep {id_type}, near {id_type}, d double"
    if max_distance is None or exact:
        met = meet(routed_rows(False, reps, False), 8 * full, rank, ranked)
    else:
        near = checkpointed(meet(routed_rows(True, reps, both), 2 * min(full, SKETCH), candidates, f"rep {id_type}, near {id_type}"))
        pairs = near.where("near IS NOT NULL").select(F.least("rep", "near").alias("rep"), F.greatest("rep", "near").alias("near")).distinct()
        met = _exact(vectors, pairs, shape, max_distance, id_type)
        met = met.unionByName(met.select(F.col("near").alias("rep"), F.col("rep").alias("near"), "d"))
        dense = near.where("near IS NULL").select("rep").distinct()
        if not dense.isEmpty():  # vectors in crowded places ask by their whole vectors
            crowded = reps.drop("asks").join(dense.withColumn("asks", F.lit(True)), "rep", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
            met = met.unionByName(meet(routed_rows(False, crowded, False), 8 * full, rank, ranked))
    merged = met.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "near"))), 1, k).alias("n")).select("rep", F.posexplode("n").alias("p", "e")).select("rep", F.col("e.near").alias("near"), F.col("e.d").alias("d"))
    ids_of = reps.select(F.col("rep").alias("near"), "ids")
    found = merged.join(ids_of, "near").select("rep", F.explode("ids").alias("neighbour"), "d")
    copies = reps.where(F.size("ids") > 1).select("rep", F.explode("ids").alias("neighbour"), F.lit(0.0).alias("d"))
    lists = found.unionByName(copies).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("d"), F.col("neighbour")))), 1, k + 1).alias("n"))
    whose = ask.join(reps.select("g1", "g2", "rep"), ["g1", "g2"]).select("id", "rep")
    own = whose.join(lists, "rep").select("id", F.slice(F.filter("n", lambda e: e["neighbour"] != F.col("id")), 1, k).alias("n"))
    return own.select("id", F.posexplode("n").alias("p", "e")).select("id", F.col("e.neighbour").alias("neighbour"), F.col("e.d").alias("distance"), (F.col("p") + 1).alias("place"))


def _exact(vectors: DataFrame, pairs: DataFrame, shape: tuple[int, ...], max_distance: float, id_type: str) -> DataFrame:
    """(rep, near, d) of the pairs whose whole vectors lie within the distance; only vectors of some pair are moved."""
    full = math.prod(shape)
    needed = pairs.select(F.explode(F.array("rep", "near")).alias("id")).distinct()
    if fitting_broadcast(needed, 1_000_000):
        needed = F.broadcast(needed)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = dense_rows(b.column("v"), shape)
            g = _names(x)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(g[:, 0]), pa.array(g[:, 1]), pa.array(_encode(x), pa.binary())], ["id", "g1", "g2", "b"])

    whole = vectors.join(needed, "id", "left_semi").mapInArrow(packed, f"id {id_type}, g1 bigint, g2 bigint, b binary")
    whole = whole.groupBy("id").agg(F.min_by("b", F.struct("g1", "g2")).alias("b"))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            d = np.sqrt(((_decode(pdf["b"], full) - _decode(pdf["c"], full)) ** 2).sum(1))
            yield pd.DataFrame({"rep": pdf["rep"], "near": pdf["near"], "d": d})[d <= max_distance]

    met = pairs.join(whole.withColumnRenamed("id", "rep"), "rep").join(whole.select(F.col("id").alias("near"), F.col("b").alias("c")), "near")
    return met.mapInPandas(measure, f"rep {id_type}, near {id_type}, d double")
