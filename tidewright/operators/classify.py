"""Classification of feature vectors and of symmetric positive definite matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.functions import spd
from tidewright.session import checkpointed

CELLS = 4_000_000


def nearest_neighbours(
    queries: DataFrame, train: DataFrame, k: int, metric: str = "euclidean", d: int | None = None, qid: str = "id", tid: str = "id", features: str = "x", label: str = "label",
    fold: str | None = None, block: int = 2000,
) -> DataFrame:
    """(qid, place, tid, label, d): the exact k nearest training rows of each query, ties by tid.

    Queries and training rows are cut into hash blocks; each pair of blocks is compared by one task in numpy
    and gives at most k rows per query, so neither side is held whole or broadcast. A row is never its own
    neighbour where ids are equal and, with ``fold``, rows of the query's fold aren't either.
    ``airm`` compares flattened symmetric d x d matrices, ``euclidean`` plain vectors of equal length.

    The affine-invariant distance is never below the log-Euclidean one, which is one matrix product for all
    pairs: only rows whose log-Euclidean distance is within the k-th affine-invariant one get eigenvalues.
    """
    if k < 1 or metric not in ("euclidean", "airm"):
        raise ValueError("k must be positive and metric euclidean or airm")
    f = F.col(fold) if fold else F.lit(None).cast("int")
    q = queries.select(F.col(qid).alias("q"), F.col(features).alias("qx"), f.alias("qf"))
    t = train.select(F.col(tid).alias("t"), F.col(features).alias("tx"), F.col(label).alias("label"), f.alias("tf"))
    if metric == "airm":  # the upper triangle is moved
        upper = F.array(*[F.lit(i * d + j) for i in range(d) for j in range(i, d)])
        q, t = q.withColumn("qx", F.transform(upper, lambda k: F.get("qx", k))), t.withColumn("tx", F.transform(upper, lambda k: F.get("tx", k)))
    nq, nt = (max(1, -(-df.count() // block)) for df in (queries, train))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = q.select("*", own("q", nq).alias("qb"), every(nt).alias("tb"))
    b = t.select("*", every(nq).alias("qb2"), own("t", nt).alias("tb2"))
    types = dict(q.dtypes) | dict(t.dtypes)
    schema = f"q {types['q']}, t {types['t']}, label {types['label']}, d double"

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return compared(x, y, k, metric, d, bool(fold))

    met = a.groupBy("qb", "tb").cogroup(b.groupBy("qb2", "tb2")).applyInPandas(compare, schema)
    near = met.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "t", "label"))), 1, k).alias("n"))
    return near.select("q", F.posexplode("n").alias("p", "e")).select(F.col("q").alias("qid"), (F.col("p") + 1).alias("place"), F.col("e.t").alias("tid"), F.col("e.label").alias("label"), F.col("e.d").alias("d"))


def compared(x: pd.DataFrame, y: pd.DataFrame, k: int, metric: str, d: int | None, fold: bool) -> pd.DataFrame:
    """(q, t, label, d): the k nearest rows (t, tx, label, tf) of each query (q, qx, qf), all of one block."""
    empty = pd.DataFrame({"q": [], "t": [], "label": [], "d": []})
    if not len(x) or not len(y):
        return empty
    u, v = np.array(x["qx"].tolist(), dtype=float), np.array(y["tx"].tolist(), dtype=float)
    tn, ln, qn = y["t"].to_numpy(), y["label"].to_numpy(), x["q"].to_numpy()
    out, m = [], min(k, len(v))
    if metric == "airm":
        exact, u, v, bounded = _affine_invariant(u, v, d)
    norms = (v**2).sum(1)
    step = max(1, CELLS // len(v))
    for at in range(0, len(u), step):
        part, names = u[at : at + step], qn[at : at + step]
        dist = (part**2).sum(1)[:, None] + norms[None] - 2 * part @ v.T  # squared, up to rounding
        if metric == "airm":
            dist = np.where(bounded(at, at + step), dist, 0)
        may = tn[None] != names[:, None]
        if fold:
            may &= y["tf"].to_numpy()[None] != x["qf"].to_numpy()[at : at + step][:, None]
        dist = np.where(may, dist, np.inf)
        if metric == "airm":
            first = np.argpartition(dist, m - 1, axis=1)[:, :m]
            r = np.repeat(np.arange(len(part)), m)
            edge = np.where(np.isinf(np.take_along_axis(dist, first, 1)), np.inf, exact(at + r, first.ravel()).reshape(-1, m)).max(1) ** 2
            r, c = np.nonzero(may & (dist <= (edge + 1e-6 * (1 + edge))[:, None]))
            near = exact(at + r, c)
        else:
            edge = np.partition(dist, m - 1, axis=1)[:, m - 1]
            r, c = np.nonzero(may & (dist <= (edge + 1e-9 * (1 + np.abs(edge)))[:, None]))
            near = np.sqrt(((v[c] - part[r]) ** 2).sum(1))
        found = pd.DataFrame({"q": names[r], "t": tn[c], "label": ln[c], "d": near})
        out.append(found.sort_values(["q", "d", "t"]).groupby("q").head(k))
    return pd.concat(out) if out else empty


def _affine_invariant(u: np.ndarray, v: np.ndarray, d: int) -> tuple[Callable, np.ndarray, np.ndarray, Callable]:
    """(distances of pairs of rows, tangent features of u, of v, which pairs of a range of u these bound from below).

    ``u`` and ``v`` are upper triangles. Where the floor of the eigenvalues may change the distance, features bound nothing.
    """
    i, j = np.triu_indices(d)

    def whole(t: np.ndarray) -> np.ndarray:
        m = np.zeros((len(t), d, d))
        m[:, i, j] = m[:, j, i] = t
        return m

    u, v = whole(u), whole(v)
    (wu, eu), (wv, ev) = np.linalg.eigh(u), np.linalg.eigh(v)
    made = lambda e, w: (e * w[:, None, :]) @ np.swapaxes(e, 1, 2)
    half = made(eu, np.maximum(wu, spd.FLOOR) ** -0.5)
    logs = [spd.vech(made(e, np.log(np.maximum(w, spd.FLOOR)))) for e, w in ((eu, wu), (ev, wv))]

    def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        some = max(1, CELLS // (d * d))
        parts = [np.linalg.eigvalsh(half[r[a : a + some]] @ v[c[a : a + some]] @ half[r[a : a + some]]) for a in range(0, len(r), some)]
        return np.sqrt((np.log(np.maximum(np.concatenate(parts or [np.zeros((0, d))]), spd.FLOOR)) ** 2).sum(1))

    def bounded(a: int, b: int) -> np.ndarray:
        least = 2 * spd.FLOOR * np.maximum(wu[a:b, -1], 1)  # the least eigenvalue of a pair is at least that of v by the greatest of u
        return (wu[a:b, 0] > 2 * spd.FLOOR)[:, None] & (wv[None, :, 0] > least[:, None])

    return exact, *logs, bounded


def vote(neighbours: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """(keys, predicted): the most frequent label; among equally frequent ones that of the nearest neighbour having it."""
    per = neighbours.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    return per.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "label")).alias("m")).select(*keys, F.col("m.label").alias("predicted"))


def kernel_vote(neighbours: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """(keys, predicted): the label of greatest summed weight exp(-d^2 / 2 s^2), s the median distance of the query's neighbours.

    Weights are compared to 12 digits; of equal ones the label with the nearest neighbour wins.
    """
    scale = neighbours.groupBy(*keys).agg(F.greatest(F.median("d"), F.lit(1e-12)).alias("s"))
    w = neighbours.join(scale, list(keys)).withColumn("w", F.exp(-F.col("d") * F.col("d") / (2 * F.col("s") * F.col("s"))))
    per = w.groupBy(*keys, "label").agg(F.round(F.sum("w"), 12).alias("w"), F.min("place").alias("first"))
    return per.groupBy(*keys).agg(F.max(F.struct("w", (-F.col("first")).alias("f"), "label")).alias("m")).select(*keys, F.col("m.label").alias("predicted"))


def contiguous_folds(df: DataFrame, order: str, folds: int) -> DataFrame:
    """``df`` with ``fold``: contiguous by ``order``, the first n mod folds ones one row larger.

    Positions come from counts per range of the order, so the rows aren't sorted in one task.
    """
    n = df.count()
    if not 1 < folds <= n:
        raise ValueError("folds must be at least 2 and at most the number of rows")
    ranged = checkpointed(df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))  # its partitions are referred to twice
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    i = F.col("_o") + F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    placed = ranged.join(F.broadcast(offset), "_p").withColumn("_i", i)  # one row per partition
    small, more = n // folds, n % folds
    cut = more * (small + 1)
    fold = F.when(F.col("_i") < cut, F.floor(F.col("_i") / (small + 1))).otherwise(more + F.floor((F.col("_i") - cut) / max(1, small)))
    return placed.withColumn("fold", fold.cast("int")).drop("_p", "_n", "_o", "_i")


def accuracy(predicted: DataFrame, truth: DataFrame, qid: str = "qid", tid: str = "id", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, accuracy) of predictions against the true labels."""
    t = truth.select(F.col(tid).alias(qid), F.col(label).alias("_true"))
    joined = predicted.join(t, qid)
    g = joined.groupBy(*keys) if keys else joined
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("_true")).cast("double")).alias("accuracy"))


def held_out_accuracy(v: DataFrame, folds: int, judge: Callable[[DataFrame, DataFrame], DataFrame], label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """(fold, keys, n, accuracy): ``judge(train, test)`` adds ``predicted`` to the rows of each fold, having seen the other folds only."""
    out = None
    for k in range(folds):
        one = judge(v.where(F.col("fold") != k), v.where(F.col("fold") == k)).select("fold", *keys, (F.col("predicted") == F.col(label)).cast("double").alias("_hit"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("fold", *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("accuracy"))


def perceptron_fit(rows: DataFrame, id_col: str, features: Sequence[str], target: str, group: str, rate: float = 0.2, max_turns: int = 100, weights: Sequence[float] | None = None, bias: float = 0.9) -> DataFrame:
    """(group, w, b, turns, errors): the online perceptron over each group's rows in id order.

    Turn by turn, row by row: prediction w x + b > 0, update w += rate (t - p) x, b += rate (t - p); it ends
    after a turn without errors. An order-dependent fold can't be split, so a group's rows are folded as
    one array: groups must fit a task, and are meant to be many.
    """
    n = len(features)
    w0 = [float(v) for v in weights] if weights is not None else [0.0] * n
    packed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("t")))).alias("_r"))
    flat = packed.select(group, F.flatten(F.transform("_r", lambda r: r["x"])).alias("x"), F.transform("_r", lambda r: r["t"]).alias("t"))

    def fit(xs: list[np.ndarray], ts: list[np.ndarray]) -> pd.DataFrame:
        """All groups side by side, longest first: step k takes the k-th row of every group that has one."""
        size = np.array([len(t) for t in ts])
        order = np.argsort(-size, kind="stable")
        w, b = np.tile(w0, (len(ts), 1)), np.full(len(ts), float(bias))
        turns, errors = np.zeros(len(ts), int), np.full(len(ts), -1)
        open_ = order
        for turn in range(max_turns):
            wo, bo, wrong = w[open_], b[open_], np.zeros(len(open_), int)
            if not turn or len(open_) < before:  # groups that are done are left out
                before = len(open_)
                steps = [np.array([i for i in open_ if size[i] > k]) for k in range(size[open_].max(initial=0))]
                steps = [(np.array([xs[i][k] for i in own]), np.array([ts[i][k] for i in own])) for k, own in enumerate(steps)]
            for x, t in steps:
                m = len(t)
                score = np.zeros(m)
                for c in range(n):
                    score = score + wo[:m, c] * x[:, c]
                gap = t - (score + bo[:m] > 0)
                step = rate * gap
                wo[:m] += step[:, None] * x
                bo[:m] += step
                wrong[:m] += gap != 0
            w[open_], b[open_], errors[open_] = wo, bo, wrong
            turns[open_] += 1
            open_ = open_[wrong > 0]
            if not len(open_):
                break
        return pd.DataFrame({"w": list(w), "b": b, "turns": turns, "errors": errors})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                got = fit([np.asarray(x, float).reshape(-1, n) for x in pdf["x"]], [np.asarray(t, float) for t in pdf["t"]])
                yield got.assign(**{group: pdf[group].to_numpy()})[[group, "w", "b", "turns", "errors"]]

    return flat.mapInPandas(run, f"{group} {dict(rows.dtypes)[group]}, w array<double>, b double, turns int, errors int")


def perceptron_decide(rows: DataFrame, models: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """``rows`` with score = w x + b of their group's model and predicted = score > 0."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    return rows.join(models.select(group, "w", "b"), group).withColumn("score", A.dot("w", x) + F.col("b")).withColumn("predicted", (F.col("score") > 0).cast("int")).drop("w", "b")


def separating_line(models: DataFrame, x1: Column | float) -> Column:
    """The second coordinate of the line w x + b = 0 at a first coordinate, for two features; null for a vertical line."""
    return -(F.get("w", F.lit(0)) * x1 + F.col("b")) / F.nullif(F.get("w", F.lit(1)), F.lit(0.0))


def class_means(df: DataFrame, features: str, label: str) -> DataFrame:
    """(label, mean): element-wise mean vectors; with tangent features the log-Euclidean mean of each class."""
    e = df.select(label, F.posexplode(features).alias("pos", "v")).groupBy(label, "pos").agg(F.avg("v").alias("m"))
    return e.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda z: z["m"]).alias("mean"))


def nearest_class(df: DataFrame, means: DataFrame, features: str, label: str) -> DataFrame:
    """``df`` with predicted: the class of least distance to its mean (the smaller label of equal ones); class means are few rows."""
    gathered = means.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("mean")))).alias("_m"))
    scored = F.transform("_m", lambda c: F.struct(F.round(A.distance(F.col(features), c["mean"]), 12).alias("d"), c["label"].alias("label")))
    return df.join(F.broadcast(gathered)).withColumn("predicted", F.array_min(scored)["label"]).drop("_m")


def linear_discriminant(df: DataFrame, features: str, label: str, d: int, ridge: float = 1e-6) -> DataFrame:
    """(label, w, b): linear discriminants from class means and the pooled covariance, summed per class in one pass.

    score = w x + b, greatest wins. The sums are d^2 + d numbers per class; the d x d system is solved once.
    """
    x = F.col(features)
    crossed = F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
    sums = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get(x, F.lit(i))).alias(f"s{i}") for i in range(d)])
    second = df.select(F.posexplode(crossed).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    rows, cross = sums.collect(), np.zeros(d * d)
    for r in second.collect():
        cross[r["k"]] = r["v"]
    total = sum(r["n"] for r in rows)
    means = np.array([[r[f"s{i}"] / r["n"] for i in range(d)] for r in rows])
    within = cross.reshape(d, d) - sum(r["n"] * np.outer(m, m) for r, m in zip(rows, means))
    cov = within / max(total - len(rows), 1) + ridge * np.trace(within) / max(total, 1) / d * np.eye(d)
    w = np.linalg.solve(cov, means.T).T
    out = [(r[label], w_.tolist(), float(-0.5 * m @ w_ + np.log(r["n"] / total))) for r, m, w_ in zip(rows, means, w)]
    return df.sparkSession.createDataFrame(out, f"{label} {dict(df.dtypes)[label]}, w array<double>, b double")


def discriminant_predict(df: DataFrame, model: DataFrame, features: str, label: str) -> DataFrame:
    """``df`` with predicted: the class of the greatest discriminant score; the model has one row per class."""
    gathered = model.agg(F.collect_list(F.struct(F.col(label).alias("label"), "w", "b")).alias("_m"))
    scored = F.transform("_m", lambda c: F.struct((A.dot(F.col(features), c["w"]) + c["b"]).alias("s"), c["label"].alias("label")))
    return df.join(F.broadcast(gathered)).withColumn("predicted", F.array_max(scored)["label"]).drop("_m")


def karcher_mean(df: DataFrame, matrix: str, d: int, rounds: int = 15, tol: float = 1e-9) -> np.ndarray:
    """Affine-invariant mean of a column of flattened matrices, starting at the log-Euclidean mean.

    Every round is one distributed average of tangent vectors; only d x d numbers reach the driver.
    """
    def average(t: Column) -> np.ndarray:
        got = df.where(F.col(matrix).isNotNull()).select(F.posexplode(t).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(got, key=lambda r: r["k"])])

    first = average(spd.tangent(F.col(matrix), d))
    if not len(first):
        raise ValueError("no matrices")
    mean = spd.apply_spectral(spd.unvech(first[None], d), np.exp)[0]
    for _ in range(rounds):
        step = spd.unvech(average(spd.tangent_at(F.col(matrix), mean))[None], d)
        root = spd.apply_spectral(mean[None], np.sqrt)[0]
        mean = root @ spd.apply_spectral(step, np.exp)[0] @ root
        if np.linalg.norm(step) < tol:
            break
    return mean
