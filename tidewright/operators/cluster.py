"""Waveform clustering: alignment, templates, overlap screening, k-means variants, sorting pipelines, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.functions import signal, spd
from tidewright.operators import fusion
from tidewright.operators.classify import class_means
from tidewright.session import checkpointed, spread


def best_shift(x: Column | str, template: Column | str, max_shift: int) -> Column:
    """The cyclic shift in -max_shift..max_shift of greatest dot product with the template; the first of equal ones.

    Products are compared to 9 digits.
    """
    c, t = (F.col(v) if isinstance(v, str) else v for v in (x, template))
    n = F.size(c)
    rolled = lambda s: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + F.get(c, F.pmod(i - s, n).cast("int")) * F.get(t, i))
    options = F.transform(F.sequence(F.lit(-max_shift), F.lit(max_shift)), lambda s: F.struct(F.round(rolled(s), 9).alias("d"), (-s).alias("s")))
    return -F.array_max(options)["s"]


def roll(x: Column | str, shift: Column) -> Column:
    """``x`` moved cyclically by ``shift``, which is computed once a row, not once a sample."""
    c = F.col(x) if isinstance(x, str) else x
    return F.transform(F.array(shift), lambda s: F.transform(c, lambda _, i: F.get(c, F.pmod(i - s, F.size(c)).cast("int"))))[0]


def align_waveforms(waveforms: DataFrame, wf: str, template: Sequence[float] | None = None, max_shift: int = 6) -> DataFrame:
    """``waveforms`` with ``shift`` and ``aligned``: each rolled to fit the template best (by default the mean waveform)."""
    if template is None:
        rows = waveforms.select(F.posexplode(wf).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()  # one number per sample
        template = [r["m"] for r in rows]
    t = F.array(*[F.lit(float(v)) for v in template])
    return waveforms.withColumn("shift", best_shift(wf, t, max_shift)).withColumn("aligned", roll(wf, F.col("shift")))


def cluster_templates(waveforms: DataFrame, wf: str, label: str) -> DataFrame:
    """(label, template): median of the members at each sample; rows with a null label are left out."""
    e = waveforms.where(F.col(label).isNotNull()).select(label, F.posexplode(wf).alias("pos", "v")).groupBy(label, "pos").agg(F.median("v").alias("m"))
    return e.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda z: z["m"]).alias("template"))


def screen_overlaps(waveforms: DataFrame, id_col: str, wf: str, label: str, templates: DataFrame, error_ratio: float = 1.5, gain: float = 2.5) -> DataFrame:
    """(id, label, e1, e2, is_overlap): waveforms that two templates explain much better than their own alone.

    e1 is the squared residual to the own template; e2 the least squared residual when a second template with
    its best coefficient is added. An overlap has e1 above ``error_ratio`` times its cluster's median e1 and
    e2 below e1 / ``gain``. Templates are one row per cluster.
    """
    gathered = templates.agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("template").alias("t"))).alias("_ts"))
    x = waveforms.join(F.broadcast(gathered))
    own = F.filter("_ts", lambda e: e["l"] == F.col(label))[0]["t"]
    x = x.withColumn("_r", F.zip_with(wf, own, lambda a, b: a - b)).withColumn("e1", A.dot("_r", "_r"))
    power = lambda t: F.nullif(A.dot(t, t), F.lit(0.0))
    second = F.array_min(F.transform(F.filter("_ts", lambda e: e["l"] != F.col(label)), lambda e: F.col("e1") - F.coalesce(A.dot("_r", e["t"]) * A.dot("_r", e["t"]) / power(e["t"]), F.lit(0.0))))
    x = x.withColumn("e2", F.coalesce(second, F.col("e1")))
    medians = x.groupBy(label).agg(F.median("e1").alias("_med"))
    joined = x.join(medians, label)
    hit = (F.col("e1") > F.greatest(error_ratio * F.col("_med"), F.lit(1e-12))) & (F.col("e2") * gain < F.col("e1"))
    return joined.select(id_col, label, "e1", "e2", hit.alias("is_overlap"))


def lloyd(df: DataFrame, id_col: str, features: str, centers: Sequence[Sequence[float]], rounds: int, tol: float = 0.0) -> tuple[DataFrame, list[list[float]]]:
    """((id, cluster, d2), centers) after at most ``rounds`` of Lloyd's iteration from given centers.

    Each round is one pass with the k centers as literals and one aggregation of k means; a cluster that
    loses its members moves to the row farthest from its center. Ties go to the first center.
    """
    now = [[float(v) for v in c] for c in centers]
    rows = checkpointed(df.select(id_col, F.col(features).alias("_x")))  # read once a round

    def assigned() -> DataFrame:
        cs = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(v) for v in c]).alias("c")) for k, c in enumerate(now)])
        near = F.array_min(F.transform(cs, lambda c: F.struct(F.round(A.total(F.zip_with("_x", c["c"], lambda a, b: (a - b) * (a - b))), 12).alias("d"), c["k"].alias("k"))))
        return rows.withColumn("_n", near).select(id_col, "_x", F.col("_n.k").alias("cluster"), F.col("_n.d").alias("d2"))

    for _ in range(rounds):
        a = assigned()
        means = {r["cluster"]: r["mean"] for r in class_means(a, "_x", "cluster").collect()}
        lost = [k for k in range(len(now)) if k not in means]
        far = a.orderBy(F.desc("d2"), id_col).limit(len(lost)).collect() if lost else []
        new = [means.get(k, now[k]) for k in range(len(now))]
        for k, r in zip(lost, far):
            new[k] = r["_x"]
        moved = max(sum((u - v) ** 2 for u, v in zip(p, q)) for p, q in zip(now, new)) ** 0.5
        now = [list(c) for c in new]
        if moved <= tol:
            break
    return assigned().select(id_col, "cluster", "d2"), now


def pca(df: DataFrame, features: str, k: int) -> tuple[DataFrame, list[float]]:
    """(``df`` with ``pcs``, shares): projections of centred rows on the first k principal axes, and their shares of the variance.

    The covariance is summed on the executors. Axes are signed so that their largest element is positive.
    """
    v = df.withColumn("_v", array_to_vector(F.col(features)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    axes = model.pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(0), range(k)])
    means = [r["m"] for r in df.select(F.posexplode(features).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()]
    offset = (np.array(means) @ axes).tolist()
    shifted = F.transform(vector_to_array("_p"), lambda x, i: (x - F.get(F.array(*[F.lit(float(o)) for o in offset]), i)) * F.get(F.array(*[F.lit(float(s)) for s in sign]), i))
    return model.transform(v).withColumn("pcs", shifted).drop("_v", "_p"), [float(s) for s in model.explainedVariance]


def _best_model(vectors: DataFrame, features: str, k: int, seeds: Sequence[int], max_iter: int, at_once: int = 4) -> KMeansModel:
    """The model of least cost among the seeds; ``at_once`` fits run side by side on one kept copy of the vectors."""
    kept = vectors.select(features).persist(StorageLevel.MEMORY_AND_DISK)
    fit = inheritable_thread_target(kept.sparkSession)(lambda s: KMeans(k=k, seed=s, maxIter=max_iter, featuresCol=features, predictionCol="cluster").fit(kept))
    try:
        with ThreadPool(at_once) as pool:
            models = pool.map(fit, seeds)
    finally:
        kept.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def kmeans(df: DataFrame, features: str, k: int, seeds: Sequence[int] = range(10), max_iter: int = 50) -> DataFrame:
    """``df`` with ``cluster``: k-means|| and Lloyd by Spark ML, the best of several seeds."""
    v = checkpointed(df.withColumn(features, array_to_vector(F.col(features))))
    return _best_model(v, features, k, seeds, max_iter).transform(v).withColumn(features, vector_to_array(F.col(features)))


def log_euclidean_kmeans(df: DataFrame, id_col: str, tangent: str, k: int, seeds: Sequence[int] = range(10), max_iter: int = 50) -> DataFrame:
    """(id, cluster, d2): k-means of matrices under the log-Euclidean distance, on their tangent features.

    The log-Euclidean mean is the plain mean of tangent features, so this is Lloyd's iteration there, from
    the best centers that k-means|| and Lloyd find from several seeds.
    """
    first = _best_model(df.select(array_to_vector(F.col(tangent)).alias("_v")), "_v", k, seeds, max_iter).clusterCenters()
    return lloyd(df, id_col, tangent, [c.tolist() for c in first], max_iter, 1e-9)[0]


def fusion_features(df: DataFrame, wf: str, out: str, dim: int = 16, lag: int = 3, length: int = 91, w_delay: float = 1.0, w_outer: float = 1.0) -> DataFrame:
    """``df`` with ``out``: weighted tangent features of the delay descriptor and of the outer product of the whole waveform."""
    made = spd.with_tangent(df.withColumn("_d", A.delay_descriptor(wf, dim, lag)), "_d", dim, "_td")
    outer = A.outer_tangent(wf, length)
    return made.withColumn(out, F.concat(F.transform("_td", lambda v: v * w_delay), F.transform(outer, lambda v: v * w_outer))).drop("_d", "_td")


def sort_pca(waveforms: DataFrame, id_col: str, wf: str, k: int, components: int = 3) -> DataFrame:
    """(id, cluster): principal components, then k-means."""
    return kmeans(pca(spread(waveforms.select(id_col, wf), id_col), wf, components)[0], "pcs", k).select(id_col, "cluster")


def sort_spd(waveforms: DataFrame, id_col: str, wf: str, k: int, dim: int = 8, lag: int = 3) -> DataFrame:
    """(id, cluster): delay descriptors, then log-Euclidean k-means."""
    m = spread(waveforms.select(id_col, wf), id_col).select(id_col, A.delay_descriptor(wf, dim, lag).alias("m"))
    t = checkpointed(spd.with_tangent(m, "m", dim, "t").select(id_col, "t")).where("t IS NOT NULL")
    return log_euclidean_kmeans(t, id_col, "t", k).select(id_col, "cluster")


def sort_refined(waveforms: DataFrame, id_col: str, wf: str, k: int, fs: float, cutoff_hz: float = 5000.0, max_shift: int = 6, rounds: int = 1, descriptor: str = "fusion", dim: int = 8, lag: int = 3) -> DataFrame:
    """(id, cluster, is_overlap): low pass, alignment, clustering, realignment to the templates, overlap screening.

    ``descriptor``: fusion (plain k-means on both tangent features) or delay (log-Euclidean k-means).
    """
    if descriptor not in ("fusion", "delay"):
        raise ValueError("descriptor must be fusion or delay")
    rows = spread(waveforms.select(id_col, wf), id_col)
    clean = checkpointed(rows.select(id_col, signal.lowpass(F.col(wf), cutoff_hz, fs).alias("x")))
    if descriptor == "fusion":
        mean = [r["m"] for r in clean.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()]  # one number per sample
        packed = fusion.pack(clean, id_col, "x", mean, max_shift)
        centers = fusion.kmeans(packed, k)
        for _ in range(rounds):
            packed = fusion.realigned(packed, centers, fusion.medians(packed, centers), max_shift)
            centers = fusion.kmeans(packed, k)
        found = sorted(fusion.medians(packed, centers).items())
        templates = clean.sparkSession.createDataFrame([(c, t.tolist()) for c, t in found], "cluster int, template array<double>")
        return screen_overlaps(checkpointed(fusion.labelled(packed, centers, id_col)), id_col, "x", "cluster", templates).select(id_col, "cluster", "is_overlap")
    aligned = checkpointed(align_waveforms(clean, "x", max_shift=max_shift).select(id_col, F.col("aligned").alias("x")))
    for _ in range(rounds):
        labels = sort_spd(aligned, id_col, "x", k, dim, lag)
        templates = cluster_templates(aligned.join(labels, id_col), "x", "cluster")
        met = aligned.join(labels, id_col).join(F.broadcast(templates), "cluster")  # k rows
        aligned = checkpointed(met.select(id_col, roll("x", best_shift("x", "template", max_shift)).alias("x")))
    labelled = checkpointed(aligned.join(sort_spd(aligned, id_col, "x", k, dim, lag), id_col))
    screened = screen_overlaps(labelled, id_col, "x", "cluster", cluster_templates(labelled, "x", "cluster"))
    return screened.select(id_col, "cluster", "is_overlap")


def contingency(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(cluster).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a minimum-cost assignment of a small table, by shortest augmenting paths."""
    cost = np.asarray(cost, dtype=float)
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0] = i
        j0, least, way, used = 0, np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def clustering_accuracy(df: DataFrame, truth: str, cluster: str) -> float:
    """Share of rows in agreement under the best one-to-one naming of clusters; the table has one cell per (truth, cluster)."""
    cells = contingency(df, truth, cluster).collect()
    if not cells:
        return 0.0
    ts, cs = sorted({r["truth"] for r in cells}), sorted({r["cluster"] for r in cells})
    table = np.zeros((len(ts), len(cs)))
    for r in cells:
        table[ts.index(r["truth"]), cs.index(r["cluster"])] = r["n"]
    return float(sum(table[i, j] for i, j in assignment(-table)) / table.sum())


def adjusted_rand(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """One row (ari): agreement of pairs, corrected for chance, from the contingency table; 1 where both are trivial."""
    cells = contingency(df, truth, cluster)
    two = lambda n: n * (n - 1) / 2.0
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(name))
    whole = cells.agg(F.sum(two(F.col("n"))).alias("ij"), two(F.sum("n")).alias("all"))
    sums = whole.crossJoin(side("truth", "a")).crossJoin(side("cluster", "b"))  # one row each
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("all"))
    return sums.select(F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0)).alias("ari"))


def agreement(matches: DataFrame, truth_unit: str, found_unit: str, truth_sizes: DataFrame, found_sizes: DataFrame) -> list[tuple[object, object, float]]:
    """(truth unit, found unit, agreement) of the best one-to-one naming; agreement = matched / max(truth, found).

    ``matches`` has one row per matched event pair, the sizes (unit, n) one row per unit.
    """
    nt, nf = ({r[0]: r[1] for r in s.collect()} for s in (truth_sizes, found_sizes))
    cells = {(r[0], r[1]): r[2] for r in matches.groupBy(truth_unit, found_unit).count().collect()}
    if not nt or not nf:
        return []
    ts, fs = sorted(nt), sorted(nf)
    score = np.array([[cells.get((t, f), 0) / max(nt[t], nf[f], 1) for f in fs] for t in ts])
    return [(ts[i], fs[j], float(score[i, j])) for i, j in assignment(-score)]


def nearest_opposite_pair(df: DataFrame, id_col: str, features: str, label: str) -> DataFrame:
    """(label, id, other, d): for every label its row nearest to a row of another label; ids break ties.

    Compared in blocks by nearest_neighbours with the label as fold, so each row meets the other labels only.
    """
    from tidewright.operators.classify import nearest_neighbours

    near = nearest_neighbours(df, df, 1, qid=id_col, tid=id_col, features=features, label=label, fold=label)
    mine = df.select(F.col(id_col).alias("qid"), F.col(label).alias("own"))
    best = near.join(mine, "qid").groupBy("own").agg(F.min(F.struct(F.round("d", 9).alias("d"), F.col("qid"), F.col("tid"))).alias("m"))
    return best.select(F.col("own").alias("label"), F.col("m.qid").alias("id"), F.col("m.tid").alias("other"), F.col("m.d").alias("d"))
