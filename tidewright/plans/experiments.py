"""Experiments on synthetic inputs with known truth: estimator bias, and spike detection and sorting.

They run on made-up input only, so they are library functions and not registered queries.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import cluster, events, information
from tidewright.sources import generators as gen

BINS = (4, 8, 12, 16)


def true_information(spark: SparkSession, neurons: int, n_classes: int = 8) -> DataFrame:
    """(neuron, truth): exact information of the neurons that ``simulate_population`` draws from."""
    joints = None
    for k in range(neurons):
        j = gen.analytic_joint(spark, k * 0.9 / max(1, neurons - 1), BINS[k % 4], n_classes).withColumn("neuron", F.lit(k))
        joints = j if joints is None else joints.unionByName(j)
    return information.mutual_information(joints, "response", "stimulus", ["neuron"], n="p").withColumnRenamed("mi", "truth")


def true_synergy(spark: SparkSession, rho_a: float, bins_a: int, rho_b: float, bins_b: int, n_classes: int = 8) -> float:
    """Exact SR of two neurons that are independent given the stimulus."""
    a = gen.analytic_joint(spark, rho_a, bins_a, n_classes).select(F.col("response").alias("ra"), "stimulus", F.col("p").alias("pa"))
    b = gen.analytic_joint(spark, rho_b, bins_b, n_classes).select(F.col("response").alias("rb"), "stimulus", F.col("p").alias("pb"))
    both = a.join(b, "stimulus").select(F.concat_ws("|", "ra", "rb").alias("response"), "stimulus", (F.col("pa") * F.col("pb") * n_classes).alias("p"))
    mi = lambda j, r, p: information.mutual_information(j, r, "stimulus", n=p).first()["mi"]
    return mi(both, "response", "p") - mi(a, "ra", "pa") - mi(b, "rb", "pb")


def information_bias(spark: SparkSession, neurons: int, trials: Sequence[int], reps: int, methods: Sequence[str] = ("plugin", "miller_madow"), n_classes: int = 8) -> DataFrame:
    """(method, trials, bias, deviation): estimates less truth over neurons and repetitions, all repetitions in one job per method."""
    truth = true_information(spark, neurons, n_classes)
    runs = None
    for n in trials:
        for r in range(reps):
            pop = gen.simulate_population(spark, neurons, n, n_classes, seed=1000 * n + r).withColumns({"trials": F.lit(n), "rep": F.lit(r)})
            runs = pop if runs is None else runs.unionByName(pop)
    out = None
    for m in methods:
        mi = information.mi_by_key(runs, ["trials", "rep", "neuron"], "response", "stimulus", method=m)
        s = mi.join(truth, "neuron").groupBy("trials").agg(F.avg(F.col("mi") - F.col("truth")).alias("bias"), F.stddev_pop("mi").alias("deviation")).withColumn("method", F.lit(m))
        out = s if out is None else out.unionByName(s)
    return out.select("method", "trials", "bias", "deviation")


def spike_sorting(spark: SparkSession, snr: float, overlap: float, seconds: float = 4.0, fs: float = 30_000.0, rate: float = 12.0, seed: int = 0) -> dict[str, float]:
    """Detection and sorting of three planted units: precision, recall and f1 of the detector, ari and accuracy of two sorters."""
    train = gen.add_overlaps(gen.poisson_train(spark, 3, rate, seconds, seed=seed), 3, overlap, 0.0005, seed).withColumn("rec", F.lit(0))
    signal = gen.build_signal(train, fs, seconds, 1.0 / snr, gen.templates(), seed=seed).withColumn("rec", F.lit(0)).cache()
    found = events.detect_spikes(signal, ["rec"], "i", "v", events.mad_threshold(signal, ["rec"], "v", 4.0), 30).cache()
    truth = train.select("rec", "unit", F.round(F.col("t") * fs).cast("bigint").alias("tt")).withColumn("tid", F.monotonically_increasing_id()).cache()
    matched = events.match_detections(found.withColumn("did", F.col("i")), truth, ["rec"], "did", "tid", "i", "tt", 30).cache()
    scores = events.precision_recall(matched, found, truth, ["rec"]).first()
    w = events.extract_waveforms(signal, found, ["rec"], "i", "v", 30, 30).select(F.col("center").alias("id"), F.col("wf").alias("x")).dropDuplicates(["id"]).cache()
    units = matched.join(truth.select("tid", "unit"), "tid").select(F.col("did").alias("id"), "unit")
    out = {k: float(scores[k]) for k in ("precision", "recall", "f1")}
    for name, labels in (("pca", cluster.sort_pca(w, "id", "x", 3)), ("spd", cluster.sort_spd(w, "id", "x", 3))):
        joined = labels.join(units, "id").cache()
        out[f"{name}_ari"] = float(cluster.adjusted_rand(joined, "unit", "cluster").first()["ari"])
        out[f"{name}_accuracy"] = cluster.clustering_accuracy(joined, "unit", "cluster")
    return out


def winner(scores: dict[str, float], tie: float = 0.01) -> str:
    """The name of the best score, or 'tie' where the two best differ by at most ``tie``."""
    ranked = sorted(scores.items(), key=lambda kv: -kv[1])
    return "tie" if len(ranked) > 1 and ranked[0][1] - ranked[1][1] <= tie else ranked[0][0]


def circulant_spectrum(kernel: Sequence[float], n: int) -> np.ndarray:
    """Eigenvalues of the circulant matrix of a kernel: its transform, padded to n."""
    return np.fft.fft(np.asarray(kernel, dtype=float), n)
