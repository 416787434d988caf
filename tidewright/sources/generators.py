"""Synthetic inputs with known truth, for tests and experiments: populations, signals, spike trains.

All draws come from hashes of ids and a seed, so any partitioning gives the same rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *ids: str | Column) -> Column:
    """A number in (0, 1) drawn by a hash of the ids."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(i) if isinstance(i, str) else i for i in ids], F.lit(seed))), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / float(16**12)


def analytic_joint(spark: SparkSession, rho: float, n_bins: int, n_classes: int) -> DataFrame:
    """(response, stimulus, p): with chance rho the response is stimulus mod n_bins, else any bin, stimuli equally likely."""
    grid = spark.range(n_bins * n_classes).select((F.col("id") % n_bins).alias("response"), F.floor(F.col("id") / n_bins).alias("stimulus"))
    hit = (F.col("stimulus") % n_bins == F.col("response")).cast("double")
    return grid.withColumn("p", (rho * hit + (1 - rho) / n_bins) / n_classes)


def simulate_population(spark: SparkSession, neurons: int, trials_per_class: int, n_classes: int = 8, seed: int = 0) -> DataFrame:
    """(neuron, trial_id, response, stimulus): neurons of reliability 0 .. 0.9 in even steps, bins 4, 8, 12, 16 in turn."""
    trials = spark.range(trials_per_class * n_classes).select(F.col("id").alias("trial_id"), (F.col("id") % n_classes).alias("stimulus"))
    rows = trials.select("*", F.explode(F.sequence(F.lit(0), F.lit(neurons - 1))).alias("neuron"))
    bins = F.get(F.array(*[F.lit(b) for b in (4, 8, 12, 16)]), F.col("neuron") % 4)
    rho = F.col("neuron") * (0.9 / max(1, neurons - 1))
    informed = uniform(seed, "neuron", "trial_id", F.lit("hit")) < rho
    guess = F.floor(uniform(seed, "neuron", "trial_id", F.lit("bin")) * bins)
    return rows.select("neuron", "trial_id", F.when(informed, F.col("stimulus") % bins).otherwise(guess).cast("int").alias("response"), "stimulus")


def sinusoid(spark: SparkSession, frequency: float, fs: float, seconds: float, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """(i, t, v): sin(2 pi f t) at regular points, or at points moved by up to +-jitter/2 of a step."""
    rows = spark.range(int(round(seconds * fs))).select(F.col("id").alias("i"))
    t = (F.col("i") + jitter * (uniform(seed, "i") - 0.5)) / fs
    return rows.select("i", t.alias("t"), F.sin(2 * math.pi * frequency * t).alias("v"))


def quantised(v: Column | str, value_range: float, gain: float, bits: int) -> Column:
    """A value as a converter reads it: whole steps of range / gain / 2^bits, clipped to the range."""
    step = value_range / gain / 2**bits
    c = F.col(v) if isinstance(v, str) else v
    return F.greatest(F.lit(-(2 ** (bits - 1))), F.least(F.lit(2 ** (bits - 1) - 1), F.round(c / step))) * step


def templates(n: int = 61) -> np.ndarray:
    """Three biphasic waveforms of ``n`` samples: differences of two bells each, scaled to a largest size of 1."""
    t = np.arange(n) - n // 2
    shapes = [np.exp(-((t - a) ** 2) / (2 * s**2)) * -1 + h * np.exp(-((t - b) ** 2) / (2 * w**2)) for a, s, h, b, w in ((0, 3, 0.45, 9, 6), (0, 5, 0.8, 14, 8), (-2, 2, 0.25, 5, 10))]
    return np.array([x / np.abs(x).max() for x in shapes])


def poisson_train(spark: SparkSession, units: int, rate: float, seconds: float, refractory: float = 0.002, seed: int = 0) -> DataFrame:
    """(unit, t): per unit, intervals of refractory + an exponential with the given mean rate, up to ``seconds``."""
    mean = 1 / rate - refractory
    if mean <= 0:
        raise ValueError("rate too high for the refractory time")
    n = int(seconds * rate * 1.5) + 20
    rows = spark.range(units * n).select(F.floor(F.col("id") / n).alias("unit"), (F.col("id") % n).alias("k"))
    gap = refractory - mean * F.log(uniform(seed, "unit", "k"))
    w = Window.partitionBy("unit").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("t", F.sum(gap).over(w)).where(F.col("t") < seconds).select("unit", "t")


def bursting_train(spark: SparkSession, units: int, rate: float, seconds: float, longest: int = 5, gap: float = 0.004, seed: int = 0) -> DataFrame:
    """(unit, t): Poisson burst onsets, 1 .. longest spikes each, uniform gaps of 0.5 .. 1.5 times ``gap`` within a burst."""
    starts = poisson_train(spark, units, rate, seconds, refractory=min(longest * 2 * gap, 0.5 / rate), seed=seed)
    size = 1 + F.floor(uniform(seed, "unit", "t", F.lit("size")) * longest).cast("int")
    spikes = starts.select("unit", "t", F.explode(F.sequence(F.lit(0), size - 1)).alias("j"))
    jump = F.when(F.col("j") == 0, 0.0).otherwise(gap * (0.5 + uniform(seed, "unit", "t", "j")))
    w = Window.partitionBy("unit", "t").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    return spikes.select("unit", (F.col("t") + F.sum(jump).over(w)).alias("t")).where(F.col("t") < seconds)


def add_overlaps(train: DataFrame, others: int, share: float, spread: float, seed: int = 0) -> DataFrame:
    """(unit, t, planted): a share of the spikes gets a companion of another unit within ``spread`` seconds."""
    chosen = train.where(uniform(seed, "unit", "t", F.lit("take")) < share)
    moved = chosen.select(((F.col("unit") + 1) % others).alias("unit"), (F.col("t") + spread * (2 * uniform(seed, "unit", "t", F.lit("move")) - 1)).alias("t"), F.lit(True).alias("planted"))
    return train.withColumn("planted", F.lit(False)).unionByName(moved.where("t >= 0"))


def build_signal(train: DataFrame, fs: float, seconds: float, noise: float, shapes: np.ndarray, drift: float = 0.0, seed: int = 0) -> DataFrame:
    """(i, v): each spike's template added around its sample, with optional sinusoidal gain, plus Gaussian noise at every sample."""
    spark = train.sparkSession
    length = shapes.shape[1]
    table = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in shapes])
    gain = 1 + drift * F.sin(2 * math.pi * F.col("t") / seconds)
    parts = train.select(F.round(F.col("t") * fs).cast("bigint").alias("c"), gain.alias("g"), F.posexplode(F.get(table, (F.col("unit") % len(shapes)).cast("int"))).alias("k", "s"))
    spikes = parts.select((F.col("c") + F.col("k") - length // 2).alias("i"), (F.col("g") * F.col("s")).alias("s")).groupBy("i").agg(F.sum("s").alias("s"))
    base = spark.range(int(seconds * fs)).select(F.col("id").alias("i"))
    normal = F.sqrt(-2 * F.log(uniform(seed, "i", F.lit("a")))) * F.cos(2 * math.pi * uniform(seed, "i", F.lit("b")))
    return base.join(spikes, "i", "left").select("i", (F.coalesce("s", F.lit(0.0)) + noise * normal).alias("v"))


def colored_noise(spark: SparkSession, channels: int, n: int, exponent: float = 1.0, seed: int = 0) -> DataFrame:
    """(channel, i, v): noise with power falling as 1 / f^exponent, unit variance per channel."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["channel"].iloc[0])
        rng = np.random.default_rng([seed, c])
        f = np.fft.rfftfreq(n)
        f[0] = f[1] if n > 1 else 1.0
        x = np.fft.irfft(np.fft.rfft(rng.standard_normal(n)) / f ** (exponent / 2), n)
        return pd.DataFrame({"channel": c, "i": np.arange(n), "v": x / (x.std() or 1.0)})

    return spark.range(channels).select(F.col("id").alias("channel")).groupBy("channel").applyInPandas(make, "channel bigint, i bigint, v double")


def covariance_windows(spark: SparkSession, classes: int = 7, per_class: int = 30, steps: int = 64, channels: int = 8, by_mean: bool = False, seed: int = 0) -> DataFrame:
    """(id, label, win): Gaussian windows whose classes differ in covariance (equal trace) or, with ``by_mean``, in mean only."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        label = int(pdf["label"].iloc[0])
        rng = np.random.default_rng([seed, label])
        q, r = np.linalg.qr(rng.standard_normal((channels, channels)))
        scale = np.exp(rng.uniform(-1, 1, channels))
        cov = (q * np.sign(np.diag(r))) @ np.diag(scale / scale.sum() * channels) @ (q * np.sign(np.diag(r))).T
        mean = rng.standard_normal(channels) if by_mean else np.zeros(channels)
        x = rng.multivariate_normal(mean, np.eye(channels) if by_mean else cov, (per_class, steps))
        return pd.DataFrame({"id": label * per_class + np.arange(per_class), "label": label, "win": [w.tolist() for w in x]})

    return spark.range(classes).select(F.col("id").alias("label")).groupBy("label").applyInPandas(make, "id bigint, label int, win array<array<double>>")
