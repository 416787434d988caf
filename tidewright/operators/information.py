"""Information-theoretic aggregates over long-form rows.

Every operator takes counts or rows in long form and any number of key columns, so many tables are
computed in one job. Zero cells are simply missing rows. Logarithms are to base 2.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.permutations import distinct_cells, permuted
from tidewright.operators.series import indexed
from tidewright.session import checkpointed, spread

METHODS = ("plugin", "miller_madow", "shuffle")


def joint_histogram(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts ``n`` of each (keys, y, x); rows with a null x or y are left out."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, y, x).agg(F.count(F.lit(1)).alias("n"))


def entropy(df: DataFrame, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Entropy in bits of non-negative weights per key; zero weights add nothing, negative ones raise an error.

    From H = log2(S) - sum(w log2 w) / S with S = sum(w): one aggregation, no normalising pass.
    An empty input gives no row for any key (one null row without keys).
    """
    w = F.col(weight).cast("double")
    checked = F.when(w < 0, F.raise_error(F.lit("weights must not be negative")).cast("double")).otherwise(w)
    s, wl = F.sum(checked), F.sum(F.when(w > 0, w * F.log2(w)))
    value = F.when(s > 0, F.log2(s) - wl / s)
    return (df.groupBy(*keys) if keys else df).agg(value.alias("entropy"))


def _xlog(n: Column) -> Column:
    return n * F.log2(n)


def mutual_information(joint: DataFrame, x: str, y: str, keys: Sequence[str] = (), n: str = "n", method: str = "plugin") -> DataFrame:
    """Mutual information ``mi`` between x and y from joint counts, per key.

    One pass of grouping sets gives the marginals, whose sums of n log n make the entropies:
    I = log2 N + (S_xy - S_x - S_y) / N. ``miller_madow`` adds ((mx-1)+(my-1)-(mxy-1)) / (2 N ln 2).
    """
    if method not in ("plugin", "miller_madow"):
        raise ValueError(f"unknown method {method!r}")
    cells = joint.where(F.col(n) > 0).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(n).cast("double").alias("_n"))
    sets = [[*keys, "_x"], [*keys, "_y"], [*keys, "_x", "_y"]]
    margins = cells.groupingSets([[F.col(c) for c in s] for s in sets], *keys, "_x", "_y").agg(
        F.grouping("_x").alias("_gx"), F.grouping("_y").alias("_gy"), F.sum("_n").alias("_m")
    )
    both, only_x, only_y = (F.col("_gx") + F.col("_gy")) == 0, F.col("_gy") == 1, F.col("_gx") == 1
    sums = margins.groupBy(*keys).agg(
        F.sum(F.when(both, F.col("_m"))).alias("_total"),
        F.sum(F.when(both, _xlog(F.col("_m")))).alias("_sxy"),
        F.sum(F.when(only_x, _xlog(F.col("_m")))).alias("_sx"),
        F.sum(F.when(only_y, _xlog(F.col("_m")))).alias("_sy"),
        F.count(F.when(both, 1)).alias("_mxy"),
        F.count(F.when(only_x, 1)).alias("_mx"),
        F.count(F.when(only_y, 1)).alias("_my"),
    )
    total = F.col("_total")
    mi = F.log2(total) + (F.col("_sxy") - F.col("_sx") - F.col("_sy")) / total
    if method == "miller_madow":
        mi = mi + (F.col("_mx") + F.col("_my") - F.col("_mxy") - 1) / (2 * total * F.log(F.lit(2.0)))
    return sums.select(*keys, mi.alias("mi")).where(total.isNotNull())


def label_arrays(trials: DataFrame, trial_id: str, stimulus: str, b: int, seed: int) -> DataFrame:
    """(trial id, labels): what each of ``b`` permutations of the stimulus over the trials gives the trial, as one array.

    Permutation k gives the trial at position r of id order the stimulus of the trial at position r in
    the order of md5(id|k|seed): reproducible on any engine, without a random stream. Positions are counted
    over sampled ranges of ids and prefixes of the hash, so no task sorts all trials however ids are spread.
    """
    if b <= 0:
        raise ValueError("b must be positive")
    ranged = checkpointed(trials.select(trial_id, stimulus).repartitionByRange(F.col(trial_id)).withColumn("_p", F.spark_partition_id()))
    placed = indexed(ranged, [], trial_id, [], F.col("_p"), "pos").drop("_p")
    drawn = spread(ranged.select(trial_id, stimulus), trial_id).select(trial_id, stimulus, F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b"))
    hashed = drawn.withColumn("_h", F.unhex(F.md5(F.concat_ws("|", F.col(trial_id), F.col("b"), F.lit(seed)))))
    shuffled = indexed(hashed, ["b"], "_h", [trial_id], F.hex(F.substring("_h", 1, 1)), "pos").select("b", "pos", stimulus)
    packed = shuffled.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct(F.col("b"), F.col(stimulus).alias("s")))).alias("_l"))
    return placed.select(trial_id, "pos").join(packed, "pos").select(trial_id, F.transform("_l", lambda e: e["s"]).alias("labels"))


def shuffled_labels(trials: DataFrame, trial_id: str, stimulus: str, b: int, seed: int) -> DataFrame:
    """Each of ``b`` permutations of the stimulus over the trials, as rows (b, trial id, stimulus)."""
    made = label_arrays(trials, trial_id, stimulus, b, seed)
    return made.select(trial_id, F.posexplode("labels").alias("b", stimulus)).select((F.col("b") + 1).alias("b"), trial_id, stimulus)


def coded_labels(rows: DataFrame, trial_id: str, stimulus: str, b: int, seed: int) -> tuple[DataFrame, int]:
    """((trial id, labels), number of stimuli): label arrays of the trials of ``rows`` with stimuli numbered from 1, null as 0; written once."""
    trials = rows.select(trial_id, stimulus).distinct()
    codes = trials.where(F.col(stimulus).isNotNull()).select(stimulus).distinct()  # one row per stimulus
    codes = checkpointed(codes.select(stimulus, F.row_number().over(Window.orderBy(stimulus)).alias("_code")))
    coded = trials.join(codes, stimulus, "left").select(trial_id, F.coalesce("_code", F.lit(0)).alias("_code"))
    return checkpointed(label_arrays(coded, trial_id, "_code", b, seed)), codes.count()


def surrogate_counts(rows: DataFrame, keys: Sequence[str], response: str, trial_id: str, labels: DataFrame, b: int, stimuli: int, held: int = 8_000_000) -> DataFrame:
    """Counts ``n`` of (keys, b, response, code) under each permutation of ``coded_labels``.

    Responses of a trial are packed next to its labels, so rows aren't multiplied by ``b``: each Arrow batch
    counts all permutations with numpy and adds to the counts of its task, which are passed on when they
    exceed ``held`` numbers. Null responses and null stimuli aren't counted.
    """
    cell = F.struct(*keys, F.col(response).alias("_x"))
    packed = rows.where(F.col(response).isNotNull()).groupBy(trial_id).agg(F.collect_list(cell).alias("_cells"))
    met = packed.join(labels, trial_id).select("_cells", "labels")
    wide = stimuli + 1

    def counted(cells: pa.StructArray, trial: np.ndarray, drawn: np.ndarray) -> tuple[pa.StructArray, np.ndarray]:
        kinds, place = distinct_cells(cells)
        table = np.empty((len(kinds), b, wide), np.int64)
        for k in range(b):
            table[:, k] = np.bincount(place * wide + drawn[trial, k], minlength=len(kinds) * wide).reshape(-1, wide)
        return kinds, table

    def merged(parts: list) -> tuple[pa.StructArray, np.ndarray]:
        kinds, place = distinct_cells(pa.concat_arrays([p[0] for p in parts]))
        table = np.zeros((len(kinds), b, wide), np.int64)
        np.add.at(table, place, np.concatenate([p[1] for p in parts]))
        return kinds, table

    def passed(kinds: pa.StructArray, table: np.ndarray):
        size = b * wide
        step = max(1, held // size)
        for at in range(0, len(kinds), step):
            flat = table[at : at + step].reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([kinds.slice(at, step), lists], names=["_cell", "_n"])

    def count(batches):
        parts, numbers = [], 0
        for batch in batches:
            lists, at = batch.column(0), 0
            drawn = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, b)
            sizes = np.diff(lists.offsets.to_numpy())
            step = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + 1, max(1, held // (b * wide))), "right")
            for end in [*np.unique(step[step > 0]).tolist(), len(sizes)]:
                if end > at:
                    trial = np.repeat(np.arange(at, end), sizes[at:end])
                    parts.append(counted(lists.slice(at, end - at).flatten(), trial, drawn))
                    numbers += parts[-1][1].size
                    at = end
                if numbers > 2 * held:
                    parts = [merged(parts)]
                    numbers = parts[0][1].size
                    if numbers > held:
                        yield from passed(*parts[0])
                        parts, numbers = [], 0
        if parts:
            yield from passed(*merged(parts))

    kept = T.StructType([T.StructField("_cell", packed.schema["_cells"].dataType.elementType), T.StructField("_n", T.ArrayType(T.LongType()))])
    summed = met.mapInArrow(count, kept).select("_cell.*", F.posexplode("_n").alias("_at", "_n")).where("_n > 0")
    draw, code = F.floor(F.col("_at") / wide).cast("int"), F.col("_at") % wide
    return summed.where(code > 0).groupBy(*keys, "_x", "_at").agg(F.sum("_n").alias("n")).select(*keys, (draw + 1).alias("b"), F.col("_x").alias(response), code.alias("code"), "n")


def mi_by_key(
    rows: DataFrame, keys: Sequence[str], response: str, stimulus: str, trial_id: str | None = None, method: str = "plugin", b: int = 20, seed: int = 0, labels: tuple[DataFrame, int] | None = None
) -> DataFrame:
    """MI between response and stimulus per key by any of the three estimators (``shuffle`` needs unique trial ids).

    ``labels``: the ``coded_labels`` of the trials where they exist already. Without them permutations are made a few at a time.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method != "shuffle":
        return mutual_information(joint_histogram(rows, response, stimulus, keys), response, stimulus, keys, method=method)
    observed = mutual_information(joint_histogram(rows, response, stimulus, keys), response, stimulus, keys)
    judged = lambda counts: mutual_information(counts, response, "code", [*keys, "b"])
    if labels:
        spread = judged(surrogate_counts(rows, keys, response, trial_id, labels[0], b, labels[1]))
    else:
        spread = permuted(rows, keys, response, trial_id, stimulus, b, seed, judged)
    if not keys:
        return observed.crossJoin(spread.agg(F.avg("mi").alias("_s"))).select((F.col("mi") - F.col("_s")).alias("mi"))
    means = spread.groupBy(*keys).agg(F.avg("mi").alias("_s"))
    return observed.join(means, [*keys]).select(*keys, (F.col("mi") - F.col("_s")).alias("mi"))


def rank_by_information(mi: DataFrame, key: str) -> DataFrame:
    """Rows (key, mi, position): position 1 is the most informative key; ties by key.

    Keys are neurons or columns, so the ranked rows are few; values are compared to 12 digits.
    """
    return mi.select(key, "mi", F.row_number().over(Window.orderBy(F.round("mi", 12).desc(), F.col(key))).cast("bigint").alias("position"))


def most_informative(mi: DataFrame, key: str) -> DataFrame:
    """All keys that reach the greatest mi."""
    w = Window.orderBy(F.round("mi", 12).desc())
    return mi.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def pair_rows(rows: DataFrame, neuron: str, trial_id: str, response: str, stimulus: str) -> DataFrame:
    """Rows (i, j, trial, ri, rj, stimulus) for every neuron pair i < j of a trial.

    Responses of a trial are gathered into one array (one shuffle by trial), from which pairs are made in
    place: no join of the table with itself.
    """
    packed = rows.groupBy(trial_id, stimulus).agg(F.array_sort(F.collect_list(F.struct(F.col(neuron).alias("k"), F.col(response).alias("r")))).alias("_p"))
    left = packed.select(trial_id, stimulus, "_p", F.explode("_p").alias("_a"))
    return left.select(trial_id, stimulus, "_a", F.explode(F.filter("_p", lambda e: e["k"] > F.col("_a.k"))).alias("_b")).select(
        F.col("_a.k").alias("i"), F.col("_b.k").alias("j"), trial_id, F.col("_a.r").alias("ri"), F.col("_b.r").alias("rj"), stimulus
    )


def synergy(rows: DataFrame, neuron: str, trial_id: str, response: str, stimulus: str, method: str = "plugin", b: int = 20, seed: int = 0) -> DataFrame:
    """SR(i, j) = I(Ri,Rj;S) - I(Ri;S) - I(Rj;S) for i < j by one estimator."""
    pairs = pair_rows(rows, neuron, trial_id, response, stimulus).withColumn("_rr", F.concat_ws("|", "ri", "rj"))
    labels = coded_labels(rows, trial_id, stimulus, b, seed) if method == "shuffle" else None
    joint = mi_by_key(pairs.drop("ri", "rj"), ["i", "j"], "_rr", stimulus, trial_id, method, b, seed, labels).withColumnRenamed("mi", "_mij")
    single = mi_by_key(rows.select(neuron, trial_id, response, stimulus), [neuron], response, stimulus, trial_id, method, b, seed, labels)
    mi_i = single.select(F.col(neuron).alias("i"), F.col("mi").alias("_mi"))
    mi_j = single.select(F.col(neuron).alias("j"), F.col("mi").alias("_mj"))
    return joint.join(mi_i, "i").join(mi_j, "j").select("i", "j", (F.col("_mij") - F.col("_mi") - F.col("_mj")).alias("sr"))


def synergy_matrix(sr: DataFrame) -> DataFrame:
    """Full symmetric matrix rows with a zero diagonal from the upper triangle."""
    names = sr.select(F.col("i").alias("k")).union(sr.select("j")).distinct()
    diagonal = names.select(F.col("k").alias("i"), F.col("k").alias("j"), F.lit(0.0).alias("sr"))
    return sr.select("i", "j", "sr").union(sr.select(F.col("j").alias("i"), F.col("i").alias("j"), "sr")).union(diagonal)


def synergy_counts(sr: DataFrame) -> DataFrame:
    """How many pairs are redundant and synergistic, and the total."""
    r = F.round("sr", 9)
    return sr.agg(F.count_if(r < 0).alias("redundant"), F.count_if(r > 0).alias("synergistic"), F.sum("sr").alias("sr_total"))


def noise_correlation(pairs: DataFrame, stimulus: str) -> DataFrame:
    """Sum over s of p(s) I(Ri; Rj | S = s) per pair, from rows of ``pair_rows``."""
    keys = ["i", "j", stimulus]
    mi = mutual_information(joint_histogram(pairs, "ri", "rj", keys), "ri", "rj", keys)
    n = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = n.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy("i", "j")))
    return mi.join(share, keys).groupBy("i", "j").agg(F.sum(F.col("mi") * F.col("_p")).alias("noise_mi"))


def signal_correlation(pairs: DataFrame) -> DataFrame:
    """I(Ri; Rj) per pair."""
    return mutual_information(joint_histogram(pairs, "ri", "rj", ["i", "j"]), "ri", "rj", ["i", "j"]).withColumnRenamed("mi", "signal_mi")


def pair_regression(pairs: DataFrame, stimulus: str) -> DataFrame:
    """Pearson r of each pair's responses under each stimulus; null where a response is constant."""
    return pairs.groupBy("i", "j", stimulus).agg(F.corr(F.col("ri").cast("double"), F.col("rj").cast("double")).alias("r"))
