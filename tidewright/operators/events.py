"""Event times: detection in sampled signals, intervals, histograms around events, matching."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.series import chains, previous, with_range
from tidewright.session import checkpointed


def mad_threshold(df: DataFrame, keys: Sequence[str], value: str, k: float = 4.0) -> DataFrame:
    """(keys, sigma, threshold): sigma = median |v| / 0.6745, threshold = k sigma; both null where sigma is 0."""
    med = F.median(F.abs(F.col(value))) / 0.6745
    out = (df.groupBy(*keys) if keys else df).agg(F.nullif(med, F.lit(0.0)).alias("sigma"))
    return out.withColumn("threshold", F.col("sigma") * k)


def std_threshold(df: DataFrame, keys: Sequence[str], value: str, divisor: float = 1.5) -> DataFrame:
    """(keys, sigma, threshold): threshold = population deviation / divisor; both null for constant signals."""
    out = (df.groupBy(*keys) if keys else df).agg(F.nullif(F.stddev_pop(value), F.lit(0.0)).alias("sigma"))
    return out.withColumn("threshold", F.col("sigma") / divisor)


def suprathreshold_candidates(series: DataFrame, keys: Sequence[str], i: str, value: str, threshold: Column | float, stretch: int = 100_000) -> DataFrame:
    """One row (keys, i, magnitude) per run of consecutive positions with |value| > threshold: the first largest of the run.

    Positions above the threshold are few. Runs are found within stretches of ``stretch`` positions, each
    with the last earlier position known from its neighbour, so a long signal isn't one task.
    """
    above = series.select(*keys, F.col(i).alias("_i"), F.abs(F.col(value)).alias("_m")).where(F.col("_m") > threshold)
    above = above.withColumn("_s", F.floor(F.col("_i") / stretch))
    w = Window.partitionBy(*keys, "_s").orderBy("_i")
    marked = above.withColumn("_run", F.col("_i") - F.row_number().over(w))
    runs = marked.groupBy(*keys, "_s", "_run").agg(F.min("_i").alias("_a"), F.max("_i").alias("_z"), F.max(F.struct(F.col("_m"), (-F.col("_i")).alias("_n"))).alias("_t"))
    # runs that touch across the border of a stretch are joined: at most two runs per stretch take part
    w2 = Window.partitionBy(*keys).orderBy("_a")
    edge = (F.col("_a") % stretch == 0) | (F.col("_z") % stretch == stretch - 1)
    inner = runs.where(~edge)
    chained = runs.where(edge).withColumn("_new", (F.col("_a") != F.lag("_z").over(w2) + 1) | F.lag("_z").over(w2).isNull())
    chained = chained.withColumn("_g", F.sum(F.col("_new").cast("int")).over(w2)).groupBy(*keys, "_g").agg(F.max("_t").alias("_t"))
    out = inner.select(*keys, "_t").unionByName(chained.select(*keys, "_t"))
    return out.select(*keys, (-F.col("_t._n")).alias("i"), F.col("_t._m").alias("magnitude"))


def enforce_refractory(candidates: DataFrame, keys: Sequence[str], i: str, magnitude: str, min_gap: int) -> DataFrame:
    """The candidates that stay when, by falling magnitude, each blocks all within ``min_gap`` of it (inclusive).

    Of equal magnitudes the later position goes first. Candidates further apart than the gap can't block one
    another, so chains between larger gaps are settled alone, each as one array: a chain goes on while pauses stay below the gap, and costs n log n and its neighbours within the gap.
    """
    few = checkpointed(candidates.select(*keys, i, magnitude))  # read several times below; far fewer rows than the signal
    chained = chains(few, keys, i, min_gap, max(100_000, 8 * min_gap), "_chain")
    packed = chained.groupBy(*keys, "_chain").agg(F.collect_list(F.struct(F.col(magnitude).alias("m"), F.col(i).alias("i"))).alias("_p"))
    alone = packed.where("size(_p) = 1").select(*keys, F.col("_p")[0]["i"].alias(i), F.col("_p")[0]["m"].alias(magnitude))

    @F.pandas_udf(packed.schema["_p"].dataType)
    def settle(chains: pd.Series) -> pd.Series:
        def one(chain):
            at, size = np.array([c["i"] for c in chain]), np.array([c["m"] for c in chain])
            by_place = np.argsort(at, kind="stable")
            at, size = at[by_place], size[by_place]
            lo, hi = np.searchsorted(at, at - min_gap, "left"), np.searchsorted(at, at + min_gap, "right")
            blocked, kept = np.zeros(len(at), bool), []
            for k in np.lexsort((-at, -size)):
                if not blocked[k]:
                    blocked[lo[k] : hi[k]] = True
                    kept.append({"m": size[k].item(), "i": at[k].item()})
            return kept

        return chains.map(one)

    rest = packed.where("size(_p) > 1").select(*keys, F.explode(settle("_p")).alias("_e")).select(*keys, F.col("_e.i").alias(i), F.col("_e.m").alias(magnitude))
    return alone.unionByName(rest)


def detect_spikes(series: DataFrame, keys: Sequence[str], i: str, value: str, thresholds: DataFrame, min_gap: int) -> DataFrame:
    """Spikes (keys, i, magnitude): runs beyond their key's threshold, refractory gap enforced. Keys without a threshold have none."""
    bars = thresholds.where("threshold IS NOT NULL").select(*keys, "threshold")
    joined = series.join(bars, list(keys)) if keys else series.crossJoin(F.broadcast(bars))  # one row
    return enforce_refractory(suprathreshold_candidates(joined, keys, i, value, F.col("threshold")), keys, "i", "magnitude", min_gap)


def zero_crossings(series: DataFrame, keys: Sequence[str], i: str, value: str, offset: float = 0.1) -> DataFrame:
    """Positions where value + offset becomes negative after a positive position."""
    rows = series.select(*keys, F.col(i).alias("i"), (F.col(value) + offset).alias("v"))
    marked = previous(rows, keys, "i", "v", 100_000, "_p")
    return marked.where((F.col("_p.o") == F.col("i") - 1) & (F.col("_p.v") * F.col("v") < 0) & (F.col("v") < 0)).select(*keys, "i")


def extract_waveforms(series: DataFrame, spikes: DataFrame, keys: Sequence[str], i: str, value: str, pre: int, post: int, align: int = 0, stretch: int = 4096) -> DataFrame:
    """(keys, center, wf): the pre + post + 1 values around each spike; spikes without all of them are dropped.

    With ``align`` the center first moves to the largest |value| within +-align (the earliest of equals).
    Samples are packed once into stretches with margins; each spike meets exactly one stretch.
    """
    margin = max(pre, post) + align
    s = series.select(*keys, F.col(i).alias("_i"), F.col(value).cast("double").alias("_v"))
    home = lambda c: F.floor(c / stretch)
    sent = s.withColumn("_s", F.explode(F.array_distinct(F.array(home(F.col("_i") - margin), home(F.col("_i")), home(F.col("_i") + margin)))))
    packed = sent.groupBy(*keys, "_s").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_p"))
    first, last = F.col("_p")[0]["_i"], F.element_at("_p", -1)["_i"]
    values = F.transform("_p", lambda e: e["_v"])
    spaced = F.transform(F.sequence(first, last), lambda k: F.try_element_at(F.map_from_entries("_p"), k))  # where positions are missing
    packed = packed.select(*keys, "_s", first.alias("_from"), F.when(last - first + 1 == F.size("_p"), values).otherwise(spaced).alias("_m"))
    value_at = lambda k: F.when(k >= F.col("_from"), F.get("_m", (k - F.col("_from")).cast("int")))
    hits = spikes.select(*keys, F.col("i").cast("bigint").alias("_c")).withColumn("_s", home(F.col("_c")))
    met = hits.join(packed, [*keys, "_s"])
    if align:
        around = F.transform(F.sequence(F.col("_c") - align, F.col("_c") + align), lambda k: F.struct(F.abs(value_at(k)).alias("a"), (-k).alias("k")))
        met = met.withColumn("_c", -F.array_max(F.filter(around, lambda e: e["a"].isNotNull()))["k"])
    wf = F.transform(F.sequence(F.col("_c") - pre, F.col("_c") + post), value_at)
    return met.select(*keys, F.col("_c").alias("center"), wf.alias("wf")).where(F.forall("wf", lambda x: x.isNotNull()))


def mean_waveform(waveforms: DataFrame, keys: Sequence[str], wf: str) -> DataFrame:
    """(keys, pos, mean): mean of the waveforms at each position."""
    e = waveforms.select(*keys, F.posexplode(wf).alias("pos", "v"))
    return e.groupBy(*keys, "pos").agg(F.avg("v").alias("mean"))


def intervals(times: DataFrame, keys: Sequence[str], t: str, bucket_width: int) -> DataFrame:
    """(keys, t, isi): time since the previous event of the key, in the unit of ``t``; the first of a key has none.

    The previous event is found within buckets of time; the first of each bucket takes the last of the
    previous non-empty one, so a busy key is spread over its buckets.
    """
    rows = previous(times.select(*keys, F.col(t).alias("t")).where("t IS NOT NULL"), keys, "t", "t", bucket_width, "_p")
    return rows.select(*keys, "t", (F.col("t") - F.col("_p.o")).alias("isi")).where("isi IS NOT NULL")


def isi_histogram(isis: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """(keys, bin, n): counts of intervals per bin of ``width``, empty bins included, the last bin closed above.

    Keys without intervals have no rows.
    """
    bins = F.greatest(F.lit(1), F.ceil(F.max("isi") / width)).cast("bigint")
    top = isis.groupBy(*keys).agg(bins.alias("_n"))
    binned = isis.join(top, list(keys)).groupBy(*keys, F.least(F.floor(F.col("isi") / width), F.col("_n") - 1).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = with_range(top.withColumnRenamed("_n", "_top"), F.col("_top"), "bin").select(*keys, "bin")
    return spine.join(binned, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def refractory_violations(isis: DataFrame, keys: Sequence[str], refractory: int) -> DataFrame:
    """(keys, t, isi): events closer than ``refractory`` to the previous one."""
    return isis.where(F.col("isi") < refractory)


def range_join(times: DataFrame, events: DataFrame, keys: Sequence[str], t: str, event_t: str, start: int, end: int) -> DataFrame:
    """Every (event, time) of a key with start <= t - event_t < end, as (keys, event, t, dt).

    Both sides are cut into buckets as wide as the window; an event is sent to the two or three buckets its
    window meets, so the join is an equality and a busy key is spread over its buckets.
    """
    if end <= start:
        raise ValueError("the window must not be empty")
    width = end - start
    a = times.select(*keys, F.col(t).alias("t")).where("t IS NOT NULL").withColumn("_b", F.floor(F.col("t") / width))
    e = events.select(*keys, F.col(event_t).alias("event")).where("event IS NOT NULL")
    e = e.withColumn("_b", F.explode(F.sequence(F.floor((F.col("event") + start) / width), F.floor((F.col("event") + end - 1) / width))))
    met = a.join(e, [*keys, "_b"]).withColumn("dt", F.col("t") - F.col("event"))
    return met.where((F.col("dt") >= start) & (F.col("dt") < end)).select(*keys, "event", "t", "dt")


def psth(times: DataFrame, events: DataFrame, keys: Sequence[str], t: str, event_t: str, start: int, end: int, width: int) -> DataFrame:
    """(keys, bin, n, rate): events' counts per bin of the window around them, rate = n / number of events of the key.

    Empty bins are included for every key that has events.
    """
    bins = -(-(end - start) // width)
    met = range_join(times, events, keys, t, event_t, start, end)
    counts = met.groupBy(*keys, F.floor((F.col("dt") - start) / width).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    base = events.where(F.col(event_t).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_e")) if keys else events.where(F.col(event_t).isNotNull()).agg(F.count(F.lit(1)).alias("_e"))
    spine = base.select(*keys, "_e", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return spine.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.greatest("_e", F.lit(1))).alias("rate"))


def psth_effect(histogram: DataFrame, keys: Sequence[str], split: int) -> DataFrame:
    """(keys, before, after, effect): summed rates before and from bin ``split``; excitation, inhibition or none."""
    g = histogram.groupBy(*keys) if keys else histogram
    out = g.agg(F.sum(F.when(F.col("bin") < split, F.col("n")).otherwise(0)).alias("before"), F.sum(F.when(F.col("bin") >= split, F.col("n")).otherwise(0)).alias("after"))
    return out.withColumn("effect", F.when(F.col("after") > F.col("before"), "excitation").when(F.col("after") < F.col("before"), "inhibition").otherwise("none"))


def match_detections(detected: DataFrame, truth: DataFrame, keys: Sequence[str], det_id: str, true_id: str, det_t: str, true_t: str, tolerance: int) -> DataFrame:
    """(keys, det_id, true_id, dt): one-to-one pairs within the tolerance that match as many as possible, nearest first among those.

    Pairs within the tolerance fall apart into chains with no pair between them. A chain is matched in order
    of time by dynamic programming: most pairs, then least total |dt|. On a line an optimal matching never
    crosses, so this is the optimum of the whole assignment.
    """
    both = detected.select(*keys, F.lit(0).alias("_k"), F.col(det_id).alias("_id"), F.col(det_t).alias("_t")).unionByName(
        truth.select(*keys, F.lit(1).alias("_k"), F.col(true_id).alias("_id"), F.col(true_t).alias("_t"))
    ).where("_t IS NOT NULL AND _id IS NOT NULL")
    chained = chains(checkpointed(both), keys, "_t", tolerance, max(1_000_000, 8 * tolerance), "_c")
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("_k") == k, F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")))))
    packed = chained.groupBy(*keys, "_c").agg(side(0).alias("_a"), side(1).alias("_z")).where("size(_a) > 0 AND size(_z) > 0")
    simple = (F.size("_a") == 1) & (F.size("_z") == 1)
    row = lambda a, z: F.struct(a["id"].alias("a"), z["id"].alias("z"), (z["t"] - a["t"]).alias("dt"))
    one = packed.where(simple).select(*keys, row(F.col("_a")[0], F.col("_z")[0]).alias("_m"))
    types = T.ArrayType(one.schema["_m"].dataType)

    @F.pandas_udf(types)
    def solve(a: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([_best_matching(list(x), list(y), tolerance) for x, y in zip(a, z)])

    many = packed.where(~simple).select(*keys, F.explode(solve("_a", "_z")).alias("_m"))
    return one.unionByName(many).where(F.abs("_m.dt") <= tolerance).select(*keys, F.col("_m.a").alias(det_id), F.col("_m.z").alias(true_id), F.col("_m.dt").alias("dt"))


def _best_matching(a: list, b: list, tolerance: int) -> list[dict]:
    """Most pairs within the tolerance, then the least total distance, of two lists in order of time.

    Only pairs within the tolerance are tabled: before them nothing of ``b`` can be matched any more, behind
    them nothing yet, so the table is as wide as the tolerance, not as the chain.
    """
    n, m = len(a), len(b)
    at, bt = [e["t"] for e in a], [e["t"] for e in b]
    lo, hi = [bisect.bisect_left(bt, t - tolerance) for t in at], [bisect.bisect_right(bt, t + tolerance) for t in at]
    best: list[list[tuple[int, int]]] = [[]] * n

    def value(i: int, j: int) -> tuple[int, int]:
        while i < n and j > hi[i]:
            i += 1
        return (0, 0) if i == n else best[i][max(j, lo[i]) - lo[i]]

    for i in range(n - 1, -1, -1):
        row = [(0, 0)] * (hi[i] - lo[i] + 1)
        row[-1] = value(i + 1, hi[i])
        for j in range(hi[i] - 1, lo[i] - 1, -1):
            k, d = value(i + 1, j + 1)
            row[j - lo[i]] = max(value(i + 1, j), row[j + 1 - lo[i]], (k + 1, d - abs(at[i] - bt[j])))
        best[i] = row
    out, i, j = [], 0, 0
    while i < n and j < m:
        d = abs(at[i] - bt[j])
        v = value(i, j)
        if d <= tolerance and v == (value(i + 1, j + 1)[0] + 1, value(i + 1, j + 1)[1] - d):
            out.append({"a": a[i]["id"], "z": b[j]["id"], "dt": bt[j] - at[i]})
            i, j = i + 1, j + 1
        elif v == value(i + 1, j):
            i += 1
        else:
            j += 1
    return out


def precision_recall(matches: DataFrame, detected: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, hits, detections, truths, precision, recall, f1); empty sides count as one, so nothing divides by zero."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = n(detected, "detections").join(n(truth, "truths"), list(keys), "full").join(n(matches, "hits"), list(keys), "left").fillna(0, ["detections", "truths", "hits"])
    out = out.withColumn("precision", F.col("hits") / F.greatest("detections", F.lit(1))).withColumn("recall", F.col("hits") / F.greatest("truths", F.lit(1)))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))


def jittered(spikes: DataFrame, i: str, ids: Sequence[str], spread: int, seed: int) -> DataFrame:
    """Positions moved by a whole number in -spread..spread, drawn by a hash of the ids: reproducible."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *ids, F.lit(seed))), 1, 8), 16, 10).cast("bigint")
    return spikes.withColumn(i, F.col(i) + u % (2 * spread + 1) - spread)
