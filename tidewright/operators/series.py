"""Ordered series: exact positions without one task per series, windows, correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.session import checkpointed


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def indexed(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], bucket: Column, name: str = "i") -> DataFrame:
    """``df`` with the position (from 0) of each row in the order of its series.

    ``bucket`` must not fall as ``order`` grows. Rows are numbered within (keys, bucket), and buckets are
    offset by the counts of earlier ones, so a series with many rows is spread over its buckets.
    """
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order, *ties)) - 1)
    joined = inside.join(offsets, [*keys, "_b"]) if keys else inside.join(offsets, "_b")
    return joined.withColumn(name, (F.col("_o") + F.col("_r")).cast("bigint")).drop("_b", "_o", "_r")


def running_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows of smaller ``order``, which must be unique.

    Rows are cut into ranges of the order; each range starts at the sum of the earlier ones, so no task orders all rows.
    """
    ranged = checkpointed(df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))  # its partitions are referred to twice
    sums = ranged.groupBy("_p").agg(F.sum(value).alias("_n"))  # one row per partition
    offsets = sums.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_in", inside).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_in")).drop("_p", "_o", "_in")


def with_range(df: DataFrame, n: Column, name: str, step: int = 4096) -> DataFrame:
    """``df`` repeated for ``name`` = 0 .. n - 1 (n > 0), in arrays of at most ``step`` numbers however large n is."""
    blocks = df.withColumn("_n", n.cast("bigint")).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / step))))
    return blocks.withColumn(name, F.explode(F.sequence(F.col("_k") * step, F.least(F.col("_k") * step + step, F.col("_n")) - 1))).drop("_n", "_k")


def previous(df: DataFrame, keys: Sequence[str], order: str, value: str, bucket_width: int, name: str) -> DataFrame:
    """``df`` with ``name``: struct (o, v) of the order and value of the row before, in the order of its series; null for the first.

    Rows are ordered within (keys, bucket of ``bucket_width``); the first of a bucket takes the last of the
    previous non-empty one, so a busy series is spread over its buckets. Rows of equal order are taken by
    value.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / bucket_width)).withColumn("_s", F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    last = rows.groupBy(*keys, "_b").agg(F.max("_s").alias("_last"))
    before = last.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_before"))
    inside = F.lag("_s").over(Window.partitionBy(*keys, "_b").orderBy("_s"))
    return rows.withColumn("_in", inside).join(before, [*keys, "_b"]).withColumn(name, F.coalesce("_in", "_before")).drop("_b", "_s", "_in", "_before")


def chains(df: DataFrame, keys: Sequence[str], t: str, gap: int, bucket_width: int, name: str) -> DataFrame:
    """``df`` with ``name``: the time at which the row's chain starts; a chain ends where a pause exceeds ``gap``.

    Starts are found within buckets and carried over from earlier buckets, so a busy key is spread over its
    buckets.
    """
    marked = previous(df, keys, t, t, bucket_width, "_before_t")
    marked = marked.withColumn("_new", F.when(F.col("_before_t").isNull() | (F.col(t) - F.col("_before_t.o") > gap), F.col(t))).drop("_before_t").withColumn("_cb", F.floor(F.col(t) / bucket_width))
    tops = marked.groupBy(*keys, "_cb").agg(F.max("_new").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_cb", F.max("_top").over(earlier).alias("_carried"))
    upto = Window.partitionBy(*keys, "_cb").orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_own", F.max("_new").over(upto)).join(carried, [*keys, "_cb"]).withColumn(name, F.coalesce("_own", "_carried")).drop("_cb", "_new", "_own", "_carried")


def frames(series: DataFrame, keys: Sequence[str], i: str, value: str, size: int, partial: bool = False) -> DataFrame:
    """Rows (keys, frame, x): consecutive stretches of ``size`` values as arrays; the last, shorter one only if ``partial``."""
    packed = series.groupBy(*keys, F.floor(F.col(i) / size).alias("frame")).agg(F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.col(value).cast("double").alias("v")))).alias("_p"))
    out = packed.select(*keys, "frame", F.transform("_p", lambda e: e["v"]).alias("x"))
    return out if partial else out.where(F.size("x") == size)


def smoothed(series: DataFrame, keys: Sequence[str], i: str, value: str, half: int = 2, width: int = 1024) -> DataFrame:
    """Rows (keys, i, value): centred means of 2 half + 1 values over whole series; the first and last ``half`` of a series stay.

    A value near the end of a stretch of ``width`` is also sent to the neighbouring stretch, so every stretch
    has the neighbours of its own values and no task holds a whole series.
    """
    if not 0 <= half <= width:
        raise ValueError("half must be between 0 and width")
    at = lambda by: F.floor((F.col(i) + by) / width)
    sent = series.select(*keys, F.col(i).alias("_i"), F.col(value).cast("double").alias("_v"), F.explode(F.array_distinct(F.array(at(0), at(-half), at(half)))).alias("_s"))
    packed = sent.groupBy(*keys, "_s").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_p"))
    means = packed.select(*keys, "_s", F.explode(F.arrays_zip(F.transform("_p", lambda e: e["_i"]).alias("i"), A.moving_average(F.transform("_p", lambda e: e["_v"]), half).alias("v"))).alias("_e"))
    return means.where(F.floor(F.col("_e.i") / width) == F.col("_s")).select(*keys, F.col("_e.i").alias(i), F.col("_e.v").alias(value))


def _mean_sd(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))


def zscore(df: DataFrame, keys: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """(x - mean) / population deviation per key; null where the values of a key are constant.

    Mean and deviation are aggregated and joined back, so no task holds a whole key.
    """
    moments = _mean_sd(df, keys, value)
    joined = df.join(moments, list(keys)) if keys else df.crossJoin(F.broadcast(moments))  # one row
    return joined.withColumn(name, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def snr(df: DataFrame, signal: str, noise: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, snr_power, snr_db, snr_rms): mean square of signal over noise; null where the noise is all zero."""
    g = df.groupBy(*keys) if keys else df
    power = F.try_divide(F.avg(F.col(signal) * F.col(signal)), F.nullif(F.avg(F.col(noise) * F.col(noise)), F.lit(0.0)))
    return g.agg(power.alias("snr_power")).withColumn("snr_db", F.when(F.col("snr_power") > 0, 10 * F.log10("snr_power"))).withColumn("snr_rms", F.sqrt("snr_power"))


def trial_average(df: DataFrame, position: str, value: str) -> DataFrame:
    """Mean over the repeats at each position."""
    return df.groupBy(position).agg(F.avg(value).alias("mean"), F.count(value).alias("repeats"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties, per key.

    Mean ranks come from counts of distinct values: rows of equal value are merged before any ordering.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))

    def ranks(c: str, out: str) -> DataFrame:
        counts = rows.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return counts.select(*keys, c, (upto - (F.col("_n") - 1) / 2).alias(out))

    ranked = rows.join(ranks("_x", "_rx"), [*keys, "_x"]).join(ranks("_y", "_ry"), [*keys, "_y"])
    return (ranked.groupBy(*keys) if keys else ranked).agg(F.corr("_rx", "_ry").alias("spearman"))


def cross_correlation(series: DataFrame, keys: Sequence[str], i: str, a: str, b: str, max_lag: int) -> DataFrame:
    """Rows (keys, lag, r) with r = sum_i a[i + lag] b[i] for |lag| <= max_lag; missing positions count as 0.

    A series is cut into stretches: a's values are sent to the stretch of their position and, near its ends,
    to the neighbouring one, so each stretch gives its share of every lag alone and the shares are summed.
    """
    width = max(4 * max_lag, 256)
    s = series.select(*keys, F.col(i).alias("_i"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    home = F.floor(F.col("_i") / width)
    sent = s.withColumn("_s", F.explode(F.array_distinct(F.array(home, F.floor((F.col("_i") - max_lag) / width), F.floor((F.col("_i") + max_lag) / width)))))
    packed = sent.groupBy(*keys, "_s").agg(F.collect_list(F.struct((F.col("_i") - F.col("_s") * width + max_lag).cast("int").alias("k"), F.coalesce("_a", F.lit(0.0)).alias("a"), F.coalesce("_b", F.lit(0.0)).alias("b"))).alias("_p"))

    @F.pandas_udf("array<double>")
    def shares(at: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        def one(k, u, v):
            left, right = np.zeros(width + 2 * max_lag), np.zeros(width + 2 * max_lag)
            left[k], right[k] = u, v  # place 0 is max_lag before the stretch
            return np.correlate(left, right[max_lag : max_lag + width], "valid")

        return pd.Series([one(k, u, v) for k, u, v in zip(at, x, y)])

    field = lambda f: F.transform("_p", lambda e: e[f])
    per = packed.select(*keys, F.posexplode(shares(field("k"), field("a"), field("b"))).alias("_l", "_r"))
    return per.groupBy(*keys, (F.col("_l") - max_lag).cast("bigint").alias("lag")).agg(F.sum("_r").alias("r"))
