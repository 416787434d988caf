"""Pairing rows of two tables by nearest time within an entity.

Time is cut into buckets as wide as the tolerance: a match lies in the same or an adjacent bucket, so the
join is an equality on (entity, bucket). A busy entity is spread over its many buckets. Right rows of the
same entity and microsecond are merged first, so one bucket holds at most ``tolerance + 1`` right rows
however often rows are repeated, and a left row meets at most three buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_entity: str,
    right_entity: str,
    left_ts: str,
    right_ts: str,
    tolerance_us: int,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Rows (left_id, right_id, diff_us): for each left id the right row of its entity that is nearest in time.

    ``diff_us`` is right minus left time. Ties go to the earlier right row, then to the smaller right id.
    Rows with a null id, entity or time never match; with ``keep_unmatched`` left ids without a match come
    out with nulls. Repeated left rows give one row per left id (the nearest of any of them). Empty tables
    give an empty result; other columns of either table are ignored, so their names may clash.
    """
    if tolerance_us < 0:
        raise ValueError("tolerance_us must not be negative")
    width = max(1, tolerance_us)
    a = left.select(F.col(left_id).alias("_l"), F.col(left_entity).alias("_e"), micros(left_ts).alias("_lt"))
    usable = a.where("_l IS NOT NULL AND _e IS NOT NULL AND _lt IS NOT NULL")
    b = right.select(F.col(right_id).alias("_r"), F.col(right_entity).alias("_e"), micros(right_ts).alias("_rt"))
    b = b.where("_r IS NOT NULL AND _e IS NOT NULL AND _rt IS NOT NULL").groupBy("_e", "_rt").agg(F.min("_r").alias("_r"))
    bucket = lambda c: F.floor(F.col(c) / width)
    a2 = usable.withColumn("_b", F.explode(F.sequence(bucket("_lt") - 1, bucket("_lt") + 1)))
    met = a2.join(b.withColumn("_b", bucket("_rt")), ["_e", "_b"]).withColumn("_d", F.col("_rt") - F.col("_lt")).where(F.abs("_d") <= tolerance_us)
    best = met.groupBy("_l").agg(F.min(F.struct(F.abs("_d").alias("a"), F.col("_d").alias("d"), F.col("_r").alias("r"))).alias("_m"))
    out = best.select(F.col("_l").alias(left_id), F.col("_m.r").alias(right_id), F.col("_m.d").alias("diff_us"))
    if keep_unmatched:
        out = left.select(left_id).where(F.col(left_id).isNotNull()).distinct().join(out, left_id, "left")
    return out
