"""ROC analysis of integer rates under two conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.series import previous, running_before, with_range


def rate_distributions(df: DataFrame, condition: str, rate: str) -> DataFrame:
    """Rows (condition, k, p): share of each integer rate 0..max over all conditions, zeros included.

    Rates must be non-negative whole numbers (an error otherwise); null rates and conditions are left out.
    """
    bad = (F.col(rate) < 0) | (F.col(rate) != F.floor(F.col(rate)))
    k = F.when(bad, F.raise_error(F.lit("rates must be non-negative integers")).cast("bigint")).otherwise(F.col(rate).cast("bigint"))
    counts = df.where(F.col(condition).isNotNull() & F.col(rate).isNotNull()).groupBy(F.col(condition).alias("condition"), k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("condition").agg(F.sum("n").alias("total"))
    top = counts.agg(F.max("k").alias("top"))
    spine = with_range(sums.join(F.broadcast(top)), F.col("top") + 1, "k").select("condition", "total", "k")  # top is one row
    return spine.join(counts, ["condition", "k"], "left").select("condition", "k", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("p"))


def roc_curve(distributions: DataFrame, negative: str, positive: str) -> DataFrame:
    """Rows (k, fpr, tpr): tail shares P(rate >= k) under both conditions, with the point (0, 0) at k = max + 1.

    The distributions are one row per bin, so one running sum per condition suffices.
    """
    tail = Window.partitionBy("condition").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    tails = distributions.where(F.col("condition").isin(negative, positive)).withColumn("t", F.sum("p").over(tail))
    points = tails.groupBy("k").agg(F.sum(F.when(F.col("condition") == negative, F.col("t"))).alias("fpr"), F.sum(F.when(F.col("condition") == positive, F.col("t"))).alias("tpr"))
    end = points.agg((F.max("k") + 1).alias("k"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).where("k IS NOT NULL")
    return points.unionByName(end)


def area_under_curve(curve: DataFrame) -> DataFrame:
    """One row (auc): absolute trapezoid area under the curve of one row per bin."""
    pairs = previous(curve.withColumn("_xy", F.struct("fpr", "tpr")), [], "k", "_xy", 4096, "last").where("last IS NOT NULL")
    step = (F.col("fpr") - F.col("last.v.fpr")) * (F.col("tpr") + F.col("last.v.tpr")) / 2
    return pairs.select(step.alias("a")).agg(F.abs(F.sum("a")).alias("auc"))


def auc_by_ranks(df: DataFrame, condition: str, rate: str, negative: str, positive: str) -> DataFrame:
    """One row (auc): probability that a positive rate exceeds a negative one, ties counting half (Mann-Whitney).

    Counted per distinct rate; the rates below each are counted by ranges, so scores may all differ.
    """
    counts = df.where(F.col(rate).isNotNull()).groupBy(F.col(rate).alias("k")).agg(
        F.count_if(F.col(condition) == negative).alias("n0"), F.count_if(F.col(condition) == positive).alias("n1")
    )
    wins = running_before(counts, "k", "n0", "below").select((F.col("n1") * (F.col("below") + F.col("n0") / 2)).alias("w"), "n0", "n1")
    return wins.agg(F.try_divide(F.sum("w"), F.sum("n0") * F.sum("n1")).alias("auc"))
