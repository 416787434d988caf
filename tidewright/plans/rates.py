"""ROC, series and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.operators import roc, series
from tidewright.plans.information import r6, r6_of
from tidewright.session import read_table

FRAME = 32
DAY_US = 86_400_000_000


def user_series(spark, sf):
    """Rows (user_id, i, v, event_id): each user's values in order of time."""
    e = read_table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("value").alias("v"), (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 10).alias("r4"))
    return series.indexed(e, ["user_id"], "ts", ["event_id"], F.floor(series.micros("ts") / DAY_US))


def user_frames(spark, sf):
    """Every user's series in frames; the last one of a user is a signal of its own, shorter length."""
    return series.frames(user_series(spark, sf), ["user_id"], "i", "v", FRAME, partial=True)


SERIES_SQL = "ser AS (SELECT user_id, event_id, value AS v, cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 10 AS r4, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
# n: the length of the frame
FRAMES_SQL = f"{SERIES_SQL}, fr AS (SELECT user_id, i // {FRAME} AS frame, cast(i % {FRAME} AS int) AS p, v, count(*) OVER (PARTITION BY user_id, i // {FRAME}) AS n FROM ser)"


def exploded(frames, column, name="v"):
    return frames.select("user_id", "frame", F.posexplode(column).alias("p", "x")).select("user_id", "frame", "p", r6_of(F.col("x"), name))


def _rates(spark, sf):
    return roc.rate_distributions(read_table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


def rate_distributions(spark, sf):
    return _rates(spark, sf).select("condition", "k", r6("p"))


def roc_curve(spark, sf):
    return roc.roc_curve(_rates(spark, sf), "A", "R").select("k", r6("fpr"), r6("tpr"))


def auc(spark, sf):
    return roc.area_under_curve(roc.roc_curve(_rates(spark, sf), "A", "R")).select(r6("auc"))


def auc_mannwhitney(spark, sf):
    return roc.auc_by_ranks(read_table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "A", "R").select(r6("auc"))


def decoding_auc(spark, sf):
    """How well each neuron's rate tells stimulus 0 from stimulus 1: area under the curve per neuron."""
    t = read_table(spark, sf, "decoding_trials").where(A.sound("rates", 22) & F.col("stimulus").isin(0, 1)).select("trial_id", "rates", "stimulus").dropDuplicates(["trial_id"])
    rows = t.select(F.posexplode("rates").alias("neuron", "v"), "stimulus").withColumn("k", F.floor(F.col("v") * 32))
    counts = rows.groupBy("neuron", "k").agg(F.count_if(F.col("stimulus") == 0).alias("n0"), F.count_if(F.col("stimulus") == 1).alias("n1"))
    from pyspark.sql import Window

    below = F.coalesce(F.sum("n0").over(Window.partitionBy("neuron").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = counts.select("neuron", (F.col("n1") * (below + F.col("n0") / 2)).alias("w"), "n0", "n1")
    return wins.groupBy("neuron").agg(r6_of(F.try_divide(F.sum("w"), F.sum("n0") * F.sum("n1")), "auc"))


def zscore(spark, sf):
    return series.zscore(read_table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", r6("z"))


def snr(spark, sf):
    """Mean value of a user as signal, the rest as noise, per event type."""
    e = read_table(spark, sf, "events").select("event_type", "user_id", "value")
    m = e.groupBy("event_type", "user_id").agg(F.avg("value").alias("signal"))
    return series.snr(e.join(m, ["event_type", "user_id"]).withColumn("noise", F.col("value") - F.col("signal")), "signal", "noise", ["event_type"]).select("event_type", r6("snr_power"), r6("snr_db"), r6("snr_rms"))


def trial_average(spark, sf):
    e = read_table(spark, sf, "events").select(F.hour("ts").alias("hour"), "value")
    return series.trial_average(e, "hour", "value").select("hour", r6("mean"), "repeats")


def _smooth(spark, sf, times):
    """Every user's whole series smoothed, under the frame and place of each value; only a series' own ends stay."""
    s = user_series(spark, sf).select("user_id", "i", "v")
    for _ in range(times):
        s = series.smoothed(s, ["user_id"], "i", "v")
    return s.select("user_id", F.floor(F.col("i") / FRAME).alias("frame"), (F.col("i") % FRAME).cast("int").alias("p"), r6("v"))


def moving_avg5(spark, sf):
    return _smooth(spark, sf, 1)


def smooth_twice(spark, sf):
    return _smooth(spark, sf, 2)


def pearson(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6_of(F.corr("l_quantity", "l_extendedprice"), "r"))


def spearman(spark, sf):
    return series.spearman(read_table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount").select("l_returnflag", r6("spearman"))


def xcorr_lag(spark, sf):
    return series.cross_correlation(user_series(spark, sf), ["user_id"], "i", "v", "r4", 500).select("user_id", "lag", F.round("r", 4).alias("r"))


QUERIES = {f.__name__: f for f in (rate_distributions, roc_curve, auc, auc_mannwhitney, decoding_auc, zscore, snr, trial_average, moving_avg5, smooth_twice, pearson, spearman, xcorr_lag)}
QUERIES |= {"moving_avg5_whole": moving_avg5, "smooth_twice_whole": smooth_twice}  # earlier names of the same
DIST_SQL = """
c AS (SELECT l_returnflag AS condition, cast(l_quantity AS bigint) AS k, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL AND l_quantity IS NOT NULL GROUP BY ALL),
t AS (SELECT condition, sum(n) AS total FROM c GROUP BY ALL), sp AS (SELECT condition, total, unnest(range((SELECT max(k) + 1 FROM c))) AS k FROM t),
dist AS (SELECT sp.condition, sp.k, coalesce(n, 0) / total AS p FROM sp LEFT JOIN c USING (condition, k))"""
CURVE_SQL = f"""{DIST_SQL},
tails AS (SELECT condition, k, sum(p) OVER (PARTITION BY condition ORDER BY k DESC) AS s FROM dist),
curve AS (SELECT k, sum(s) FILTER (condition = 'A') AS fpr, sum(s) FILTER (condition = 'R') AS tpr FROM tails GROUP BY k UNION ALL SELECT max(k) + 1, 0, 0 FROM tails)"""
MA = "CASE WHEN i < 2 OR i >= n - 2 THEN v ELSE avg(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS v"
SMOOTH_SQL = f"{SERIES_SQL}, s0 AS (SELECT user_id, i, v, count(*) OVER (PARTITION BY user_id) AS n FROM ser), s1 AS (SELECT user_id, i, n, {MA} FROM s0), s2 AS (SELECT user_id, i, n, {MA} FROM s1)"
PLACED = f"SELECT user_id, i // {FRAME} AS frame, cast(i % {FRAME} AS int) AS p, round(v, 6) + 0.0 AS v"
ORACLES = {
    "rate_distributions": f"WITH {DIST_SQL} SELECT condition, k, round(p, 6) + 0.0 AS p FROM dist",
    "roc_curve": f"WITH {CURVE_SQL} SELECT k, round(fpr, 6) + 0.0 AS fpr, round(tpr, 6) + 0.0 AS tpr FROM curve",
    "auc": f"WITH {CURVE_SQL}, s AS (SELECT (fpr - lag(fpr) OVER (ORDER BY k DESC)) * (tpr + lag(tpr) OVER (ORDER BY k DESC)) / 2 AS a FROM curve) SELECT round(abs(sum(a)), 6) + 0.0 AS auc FROM s",
    "auc_mannwhitney": "WITH a AS (SELECT l_quantity AS q, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_quantity AS q, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT round(sum(r.n * a.n * (CASE WHEN r.q > a.q THEN 1.0 WHEN r.q = a.q THEN 0.5 ELSE 0 END)) / ((SELECT sum(n) FROM a) * (SELECT sum(n) FROM r)), 6) + 0.0 AS auc FROM a, r",
    "decoding_auc": """WITH t AS (SELECT DISTINCT trial_id, rates, stimulus FROM decoding_trials WHERE len(rates) = 22 AND list_count(rates) = 22 AND NOT list_contains(rates, 'nan'::double) AND stimulus IN (0, 1)),
r AS (SELECT cast(i AS int) AS neuron, floor(rates[i + 1] * 32) AS k, stimulus FROM t, (SELECT unnest(range(22)) AS i))
SELECT a.neuron, round(avg(CASE WHEN b.k > a.k THEN 1.0 WHEN b.k = a.k THEN 0.5 ELSE 0.0 END), 6) + 0.0 AS auc FROM r a JOIN r b ON a.neuron = b.neuron AND a.stimulus = 0 AND b.stimulus = 1 GROUP BY ALL""",
    "zscore": "SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY event_type)",
    "snr": "WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type, user_id) AS s FROM events), p AS (SELECT event_type, avg(s * s) / avg((value - s) * (value - s)) AS q FROM m GROUP BY 1) SELECT event_type, round(q, 6) + 0.0 AS snr_power, round(10 * log10(q), 6) + 0.0 AS snr_db, round(sqrt(q), 6) + 0.0 AS snr_rms FROM p",
    "trial_average": "SELECT cast(hour(ts) AS int) AS hour, round(avg(value), 6) + 0.0 AS mean, count(value) AS repeats FROM events GROUP BY 1",
    "moving_avg5": f"WITH {SMOOTH_SQL} {PLACED} FROM s1",
    "smooth_twice": f"WITH {SMOOTH_SQL} {PLACED} FROM s2",
    "pearson": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS r FROM lineitem GROUP BY 1",
    "spearman": "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL) SELECT l_returnflag, round(corr(a, b), 6) + 0.0 AS spearman FROM r GROUP BY 1",
    "xcorr_lag": f"WITH {SERIES_SQL}, lags AS (SELECT unnest(range(-500, 501)) AS lag), u AS (SELECT DISTINCT user_id FROM ser), m AS (SELECT b.user_id, a.i - b.i AS lag, sum(a.v * b.r4) AS r FROM ser a JOIN ser b ON a.user_id = b.user_id AND a.i BETWEEN b.i - 500 AND b.i + 500 GROUP BY ALL) SELECT u.user_id, lags.lag, round(coalesce(r, 0.0), 4) AS r FROM u CROSS JOIN lags LEFT JOIN m ON m.user_id = u.user_id AND m.lag = lags.lag",
}
ORACLES |= {"moving_avg5_whole": ORACLES["moving_avg5"], "smooth_twice_whole": ORACLES["smooth_twice"]}
