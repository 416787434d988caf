"""Event-time queries: detection in user value series, spike trains of det_mad and stimulator_spikes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import events as E
from tidewright.operators import series
from tidewright.plans.information import r6
from tidewright.plans.rates import SERIES_SQL, user_series
from tidewright.session import read_table

BUCKET = 1_000_000


def detections(spark, sf):
    """Rows (rec, det_id, t, spike_idx): every detection once."""
    d = read_table(spark, sf, "det_mad").where("det_id IS NOT NULL AND rec IS NOT NULL AND ts IS NOT NULL")
    return d.select("rec", "det_id", series.micros("ts").alias("t"), "spike_idx").dropDuplicates(["det_id"])


def stimuli(spark, sf):
    s = read_table(spark, sf, "stimulator_spikes").where("stim_id IS NOT NULL AND rec IS NOT NULL AND ts IS NOT NULL")
    return s.select("rec", "stim_id", series.micros("ts").alias("t")).dropDuplicates(["stim_id"])


DET_SQL = "det AS (SELECT DISTINCT rec, det_id, epoch_us(ts) AS t, spike_idx FROM det_mad WHERE det_id IS NOT NULL AND rec IS NOT NULL AND ts IS NOT NULL)"
STIM_SQL = "stim AS (SELECT DISTINCT rec, stim_id, epoch_us(ts) AS t FROM stimulator_spikes WHERE stim_id IS NOT NULL AND rec IS NOT NULL AND ts IS NOT NULL)"


def mad_threshold(spark, sf):
    return E.mad_threshold(read_table(spark, sf, "events"), ["event_type"], "value").select("event_type", r6("sigma"), r6("threshold"))


def std_threshold(spark, sf):
    return E.std_threshold(read_table(spark, sf, "events"), ["event_type"], "value").select("event_type", r6("sigma"), r6("threshold"))


def islands_candidates(spark, sf):
    return E.suprathreshold_candidates(user_series(spark, sf), ["user_id"], "i", "v", 100.0).select("user_id", "i", r6("magnitude"))


def zero_cross(spark, sf):
    return E.zero_crossings(user_series(spark, sf), ["user_id"], "i", "v", -50.0)


def detect_spikes(spark, sf):
    s = user_series(spark, sf)
    return E.detect_spikes(s, ["user_id"], "i", "v", E.mad_threshold(s, ["user_id"], "v", 2.0), 3)


def detect_spikes_std(spark, sf):
    s = user_series(spark, sf)
    return E.detect_spikes(s, ["user_id"], "i", "v", E.std_threshold(s, ["user_id"], "v", 0.6), 3)


def extract_waveforms(spark, sf):
    s = user_series(spark, sf)
    w = E.extract_waveforms(s, E.suprathreshold_candidates(s, ["user_id"], "i", "v", 100.0), ["user_id"], "i", "v", 3, 5)
    return w.select("user_id", "center", F.posexplode("wf").alias("p", "v")).select("user_id", "center", "p", r6("v"))


def extract_aligned(spark, sf):
    """Waveforms around jittered spikes, moved back to the largest value nearby."""
    s = user_series(spark, sf)
    spikes = E.jittered(E.suprathreshold_candidates(s, ["user_id"], "i", "v", 100.0), "i", ["user_id", "i"], 2, 3)
    w = E.extract_waveforms(s, spikes, ["user_id"], "i", "v", 3, 5, align=2)
    return w.select("user_id", "center", F.posexplode("wf").alias("p", "v")).select("user_id", "center", "p", r6("v"))


def mean_waveform(spark, sf):
    from tidewright.functions import arrays as A

    w = read_table(spark, sf, "spike_waveforms").where(A.sound("waveforms", 91) & F.col("spike_id").isNotNull()).select("spike_id", "rec", "waveforms").dropDuplicates(["spike_id"])
    return E.mean_waveform(w, ["rec"], "waveforms").select("rec", "pos", "mean")


def isi_hist(spark, sf):
    return E.isi_histogram(E.intervals(detections(spark, sf), ["rec"], "t", BUCKET), ["rec"], 100_000)


def refractory_violations(spark, sf):
    return E.refractory_violations(E.intervals(detections(spark, sf), ["rec"], "t", BUCKET), ["rec"], 1000)


def raster(spark, sf):
    return E.range_join(detections(spark, sf), stimuli(spark, sf), ["rec"], "t", "t", -2000, 2000)


def psth(spark, sf):
    return E.psth(detections(spark, sf), stimuli(spark, sf), ["rec"], "t", "t", -5000, 5000, 500).select("rec", "bin", "n", r6("rate"))


def psth_effect(spark, sf):
    return E.psth_effect(E.psth(detections(spark, sf), stimuli(spark, sf), ["rec"], "t", "t", -5000, 5000, 500), ["rec"], 10)


def spike_correlogram(spark, sf):
    """Counts of detections by their distance in ms from each stimulator spike, over all recordings."""
    h = E.psth(detections(spark, sf), stimuli(spark, sf), ["rec"], "t", "t", -50_000, 50_000, 1000)
    return h.groupBy("bin").agg(F.sum("n").alias("n"))


def match_detections(spark, sf):
    return E.match_detections(detections(spark, sf), stimuli(spark, sf), ["rec"], "det_id", "stim_id", "t", "t", 500)


def precision_recall(spark, sf):
    d, s = detections(spark, sf), stimuli(spark, sf)
    return E.precision_recall(E.match_detections(d, s, ["rec"], "det_id", "stim_id", "t", "t", 500), d, s, ["rec"])


def jitter(spark, sf):
    return E.jittered(detections(spark, sf).where("spike_idx IS NOT NULL"), "spike_idx", ["det_id"], 5, 3).select("det_id", "spike_idx")


QUERIES = {
    f.__name__: f
    for f in (
        mad_threshold, std_threshold, islands_candidates, zero_cross, detect_spikes, detect_spikes_std, extract_waveforms, extract_aligned, mean_waveform,
        isi_hist, refractory_violations, raster, psth, psth_effect, spike_correlogram, match_detections, precision_recall, jitter,
    )
}
ISLANDS_SQL = f"""{SERIES_SQL}, ab AS (SELECT user_id, i, abs(v) AS m, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM ser WHERE abs(v) > 100),
isl AS (SELECT user_id, i, m, row_number() OVER (PARTITION BY user_id, g ORDER BY m DESC, i) AS r FROM ab), cand AS (SELECT user_id, i, m FROM isl WHERE r = 1)"""
ISI_SQL = f"{DET_SQL}, isi AS (SELECT rec, t, t - lag(t) OVER (PARTITION BY rec ORDER BY t) AS isi FROM det)"


def _psth_sql(start: int, end: int, width: int) -> str:
    bins = (end - start) // width
    return f"""{DET_SQL}, {STIM_SQL}, ev AS (SELECT rec, count(*) AS e FROM stim GROUP BY 1),
hit AS (SELECT s.rec, (d.t - s.t - ({start})) // {width} AS bin, count(*) AS n FROM stim s JOIN det d ON d.rec = s.rec AND d.t >= s.t + ({start}) AND d.t < s.t + {end} GROUP BY ALL),
hist AS (SELECT ev.rec, bin, coalesce(n, 0) AS n, coalesce(n, 0) / e AS rate FROM (SELECT rec, e, unnest(range({bins})) AS bin FROM ev) ev LEFT JOIN hit USING (rec, bin))"""


ORACLES = {
    "mad_threshold": "SELECT event_type, round(median(abs(value)) / 0.6745, 6) + 0.0 AS sigma, round(4 * median(abs(value)) / 0.6745, 6) + 0.0 AS threshold FROM events GROUP BY 1",
    "std_threshold": "SELECT event_type, round(stddev_pop(value), 6) + 0.0 AS sigma, round(stddev_pop(value) / 1.5, 6) + 0.0 AS threshold FROM events GROUP BY 1",
    "islands_candidates": f"WITH {ISLANDS_SQL} SELECT user_id, i, round(m, 6) + 0.0 AS magnitude FROM cand",
    "zero_cross": f"WITH {SERIES_SQL}, w AS (SELECT user_id, i, v - 50 AS v, lag(v - 50) OVER (PARTITION BY user_id ORDER BY i) AS p FROM ser) SELECT user_id, i FROM w WHERE p * v < 0 AND v < 0",
    "extract_waveforms": f"WITH {ISLANDS_SQL}, j AS (SELECT c.user_id, c.i AS center, cast(s.i - c.i + 3 AS int) AS p, s.v, count(*) OVER (PARTITION BY c.user_id, c.i) AS n FROM cand c JOIN ser s ON s.user_id = c.user_id AND s.i BETWEEN c.i - 3 AND c.i + 5) SELECT user_id, center, p, round(v, 6) + 0.0 AS v FROM j WHERE n = 9",
    "extract_aligned": f"""WITH {ISLANDS_SQL}, jt AS (SELECT user_id, i AS id, i + cast(('0x' || substr(md5(concat_ws('|', user_id, i, 3)), 1, 8)) AS bigint) % 5 - 2 AS i FROM cand),
al AS (SELECT j.user_id, j.id, s.i AS center, row_number() OVER (PARTITION BY j.user_id, j.id ORDER BY abs(s.v) DESC, s.i) AS r FROM jt j JOIN ser s ON s.user_id = j.user_id AND s.i BETWEEN j.i - 2 AND j.i + 2),
w AS (SELECT a.user_id, a.id, a.center, cast(s.i - a.center + 3 AS int) AS p, s.v, count(*) OVER (PARTITION BY a.user_id, a.id) AS n FROM al a JOIN ser s ON s.user_id = a.user_id AND s.i BETWEEN a.center - 3 AND a.center + 5 WHERE a.r = 1)
SELECT user_id, center, p, round(v, 6) + 0.0 AS v FROM w WHERE n = 9""",
    "mean_waveform": "WITH w AS (SELECT DISTINCT spike_id, rec, waveforms FROM spike_waveforms WHERE len(waveforms) = 91 AND list_count(waveforms) = 91 AND NOT list_contains(waveforms, 'nan'::double) AND spike_id IS NOT NULL) SELECT rec, cast(p AS int) AS pos, avg(waveforms[p + 1]) AS mean FROM w, (SELECT unnest(range(91)) AS p) GROUP BY ALL",
    "isi_hist": f"WITH {ISI_SQL}, top AS (SELECT rec, greatest(1, ceil(max(isi) / 100000.0)) AS n FROM isi WHERE isi IS NOT NULL GROUP BY 1), b AS (SELECT rec, cast(least(isi // 100000, n - 1) AS bigint) AS bin, count(*) AS n FROM isi JOIN top USING (rec) WHERE isi IS NOT NULL GROUP BY ALL), sp AS (SELECT rec, unnest(range(cast(n AS bigint))) AS bin FROM top) SELECT rec, bin, coalesce(b.n, 0) AS n FROM sp LEFT JOIN b USING (rec, bin)",
    "refractory_violations": f"WITH {ISI_SQL} SELECT rec, t, isi FROM isi WHERE isi < 1000",
    "raster": f"WITH {DET_SQL}, {STIM_SQL} SELECT s.rec, s.t AS event, d.t, d.t - s.t AS dt FROM stim s JOIN det d ON d.rec = s.rec AND d.t >= s.t - 2000 AND d.t < s.t + 2000",
    "psth": f"WITH {_psth_sql(-5000, 5000, 500)} SELECT rec, bin, n, round(rate, 6) + 0.0 AS rate FROM hist",
    "psth_effect": f"WITH {_psth_sql(-5000, 5000, 500)}, h AS (SELECT rec, cast(sum(CASE WHEN bin < 10 THEN n ELSE 0 END) AS bigint) AS before, cast(sum(CASE WHEN bin >= 10 THEN n ELSE 0 END) AS bigint) AS after FROM hist GROUP BY 1) SELECT *, CASE WHEN after > before THEN 'excitation' WHEN after < before THEN 'inhibition' ELSE 'none' END AS effect FROM h",
    "spike_correlogram": f"WITH {_psth_sql(-50000, 50000, 1000)} SELECT bin, cast(sum(n) AS bigint) AS n FROM hist GROUP BY 1",
    "jitter": f"WITH {DET_SQL} SELECT det_id, spike_idx + cast(('0x' || substr(md5(concat_ws('|', det_id, 3)), 1, 8)) AS bigint) % 11 - 5 AS spike_idx FROM det WHERE spike_idx IS NOT NULL",
}
