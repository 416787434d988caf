"""Clustering queries on embeddings and spike waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.operators import cluster as K
from tidewright.plans.classification import VEC_SQL, vectors
from tidewright.plans.fourier import FS, WAVE_SQL, waveforms
from tidewright.plans.information import r6
from tidewright.session import checkpointed, read_table

UNITS = 3


def align_waveforms(spark, sf):
    w = K.align_waveforms(waveforms(spark, sf), "x", max_shift=6)
    return w.select("spike_id", "shift", (F.round(F.get("aligned", F.lit(30)), 6) + 0.0).alias("center"))


def cluster_templates(spark, sf):
    t = K.cluster_templates(vectors(spark, sf), "x", "label")
    return t.select("label", F.posexplode("template").alias("p", "v")).select("label", "p", r6("v"))


def screen_overlaps(spark, sf):
    v = vectors(spark, sf)
    return K.screen_overlaps(v, "id", "x", "label", K.cluster_templates(v, "x", "label"), 1.2, 1.05).select("id", "label", r6("e1"), r6("e2"), "is_overlap")


def _start(spark, sf):
    """Three starting centers: the means of labels 0, 1 and 2."""
    from tidewright.operators.classify import class_means

    return [r["mean"] for r in class_means(vectors(spark, sf).where("label < 3"), "x", "label").orderBy("label").collect()]


def kmeans_lloyd_fixed(spark, sf):
    return K.lloyd(vectors(spark, sf), "id", "x", _start(spark, sf), 3, -1.0)[0].select("id", "cluster", r6("d2"))


def ari(spark, sf):
    """Agreement of three k-means clusters with the ten labels."""
    v = vectors(spark, sf)
    c = K.lloyd(v, "id", "x", _start(spark, sf), 3, -1.0)[0]
    return K.adjusted_rand(c.join(v.select("id", "label"), "id"), "label", "cluster").select(r6("ari"))


def _converged(spark, sf):
    """Lloyd's iteration from the means of all labels until the centers stay."""
    from tidewright.operators.classify import class_means

    v = checkpointed(vectors(spark, sf))
    start = [r["mean"] for r in class_means(v, "x", "label").orderBy("label").collect()]
    return v, K.lloyd(v, "id", "x", start, 300, 1e-9)[0]


def kmeans_lloyd_converged(spark, sf):
    return _converged(spark, sf)[1].select("id", "cluster", r6("d2"))


def ari_converged(spark, sf):
    """Agreement of converged k-means with as many clusters as labels with the labels."""
    v, c = _converged(spark, sf)
    return K.adjusted_rand(c.join(v.select("id", "label"), "id"), "label", "cluster").select(r6("ari"))


def cluster_accuracy(spark, sf):
    v = vectors(spark, sf)
    c = checkpointed(K.kmeans(v, "x", 10).select("id", "label", "cluster"))
    acc = K.clustering_accuracy(c, "label", "cluster")
    return K.adjusted_rand(c, "label", "cluster").withColumn("accuracy", F.lit(acc))


def pca_shares(spark, sf):
    """Shares of the variance along the first three axes of the waveforms, and the spread of each projection."""
    projected, shares = K.pca(waveforms(spark, sf), "x", 3)
    p = projected.select(F.posexplode("pcs").alias("axis", "v")).groupBy("axis").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    return p.withColumn("share", F.get(F.array(*[F.lit(s) for s in shares]), F.col("axis")))


def pca_kmeans(spark, sf):
    return K.sort_pca(waveforms(spark, sf), "spike_id", "x", UNITS)


def le_kmeans(spark, sf):
    return K.sort_spd(waveforms(spark, sf).where(F.exists("x", lambda v: v != 0)), "spike_id", "x", UNITS)


def sort_refined(spark, sf):
    return K.sort_refined(waveforms(spark, sf).where(F.exists("x", lambda v: v != 0)), "spike_id", "x", UNITS, FS)


def fusion_features(spark, sf):
    w = K.fusion_features(waveforms(spark, sf).where(F.exists("x", lambda v: v != 0)), "x", "f")
    return w.select("spike_id", F.size("f").alias("size"), A.norm("f").alias("norm"))


def regime_ari(spark, sf):
    """Agreement between sessions and stimuli of the decoding trials (near 0: sessions hold all stimuli)."""
    t = read_table(spark, sf, "decoding_trials").where("trial_id IS NOT NULL").select("trial_id", "ses", "stimulus").dropDuplicates(["trial_id"])
    return K.adjusted_rand(t, "ses", "stimulus").select(r6("ari"))


QUERIES = {f.__name__: f for f in (align_waveforms, cluster_templates, screen_overlaps, kmeans_lloyd_fixed, ari, cluster_accuracy, pca_shares, pca_kmeans, le_kmeans, sort_refined, fusion_features, regime_ari)}
#: Without SQL: the SQL of kmeans_lloyd_fixed and ari unrolls three rounds of three clusters.
QUERIES |= {f.__name__: f for f in (kmeans_lloyd_converged, ari_converged)}
ALIGN_SQL = f"""{WAVE_SQL}, tm AS (SELECT list(m ORDER BY p) AS t FROM (SELECT p, avg(x[p + 1]) AS m FROM wv, (SELECT unnest(range(91)) AS p) GROUP BY p)),
op AS (SELECT spike_id, x, s, round(list_dot_product(list_transform(range(91), lambda i: x[((i - s) % 91 + 91) % 91 + 1]), t), 9) AS d FROM wv, tm, (SELECT unnest(range(-6, 7)) AS s))"""
TPL_SQL = f"{VEC_SQL}, tpl AS (SELECT label, list(m ORDER BY p) AS t FROM (SELECT label, p, median(x[p + 1]) AS m FROM vec, (SELECT unnest(range(64)) AS p) GROUP BY ALL) GROUP BY 1)"


def _lloyd_sql() -> str:
    out = f"{VEC_SQL}, c0 AS (SELECT label AS k, list(m ORDER BY p) AS c FROM (SELECT label, p, avg(x[p + 1]) AS m FROM vec, (SELECT unnest(range(64)) AS p) WHERE label < 3 GROUP BY ALL) GROUP BY 1)"
    for r in range(4):
        out += f""", a{r} AS (SELECT id, label, x, cluster, d2 FROM (SELECT v.id, v.label, v.x, k AS cluster, round(list_distance(v.x, c) ** 2, 12) AS d2, row_number() OVER (PARTITION BY v.id ORDER BY round(list_distance(v.x, c) ** 2, 12), k) AS r FROM vec v, c{r}) WHERE r = 1)"""
        if r < 3:
            out += f", c{r + 1} AS (SELECT cluster AS k, list(m ORDER BY p) AS c FROM (SELECT cluster, p, avg(x[p + 1]) AS m FROM a{r}, (SELECT unnest(range(64)) AS p) GROUP BY ALL) GROUP BY 1)"
    return out


def ari_sql(source: str, truth: str, cluster: str) -> str:
    return f"""ct AS (SELECT {truth} AS t, {cluster} AS c, count(*) AS n FROM {source} WHERE {truth} IS NOT NULL AND {cluster} IS NOT NULL GROUP BY ALL),
sm AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ct GROUP BY t)) AS a,
 (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ct GROUP BY c)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM ct) AS w)
SELECT round((ij - a * b / w) / ((a + b) / 2 - a * b / w), 6) + 0.0 AS ari FROM sm"""


ORACLES = {
    "align_waveforms": f"WITH {ALIGN_SQL} SELECT spike_id, cast(s AS int) AS shift, round(x[((30 - s) % 91 + 91) % 91 + 1], 6) + 0.0 AS center FROM (SELECT *, row_number() OVER (PARTITION BY spike_id ORDER BY d DESC, s) AS r FROM op) WHERE r = 1",
    "cluster_templates": f"WITH {TPL_SQL} SELECT label, cast(p AS int) AS p, round(t[p + 1], 6) + 0.0 AS v FROM tpl, (SELECT unnest(range(64)) AS p)",
    "screen_overlaps": f"""WITH {TPL_SQL}, rs AS (SELECT vec.id, vec.label, list_transform(range(64), lambda i: x[i + 1] - t[i + 1]) AS r FROM vec JOIN tpl ON vec.label = tpl.label),
e1 AS (SELECT *, list_dot_product(r, r) AS e1 FROM rs), e2 AS (SELECT e1.id, e1.label, any_value(e1) AS e1, min(e1 - list_dot_product(r, t) ** 2 / list_dot_product(t, t)) AS e2 FROM e1 JOIN tpl ON e1.label <> tpl.label GROUP BY ALL),
md AS (SELECT label, median(e1) AS m FROM e1 GROUP BY 1) SELECT id, e2.label, round(e1, 6) + 0.0 AS e1, round(e2, 6) + 0.0 AS e2, e1 > greatest(1.2 * m, 1e-12) AND e2 * 1.05 < e1 AS is_overlap FROM e2 JOIN md ON e2.label = md.label""",
    "kmeans_lloyd_fixed": f"WITH {_lloyd_sql()} SELECT id, cluster, round(d2, 6) + 0.0 AS d2 FROM a3",
    "ari": f"WITH {_lloyd_sql()}, {ari_sql('a3', 'label', 'cluster')}",
    "regime_ari": f"WITH tt AS (SELECT DISTINCT trial_id, ses, stimulus FROM decoding_trials WHERE trial_id IS NOT NULL), {ari_sql('tt', 'ses', 'stimulus')}",
}
