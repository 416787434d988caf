"""Queries on symmetric positive definite matrices: descriptors, matrix functions, distances, Riemannian classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.functions import spd
from tidewright.operators import classify as C
from tidewright.plans.classification import K, WINDOWS_SQL, asked, near_sql, vote_sql, windows
from tidewright.plans.fourier import WAVE_SQL, waveforms
from tidewright.plans.information import r6, r6_of
from tidewright.session import checkpointed


def cells(df, key, c, name="v"):
    return df.select(key, F.posexplode(c).alias("k", "e")).select(key, "k", r6_of(F.col("e"), name))


def matrices(spark, sf, d=8, first=0):
    """Rows (id, label, m): covariance of d of a window's channels, regularised."""
    cut = F.transform("win", lambda r: F.slice(r, first + 1, d))
    return windows(spark, sf).select("id", "label", A.spd_embed(cut, d).alias("m"))


PAIRS = 4


def pair_matrices(spark, sf):
    """Rows (id, label, pair, m): the covariance of each of the four pairs of neighbouring channels, regularised."""
    cut = lambda p: F.transform("win", lambda r: F.slice(r, 2 * p + 1, 2))
    return windows(spark, sf).select("id", "label", F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), A.spd_embed(cut(p), 2).alias("m")) for p in range(PAIRS)])).alias("e")).select("id", "label", "e.pair", "e.m")


def _blocks(spark, sf):
    """Rows (id, label, m): all 8 channels as the block-diagonal matrix of the four pairs' covariances."""
    own = F.array_sort(F.collect_list(F.struct("pair", "m")))
    cell = lambda i, j: F.get(F.col("b")[i // 2]["m"], F.lit(i % 2 * 2 + j % 2)) if i // 2 == j // 2 else F.lit(0.0)
    g = pair_matrices(spark, sf).groupBy("id", "label").agg(own.alias("b"))
    return g.select("id", "label", F.array(*[cell(i, j) for i in range(8) for j in range(8)]).alias("m"))


def _block_tangents(spark, sf):
    """Rows (id, label, x): the tangent features of the four pairs, 12 numbers over all 8 channels."""
    t = pair_matrices(spark, sf).withColumn("t", spd.tangent(F.col("m"), 2))
    return t.groupBy("id", "label").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pair", "t"))), lambda e: e["t"])).alias("x"))


def spd_embed(spark, sf):
    return cells(matrices(spark, sf), "id", "m")


def vech(spark, sf):
    return cells(matrices(spark, sf), "id", A.vech("m", 8))


def hankel(spark, sf):
    """First and last delay row of each waveform (dimension 4, lag 2) and the number of rows."""
    h = waveforms(spark, sf).select("spike_id", A.hankel("x", 4, 2).alias("h"))
    return h.select("spike_id", F.size("h").alias("n"), *[r6_of(F.get(F.get("h", F.lit(0)), F.lit(k)), f"a{k}") for k in range(4)], *[r6_of(F.get(F.element_at("h", -1), F.lit(k)), f"z{k}") for k in range(4)])


def tde_descriptor(spark, sf):
    return cells(waveforms(spark, sf), "spike_id", A.delay_descriptor("x", 4, 2))


def spd_descriptor(spark, sf):
    """Trace, total and a corner of the outer-product descriptor of each waveform."""
    w = waveforms(spark, sf).where(F.exists("x", lambda v: v != 0)).select("spike_id", A.outer_descriptor("x", 91).alias("m"))
    trace = F.aggregate(F.sequence(F.lit(0), F.lit(90)), F.lit(0.0), lambda s, i: s + F.get("m", i * 92))
    return w.select("spike_id", r6_of(trace, "trace"), r6_of(A.total("m"), "total"), r6_of(F.get("m", F.lit(30 * 91 + 31)), "corner"))


def _pair_cells(df, c, key="id"):
    return df.select(key, "pair", F.posexplode(c).alias("k", "e")).select(key, "pair", "k", r6_of(F.col("e"), "v"))


def logm2(spark, sf):
    """Logarithm of the covariance of each pair of neighbouring channels."""
    return _pair_cells(pair_matrices(spark, sf), spd.logm(F.col("m"), 2))


def expm2(spark, sf):
    return _pair_cells(pair_matrices(spark, sf), spd.expm(F.col("m"), 2))


def sqrtm2(spark, sf):
    """Inverse square root of the covariance of each pair of neighbouring channels."""
    return _pair_cells(pair_matrices(spark, sf), spd.powm(F.col("m"), 2, -0.5))


def logm_windows(spark, sf):
    return cells(matrices(spark, sf), "id", spd.logm(F.col("m"), 8))


def expm_windows(spark, sf):
    return cells(matrices(spark, sf), "id", spd.expm(F.col("m"), 8))


def sqrtm_windows(spark, sf):
    return cells(matrices(spark, sf), "id", spd.powm(F.col("m"), 8, -0.5))


def _next_pairs(spark, sf):
    """Rows (id, pair, a, b): each pair of channels and the one after it, the first after the last."""
    m = pair_matrices(spark, sf)
    a = m.select("id", "pair", F.col("m").alias("a"))
    return a.join(m.select("id", ((F.col("pair") + PAIRS - 1) % PAIRS).alias("pair"), F.col("m").alias("b")), ["id", "pair"])


def logeuclid_dist(spark, sf):
    return _next_pairs(spark, sf).select("id", "pair", r6_of(A.distance(spd.tangent(F.col("a"), 2), spd.tangent(F.col("b"), 2)), "d"))


def airm_dist(spark, sf):
    return _next_pairs(spark, sf).select("id", "pair", r6_of(spd.airm_distance(F.col("a"), F.col("b"), 2), "d"))


def _halves(spark, sf):
    """Rows (id, a, b): the covariance of all 8 channels over the first and over the last 32 rows of a window that has both."""
    a, b = (A.spd_embed(F.slice("win", at, 32), 8) for at in (1, 33))
    moving = lambda at: F.exists(F.flatten(F.slice("win", at, 32)), lambda v: v != 0)
    return checkpointed(windows(spark, sf).where(moving(1) & moving(33)).select("id", a.alias("a"), b.alias("b")))


def logeuclid_dist_windows(spark, sf):
    """Log-Euclidean distance between the two halves of every window, on all 8 channels."""
    return _halves(spark, sf).select("id", r6_of(A.distance(spd.tangent(F.col("a"), 8), spd.tangent(F.col("b"), 8)), "d"))


def airm_dist_windows(spark, sf):
    """Affine-invariant distance between the two halves of every window, on all 8 channels."""
    return _halves(spark, sf).select("id", r6_of(spd.airm_distance(F.col("a"), F.col("b"), 8), "d"))


def _tangents(spark, sf, d):
    return spd.with_tangent(matrices(spark, sf, d), "m", d, "x")


def le_mean(spark, sf):
    """Log-Euclidean mean of each class and pair of channels."""
    t = pair_matrices(spark, sf).select((F.col("label") * PAIRS + F.col("pair")).alias("lp"), spd.tangent(F.col("m"), 2).alias("x"))
    m = C.class_means(t, "x", "lp").select(F.floor(F.col("lp") / PAIRS).cast("int").alias("label"), (F.col("lp") % PAIRS).cast("int").alias("pair"), spd.from_tangent(F.col("mean"), 2).alias("m"))
    return _pair_cells(m, F.col("m"), "label")


def le_mean_windows(spark, sf):
    m = C.class_means(_tangents(spark, sf, 8), "x", "label").select("label", spd.from_tangent(F.col("mean"), 8).alias("m"))
    return cells(m, "label", "m")


def mdm_predict(spark, sf):
    """Windows named by the nearest log-Euclidean class mean of their block-diagonal covariance."""
    t = checkpointed(_block_tangents(spark, sf))
    return C.nearest_class(t, C.class_means(t, "x", "label"), "x", "label").select("id", "predicted")


def mdm_predict_windows(spark, sf):
    t = checkpointed(_tangents(spark, sf, 8).drop("m"))
    return C.nearest_class(t, C.class_means(t, "x", "label"), "x", "label").select("id", "predicted")


def mdm_cv5(spark, sf):
    """Accuracy of the nearest log-Euclidean class mean on all 8 channels, each of 5 folds judged by means of the others."""
    v = checkpointed(C.contiguous_folds(_tangents(spark, sf, 8).drop("m"), "id", 5))
    return C.held_out_accuracy(v, 5, lambda train, test: C.nearest_class(test, C.class_means(train, "x", "label"), "x", "label"))


def mdm_windows(spark, sf):
    """Accuracy of the nearest log-Euclidean class mean on all 8 channels."""
    t = checkpointed(_tangents(spark, sf, 8))
    p = C.nearest_class(t, C.class_means(t, "x", "label"), "x", "label")
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))


def geoknn_predict_le(spark, sf):
    """Windows named by their nearest windows under the log-Euclidean distance of block-diagonal covariances."""
    t = checkpointed(_block_tangents(spark, sf))
    return C.kernel_vote(C.nearest_neighbours(asked(t), t, K))


def _airm_neighbours(m):
    t = checkpointed(m.select("id", "label", F.col("m").alias("x")))
    return C.kernel_vote(C.nearest_neighbours(asked(t), t, K, metric="airm", d=8, block=8000))


def geoknn_predict_airm(spark, sf):
    return _airm_neighbours(_blocks(spark, sf))


def geoknn_windows_predict_airm(spark, sf):
    return _airm_neighbours(matrices(spark, sf))


def vectorised_knn(spark, sf):
    """Windows named by the Euclidean distance of their covariances' upper triangles."""
    t = checkpointed(matrices(spark, sf).select("id", "label", A.vech("m", 8).alias("x")))
    return C.vote(C.nearest_neighbours(asked(t), t, K))


def geoknn_windows_predict(spark, sf):
    """Windows named by their nearest windows under the log-Euclidean distance of all 8 channels."""
    t = checkpointed(_tangents(spark, sf, 8).drop("m"))
    return C.kernel_vote(C.nearest_neighbours(asked(t), t, K))


def _folded(t):
    v = checkpointed(C.contiguous_folds(t, "id", 5))
    near = C.nearest_neighbours(v, v, K, fold="fold").join(v.select(F.col("id").alias("qid"), "fold"), "qid")
    return C.accuracy(C.kernel_vote(near, ["qid", "fold"]), v, keys=["fold"]).select("fold", "n", r6("accuracy"))


def geoknn_cv5(spark, sf):
    return _folded(_block_tangents(spark, sf))


def geoknn_windows_cv5(spark, sf):
    return _folded(_tangents(spark, sf, 8).drop("m"))


def tangent_map(spark, sf):
    """Tangent features of the 8 x 8 matrices at their Karcher mean: they average to 0."""
    m = checkpointed(matrices(spark, sf, 8).select("id", "m"))
    mean = C.karcher_mean(m, "m", 8)
    return cells(m, "id", spd.tangent_at(F.col("m"), mean))


def karcher_mean(spark, sf):
    m = checkpointed(matrices(spark, sf, 8).select("m"))
    mean = C.karcher_mean(m, "m", 8)
    near = m.select(spd.airm_distance(F.col("m"), F.array(*[F.lit(float(v)) for v in mean.ravel()]), 8).alias("d"))
    return near.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_distance")).withColumn("mean", F.array(*[F.lit(float(v)) for v in mean.ravel()]))


QUERIES = {
    f.__name__: f
    for f in (
        spd_embed, vech, hankel, tde_descriptor, spd_descriptor, logm2, expm2, sqrtm2, logeuclid_dist, airm_dist, le_mean, mdm_predict, mdm_windows, mdm_cv5,
        geoknn_predict_le, geoknn_predict_airm, geoknn_windows_predict, geoknn_cv5, tangent_map, karcher_mean, vectorised_knn,
        # full 8 x 8 matrices: without SQL where it has no closed form
        logeuclid_dist_windows, airm_dist_windows, logm_windows, expm_windows, sqrtm_windows, le_mean_windows, mdm_predict_windows,
        geoknn_windows_predict_airm, geoknn_windows_cv5,
    )
}


def cov_sql(d: int, first: int = 0, out: str = "mt") -> str:
    """CTE out(id, label, i, j, v): the regularised covariance, cell by cell."""
    return f"""{out}_r AS (SELECT id, label, i, j, sum(r[i + 1 + {first}] * r[j + 1 + {first}]) / 64 AS v FROM (SELECT id, label, unnest(win) AS r FROM win), (SELECT unnest(range({d})) AS i), (SELECT unnest(range({d})) AS j) GROUP BY ALL),
{out} AS (SELECT id, label, cast(i AS int) AS i, cast(j AS int) AS j, v + CASE WHEN i = j THEN 1e-6 * sum(CASE WHEN i = j THEN v ELSE 0 END) OVER (PARTITION BY id) / {d} ELSE 0 END AS v FROM {out}_r)"""


def abc_sql(first: int = 0, out: str = "abc") -> str:
    """CTE out(id, label, a, b, c) of 2 x 2 matrices with the parts of their closed forms."""
    return f"""{cov_sql(2, first, out + "_m")},
{out} AS (SELECT *, (a + c) / 2 AS m, sqrt(((a - c) / 2) ** 2 + b * b) AS r FROM (SELECT id, label, max(CASE WHEN i = 0 AND j = 0 THEN v END) AS a, max(CASE WHEN i = 0 AND j = 1 THEN v END) AS b, max(CASE WHEN i = 1 AND j = 1 THEN v END) AS c FROM {out}_m GROUP BY ALL))"""


def closed_sql(source: str, f: str, out: str, keys: str = "id, label") -> str:
    """CTE out(keys, p, q, s): f of a symmetric 2 x 2 matrix in closed form; ``f`` has {{x}} for an eigenvalue."""
    hi, lo = f.format(x="greatest(m + r, 1e-12)"), f.format(x="greatest(m - r, 1e-12)")
    if f.startswith("exp"):
        hi, lo = f.format(x="(m + r)"), f.format(x="(m - r)")
    return f"""{out}_h AS (SELECT {keys}, a, b, c, m, r, ({hi} + {lo}) / 2 AS g, CASE WHEN r = 0 THEN 0 ELSE ({hi} - {lo}) / (2 * r) END AS h FROM {source}),
{out} AS (SELECT {keys}, g + h * (a - m) AS p, h * b AS q, g + h * (c - m) AS s FROM {out}_h)"""


ABC4_SQL = ", ".join(abc_sql(2 * p, f"abc{p}") for p in range(PAIRS)) + ", abc AS (" + " UNION ALL ".join(f"SELECT *, {p} AS pair FROM abc{p}" for p in range(PAIRS)) + ")"
IN_PAIRS = "id, label, pair"
FOUR = "SELECT {key}, cast(k AS int) AS k, round(CASE k WHEN 0 THEN p WHEN 3 THEN s ELSE q END, 6) + 0.0 AS v FROM {t}, (SELECT unnest(range(4)) AS k)"
LOG4_SQL = f"{WINDOWS_SQL}, {ABC4_SQL}, {closed_sql('abc', 'ln({x})', 'lg', IN_PAIRS)}"
TAN_SQL = f"{LOG4_SQL}, tn AS (SELECT id, label, flatten(list([p, sqrt(2) * q, s] ORDER BY pair)) AS x FROM lg GROUP BY id, label)"


def kernel_sql(keys: str = "qid") -> str:
    on = " AND ".join(f"near.{k} = sc.{k}" for k in keys.split(", "))
    return f"""sc AS (SELECT {keys}, greatest(median(d), 1e-12) AS s FROM near GROUP BY {keys}),
kw AS (SELECT {", ".join("near." + k for k in keys.split(", "))}, label, round(sum(exp(-d * d / (2 * s * s))), 12) AS w, min(place) AS f FROM near JOIN sc ON {on} GROUP BY ALL),
vt AS (SELECT {keys}, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY w DESC, f) AS r FROM kw) WHERE r = 1)"""


AIRM = "sqrt(ln(greatest({t} / 2 + sqrt(greatest({t} * {t} / 4 - {d}, 0)), 1e-12)) ** 2 + ln(greatest({t} / 2 - sqrt(greatest({t} * {t} / 4 - {d}, 0)), 1e-12)) ** 2)"


def airm_sql(x: str, y: str) -> str:
    tau = f"(({x}.c * {y}.a - 2 * {x}.b * {y}.b + {x}.a * {y}.c) / ({x}.a * {x}.c - {x}.b * {x}.b))"
    delta = f"(({y}.a * {y}.c - {y}.b * {y}.b) / ({x}.a * {x}.c - {x}.b * {x}.b))"
    return AIRM.format(t=tau, d=delta)


HANKEL = ", ".join([f"round(x[{1 + 2 * k}], 6) + 0.0 AS a{k}" for k in range(4)] + [f"round(x[{85 + 2 * k}], 6) + 0.0 AS z{k}" for k in range(4)])
ORACLES = {
    "spd_embed": f"WITH {WINDOWS_SQL}, {cov_sql(8)} SELECT id, i * 8 + j AS k, round(v, 6) + 0.0 AS v FROM mt",
    "vech": f"WITH {WINDOWS_SQL}, {cov_sql(8)} SELECT id, cast(row_number() OVER (PARTITION BY id ORDER BY i, j) - 1 AS int) AS k, round(v * CASE WHEN i = j THEN 1 ELSE sqrt(2) END, 6) + 0.0 AS v FROM mt WHERE j >= i",
    "hankel": f"WITH {WAVE_SQL} SELECT spike_id, cast(85 AS int) AS n, {HANKEL} FROM wv",
    "tde_descriptor": f"WITH {WAVE_SQL}, g AS (SELECT spike_id, i, j, sum(x[t + 2 * i + 1] * x[t + 2 * j + 1]) / 85 AS v FROM wv, (SELECT unnest(range(85)) AS t), (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) GROUP BY ALL) SELECT spike_id, cast(i * 4 + j AS int) AS k, round(v + CASE WHEN i = j THEN 1e-3 * sum(CASE WHEN i = j THEN v ELSE 0 END) OVER (PARTITION BY spike_id) / 4 ELSE 0 END, 6) + 0.0 AS v FROM g",
    "spd_descriptor": f"WITH {WAVE_SQL}, s AS (SELECT spike_id, x, list_sum(list_transform(x, lambda v: v * v)) AS q, list_sum(x) AS t FROM wv) SELECT spike_id, round(q * (1 + 1e-3), 6) + 0.0 AS trace, round(t * t + 1e-3 * q, 6) + 0.0 AS total, round(x[31] * x[32], 6) + 0.0 AS corner FROM s WHERE q > 0",
    "logm2": f"WITH {LOG4_SQL} {FOUR.format(key='id, pair', t='lg')}",
    "expm2": f"WITH {WINDOWS_SQL}, {ABC4_SQL}, {closed_sql('abc', 'exp({x})', 'ex', IN_PAIRS)} {FOUR.format(key='id, pair', t='ex')}",
    "sqrtm2": f"WITH {WINDOWS_SQL}, {ABC4_SQL}, {closed_sql('abc', '(({x}) ** -0.5)', 'pw', IN_PAIRS)} {FOUR.format(key='id, pair', t='pw')}",
    "logeuclid_dist": f"WITH {LOG4_SQL} SELECT la.id, la.pair, round(sqrt((la.p - lb.p) ** 2 + 2 * (la.q - lb.q) ** 2 + (la.s - lb.s) ** 2), 6) + 0.0 AS d FROM lg la JOIN lg lb ON la.id = lb.id AND lb.pair = (la.pair + 1) % {PAIRS}",
    "airm_dist": f"WITH {WINDOWS_SQL}, {ABC4_SQL} SELECT xa.id, xa.pair, round({airm_sql('xa', 'xb')}, 6) + 0.0 AS d FROM abc xa JOIN abc xb ON xa.id = xb.id AND xb.pair = (xa.pair + 1) % {PAIRS}",
    "le_mean": f"WITH {LOG4_SQL}, mn AS (SELECT *, (a + c) / 2 AS m, sqrt(((a - c) / 2) ** 2 + b * b) AS r FROM (SELECT label, pair, avg(p) AS a, avg(q) AS b, avg(s) AS c FROM lg GROUP BY ALL)), {closed_sql('mn', 'exp({x})', 'ex', 'label, pair')} {FOUR.format(key='label, pair', t='ex')}",
    "mdm_predict": f"WITH {TAN_SQL}, mn AS (SELECT label, [{', '.join(f'avg(x[{k}])' for k in range(1, 3 * PAIRS + 1))}] AS m FROM tn GROUP BY 1) SELECT id, predicted FROM (SELECT tn.id, mn.label AS predicted, row_number() OVER (PARTITION BY tn.id ORDER BY round(list_distance(x, m), 12), mn.label) AS r FROM tn, mn) WHERE r = 1",
    "geoknn_predict_le": f"WITH {TAN_SQL}, {near_sql('tn', 'q.id % 20 = 0', K)}, {kernel_sql()} SELECT qid, predicted FROM vt",
    "geoknn_predict_airm": f"WITH {WINDOWS_SQL}, {ABC4_SQL}, di AS (SELECT q.id AS qid, t.id AS tid, t.label, sqrt(sum(({airm_sql('q', 't')}) ** 2)) AS d FROM abc q JOIN abc t ON q.pair = t.pair AND q.id <> t.id AND q.id % 20 = 0 GROUP BY ALL), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS place FROM di) WHERE place <= {K}), {kernel_sql()} SELECT qid, predicted FROM vt",
    "geoknn_cv5": f"WITH {TAN_SQL}, fd AS (SELECT *, ntile(5) OVER (ORDER BY id) - 1 AS fold FROM tn), {near_sql('fd', 'q.fold <> t.fold', K)}, {kernel_sql()} SELECT cast(fold AS int) AS fold, count(*) AS n, round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM vt JOIN fd ON vt.qid = fd.id GROUP BY 1",
}
VECH_SQL = f"{WINDOWS_SQL}, {cov_sql(8)}, vc AS (SELECT id, label, list(v * CASE WHEN i = j THEN 1 ELSE sqrt(2) END ORDER BY i, j) AS x FROM mt WHERE j >= i GROUP BY id, label)"
ORACLES["vectorised_knn"] = f"WITH {VECH_SQL}, {near_sql('vc', 'q.id % 20 = 0', K)}, {vote_sql('near', 'qid', 'vt')} SELECT qid, predicted FROM vt"
