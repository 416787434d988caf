"""Nearest-neighbour, perceptron and discriminant queries on embeddings, geoknn_windows, decoding_trials and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.operators import classify as C
from tidewright.operators.cluster import nearest_opposite_pair
from tidewright.plans.information import r6
from tidewright.session import checkpointed, read_table

K = 5
TURNS = 1000


def vectors(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), A.doubles("embedding").alias("x"), "label")
    return e.where("id IS NOT NULL AND label IS NOT NULL").where(A.sound("x"))


def windows(spark, sf):
    """Rows (id, label, win): sound labelled windows of 64 x 8, each once."""
    w = read_table(spark, sf, "geoknn_windows").where("window_id IS NOT NULL AND y_train IS NOT NULL AND x_train IS NOT NULL AND size(x_train) = 64")
    w = w.where(F.forall("x_train", lambda r: r.isNotNull() & (F.size(r) == 8)) & A.sound(F.flatten("x_train")) & F.exists(F.flatten("x_train"), lambda v: v != 0))
    return w.select(F.col("window_id").alias("id"), F.col("y_train").alias("label"), F.col("x_train").alias("win")).dropDuplicates(["id"])


WINDOWS_SQL = """win AS (SELECT DISTINCT window_id AS id, y_train AS label, x_train AS win FROM geoknn_windows
 WHERE window_id IS NOT NULL AND y_train IS NOT NULL AND len(x_train) = 64 AND len(list_filter(x_train, lambda r: len(r) = 8 AND list_count(r) = 8)) = 64
   AND NOT list_contains(flatten(x_train), 'nan'::double) AND list_sum(list_transform(flatten(x_train), lambda v: abs(v))) > 0)"""


def asked(df):
    """The stated query set: ids divisible by 20."""
    return df.where("id % 20 = 0")


def knn_predict(spark, sf):
    v = vectors(spark, sf)
    return C.vote(C.nearest_neighbours(asked(v), v, K))


def summed(spark, sf):
    """Windows summed over time: 8 numbers each."""
    add = lambda s, r: F.zip_with(s, r, lambda a, b: a + b)
    return windows(spark, sf).select("id", "label", F.aggregate("win", F.array(*[F.lit(0.0)] * 8), add).alias("x"))


def knn_summed(spark, sf):
    v = summed(spark, sf)
    return C.vote(C.nearest_neighbours(asked(v), v, K))


def _folded_neighbours(spark, sf, k):
    v = checkpointed(C.contiguous_folds(vectors(spark, sf), "id", 7))
    near = C.nearest_neighbours(v, v, k, fold="fold")
    return v, near.join(v.select(F.col("id").alias("qid"), "fold"), "qid")


def knn_cv7(spark, sf):
    """Accuracy of each of 7 contiguous folds, judged by the other six."""
    v, near = _folded_neighbours(spark, sf, K)
    return C.accuracy(C.vote(near, ["qid", "fold"]), v, keys=["fold"]).select("fold", "n", r6("accuracy"))


def _sweep(spark, sf):
    v, near = _folded_neighbours(spark, sf, 15)
    kept = near.withColumn("k", F.explode(F.sequence("place", F.lit(15))))
    return C.accuracy(C.vote(kept, ["qid", "fold", "k"]), v, keys=["fold", "k"]).groupBy("k").agg(F.avg("accuracy").alias("accuracy"))


def knn_ksweep(spark, sf):
    """Mean fold accuracy for k = 1 .. 15; neighbours are ranked once."""
    return _sweep(spark, sf).select("k", r6("accuracy"))


def best_k(spark, sf):
    s = _sweep(spark, sf).select("k", F.round("accuracy", 9).alias("a"))
    return s.agg(F.max(F.struct("a", (-F.col("k")).alias("n"))).alias("m")).select((-F.col("m.n")).alias("k"), (F.round("m.a", 6) + 0.0).alias("accuracy"))


def nearest_pairs(spark, sf):
    """Each label's row that is nearest to a row of another label: the pair a separating line would halve."""
    return nearest_opposite_pair(vectors(spark, sf), "id", "x", "label").select("label", "id", "other", r6("d"))


def _points(spark, sf):
    return read_table(spark, sf, "events").select("event_id", "user_id", (F.col("value") / 100).alias("x1"), (F.hour("ts") / 24).alias("x2"), (F.col("event_type") == "purchase").cast("int").alias("t"))


def perceptron_fit(spark, sf):
    """A perceptron per user that tells purchases by value and hour."""
    m = C.perceptron_fit(_points(spark, sf), "event_id", ["x1", "x2"], "t", "user_id", max_turns=TURNS, weights=(0.6, -0.2))
    return m.select("user_id", F.round(F.get("w", F.lit(0)), 6).alias("w1"), F.round(F.get("w", F.lit(1)), 6).alias("w2"), F.round("b", 6).alias("b"), "turns", "errors")


def perceptron_predict(spark, sf):
    p = _points(spark, sf)
    m = C.perceptron_fit(p, "event_id", ["x1", "x2"], "t", "user_id", max_turns=TURNS, weights=(0.6, -0.2))
    return C.perceptron_decide(p, m, ["x1", "x2"], "user_id").groupBy("user_id").agg(F.avg((F.col("predicted") == F.col("t")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def decision_line(spark, sf):
    m = C.perceptron_fit(_points(spark, sf), "event_id", ["x1", "x2"], "t", "user_id", max_turns=TURNS, weights=(0.6, -0.2))
    return m.select("user_id", C.separating_line(m, F.lit(0.0)).alias("y0"), C.separating_line(m, F.lit(1.0)).alias("y1"))


def _trials(spark, sf):
    t = read_table(spark, sf, "decoding_trials").where(A.sound("rates", 22) & F.col("stimulus").isNotNull() & F.col("trial_id").isNotNull())
    return t.select(F.col("trial_id").alias("id"), "regime", F.col("stimulus").alias("label"), F.col("rates").alias("x")).dropDuplicates(["id"])


def lda(spark, sf):
    """Share of trials whose stimulus a linear discriminant names, per regime."""
    t = checkpointed(_trials(spark, sf))
    model = C.linear_discriminant(t, "x", "label", 22)
    return C.discriminant_predict(t, model, "x", "label").groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))


def lda_cv5(spark, sf):
    """Share of held-out trials whose stimulus a linear discriminant names, per fold and regime: fitted on the other four folds."""
    v = checkpointed(C.contiguous_folds(_trials(spark, sf), "id", 5))
    return C.held_out_accuracy(v, 5, lambda train, test: C.discriminant_predict(test, C.linear_discriminant(train, "x", "label", 22), "x", "label"), keys=["regime"])


def nearest_mean_cv5(spark, sf):
    """Accuracy of the nearest mean rate vector, each of 5 folds judged by means of the others."""
    v = checkpointed(C.contiguous_folds(_trials(spark, sf), "id", 5))
    return C.held_out_accuracy(v, 5, lambda train, test: C.nearest_class(test, C.class_means(train, "x", "label"), "x", "label")).select("fold", "n", r6("accuracy"))


def nearest_mean(spark, sf):
    """Trials named by the nearest mean rate vector."""
    t = _trials(spark, sf)
    return C.nearest_class(t, C.class_means(t, "x", "label"), "x", "label").select("id", "predicted")


QUERIES = {f.__name__: f for f in (knn_predict, knn_summed, knn_cv7, knn_ksweep, best_k, nearest_pairs, perceptron_fit, perceptron_predict, decision_line, lda, lda_cv5, nearest_mean, nearest_mean_cv5)}
VEC_SQL = "vec AS (SELECT vec_id AS id, embedding::double[] AS x, label FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL)"


def vote_sql(near: str, keys: str, out: str) -> str:
    return f"""{out}_c AS (SELECT {keys}, label, count(*) AS n, min(place) AS f FROM {near} GROUP BY {keys}, label),
{out} AS (SELECT {keys}, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, f) AS r FROM {out}_c) WHERE r = 1)"""


def near_sql(table: str, where: str, k: int, distance: str = "list_distance(q.x, t.x)") -> str:
    return f"""near AS (SELECT * FROM (SELECT q.id AS qid, t.id AS tid, t.label, {distance} AS d, row_number() OVER (PARTITION BY q.id ORDER BY {distance}, t.id) AS place
 FROM {table} q JOIN {table} t ON q.id <> t.id AND {where}) WHERE place <= {k})"""


SUM_SQL = f"{WINDOWS_SQL}, sm AS (SELECT id, label, list_transform(range(8), lambda c: list_sum(list_transform(win, lambda r: r[c + 1]))) AS x FROM win)"
FOLD_SQL = f"{VEC_SQL}, fd AS (SELECT *, ntile(7) OVER (ORDER BY id) - 1 AS fold FROM vec)"
SWEEP_SQL = f"""{FOLD_SQL}, {near_sql('fd', 'q.fold <> t.fold', 15)}, ks AS (SELECT near.*, k FROM near JOIN (SELECT unnest(range(1, 16)) AS k) ON place <= k), {vote_sql('ks', 'qid, k', 'vt')},
acc AS (SELECT k, fold, avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END) AS a FROM vt JOIN fd ON vt.qid = fd.id GROUP BY ALL), sw AS (SELECT k, avg(a) AS a FROM acc GROUP BY k)"""
TRIAL_SQL = "tr AS (SELECT DISTINCT trial_id AS id, stimulus AS label, rates AS x FROM decoding_trials WHERE len(rates) = 22 AND list_count(rates) = 22 AND NOT list_contains(rates, 'nan'::double) AND stimulus IS NOT NULL AND trial_id IS NOT NULL)"
ORACLES = {
    "knn_predict": f"WITH {VEC_SQL}, {near_sql('vec', 'q.id % 20 = 0', K)}, {vote_sql('near', 'qid', 'vt')} SELECT qid, predicted FROM vt",
    "knn_summed": f"WITH {SUM_SQL}, {near_sql('sm', 'q.id % 20 = 0', K)}, {vote_sql('near', 'qid', 'vt')} SELECT qid, predicted FROM vt",
    "knn_cv7": f"WITH {FOLD_SQL}, {near_sql('fd', 'q.fold <> t.fold', K)}, {vote_sql('near', 'qid', 'vt')} SELECT cast(fold AS int) AS fold, count(*) AS n, round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM vt JOIN fd ON vt.qid = fd.id GROUP BY 1",
    "knn_ksweep": f"WITH {SWEEP_SQL} SELECT cast(k AS int) AS k, round(a, 6) + 0.0 AS accuracy FROM sw",
    "best_k": f"WITH {SWEEP_SQL} SELECT cast(k AS int) AS k, round(a, 6) + 0.0 AS accuracy FROM sw ORDER BY round(a, 9) DESC, k LIMIT 1",
    "nearest_pairs": f"WITH {VEC_SQL}, c AS (SELECT q.label, q.id, t.id AS other, round(list_distance(q.x, t.x), 9) AS d FROM vec q JOIN vec t ON q.label <> t.label) SELECT label, id, other, round(d, 6) + 0.0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, id, other) AS r FROM c) WHERE r = 1",
    "nearest_mean": f"WITH {TRIAL_SQL}, e AS (SELECT label, i, avg(x[i]) AS m FROM tr, (SELECT unnest(range(1, 23)) AS i) GROUP BY ALL), mn AS (SELECT label, list(m ORDER BY i) AS m FROM e GROUP BY 1) SELECT id, predicted FROM (SELECT tr.id, mn.label AS predicted, row_number() OVER (PARTITION BY tr.id ORDER BY round(list_distance(tr.x, mn.m), 12), mn.label) AS r FROM tr, mn) WHERE r = 1",
}
ORACLES["nearest_mean_cv5"] = f"""WITH {TRIAL_SQL}, fd AS (SELECT *, ntile(5) OVER (ORDER BY id) - 1 AS fold FROM tr), e AS (SELECT f, label, i, avg(x[i]) AS m FROM fd, (SELECT unnest(range(5)) AS f), (SELECT unnest(range(1, 23)) AS i) WHERE fold <> f GROUP BY ALL),
mn AS (SELECT f, label, list(m ORDER BY i) AS m FROM e GROUP BY ALL), p AS (SELECT fd.fold, fd.label, mn.label AS predicted, row_number() OVER (PARTITION BY fd.id ORDER BY round(list_distance(x, m), 12), mn.label) AS r FROM fd JOIN mn ON f = fold)
SELECT cast(fold AS int) AS fold, count(*) AS n, round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM p WHERE r = 1 GROUP BY 1"""
