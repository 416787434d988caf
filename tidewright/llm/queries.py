"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.llm import canonical_text, encoding_repair, language_segments, leakage, mixing, nearest_time, shape_clusters, spam_pages, vector_neighbors
from tidewright.session import read_table


def p1_segments(spark, sf):
    """Every piece, stretch by stretch, with language and confidence."""
    return language_segments.language_segments(read_table(spark, sf, "load_corpora"), "piece_id", "text", "lang")


def p1_found(spark, sf):
    return p1_segments(spark, sf).where("NOT label_ok AND lang IS NOT NULL").select("piece_id", "seg", "lang")


def p2_repaired(spark, sf):
    """Every piece with its restored text."""
    return encoding_repair.repair_encoding(read_table(spark, sf, "load_corpora"), "piece_id", "text")


def p2_found(spark, sf):
    return p2_repaired(spark, sf).where("damaged").select("piece_id")


def _fields(spark, sf):
    """(field, vectors, shape, largest distance of a case)."""
    rates = vector_neighbors.usable_vectors(read_table(spark, sf, "decoding_trials"), "trial_id", "rates")
    return [("rates", rates, (22,), 0.5), ("x_train", vector_neighbors.usable_vectors(read_table(spark, sf, "geoknn_windows"), "window_id", "x_train"), (64, 8), 12.0)]


def p3_found(spark, sf):
    out = None
    for field, vectors, size, far in _fields(spark, sf):
        near = vector_neighbors.nearest_vectors(vectors, 5, size, max_distance=far)
        pairs = near.select(F.lit(field).alias("field"), F.least("id", "neighbour").alias("id_lo"), F.greatest("id", "neighbour").alias("id_hi")).distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p3_neighbors(spark, sf):
    """The 5 nearest of every vector whose id is divisible by 20, among all vectors of its field."""
    out = None
    for field, vectors, size, _ in _fields(spark, sf):
        near = vector_neighbors.nearest_vectors(vectors, 5, size, queries="id % 20 = 0").select(F.lit(field).alias("field"), "id", "neighbour", "distance", "place")
        out = near if out is None else out.unionByName(near)
    return out


def p4_found(spark, sf):
    pairs = canonical_text.look_alike_pairs(read_table(spark, sf, "load_corpora"), "piece_id", "text")
    return pairs.select(F.col("lo").alias("piece_lo"), F.col("hi").alias("piece_hi"))


def p4_classes(spark, sf):
    """Every piece with its class of look-alike texts."""
    return canonical_text.look_alike_classes(read_table(spark, sf, "load_corpora"), "piece_id", "text").select("piece_id", "class_id", "spellings", "members", "links", "canonical")


def _clusters(spark, sf):
    return shape_clusters.shape_clusters(read_table(spark, sf, "spike_waveforms"), "spike_id", "waveforms", 91)


def p5_members(spark, sf):
    """Every spike with its cluster, null where it belongs to none."""
    return _clusters(spark, sf)[0]


def p5_clusters(spark, sf):
    """Every cluster with its size, medoid and most typical spikes."""
    return _clusters(spark, sf)[1]


def p5_found(spark, sf):
    members = _clusters(spark, sf)[0].where("cluster IS NOT NULL")
    pairs = read_table(spark, sf, "sort_pairs").select(F.least("spike_a", "spike_b").alias("spike_lo"), F.greatest("spike_a", "spike_b").alias("spike_hi"))
    pairs = pairs.where("spike_lo < spike_hi").distinct()
    a = members.select(F.col("spike_id").alias("spike_lo"), F.col("cluster").alias("c1"))
    b = members.select(F.col("spike_id").alias("spike_hi"), F.col("cluster").alias("c2"))
    return pairs.join(a, "spike_lo").join(b, "spike_hi").where("c1 = c2").select("spike_lo", "spike_hi")


def _nearest(spark, sf, **kw):
    det, stim = read_table(spark, sf, "det_mad"), read_table(spark, sf, "stimulator_spikes")
    return nearest_time.nearest_in_time(det, stim, "det_id", "stim_id", "rec", "rec", "ts", "ts", 500, **kw)


def p6_found(spark, sf):
    return _nearest(spark, sf).select("det_id", "stim_id")


def p6_all_detections(spark, sf):
    """Every detection, with its stimulator spike and the difference, or nulls."""
    return _nearest(spark, sf, keep_unmatched=True)


P6_SQL = """
WITH d AS (SELECT DISTINCT det_id, rec, ts FROM det_mad WHERE det_id IS NOT NULL AND rec IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT DISTINCT stim_id, rec, ts FROM stimulator_spikes WHERE stim_id IS NOT NULL AND rec IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT det_id, stim_id, epoch_us(s.ts) - epoch_us(d.ts) AS diff,
             row_number() OVER (PARTITION BY det_id ORDER BY abs(epoch_us(s.ts) - epoch_us(d.ts)), epoch_us(s.ts), stim_id) AS r
      FROM d JOIN s ON d.rec = s.rec AND s.ts BETWEEN d.ts - INTERVAL 500 MICROSECOND AND d.ts + INTERVAL 500 MICROSECOND)"""


def p7_leaks(spark, sf):
    """Each leaked item of each post, with the words of its longest passage."""
    return leakage.leaked_passages(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"), "doc_id", "text", "item_id", "item_text")


def p7_found(spark, sf):
    return p7_leaks(spark, sf).select("doc_id", "item_id")


def p8_found(spark, sf):
    return p8_report(spark, sf).where("NOT reachable").select("source")


def p8_report(spark, sf):
    """Target and actual shares of each source."""
    _, report = mixing.mix_sources(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets"), "doc_id", "text", "source")
    return report


def p8_mix(spark, sf):
    """The mix itself: each drawn post with its number of copies."""
    mix, _ = mixing.mix_sources(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets"), "doc_id", "text", "source")
    return mix


def p9_pages(spark, sf):
    """Every post with its spam probability before and after smoothing."""
    return spam_pages.spam_pages(read_table(spark, sf, "documents"), "doc_id", "text", "source")


def p9_found(spark, sf):
    return p9_pages(spark, sf).where("is_spam").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_repaired, p3_found, p3_neighbors, p4_found, p4_classes, p5_found, p5_members, p5_clusters, p6_found, p6_all_detections, p7_found, p7_leaks, p8_found, p8_report, p8_mix, p9_found, p9_pages)}
def _neighbour_sql(field: str, table: str, far: float) -> str:
    return f"""SELECT '{field}' AS field, least(a, b) AS id_lo, greatest(a, b) AS id_hi FROM (SELECT q.id AS a, t.id AS b, list_distance(q.v, t.v) AS d,
 row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS r FROM {table} q JOIN {table} t ON q.id <> t.id) WHERE r <= 5 AND d <= {far}"""


P3_SQL = f"""
WITH rt AS (SELECT DISTINCT trial_id AS id, rates AS v FROM decoding_trials WHERE trial_id IS NOT NULL AND len(rates) = 22 AND list_count(rates) = 22
            AND NOT list_contains(rates, 'nan'::double) AND list_sum(list_transform(rates, lambda x: abs(x))) > 0),
xt AS (SELECT DISTINCT window_id AS id, flatten(x_train) AS v FROM geoknn_windows WHERE window_id IS NOT NULL AND len(x_train) = 64
       AND len(list_filter(x_train, lambda r: len(r) = 8 AND list_count(r) = 8)) = 64 AND NOT list_contains(flatten(x_train), 'nan'::double)
       AND list_sum(list_transform(flatten(x_train), lambda x: abs(x))) > 0)
SELECT DISTINCT field, id_lo, id_hi FROM ({_neighbour_sql('rates', 'rt', 0.5)} UNION ALL {_neighbour_sql('x_train', 'xt', 12)})"""
# Words as in the operator: entities, marks of quotes and markup removed, tags inside a word without a gap.
# A passage is followed from each run of equal words (same diagonal) through two edits, as far as the next run reaches.
_INLINE = "|".join(sorted(leakage.INLINE))
_ENTITIES = (("&gt;", ">"), ("&lt;", "<"), ("&nbsp;", " "), ("&#039;", "''"), ("&#39;", "''"), ("&quot;", '"'), ("&amp;", "&"))


def _words_sql(text: str) -> str:
    for name, sign in _ENTITIES:
        text = f"replace({text}, '{name}', '{sign}')"
    plain = f"regexp_replace({text}, '(?i)</?({_INLINE})([ =][^<>]*)?>|\\[/?({_INLINE})(=[^\\]]*)?\\]', '', 'g')"
    plain = f"regexp_replace({plain}, '</?[a-zA-Z][^<>]*>|\\[/?[a-zA-Z*]+(=[^\\]]*)?\\]', ' ', 'g')"
    return f"regexp_extract_all(lower({plain}), '[\\p{{L}}\\p{{N}}]+')"


def _edit_sql(n: int) -> str:
    """CTE e{n}: the states (document, item, diagonal, start, reach) after n edits, extended along the run that covers them."""
    return f"""e{n} AS (SELECT DISTINCT s.doc_id, s.item_id, s.i0, s.d2 AS d, coalesce(r.z, s.i2) AS i, r.z IS NOT NULL AS more
 FROM (SELECT doc_id, item_id, i0, d + m.dd AS d2, i + m.di AS i2 FROM e{n - 1}, (VALUES (0, 1), (1, 0), (-1, 1)) m(dd, di)) s
 LEFT JOIN run r ON r.doc_id = s.doc_id AND r.item_id = s.item_id AND r.d = s.d2 AND s.i2 >= r.a AND s.i2 < r.z)"""


P7_SQL = f"""
WITH dw AS (SELECT doc_id, w, generate_subscripts(w, 1) AS j, unnest(w) AS x FROM (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL)),
iw AS (SELECT item_id, len(w) AS n, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT item_id, {_words_sql('item_text')} AS w FROM eval_items WHERE item_text IS NOT NULL)),
hit AS (SELECT doc_id, item_id, i, j - i AS d, i - row_number() OVER (PARTITION BY doc_id, item_id, j - i ORDER BY i) AS g FROM dw JOIN iw USING (x)),
run AS (SELECT doc_id, item_id, d, min(i) AS a, max(i) + 1 AS z FROM hit GROUP BY doc_id, item_id, d, g),
-- a passage of half the words with two edits holds a run of at least a third of the rest
few AS (SELECT DISTINCT r.doc_id, r.item_id FROM run r JOIN (SELECT item_id, max(n) AS n FROM iw GROUP BY 1) s USING (item_id) WHERE z - a >= (ceil(n * 0.5) - 2) / 3),
e0 AS (SELECT doc_id, item_id, a AS i0, d, z AS i, true AS more FROM run SEMI JOIN few USING (doc_id, item_id)), {_edit_sql(1)}, {_edit_sql(2)},
best AS (SELECT doc_id, item_id, max(i - i0) AS words FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 WHERE more UNION ALL SELECT * FROM e2 WHERE more) GROUP BY ALL)
SELECT doc_id, item_id, cast(words AS int) AS words, cast(n AS int) AS item_words FROM best JOIN (SELECT item_id, max(n) AS n FROM iw GROUP BY 1) s USING (item_id) WHERE words >= ceil(n * 0.5)"""
# the answer doesn't depend on the tokenizer, so characters stand for tokens
P8_SQL = """
SELECT m.source FROM mix_targets m LEFT JOIN (SELECT source, sum(length(text)) AS n FROM documents GROUP BY 1) d ON d.source = m.source
WHERE coalesce(n, 0) * max_repeats < target_share * (SELECT sum(length(text)) FROM documents)"""
ORACLES = {
    "p3_found": P3_SQL,
    "p7_leaks": P7_SQL,
    "p7_found": f"SELECT doc_id, item_id FROM ({P7_SQL})",
    "p8_found": P8_SQL,
    "p6_found": f"{P6_SQL} SELECT det_id, stim_id FROM m WHERE r = 1",
    "p6_all_detections": f"{P6_SQL}, i AS (SELECT DISTINCT det_id FROM det_mad WHERE det_id IS NOT NULL) SELECT i.det_id, stim_id, diff AS diff_us FROM i LEFT JOIN (SELECT * FROM m WHERE r = 1) b ON i.det_id = b.det_id",
}
