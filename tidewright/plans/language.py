"""Sequential language identification on documents: models from the first 80 % of each text, tests on the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import langid as L
from tidewright.plans.information import r6
from tidewright.session import checkpointed, read_table

LANGS = ("en", "fr", "nl")
ALPHA = BETA = 0.05


def texts(spark, sf):
    """Rows (doc_id, lang, front, rest): the letters of each post, cut at 80 %."""
    front, rest = L.split_text("s")
    return read_table(spark, sf, "documents").where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", L.letters("text").alias("s")).select("doc_id", "lang", front.alias("front"), rest.alias("rest"))


def _unigram(spark, sf):
    return L.train_unigram(texts(spark, sf), "lang", "front")


def extract_letters(spark, sf):
    return read_table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", L.letters("text").alias("letters"))


def letter_histogram(spark, sf):
    return L.letter_counts(texts(spark, sf), "lang", "front")


def unigram_model(spark, sf):
    return _unigram(spark, sf).select("lang", "letter", r6("p"))


def bigram_model(spark, sf):
    return L.train_bigram(texts(spark, sf), "lang", "front").select("lang", "prev", "cur", r6("p"))


def expected_samples(spark, sf):
    return L.expected_samples(_unigram(spark, sf), ALPHA, BETA).select("lang1", "lang0", r6("divergence"), F.round("letters1", 4).alias("letters1"), F.round("letters0", 4).alias("letters0"))


def _ratios(spark, sf, pairs):
    return checkpointed(L.log_ratios(_unigram(spark, sf), pairs))


def sprt_unigram(spark, sf):
    return L.sprt(texts(spark, sf), "doc_id", "rest", _ratios(spark, sf, [("en", "fr")]), ALPHA, BETA).select("doc_id", "label", "n_letters", "forced", r6("llr"))


def sprt_trajectory(spark, sf):
    return L.sprt_trajectory(texts(spark, sf), "doc_id", "rest", _ratios(spark, sf, [("en", "fr")])).select("doc_id", "pos", r6("llr"))


def sprt_pairwise(spark, sf):
    duels = L.sprt(texts(spark, sf), "doc_id", "rest", _ratios(spark, sf, [("en", "fr"), ("en", "nl"), ("fr", "nl")]), ALPHA, BETA)
    return L.pairwise_vote(duels, "doc_id", LANGS)


def _bigram_decisions(spark, sf):
    t = texts(spark, sf)
    tables = checkpointed(L.bigram_tables(L.train_unigram(t, "lang", "front"), L.train_bigram(t, "lang", "front"), LANGS))
    return L.bigram_sprt(t, "doc_id", "rest", tables, ALPHA, BETA)


def sprt_bigram(spark, sf):
    return _bigram_decisions(spark, sf).select("doc_id", "label", "n_letters", "forced", r6("margin"))


def sprt_error_table(spark, sf):
    d = sprt_pairwise(spark, sf).join(texts(spark, sf).select("doc_id", F.col("lang").alias("truth")), "doc_id")
    return L.trial_stats(d, "truth").select("truth", "trials", "errors", r6("error_rate"), r6("mean_letters"), r6("median_letters"))


def bigram_error_table(spark, sf):
    d = _bigram_decisions(spark, sf).join(texts(spark, sf).select("doc_id", F.col("lang").alias("truth")), "doc_id")
    return L.trial_stats(d, "truth").select("truth", "trials", "errors", r6("error_rate"), r6("mean_letters"), r6("median_letters"))


def sample_windows(spark, sf):
    return L.sample_windows(read_table(spark, sf, "documents"), "doc_id", "text", 2, seed=3)


def corpus_unigrams(spark, sf):
    """Letter shares of every spelling of a label in load_corpora, each piece once."""
    p = read_table(spark, sf, "load_corpora").where("piece_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("piece_id", "lang", "text").dropDuplicates(["piece_id"])
    return L.train_unigram(p.select("lang", L.letters("text").alias("s")), "lang", "s").select("lang", "letter", r6("p"))


QUERIES = {
    f.__name__: f
    for f in (extract_letters, letter_histogram, unigram_model, bigram_model, expected_samples, sprt_unigram, sprt_trajectory, sprt_pairwise, sprt_bigram, sprt_error_table, bigram_error_table, sample_windows, corpus_unigrams)
}
A_, B_ = L.wald_thresholds(ALPHA, BETA)
TEXT_SQL = """
tx0 AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
tx AS (SELECT doc_id, lang, substr(s, 1, cast(floor(length(s) * 0.8) AS int)) AS front, substr(s, cast(floor(length(s) * 0.8) AS int) + 1) AS rest FROM tx0),
ch AS (SELECT lang, ord(unnest(string_split(front, ''))) - 97 AS letter FROM tx WHERE front <> ''),
cnt AS (SELECT lang, letter, count(*) AS n FROM ch GROUP BY ALL),
spn AS (SELECT lang, unnest(range(26)) AS letter FROM (SELECT DISTINCT lang FROM tx)),
uni AS (SELECT spn.lang, cast(spn.letter AS int) AS letter, (coalesce(n, 0) + 1e-3) / sum(coalesce(n, 0) + 1e-3) OVER (PARTITION BY spn.lang) AS p FROM spn LEFT JOIN cnt USING (lang, letter))"""
BI_SQL = """
pr AS (SELECT lang, substr(front, cast(k AS int), 2) AS pair FROM tx, (SELECT unnest(range(1, (SELECT max(length(front)) FROM tx) + 1)) AS k) WHERE k < length(front)),
pc AS (SELECT lang, ord(pair) - 97 AS prev, ord(substr(pair, 2, 1)) - 97 AS cur, count(*) AS n FROM pr GROUP BY ALL),
bsp AS (SELECT lang, a AS prev, b AS cur FROM (SELECT DISTINCT lang FROM tx WHERE length(front) >= 2), (SELECT unnest(range(26)) AS a), (SELECT unnest(range(26)) AS b)),
bi AS (SELECT bsp.lang, cast(bsp.prev AS int) AS prev, cast(bsp.cur AS int) AS cur, (coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1.0) OVER (PARTITION BY bsp.lang, bsp.prev) AS p FROM bsp LEFT JOIN pc USING (lang, prev, cur))"""
RUN_SQL = """
lt AS (SELECT doc_id, cast(k AS bigint) AS pos, ord(substr(rest, cast(k AS int), 1)) - 97 AS letter FROM tx, (SELECT unnest(range(1, (SELECT max(length(rest)) FROM tx) + 1)) AS k) WHERE k <= length(rest)),
lr AS (SELECT a.lang AS lang1, b.lang AS lang0, a.letter, round(log10(a.p / b.p), 12) AS r FROM uni a JOIN uni b ON a.letter = b.letter WHERE (a.lang, b.lang) IN (('en', 'fr'), ('en', 'nl'), ('fr', 'nl'))),
tr AS (SELECT doc_id, lang1, lang0, pos, sum(r) OVER (PARTITION BY doc_id, lang1, lang0 ORDER BY pos ROWS UNBOUNDED PRECEDING) AS llr FROM lt JOIN lr USING (letter))"""
DECIDE_SQL = f"""{RUN_SQL},
cx AS (SELECT doc_id, lang1, lang0, min(pos) FILTER (llr >= {A_} OR llr <= {B_}) AS hit, max(pos) AS z FROM tr GROUP BY ALL),
dc AS (SELECT tr.doc_id, tr.lang1, tr.lang0, CASE WHEN llr >= 0 THEN tr.lang1 ELSE tr.lang0 END AS label, pos AS n_letters, hit IS NULL AS forced, llr FROM tr JOIN cx ON tr.doc_id = cx.doc_id AND tr.lang1 = cx.lang1 AND tr.lang0 = cx.lang0 AND tr.pos = coalesce(hit, z)),
du AS (SELECT doc_id, lang1, lang0, label, n_letters, forced, llr FROM dc UNION ALL
       SELECT doc_id, l1, l0, l1, 0, true, 0.0 FROM tx, (VALUES ('en', 'fr'), ('en', 'nl'), ('fr', 'nl')) v(l1, l0) WHERE rest = '')"""
VOTE_SQL = f"""{DECIDE_SQL},
wn AS (SELECT doc_id, label, count(*) AS wins FROM du GROUP BY ALL),
bs AS (SELECT doc_id, label, wins, row_number() OVER (PARTITION BY doc_id ORDER BY wins DESC, label) AS r FROM wn),
vt AS (SELECT bs.doc_id, label, wins, n_letters FROM bs JOIN (SELECT doc_id, max(n_letters) AS n_letters FROM du GROUP BY 1) m USING (doc_id) WHERE r = 1)"""
BIGRAM_SQL = f"""{BI_SQL}, {RUN_SQL.split("lr AS")[0].rstrip().rstrip(",")},
st AS (SELECT lt.doc_id, lt.pos, l.lang, CASE WHEN lt.pos = 1 THEN round(log10(u.p), 12) ELSE round(log10(b.p), 12) END AS x
       FROM (SELECT *, lag(letter) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM lt) lt CROSS JOIN (SELECT DISTINCT lang FROM uni) l
       JOIN uni u ON u.lang = l.lang AND u.letter = lt.letter LEFT JOIN bi b ON b.lang = l.lang AND b.prev = lt.prev AND b.cur = lt.letter),
ru AS (SELECT doc_id, pos, lang, sum(x) OVER (PARTITION BY doc_id, lang ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM st),
rk AS (SELECT doc_id, pos, lang, s, row_number() OVER (PARTITION BY doc_id, pos ORDER BY s DESC, lang) AS r FROM ru),
mg AS (SELECT doc_id, pos, max(CASE WHEN r = 1 THEN lang END) AS label, max(CASE WHEN r = 1 THEN s END) - max(CASE WHEN r = 2 THEN s END) AS margin FROM rk GROUP BY ALL),
bc AS (SELECT doc_id, coalesce(min(pos) FILTER (margin >= {A_}), max(pos)) AS pos FROM mg GROUP BY 1)"""
ORACLES = {
    "extract_letters": "SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS letters FROM documents WHERE text IS NOT NULL",
    "letter_histogram": f"WITH {TEXT_SQL} SELECT lang, cast(letter AS int) AS letter, n FROM cnt",
    "unigram_model": f"WITH {TEXT_SQL} SELECT lang, letter, round(p, 6) + 0.0 AS p FROM uni",
    "bigram_model": f"WITH {TEXT_SQL}, {BI_SQL} SELECT lang, prev, cur, round(p, 6) + 0.0 AS p FROM bi",
    "expected_samples": f"WITH {TEXT_SQL}, d AS (SELECT a.lang AS lang1, b.lang AS lang0, sum(a.p * log10(a.p / b.p)) AS d1, sum(b.p * log10(b.p / a.p)) AS d0 FROM uni a JOIN uni b ON a.letter = b.letter AND a.lang <> b.lang GROUP BY ALL) SELECT lang1, lang0, round(d1, 6) + 0.0 AS divergence, round({A_} / d1, 4) AS letters1, round(abs({B_}) / d0, 4) AS letters0 FROM d",
    "sprt_unigram": f"WITH {TEXT_SQL}, {DECIDE_SQL} SELECT doc_id, label, n_letters, forced, round(llr, 6) + 0.0 AS llr FROM du WHERE lang1 = 'en' AND lang0 = 'fr'",
    "sprt_trajectory": f"WITH {TEXT_SQL}, {RUN_SQL} SELECT doc_id, cast(pos AS int) AS pos, round(llr, 6) + 0.0 AS llr FROM tr WHERE lang1 = 'en' AND lang0 = 'fr'",
    "sprt_pairwise": f"WITH {TEXT_SQL}, {VOTE_SQL} SELECT doc_id, label, wins, n_letters FROM vt",
    "sprt_error_table": f"WITH {TEXT_SQL}, {VOTE_SQL} SELECT lang AS truth, count(*) AS trials, count(*) FILTER (label <> lang) AS errors, round(avg(CASE WHEN label <> lang THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS error_rate, round(avg(n_letters), 6) + 0.0 AS mean_letters, round(median(n_letters), 6) + 0.0 AS median_letters FROM vt JOIN tx USING (doc_id) GROUP BY 1",
    "sprt_bigram": f"WITH {TEXT_SQL}, {BIGRAM_SQL} SELECT doc_id, label, pos AS n_letters, margin < {A_} AS forced, round(margin, 6) + 0.0 AS margin FROM mg JOIN bc USING (doc_id, pos)",
    "bigram_error_table": f"WITH {TEXT_SQL}, {BIGRAM_SQL}, de AS (SELECT doc_id, label, pos AS n_letters FROM mg JOIN bc USING (doc_id, pos)) SELECT lang AS truth, count(*) AS trials, count(*) FILTER (label <> lang) AS errors, round(avg(CASE WHEN label <> lang THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS error_rate, round(avg(n_letters), 6) + 0.0 AS mean_letters, round(median(n_letters), 6) + 0.0 AS median_letters FROM de JOIN tx USING (doc_id) GROUP BY 1",
    "sample_windows": """WITH d AS (SELECT doc_id, text, b AS draw, 20 + cast(('0x' || substr(md5(concat_ws('|', doc_id, b, 'length', 3)), 1, 8)) AS bigint) % 181 AS len,
 cast(('0x' || substr(md5(concat_ws('|', doc_id, b, 'start', 3)), 1, 8)) AS bigint) AS u FROM documents, (SELECT unnest([1, 2]) AS b) WHERE length(text) > 0),
p AS (SELECT doc_id, draw, cast(u % greatest(length(text) - len + 1, 1) AS int) AS start, text, len FROM d),
w AS (SELECT doc_id, draw, start, array_to_string(list_slice(string_split(text, ''), start + 1, start + len), '') AS window FROM p)
SELECT doc_id, draw, start, "window" FROM w WHERE length(regexp_replace(lower("window"), '[^a-z]', '', 'g')) >= 5""",
    "corpus_unigrams": """WITH p AS (SELECT DISTINCT piece_id, lang, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s FROM load_corpora WHERE piece_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL),
c AS (SELECT lang, ord(x) - 97 AS letter, count(*) AS n FROM (SELECT lang, unnest(string_split(s, '')) AS x FROM p WHERE s <> '') GROUP BY ALL), sp AS (SELECT lang, unnest(range(26)) AS letter FROM (SELECT DISTINCT lang FROM p))
SELECT sp.lang, cast(sp.letter AS int) AS letter, round((coalesce(n, 0) + 1e-3) / sum(coalesce(n, 0) + 1e-3) OVER (PARTITION BY sp.lang), 6) + 0.0 AS p FROM sp LEFT JOIN c USING (lang, letter)""",
}
