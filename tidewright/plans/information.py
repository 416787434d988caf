"""Information-theory queries: counts on lineitem, shuffles and pairs on events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import arrays as A
from tidewright.operators import information as info
from tidewright.session import read_table

#: Permutations behind one estimate, behind each of many (rankings, pairs), and their seed.
B_ONE, B_MANY, SEED = 200, 100, 7


def line_neurons(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (neuron, response, stimulus) of lineitem: four columns as neurons, the return flag as stimulus."""
    t = read_table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("stimulus"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.col("l_linenumber").cast("int").alias("linenumber"),
    )
    return t.unpivot(["stimulus"], ["quantity", "discount", "tax", "linenumber"], "neuron", "response")


LINE_SQL = """
line AS (SELECT l_returnflag AS stimulus, cast(l_quantity AS int) AS quantity, cast(round(l_discount*100) AS int) AS discount,
                cast(round(l_tax*100) AS int) AS tax, cast(l_linenumber AS int) AS linenumber FROM lineitem),
rws AS (SELECT 'quantity' AS neuron, quantity AS response, stimulus FROM line UNION ALL SELECT 'discount', discount, stimulus FROM line
        UNION ALL SELECT 'tax', tax, stimulus FROM line UNION ALL SELECT 'linenumber', linenumber, stimulus FROM line)"""


def event_neurons(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (neuron, event_id, response, stimulus): four numbers of an event as neurons, its type as stimulus."""
    t = read_table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("stimulus"),
        F.hour("ts").alias("r1"),
        F.least(F.floor(F.col("value") / 25), F.lit(9)).cast("int").alias("r2"),
        (F.col("user_id") % 8).cast("int").alias("r3"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 10).alias("r4"),
    )
    return t.unpivot(["event_id", "stimulus"], ["r1", "r2", "r3", "r4"], "neuron", "response").select("neuron", "event_id", "response", "stimulus")


EVENT_SQL = """
ev AS (SELECT event_id, event_type AS stimulus, cast(hour(ts) AS int) AS r1, cast(least(floor(value/25), 9) AS int) AS r2,
              cast(user_id % 8 AS int) AS r3, cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 10 AS r4 FROM events),
pop AS (SELECT 'r1' AS neuron, event_id, r1 AS response, stimulus FROM ev UNION ALL SELECT 'r2', event_id, r2, stimulus FROM ev
        UNION ALL SELECT 'r3', event_id, r3, stimulus FROM ev UNION ALL SELECT 'r4', event_id, r4, stimulus FROM ev)"""


def mi_sql(source: str, keys: str, x: str, y: str, out: str, mm: bool = False, where: str = "true") -> str:
    """CTEs that end in ``out(keys, mi)``: the double sum of p log2(p / (px py)), unlike the entropy form of the operator."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    bias = f"+ (count(DISTINCT {x}) + count(DISTINCT {y}) - count(*) - 1) / (2 * any_value(total) * ln(2))" if mm else ""
    return f"""
{out}_c AS (SELECT {k}{x}, {y}, cast(count(*) AS double) AS n FROM {source} WHERE {where} GROUP BY {k}{x}, {y}),
{out}_m AS (SELECT *, sum(n) OVER (PARTITION BY {k}{x}) AS nx, sum(n) OVER (PARTITION BY {k}{y}) AS ny, sum(n) OVER ({part}) AS total FROM {out}_c),
{out} AS (SELECT {k}sum(n / total * log2(n * total / (nx * ny))) {bias} AS mi FROM {out}_m {group})"""


def r6(c: str, name: str | None = None):
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(name or c)


def mi_plugin(spark, sf):
    j = info.joint_histogram(read_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return info.mutual_information(j, "l_returnflag", "l_linestatus").select(r6("mi"))


def _ranking(method, source):
    def run(spark, sf):
        rows = source(spark, sf)
        mi = info.mi_by_key(rows, ["neuron"], "response", "stimulus", "event_id", method, B_MANY, SEED)
        return info.rank_by_information(mi, "neuron").select("neuron", r6("mi"), "position")

    return run



def population(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (neuron, trial_id, response, stimulus) of decoding_trials: 22 neurons, rates binned by 4."""
    t = read_table(spark, sf, "decoding_trials").where(A.sound("rates", 22) & F.col("stimulus").isNotNull() & F.col("trial_id").isNotNull())
    t = t.select("trial_id", "rates", "stimulus").dropDuplicates(["trial_id"])
    return t.select("trial_id", "stimulus", F.posexplode("rates").alias("neuron", "v")).select("neuron", "trial_id", F.least(F.floor(F.col("v") / 4), F.lit(11)).cast("int").alias("response"), "stimulus")


POPULATION_SQL = """
trials AS (SELECT DISTINCT trial_id, rates, stimulus FROM decoding_trials
           WHERE len(rates) = 22 AND list_count(rates) = 22 AND NOT list_contains(rates, 'nan'::double) AND stimulus IS NOT NULL AND trial_id IS NOT NULL),
pop AS (SELECT cast(i AS int) AS neuron, trial_id AS event_id, cast(least(floor(rates[i + 1] / 4), 11) AS int) AS response, stimulus
        FROM trials, (SELECT unnest(range(22)) AS i))"""
PAIRS_SQL = """
pairs AS (SELECT a.neuron AS i, b.neuron AS j, a.event_id, a.response AS ri, b.response AS rj, a.response || '|' || b.response AS rr, a.stimulus
          FROM pop a JOIN pop b ON a.event_id = b.event_id AND a.neuron < b.neuron)"""


def shuffle_sql(source: str, keys: str, out: str, x: str = "response") -> str:
    """CTEs that end in out(keys, mi): observed MI less the mean over the shuffles of perm(b, event_id, stimulus)."""
    on = " AND ".join(f"o.{k} = s.{k}" for k in keys.split(", "))
    return f"""
{out}_sur AS (SELECT {keys}, b, {x}, perm.stimulus FROM {source} JOIN perm USING (event_id)),
{mi_sql(source, keys, x, 'stimulus', out + '_obs')}, {mi_sql(out + '_sur', keys + ', b', x, 'stimulus', out + '_srr')},
{out} AS (SELECT {", ".join("o." + k for k in keys.split(", "))}, o.mi - s.m AS mi FROM {out}_obs o
         JOIN (SELECT {keys}, avg(mi) AS m FROM {out}_srr GROUP BY {keys}) s ON {on})"""


def perm_sql(b: int) -> str:
    """CTEs that end in perm(event_id, b, stimulus): ``b`` permutations of the stimuli over the trials of pop."""
    return f"""
ids AS (SELECT event_id, stimulus, row_number() OVER (ORDER BY event_id) AS r FROM (SELECT DISTINCT event_id, stimulus FROM pop)),
hsh AS (SELECT event_id, stimulus, b, row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws('|', event_id, b, {SEED})), event_id) AS r
        FROM ids, (SELECT unnest(range(1, {b} + 1)) AS b)),
perm AS (SELECT ids.event_id, hsh.b, hsh.stimulus FROM ids JOIN hsh ON ids.r = hsh.r)"""


def entropy_by_type(spark, sf):
    counts = read_table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return info.entropy(counts, "n", ["event_type"]).select("event_type", r6("entropy"))


def joint_histogram(spark, sf):
    return info.joint_histogram(read_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


def mi_miller_madow(spark, sf):
    j = info.joint_histogram(read_table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("int")), "q", "l_returnflag")
    return info.mutual_information(j, "q", "l_returnflag", method="miller_madow").select(r6("mi"))


def mi_shuffle(spark, sf):
    rows = event_neurons(spark, sf).where("neuron = 'r2'")
    return info.mi_by_key(rows, ["neuron"], "response", "stimulus", "event_id", "shuffle", B_ONE, SEED).select(r6("mi"))


def most_informative(spark, sf):
    mi = info.mi_by_key(line_neurons(spark, sf), ["neuron"], "response", "stimulus")
    return info.most_informative(mi, "neuron").select("neuron", r6("mi"))


def _synergy(method, full=True):
    def run(spark, sf):
        sr = info.synergy(event_neurons(spark, sf), "neuron", "event_id", "response", "stimulus", method, B_MANY, SEED)
        return (info.synergy_matrix(sr) if full else info.synergy_counts(sr)).select(*(["i", "j", r6("sr")] if full else ["redundant", "synergistic", r6("sr_total")]))

    return run


def _pairs(spark, sf):
    return info.pair_rows(event_neurons(spark, sf), "neuron", "event_id", "response", "stimulus")


def noise_corr(spark, sf):
    return info.noise_correlation(_pairs(spark, sf), "stimulus").select("i", "j", r6("noise_mi"))


def signal_corr(spark, sf):
    return info.signal_correlation(_pairs(spark, sf)).select("i", "j", r6("signal_mi"))


def sr2_identity(spark, sf):
    """Noise less signal correlation next to SR: the two are equal."""
    p = _pairs(spark, sf)
    both = info.noise_correlation(p, "stimulus").join(info.signal_correlation(p), ["i", "j"])
    sr = info.synergy(event_neurons(spark, sf), "neuron", "event_id", "response", "stimulus")
    return both.join(sr, ["i", "j"]).select("i", "j", (F.round(F.col("noise_mi") - F.col("signal_mi"), 6) + 0.0).alias("sr2"), r6("sr"))


def pair_regression(spark, sf):
    return info.pair_regression(_pairs(spark, sf), "stimulus").select("i", "j", "stimulus", r6("r"))


def population_ranking(spark, sf):
    mi = info.mi_by_key(population(spark, sf), ["neuron"], "response", "stimulus", method="miller_madow")
    return info.rank_by_information(mi, "neuron").select("neuron", r6("mi"), "position")


def population_synergy(spark, sf):
    return info.synergy(population(spark, sf), "neuron", "trial_id", "response", "stimulus").select("i", "j", r6("sr"))


def mean_rates(spark, sf):
    """Mean rate of every neuron under every stimulus."""
    t = read_table(spark, sf, "decoding_trials").where(A.sound("rates", 22) & F.col("stimulus").isNotNull()).select("trial_id", "rates", "stimulus").dropDuplicates(["trial_id"])
    return t.select("stimulus", F.posexplode("rates").alias("neuron", "v")).groupBy("neuron", "stimulus").agg((F.round(F.avg("v"), 8) + F.lit(0.0)).alias("mean_rate"))


def r6_of(c, name):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


RANK_SQL = "SELECT neuron, round(mi, 6) + 0.0 AS mi, row_number() OVER (ORDER BY round(mi, 12) DESC, neuron) AS position FROM mi"
SR_TAIL = "sr AS (SELECT p.i, p.j, p.mi - a.mi - b.mi AS sr FROM mij p JOIN mi a ON p.i = a.neuron JOIN mi b ON p.j = b.neuron)"
FULL_SQL = """SELECT i, j, round(sr, 6) + 0.0 AS sr FROM sr UNION ALL SELECT j, i, round(sr, 6) + 0.0 FROM sr
UNION ALL SELECT k, k, 0.0 FROM (SELECT i AS k FROM sr UNION SELECT j FROM sr)"""


def _sr_sql(mm: bool) -> str:
    return f"WITH {EVENT_SQL}, {PAIRS_SQL}, {mi_sql('pop', 'neuron', 'response', 'stimulus', 'mi', mm)}, {mi_sql('pairs', 'i, j', 'rr', 'stimulus', 'mij', mm)}, {SR_TAIL}"


NOISE_SQL = f"""{mi_sql('pairs', 'i, j, stimulus', 'ri', 'rj', 'nm')},
share AS (SELECT i, j, stimulus, count(*) / sum(count(*)) OVER (PARTITION BY i, j) AS p FROM pairs GROUP BY i, j, stimulus),
noise AS (SELECT i, j, sum(mi * p) AS noise_mi FROM nm JOIN share USING (i, j, stimulus) GROUP BY i, j)"""
SIGNAL_SQL = mi_sql("pairs", "i, j", "ri", "rj", "sig")

QUERIES = {
    "mi_plugin": mi_plugin,
    "mi_miller_madow": mi_miller_madow,
    "mi_shuffle": mi_shuffle,
    "entropy_by_type": entropy_by_type,
    "joint_histogram": joint_histogram,
    "neuron_ranking_plugin": _ranking("plugin", line_neurons),
    "neuron_ranking_mm": _ranking("miller_madow", line_neurons),
    "neuron_ranking_shuffle": _ranking("shuffle", event_neurons),
    "most_informative": most_informative,
    "synergy_matrix_plugin": _synergy("plugin"),
    "synergy_matrix_mm": _synergy("miller_madow"),
    "synergy_matrix_shuffle": _synergy("shuffle"),
    "synergy_counts": _synergy("plugin", full=False),
    "noise_corr": noise_corr,
    "signal_corr": signal_corr,
    "sr2_identity": sr2_identity,
    "pair_regression": pair_regression,
    "population_ranking": population_ranking,
    "population_synergy": population_synergy,
    "mean_rates": mean_rates,
}
ORACLES = {
    "mi_plugin": f"WITH {mi_sql('lineitem', '', 'l_returnflag', 'l_linestatus', 'mi')} SELECT round(mi, 6) + 0.0 AS mi FROM mi",
    "mi_miller_madow": f"WITH l AS (SELECT cast(l_quantity AS int) AS q, l_returnflag FROM lineitem), {mi_sql('l', '', 'q', 'l_returnflag', 'mi', mm=True)} SELECT round(mi, 6) + 0.0 AS mi FROM mi",
    "mi_shuffle": f"WITH {EVENT_SQL}, {perm_sql(B_ONE)}, r2 AS (SELECT * FROM pop WHERE neuron = 'r2'), {shuffle_sql('r2', 'neuron', 'mi')} SELECT round(mi, 6) + 0.0 AS mi FROM mi",
    "entropy_by_type": "WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM c) SELECT event_type, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY event_type",
    "joint_histogram": "SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL",
    "neuron_ranking_plugin": f"WITH {LINE_SQL}, {mi_sql('rws', 'neuron', 'response', 'stimulus', 'mi')} {RANK_SQL}",
    "neuron_ranking_mm": f"WITH {LINE_SQL}, {mi_sql('rws', 'neuron', 'response', 'stimulus', 'mi', mm=True)} {RANK_SQL}",
    "neuron_ranking_shuffle": f"WITH {EVENT_SQL}, {perm_sql(B_MANY)}, {shuffle_sql('pop', 'neuron', 'mi')} {RANK_SQL}",
    "most_informative": f"WITH {LINE_SQL}, {mi_sql('rws', 'neuron', 'response', 'stimulus', 'mi')} SELECT neuron, round(mi, 6) + 0.0 AS mi FROM mi WHERE round(mi, 12) = (SELECT max(round(mi, 12)) FROM mi)",
    "synergy_matrix_plugin": f"{_sr_sql(False)} {FULL_SQL}",
    "synergy_matrix_mm": f"{_sr_sql(True)} {FULL_SQL}",
    "synergy_matrix_shuffle": f"WITH {EVENT_SQL}, {perm_sql(B_MANY)}, {PAIRS_SQL}, {shuffle_sql('pop', 'neuron', 'mi')}, {shuffle_sql('pairs', 'i, j', 'mij', 'rr')}, {SR_TAIL} {FULL_SQL}",
    "synergy_counts": f"{_sr_sql(False)} SELECT count(*) FILTER (round(sr, 9) < 0) AS redundant, count(*) FILTER (round(sr, 9) > 0) AS synergistic, round(sum(sr), 6) + 0.0 AS sr_total FROM sr",
    "noise_corr": f"WITH {EVENT_SQL}, {PAIRS_SQL}, {NOISE_SQL} SELECT i, j, round(noise_mi, 6) + 0.0 AS noise_mi FROM noise",
    "signal_corr": f"WITH {EVENT_SQL}, {PAIRS_SQL}, {SIGNAL_SQL} SELECT i, j, round(mi, 6) + 0.0 AS signal_mi FROM sig",
    "sr2_identity": f"{_sr_sql(False)}, {NOISE_SQL}, {SIGNAL_SQL} SELECT i, j, round(noise_mi - sig.mi, 6) + 0.0 AS sr2, round(sr, 6) + 0.0 AS sr FROM noise JOIN sig USING (i, j) JOIN sr USING (i, j)",
    "pair_regression": f"WITH {EVENT_SQL}, {PAIRS_SQL} SELECT i, j, stimulus, round(corr(ri, rj), 6) + 0.0 AS r FROM pairs GROUP BY ALL",
    "population_ranking": f"WITH {POPULATION_SQL}, {mi_sql('pop', 'neuron', 'response', 'stimulus', 'mi', mm=True)} {RANK_SQL}",
    "population_synergy": f"WITH {POPULATION_SQL}, {PAIRS_SQL}, {mi_sql('pop', 'neuron', 'response', 'stimulus', 'mi')}, {mi_sql('pairs', 'i, j', 'rr', 'stimulus', 'mij')}, {SR_TAIL} SELECT i, j, round(sr, 6) + 0.0 AS sr FROM sr",
    "mean_rates": f"WITH {POPULATION_SQL} SELECT cast(i AS int) AS neuron, stimulus, round(avg(rates[i + 1]), 8) + 0.0 AS mean_rate FROM trials, (SELECT unnest(range(22)) AS i) GROUP BY ALL",
}
