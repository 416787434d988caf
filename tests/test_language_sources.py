import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import langid as L
from tidewright.sources import generators as gen
from tidewright.sources import readers
from tidewright.streaming.sprt_stream import refractory_sessions, sprt_stream


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "en", "The Quick brown fox, 12 times!"), (2, "en", "jumps over the lazy dog"), (3, "fr", "Le renard brun saute"), (4, "fr", "par-dessus le chien"), (5, None, "x"), (6, "en", None), (7, "fr", "12345 !? \n\t")]
    return spark.createDataFrame(rows, "id int, lang string, text string").withColumn("s", L.letters("text"))


def test_letters(spark, corpus):
    got = {r["id"]: r["s"] for r in corpus.collect()}
    assert got[1] == "thequickbrownfoxtimes" and got[7] == "" and got[6] is None
    assert [r["c"] for r in corpus.where("id = 5").select(L.codes("s").alias("c")).collect()] == [[23]]


def test_models(spark, corpus):
    u = L.train_unigram(corpus, "lang", "s").collect()
    assert len(u) == 52
    for lang in ("en", "fr"):
        assert sum(r["p"] for r in u if r["lang"] == lang) == pytest.approx(1)
    text = "thequickbrownfoxtimes" + "jumpsoverthelazydog"
    e = next(r["p"] for r in u if r["lang"] == "en" and r["letter"] == 4)
    assert e == pytest.approx((text.count("e") + 1e-3) / (len(text) + 26e-3))
    b = L.train_bigram(corpus, "lang", "s").collect()
    assert len(b) == 2 * 676
    assert sum(r["p"] for r in b if r["lang"] == "en" and r["prev"] == 7) == pytest.approx(1)
    th = next(r["p"] for r in b if (r["lang"], r["prev"], r["cur"]) == ("en", 19, 7))
    n_t = sum(1 for s in ("thequickbrownfoxtimes", "jumpsoverthelazydog") for x in s[:-1] if x == "t")
    assert th == pytest.approx((2 + 1) / (n_t + 26))


def test_wald():
    for a, b in ((0.05, 0.05), (0.01, 0.01), (0.05, 0.001), (1e-4, 1e-3)):
        up, low = L.wald_thresholds(a, b)
        assert up == pytest.approx(math.log10((1 - a) / b)) and low == pytest.approx(math.log10(a / (1 - b))) and up > 0 > low
    for bad in ((0, 0.1), (0.6, 0.6), (1, 0.1)):
        with pytest.raises(ValueError):
            L.wald_thresholds(*bad)


def python_sprt(codes, ratios, up, low):
    s = n = 0
    for x in codes:
        s, n = s + ratios[x], n + 1
        if s >= up or s <= low:
            return s >= 0, n, False
    return s >= 0, n, True


def test_sprt_against_plain_loop(spark):
    rng = np.random.default_rng(0)
    ratios = np.round(rng.normal(0, 0.4, 26), 12).tolist()
    texts = ["".join(chr(97 + k) for k in rng.integers(0, 26, n)) for n in (0, 1, 3, 40, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    table = spark.createDataFrame([("a", "b", ratios)], "lang1 string, lang0 string, ratios array<double>")
    up, low = L.wald_thresholds(0.01, 0.01)
    for r in L.sprt(df, "id", "s", table, 0.01, 0.01).collect():
        first, n, forced = python_sprt([ord(c) - 97 for c in texts[r["id"]]], ratios, up, low)
        assert (r["label"] == "a", r["n_letters"], r["forced"]) == (first, n, forced)
    run = [r["llr"] for r in L.sprt_trajectory(df, "id", "s", table).where("id = 3").orderBy("pos").collect()]
    assert run == pytest.approx(np.cumsum([ratios[ord(c) - 97] for c in texts[3]]))


def test_bigrams_tell_chains_that_letters_cannot(spark):
    rng = np.random.default_rng(1)

    def chain(step, n):
        x, out = int(rng.integers(26)), []
        for _ in range(n):
            out.append(chr(97 + x))
            x = (x + step) % 26 if rng.random() < 0.7 else int(rng.integers(26))
        return "".join(out)

    train = spark.createDataFrame([("one", chain(1, 4000)), ("three", chain(3, 4000))], "lang string, s string")
    tests = spark.createDataFrame([(k, ("one", "three")[k % 2], chain((1, 3)[k % 2], 60)) for k in range(40)], "id int, truth string, s string")
    u, b = L.train_unigram(train, "lang", "s"), L.train_bigram(train, "lang", "s")
    d = L.bigram_sprt(tests, "id", "s", L.bigram_tables(u, b, ("one", "three")), 0.01, 0.01).join(tests, "id")
    assert d.where("label <> truth").count() <= 4
    stats = L.trial_stats(d, "truth").collect()
    assert sum(r["trials"] for r in stats) == 40
    v = L.pairwise_vote(L.sprt(tests, "id", "s", L.log_ratios(u, [("one", "three")]), 0.05, 0.05), "id", ("one", "three"))
    assert v.count() == 40


def test_windows_and_split(spark, corpus):
    w = L.sample_windows(corpus, "id", "text", 3, 5, 10, 3, seed=1).collect()
    assert w and all(5 <= len(r["window"]) <= 10 for r in w)
    front, rest = L.split_text("s")
    r = corpus.where("id = 2").select(front.alias("a"), rest.alias("b"), "s").first()
    assert r["a"] + r["b"] == r["s"] and len(r["a"]) == int(0.8 * len(r["s"]))


def test_expected_samples(spark, corpus):
    e = L.expected_samples(L.train_unigram(corpus, "lang", "s"), 0.05, 0.05).collect()
    assert len(e) == 2 and all(r["divergence"] > 0 and r["letters1"] > 0 for r in e)
    same = spark.createDataFrame([("a", k, 1 / 26) for k in range(26)] + [("b", k, 1 / 26) for k in range(26)], "lang string, letter int, p double")
    assert all(math.isinf(r["letters1"]) for r in L.expected_samples(same, 0.05, 0.05).collect())


def test_readers(spark, tmp_path):
    (tmp_path / "nl.txt").write_bytes("één café".encode("latin1"))
    got = readers.load_corpora(spark, {"dutch": str(tmp_path / "nl.txt")}).first()
    assert got["text"] == "één café" and got["lang"] == "dutch"
    (tmp_path / "m.txt").write_text("1 2 3\n4 5 6\n")
    cells = readers.load_matrix(spark, str(tmp_path / "m.txt")).orderBy("line", "col").collect()
    assert [r["value"] for r in cells] == [1, 2, 3, 4, 5, 6]
    readers.write_results(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        readers.load_corpora(spark, {})


def test_generators(spark):
    s = gen.sinusoid(spark, 5, 100, 1.0)
    assert s.count() == 100 and s.where("i = 5").first()["v"] == pytest.approx(math.sin(2 * math.pi * 0.25))
    q = spark.createDataFrame([(0.3,), (99.0,)], "v double").select(gen.quantised("v", 10, 1, 4).alias("q")).collect()
    assert q[0]["q"] == pytest.approx(0.0) and q[1]["q"] == pytest.approx(7 * 10 / 16)
    train = gen.poisson_train(spark, 2, 20, 5.0)
    rate = train.count() / 10
    assert 14 < rate < 26
    gaps = train.groupBy("unit").agg(F.sort_array(F.collect_list("t")).alias("t")).collect()
    assert all(np.diff(r["t"]).min() >= 0.002 - 1e-9 for r in gaps)
    assert gen.bursting_train(spark, 1, 5, 5.0).count() > 10
    assert gen.add_overlaps(train, 2, 0.5, 0.001).where("planted").count() > 20
    n = gen.colored_noise(spark, 1, 256).collect()
    assert np.std([r["v"] for r in n]) == pytest.approx(1)


def test_stream_decides(spark, tmp_path):
    ratios = [1.0 if k == 0 else -1.0 for k in range(26)]
    spark.createDataFrame([(1, "aaaa"), (2, "zzzz"), (None, "a")], "id bigint, text string").write.json(str(tmp_path / "in"))
    chunks = spark.readStream.schema("id bigint, text string").json(str(tmp_path / "in"))
    q = sprt_stream(chunks, "id", "text", ratios, ("a", "z"), 0.05, 0.05).writeStream.format("memory").queryName("decisions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()  # a pending timeout would keep other triggers running
    assert q.awaitTermination(60)
    got = {r["id"]: (r["label"], r["n_letters"], r["forced"]) for r in spark.table("decisions").collect()}
    assert got == {1: ("a", 2, False), 2: ("z", 2, False)}


def test_sessions(spark):
    d = spark.sql("SELECT 1 AS rec, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s) AS ts, s * 1.0D AS a FROM VALUES (0), (1), (10) AS v(s)")
    got = refractory_sessions(d, ["rec"], "ts", "a", "2 seconds", "1 minute").orderBy("start").collect()
    assert [(r["hits"], r["peak"]) for r in got] == [(2, 1.0), (1, 10.0)]
