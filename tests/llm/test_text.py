import random

import pytest
from pyspark.sql import functions as F

from tidewright.llm import canonical_text as ct
from tidewright.llm import encoding_repair as er
from tidewright.llm import language_segments as ls
from tidewright.llm import leakage as lk
from tidewright.llm import mixing
from tidewright.llm import spam_pages as sp

SCHEMA = "id bigint, text string, lang string, _id string, n int"
EN = "The old lantern stands near the window and nobody has moved it since last week. We measured the cable twice before lunch."
FR = "La vieille lanterne est près de la fenêtre et personne ne l'a déplacée depuis la semaine dernière. Nous avons mesuré le câble deux fois."
NL = "De oude lantaarn staat naast het raam en niemand heeft hem sinds vorige week verplaatst. We hebben de kabel twee keer gemeten."


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, *[None] * (schema.count(",") + 1 - len(r))) for r in rows], schema)


# look-alike text


def test_transducer_rules():
    t = ct.transducer()
    assert t("Ｎｏｕｓ") == "Nous" and t("рrès") == "près" and t("café") == "café" and t("е́tе́") == "été"
    assert t("a b c　d") == "a b c d" and t("w​o­rd﻿") == "word" and t("ﬁn ĳs") == "fin ijs"
    assert t("½ × 4 № 7 – µV") == "½ × 4 № 7 – µV"
    assert t("Été") != t("été") and t("ete") != t("été") and t("it's") != t("it’s")
    assert t("") == "" and t("e‍́") == "é" and t("𝐍𝑜𝓊𝘀 Ⅳ 𝟛") == "Nous IV 3"
    for s in ("Ｎｏｕｓ рrès", "café   x"):
        assert t(t(s)) == t(s)


def test_conflicts_are_rejected():
    with pytest.raises(ValueError):
        ct.check_rules({"а": "b", "b": "c"})
    with pytest.raises(ValueError):
        ct.check_rules({"é": ""})
    with pytest.raises(ValueError):
        ct.compiled([("а", "a"), ("а", "o")])
    assert ct.compiled([("а", "a"), ("а", "a")]) == {"а": "a"}
    ct.check_rules(ct.rules())


def test_look_alike_pairs(spark):
    rows = [(1, "été là"), (2, "été là"), (3, "été là"), (4, "ete la"), (5, None), (None, "été là"), (6, ""), (7, "​"), (2, "été là"), (8, "x" * 200_000), (9, "x" * 199_999 + "х")]
    df = frame(spark, rows)
    for salt in (2000, 1):
        got = {(r["lo"], r["hi"]) for r in ct.look_alike_pairs(df, "id", "text", salt).collect()}
        assert got == {(1, 2), (2, 3), (6, 7), (8, 9)}
    assert ct.look_alike_pairs(frame(spark, []), "id", "text").count() == 0
    c = {r["id"]: r["members"] for r in ct.look_alike_classes(df, "id", "text").collect()}
    assert c[1] == 3 and c[4] == 1 and 5 not in c
    links = {r["id"]: r["links"] for r in ct.look_alike_classes(df, "id", "text").collect()}
    assert links == {i: sum(i in p for p in got) for i in c}


# wrong encodings


@pytest.mark.parametrize("wrote,read", [("utf-8", "latin-1"), ("utf-8", "mac-roman"), ("utf-8", "cp850"), ("latin-1", "mac-roman"), ("latin-1", "cp850")])
def test_lattice_holds_the_original(wrote, read):
    word = "déjà"
    assert word in [x for _, x in er.lattice(word.encode(wrote).decode(read))]
    assert word not in [x for _, x in er.lattice(word)]


def test_lost_bytes_are_wildcards_of_the_lattice():
    for word in ("“pass”", "Île", "Ídem", "naïfÁ"):
        read = word.encode().decode("cp1252", errors="replace")
        assert word in [x for _, x in er.lattice(read)]
    assert er.lattice("caf�") == []  # no byte beside it tells what it was
    many = ("”" * 6).encode().decode("cp1252", errors="replace")
    assert ("utf8>cp1252", "”" * 6) in er.lattice(many, {"”": 0.5})


def test_share_of_texts_restored(spark):
    """Held-out texts damaged through every channel: nearly all come back as they were written."""
    rng = random.Random(4)
    words = "été déjà fenêtre câble près là hôtel reçu naïf patiënt coördinator réparé mesuré élève Île “pass” Í".split()
    make = lambda: " ".join(rng.choices([*words, "le", "la", "sans", "avec", "pour"], k=14)) + "."
    rows = [(i, make()) for i in range(300)]
    truth, k = {}, 1000
    for wrote, read in (("utf-8", "cp1252"), ("utf-8", "mac-roman"), ("utf-8", "cp850"), ("latin-1", "mac-roman"), ("latin-1", "cp850")):
        for _ in range(20):
            truth[k] = make().replace("“", "").replace("”", "") if wrote == "latin-1" else make()
            rows.append((k, truth[k].encode(wrote).decode(read, errors="replace")))
            k += 1
    got = {r["id"]: r["restored"] for r in er.repair_encoding(frame(spark, rows), "id", "text").collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 0.97 * len(truth)
    assert all(got[i] == t for i, t in rows[:300])


def test_repair_round_trip(spark):
    rng = random.Random(0)
    words = "été déjà fenêtre câble près là hôtel reçu naïf patiënt coördinator réparé mesuré élève".split()
    good = [" ".join(rng.choices([*words, "le", "la", "sans", "avec", "pour"], k=12)) + "." for _ in range(150)]
    bad = {200: ("utf-8", "cp1252"), 201: ("utf-8", "mac-roman"), 202: ("latin-1", "cp850"), 203: ("latin-1", "mac-roman")}
    rows = [(i, t) for i, t in enumerate(good)]
    truth = {}
    for i, (w, r) in bad.items():
        truth[i] = " ".join(rng.choices(words, k=6)).replace("à", "é")
        rows.append((i, truth[i].encode(w).decode(r)))
    rows += [(300, "12,5 °C ± 0,3 µV – São £20, ÂGE 3, Ã."), (301, None), (302, ""), (None, "Ã©"), (303, "une fen�tre"), (303, "une fen�tre"), (304, "x " * 30_000)]
    got = {r["id"]: r for r in er.repair_encoding(frame(spark, rows), "id", "text").collect()}
    assert {i for i, r in got.items() if r["damaged"]} == {*bad, 303}
    assert all(got[i]["restored"] == t for i, t in truth.items())
    assert got[303]["restored"] == "une fenêtre" and got[300]["restored"] == got[300]["text"] and 301 not in got and got[302]["damaged"] is False
    assert er.repair_encoding(frame(spark, []), "id", "text").count() == 0


def test_best_path_needs_evidence():
    assert er.best_path([(-3.0, {"a": ("x", -6.0)})]) == [""]
    assert er.best_path([(-20.0, {"a": ("x", -6.0)}), (-7.0, {"a": ("y", -6.5)})]) == ["a", "a"]


# languages


@pytest.fixture(scope="module")
def labelled(spark):
    parts = [(lang, s) for lang, t in (("english", EN), ("fr", FR), ("NLD", NL)) for s in t.split(". ")]
    rng = random.Random(1)
    rows = []
    for i in range(120):
        lang = ("english", "fr", "NLD")[i % 3]
        own = [s for k, s in parts if k == lang]
        rows.append((i, ". ".join(rng.choices(own, k=3)) + ".", lang))
    return rows


def test_segments(spark, labelled):
    extra = [(500, EN + " " + FR.split(". ")[0] + ". " + NL, None), (501, FR, "english"), (502, NL, "unknown"), (503, None, "fr"), (504, "", "fr"), (505, "12 34", None), (None, EN, "en"), (506, EN, " EN "), (506, EN, " EN "), (507, (EN + " ") * 400, "en")]
    df = frame(spark, labelled + extra)
    got = {}
    for r in ls.language_segments(df, "id", "text", "lang").orderBy("id", "seg").collect():
        got.setdefault(r["id"], []).append(r)
    assert [r["lang"] for r in got[500]] == ["english", "french", "dutch"]
    assert [r["lang"] for r in got[501]] == ["french"] and not got[501][0]["label_ok"]
    assert [r["lang"] for r in got[502]] == ["dutch"] and got[502][0]["label"] is None
    assert 503 not in got and 504 not in got and got[505][0]["lang"] is None
    assert len(got[506]) == 1 and got[506][0]["label_ok"] and got[506][0]["confidence"] > 0.6
    assert [r["lang"] for r in got[507]] == ["english"]
    held = [r for i, rs in got.items() if i < 120 for r in rs]
    assert sum(r["label_ok"] for r in held) / len(held) > 0.97


def test_labels_of_regions_and_a_noisy_sample(spark, labelled):
    for said, want in (("fr-CA", "french"), ("nl_BE", "dutch"), ("en_US", "english"), (" French (Canada) ", "french"), ("none", None), ("und", None), ("", None), (None, None), ("frog", None)):
        assert ls.named_language(said) == want
        df = frame(spark, [(1, "x", said)])
        assert df.select(ls.named_language_column("lang").alias("y")).first()["y"] == want
    wrong = [(i, t, "NLD" if i % 15 == 0 else y) for i, t, y in labelled]  # a few wrong labels don't close the floor
    model = ls.fit(frame(spark, wrong), "id", "text", "lang")
    assert model.floor < 0.95 and model.noise <= 0.2


def test_segments_without_labels(spark):
    assert ls.language_segments(frame(spark, []), "id", "text", "lang").count() == 0
    assert [r["lang"] for r in ls.language_segments(frame(spark, [(1, EN)]), "id", "text", "lang").collect()] == [None]


def test_sentences():
    t = "One two. « Trois quatre ! » Five?\nsix"
    assert [t[a:b] for a, b in ls.sentences(t)] == ["One two.", "« Trois quatre !", "» Five?", "six"] or len(ls.sentences(t)) == 4


# leaks


ITEM = "In 1241 the beekeepers of Dogafemi doubled the barge near Ranela for a fee of sixty ducats and the archivists of Kemoru later postponed it without informing the lower chamber"


def brute_longest(item, doc, edits):
    best = 0
    for i in range(len(item)):
        for k in range(len(item), i, -1):
            if k - i <= best:
                break
            w = item[i:k]
            for a in range(len(doc)):
                for b in range(a + 1, min(len(doc), a + len(w) + edits) + 1):
                    if doc[a] != w[0] or doc[b - 1] != w[-1] or abs(b - a - len(w)) > edits:
                        continue
                    d = list(range(b - a + 1))
                    for x, u in enumerate(w):
                        p, d[0] = d[0], x + 1
                        for y in range(1, b - a + 1):
                            p, d[y] = d[y], min(d[y] + 1, d[y - 1] + 1, p + (u != doc[a + y - 1]))
                    if d[-1] <= edits:
                        best = max(best, len(w))
    return best


def test_longest_passage_against_brute_force():
    rng = random.Random(3)
    for _ in range(25):
        item = [rng.choice("abcdefghij") + str(k) for k in range(12)]
        doc = item[rng.randrange(4) : rng.randrange(7, 12)]
        for _ in range(rng.randrange(4)):
            doc[rng.randrange(len(doc))] = "zz"
        doc = ["q"] * 3 + doc + ["r"] * 2
        assert lk.longest_passage(item, doc, 2) == brute_longest(item, doc, 2)


def test_leaks(spark):
    w = ITEM.split()
    half = len(w) // 2
    swapped = " ".join(w[:20]).replace("barge", "boat").replace("sixty", "ninety")
    shuffled = w[:]
    random.Random(5).shuffle(shuffled)
    rows = [
        (1, "> Hello\n> " + ITEM.upper() + "!"), (2, swapped + " etc."), (3, " ".join(w[: half - 4])), (4, " ".join(shuffled)), (5, None), (6, ""), (None, ITEM),
        (7, "<p>" + " ".join(w[:18]).replace("the", "<b>the</b>") + "</p>"), (8, "x " * 50_000 + ITEM), (1, "> Hello\n> " + ITEM.upper() + "!"),
        (9, " ".join(w[:20]).replace("barge", "a").replace("sixty", "b").replace("1241", "c").replace("fee", "d").replace("near", "e")),
    ]
    items = frame(spark, [(70, ITEM), (71, None), (None, ITEM), (72, "")])
    got = {(r["doc"], r["item"]) for r in lk.leaked_passages(frame(spark, rows).withColumnRenamed("id", "doc"), items.withColumnRenamed("id", "item"), "doc", "text", "item", "text").collect()}
    assert got == {(1, 70), (2, 70), (7, 70), (8, 70)}
    none = frame(spark, [])
    assert lk.leaked_passages(none.withColumnRenamed("id", "doc"), items.withColumnRenamed("id", "item"), "doc", "text", "item", "text").count() == 0
    assert lk.leaked_passages(frame(spark, rows).withColumnRenamed("id", "doc"), none.withColumnRenamed("id", "item"), "doc", "text", "item", "text").count() == 0
    with pytest.raises(ValueError):
        lk.leaked_passages(none, items, "id", "text", "id", "text", share=0)


def edited_passages(item, seed):
    """Passages of an item with two words replaced, added or left out, the new words 5 to 30 letters longer, among other words."""
    rng, w, out = random.Random(seed), item.split(), []
    for longer in range(5, 31):
        for offset in range(0, len(w) - 16, 2):
            part = w[offset : offset + 17]
            for k in rng.sample(range(1, 16), 2):
                kind = rng.choice(["change", "change", "add", "drop"])
                new = "q" * (len(part[k]) + longer)
                part[k] = {"change": new, "add": part[k] + " " + new, "drop": ""}[kind]
            out.append(" ".join(["lead"] * rng.randrange(60) + part + ["tail"] * rng.randrange(9)))
    return out


@pytest.mark.parametrize("bound", [1_000_000, 1])
def test_no_passage_is_lost_whatever_the_length_of_the_words(spark, monkeypatch, bound):
    monkeypatch.setattr(lk, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(lk, "PIECE_WORDS", 50)
    other = "Two surveyors walk from Nanodo to Pemibe in 21 hours resting 7 times at the bakery and once near the old mill before they reach the harbour"
    texts = edited_passages(ITEM, 1) + edited_passages(other, 2) + [ITEM + " " + other, "nothing here", "fee"]
    items = {70: ITEM, 71: other, 72: "sixty ducats", 73: "fee", 74: "of the 21 hours"}
    want = {}
    for i, t in enumerate(texts):
        for k, item in items.items():
            words = lk.plain_words(item)
            got = lk.longest_passage(words, lk.plain_words(t), 2)
            if got >= lk.least_passage(len(words), 0.5):
                want[i, k] = got
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)]).withColumnRenamed("id", "doc")
    found = lk.leaked_passages(docs, frame(spark, list(items.items())).withColumnRenamed("id", "item"), "doc", "text", "item", "text").collect()
    assert {(r["doc"], r["item"]): r["words"] for r in found} == want
    assert len(found) == len(want) > 200 and {73, 70, 71, 74} <= {k for _, k in want}


# mixing


def test_mix_reaches_targets(spark):
    rng = random.Random(7)
    rows = [(i, "word " * rng.randrange(5, 60), "a" if i % 3 else "b") for i in range(900)] + [(2000, None, "a"), (2001, "x", None), (None, "y", "a"), (2002, "", "b")]
    docs = frame(spark, rows).withColumnRenamed("lang", "source")
    goals = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 4), ("c", 0.2, 9)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(docs, goals, "id", "text", "source")
    r = {x["source"]: x for x in report.collect()}
    assert r["a"]["share_of_total"] == pytest.approx(0.3, abs=0.01) and r["b"]["share_of_total"] == pytest.approx(0.5, abs=0.01)
    assert r["c"]["mixed_tokens"] == 0 and [s for s in "abc" if not r[s]["reachable"]] == ["c"]
    # the report tells what the mix holds: a source short of its target has every document as often as allowed
    assert all((r[s]["copies"], r[s]["mixed_tokens"]) == (sum(x["copies"] for x in mix.collect() if x["source"] == s), sum(x["copies"] * x["tokens"] for x in mix.collect() if x["source"] == s)) for s in "abc")
    tight = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    some, told = mixing.mix_sources(docs, tight, "id", "text", "source")
    t = {x["source"]: x for x in told.collect()}
    assert not t["a"]["reachable"] and t["a"]["exhausted"] and t["b"]["reachable"] and not t["b"]["exhausted"]
    assert some.where("source = 'a'").agg({"copies": "max"}).first()[0] == 1
    named = docs.selectExpr("concat('d', id) AS id", "text", "source")  # ids of another type
    assert mixing.mix_sources(named, goals, "id", "text", "source")[0].dtypes[0] == ("id", "string")
    rows_ = mix.collect()
    assert len({x["id"] for x in rows_}) == len(rows_) and all(1 <= x["copies"] <= 4 for x in rows_)
    again, _ = mixing.mix_sources(docs, goals, "id", "text", "source")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows_))


def test_mix_of_nothing(spark):
    docs = frame(spark, []).withColumnRenamed("lang", "source")
    goals = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(docs, goals, "id", "text", "source")
    assert mix.count() == 0 and report.first()["mixed_tokens"] == 0
    assert mixing.mix_sources(docs, goals.where("source = 'z'"), "id", "text", "source")[1].count() == 0


def test_token_counts(spark):
    got = [r["n"] for r in frame(spark, [(1, "hello world"), (2, ""), (3, None)]).orderBy("id").select(mixing.token_counts("text").alias("n")).collect()]
    assert got == [2, 0, 0]


# spam


def test_own_text():
    t = '[quote="a"]x [quote]y[/quote] z[/quote]\n> quoted\nmine\n-- \nSig\nhttp://sig.example/'
    assert sp.own_text(t) == "mine"
    assert sp.own_text("a wrote:\n&gt; b\nc\n__________\nMe") == "c"


def test_spam(spark):
    rng = random.Random(9)
    kw = "cheap phone cases online best garden hose price".split()
    posts, spam = [], []
    for i in range(200):
        s = [f"{rng.choice(['We', 'They', 'Nobody'])} {rng.choice(['moved', 'sold', 'cleaned'])} the {rng.choice(['lamp', 'radio', 'bench', 'door'])} {rng.choice(['before lunch', 'in the attic', 'near the canal'])}, as you can see." for _ in range(4)]
        posts.append((i, " ".join(s), "f1"))
    for i in range(300, 330):
        spam.append((i, rng.choice([" ", ", ", "\n"]).join(rng.choice(kw) + " " + rng.choice(kw) for _ in range(40)), "f2"))
        spam.append((i + 100, "\n".join(f"http://{rng.choice(kw)}{k}.example/{rng.choice(kw)}" for k in range(15)), "f2"))
    odd = [(900, None, "f1"), (901, "", "f1"), (902, "[removed]", None), (None, "x", "f1"), (903, "> " + spam[0][1].replace("\n", " ") + "\n" + posts[0][1], "f1"), (904, "\n".join(f"{k} {k * 1.7:.2f} {k * 3.1:.2f}" for k in range(20)), "f1"), (905, posts[1][1] * 300, "f1"), (300, spam[0][1], "f2")]
    df = frame(spark, posts + spam + odd).withColumnRenamed("lang", "host")
    got = {r["id"]: r for r in sp.spam_pages(df, "id", "text", "host").collect()}
    assert {i for i, r in got.items() if r["is_spam"]} == {r[0] for r in spam}
    assert len(got) == len(posts) + len(spam) + 6
    assert sp.spam_pages(frame(spark, []).withColumnRenamed("lang", "host"), "id", "text", "host").count() == 0
    only = frame(spark, posts[:5]).withColumnRenamed("lang", "host")
    assert sp.spam_pages(only, "id", "text", "host").where("is_spam").count() == 0
