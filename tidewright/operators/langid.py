"""Sequential language identification: letter models and probability ratio tests.

Texts are letter strings; models are few rows (26 or 676 per language). A test sums along one text's
letters in blocks, vectorised, and stops with the block that decides it; a text is one row and no text is joined
letter by letter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import checkpointed

LETTERS = 26
BLOCK = 4096


def _codes(letter_string: str) -> np.ndarray:
    return np.frombuffer(letter_string.encode("ascii"), dtype=np.uint8).astype(np.int64) - 97


def letters(text: Column | str) -> Column:
    """The text's a-z letters in order, as a string: lower case, everything else dropped; null stays null."""
    return F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), "[^a-z]", "")


def codes(letter_string: Column | str) -> Column:
    """Letters as an array of 0..25."""
    s = F.col(letter_string) if isinstance(letter_string, str) else letter_string
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c) - 97)


def _counted(texts: DataFrame, lang: str, letter_string: str, pairs: bool) -> DataFrame:
    """(lang, code, n): letters (or 27 prev + cur for letter pairs) counted per batch of texts, then summed per language."""
    kind = dict(texts.dtypes)[lang]

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            names, codes_, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for name, group in pdf.groupby("lang"):
                x = _codes("{".join(group["s"]))  # the sign after z parts the texts: code 26
                n = np.bincount(27 * x[:-1] + x[1:] if pairs else x)
                found = np.flatnonzero(n)
                names += [name] * len(found)
                codes_.append(found)
                counts.append(n[found])
            yield pd.DataFrame({"lang": pd.Series(names, dtype=object), "code": np.concatenate(codes_), "n": np.concatenate(counts)})

    rows = texts.where(F.col(lang).isNotNull() & F.col(letter_string).isNotNull()).select(F.col(lang).alias("lang"), F.col(letter_string).alias("s"))
    return rows.mapInPandas(count, f"lang {kind}, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def letter_counts(texts: DataFrame, lang: str, letter_string: str) -> DataFrame:
    """(lang, letter, n), letters that occur only; counted in one pass over the texts without exploding letters."""
    return _counted(texts, lang, letter_string, False).where(F.col("code") < LETTERS).select("lang", F.col("code").alias("letter"), "n")


def train_unigram(texts: DataFrame, lang: str, letter_string: str, smoothing: float = 1e-3) -> DataFrame:
    """(lang, letter, p): smoothed letter shares, all 26 letters for every language."""
    if smoothing < 0:
        raise ValueError("smoothing must not be negative")
    counts = letter_counts(texts, lang, letter_string)
    langs = texts.where(F.col(lang).isNotNull() & F.col(letter_string).isNotNull()).select(F.col(lang).alias("lang")).distinct()
    spine = langs.select("lang", F.explode(F.sequence(F.lit(0), F.lit(LETTERS - 1))).alias("letter"))
    full = spine.join(counts, ["lang", "letter"], "left").select("lang", "letter", (F.coalesce("n", F.lit(0)) + smoothing).alias("w"))
    return full.select("lang", "letter", F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("lang"))).alias("p"))


def train_bigram(texts: DataFrame, lang: str, letter_string: str, smoothing: float = 1.0) -> DataFrame:
    """(lang, prev, cur, p): smoothed transitions, each row of 26 sums to 1; transitions don't cross texts."""
    prev, cur = F.floor(F.col("code") / 27).cast("int"), F.col("code") % 27
    counts = checkpointed(_counted(texts, lang, letter_string, True).select("lang", prev.alias("prev"), cur.alias("cur"), "n").where("prev < 26 AND cur < 26"))  # at most 676 rows a language
    spine = counts.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(0), F.lit(LETTERS - 1))).alias("prev")).select("lang", "prev", F.explode(F.sequence(F.lit(0), F.lit(LETTERS - 1))).alias("cur"))
    full = spine.join(counts, ["lang", "prev", "cur"], "left").select("lang", "prev", "cur", (F.coalesce("n", F.lit(0)) + smoothing).alias("w"))
    return full.select("lang", "prev", "cur", F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("lang", "prev"))).alias("p"))


def wald_thresholds(alpha: float, beta: float) -> tuple[float, float]:
    """(A, B) = (log10((1 - alpha) / beta), log10(alpha / (1 - beta))); alpha and beta in (0, 1) with alpha + beta < 1."""
    if not (0 < alpha < 1 and 0 < beta < 1 and alpha + beta < 1):
        raise ValueError("alpha and beta must lie in (0, 1) with a sum below 1")
    return math.log10((1 - alpha) / beta), math.log10(alpha / (1 - beta))


def expected_samples(unigram: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(lang1, lang0, divergence, letters1, letters0) for every ordered pair of languages.

    divergence is D(p1 || p0) in base 10; letters1 = A / D(p1 || p0), letters0 = |B| / D(p0 || p1); infinite
    where a divergence is 0.
    """
    a, b = wald_thresholds(alpha, beta)
    x = unigram.select(F.col("lang").alias("lang1"), "letter", F.col("p").alias("p1"))
    y = unigram.select(F.col("lang").alias("lang0"), "letter", F.col("p").alias("p0"))
    pairs = x.join(y, "letter").where("lang1 <> lang0").groupBy("lang1", "lang0").agg(
        F.sum(F.when(F.col("p1") > 0, F.col("p1") * F.log10(F.col("p1") / F.col("p0")))).alias("divergence"),
        F.sum(F.when(F.col("p0") > 0, F.col("p0") * F.log10(F.col("p0") / F.col("p1")))).alias("_back"),
    )
    over = lambda t, d: F.when(F.col(d) > 0, t / F.col(d)).otherwise(float("inf"))
    return pairs.select("lang1", "lang0", "divergence", over(a, "divergence").alias("letters1"), over(abs(b), "_back").alias("letters0"))


def log_ratios(unigram: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(lang1, lang0, ratios): for each pair the 26 values log10(p1 / p0), rounded to 12 digits, as one array."""
    wide = unigram.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("letter", "p"))), lambda e: e["p"]).alias("p"))
    chosen = wide.sparkSession.createDataFrame(list(pairs), "lang1 string, lang0 string")
    one, two = wide.select(F.col("lang").alias("lang1"), F.col("p").alias("p1")), wide.select(F.col("lang").alias("lang0"), F.col("p").alias("p0"))
    return chosen.join(one, "lang1").join(two, "lang0").select("lang1", "lang0", F.zip_with("p1", "p0", lambda a, b: F.round(F.log10(a / b), 12)).alias("ratios"))


def sprt(texts: DataFrame, text_id: str, letter_string: str, ratios: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(id, lang1, lang0, label, n_letters, forced, llr) for every text and pair of languages.

    The log ratio is summed letter by letter; at A or more lang1 is decided, at B or less lang0. A text that
    ends first is decided by the sign (0 counts for lang1) and marked as forced. The ratio tables are a
    handful of rows and are broadcast.
    """
    a, b = wald_thresholds(alpha, beta)
    met = texts.select(text_id, F.col(letter_string).alias("_x")).where("_x IS NOT NULL").join(F.broadcast(ratios))

    @F.pandas_udf("s double, n bigint")
    def decide(texts_: pd.Series, tables: pd.Series) -> pd.DataFrame:
        out = []
        for x, table in zip(texts_, tables):
            s, n, table = 0.0, 0, np.asarray(table)
            for at in range(0, len(x), BLOCK):
                run = np.cumsum(np.concatenate([[s], table[_codes(x[at : at + BLOCK])]]))[1:]
                hit = np.flatnonzero((run >= a) | (run <= b))
                k = hit[0] if len(hit) else len(run) - 1
                s, n = run[k], at + k + 1
                if len(hit):
                    break
            out.append((s, n))
        return pd.DataFrame(out, columns=["s", "n"])

    folded = met.withColumn("_r", decide("_x", "ratios"))
    s = F.col("_r.s")
    return folded.select(
        text_id, "lang1", "lang0", F.when(s >= 0, F.col("lang1")).otherwise(F.col("lang0")).alias("label"), F.col("_r.n").alias("n_letters"), ((s < a) & (s > b)).alias("forced"), s.alias("llr")
    )


def sprt_trajectory(texts: DataFrame, text_id: str, letter_string: str, ratios: DataFrame) -> DataFrame:
    """(id, lang1, lang0, pos, llr): the running log ratio after each letter (pos from 1), without stopping."""
    met = texts.select(text_id, F.col(letter_string).alias("_x")).where("_x IS NOT NULL").join(F.broadcast(ratios))

    @F.pandas_udf("array<double>")
    def running(texts_: pd.Series, tables: pd.Series) -> pd.Series:
        return pd.Series([np.cumsum(np.asarray(table)[_codes(x)]) for x, table in zip(texts_, tables)])

    return met.select(text_id, "lang1", "lang0", F.posexplode(running("_x", "ratios")).alias("p", "llr")).select(text_id, "lang1", "lang0", (F.col("p") + 1).alias("pos"), "llr")


def pairwise_vote(decisions: DataFrame, text_id: str, order: Sequence[str]) -> DataFrame:
    """(id, label, wins, n_letters): the language that wins most of a text's duels; ties go to the first in ``order``."""
    place = F.create_map(*[x for k, lang in enumerate(order) for x in (F.lit(lang), F.lit(k))])
    wins = decisions.groupBy(text_id, "label").agg(F.count(F.lit(1)).alias("wins"))
    best = wins.groupBy(text_id).agg(F.max(F.struct(F.col("wins"), (-F.element_at(place, F.col("label"))).alias("o"), F.col("label"))).alias("m"))
    longest = decisions.groupBy(text_id).agg(F.max("n_letters").alias("n_letters"))
    return best.join(longest, text_id).select(text_id, F.col("m.label").alias("label"), F.col("m.wins").alias("wins"), "n_letters")


def bigram_tables(unigram: DataFrame, bigram: DataFrame, langs: Sequence[str]) -> DataFrame:
    """One row (langs, first, step): log10 tables of all languages; first[26 l + x], step[676 l + 26 prev + cur]."""
    place = F.create_map(*[x for k, lang in enumerate(langs) for x in (F.lit(lang), F.lit(k))])
    log = F.round(F.log10("p"), 12)
    first = unigram.where(F.col("lang").isin(*langs)).agg(F.transform(F.array_sort(F.collect_list(F.struct((F.element_at(place, F.col("lang")) * 26 + F.col("letter")).alias("k"), log.alias("v")))), lambda e: e["v"]).alias("first"))
    step = bigram.where(F.col("lang").isin(*langs)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((F.element_at(place, F.col("lang")) * 676 + F.col("prev") * 26 + F.col("cur")).alias("k"), log.alias("v")))), lambda e: e["v"]).alias("step")
    )
    return first.crossJoin(step).withColumn("langs", F.array(*[F.lit(x) for x in langs]))


def bigram_sprt(texts: DataFrame, text_id: str, letter_string: str, tables: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(id, label, n_letters, forced, margin): all languages' likelihoods run along the text until the best leads by A.

    The first letter counts by its share, later ones by their transition; at the end of the text the best
    language is decided and marked as forced. Ties go to the first language.
    """
    a, _ = wald_thresholds(alpha, beta)
    met = texts.select(text_id, F.col(letter_string).alias("_x")).where("_x <> ''").join(F.broadcast(tables))

    @F.pandas_udf("best int, n bigint, lead double")
    def decide(texts_: pd.Series, firsts: pd.Series, steps: pd.Series) -> pd.DataFrame:
        out = []
        for x, first, step in zip(texts_, firsts, steps):
            first, step = np.asarray(first).reshape(-1, 26), np.asarray(step).reshape(-1, 676)
            v, n, lead, prev = np.zeros(len(first)), 0, None, None
            for at in range(0, len(x), BLOCK):
                c = _codes(x[at : at + BLOCK])
                pairs = 26 * np.concatenate([c[:1] if prev is None else [prev], c[:-1]]) + c
                gains = step[:, pairs]
                if prev is None:
                    gains[:, 0] = first[:, c[0]]
                run, prev = np.cumsum(np.concatenate([v[:, None], gains], axis=1), axis=1)[:, 1:], c[-1]
                top = np.sort(run, axis=0)
                leads = top[-1] - top[-2] if len(first) > 1 else np.full(run.shape[1], np.nan)
                hit = np.flatnonzero(leads >= a)
                k = hit[0] if len(hit) else run.shape[1] - 1
                v, n, lead = run[:, k], at + k + 1, leads[k]
                if len(hit):
                    break
            out.append((int(v.argmax()), n, lead))
        return pd.DataFrame(out, columns=["best", "n", "lead"])

    folded = met.withColumn("_r", decide("_x", "first", "step"))
    return folded.select(text_id, F.get("langs", F.col("_r.best")).alias("label"), F.col("_r.n").alias("n_letters"), (F.col("_r.lead") < a).alias("forced"), F.col("_r.lead").alias("margin"))


def split_text(letter_string: Column | str, share: float = 0.8) -> tuple[Column, Column]:
    """(front, rest): the first ``share`` of a text's characters and what follows."""
    s = F.col(letter_string) if isinstance(letter_string, str) else letter_string
    cut = F.floor(F.length(s) * share).cast("int")
    return F.substring(s, F.lit(1), cut), F.substring(s, cut + 1, F.length(s))


def sample_windows(texts: DataFrame, text_id: str, text: str, per_text: int, shortest: int = 20, longest: int = 200, min_letters: int = 5, seed: int = 0) -> DataFrame:
    """(id, draw, start, window): ``per_text`` windows per text, place and length drawn by a hash; those with too few letters go.

    A text shorter than the drawn length gives its whole rest.
    """
    u = lambda tag: F.conv(F.substring(F.md5(F.concat_ws("|", text_id, "draw", F.lit(tag), F.lit(seed))), 1, 8), 16, 10).cast("bigint")
    drawn = texts.select(text_id, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(1), F.lit(per_text))).alias("draw")).where("length(_t) > 0")
    placed = drawn.withColumn("_len", (shortest + u("length") % (longest - shortest + 1)).cast("int")).withColumn("start", (u("start") % F.greatest(F.length("_t") - F.col("_len") + 1, F.lit(1))).cast("int"))
    cut = placed.select(text_id, "draw", "start", F.substring(F.col("_t"), F.col("start") + 1, F.col("_len")).alias("window"))
    return cut.where(F.length(letters("window")) >= min_letters)


def trial_stats(decisions: DataFrame, truth: str, label: str = "label", n_letters: str = "n_letters") -> DataFrame:
    """(truth, trials, errors, error_rate, mean_letters, median_letters)."""
    wrong = F.col(label) != F.col(truth)
    return decisions.groupBy(truth).agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(wrong).alias("errors"), F.avg(wrong.cast("double")).alias("error_rate"), F.avg(n_letters).alias("mean_letters"), F.median(n_letters).alias("median_letters")
    )
