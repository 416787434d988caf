"""Language of every document and of every stretch in one language within it.

A linear classifier over averaged embeddings of hashed subwords (words and their character n-grams),
trained by stochastic gradient descent in numpy on sentences of a bounded sample of labelled documents.
Sentences whose label the first model firmly rejects are left out of a second training, so wrong labels
and mixed documents do little harm. Probabilities are calibrated by a temperature on all sentences of held-out
documents, together with the share of labels that are wrong; below a confidence bound set there a sentence
gives no evidence and joins its neighbours.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.canonical_text import transducer

# Spellings of the labels.
LANGUAGES = {
    "english": ("english", "en", "eng", "en-us", "en-gb", "anglais", "engels"),
    "french": ("french", "fr", "fra", "fre", "fr-fr", "français", "francais", "frans"),
    "dutch": ("dutch", "nl", "nld", "dut", "nl-nl", "nederlands", "néerlandais"),
}
ENDS = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ASIDE = re.compile(r"\([^()]*\)")
MIN_LETTERS = 16


@lru_cache(1)
def label_map() -> dict[str, str]:
    return {s: lang for lang, spellings in LANGUAGES.items() for s in spellings}


SUBTAG = re.compile(r"^([^\W\d_]+)[-_ (]")


def named_language(label: object) -> str | None:
    """The language a label names: a code or name in any case, alone or before a region or another addition."""
    if not isinstance(label, str):
        return None
    names, said = label_map(), label.strip().lower()
    m = SUBTAG.match(said)
    return names.get(said) or (names.get(m.group(1)) if m else None)


def named_language_column(label: str) -> Column:
    """``named_language`` as an expression."""
    names = F.create_map(*[F.lit(x) for kv in label_map().items() for x in kv])
    said = F.lower(F.regexp_replace(F.col(label).cast("string"), r"^\s+|\s+$", ""))
    return F.coalesce(F.element_at(names, said), F.element_at(names, F.regexp_extract(said, r"^(\p{L}+)[-_ (]", 1)))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence; closing quotes belong to it, blank ones are left out."""
    out, at = [], 0
    for m in ENDS.finditer(text):
        cut = m.start() + len(m.group()) - len(m.group().lstrip("\"'”’»)]"))
        if text[at:cut].strip():
            out.append((at, cut))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


@lru_cache(200_000)
def word_features(word: str, buckets: int) -> np.ndarray:
    """Hashed ids of a word and of its character 2- to 4-grams."""
    b = f"<{word}>"
    ids = [zlib.crc32(b.encode()) % buckets]
    ids += [zlib.crc32(b[k : k + n].encode()) % buckets for n in (2, 3, 4) for k in range(len(b) - n + 1)]
    return np.asarray(ids, dtype=np.int64)


def features(sentence: str, buckets: int) -> np.ndarray:
    """The ids of all words of a sentence."""
    found = [word_features(w, buckets) for w in TOKEN.findall(sentence.lower())]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class SubwordModel:
    """Averaged embeddings and a linear softmax; ``temperature``, ``floor`` and ``noise`` (share of wrong labels) are the calibration."""

    languages: list[str]
    embed: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.5
    noise: float = 0.0

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return (self.embed[ids].mean(0) @ self.weight + self.bias) if len(ids) else np.zeros(len(self.languages))

    def sentence_logits(self, sentence: str) -> np.ndarray:
        """As ``logits`` of the sentence's features; the sum of each word's embeddings is kept, as words recur."""
        known = self.__dict__.setdefault("_sums", {})
        total, n = np.zeros(self.embed.shape[1]), 0
        for w in TOKEN.findall(sentence.lower()):
            one = known.get(w)
            if one is None:
                ids = word_features(w, len(self.embed))
                one = (self.embed[ids].sum(0, dtype=float), len(ids))
                if len(known) < 200_000:
                    known[w] = one
            total += one[0]
            n += one[1]
        return total / n @ self.weight + self.bias if n else np.zeros(len(self.languages))

    def log_probs(self, sentence: str) -> np.ndarray | None:
        """Calibrated log probabilities, or None where the sentence gives no evidence.

        A phrase in parentheses doesn't decide the language of the sentence around it.
        """
        around = ASIDE.sub(" ", sentence)
        if sum(c.isalpha() for c in around) >= MIN_LETTERS:
            sentence = around
        if sum(c.isalpha() for c in sentence) < MIN_LETTERS:
            return None
        z = self.sentence_logits(sentence) / self.temperature
        z = z - z.max()
        lp = z - math.log(np.exp(z).sum())
        return None if math.exp(lp.max()) < self.floor else np.maximum(lp, math.log(1e-6))


def train(data: list[tuple[np.ndarray, int]], languages: list[str], buckets: int, dim: int, epochs: int, seed: int) -> SubwordModel:
    """Plain SGD with a linearly falling rate over averaged embeddings."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    weight, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = max(1, epochs * len(data)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            ids, y = data[k]
            rate = 0.4 * (1 - done / steps)
            done += 1
            h = embed[ids].mean(0)
            z = h @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weight @ p
            weight -= rate * np.outer(h, p)
            bias -= rate * p
            np.add.at(embed, ids, -rate * back / len(ids))
    return SubwordModel(languages, embed, weight, bias)


def calibrate(model: SubwordModel, held: list[tuple[np.ndarray, int]], error: float = 0.02) -> None:
    """Temperature and share of wrong labels of the least log loss, then the lowest confidence bound within ``error``.

    The labels of held-out sentences are wrong at times, as those of the others; a label that is wrong names any
    language. The error rate above a bound is what exceeds the share of such labels. If no bound keeps within
    ``error``, sentences give evidence only at the highest one.
    """
    if not held:
        return
    z = np.array([model.logits(i) for i, _ in held], dtype=float)
    y = np.array([t for _, t in held])

    def scaled(t: float) -> np.ndarray:
        a = np.exp(z / t - (z / t).max(1, keepdims=True))
        return a / a.sum(1, keepdims=True)

    def loss(t: float, noise: float) -> float:
        return float(-np.log((1 - noise) * scaled(t)[np.arange(len(y)), y] + noise / z.shape[1] + 1e-12).mean())

    grid = [(t, e) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0) for e in (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3)]
    model.temperature, model.noise = min(grid, key=lambda g: loss(*g))
    p = scaled(model.temperature)
    top, right = p.max(1), p.argmax(1) == y
    floor = 0.95
    for bound in np.arange(0.4, 0.96, 0.05):
        kept = top >= bound
        if kept.any() and 1 - right[kept].mean() - model.noise * (1 - 1 / z.shape[1]) <= error:
            floor = bound
            break
    model.floor = float(floor)


def fit(
    df: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = 4000, max_chars: int = 20_000, buckets: int = 1 << 14, dim: int = 12, steps: tuple[int, int] = (25_000, 60_000), seed: int = 5
) -> SubwordModel:
    """Train on at most ``max_rows`` labelled rows of at most ``max_chars`` characters, drawn evenly by a hash of the id (a bounded sample), in between ``steps[0]`` and ``steps[1]`` steps.

    Every fifth row of the sample is held out whole.
    """
    labelled = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), named_language_column(label_col).alias("_y"))
    labelled = labelled.where(F.col("_y").isNotNull() & F.col("_t").isNotNull() & (F.length("_t") <= max_chars))
    sample = labelled.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(max_rows).collect()
    languages, clean = sorted(LANGUAGES), transducer()
    rest, held = [], []
    for k, r in enumerate(sample):
        text = clean(r["_t"])
        for a, b in sentences(text):
            if sum(c.isalpha() for c in text[a:b]) >= MIN_LETTERS:
                (rest if k % 5 else held).append((features(text[a:b], buckets), languages.index(r["_y"])))
    if not rest:
        return SubwordModel(languages, np.zeros((buckets, dim), np.float32), np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32), floor=1.1)
    # ten rounds over the sentences, within bounds: a small sample needs more of them, a large one fewer
    epochs = lambda n: max(1, math.ceil(min(max(10 * n, steps[0]), steps[1]) / max(1, n)))
    first = train(rest, languages, buckets, dim, max(1, epochs(len(rest)) // 3), seed)
    calibrate(first, held)
    agrees = lambda d: np.argmax(z := first.logits(d[0])) == d[1] or z.max() - z[d[1]] < 2 * first.temperature
    kept = [d for d in rest if agrees(d)]
    model = train(kept, languages, buckets, dim, epochs(len(kept)), seed)
    calibrate(model, held)
    return model


def segment(text: str, model: SubwordModel, switch: float = 1.0) -> list[tuple[int, int, str | None, float]]:
    """Stretches (start, end, language, confidence): the most likely languages of the sentences, a change costing ``switch``.

    Sentences without evidence take the language of their neighbours. A text without any evidence is one
    stretch with language None and confidence 0.
    """
    spans = sentences(text)
    if not spans:
        return []
    scores = [model.log_probs(text[a:b]) for a, b in spans]
    n = len(model.languages)
    if all(s is None for s in scores):
        return [(spans[0][0], spans[-1][1], None, 0.0)]
    best, back = np.zeros(n), []
    for s in scores:
        stay_or_go = best.max() - switch > best
        back.append(np.where(stay_or_go, best.argmax(), np.arange(n)))
        best = np.where(stay_or_go, best.max() - switch, best) + (0 if s is None else s)
    k = int(best.argmax())
    path = [k]
    for b in back[:0:-1]:
        k = int(b[k])
        path.append(k)
    path.reverse()
    out: list[list] = []
    for (a, b), s, k in zip(spans, scores, path):
        size, p = (b - a, math.exp(s[k])) if s is not None else (0, 0.0)
        if out and out[-1][2] == k:
            out[-1][1] = b
            out[-1][3] += size * p
            out[-1][4] += size
        else:
            out.append([a, b, k, size * p, size])
    return [(a, b, model.languages[k], w / n if n else 0.0) for a, b, k, w, n in out]


def language_segments(df: DataFrame, id_col: str, text_col: str, label_col: str, model: SubwordModel | None = None) -> DataFrame:
    """Rows (id, seg, lang, confidence, start, end, segments, label, label_ok), one per stretch in one language.

    ``label`` is the language the label names, null if it names none; ``label_ok`` whether the document is
    in that one language. start and end are positions in the canonical spelling of the text. Null and
    blank texts give no row, texts without evidence one row with a null language; repeated rows of an id
    count once.
    """
    model = model or fit(df, id_col, text_col, label_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean, m = transducer(), shared.value
        for pdf in parts:
            rows = []
            for _id, text, label in zip(pdf["_id"], pdf["_t"], pdf["_y"]):
                said = named_language(label)
                found = segment(clean(text), m)
                for k, (a, b, lang, p) in enumerate(found):
                    rows.append((_id, k, lang, p, a, b, len(found), said, len(found) == 1 and lang is not None and said == lang))
            yield pd.DataFrame(rows, columns=["_id", "seg", "lang", "confidence", "start", "end", "segments", "label", "label_ok"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(label_col).cast("string").alias("_y")).where("_id IS NOT NULL AND _t IS NOT NULL")
    rows = rows.groupBy("_id").agg(F.min(F.struct("_t", "_y")).alias("_r")).select("_id", "_r._t", "_r._y")
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, seg int, lang string, confidence double, start int, end int, segments int, label string, label_ok boolean"
    return rows.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
