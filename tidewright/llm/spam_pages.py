"""Pages stuffed with keywords, links or product tags instead of sentences.

The page's own text (quotes and signatures set aside) gives content and link features. Labelling rules
mark the plain cases as spam or not spam and abstain otherwise; bagged decision trees learn from those
weak labels on a bounded sample and judge every page. Page probabilities are then smoothed with the spam
rate of the page's host, shrunk towards the overall rate for hosts with few pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import checkpointed

# Notations of quotes and signatures.
QUOTE_TAGS = re.compile(r"\[quote\b[^\]]*\]|\[/quote\]|<blockquote\b[^>]*>|</blockquote>", re.I)
QUOTED_LINE = re.compile(r"(?m)^[ \t]*(?:>|&gt;).*(?:\n|$)")
ATTRIBUTION = re.compile(r"(?im)^[^\n]{0,80}\b(?:wrote|a écrit|schreef)[^\n]{0,20}:[ \t]*$")
SIGNATURE = re.compile(r"(?s)\n(?:-- ?\n|_{4,}[ \t]*\n|~ [^\n]{1,60} ~[ \t]*$|\[size=1\]).*\Z")
LINK = re.compile(r"\[url=[^\]]*\].*?\[/url\]|<a\s+href=[^>]*>.*?</a>|https?://\S+|\b[\w.-]+\.[a-z]{3,8}/\S+|\bwww\.\S+", re.I | re.S)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|\[/?[a-zA-Z*]+(?:=[^\]]*)?\]")
HASHTAG = re.compile(r"#\w+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
FEATURES = ("words", "link_share", "links_per_word", "tag_share", "distinct", "repeated_pairs", "top_word", "sentence_share", "sentence_chars", "echo", "top_long", "links", "tags", "digit_share", "separators", "capitals")
MAX_TRAIN_ROWS = 20_000


def own_text(text: str) -> str:
    """The text without quotes (nested ones too), quoted lines, attribution lines and the signature."""
    out, depth, at = [], 0, 0
    for m in QUOTE_TAGS.finditer(text):
        opening = not m.group().startswith(("[/", "</"))
        if depth == 0:
            out.append(text[at : m.start()])
        depth = depth + 1 if opening else max(0, depth - 1)
        at = m.end()
    if depth == 0:
        out.append(text[at:])
    plain = ATTRIBUTION.sub("", QUOTED_LINE.sub("", "\n".join(out)))
    return SIGNATURE.sub("", "\n" + plain).strip()


def measure(text: str) -> tuple[float, ...]:
    """The features of one page's own text, in the order of FEATURES."""
    own = html.unescape(own_text(text))
    size = max(1, len(re.sub(r"\s", "", own)))
    links = LINK.findall(own)
    link_chars = sum(len(re.sub(r"\s", "", x)) for x in links)
    rest = TAG.sub(" ", LINK.sub(" ", own))
    tags = HASHTAG.findall(rest)
    prose = HASHTAG.sub(" ", rest)
    spelled = WORD.findall(prose)
    words = [w.lower() for w in spelled]
    n = len(words)
    pairs = list(zip(words, words[1:]))
    in_sentences = chars = echoing = parts = 0
    for s in re.findall(r"[^.!?\n]+[.!?]*", prose):
        ws = [w.lower() for w in WORD.findall(s)]
        if len(ws) >= 4:
            echo = max((c for w, c in Counter(ws).items() if len(w) > 3), default=0) >= 3
            parts += 1
            echoing += echo
            if s[-1] in ".!?" and not echo:
                in_sentences += len(ws)
                chars += len(re.sub(r"\s", "", s))
    return (
        float(n),
        link_chars / size,
        len(links) / (n + len(links) + 1),
        sum(map(len, tags)) / size,
        len(set(words)) / n if n else 1.0,
        1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
        max(Counter(words).values()) / n if n else 0.0,
        in_sentences / n if n else 0.0,
        chars / size,
        echoing / (parts + 2),
        (max((c for w, c in Counter(words).items() if len(w) > 3), default=1) - 1) / (n + 10),
        float(len(links)),
        float(len(tags)),
        sum(c.isdigit() for c in rest) / size,
        len(re.findall(r"[,;|/•]| - |\n", prose)) / (n + 1),
        sum(w[0].isupper() for w in spelled) / n if n else 0.0,
    )


def weak_label(f: tuple[float, ...]) -> int | None:
    """1 for plain spam, 0 for plain posts, None where the rules don't tell."""
    v = dict(zip(FEATURES, f))
    if v["link_share"] > 0.6 or v["tag_share"] > 0.6:
        return 1
    listed = v["digit_share"] < 0.3 and v["sentence_chars"] < 0.35
    if listed and (v["links"] + v["tags"] >= 4 or v["words"] >= 12 and (v["repeated_pairs"] > 0.4 or v["separators"] > 0.25 and v["distinct"] < 0.7)):
        return 1
    if v["words"] >= 20 and (v["echo"] > 0.5 and v["repeated_pairs"] > 0.2 or v["top_long"] > 0.14):
        return 1
    if v["links"] < 3 and v["tags"] < 4 and (v["words"] < 12 or v["digit_share"] > 0.4):
        return 0
    if v["sentence_chars"] > 0.5 and v["echo"] < 0.4 and v["top_long"] < 0.12:
        return 0
    return None


def spam_pages(
    df: DataFrame, id_col: str, text_col: str, host_col: str, max_train_rows: int = MAX_TRAIN_ROWS, trees: int = 30, depth: int = 8, smoothing: float = 0.3, prior_pages: float = 50.0, seed: int = 11
) -> DataFrame:
    """One row per id: (id, host, page_probability, host_rate, probability, is_spam).

    Trained on at most ``max_train_rows`` weakly labelled rows, drawn evenly by a hash of the id, in equal
    halves where both labels suffice. Null texts and texts without words or links are no spam, a null host has the overall rate,
    rows with a null id are left out and repeated rows count once. If one label is missing altogether,
    the rules alone judge.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(host_col).cast("string").alias("_host")).where("_id IS NOT NULL")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            m = [measure(t) if isinstance(t, str) and t else (0.0,) * len(FEATURES) for t in pdf["_t"]]
            y = [weak_label(f) for f in m]
            out = pd.DataFrame(np.array(m, dtype=float).reshape(-1, len(FEATURES)), columns=list(FEATURES))
            out.insert(0, "_host", pdf["_host"].to_numpy())
            out.insert(0, "_id", pdf["_id"].to_numpy())
            out["label"] = pd.array(y, dtype="Int64")
            yield out

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _host string, {', '.join(f'{f} double' for f in FEATURES)}, label bigint"
    measured = checkpointed(rows.groupBy("_id").agg(F.min(F.struct("_t", "_host")).alias("r")).select("_id", "r._t", "r._host").mapInPandas(run, schema))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(measured)

    order = (F.xxhash64("_id", F.lit(seed)), F.col("_id"))
    sides = [vectors.where(F.col("label") == k).orderBy(*order).limit(max_train_rows // 2) for k in (0, 1)]
    sample = checkpointed(sides[0].unionByName(sides[1]).select("features", F.col("label").cast("double").alias("label")))
    if sample.select("label").distinct().count() == 2:
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", subsamplingRate=1.0, seed=seed, probabilityCol="_p")
        judged = forest.fit(sample).transform(vectors).withColumn("page_probability", vector_to_array("_p")[1])
    else:
        judged = vectors.withColumn("page_probability", F.coalesce(F.col("label").cast("double"), F.lit(0.0)))
    empty = (F.col("words") + F.col("links") + F.col("tags")) == 0
    judged = checkpointed(judged.select("_id", "_host", F.when(empty, 0.0).otherwise(F.col("page_probability")).alias("page_probability")))  # judged once
    overall = judged.agg(F.avg((F.col("page_probability") >= 0.5).cast("double"))).first()[0] or 0.0
    hosted = judged.where("_host IS NOT NULL")  # pages without a host meet no rate, so they don't gather in one task either
    rates = hosted.groupBy("_host").agg(((F.sum((F.col("page_probability") >= 0.5).cast("double")) + prior_pages * overall) / (F.count(F.lit(1)) + prior_pages)).alias("host_rate"))
    logit = lambda p: F.log(p / (1 - p))
    bounded = lambda c: F.least(F.greatest(c, F.lit(1e-3)), F.lit(1 - 1e-3))
    out = hosted.join(rates, "_host").unionByName(judged.where("_host IS NULL").withColumn("host_rate", F.lit(float(overall))))
    shifted = logit(bounded(F.col("page_probability"))) + smoothing * (logit(bounded(F.col("host_rate"))) - logit(bounded(F.lit(float(overall)))))
    out = out.withColumn("probability", 1 / (1 + F.exp(-shifted)))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), "page_probability", "host_rate", "probability", (F.col("probability") >= 0.5).alias("is_spam"))
