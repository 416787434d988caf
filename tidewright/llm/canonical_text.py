"""One consistent spelling for texts that look alike.

A mapping from look-alike spellings to one canonical spelling is compiled from rules, checked for
conflicts and turned into a longest-match transducer over grapheme clusters. ASCII text passes untouched;
every other cluster is rewritten in the same single pass. Case, accents, words and punctuation are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import checkpointed

# Letters of other scripts that are drawn like Latin letters.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ɡ": "g", "ɑ": "a",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "μ": "µ",
}
# Signs that are drawn like another sign.
SIGNS = {"\u2010": "-", "\u2011": "-", "\u02bc": "\u2019", "\u2126": "\u03a9", "\u212a": "K", "\u212b": "\u00c5", "\u2215": "/", "\u037e": ";"}
# Blanks of any width, characters without a picture, accents that combine with letters.
BLANKS = "\t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe00\ufe01\ufe0e\ufe0f\ufeff"
)
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0323\u0327\u0328"
LIGATURES = "\ufb00\ufb01\ufb02\ufb03\ufb04\u0132\u0133"


def compiled(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The mapping of (source, canonical) pairs; two different targets of one source are a conflict."""
    out: dict[str, str] = {}
    for s, t in pairs:
        if out.setdefault(s, t) != t:
            raise ValueError(f"conflict: {s!r} -> {out[s]!r} and {t!r}")
    return out


def rules() -> dict[str, str]:
    """The whole mapping: source spelling -> canonical spelling."""
    styled = [chr(c) for c in (*range(0x2160, 0x2180), *range(0x1D400, 0x1D6A4), *range(0x1D7CE, 0x1D800))]  # roman numerals, styled letters and digits
    plain = [(c, unicodedata.normalize("NFKC", c)) for c in styled]
    single = compiled((
        *LOOKALIKES.items(), *SIGNS.items(), *((c, " ") for c in BLANKS), *((c, "") for c in INVISIBLE),
        *((chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F)), *((c, unicodedata.normalize("NFKC", c)) for c in LIGATURES),
        *((c, t) for c, t in plain if t != c and t.isascii() and t.isalnum()),
    ))
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    sources: dict[str, list[str]] = {}
    for s, t in [*((c, c) for c in letters), *single.items()]:
        if len(t) == 1 and t.isalpha():
            sources.setdefault(t, []).append(s)
    out = list(single.items())
    for base in letters:
        for mark in MARKS:
            target = unicodedata.normalize("NFC", base + mark)
            for s in sources[base]:
                out.append((s + mark, target))
                whole = unicodedata.normalize("NFC", s + mark)
                if len(whole) == 1 and whole != target:
                    out.append((whole, target))
    return compiled(out)


def check_rules(mapping: dict[str, str]) -> None:
    """Reject a mapping that isn't stable (a target that is itself rewritten) or merges ASCII characters."""
    for s, t in mapping.items():
        for c in t:
            if mapping.get(c, c) != c:
                raise ValueError(f"conflict: {s!r} -> {t!r}, but {c!r} -> {mapping[c]!r}")
        if s.isascii() and s not in BLANKS:
            raise ValueError(f"ASCII source {s!r}")
        if not t and s not in INVISIBLE:
            raise ValueError(f"visible {s!r} is deleted")


class Transducer:
    """Longest match over grapheme clusters: a trie of the mapping, walked once per cluster, invisible signs skipped."""

    def __init__(self, mapping: dict[str, str]) -> None:
        check_rules(mapping)
        self.trie: dict = {}
        for s, t in mapping.items():
            node = self.trie
            for c in s:
                node = node.setdefault(c, {})
            node["out"] = t
        marks, hidden = re.escape(MARKS), re.escape(INVISIBLE)
        self.cluster = re.compile(f"[A-Za-z][{hidden}]*[{marks}][{marks}{hidden}]*|[^\x00-\x7f][{marks}{hidden}]*|\t")
        self.rewrite = lru_cache(100_000)(self._rewrite)

    def _rewrite(self, cluster: str) -> str:
        chars = [c for c in unicodedata.normalize("NFC", "".join(c for c in cluster if c not in INVISIBLE))]
        chars = [d for c in chars for d in ((c,) if c in self.trie else unicodedata.normalize("NFD", c) if len(unicodedata.normalize("NFD", c)) == 2 else (c,))]
        out, k = [], 0
        while k < len(chars):
            node, best, end = self.trie, chars[k], k + 1
            for e in range(k, len(chars)):
                node = node.get(chars[e])
                if node is None:
                    break
                if "out" in node:
                    best, end = node["out"], e + 1
            out.append(best)
            k = end
        return unicodedata.normalize("NFC", "".join(out))

    def __call__(self, text: str) -> str:
        if text.isascii() and "\t" not in text and "  " not in text:
            return text.strip(" ")
        done = self.cluster.sub(lambda m: self.rewrite(m.group()), text)
        return re.sub(" {2,}", " ", done).strip(" ")


@lru_cache(1)
def transducer() -> Transducer:
    """The compiled default transducer, built once per process."""
    return Transducer(rules())


@F.pandas_udf(T.StringType())
def _canonical(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    t = transducer()
    for texts in parts:
        yield texts.map(t, na_action="ignore")


def canonical(text: Column | str) -> Column:
    """The canonical spelling of a text; null stays null, an empty text stays empty.

    Runs of blanks become one blank and blanks at either end go, as their width can't be seen.
    """
    return _canonical(F.col(text) if isinstance(text, str) else text)


def _keyed(df: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """(_id, text_id, class_id), with the canonical text where wanted; kept, so that texts are rewritten once."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_id IS NOT NULL AND _t IS NOT NULL")
    rows = rows.groupBy("_id").agg(F.min("_t").alias("_t")).select("_id", F.xxhash64("_t").alias("text_id"), canonical("_t").alias("canonical"))
    rows = rows.withColumn("class_id", F.sha2("canonical", 256))
    return checkpointed(rows if with_text else rows.drop("canonical"))


def _with_sizes(keyed: DataFrame) -> DataFrame:
    """``keyed`` with the spellings and members of each class and the links (members of another spelling) of each row."""
    same = keyed.groupBy("class_id", "text_id").agg(F.count(F.lit(1)).alias("same"))
    every = Window.partitionBy("class_id")  # one row per spelling of a class
    same = same.withColumn("members", F.sum("same").over(every)).withColumn("spellings", F.col("same") < F.col("members")).withColumn("links", F.col("members") - F.col("same"))
    return keyed.join(same.drop("same"), ["class_id", "text_id"])


def look_alike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per id: (id, canonical text, class_id, text_id, spellings, members, links).

    ``class_id`` is a hash of the canonical text, ``text_id`` of the text as it stands, ``spellings`` tells
    whether the class has more than one spelling, ``links`` how many members are spelled differently. Rows with
    a null id or text are left out; repeated rows of one id count once (the smallest text, if they differ).
    """
    c = _with_sizes(_keyed(df, id_col, text_col, True))
    return c.select(F.col("_id").alias(id_col), "canonical", "class_id", "text_id", "spellings", "members", "links")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str, rows_per_salt: int = 2000) -> DataFrame:
    """Pairs (lo, hi) of ids whose texts look the same but differ in a character.

    Only classes with several spellings are joined; a large class is split into salts of about
    ``rows_per_salt`` rows on one side and repeated per salt on the other, so no task holds it whole.
    """
    c = _with_sizes(_keyed(df, id_col, text_col, False)).where("spellings").select(
        F.col("_id").alias("id"), "class_id", "text_id", F.ceil(F.col("members") / rows_per_salt).cast("int").alias("salts")
    )
    a = c.select("class_id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("lo"), F.col("text_id").alias("t1"))
    b = c.select("class_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("hi"), F.col("text_id").alias("t2"))
    return a.join(b, ["class_id", "salt"]).where("lo < hi AND t1 <> t2").select("lo", "hi")
