"""Evaluation items whose passages appear in a training corpus.

Q-gram lemma filter: an item and a document are compared as strings of plain words. A passage with few
changed words keeps most of its character q-grams, and keeps them on near diagonals. A diagonal is the
number of the word a q-gram begins in, in the document minus in the item: a changed word doesn't move
it whatever its length, an added or left out one moves it by one, so a passage with e edits spreads over e + 1
diagonals at most. Shared q-grams are counted in overlapping bands of diagonals; only regions with as
many as the edit budget must leave are kept and verified by a banded alignment of their words.

While the items' q-grams are few enough to be held by every task (a checked bound) a task meets its
documents with all of them, so no q-gram is shuffled. Beyond the bound q-grams are joined and counted by
Spark, after a broadcast bitmap of fixed size has dropped those that no item has.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import checkpointed

Q = 9
BROADCAST_ROWS = 2_000_000
BITMAP_BITS = 1 << 27
CHUNK_CHARS, PIECE_WORDS = 400_000, 50_000
# Markup of forum posts.
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|\[/?[a-zA-Z*]+(?:=[^\]]*)?\]")
PREFIX = re.compile(r"(?m)^[ \t]*(?:(?:>|\|)[ \t]*)+")
WORD = re.compile(r"[^\W_]+")


def plain_words(text: str) -> list[str]:
    """Lower-case words of a text without markup, entities and quote signs."""
    if "&" in text:
        text = html.unescape(text)
    text = PREFIX.sub("", text)
    text = TAG.sub(lambda m: "" if m.group().lower().strip("</[]>").split("=")[0].split(" ")[0] in INLINE else " ", text)
    return WORD.findall(text.lower())


# Tags that may stand inside a word.
INLINE = frozenset(("b", "i", "u", "s", "em", "strong", "span", "color", "size", "font", "sub", "sup", "wbr"))


def least_passage(n: int, share: float) -> int:
    return max(1, math.ceil(n * share))


def least_shared(words: list[str], share: float, edits: int) -> int:
    """How many q-grams any passage of the item keeps at least after ``edits`` changed words: the q-gram lemma by words.

    A passage of L characters has L - q + 1 q-grams; an edited word of w characters takes at most w + q + 1 of
    them, the last one at most w. 0 where the lemma promises none.
    """
    m = least_passage(len(words), share)
    least = None
    for k in range(len(words) - m + 1):
        part = words[k : k + m]
        lost = sum(heapq.nlargest(edits, [*(len(w) + Q + 1 for w in part[1:-1]), len(part[-1])]))
        kept = sum(map(len, part)) + m - 1 - Q + 1 - lost
        least = kept if least is None else min(least, kept)
    return max(0, least or 0)


def longest_passage(item: list[str], doc: list[str], edits: int) -> int:
    """Most item words covered by one passage of the document with at most ``edits`` words changed, added or left out.

    The ends of the passage are words as they stand in the item. Banded: a furthest-reaching alignment is
    followed from every seed (two equal words in a row, or one where a passage starts) along its diagonal
    and those beside it.
    """
    places: dict[str, list[int]] = {}
    for j, w in enumerate(doc):
        places.setdefault(w, []).append(j)
    best = 0
    for i0, w in enumerate(item):
        if len(item) - i0 <= best:
            break
        for j0 in places.get(w, ()):
            if i0 and j0 and item[i0 - 1] == doc[j0 - 1]:
                continue  # part of a run that began earlier
            # reach[d] = furthest item position on diagonal d (document minus item) with e edits
            reach = {j0 - i0: i0}
            for e in range(edits + 1):
                for d in list(reach):
                    i = reach[d]
                    j = i + d
                    while i < len(item) and j < len(doc) and item[i] == doc[j]:
                        i += 1
                        j += 1
                    if i > reach[d]:
                        best = max(best, i - i0)
                    reach[d] = i
                if e < edits:
                    new: dict[int, int] = {}
                    for d, i in reach.items():
                        for d2, i2 in ((d, i + 1), (d + 1, i), (d - 1, i + 1)):
                            if i2 <= len(item) and 0 <= i2 + d2 <= len(doc):
                                new[d2] = max(new.get(d2, -1), i2)
                    reach = new
    return best


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every stretch of q characters."""
    n = max(0, len(codes) - Q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _grams(texts: list[list[str]], whole_words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word, place) of the q-grams of every text; words are numbered through all texts.

    With ``whole_words`` each word gives one more hash of its own, with place -1 - word.
    """
    codes = np.frombuffer("\n".join(" ".join(t) for t in texts).encode("utf-32-le"), dtype=np.uint32)
    h = _hashes(codes.astype(np.uint64))
    cut = np.concatenate([[0], np.cumsum(codes == 10)])
    at = np.flatnonzero(cut[Q : Q + len(h)] == cut[: len(h)])
    word = np.cumsum((codes == 32) | (codes == 10))
    out = [h[at], cut[at], word[at], at]
    if whole_words:
        own = [xxhash.xxh64_intdigest(w) for t in texts for w in t]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        which = np.repeat(np.arange(len(texts)), sizes)
        # a text without words still takes one word's number between the separators
        number = np.arange(len(own)) + np.repeat(np.cumsum(sizes == 0) - (sizes == 0), sizes)
        extra = [np.array(own, dtype=np.uint64).view(np.int64), which, number, -1 - number]
        out = [np.concatenate([a, b]) for a, b in zip(out, extra)]
    return tuple(out)


@dataclass
class Items:
    """All items with their q-grams sorted by hash; ``need`` is what a passage keeps, ``span`` the words the widest one takes in a document."""

    ids: list
    words: list[list[str]]
    need: np.ndarray
    short: bool
    span: int
    grams: np.ndarray
    item: np.ndarray
    word: np.ndarray
    place: np.ndarray


def _index(ids: list, words: list[list[str]], share: float, edits: int) -> Items:
    """Items whose passages may keep no q-gram are indexed by their whole words too (a passage begins with a word as it stands)."""
    need = np.array([least_shared(w, share, edits) for w in words], dtype=np.int64)
    g, item, word, place = _grams(words, bool((need < 1).any())) if words else (np.zeros(0, np.int64),) * 4
    keep = (need[item] >= 1) == (place >= 0)
    g, item, word, place = g[keep], item[keep], word[keep], place[keep]
    first = np.cumsum([0, *(max(1, len(w)) for w in words)])
    order = np.argsort(g, kind="stable")
    span = max((least_passage(len(w), share) + edits for w in words), default=0)
    return Items(ids, words, np.maximum(need, 1), bool((need < 1).any()), span, g[order], item[order], (word - first[item])[order], place[order])


def _dense(word: np.ndarray, least: int, span: int) -> np.ndarray:
    """Which of the places, sorted by word, lie in some stretch of ``span`` words with at least ``least`` of them."""
    n = np.searchsorted(word, word + span, side="left") - np.arange(len(word))
    ends = np.zeros(len(word) + 1, np.int64)
    full = np.flatnonzero(n >= least)
    np.add.at(ends, full, 1)
    np.add.at(ends, full + n[full], -1)
    return np.cumsum(ends[:-1]) > 0


def _chunks(parts: Iterator[pd.DataFrame], overlap: int) -> Iterator[tuple[list, list[int], list[list[str]]]]:
    """(ids, first words, words) of texts, about CHUNK_CHARS characters at a time.

    A long text comes in pieces that share ``overlap`` words, as many as the widest passage may take.
    """
    for pdf in parts:
        ids, starts, texts, size = [], [], [], 0
        for _id, text in zip(pdf["_doc"], pdf["_dt"]):
            words = plain_words(text)
            for at in range(0, max(1, len(words) - overlap), PIECE_WORDS):
                ids.append(_id)
                starts.append(at)
                texts.append(words[at : at + PIECE_WORDS + overlap])
                size += sum(map(len, texts[-1]))
                if size >= CHUNK_CHARS:
                    yield ids, starts, texts
                    ids, starts, texts, size = [], [], [], 0
        if ids:
            yield ids, starts, texts


def _known(g: np.ndarray, place: np.ndarray, word: np.ndarray, known: np.ndarray, least: int, span: int) -> np.ndarray:
    """Places of q-grams that are ``known`` and dense enough for a passage, and of known whole words."""
    grams = np.flatnonzero(known & (place >= 0))
    return np.concatenate([grams[_dense(word[grams], least, span)], np.flatnonzero(known & (place < 0))])


def _regions(texts: list[list[str]], index: Items, edits: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, from word, to word) of the diagonal bands with as many shared q-grams as the item needs."""
    if not len(index.grams):
        return
    g, text, word, place = _grams(texts, index.short)
    lo = np.searchsorted(index.grams, g)
    known = index.grams[np.minimum(lo, len(index.grams) - 1)] == g
    least = int(index.need[np.unique(index.item[index.place >= 0])].min(initial=1 << 30))
    rows = _known(g, place, word, known, least, index.span)
    lo, hi = lo[rows], np.searchsorted(index.grams, g[rows], side="right")
    n = hi - lo
    hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    rows = np.repeat(rows, n)
    item, step = index.item[hit], max(1, edits)
    first = np.cumsum([0, *(max(1, len(t)) for t in texts)])
    band = (word[rows] - first[text[rows]] - index.word[hit]) // step
    low, many = band.min(initial=0) - 1, len(index.words)
    width = band.max(initial=0) - low + 1
    bands = np.concatenate([band, band - 1]) - low
    region, inverse = np.unique((np.tile(text[rows], 2) * many + np.tile(item, 2)) * width + bands, return_inverse=True)
    places = np.tile(index.place[hit], 2)
    shift = places.min(initial=0)
    reach = places.max(initial=0) - shift + 1
    kept = np.bincount(np.unique(inverse * reach + (places - shift)) // reach, minlength=len(region))
    pair, which = region // width, region % width + low
    for k in np.flatnonzero(kept >= index.need[pair % many]):
        t, i = int(pair[k] // many), int(pair[k] % many)
        yield t, i, max(0, int(which[k]) * step), int(which[k] + 2) * step + len(index.words[i])


def _find(parts: Iterator[pd.DataFrame], index: Items, share: float, edits: int) -> Iterator[pd.DataFrame]:
    overlap = max(map(len, index.words), default=0) + edits
    for ids, _, texts in _chunks(parts, overlap):
        best: dict[tuple[int, int], int] = {}
        for t, i, a, b in _regions(texts, index, edits):
            got = longest_passage(index.words[i], texts[t][a:b], edits)
            if got >= least_passage(len(index.words[i]), share):
                best[t, i] = max(best.get((t, i), 0), got)
        out = [(ids[t], index.ids[i], got, len(index.words[i])) for (t, i), got in best.items()]
        yield pd.DataFrame(out, columns=["_doc", "_item", "words", "item_words"])


def _item_grams(parts: Iterator[pd.DataFrame], share: float, edits: int) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        x = _index(list(pdf["_item"]), [plain_words(t) for t in pdf["_it"]], share, edits)
        out = pd.DataFrame({"g": x.grams, "_item": pd.Series(x.ids, dtype=pdf["_item"].dtype).to_numpy()[x.item], "iw": x.word, "at": x.place, "need": x.need[x.item]})
        yield out.assign(span=x.span)


def _doc_grams(parts: Iterator[pd.DataFrame], bits: np.ndarray, least: int, span: int, short: bool) -> Iterator[pd.DataFrame]:
    """Rows (doc, q-gram, word) of the q-grams in the bitmap that are dense enough for a passage, and of whole words in it."""
    for ids, starts, texts in _chunks(parts, span):
        g, text, word, place = _grams(texts, short)
        x = g & (BITMAP_BITS - 1)
        rows = _known(g, place, word, (bits[x >> 3] >> (x & 7)) & 1 == 1, least, span)
        first = np.cumsum([0, *(max(1, len(t)) for t in texts)])[:-1] - np.array(starts)
        yield pd.DataFrame({"_doc": pd.Series(ids).to_numpy()[text[rows]], "g": g[rows], "dw": word[rows] - first[text[rows]]})


def _joined_pairs(d: DataFrame, grams: DataFrame, edits: int, doc_type: str) -> DataFrame:
    """(doc, item) pairs with a region that has as many shared q-grams as the item needs, by a shuffled join."""
    ends = grams.agg(F.min(F.when(F.col("at") >= 0, F.col("need"))).alias("least"), F.max("span").alias("span"), F.min("at").alias("low")).first()
    x = F.col("g").bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1  # bit 0 of bitmap 1 stands for 1
    pieces = grams.groupBy(F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("m")).collect()  # at most BITMAP_BITS / 8 bytes
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in pieces:
        part = np.frombuffer(r["m"], np.uint8)
        bits[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
    held = d.sparkSession.sparkContext.broadcast(bits)
    least, span, short = ends["least"] or 1 << 30, ends["span"] or 0, (ends["low"] or 0) < 0
    found = d.mapInPandas(lambda p: _doc_grams(p, held.value, least, span, short), f"_doc {doc_type}, g bigint, dw bigint")
    band = F.floor((F.col("dw") - F.col("iw")) / max(1, edits))
    shared = found.join(grams, "g").select("_doc", "_item", "need", "at", F.explode(F.array(band, band - 1)).alias("band"))
    regions = shared.groupBy("_doc", "_item", "band").agg(F.count_distinct("at").alias("kept"), F.any_value("need").alias("need"))
    return regions.where("kept >= need").select("_doc", "_item").distinct()


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, share: float = 0.5, edits: int = 2
) -> DataFrame:
    """Rows (doc_id, item_id, words, item_words): documents with a passage of at least ``share`` of an item's words.

    At most ``edits`` words of the passage may be changed (whatever their length), added or left out.
    ``words`` is the length of the longest such passage. Case, punctuation, blanks, line breaks, quote signs and
    markup don't matter. Null ids or texts and texts without words take no part. Rows of one doc id are
    one document (the longest passage of any); of the rows of one item id the smallest text counts. Very
    short items, whose passages may keep no q-gram, are sought by their words. The items are held by every
    task while they have at most BROADCAST_ROWS q-grams, and joined by shuffle beyond that; the result is the same.
    """
    if not 0 < share <= 1 or edits < 0:
        raise ValueError("share must lie in (0, 1], edits must not be negative")
    it = items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_it")).where("_item IS NOT NULL AND _it IS NOT NULL").groupBy("_item").agg(F.min("_it").alias("_it"))
    d = docs.select(F.col(doc_id).alias("_doc"), F.col(doc_text).alias("_dt")).where("_doc IS NOT NULL AND _dt IS NOT NULL")
    kinds = {c: t for c, t in (*it.dtypes, *d.dtypes)}
    schema = f"_doc {kinds['_doc']}, _item {kinds['_item']}, words int, item_words int"
    chars = it.agg(F.sum(F.length("_it")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if (chars["n"] or 0) + chars["rows"] <= BROADCAST_ROWS:  # a text has fewer q-grams and words than characters
        rows = [(r["_item"], plain_words(r["_it"])) for r in it.collect()]
        rows = sorted((r for r in rows if r[1]), key=lambda r: str(r[0]))
        held = docs.sparkSession.sparkContext.broadcast(_index([r[0] for r in rows], [r[1] for r in rows], share, edits))
        found = d.mapInPandas(lambda p: _find(p, held.value, share, edits), schema)
    else:
        grams = checkpointed(it.mapInPandas(lambda p: _item_grams(p, share, edits), f"g bigint, _item {kinds['_item']}, iw int, at int, need int, span int"))
        pairs = checkpointed(_joined_pairs(d, grams, edits, kinds["_doc"]))
        texts = d.join(pairs.select("_doc").distinct(), "_doc", "left_semi")
        rows = texts.join(pairs, "_doc").join(it, "_item")

        def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                out = []
                for _doc, _item, dt, text in zip(pdf["_doc"], pdf["_item"], pdf["_dt"], pdf["_it"]):
                    words = plain_words(text)
                    got = longest_passage(words, plain_words(dt), edits)
                    if got >= least_passage(len(words), share):
                        out.append((_doc, _item, got, len(words)))
                yield pd.DataFrame(out, columns=["_doc", "_item", "words", "item_words"])

        found = rows.mapInPandas(verify, schema)
    found = found.groupBy("_doc", "_item").agg(F.max("words").alias("words"), F.max("item_words").alias("item_words"))
    return found.withColumnRenamed("_doc", doc_id).withColumnRenamed("_item", item_id)
