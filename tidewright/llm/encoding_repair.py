"""Finding and restoring text that was decoded with the wrong character encoding.

Noisy channel: every word with a character outside ASCII gets a lattice of the byte sequences that could
lie behind it, one per damage channel (how the bytes were misread), with a wildcard for bytes that were
lost: any byte the code page has no character for, so long as it completes a UTF-8 character with the bytes
that survived. Paths are scored by corpus word frequencies with a character model behind them for unseen words.
A Viterbi pass over the words of a text picks the channel at each word; entering damage costs, so a
channel needs evidence, and staying in it is cheap. The frequencies are counted over all texts.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import checkpointed

# The code pages that bytes are commonly misread in; the last resort of cp1252 is latin-1.
PAGES = ("cp1252", "iso8859-15", "mac-roman", "cp850", "cp437")
LOST = "�"
BREAKS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
MARKS = frozenset("«»“”‘’–—…€£§°±½×µ№·")
ENTER, LEAVE, STAY = -5.0, -2.0, -0.05
KAPPA, NEVER = 0.5, -60.0
DEPTH, READINGS = 3, 200


@lru_cache(None)
def _byte_of(ch: str, page: str) -> int | None:
    """The byte that reads as ``ch`` on a code page; cp1252 falls back to latin-1 where it has no character."""
    try:
        return ch.encode(page)[0]
    except UnicodeEncodeError:
        return ord(ch) if page == "cp1252" and ord(ch) < 256 else None


@lru_cache(None)
def _latin(b: int) -> str:
    try:
        return bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(b)


def _as_utf8(word: str, page: str) -> str:
    """The word with every run whose bytes on ``page`` are one UTF-8 character replaced by that character."""
    out, k = [], 0
    while k < len(word):
        first = None if word[k].isascii() else _byte_of(word[k], page)
        size = 0 if first is None else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
        if size:
            run = [_byte_of(c, page) for c in word[k : k + size] if not c.isascii()]
            if len(run) == size and None not in run:
                try:
                    out.append(bytes(run).decode("utf-8"))
                    k += size
                    continue
                except UnicodeDecodeError:
                    pass
        out.append(word[k])
        k += 1
    return "".join(out)


@lru_cache(None)
def _unread(page: str) -> tuple[int, ...]:
    """The bytes beyond ASCII that a code page has no character for, which reading it so loses."""
    out = []
    for b in range(0x80, 0x100):
        try:
            bytes([b]).decode(page)
        except UnicodeDecodeError:
            out.append(b)
    return tuple(out)


def _as_utf8_with_lost(word: str, page: str) -> list[list[str]]:
    """Steps through the byte lattice of a word with lost bytes: what may stand at each place, in order.

    A lost sign is a wildcard for the bytes the page can't read; a step is an ordinary character or every UTF-8
    character that a run of bytes and wildcards can be. Empty if some lost sign is in no such run.
    """
    out: list[list[str]] = []
    wild = _unread(page)
    k = 0
    while k < len(word):
        c = word[k]
        first = () if c.isascii() else wild if c == LOST else tuple(b for b in (_byte_of(c, page),) if b is not None)
        found: list[str] = []
        for size in (4, 3, 2):
            run = word[k : k + size]
            if len(run) < size or LOST not in run or any(x.isascii() for x in run):
                continue
            lead = range(0xC2, 0xE0) if size == 2 else range(0xE0, 0xF0) if size == 3 else range(0xF0, 0xF5)
            rest = [wild if x == LOST else tuple(b for b in (_byte_of(x, page),) if b is not None) for x in run[1:]]
            for bytes_ in itertools.product([b for b in first if b in lead], *[[b for b in r if 0x80 <= b < 0xC0] for r in rest]):
                try:
                    found.append(bytes(bytes_).decode("utf-8"))
                except UnicodeDecodeError:
                    pass
            if found:
                out.append(found)
                k += size
                break
        if found:
            continue
        if c == LOST:
            return []
        out.append([c])
        k += 1
    return out


def _as_latin(word: str, page: str) -> str | None:
    """The word with every character read on ``page`` replaced by what its byte is in a Western code page."""
    out = []
    for c in word:
        b = ord(c) if c.isascii() else _byte_of(c, page)
        d = c if c.isascii() else None if b is None else _latin(b)
        if d is None or not (d.isascii() or d.isalpha() or d in MARKS):
            return None
        out.append(d)
    return "".join(out)


def lattice(word: str, chars: dict[str, float] | None = None) -> list[tuple[str, str]]:
    """(channel, what was written) for each channel under which the word is damaged; several readings where bytes were lost.

    Readings beyond READINGS are left to the characters' frequencies ``chars``: the likeliest at each place.
    """
    out: list[tuple[str, str]] = []
    for page in PAGES:
        if LOST in word:
            steps = _as_utf8_with_lost(word, page)
            if steps and math.prod(map(len, steps)) > READINGS:
                steps = [[max(s, key=lambda x: (chars or {}).get(x, 0.0))] for s in steps]
            # what stands beside the lost bytes may be damaged too
            out += sorted({(f"utf8>{page}", _as_utf8("".join(r), page)) for r in itertools.product(*steps)}) if steps else []
            continue
        seen = word
        for depth in range(1, DEPTH + 1):
            was = _as_utf8(seen, page)
            if was == seen:
                break
            seen = was
            out.append((f"utf8>{page}" + (f" x{depth}" if depth > 1 else ""), seen))
        if page in ("mac-roman", "cp850", "cp437"):
            was = _as_latin(word, page)
            if was and was != word and not was.isascii() and any(c.isalpha() for c in was):  # a lone sign is no evidence
                out.append((f"latin>{page}", was))
    return out


def fold(word: str) -> str:
    return word.lower() if len(word) > 1 and word.isupper() else word


def _candidates(parts: Iterator[pd.DataFrame], chars: dict[str, float]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for w, n in zip(pdf["word"], pdf["n"]):
            rows.append((w, n, "", fold(w), w))
            rows += [(w, n, ch, fold(x), x) for ch, x in lattice(w, chars)]
        yield pd.DataFrame(rows, columns=["word", "n", "channel", "form", "written"])


def _score(parts: Iterator[pd.DataFrame], chars: dict[str, float], total: float) -> Iterator[pd.DataFrame]:
    """Per word: the log score of leaving it as it stands, and of each channel's reading of it."""

    def model(x: str) -> float:
        p = KAPPA
        for c in x:
            if not c.isascii():
                p *= chars.get(c, 0.0) + 1e-9
        return max(p, 1e-300)

    for pdf in parts:
        rows = []
        for w, options in zip(pdf["word"], pdf["options"]):
            own, reads = 0.0, []
            for o in options:
                if o["channel"] == "":
                    own = float(o["freq"])
                else:
                    reads.append((o["channel"], o["written"], float(o["freq"])))
            if not reads and LOST not in w and not any("\x80" <= c <= "\x9f" for c in w):
                continue
            plain = model(w)
            if LOST in w or any("\x80" <= c <= "\x9f" for c in w):
                clean = NEVER
            else:
                best = max(model(x) for _, x, _ in reads)
                known = max(f for _, _, f in reads)
                kept = own * min(1.0, plain / best) if known <= own else 0.0
                clean = math.log((plain + kept) / total)
            best_of: dict[str, tuple[str, str, float]] = {}
            for c, x, f in reads:  # the likeliest reading of each channel
                one = (c, x, math.log((model(x) + f) / total))
                best_of[c] = max(best_of.get(c, one), one, key=lambda o: (o[2], o[1]))
            scored = list(best_of.values())
            if LOST in w and not scored:
                scored = [("lost", w, math.log(1e-9 / total))]
            if not scored:
                scored = [("unknown", w, math.log(1e-9 / total))]
            scored = [s for s in scored if s[2] > clean - 1.0]
            if scored:
                rows.append((w, clean, [{"channel": c, "written": x, "score": s} for c, x, s in scored]))
        yield pd.DataFrame(rows, columns=["word", "clean", "reads"])


def best_path(steps: list[tuple[float, dict[str, tuple[str, float]]]]) -> list[str]:
    """Viterbi over words: the channel at each, '' where the word stands. steps: (clean score, channel -> (reading, score))."""
    states = [""] + sorted({c for _, reads in steps for c in reads})
    score = {s: (0.0 if s == "" else ENTER) for s in states}
    back: list[dict[str, str]] = []
    for clean, reads in steps:
        top = max(score, key=lambda s: (score[s], s))
        new, frm = {}, {}
        for s in states:
            emit = clean if s == "" else reads[s][1] if s in reads else None
            if emit is None:
                continue
            opts = [(score[s] + (0.0 if s == "" else STAY), s)] if s in score else []
            opts.append((score[top] + (LEAVE if s == "" else ENTER), top))
            if "" in score and s != "":
                opts.append((score[""] + ENTER, ""))
            v, p = max(opts)
            new[s], frm[s] = v + emit, p
        back.append(frm)
        score = new
    s = max(score, key=lambda k: (score[k], k == ""))
    path = [s]
    for frm in reversed(back[1:]):
        s = frm[s]
        path.append(s)
    return path[::-1]


def _restore(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for _id, text, hints in zip(pdf["_id"], pdf["_t"], pdf["hints"]):
            if hints is None or len(hints) == 0:
                rows.append((_id, text, text, False, 0, 0, None))
                continue
            known = {h["word"]: (h["clean"], {r["channel"]: (r["written"], r["score"]) for r in h["reads"]}) for h in hints}
            found = [m for m in WORD.finditer(text) if m.group() in known]
            path = best_path([known[m.group()] for m in found])
            out, at, damaged, lost, channels = [], 0, 0, 0, set()
            for m, c in zip(found, path):
                if c:
                    new = known[m.group()][1][c][0]
                    out += [text[at : m.start()], new]
                    at = m.end()
                    damaged += 1
                    lost += LOST in new or new == m.group()
                    channels.add(c)
            out.append(text[at:])
            rows.append((_id, text, "".join(out), damaged > 0, damaged, int(lost), ", ".join(sorted(channels)) or None))
        yield pd.DataFrame(rows, columns=["_id", "_t", "restored", "damaged", "damaged_words", "lost_words", "channels"])


def repair_encoding(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per id: (id, text, restored, damaged, damaged_words, lost_words, channels).

    ``restored`` is the text with its damaged words restored; words whose bytes are gone beyond any
    reading stay as they are and count in ``lost_words``. Rows with a null id or text are left out, empty
    texts come out undamaged, repeated rows of an id count once (the smallest text, if they differ).
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_id IS NOT NULL AND _t IS NOT NULL")
    id_type = rows.schema["_id"].dataType.simpleString()
    rows = checkpointed(rows.groupBy("_id").agg(F.min("_t").alias("_t")))
    words = checkpointed(rows.select(F.explode(F.split("_t", BREAKS)).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    upper = (F.length("word") > 1) & (F.upper("word") == F.col("word")) & (F.lower("word") != F.col("word"))
    forms = words.groupBy(F.when(upper, F.lower("word")).otherwise(F.col("word")).alias("form")).agg(F.sum("n").alias("freq"))
    odd = words.where(F.col("word").rlike(r"[^\x00-\x7f]"))

    # at most one entry per Unicode character
    chars = odd.select(F.explode(F.split(F.regexp_replace("word", r"[\x00-\x7f]", ""), "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    counted = {r["c"]: r["n"] for r in chars.collect()}
    every = sum(counted.values()) or 1
    model = {c: n / every for c, n in counted.items()}
    total = float(words.agg(F.sum("n")).first()[0] or 1)

    read = odd.mapInPandas(lambda it: _candidates(it, model), "word string, n bigint, channel string, form string, written string")
    scored = read.join(forms, "form", "left").select("word", "channel", "written", F.coalesce("freq", F.lit(0)).alias("freq"))

    # wildcards: a run of lost bytes stands for one or more characters outside ASCII
    mask = lambda c: F.regexp_replace(c, r"[^\x00-\x7f]+", LOST)
    run = r"[^\x00-\x7f]+"
    holes = odd.where(F.contains("word", F.lit(LOST))).select("word", F.when(upper, F.lower("word")).otherwise(F.col("word")).alias("low")).select("word", mask("low").alias("mask")).where(F.col("mask") != LOST)  # a word without any ASCII tells nothing
    whole = forms.where(F.col("form").rlike(r"[^\x00-\x7f]") & ~F.contains("form", F.lit(LOST))).select("form", "freq", mask("form").alias("mask"))
    sizes = lambda c: F.transform(F.regexp_extract_all(c, F.lit(run), F.lit(0)), lambda x: F.length(x))
    fits = F.forall(F.zip_with(sizes("word"), sizes("form"), lambda k, j: (j <= k) & (k <= 3 * j)), lambda b: b)
    clean_letters = F.col("form").rlike(r"^[\x00-\x7f\p{L}]+$")
    filled = holes.join(whole.where(clean_letters), "mask").where(fits).groupBy("word").agg(F.max(F.struct("freq", "form")).alias("_m"))
    filled = filled.select("word", F.lit("lost").alias("channel"), F.col("_m.form").alias("written"), F.col("_m.freq").alias("freq"))
    options = scored.unionByName(filled).groupBy("word").agg(F.collect_list(F.struct("channel", "written", "freq")).alias("options"))
    hints = options.mapInPandas(
        lambda it: _score(it, model, total), "word string, clean double, reads array<struct<channel:string,written:string,score:double>>"
    )

    tokens = rows.select("_id", F.explode(F.array_distinct(F.split("_t", BREAKS))).alias("word")).where(F.col("word").rlike(r"[^\x00-\x7f]"))
    per_text = tokens.join(hints, "word").groupBy("_id").agg(F.collect_list(F.struct("word", "clean", "reads")).alias("hints"))
    joined = rows.join(per_text, "_id", "left")
    schema = f"_id {id_type}, _t string, restored string, damaged boolean, damaged_words int, lost_words int, channels string"
    return joined.mapInPandas(_restore, schema).withColumnRenamed("_id", id_col).withColumnRenamed("_t", text_col)
