"""Mixing sources to target shares of the tokens, by pivotal dependent rounding.

Each document of a source is wanted ``c`` times (its source's target tokens over its tokens, at most
``max_repeats``): floor(c) copies for certain and one more with the fractional probability. Pivotal
rounding settles those fractions: two documents of near size meet, one takes mass from the other until
one of them is 0 or 1, and the other meets the next. Every partition does so over its own share of every
source and leaves at most one open document per source; the open ones of all partitions are settled
through a tree of ever fewer partitions. The number of copies of a source so differs from its
expectation by less than one.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
COLUMNS = ["id", "source", "tokens", "copies", "p", "key"]
EPS, MASK = 1e-12, (1 << 64) - 1


def token_counts(text: Column | str, tokenizer_path: str = TOKENIZER, pattern: str | None = None) -> Column:
    """Tokens of a text under a public byte-level BPE vocabulary file; null and empty texts have 0.

    The driver reads the file (a few MB at most) and sends it to the executors.
    """
    held = SparkSession.active().sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        pat = pattern or r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        enc = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
        for s in parts:
            yield s.fillna("").map(lambda t: len(enc.encode_ordinary(t))).astype("int64")

    return count(F.col(text) if isinstance(text, str) else text)


def _settle(parts: Iterator[pd.DataFrame], seed: int, level: int, last: bool) -> Iterator[pd.DataFrame]:
    """Pivotal rounding along the rows (id, source, tokens, copies, p, key) of a partition, 0 < p < 1; the open row of each source comes out at the end.

    ``key`` is a hash of the row; a meeting is decided by the keys of the two rows.
    """
    salt = (seed * 0x9E3779B97F4A7C15 + level * 0xD1B54A32D192ED03) & MASK
    open_rows: dict[str, list] = {}
    for pdf in parts:
        n = len(pdf)
        sources, keys, p_in = pdf["source"].tolist(), pdf["key"].tolist(), pdf["p"].tolist()
        rows = pdf[["id", "source", "tokens", "copies"]].to_dict("split", index=False)["data"]
        done = []
        for k in range(n):
            p, key, source = p_in[k], keys[k], sources[k]
            o = open_rows.get(source)
            if o is None:
                open_rows[source] = [rows[k], p, key]
                continue
            q, x = o[1], ((o[2] ^ salt) * 0xBF58476D1CE4E5B9 + key * 0x94D049BB133111EB) & MASK
            u = (((x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & MASK) >> 11) / (1 << 53)
            if p + q < 1:  # one takes the mass of both, the other gets no copy
                old_wins = u < q / (p + q)
                lose = rows[k] if old_wins else o[0]
                open_rows[source] = [o[0] if old_wins else rows[k], p + q, o[2] if old_wins else key]
                done.append((*lose, None, 0))
            else:  # one gets its copy, the other keeps what is left
                old_full = u < (1 - p) / (2 - p - q)
                win, lose, lose_key = (o[0], rows[k], key) if old_full else (rows[k], o[0], o[2])
                done.append((*win[:3], win[3] + 1, None, 0))
                rest = p + q - 1
                if rest <= EPS:
                    done.append((*lose, None, 0))
                    del open_rows[source]
                else:
                    open_rows[source] = [lose, rest, lose_key]
        yield pd.DataFrame(done, columns=COLUMNS).astype({"p": "float64"})
    left = []
    for row, p, key in open_rows.values():
        u = (((key ^ salt) * 0x9E3779B97F4A7C15 & MASK) >> 11) / (1 << 53)
        left.append((*row[:3], row[3] + int(u < p), None, 0) if last else (*row, p, key))
    yield pd.DataFrame(left, columns=COLUMNS).astype({"p": "float64"})


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    tokenizer_path: str = TOKENIZER,
    target_source: str = "source",
    share_col: str = "target_share",
    repeats_col: str = "max_repeats",
    total_tokens: int | None = None,
    seed: int = 17,
    fan_in: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: rows (id, source, tokens, copies) with copies >= 1. report: one row per target source.

    The report has source, target_share, max_repeats, docs, source_tokens, capacity_tokens, target_tokens,
    mixed_tokens, actual_share (of what was mixed), share_of_total (of the size aimed at), copies, exhausted
    (the mix holds every document ``max_repeats`` times) and reachable (not exhausted below its target).
    The size aimed at is ``total_tokens`` or else the tokens of all documents, those without a source
    included. Documents with a null id or a source without a target aren't drawn; a null text has no
    tokens. A source without documents mixes nothing and so is exhausted. Repeated rows of a target
    source count once. The targets are as few as the sources.
    """
    id_type, source_type = (docs.schema[c].dataType.simpleString() for c in (id_col, source_col))
    sized = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_counts(text_col, tokenizer_path).alias("tokens")))
    goals = targets.select(F.col(target_source).alias("source"), F.col(share_col).cast("double").alias("target_share"), F.col(repeats_col).cast("bigint").alias("max_repeats"))
    goals = goals.where("source IS NOT NULL").dropDuplicates(["source"])
    per_source = sized.where("id IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("docs"))
    if total_tokens is None:
        total_tokens = sized.agg(F.sum("tokens")).first()[0] or 0
    plan = goals.join(per_source, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens")
    )
    plan = plan.withColumn("capacity_tokens", F.col("source_tokens") * F.col("max_repeats")).withColumn("target_tokens", F.col("target_share") * F.lit(total_tokens))
    wanted = F.when(F.col("source_tokens") > 0, F.least(F.col("target_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    rates = plan.select("source", wanted.alias("_c"))

    schema = f"id {id_type}, source {source_type}, tokens bigint, copies bigint, p double, key bigint"
    p = F.col("_c") - F.floor("_c")
    drawn = sized.where("id IS NOT NULL").join(rates, "source").select(
        "id", "source", "tokens", (F.floor("_c") + F.when(p >= 1 - EPS, 1).otherwise(0)).cast("bigint").alias("copies"),
        F.when((p > EPS) & (p < 1 - EPS), p).alias("p"), F.xxhash64("id", F.lit(seed)).alias("key"),
    )
    settled = [drawn.where("p IS NULL")]  # whole numbers of copies need no rounding
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level, last = 0, n == 1
    current = drawn.where("p IS NOT NULL").repartition(n, "id").sortWithinPartitions("source", "tokens", "id")
    while True:
        lv, la = level, last
        step = checkpointed(current.mapInPandas(lambda it, lv=lv, la=la: _settle(it, seed, lv, la), schema))
        settled.append(step.where("p IS NULL"))
        if last:
            break
        n = math.ceil(n / fan_in)
        level, last = level + 1, n == 1
        rest = step.where("p IS NOT NULL")
        current = rest.repartition(n, "id").sortWithinPartitions("source", "tokens", "id") if n > 1 else rest.coalesce(1).sortWithinPartitions("source", "tokens", "id")
    copies = settled[0]
    for s in settled[1:]:
        copies = copies.unionByName(s)
    mix = copies.where("copies > 0").select("id", "source", "tokens", "copies")
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("copies"))
    report = plan.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0))).withColumn("copies", F.coalesce("copies", F.lit(0)))
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # one row per target
    report = report.withColumn("actual_share", F.try_divide(F.col("mixed_tokens"), whole.cast("double")))
    report = report.withColumn("share_of_total", F.try_divide(F.col("mixed_tokens"), F.lit(total_tokens).cast("double")))
    report = report.withColumn("exhausted", F.col("copies") >= F.col("docs") * F.col("max_repeats"))
    report = report.withColumn("reachable", ~F.col("exhausted") | (F.col("mixed_tokens") >= F.col("target_tokens")))
    return mix.withColumnRenamed("id", id_col), report
