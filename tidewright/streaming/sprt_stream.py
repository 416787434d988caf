"""Sequential tests on streams of letters: a decision per stream id as soon as the evidence suffices.

The state of an id is its running log ratio, its letter count and whether it is decided; a stream that
stays silent for ``timeout_ms`` is decided by the sign of its ratio and marked as forced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.operators.langid import wald_thresholds

OUTPUT = "id bigint, label string, n_letters bigint, forced boolean, llr double"
STATE = "llr double, n bigint, decided boolean"


def sprt_stream(chunks: DataFrame, id_col: str, text: str, ratios: Sequence[float], labels: tuple[str, str], alpha: float, beta: float, timeout_ms: int = 600_000, order: str | None = None) -> DataFrame:
    """Decisions (id, label, n_letters, forced, llr) from a stream of text chunks; the chunks of an id come batch by batch in order.

    ``ratios`` are the 26 log ratios of label 1 over label 0. Letters after the decision are ignored, other
    characters, null ids and null texts too. Within a batch the chunks of an id are taken by the column
    ``order`` (a number or time; nulls last); without it, in the order in which they arrive in its group, which a shuffle may change.
    """
    upper, lower = wald_thresholds(alpha, beta)
    table = [float(r) for r in ratios]
    if len(table) != 26:
        raise ValueError("need 26 ratios")

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        llr, n, done = state.get if state.exists else (0.0, 0, False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame({"id": [key[0]], "label": [labels[0] if llr >= 0 else labels[1]], "n_letters": [n], "forced": [True], "llr": [llr]})
            return
        chunks_ = pd.concat([*parts])  # one id's chunks of one batch
        if not done:
            if order is not None:
                chunks_ = chunks_.sort_values("_order", kind="stable")
            x = np.frombuffer("".join(chunks_["text"]).encode("ascii"), dtype=np.uint8).astype(np.int64) - 97
            run = np.cumsum(np.concatenate([[llr], np.asarray(table)[x]]))[1:]
            hit = np.flatnonzero((run >= upper) | (run <= lower))
            if len(run):
                k = int(hit[0]) if len(hit) else len(run) - 1
                llr, n, done = float(run[k]), n + k + 1, len(hit) > 0
            if done:
                yield pd.DataFrame({"id": [key[0]], "label": [labels[0] if llr >= 0 else labels[1]], "n_letters": [n], "forced": [False], "llr": [llr]})
        state.update((llr, n, done))
        if not done:
            state.setTimeoutDuration(timeout_ms)

    rows = chunks.select(F.col(id_col).cast("bigint").alias("id"), F.regexp_replace(F.lower(F.col(text)), "[^a-z]", "").alias("text"), F.col(order or id_col).alias("_order")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.groupBy("id").applyInPandasWithState(decide, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def refractory_sessions(detections: DataFrame, keys: Sequence[str], ts: str, amplitude: str, gap: str, watermark: str) -> DataFrame:
    """(keys, start, end, hits, peak): runs of detections with pauses below ``gap``, as session windows of a stream or table.

    Late detections are accepted up to the watermark; a run is final once the watermark has passed its end.
    """
    w = detections.withWatermark(ts, watermark) if detections.isStreaming else detections
    g = w.where(F.col(ts).isNotNull()).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    out = g.agg(F.count(F.lit(1)).alias("hits"), F.max(F.abs(F.col(amplitude))).alias("peak"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "hits", "peak")
