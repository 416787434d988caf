"""Clusters of mutually similar waveforms, by parallel pivot correlation clustering.

Waveforms are smoothed and compared by their best normalised correlation over small shifts, so amplitude,
gain and alignment don't matter. The clustering follows a hash order of the ids. In every round the
waveforms that come first among the unclustered ones are sent to all tasks; those without a similar earlier
one (local minima of the order) are pivots, and every unclustered waveform similar to a pivot is absorbed.
Rounds of this kind find the large clusters; pivots of the same shape are merged, members move to the closest
pivot and templates are recomputed. What these don't explain is cut by hashed signs of random projections into
buckets of a row or so, several times: rows of a small cluster fall into the same buckets. The first row of a
bucket in hash order is its pivot, and pivots that absorb others there are tried against all that is left,
then refined in the same way. So a cluster needs a number of rows, not a share of the table, and no row meets
all others. At last medoids are recomputed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.vector_neighbors import dense_rows
from tidewright.session import checkpointed

CELLS = 4_000_000
ROUND_PIVOTS = 64
LARGE = 256
BATCH_PIVOTS = 256
TABLES = 8


def _kernel(sigma: float) -> np.ndarray:
    r = math.ceil(3 * sigma)
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2)) if sigma > 0 else np.ones(1)
    return k / k.sum()


def noise_passed(sigma: float) -> float:
    """Noise that stays after smoothing over noise that smoothing removes, for white noise."""
    k = _kernel(sigma)
    kept, middle = (k**2).sum(), k[len(k) // 2]
    return math.sqrt(kept / max(1 - 2 * middle + kept, 1e-12))


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Rows convolved with a Gaussian of ``sigma`` samples, zero beyond the ends."""
    k = _kernel(sigma)
    r, n = len(k) // 2, x.shape[1]
    padded = np.pad(x, ((0, 0), (r, r)))
    return sum(k[j] * padded[:, j : j + n] for j in range(2 * r + 1))


def _shifted(p: np.ndarray, shift: int) -> np.ndarray:
    """(rows, 2 shift + 1, n): every row moved by -shift..shift samples, zero where nothing is known."""
    n = p.shape[1]
    padded = np.pad(p, ((0, 0), (shift, shift)))
    return np.stack([padded[:, shift - s : shift - s + n] for s in range(-shift, shift + 1)], axis=1)


def similarity(x: np.ndarray, pivots: np.ndarray, shift: int, overlap: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Best normalised correlation of each row with each pivot over the shifts, and the shift.

    A shift counts only where at least ``overlap`` of the row's energy meets the pivot.
    """
    moved = _shifted(pivots, shift)
    moved = moved / np.maximum(np.linalg.norm(moved, axis=2, keepdims=True), 1e-12)
    mask = _shifted(np.ones((1, x.shape[1]), x.dtype), shift)[0]
    best = np.empty((len(x), len(pivots)), np.float32)
    arg = np.empty((len(x), len(pivots)), np.int16)
    step = max(1, CELLS // (len(pivots) * len(mask)))
    flat = moved.reshape(-1, x.shape[1]).T
    for at in range(0, len(x), step):
        y = x[at : at + step]
        part = np.sqrt((y**2) @ mask.T)
        c = (y @ flat).reshape(len(y), len(pivots), len(mask)) / np.maximum(part, 1e-12)[:, None, :]
        c = np.where((part >= overlap * np.linalg.norm(y, axis=1, keepdims=True))[:, None, :], c, -1)
        best[at : at + step] = c.max(2)
        arg[at : at + step] = c.argmax(2) - shift
    return best, arg


def _pack(unit: np.ndarray) -> list[bytes]:
    """Unit vectors in 16-bit numbers, which moves a correlation by less than 0.0001."""
    top = np.maximum(np.abs(unit).max(1, keepdims=True), 1e-12)
    return [r.tobytes() for r in np.rint(unit / top * 32767).astype(np.int16)]


def _vectors(col, n: int) -> np.ndarray:
    x = np.frombuffer(b"".join(col), dtype=np.int16).reshape(-1, n).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def usable(df: DataFrame, id_col: str, vector_col: str, length: int, sigma: float) -> DataFrame:
    """Rows (id, h, b, noise): smoothed arrays of ``length`` finite numbers that aren't all zero, one per id, in hash order h."""
    id_type = df.schema[id_col].dataType.simpleString()
    edge = min(3, length // 4)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = dense_rows(batch.column("v"), (length,))
            x = smooth(raw, sigma)
            norm = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
            noise = np.linalg.norm((raw - x)[:, edge : length - edge], axis=1) / norm
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(_pack(x / norm[:, None]), pa.binary()), pa.array(noise.astype(np.float32))], ["id", "b", "noise"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.mapInArrow(prepare, f"id {id_type}, b binary, noise float").groupBy("id").agg(F.min(F.struct("b", "noise")).alias("r"))
    return rows.select("id", F.xxhash64("id").alias("h"), "r.b", "r.noise")


def local_minima(cand: np.ndarray, known: np.ndarray, shift: int, threshold: float) -> np.ndarray:
    """Those of the candidates, in hash order, that are similar to no earlier candidate and to no known template."""
    if not len(cand):
        return cand
    early = np.tril(similarity(cand, cand, shift)[0] >= threshold, -1).any(1)
    if len(known):
        early |= (similarity(cand, known, shift)[0] >= threshold).any(1)
    return cand[~early]


def _gathered(rows: DataFrame, cand: np.ndarray, known: np.ndarray, length: int, shift: int, threshold: float, passed: float) -> list:
    """One row per pivot with members among ``rows``: (cluster, total, rows, apart, expected), pivots being the local minima of ``cand``.

    total is the sum of the members, moved onto the pivot; apart the sum of their squared distances from it
    and expected what their own noise makes of these. Summed per task first; one row per task and pivot is shuffled.
    """
    held = rows.sparkSession.sparkContext.broadcast((cand, known))
    schema = "cluster int, total binary, rows bigint, apart double, expected double"

    def gather(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = local_minima(*held.value, shift, threshold)
        total, n, apart, expected = np.zeros((len(p), length)), np.zeros(len(p), int), np.zeros(len(p)), np.zeros(len(p))
        for pdf in parts if len(p) else ():
            x = _vectors(pdf["b"], length)
            c, a = similarity(x, p, shift)
            near, top = c.argmax(1), c.max(1)
            inside = np.flatnonzero(top >= threshold)
            moves = a[inside, near[inside]]
            for k, s in {*zip(near[inside].tolist(), moves.tolist())}:
                part = x[inside[(near[inside] == k) & (moves == s)]].sum(0)
                if s <= 0:
                    total[k, -s:] += part[: length + s]
                else:
                    total[k, :-s] += part[s:]
            n += np.bincount(near[inside], minlength=len(p))
            apart += np.bincount(near[inside], np.maximum(1 - top[inside].astype(float) ** 2, 0), minlength=len(p))
            expected += np.bincount(near[inside], (passed * np.maximum(pdf["noise"].to_numpy()[inside], 0.01)) ** 2, minlength=len(p))
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some, "total": [total[k].tobytes() for k in some], "rows": n[some], "apart": apart[some], "expected": expected[some]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t) for t in pdf["total"])
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "total": [total.tobytes()], "rows": [pdf["rows"].sum()], "apart": [pdf["apart"].sum()], "expected": [pdf["expected"].sum()]})

    return sorted(rows.mapInPandas(gather, schema).groupBy("cluster").applyInPandas(add, schema).collect(), key=lambda r: r["cluster"])


def _means(stats: list, length: int) -> np.ndarray:
    return np.array([np.frombuffer(r["total"]) / r["rows"] for r in stats], dtype=np.float32).reshape(-1, length)


def _unlike(rows: DataFrame, templates: np.ndarray, length: int, shift: int, threshold: float) -> DataFrame:
    """The rows similar to none of the templates."""
    held = rows.sparkSession.sparkContext.broadcast(templates)

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf[similarity(_vectors(pdf["b"], length), held.value, shift)[0].max(1) < threshold]

    return checkpointed(rows.mapInPandas(keep, rows.schema))


def _small_pivots(left: DataFrame, n: int, length: int, shift: int, threshold: float) -> DataFrame:
    """Rows (h, id, b) that are first of a bucket and similar to at least two others of it, for hashed signs of random projections.

    Rows are moved so that their largest value (in every other table: their smallest) stands in the middle. There are
    twice as many buckets as rows, so unrelated rows seldom share one.
    """
    bits = min(60, max(4, math.ceil(math.log2(2 * n))))
    id_type = left.schema["id"].dataType.simpleString()

    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(9).normal(size=(TABLES, 2 * length, bits))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for pdf in parts:
            x = _vectors(pdf["b"], length)
            out = []
            for t in range(TABLES):
                at = x.argmax(1) if t % 2 else x.argmin(1)
                moved = np.zeros((len(x), 2 * length), np.float32)
                np.put_along_axis(moved, length - at[:, None] + np.arange(length), x, 1)
                out.append(((moved @ planes[t] > 0) @ weights))
            yield pd.DataFrame({"id": pdf["id"], "h": pdf["h"], "keys": list(np.stack(out, 1))})

    places = left.mapInPandas(keys, f"id {id_type}, h bigint, keys array<bigint>").select("id", "h", F.posexplode("keys").alias("t", "key"))
    first = places.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "id")).alias("p")).where("n >= 3")
    pairs = places.join(first.select("t", "key", F.col("p.id").alias("pivot")), ["t", "key"]).where("id <> pivot").select("id", "pivot").distinct()
    met = pairs.join(left.select("id", "b"), "id").join(left.select(F.col("id").alias("pivot"), F.col("b").alias("pb")), "pivot")

    def similar(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x, y = _vectors(pdf["b"], length), _shifted(_vectors(pdf["pb"], length), shift)
            c = np.einsum("ij,isj->is", x, y).max(1)
            yield pdf.loc[c >= threshold, ["pivot"]]

    some = met.mapInPandas(similar, f"pivot {id_type}").groupBy("pivot").count().where("count >= 2")
    return checkpointed(left.join(some.select(F.col("pivot").alias("id")), "id", "left_semi").select("h", "id", "b"))


def _large_templates(rows: DataFrame, n: int, length: int, threshold: float, min_rows: int, shift: int, passed: float) -> np.ndarray:
    """Means of the rows around the pivots of rounds, as long as a round finds one with a LARGE-th part of what is left."""
    templates, left, left_n = np.zeros((0, length), np.float32), rows, n
    while left_n >= min_rows:
        first = left.select("h", "id", "b").orderBy("h", "id").limit(ROUND_PIVOTS).collect()
        stats = _gathered(left, _vectors([r["b"] for r in first], length), templates, length, shift, threshold, passed)
        found = _means([r for r in stats if r["rows"] >= max(min_rows, left_n / LARGE)], length)
        if not len(found):
            break
        templates = _merged(np.concatenate([templates, found]), shift, threshold)
        left = _unlike(left, templates, length, shift, threshold)
        before, left_n = left_n, left.count()
        if left_n == before:
            break
    return templates


def _small_templates(left: DataFrame, n: int, length: int, threshold: float, min_rows: int, shift: int, passed: float) -> np.ndarray:
    """Means of the rows around every pivot that absorbs others in its bucket and has ``min_rows`` among all that is left."""
    templates = np.zeros((0, length), np.float32)
    rest, last = _small_pivots(left, n, length, shift, threshold), None
    while True:  # BATCH_PIVOTS at a time
        todo = rest if last is None else rest.where((F.col("h") > last["h"]) | (F.col("h") == last["h"]) & (F.col("id") > F.lit(last["id"])))
        batch = todo.orderBy("h", "id").limit(BATCH_PIVOTS).collect()
        if not batch:
            return templates
        last = batch[-1]
        stats = _gathered(left, _vectors([r["b"] for r in batch], length), templates, length, shift, threshold, passed)
        found = _means([r for r in stats if r["rows"] >= min_rows], length)
        templates = _merged(np.concatenate([templates, found]), shift, threshold)


def shape_clusters(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    length: int,
    threshold: float = 0.95,
    keep: float = 0.94,
    excess: float = 1.9,
    spread: float = 1.4,
    min_rows: int = 8,
    shift: int = 12,
    sigma: float = 2.0,
    typical: int = 3,
    refinements: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """(members, clusters). members: (id, cluster, similarity), one row per id of the input.

    ``cluster`` is null for unusable arrays (null, of another length, with a null or NaN, all zero) and for
    waveforms of no cluster: not within ``keep`` of any template, further from it than ``excess`` times what
    their own noise explains, or of a shape that fewer than ``min_rows`` rows have, however large the table.
    Groups whose members differ among themselves by more than ``spread`` times what their noise explains
    (root mean square) aren't one shape: so are waveforms superimposed at varying lags. clusters: (cluster, size,
    medoid, typical ids, mean similarity); among vectors of equal length moved onto the template the one
    closest to their mean is the medoid. One template a cluster is held by the driver and every task.
    Repeated rows of an id count once (one of them is taken if they differ); an empty table gives two empty results.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    passed = noise_passed(sigma)

    def refined(rows: DataFrame, pivots: np.ndarray) -> np.ndarray:
        """Templates after members have moved to the closest one, without those of too few or too different members.

        At most ``refinements`` rounds of moving; it ends with the round that leaves all templates as they are.
        """
        for turn in range(refinements + 1):
            pivots = _merged(pivots, shift, threshold)
            if not len(pivots):
                break
            stats = [r for r in _gathered(rows, pivots, pivots[:0], length, shift, threshold, passed) if r["rows"] >= min_rows]
            means = _means(stats, length)
            still = len(means) == len(pivots) and (similarity(means, pivots, shift)[0].diagonal() > 0.9995).all()
            if still or turn == refinements:
                return means[[r["apart"] <= spread**2 * r["expected"] for r in stats]]
            pivots = means
        return pivots

    def assigned(rows: DataFrame, templates: np.ndarray, first: int) -> DataFrame:
        """The rows with the closest template (numbered from ``first``) where it explains them, and the similarity to it."""
        held = df.sparkSession.sparkContext.broadcast(templates)

        def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = held.value
            for pdf in parts:
                top, cluster = np.zeros(len(pdf)), pd.array([pd.NA] * len(pdf), dtype="Int64")
                if len(p) and len(pdf):
                    c, _ = similarity(_vectors(pdf["b"], length), p, shift)
                    top = c.max(1).astype(float)
                    apart = np.sqrt(np.maximum(1 - top**2, 0))
                    member = (top >= keep) & (apart <= excess * passed * np.maximum(pdf["noise"].to_numpy(), 0.01))
                    cluster = pd.array(first + c.argmax(1), dtype="Int64")
                    cluster[~member] = pd.NA
                yield pdf.assign(cluster=cluster, similarity=top, b=pdf["b"].where(cluster.isna(), b""))

        done = rows.mapInPandas(assign, f"id {id_type}, h bigint, b binary, noise float, cluster int, similarity double")
        return checkpointed(done)  # members need their vectors no more

    rows = checkpointed(usable(df, id_col, vector_col, length, sigma))
    args = (length, threshold, min_rows, shift, passed)
    large = refined(rows, _large_templates(rows, rows.count(), *args))
    once = assigned(rows, large, 0)
    left = once.where("cluster IS NULL").select("id", "h", "b", "noise")
    left_n = left.count()
    small = refined(left, _small_templates(left, left_n, *args)) if left_n >= min_rows else large[:0]
    again = assigned(left, small, len(large)) if len(small) else once.where("cluster IS NULL")
    members = once.where("cluster IS NOT NULL").select("id", "cluster", "similarity").unionByName(again.select("id", "cluster", "similarity"))
    enough = [r["cluster"] for r in members.where("cluster IS NOT NULL").groupBy("cluster").count().where(F.col("count") >= min_rows).collect()]  # one row a template
    members = checkpointed(members.withColumn("cluster", F.when(F.col("cluster").isin(enough), F.col("cluster"))))
    # the best fitting members per cluster, first per salt, then over all: never a whole cluster in one task
    inside = members.where("cluster IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    best = (F.col("similarity").desc(), F.col("id"))
    few = inside.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "salt").orderBy(*best))).where(F.col("r") <= typical)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(*best))).where(F.col("r") <= typical)
    few = few.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t")).select("cluster", F.transform("t", lambda e: e["id"]).alias("typical"))
    sizes = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("similarity").alias("mean_similarity"))
    clusters = sizes.join(few, "cluster").select("cluster", "size", F.col("typical")[0].alias("medoid"), "typical", "mean_similarity")
    every = df.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().join(members, "id", "left")
    return every.withColumnRenamed("id", id_col), clusters


def _merged(pivots: np.ndarray, shift: int, bar: float) -> np.ndarray:
    """The pivots without those as similar as ``bar`` to an earlier one (earlier ones absorbed first)."""
    if not len(pivots):
        return pivots
    sims, _ = similarity(pivots, pivots, shift)
    kept: list[int] = []
    for i in range(len(pivots)):
        if all(sims[i, j] < bar for j in kept):
            kept.append(i)
    return pivots[kept]
