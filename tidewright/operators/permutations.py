"""Counts under many permutations of trials' stimuli, a few permutations a round, so that disk stays bounded.

Permutation k gives the trial at position r of id order the stimulus of the trial at position r in the order of
md5(id|k|seed). Trials are packed into chunks in id order. A round hashes all trials under some permutations, cuts the
hash space into slices and merges each slice in one task, next to the responses of the trials at these positions: no
label is written per trial, and the shuffle files of a round are removed before the next.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import checkpointed

#: Rows of a chunk; hashes of a round and of a slice (9 bytes each), unless one permutation has more.
CHUNK, ROUND, SLICE = 50_000, 100_000_000, 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
WORDS = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)


def _md5_words(words: list, n: int) -> np.ndarray:
    """The first 8 bytes of the md5 of n one-block messages, whose 16 words are arrays or, where all are equal, numbers."""
    first = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, v, np.uint32) for v in first)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        w = words[WORDS[kind](i)]
        f += a
        if isinstance(w, np.ndarray):
            f += w
            f += np.uint32(SINES[i])
        else:
            f += np.uint32((w + SINES[i]) & 0xFFFFFFFF)
        s = TURNS[kind][i % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    a, b = ((v + np.uint32(v0)).byteswap().astype(np.uint64) for v, v0 in ((a, first[0]), (b, first[1])))
    return a << np.uint64(32) | b


class Hasher:
    """The first 8 bytes of md5(prefix + suffix), as numbers in the order of the digests; prefixes of one length go together."""

    def __init__(self, prefixes: pa.Array):
        raw = prefixes.cast(pa.binary())
        size = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]) if len(raw) else np.zeros(0, int)
        self.n, self.groups = len(raw), []
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            joined = b"".join(raw.take(pa.array(at)).to_pylist())
            self.groups.append((length, at, np.frombuffer(joined, np.uint8).reshape(len(at), length)))

    def __call__(self, suffix: bytes) -> np.ndarray:
        out = np.empty(self.n, np.uint64)
        for length, at, own in self.groups:
            whole = length + len(suffix)
            if whole > 55:
                out[at] = [int.from_bytes(hashlib.md5(r.tobytes() + suffix).digest()[:8]) for r in own]
                continue
            tail = np.zeros(64, np.uint8)
            tail[length:whole] = np.frombuffer(suffix, np.uint8)
            tail[whole] = 0x80
            tail[56:] = np.frombuffer((8 * whole).to_bytes(8, "little"), np.uint8)
            varied = -(-length // 4)
            block = np.repeat(tail[None, : 4 * varied], len(own), 0)
            block[:, :length] = own
            columns = np.ascontiguousarray(block.view("<u4").T) if varied else []
            rest = [int(v) for v in tail.view("<u4")]
            done = [_md5_words([c[a : a + 65536] for c in columns] + rest[varied:], min(65536, len(own) - a)) for a in range(0, len(own), 65536)]
            out[at] = np.concatenate(done)
        return out


def distinct_cells(cells: pa.StructArray) -> tuple[pa.StructArray, np.ndarray]:
    """Distinct structs and the place of each struct among them."""
    code = np.zeros(len(cells), np.int64)
    for field in cells.flatten():
        part = field.dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(len(part.dictionary), 1) + part.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    return cells.take(pa.array(first)), place


def _whole(table: pa.Table, name: str) -> pa.Array:
    c = table[name].combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _list(a: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)


def _chunk(table: pa.Table, place: int, number: int, wide: int) -> pa.RecordBatch:
    """One row of rows in id order, which hold all rows of their ids: a trial for each id and stimulus, cells next to the trials of their id."""
    prefix, cells = _whole(table, "prefix"), _whole(table, "cell")
    same = prefix.dictionary_encode().indices.to_numpy()
    group = np.cumsum(np.concatenate([[0], np.diff(same) != 0]))
    key, first = np.unique(group * wide + table["code"].to_numpy(), return_index=True)
    owner = key // wide
    kept = np.flatnonzero(table["counted"].to_numpy(zero_copy_only=False))
    begin, end = np.searchsorted(owner, group[kept], "left"), np.searchsorted(owner, group[kept], "right")
    many = end - begin
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(kept) else np.zeros(0, int)
    kinds, which = distinct_cells(cells.take(pa.array(kept)))
    binary = lambda v, kind: pa.array([np.ascontiguousarray(v, kind).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([place], pa.int32()), pa.array([number], pa.int32()), pa.array([len(key)], pa.int64()), _list(prefix.take(pa.array(first))), binary(key % wide, "i4"), _list(kinds), binary(at, "i8"), binary(np.repeat(which, many), "i4")],
        names=["p", "c", "n", "prefixes", "codes", "kinds", "at", "which"],
    )


def packed_trials(rows: DataFrame, keys: Sequence[str], response: str, trial_id: str, stimulus: str, chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """(chunks of trials in id order with their responses, number of stimuli); null stimuli have the code 0, null responses and ids aren't counted."""
    codes = rows.where(F.col(stimulus).isNotNull()).select(stimulus).distinct()  # one row per stimulus
    codes = checkpointed(codes.select(stimulus, F.row_number().over(Window.orderBy(stimulus)).alias("code")))
    wide = codes.count() + 1
    coded = rows.join(codes, stimulus, "left").select(
        F.col(trial_id).alias("id"), F.coalesce(F.concat(F.col(trial_id).cast("string"), F.lit("|")), F.lit("")).alias("prefix"), F.struct(*keys, F.col(response).alias("_x")).alias("cell"),
        (F.col(response).isNotNull() & F.col(trial_id).isNotNull()).alias("counted"), F.coalesce("code", F.lit(0)).alias("code"),
    )
    ordered = coded.repartitionByRange(F.col("id")).sortWithinPartitions("id").drop("id")
    cell = ordered.schema["cell"].dataType
    schema = T.StructType(
        [T.StructField("p", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("prefixes", T.ArrayType(T.StringType())), T.StructField("codes", T.BinaryType()), T.StructField("kinds", T.ArrayType(cell)), T.StructField("at", T.BinaryType()), T.StructField("which", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, place = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= chunk:
                table = pa.Table.from_batches(held)
                ids = table["prefix"]
                cut = len(table) - 1  # the last id may go on
                while cut and ids[cut - 1] == ids[len(table) - 1]:
                    cut -= 1
                if cut:
                    yield _chunk(table.slice(0, cut), place, number, wide)
                    held, number = table.slice(cut).to_batches(), number + 1
        if sum(map(len, held)):
            yield _chunk(pa.Table.from_batches(held), place, number, wide)

    return checkpointed(ordered.mapInArrow(run, schema)), wide - 1


def _round(chunks: DataFrame, start: dict, n: int, wide: int, draws: Sequence[int], seed: int, per_slice: int) -> DataFrame:
    """(cell, b, code, n): counts under the permutations ``draws``."""
    slices = max(1, -(-n * len(draws) // per_slice))
    bounds = np.array([(2**64 * j) // slices for j in range(1, slices)], np.uint64)
    margin = 6 * math.isqrt(n) + 6  # by Hoeffding's bound a slice begins further from its share with a chance of e^-72; it's an error then
    low, high = ([n * (j + e) // slices + s * margin for j in range(slices)] for e, s in ((0, -1), (1, 1)))
    low[0], high[-1] = 0, n
    small = "u1" if wide <= 256 else "i4"
    cells = chunks.schema["kinds"].dataType
    moved = T.StructType([T.StructField("j", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("hashes", "codes", "sizes", "before")], T.StructField("kinds", cells), *[T.StructField(c, T.BinaryType()) for c in ("at", "which")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                own = {c: batch.column(c).slice(r, 1) for c in ("prefixes", "kinds")} | {c: batch.column(c)[r].as_py() for c in ("p", "c", "codes", "at", "which")}
                code, hasher = np.frombuffer(own["codes"], "i4").astype(small), Hasher(own["prefixes"].flatten())
                at, which, kinds = np.frombuffer(own["at"], "i8") + start[own["p"], own["c"]], np.frombuffer(own["which"], "i4"), own["kinds"].flatten()
                pieces = [([], [], [], []) for _ in range(slices)]
                for k in draws:
                    h = hasher(f"{k}|{seed}".encode())
                    order = np.argsort(h)
                    h, drawn = h[order], code[order]
                    ends = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
                    for (hs, cs, sizes, before), a, b in zip(pieces, ends, ends[1:]):
                        hs.append(h[a:b].tobytes()), cs.append(drawn[a:b].tobytes()), sizes.append(b - a), before.append(a)
                for j, (hs, cs, sizes, before) in enumerate(pieces):
                    here = np.flatnonzero((at >= low[j]) & (at < high[j]))
                    some = [b"".join(hs), b"".join(cs), np.array(sizes, "i8").tobytes(), np.array(before, "i8").tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([j], pa.int32()), *[pa.array([v], pa.binary()) for v in some], _list(kinds if len(here) else kinds.slice(0, 0)), *[pa.array([v[here].tobytes()], pa.binary()) for v in (at, which)]],
                        names=["j", "hashes", "codes", "sizes", "before", "kinds", "at", "which"],
                    )

    def merge(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(v, kind) for v in table[c].to_pylist()]
        j, hashes, codes, sizes, at = table["j"][0].as_py(), read("hashes", "u8"), read("codes", small), read("sizes", "i8"), read("at", "i8")
        lists = _whole(table, "kinds")
        kinds, place = distinct_cells(lists.flatten())
        offset = np.concatenate([[0], np.cumsum([len(v) for v in lists])])[:-1].astype(int)
        which = np.concatenate([place[w + o] for w, o in zip(read("which", "i4"), offset)])
        at = np.concatenate(at)
        order = np.argsort(at, kind="stable")
        at, which = at[order], which[order].astype(np.int64)
        off = np.sum(read("before", "i8"), axis=0)
        ends = [np.cumsum(s) for s in sizes]
        out = []
        for i, k in enumerate(draws):
            h, c = (np.concatenate([v[e[i] - s[i] : e[i]] for v, e, s in zip(x, ends, sizes)]) for x in (hashes, codes))
            if not len(h):
                continue
            begin = int(off[i])
            if begin < low[j] or begin + len(h) > high[j]:
                raise ValueError("hashes of trial ids aren't even: are ids repeated?")
            order = np.argsort(h)
            if (np.diff(h[order]) == 0).any():  # an id with several stimuli, else one chance in 2^64 for two ids
                order = np.lexsort((c, h))
            a, b = np.searchsorted(at, [begin, begin + len(h)])
            drawn = c[order][at[a:b] - begin].astype(np.int64)
            met = which[a:b] * wide + drawn
            if len(kinds) * wide <= 8_000_000:
                count = np.bincount(met, minlength=0)
                cell = np.flatnonzero(count)
                count = count[cell]
            else:
                cell, count = np.unique(met, return_counts=True)
            some = cell % wide > 0
            out.append((cell[some], count[some], k))
        cell = np.concatenate([c for c, _, _ in out] or [np.zeros(0, int)])
        return pa.table({"cell": kinds.take(pa.array(cell // wide)), "b": pa.array(np.concatenate([np.full(len(c), k) for c, _, k in out] or [cell]), pa.int32()), "code": pa.array(cell % wide, pa.int64()), "n": pa.array(np.concatenate([m for _, m, _ in out] or [cell]), pa.int64())})

    made = T.StructType([T.StructField("cell", cells.elementType), T.StructField("b", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    return chunks.mapInArrow(cut, moved).groupBy("j").applyInArrow(merge, made)


def permuted(rows: DataFrame, keys: Sequence[str], response: str, trial_id: str, stimulus: str, b: int, seed: int, summary, per_round: int = ROUND, per_slice: int = SLICE, chunk: int = CHUNK) -> DataFrame:
    """``summary`` of the counts (keys, b, response, code, n) of every permutation, written round by round.

    ``summary`` takes the counts of some permutations and gives rows for each ``b``. A round has as many permutations as
    ``per_round`` hashes allow.
    """
    if b <= 0:
        raise ValueError("b must be positive")
    spark = rows.sparkSession
    chunks, stimuli = packed_trials(rows, keys, response, trial_id, stimulus, chunk)
    start, n = {}, 0
    for r in sorted(chunks.select("p", "c", "n").collect()):  # one row per chunk
        start[r["p"], r["c"]], n = n, n + r["n"]
    step, out, before = max(1, per_round // max(n, 1)), None, spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # else the shuffle files of all rounds stay until the driver collects garbage
    try:
        for k in range(1, b + 1, step):
            counts = _round(chunks, start, n, stimuli + 1, range(k, min(k + step, b + 1)), seed, per_slice)
            flat = counts.groupBy("cell", "b", "code").agg(F.sum("n").alias("n")).select(*[F.col("cell").getField(c).alias(c) for c in keys], "b", F.col("cell._x").alias(response), "code", "n")
            one = checkpointed(summary(flat))
            out = one if out is None else out.unionByName(one)
    finally:
        spark.conf.set(CLEANUP, before)
    return out
