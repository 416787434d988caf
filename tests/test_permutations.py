"""Permutations made a few at a time: the counts of explicit labels, whatever the rounds, slices and chunks."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.operators import information as info
from tidewright.operators import permutations as P


def test_hashes_are_md5():
    texts = [f"{i}|" for i in [*range(120), 99_999, 10**18]] + ["", "é|", "x" * 52 + "|", "x" * 90 + "|"]
    got = P.Hasher(pa.array(texts))(b"17|7")
    assert got.tolist() == [int.from_bytes(hashlib.md5(f"{t}17|7".encode()).digest()[:8]) for t in texts]


def test_rounds_count_what_labels_count(spark, monkeypatch):
    rows = [(n, t, None if (t + n) % 11 == 0 else (t * 7 + n) % 5, None if t % 13 == 0 else "abc"[t % 3]) for t in range(300) for n in range(3) if (t + n) % 4]
    rows += [(0, None, 1, "a"), (1, None, 2, "a")]  # a trial without an id takes part in the permutations and isn't counted
    df = spark.createDataFrame(rows, "neuron int, trial_id int, response int, stimulus string")
    b, seed = 5, 3
    joined = df.drop("stimulus").join(info.shuffled_labels(df.select("trial_id", "stimulus").distinct(), "trial_id", "stimulus", b, seed), "trial_id")
    codes = {"a": 1, "b": 2, "c": 3}
    want = {(r["neuron"], r["b"], r["response"], codes[r["stimulus"]]): r["n"] for r in info.joint_histogram(joined, "response", "stimulus", ["neuron", "b"]).collect()}
    for limits in ((P.ROUND, P.SLICE, P.CHUNK), (700, 100, 40), (1, 1000, 7)):
        got = P.permuted(df, ["neuron"], "response", "trial_id", "stimulus", b, seed, lambda counts: counts, *limits).collect()
        assert {(r["neuron"], r["b"], r["response"], r["code"]): r["n"] for r in got} == want
    old = info.mi_by_key(df, ["neuron"], "response", "stimulus", "trial_id", "shuffle", b, seed, info.coded_labels(df, "trial_id", "stimulus", b, seed)).collect()

    def made(*_, **__):
        raise AssertionError("labels were written")

    monkeypatch.setattr(info, "label_arrays", made)
    new = {r["neuron"]: r["mi"] for r in info.mi_by_key(df, ["neuron"], "response", "stimulus", "trial_id", "shuffle", b, seed).collect()}
    assert new == {r["neuron"]: pytest.approx(r["mi"], abs=1e-12) for r in old}
    assert np.isfinite([*new.values()]).all() and spark.conf.get(P.CLEANUP) == "false"


def test_an_id_with_two_stimuli_is_two_trials(spark):
    df = spark.createDataFrame([(t, t % 4, "ab"[t % 2]) for t in range(40)] + [(7, 2, "a")], "id int, r int, s string")
    got = P.permuted(df, [], "r", "id", "s", 3, 1, lambda counts: counts.groupBy("b").agg(F.sum("n").alias("n")), chunk=9).collect()
    assert {r["b"]: r["n"] for r in got} == {k: 43 for k in (1, 2, 3)}  # both rows of 7 are counted with both
