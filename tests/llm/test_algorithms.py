import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import nearest_time as nt
from tidewright.llm import shape_clusters as sc
from tidewright.llm import vector_neighbors as vn

# nearest vectors


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "id bigint, v array<double>")


def brute(x, k, far=None):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i and (far is None or d[j] <= far)]
        out[i] = order[:k]
    return out


def collected(df):
    got = {}
    for r in df.orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    return got


def test_near_copies_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(vn, "PART_ROWS", 100)
    monkeypatch.setattr(vn, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 5, (600, 12))
    x[300:400] = x[:100] + rng.normal(0, 0.05, (100, 12))
    got = collected(vn.nearest_vectors(vectors(spark, x), 5, 12, max_distance=1.0))
    want = {i: n for i, n in brute(x, 5, 1.0).items() if n}
    assert got == want


def test_recall_without_a_distance(spark, monkeypatch):
    monkeypatch.setattr(vn, "PART_ROWS", 150)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (900, 10)) + 4 * rng.integers(0, 3, (900, 1))
    got, want = collected(vn.nearest_vectors(vectors(spark, x), 5, 10, queries="id % 20 = 0")), brute(x, 5)
    assert set(got) == set(range(0, 900, 20))
    assert sum(len(set(got[i]) & set(want[i])) for i in got) / (5 * len(got)) >= 0.9


def test_copies_ties_and_odd_rows(spark):
    same = [[1.0, 2.0]] * 40
    got = collected(vn.nearest_vectors(vectors(spark, np.array([*same, [9.0, 9.0]])), 3, 2))
    assert got[0] == [1, 2, 3] and got[39] == [0, 1, 2] and got[40] == [0, 1, 2]
    raw = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.5])], "key bigint, x array<double>").withColumn("id", F.lit("clash"))
    v = vn.usable_vectors(raw, "key", "x")
    assert collected(vn.nearest_vectors(v, 5, 2)) == {1: [7], 7: [1]}
    assert vn.nearest_vectors(v.where("id > 99"), 5, 2).count() == 0
    assert vn.nearest_vectors(v.where("id = 1"), 5, 2).count() == 0
    assert vn.nearest_vectors(v, 5, 2, max_distance=0.1).count() == 0


@pytest.mark.parametrize("top", [256, 4])
def test_long_vectors_and_two_levels(spark, monkeypatch, top):
    monkeypatch.setattr(vn, "PART_ROWS", 60)
    monkeypatch.setattr(vn, "TOP_PARTS", top)
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (900, 100))
    x[600:700] = x[:100] + rng.normal(0, 0.2, (100, 100))
    x[700] = x[5] + 1e6  # too large for 16 bits
    x[701] = x[700] + 0.01
    got = collected(vn.nearest_vectors(vectors(spark, x), 5, 100, max_distance=4.0))
    assert got == {i: n for i, n in brute(x, 5, 4.0).items() if n} and len(got) > 200
    some = collected(vn.nearest_vectors(vectors(spark, x), 3, 100, queries="id % 20 = 0", exact=True))
    want = brute(x, 3)
    assert some == {i: want[i] for i in range(0, 900, 20)}


def test_crowded_vectors_ask_by_whole_vectors(spark, monkeypatch):
    monkeypatch.setattr(vn, "DENSE", 4)
    monkeypatch.setattr(vn, "PART_ROWS", 80)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 3, (500, 8))
    x[:150] = x[0] + rng.normal(0, 0.01, (150, 8))
    x[150:200] = x[200:250] + rng.normal(0, 0.05, (50, 8))
    got = collected(vn.nearest_vectors(vectors(spark, x), 3, 8, max_distance=1.0))
    assert got == {i: n for i, n in brute(x, 3, 1.0).items() if n}


def test_arrays_of_arrays(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[1.0, 2.0], [3.0, 4.5]]), (3, [[1.0, 2.0], [3.0]]), (4, [[1.0, 2.0], None]), (5, [[1.0, 2.0]]), (6, None), (7, [[0.0, 0.0], [0.0, 0.0]]), (8, [[1.0, None], [1.0, 2.0]])]
    v = vn.usable_vectors(spark.createDataFrame(rows, "id bigint, v array<array<double>>"), "id", "v")
    assert collected(vn.nearest_vectors(v, 5, (2, 2))) == {1: [2], 2: [1]}


def test_graph_cut_is_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    label = vn.cut_graph(x, vn._nearest(x, 8), 7)
    assert np.bincount(label, minlength=7).max() <= np.ceil(1.1 * 400 / 7) + 1 and len(set(label)) == 7


# clusters


def shapes():
    t = np.arange(91)
    bell = lambda c, s: np.exp(-((t - c) ** 2) / (2 * s**2))
    return np.array([bell(30, 3) - 0.4 * bell(42, 6), -bell(30, 5) + 0.8 * bell(50, 8), bell(30, 4) - bell(38, 4)])


def waves(spark, rows):
    return spark.createDataFrame([(i, None if w is None else [None if v is None else float(v) for v in w], "r") for i, w in rows], "sid bigint, w array<double>, cluster string")


def test_clusters_of_shape(spark):
    rng, s = np.random.default_rng(3), shapes()
    rows, truth = [], {}
    for i in range(180):
        k = i % 3
        rows.append((i, rng.uniform(0.5, 2) * (np.roll(s[k], rng.integers(-4, 5)) + rng.normal(0, 0.04, 91))))
        truth[i] = k
    rows += [(500 + i, rng.normal(0, 0.3, 91)) for i in range(10)]
    rows += [(600 + i, s[0] + 0.9 * np.roll(s[1], 9 + i) + rng.normal(0, 0.02, 91)) for i in range(4)]
    rows += [(700, None), (701, [1.0] * 20), (702, [float("nan")] * 91), (703, [None] * 91), (704, [0.0] * 91), (None, s[0]), (0, rows[0][1])]
    members, clusters = sc.shape_clusters(waves(spark, rows), "sid", "w", 91)
    got = {r["sid"]: r["cluster"] for r in members.collect()}
    assert len(got) == 180 + 14 + 5
    names = {}
    for i, k in truth.items():
        names.setdefault(k, set()).add(got[i])
    kept = {k: v - {None} for k, v in names.items()}
    assert all(len(v) == 1 for v in kept.values()) and len(set().union(*kept.values())) == 3
    assert sum(got[i] is None for i in truth) <= 4 and all(got[i] is None for i in got if i >= 500)
    c = clusters.collect()
    assert len(c) == 3 and sum(r["size"] for r in c) == sum(v is not None for v in got.values())
    assert all(got[r["medoid"]] == r["cluster"] and r["medoid"] == r["typical"][0] for r in c)


def test_a_cluster_needs_rows_not_a_share(spark):
    rng, s = np.random.default_rng(8), shapes()
    rare = np.exp(-((np.arange(91) - 33) ** 2) / 32) - 0.7 * np.exp(-((np.arange(91) - 55) ** 2) / 60)
    rows = [(i, rng.uniform(0.5, 2) * (np.roll(s[i % 3], rng.integers(-4, 5)) + rng.normal(0, 0.03, 91))) for i in range(6000)]
    rows += [(7000 + i, rng.uniform(0.5, 2) * (np.roll(rare, rng.integers(-4, 5)) + rng.normal(0, 0.03, 91))) for i in range(20)]
    rows += [(8000 + i, rng.normal(0, 0.3, 91)) for i in range(300)]
    members, clusters = sc.shape_clusters(waves(spark, rows), "sid", "w", 91)
    got = {r["sid"]: (r["cluster"], r["similarity"]) for r in members.collect()}
    found = [got[7000 + i][0] for i in range(20)]
    assert len(set(found) - {None}) == 1 and sum(f is None for f in found) <= 1
    assert len({got[i][0] for i in range(6000)} - {None, *found}) == 3 and all(got[8000 + i][0] is None for i in range(300))
    for c in clusters.collect():  # the typical members are the most similar ones of all
        inside = sorted((-v[1], i) for i, v in got.items() if v[0] == c["cluster"])
        assert c["typical"] == [i for _, i in inside[:3]] and c["size"] == len(inside)


def test_clusters_of_nothing_and_of_copies(spark):
    for rows in ([], [(1, None)], [(1, shapes()[0])]):
        members, clusters = sc.shape_clusters(waves(spark, rows), "sid", "w", 91)
        assert members.count() == len(rows) and clusters.count() == 0
    members, clusters = sc.shape_clusters(waves(spark, [(i, shapes()[0]) for i in range(30)]), "sid", "w", 91)
    assert clusters.first()["size"] == 30


def test_similarity_ignores_gain_and_shift():
    s = shapes()
    x = np.array([3 * np.roll(s[0], 5), s[1]])
    best, arg = sc.similarity(x, s, 8)
    assert best[0, 0] > 0.999 and arg[0, 0] == 5 and best[1, 1] > 0.999 and best[0, 1] < 0.9


# nearest time


def events(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} bigint, rec string, us bigint, loaded_at int").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, us / 1000000.0)"))


def test_nearest_time(spark):
    left = events(spark, [(1, "a", 1000, 1), (1, "a", 1000, 2), (2, "a", 5000, 1), (3, "b", 1000, 1), (4, None, 1000, 1), (5, "a", None, 1), (None, "a", 1000, 1), (6, "a", 10_000, 1)], "did")
    right = events(spark, [(10, "a", 1300, 1), (11, "a", 700, 1), (12, "a", 5500, 1), (12, "a", 5500, 2), (13, "b", 1501, 1), (14, None, 1000, 1), (15, "a", 9999, 1), (16, "a", 10_002, 1), (9, "a", 1300, 1)], "sid")
    args = ("did", "sid", "rec", "rec", "ts", "ts", 500)
    got = {r["did"]: (r["sid"], r["diff_us"]) for r in nt.nearest_in_time(left, right, *args).collect()}
    assert got == {1: (11, -300), 2: (12, 500), 6: (15, -1)}
    every = {r["did"]: r["sid"] for r in nt.nearest_in_time(left, right, *args, keep_unmatched=True).collect()}
    assert every == {1: 11, 2: 12, 3: None, 4: None, 5: None, 6: 15}
    assert nt.nearest_in_time(left.where("did > 99"), right, *args).count() == 0
    assert nt.nearest_in_time(left, right.where("sid > 99"), *args).count() == 0
    with pytest.raises(ValueError):
        nt.nearest_in_time(left, right, "did", "sid", "rec", "rec", "ts", "ts", -1)


def test_nearest_time_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = np.sort(rng.integers(0, 60_000, 150)), np.sort(rng.integers(0, 60_000, 150))
    left = events(spark, [(i, "hot", int(t), 0) for i, t in enumerate(a)], "did")
    right = events(spark, [(i, "hot", int(t), 0) for i, t in enumerate(b)], "sid")
    got = {r["did"]: abs(r["diff_us"]) for r in nt.nearest_in_time(left, right, "did", "sid", "rec", "rec", "ts", "ts", 300).collect()}
    want = {i: int(np.abs(b - t).min()) for i, t in enumerate(a) if np.abs(b - t).min() <= 300}
    assert got == want
