import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import rpforest


def _vectors(seed=0, n=1500, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 3, dim))
    v = np.repeat(centres, 3, axis=0) + rng.normal(size=(n // 3 * 3, dim)) * 0.12
    return v * rng.uniform(0.3, 9, (len(v), 1))


def _brute(ids, v, k, floor):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {tuple(sorted((ids[i], ids[j]))) for i in range(len(v)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= floor}


def _frame(spark, ids, v, extra=()):
    rows = [(int(i), [float(np.float32(x)) for x in row]) for i, row in zip(ids, v, strict=True)] + list(extra)
    return spark.createDataFrame(rows, "id long, v array<float>").repartition(3)


BAD = [(9001, None), (9002, []), (9003, [1.0]), (9004, [0.0] * 16), (9005, [float("nan")] * 16), (9006, [float("inf")] + [1.0] * 15), (9007, [None] + [1.0] * 15)]


@pytest.mark.parametrize("block", [4096, 40])
def test_recall_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rpforest, "BLOCK_ROWS", block)
    monkeypatch.setattr(rpforest, "LEAF_ROWS", 128)
    v = np.float32(_vectors()).astype(float)
    ids = np.arange(len(v)) * 7
    found = rpforest.similar_pairs(_frame(spark, ids, v, BAD), "id", "v", 16, 5, 0.9)
    got, want = {tuple(r) for r in found.collect()}, _brute(ids.tolist(), v, 5, 0.9)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)


def test_copies_fill_the_places(spark):
    v = np.float32(_vectors(1, 90)).astype(float)
    hot = [(5000 + i, [float(x) * (1 + i % 3) for x in np.float32(v[0])]) for i in range(60)]
    df = _frame(spark, range(90), v, hot).withColumn("near", F.lit("clash")).select("id", "v", "near")
    rows = rpforest.most_similar(df, "id", "v", 16, 5, 0.9).collect()
    of = {}
    for r in rows:
        of.setdefault(r["id"], []).append((r["near"], round(r["cosine"], 6)))
    assert sorted(of[5059]) == sorted((n, 1.0) for n in (0, 5000, 5001, 5002, 5003)) and sorted(n for n, _ in of[0]) == [5000, 5001, 5002, 5003, 5004]
    assert all(len(x) <= 5 for x in of.values())


def test_own_leaves_come_first_and_queue_is_ordered():
    u = _vectors(2, 300)
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
    forest = rpforest.fit(u, 3, 4)
    leaves = forest.leaves(u, 12)
    assert (np.sort(leaves[:, :4] // 8, axis=1) == np.arange(4)).all() and all(len(set(r)) == 12 for r in leaves.tolist())
    sizes = np.bincount(leaves[:, :4].ravel(), minlength=32)
    assert sizes.max() <= 2 * 300 / 8
    assert (rpforest.fit(u, 0, 2).leaves(u, 5) >= 0).all()


def test_empty(spark):
    assert rpforest.similar_pairs(_frame(spark, [], np.zeros((0, 16)), BAD), "id", "v", 16, 5, 0.9).count() == 0


def _recall(rows, u, some, k):
    got = {}
    for r in rows:
        got.setdefault(r[0], set()).add(r[1])
    s = u[some] @ u.T
    s[np.arange(len(some)), some] = -2
    want = {int(i): set(np.argsort(-x, kind="stable")[:k].tolist()) for i, x in zip(some, s, strict=True)}
    return sum(len(got.get(i, set()) & x) for i, x in want.items()) / (k * len(some))


def test_neighbours_of_any_cosine_are_found(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(9000, 64))
    v[:3000] = rng.normal(size=64) + v[:3000] * 0.3  # a third is crowded
    u = np.float32(v / np.linalg.norm(v, axis=1, keepdims=True))
    rows = rpforest.most_similar(_frame(spark, range(9000), u), "id", "v", 64, 5).collect()
    assert len(rows) == len({(r["id"], r["near"]) for r in rows}) == 45_000
    assert _recall(rows, u, np.arange(0, 3000, 10), 5) >= 0.99 and _recall(rows, u, np.arange(3000, 9000, 20), 5) >= 0.99


@pytest.mark.parametrize("rows", [2000, 8000])
def test_probes_follow_the_target(spark, monkeypatch, rows):
    monkeypatch.setattr(rpforest, "COPY_ROWS", 0)
    monkeypatch.setattr(rpforest, "MOST_PROBES", 400)
    asked, leaves = [], rpforest.probes_needed
    monkeypatch.setattr(rpforest, "probes_needed", lambda *x: asked.append(leaves(*x)) or asked[-1])
    v = np.random.default_rng(6).normal(size=(rows, 8))
    u = np.float32(v / np.linalg.norm(v, axis=1, keepdims=True))
    reps = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(u)], "rep long, unit binary")
    found = rpforest.neighbours(reps, 8, 5, -1.0, leaf_rows=64).select("rep", "near").collect()
    assert asked[0] > rpforest.PROBES and asked[0] * 64 < rows * 2
    assert _recall(found, u, np.arange(0, rows, rows // 400), 5) >= 0.98


def test_recall_where_the_sample_binds(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "LEAST_SAMPLE", 512)
    monkeypatch.setattr(rpforest, "MOST_SAMPLE", 1024)
    monkeypatch.setattr(rpforest, "COPY_ROWS", 0)
    fitted, fit = [], rpforest.fit
    monkeypatch.setattr(rpforest, "fit", lambda sample, depth, *x: fitted.append((len(sample), depth)) or fit(sample, depth, *x))
    v = np.float32(_vectors(8, 9000)).astype(float)
    u = np.float32(v / np.linalg.norm(v, axis=1, keepdims=True))
    reps = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(u)], "rep long, unit binary")
    found = rpforest.neighbours(reps, 16, 5, 0.9, leaf_rows=40).select("rep", "near").collect()
    assert fitted[0] == (1024, 8)  # 9,000 rows in 256 leaves, 4 rows of the sample for each
    s = (u @ u.T).astype(float)
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(0, 9000, 20) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.9}
    assert len(want & {tuple(r) for r in found}) >= 0.95 * len(want)


def test_near_copies_keep_their_cosine(spark):
    v = np.eye(8)[:2].repeat(2, 0) + np.array([0, 1e-3, 0, 0])[:, None] * np.eye(8)[2]
    rows = rpforest.most_similar(_frame(spark, range(4), v), "id", "v", 8, 1).collect()
    assert {r["id"]: r["near"] for r in rows} == {0: 1, 1: 0, 2: 3, 3: 2}
    assert {r["id"]: r["cosine"] for r in rows}[0] < 1 == {r["id"]: r["cosine"] for r in rows}[3]
