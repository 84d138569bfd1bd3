import numpy as np
from pyspark.sql import functions as F

from cotejo import session
from cotejo.operators import matching, skew
from cotejo.operators.vectors import knn_join, nearest
from cotejo.sources import readers


def _frame(spark, rows):
    return spark.createDataFrame([(int(p), k, [float(x) for x in v] if v is not None else None) for p, k, v in rows], "pos long, k string, v array<double>")


def _data(seed, n, m):
    rng = np.random.default_rng(seed)
    make = lambda n, start: [(start + i, "xyz"[rng.integers(3)], rng.integers(0, 4, 3)) for i in range(n)]
    return make(n, 0), make(m, 1000)


def _brute(a, b, k):
    out = []
    for p, key, v in a:
        near = sorted((float(((v - w) ** 2).sum()), q) for q, key2, w in b if key2 == key)[:k]
        out += [(p, q, d) for d, q in near]
    return sorted(out)


def test_knn_is_brute_force_with_ties_and_blocks(spark):
    a, b = _data(1, 40, 60)
    for block in (7, 4096):
        found = knn_join(_frame(spark, a), _frame(spark, b), ["k"], "pos", "v", 3, block_rows=block)
        assert sorted((r["a_pos"], r["b_pos"], r["distance"]) for r in found.collect()) == _brute(a, b, 3)


def test_knn_leaves_out_nulls_and_empties(spark):
    a = _frame(spark, [(1, "x", [0, 0]), (2, None, [0, 0]), (3, "x", None), (4, "x", []), (5, "only", [1, 1])])
    b = _frame(spark, [(9, "x", [1, 0])])
    assert [(r["a_pos"], r["b_pos"]) for r in knn_join(a, b, ["k"], "pos", "v").collect()] == [(1, 9)]
    assert knn_join(a.limit(0), b, [], "pos", "v").count() == 0


def test_kernel_returns_fewer_than_k():
    r, c, d = nearest(np.zeros((2, 3)), np.ones((1, 3)), np.array([0]), 5, "l2")
    assert list(r) == [0, 1] and list(c) == [0, 0] and list(d) == [3, 3]


def test_one_to_one_and_properties(spark):
    a, b = _data(2, 50, 30)
    found = matching.match(_frame(spark, a), _frame(spark, b), ["k"], "pos", "v").collect()
    best = {}
    for p, q, d in _brute(a, b, 1):
        best[q] = min(best.get(q, (9e9, 0)), (d, p))
    assert {r["b_pos"]: (r["distance"], r["a_pos"]) for r in found} == best


def test_global_is_greedy(spark):
    rng = np.random.default_rng(3)
    edges = {(int(i), int(j)): float(rng.integers(1, 9)) for i, j in rng.integers(0, 15, (60, 2))}
    df = spark.createDataFrame([(i, j, d) for (i, j), d in edges.items()] + [(1, 1, None)], "a_pos long, b_pos long, distance double")
    got = {(r["a_pos"], r["b_pos"]) for r in matching.match_global(df).collect()}
    used_a, used_b, want = set(), set(), set()
    for d, i, j in sorted((d, i, j) for (i, j), d in edges.items()):
        if i not in used_a and j not in used_b:
            want.add((i, j)), used_a.add(i), used_b.add(j)
    assert got == want
    assert matching.match_global(df.limit(0)).count() == 0


def test_a_row_in_two_buckets_is_ranked_in_each(spark):
    a = _frame(spark, [(1, "x", [0, 0]), (1, "y", [0, 0])])
    b = _frame(spark, [(10, "x", [1, 0]), (11, "y", [3, 0])])
    found = {(r["k"], r["a_pos"], r["b_pos"]) for r in knn_join(a, b, ["k"], "pos", "v").collect()}
    assert found == {("x", 1, 10), ("y", 1, 11)} == {(r["k"], r["a_pos"], r["b_pos"]) for r in matching.match(a, b, ["k"], "pos", "v").collect()}


def _replay(buckets):
    """Buckets (kind, a rows, b rows of pos, id, vector) one after the other, marks of ids and places in one set."""
    used, out = set(), []
    for name, kind, left, right in buckets:
        right = right if kind == "brand" else [r for r in right if r[1] not in used]
        if not left or not right:
            continue
        pairs = []
        for p, _, v, key in left:
            near = [(float(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, (_, _, w, key2) in enumerate(right) if kind != "brand" or key == key2]
            if near:
                pairs.append((*min(near)[:1], p, min(near)[1]))
        for distance, p, j in sorted(pairs):
            mark = right[j][1] if kind == "brand" else j
            if mark not in used:
                used.add(mark)
                out.append((name, kind, p, right[j][0]))
    return out


def test_compat_is_a_replay_in_order(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        rows = {"a": [], "b": []}
        for side, n, start in (("a", 40, 0), ("b", 30, 100)):
            for i in range(n):
                kind, key = ("brand", "PQ"[rng.integers(2)]) if rng.integers(2) else ("no_brand", "")
                for bucket in sorted(set(rng.integers(0, 3, 2))):
                    rows[side].append((start + i, f"id{i % 25}", f"c{bucket}", kind, key, [float(x) for x in rng.integers(0, 5, 2)]))
        buckets = []
        for name in ("c0", "c1", "c2"):
            for kind in ("brand", "no_brand"):
                pick = lambda side: [(p, i, v, key) for p, i, c, k, key, v in sorted(rows[side]) if (c, k) == (name, kind)]  # noqa: E731, B023
                buckets.append((name, kind, pick("a"), pick("b")))
        frame = lambda side: spark.createDataFrame(rows[side], "pos long, id string, bucket string, brand_type string, brand_key string, v array<double>")  # noqa: E731, B023
        got = {(r["bucket"], r["brand_type"], r["a_pos"], r["b_pos"]) for r in matching.match_compat(frame("a"), frame("b"), "bucket", "pos", "v").collect()}
        assert got == set(_replay(buckets))


def test_places_within_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(("hot" if rng.integers(3) else f"k{i % 4}"), i) for i in range(200)]
    want = {(k, p): sorted(q for k2, q in rows if k2 == k).index(p) for k, p in rows}
    got = {(r["k"], r["p"]): r["n"] for r in matching.numbered(spark.createDataFrame(rows, "k string, p long"), ["k"], "p", "n").collect()}
    assert got == want


def test_placement_survives_the_join(spark):
    keys = ["hot" if i % 3 == 0 else "warm" if i % 5 == 0 else f"k{i % 997}" for i in range(20_000)]
    df = spark.createDataFrame([(k if i % 50 else None, i) for i, k in enumerate(keys)], "k string, row long")
    right = df.select("k").where("k is not null").distinct().withColumn("x", F.length("k"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left_anti", "left"):
            want = {"inner": df.where("k is not null").count(), "left": 20_000, "left_anti": df.where("k is null").count()}[how]
            out = skew.fragment_replicate_join(df, right, "k", F.col("row"), how, skew.plan_loads(df, "k", 4))
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == want
            if how != "left_anti":
                assert max(sizes) < 1.3 * want / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_cuts_are_deleted_when_replaced(spark):
    one = session.cut(spark.range(5))
    folder = one._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    two = session.cut(one.where("id > 2"), before=one)
    assert not readers.exists(spark, folder) and two.count() == 2
    session.release(two, spark.range(3))
