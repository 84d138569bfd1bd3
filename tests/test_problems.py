"""Units, skew and nested records: problems 1 to 3."""

import json
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.operators import dewey, flatten, skew, units

UNIT_CASES = [
    ("1495000 céntimos por tonelada", 1.5, "Atún 100 gr.", ("kg", 1495, 150)), ("100 GRS = 0,22 Eur", 0.55, "Garbanzo 250 gr. (c/trufa)", ("kg", 220, 55)), ("A 4,83 euros / L", 2.42, "Kéfir 0,5 l s/lactosa", ("l", 483, 242)),
    ("0.54 EUR por ud.", 3.24, "Huevo 6 ud", ("ud", 54, 324)), ("1,935 Eur x ½ kg", 0.77, "Aceitunas 200 gr (al ajillo) ¡Oferta!", ("kg", 387, 77)), ("1€82/1 L", 1092.0, "Leche MIGOGUX 6 unidades de 1000 ml", ("l", 182, 1092)),
    ("8.570,00 Eur/Tm", 4.29, "Arroz 1/2 kg", ("kg", 857, 429)), ("0,0187 €", 0.37, "Leche 0,2 L - precio referido a cl", ("l", 187, 37)), ("3,615", 0.96, "ＫÉＦＩＲ ０，２Ｌ Ｐ．Ｖ．Ｐ． ＰＯＲ ７５０ ＭＬ", ("l", 482, 96)),
    ("(docena: 6,96 EUR)", 6.96, "12 uds. Papel higiénico", ("ud", 58, 696)), ("1,4725 €/1/4 kg", 3.53, "Merluza 0,6 kg Promoción 3x2", ("kg", 589, 353)), ("0.95 EUR/par", None, "Calcetines", ("ud", 48, None)),
    ("€/kg", 1.0, "x", (None, None, 100)), (None, 2.0, "x 1 kg", (None, None, 200)), ("", 2.5, None, (None, None, 250)), ("2,50", 2.5, "Café 1 kg", (None, None, 250)), ("3 €/0 kg", 1.0, "x", (None, None, 100)),
]


def test_units(spark):
    rows = [(i, u, p, t) for i, (u, p, t, _) in enumerate(UNIT_CASES)]
    df = spark.createDataFrame(rows, "pos long, unit_price string, price double, text string").withColumn("base_unit", F.lit("clash"))
    out = units.with_unit_prices(df, "unit_price", "price", ["text"])
    got = {r["pos"]: (r["base_unit"], r["unit_cents"], r["price_cents"]) for r in out.collect()}
    assert got == {i: want for i, (*_, want) in enumerate(UNIT_CASES)}
    assert units.with_unit_prices(df.limit(0), "unit_price", "price", ["text"]).count() == 0


def test_units_default_and_huge_text(spark):
    df = spark.createDataFrame([("A", "2,50", "x " * 200_000), ("B", "2,50", "x")], "s string, unit_price string, t string").withColumn("price", F.lit(1.0))
    out = {r["s"]: (r["base_unit"], r["unit_from"]) for r in units.with_unit_prices(df, "unit_price", "price", ["t"], "s", {"A": "kg"}).collect()}
    assert out == {"A": ("kg", "default"), "B": (None, None)}


def test_latest_per_key_on_skew_ties_and_nulls(spark):
    random.seed(1)
    rows = [(random.choice(["hot"] * 6 + ["a", "b", "c", None]), random.choice([None, 1, 2, 3]), i) for i in range(900)] + [("gone", None, 901), ("a", 3, 902), ("a", 3, 902)]
    df = spark.createDataFrame(rows, "k string, t int, pos long")
    best = {}
    for k, t, p in rows:
        if k is not None and t is not None:
            best[k] = max(best.get(k, (0, 0)), (t, p))
    assert {r["k"]: (r["t"], r["pos"]) for r in skew.latest_per_key(df, "k", "t", "pos").collect()} == best
    assert skew.latest_per_key(df.limit(0), "k", "t", "pos").count() == 0


def test_plan_balances_and_join_is_a_join(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i) for i in range(3000)] + [(None, 5000)]
    left = spark.createDataFrame(rows, "k string, i long")
    plan = skew.plan_loads(left, "k", 6)
    assert max(plan.task_load) < 1.3 * len(rows) / 6 and len(plan.heavy) <= 6 * skew.HEAVY_PARTS and len(set(plan.heavy["hot"])) > 2
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4), ("zz", 5)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = Counter(map(tuple, skew.fragment_replicate_join(left, right, "k", F.col("i"), how, plan).collect()))
        assert got == Counter(map(tuple, left.join(right, "k", how).collect())), how
    parts = skew.spread(left, "k", F.col("i"), plan).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 1.3 * len(rows) / 6


NESTED = st.recursive(st.none() | st.integers(0, 9) | st.text("ab", max_size=2), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["x", "p", "q", "r"]), c, max_size=3), max_leaves=12)
ARRAYS = ("x", "p", "q", "r")


def _walk(value, level, prefix):
    out = []
    for i, x in enumerate(value if isinstance(value, list) else [value] if isinstance(value, dict) else []):
        if isinstance(x, dict):
            out.append(f"{prefix}{ARRAYS[level]}.{i}")
            if level < 3:
                out += _walk(x.get(ARRAYS[level + 1]), level + 1, f"{prefix}{ARRAYS[level]}.{i}.")
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(NESTED, min_size=1, max_size=25))
def test_dewey_is_a_walk(spark, values):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(100, None), (101, ""), (102, '[{"p":'), (103, '[{"p":[1,{"q":{}}]}]')]
    nodes = dewey.dewey_nodes(spark.createDataFrame(rows, "id long, t string"), "id", "t", ARRAYS).collect()
    want = [(i, p) for i, v in enumerate(values) for p in _walk(v, 0, "")] + [(103, p) for p in ("x.0", "x.0.p.1", "x.0.p.1.q.0")]
    assert Counter((r["id"], r["path"]) for r in nodes) == Counter(want)
    paths = {(r["id"], r["path"]) for r in nodes}
    assert all(r["parent_path"] is None or (r["id"], r["parent_path"]) in paths for r in nodes)


def test_dewey_table(spark):
    df = spark.createDataFrame([(1, '[{"id":"a","price":"2.5"},null,{"old":"b","price":null}]')], "id long, t string")
    nodes = dewey.dewey_nodes(df, "id", "t", ("x",))
    rows = dewey.dewey_table(nodes, "id", "x", {"key": (["$.id", "$.old"], "string"), "price": (["$.price"], "double")}).orderBy("path").collect()
    assert [tuple(r)[1:] for r in rows] == [("x.0", None, 0, "a", 2.5), ("x.2", None, 2, "b", None)]


DOC = '{"id":1,"u":{"v":2,"w":{}},"similar_products":[{"id":"x","d":null},[1,2]],"e":[],"t":"s"}'


def test_flatten(spark):
    df = spark.createDataFrame([(1, DOC), (2, "[{\"a\":1},5,{\"a\":{\"b\":[]}}]"), (3, "7"), (4, None), (5, "{bad")], "r long, t string")
    rows = flatten.flatten_json(df, "r", "t").collect()
    assert {(r["path"], r["value"], r["is_null"]) for r in rows if r["r"] == 1} == {("id", "1", False), ("u.v", "2", False), ("similar_products.0.id", "x", False), ("similar_products.0.d", None, True), ("similar_products.1", "[1,2]", False), ("t", "s", False)}
    assert [(r["item"], r["path"]) for r in rows if r["r"] != 1] == [(0, "a")]


def test_ragged_table(spark):
    items = ",".join(f'{{"k":{i}}}' for i in range(12))
    df = spark.createDataFrame([(1, f'{{"s":[{items}]}}'), (2, '{"s":null}')], "r long, t string")
    assert flatten.header(df, "r", "t")[:4] == ["s", "s.0.k", "s.1.k", "s.10.k"]
    rows = {r["r"]: r.asDict() for r in flatten.ragged_table(df, "r", "t").collect()}
    assert rows[1]["s"] == "Not found" and rows[1]["s.10.k"] == "10" and rows[2]["s"] == "" and rows[2]["s.2.k"] == "Not found"


def test_units_are_a_parameter_with_offsets(spark):
    listed = [("kg", "kg", 1000, 0), ("lb", "kg", 454, 0), ("tarro", "kg", 400, 50), ("ud", "ud", 1000, 0)]
    rows = [(1, "4,54 €/lb", 9.08, "Miel 2 lb"), (2, "9 €/tarro", 9.0, "Miel 1 tarro"), (3, "1 €/l", 1.0, "Agua 1 l")]
    df = spark.createDataFrame(rows, "pos long, unit_price string, price double, description string")
    got = {r["pos"]: (r["base_unit"], r["unit_cents"], r["content"]) for r in units.with_unit_prices(df, "unit_price", "price", ["description"], units=listed).collect()}
    assert got == {1: ("kg", 1000, 0.908), 2: ("kg", 2000, 0.45), 3: (None, None, None)}
