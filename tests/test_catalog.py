from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.functions import products as P
from cotejo.operators import catalog, categories, dedup


def test_white_label(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "chef"), (4, "MAKRO CHEF XL"), (5, "EROSKI"), (6, "Otra")], "i int, brand string")
    rows = catalog.classify_brands(df, ["Makro Chef", "EROSKI", "BRAND:none", "NO BRAND"]).collect()
    assert {r["i"]: r["brand_type"] for r in rows} == {1: "no_brand", 2: "no_brand", 3: "no_brand", 4: "brand", 5: "no_brand", 6: "brand"}


def test_rare_brands(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (3, "A", "y"), (4, "B", "x")], "i int, brand string, side string")
    rows = catalog.classify_brands(df, ["q"], 2, ["side"]).collect()
    assert {r["i"]: r["brand"] for r in rows} == {1: "A", 2: "A", 3: "NO BRAND", 4: "NO BRAND"}


def test_product_text(spark):
    schema = "supermarket string, description string, denomination string, brand string, raw_ingredients string, nutrition_information struct<calories: struct<value: string>, fat: struct<value: string>, protein: struct<value: string>, carbohydrates: struct<value: string>>"
    rows = [("EROSKI", "Leche 1L", None, "Púleva", "leche", (("12",), (None,), None, ("3",))), ("Makro", None, "12 345", "NO BRAND", None, None), ("Otro", "x", "y", "b", None, None)]
    out = catalog.product_texts(spark.createDataFrame(rows, schema)).select("product_concatenation").collect()
    assert [r[0] for r in out] == ["leche puleva leche calories fat none protein none carbs", "b"]


def test_legacy_text(spark):
    df = spark.createDataFrame([(10.0, "4"), (10.0, None), (10.0, ""), (10.0, "abc"), (10.0, "0"), (None, "2")], "p double, v string")
    text = P.legacy_product_text(F.lit("n"), F.lit("b"), F.col("p"), F.col("v"), F.lit("f"), F.lit("kg"))
    got = [r[0] for r in df.select(text).collect()]
    assert got[0] == "n, BRAND: b, UNIT PRICE: 2.5, FORMAT: f, AMOUNT: 4 kg" and "UNIT PRICE: 10.0" in got[1] and "UNIT PRICE: 10.0" in got[2] and got[3:] == [None, None, None]


def test_category_pairs_and_empty_patterns(spark):
    entries = [("A > B", "a/b", 0.9), ("A > B", "a/b", 0.9), ("bebes-0-12", "x", 0.9), ("C", None, 0.1)]
    maps = spark.createDataFrame([("E", "M", entries)], "s string, t string, mapping_results array<struct<source_category: string, matched_target_category: string, similarity_score: double>>")
    assert [tuple(r) for r in catalog.category_pairs(maps).collect()] == [("ab", "ab")]
    assert catalog.category_pairs(maps, keep_empty=True).count() == 2


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab", max_size=4), min_size=1, max_size=12), st.sets(st.text("ab", max_size=3), min_size=1, max_size=6))
def test_prefix_join_is_startswith(spark, values, patterns):
    df = spark.createDataFrame(list(enumerate(values)) + [(99, None)], "i int, v string")
    found = catalog.prefix_join(df, "v", spark.createDataFrame([(p,) for p in patterns], "p string"), "p")
    assert sorted((r["i"], r["p"]) for r in found.collect()) == sorted((i, p) for i, v in enumerate(values) for p in patterns if v.startswith(p))


def test_last_wins_keeps_first_place(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None), (None, 4, "z")], "id string, pos int, v string")
    assert sorted((str(r["id"]), r["pos"], r["v"], r["first_pos"]) for r in dedup.last_wins(df, ["id"], "pos").collect()) == [("None", 4, "z", 4), ("a", 3, None, 1), ("b", 2, "y", 2)]


def test_first_pair_wins(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "0", "b"), (4, "0", "b"), (5, None, "b")], "pos int, a string, b string")
    assert sorted(r["pos"] for r in dedup.first_pair_wins(df, "a", "b", "pos").collect()) == [1, 3, 4, 5]


def test_translation_and_golden_set(spark):
    words = spark.createDataFrame([("milk",), ("egg",), (None,)], "w string")
    assert {r["w"]: r["translated"] for r in categories.translate(words, "w", spark.createDataFrame([("milk", "leche")], "original string, translated string")).collect()} == {"milk": "leche", "egg": "egg", None: None}
    pairs = spark.createDataFrame([([["a "], ["x", "y"]],), ([["b"], []],), ([[], ["z"]],), ([["bad"]],), (None,)], "pair array<array<string>>")
    assert sorted((r[0], str(r[1])) for r in categories.expand_golden_set(pairs).collect()) == [("a", "x"), ("a", "y"), ("b", "None")]


def test_bucket_pairing(spark):
    a, b = spark.createDataFrame([("k", "x"), ("k", "x"), ("l", "x")], "c string, t string"), spark.createDataFrame([("k", "x")], "c string, t string")
    assert sorted(tuple(r) for r in catalog.bucket_pairing(a, b, ["c", "t"]).collect()) == [("k", "x", 2, 1, True), ("l", "x", 1, 0, False)]
