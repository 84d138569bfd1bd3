from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.functions import text

CASES = [
    ("Alimentación General > Bebés", "alimentacion general bebes", "alimentacion-general/bebes"), ("Piña Colada 0,5L ¡Oferta!", "pina colada oferta", "pina-colada-05l-oferta"),
    ("bebidas/agua/agua-con-gas", "bebidasaguaaguacongas", "bebidas/agua/agua-con-gas"), ("bebes-0-12", "", "bebes-0-12"), ("foo_bar 3x", "foo_bar", "foo-bar-3x"), ("12.5 a-1 b", "b", "125-a-1-b"),
    ("Ångström ß œ ø", "angstrom ß œ ø", "angstrom"), ("½ kg ²", "½ kg ²", "kg"), ("-/a b/-", "a b", "a-b"), ("-/-a", "a", "-a"), ("Niño-- 0-12 ", "nino", "nino-0-12"), ("A_B > C", "a_b c", "a-b/c"), ("", "", ""),
]


def test_normalize_and_slug(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in CASES], "t string")
    rows = df.select("t", text.normalize(F.col("t")).alias("n"), text.slug(F.col("t")).alias("s")).collect()
    assert {(r["t"], r["n"], r["s"]) for r in rows} == set(CASES)


def test_null_texts(spark):
    row = spark.createDataFrame([(None,)], "t string").select(text.normalize(F.col("t")).alias("n"), text.slug(F.col("t")).alias("s")).first()
    assert (row["n"], row["s"]) == ("", None)


def test_stopwords_and_lists(spark):
    df = spark.createDataFrame([("Leche de la casa", ["Ñu 1", None])], "t string, a array<string>")
    row = df.select(text.normalize(F.col("t"), text.stopwords()).alias("n"), text.normalize_all(F.col("a")).alias("a")).first()
    assert row["n"] == "leche casa" and row["a"] == ["nu", ""]


def test_accents_deep(spark):
    schema = "x struct<a: string, b: array<struct<c: string, n: int>>, m: map<string, string>>"
    df = spark.createDataFrame([((("é", [("ñ", 1)], {"é": "ü"})),), (None,)], schema)
    rows = df.select(text.strip_accents_deep(F.col("x"), df.schema["x"].dataType).alias("x")).collect()
    assert rows[0]["x"].asDict(True) == {"a": "e", "b": [{"c": "n", "n": 1}], "m": {"é": "u"}} and rows[1]["x"] is None
    assert isinstance(df.schema["x"].dataType, T.StructType)
