import dataclasses
import json
import pathlib
import subprocess
import sys
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.functions.encoders import HashingEncoder, MeanTokenEncoder, main_words
from cotejo.operators import catalog, categories
from cotejo.plans import pipeline
from cotejo.sources import readers, schemas, sinks
from cotejo.streaming import incremental


def _products(path):
    rows = [
        {"id": "007", "supermarket": "EROSKI", "description": "Leche entera Pulva", "brand": "Pulva", "category": "Lácteos > Leche", "price": 1.0, "unit_price": "1 €/l"},
        {"id": "008", "supermarket": "EROSKI", "description": "Arroz redondo", "brand": "EROSKI", "category": "Lácteos > Leche", "price": 2.0},
        {"id": "M1", "supermarket": "Makro", "denomination": "Leche entera Pulva 1L", "brand": "PULVA", "category": "lacteos/leche/entera", "price": 1.1},
        {"id": "M2", "supermarket": "Makro", "denomination": "Arroz redondo extra", "brand": None, "category": "lacteos/leche", "price": 2.1},
        {"id": "M3", "supermarket": "Makro", "denomination": "12 345", "brand": None, "category": "lacteos/leche", "price": 2.1},
    ]
    path.write_text(json.dumps(rows))
    return rows


def test_readers(spark, tmp_path):
    _products(tmp_path / "a.json")
    (tmp_path / "b.json").write_text('[{"id": "9"}]')
    (tmp_path / "bad.json").write_text('[{"id": ')
    rows = readers.read_json_array(spark, [str(tmp_path / n) for n in ("a.json", "b.json", "bad.json")], "id string").orderBy("pos").collect()
    assert [(r["pos"], r["id"]) for r in rows] == [(0, "007"), (1, "008"), (2, "M1"), (3, "M2"), (4, "M3"), (5, "9")]
    assert readers.merge_json(spark, [str(tmp_path / "b.json"), str(tmp_path / "none.json")], "id string").count() == 1
    assert readers.read_truth(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "t.csv").write_text("ER Referencia eroski,Ref competidor\n007,M1\n")
    assert readers.read_truth(spark, str(tmp_path / "t.csv")).first()["ER Referencia eroski"] == "007"
    (tmp_path / "w.json").write_text('{"general": ["b", "a", "b", null]}')
    assert readers.read_white_labels(spark, str(tmp_path / "w.json")) == ["a", "b"]
    (tmp_path / "tr.json").write_text('{"milk": "leche"}')
    assert readers.read_translations(spark, str(tmp_path / "tr.json")).collect()[0]["translated"] == "leche"


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", 'q"x', None, True, [1]), (2, "", "é", 1.5, False, [])], "a int, b string, c string, d double, e boolean, f array<int>")
    sinks.write_report_csv(df, str(tmp_path / "o"), single=True)
    text = next((tmp_path / "o").glob("*.csv")).read_bytes().decode()
    assert text == 'a;b;c;d;e;f\r\n1;"a;b";"q""x";;True;[1]\r\n2;;é;1.5;False;[]\r\n'
    assert readers.read_csv_report(spark, str(tmp_path / "o")).first()["b"] == "a;b"
    assert sinks.write_xlsx(df, str(tmp_path / "o.xlsx"), sheet_rows=1) == 2
    with zipfile.ZipFile(tmp_path / "o.xlsx") as book:
        sheets = [[[c.findtext(".//{*}t") or "" for c in row.findall("{*}c")] for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{i}.xml")).findall(".//{*}row")] for i in (1, 2)]
        assert ElementTree.fromstring(book.read("xl/workbook.xml")).find("{*}sheets")[1].get("name") == "Sheet2"
    assert sheets == [[list("abcdef"), ["1", "a;b", 'q"x', "", "True", "[1]"]], [list("abcdef"), ["2", "", "é", "1.5", "False", "[]"]]]
    assert sinks.write_xlsx(df.limit(0), str(tmp_path / "none.xlsx")) == 1
    assert [tuple(r) for r in sinks.progress({"x": df}).collect()] == [("x", 2)]
    assert list(sinks.markdown(spark.range(1500).toDF("a")))[::1501] == ["| a |", "| 1499 |"]


def _words():
    """A translator whose batches fail if they hold a word that it lacks; made here, as workers can't import tests."""

    class Words:
        def translate_batch(self, texts):
            return [{"milk": "leche", "bread": "pan"}[t] for t in texts]

        def translate(self, text):
            return self.translate_batch([text])[0]

    return Words


def test_translation_cache_batch_single_and_identity(spark, tmp_path):
    cache = spark.createDataFrame([("tea", "té"), ("tea", "tea?"), (None, "x")], "original string, translated string")
    words = spark.createDataFrame([("milk",), ("bread",), ("tea",), ("xyz",), (None,)], "w string").coalesce(1)
    sinks.write_translations(categories.translate_new(words, "w", cache, _words()), str(tmp_path / "t"))
    got = {r["original"]: r["translated"] for r in readers.read_translations(spark, str(tmp_path / "t")).collect()}
    assert got == {"milk": "leche", "bread": "pan", "xyz": "xyz", "tea": "tea?"}
    assert readers.read_translations(spark, str(tmp_path / "none")).count() == 0


def test_stages_without_a_table(spark, tmp_path):
    with pytest.raises(ValueError, match="match_mode"):
        pipeline.Config(match_mode="any")
    _products(tmp_path / "p.json")
    products = readers.read_products(spark, str(tmp_path / "p.json"))
    nothing = spark.createDataFrame([("EROSKI", "Makro", [])], schemas.CATEGORY_MAP)
    assert pipeline.tokenize(products, nothing, pipeline.Config(), encoder=False).groupBy("side").count().count() == 2
    unusable = spark.createDataFrame([("EROSKI", "Makro", [("a", None, 0.1)])], schemas.CATEGORY_MAP)
    assert pipeline.tokenize(products, unusable, pipeline.Config(), encoder=False).count() == 0
    assert catalog.filter_categories(products, "category", []).count() == 5 and catalog.filter_categories(products, "category", ["Lácteos > Leche", "lacteos"]).count() == 5
    assert catalog.filter_categories(products, "category", ["Lácteos/Leche/Entera"]).count() == 1


def test_mean_token_encoder():
    vectors = {"a": [1.0, 1.0], "b": [3.0, 5.0]}
    e = MeanTokenEncoder(lambda t: np.array([vectors[w] for w in t.split()]), [0.0, 2.0], max_tokens=2, batch=2)
    assert e.encode(["a b a", "a", ""]).tolist() == [[2.0, 3.0], [0.5, 1.5], [0.0, 2.0]]


def test_whole_run(spark, tmp_path):
    _products(tmp_path / "p.json")
    entries = [{"source_category": "Lácteos > Leche", "matched_target_category": "lacteos/leche", "similarity_score": 0.9}, {"source_category": "x", "matched_target_category": None, "similarity_score": 0.1}]
    (tmp_path / "m.json").write_text(json.dumps({"source_supermarket": "EROSKI", "target_supermarket": "Makro", "mapping_results": entries}))
    (tmp_path / "t.csv").write_text("ER Referencia eroski,Ref competidor\n007,M1\n008,M9\n")
    config = pipeline.Config(white_labels=("EROSKI", "BRAND:none", "NO BRAND"), run="r1")
    out = pipeline.run_report(spark, str(tmp_path / "p.json"), str(tmp_path / "m.json"), str(tmp_path / "o"), config, str(tmp_path / "t.csv"))
    report = {r["id"]: r["similar_products"][0] for r in spark.read.json(out["rawreport"]).collect()}
    assert {k: v["id"] for k, v in report.items()} == {"007": "M1", "008": "M2"} and report["008"]["product_concatenation"] == "arroz redondo extra"
    metrics = spark.read.json(out["metrics"]).first()
    assert (metrics["tp"], metrics["fp"], metrics["fn"], metrics["precision"]) == (1, 1, 1, "50.00%")
    assert spark.read.json(out["norepeat"]).first()["n_repeats"] == 0
    assert {r["category_key"]: r["n_products"] for r in spark.read.json(out["counter"]).collect()} == {"lacteosleche": 4, "lacteoslecheentera": 1}
    assert {r["stage"]: r["n_rows"] for r in spark.read.json(out["progress"]).collect()} == {"products": 5, "buckets": 4, "matches": 2, "report": 2, "export": 2}
    assert spark.read.json(out["flat"]).where("path = 'similar_products.0.id'").count() == 2 and zipfile.is_zipfile(f"{out['xlsx']}/report.xlsx")
    compat = pipeline.find_similarities(readers.read_buckets(spark, out["buckets"]), pipeline.Config(match_mode="compat"))
    assert compat.count() == 2 and set(compat.columns) == {"category_key", "brand_type", "a_pos", "b_pos", "distance"}
    glob = pipeline.find_similarities(readers.read_buckets(spark, out["buckets"]), pipeline.Config(match_mode="global")).collect()
    assert len(glob) == 2
    document = pipeline.generate_category_map(readers.read_products(spark, str(tmp_path / "p.json")), config).first()
    assert [e["source_category"] for e in document["mapping_results"]] == ["lacteos/leche"]


def test_encoder_and_tagger(spark):
    e = HashingEncoder(16).encode(["a b", "a b", ""])
    assert (e[0] == e[1]).all() and abs((e[0] ** 2).sum() - 1) < 1e-6 and (e[2] == 0).all()
    df = spark.createDataFrame([("uno dos",), (None,)], "t string")
    assert [r[0] for r in df.select(main_words(F.col("t"), str.split)).collect()] == [["uno", "dos"], []]
    assert pipeline.execution_id(0) == "197001010"


def test_streams(spark, tmp_path):
    for n, rows in enumerate(([("1", 1, "a"), ("2", 2, "b")], [("1", 3, "c")])):
        spark.createDataFrame(rows, "id string, pos long, brand string").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    schema = "id string, pos long, brand string"
    for n in range(2):
        feed = incremental.product_feed(spark, str(tmp_path / f"in/{n}"), schema)
        incremental.upsert_latest(feed, str(tmp_path / f"out{n}"), str(tmp_path / f"c{n}")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out0/v=0")).select("id", "pos").collect()) == [("1", 1), ("2", 2)]
    both = incremental.product_feed(spark, str(tmp_path / "in/*"), schema, 1)
    incremental.upsert_latest(both, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    last = max((tmp_path / "out").glob("v=*"), key=lambda p: int(p.name[2:]))
    assert sorted(tuple(r) for r in spark.read.parquet(str(last)).select("id", "brand").collect()) == [("1", "c"), ("2", "b")]


def test_entry_imports_without_the_optional_package():
    check = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['cotejo', 'llm']:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
assert set(entry.oracle_sql()) <= set(entry.queries()) and 'p1_found' in entry.queries() and 'p8_ids' not in entry.queries()
"""
    subprocess.run([sys.executable, "-c", check], check=True, cwd=pathlib.Path(__file__).parents[1])


def test_entry_lists_queries_and_their_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "p1_found" in entry.queries()


def test_upsert_keeps_earlier_keys_at_a_target_with_a_scheme(spark, tmp_path):
    schema = "id string, pos long, brand string"
    for n, rows in enumerate([[("1", 1, "a"), ("2", 2, "b")], [("1", 3, "c")], [("3", 4, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n < 2:
            feed = incremental.product_feed(spark, str(tmp_path / "in"), schema)
            incremental.upsert_latest(feed, f"file:{tmp_path}/out", str(tmp_path / "c")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/v=1")).select("id", "brand").collect()) == [("1", "c"), ("2", "b")]
    (tmp_path / "out/v=1").rename(tmp_path / "gone")
    with pytest.raises(Exception, match="needs the version before it"):
        incremental.upsert_latest(incremental.product_feed(spark, str(tmp_path / "in"), schema), f"file:{tmp_path}/out", str(tmp_path / "c")).awaitTermination()


def test_old_versions_go_and_hours_are_counted(spark, tmp_path):
    schema = "id string, pos long, category string, scraped_at timestamp"
    for n in range(5):
        spark.sql(f"select '{n % 2}' id, {n}L pos, 'c' category, timestamp'2026-01-01 00:30:00' + make_interval(0, 0, 0, {n}) scraped_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = incremental.product_feed(spark, str(tmp_path / "in"), schema, 1)
    incremental.upsert_latest(feed, str(tmp_path / "out"), str(tmp_path / "c"), keep=2).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").glob("v=*")) == ["v=3", "v=4"]
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/v=4")).select("id", "pos").collect()) == [("0", 4), ("1", 3)]
    query = incremental.hourly_counts(feed).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n_products"] for r in spark.table("hours").collect()) == [1, 1, 1, 1, 1]


def test_run_makes_the_map_and_exports(spark, tmp_path):
    _products(tmp_path / "p.json")
    config = pipeline.Config(white_labels=("EROSKI",), run="r2")
    (tmp_path / "truth.json").write_text(json.dumps([{"source_category": "Lácteos > Leche", "target_category": "lacteos/leche"}]))
    (tmp_path / "earlier.json").write_text(json.dumps([{"id": "007", "similar_products": [{"id": "M1"}]}, {"id": "old", "similar_products": []}]))
    config = dataclasses.replace(config, load_translator=_words())
    out = pipeline.run_report(spark, str(tmp_path / "p.json"), None, str(tmp_path / "o"), config, None, str(tmp_path / "none.json"), str(tmp_path / "truth.json"), [str(tmp_path / "earlier.json"), str(tmp_path / "none.json")])
    assert 0 <= spark.read.json(out["category_metrics"]).first()["f1"] <= 1
    mapping = spark.createDataFrame([("A > b", "x y", 0.9), ("C", None, 0.1), ("other", "z", 0.8)], "source_category string, matched_target_category string, similarity_score double")
    known = spark.createDataFrame([("a/B", "X Y"), ("a/b", "w"), ("c", "q")], "source_category string, target_category string")
    assert [round(v, 6) for v in categories.map_metrics(mapping, known).first()] == [round(1 / 3, 6)] * 3
    assert readers.read_translations(spark, out["translations"]).first()["translated"] == "Lácteos > Leche"
    report, merged = spark.read.json(out["rawreport"]), spark.read.json(out["merged"])
    assert sorted(r["id"] for r in merged.collect()) == sorted({"007", "old"} | {r["id"] for r in report.collect()})
    made = readers.read_category_map(spark, out["category_map"]).first()
    assert [e["source_category"] for e in made["mapping_results"]] == ["lacteos/leche"]
    rows = spark.read.json(out["rawreport"]).count()
    flat = readers.read_csv_report(spark, out["export"])
    assert rows == flat.count() and (rows == 0 or "similar_products.0.id" in flat.columns)
    similar = "array<struct<id:string,distance:double>>"
    report = spark.createDataFrame([(0, "7", None, [("M", 0.5)]), (1, "7", "x", [("M", 0.1)]), (2, "8", "y", [("N", 0.2)])], f"pos long, id string, brand string, similar_products {similar}")
    got = pipeline.export_table(report).orderBy("pos").collect()
    assert [(r["pos"], r["id"], r["brand"], r["similar_products.0.id"], r["similar_products.0.distance"]) for r in got] == [(0, "7", "", "M", "0.5"), (2, "8", "y", "N", "0.2")]
