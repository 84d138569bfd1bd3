import pytest
from cotejo.operators import flatten, evaluate

REPORT = "row int, id string, similar_products array<struct<id: string, productIdInSupermarket: string>>"


def _repeats(spark, ids, key):
    rows = [(i + 1, str(i), [(x, None) if key == "id" else (None, x)] if x else []) for i, x in enumerate(ids)]
    found = evaluate.repeats(evaluate.similar_ids(spark.createDataFrame(rows, REPORT)), "item", "row")
    return sorted(tuple(r) for r in found.collect()), evaluate.repeat_message(found).first()["message"]


def test_no_repeats(spark):
    for key in ("id", "old"):
        found, message = _repeats(spark, ["345", "645"], key)
        assert found == [] and message.startswith("Success: No repeated similar product IDs were found") and "Action Required" not in message


def test_repeats(spark):
    for key in ("id", "old"):
        found, message = _repeats(spark, ["345", "345"], key)
        assert found == [("345", 1, 2)] and message == "Action Required: One or more similar product IDs are repeated in the report."
    assert _repeats(spark, ["7", "7", "", "8", "7"], "id")[0] == [("7", 1, 2), ("7", 1, 5)]


def test_outcomes_and_metrics(spark):
    pair = "a_id string, b_id string"
    g = spark.createDataFrame([("1", "1"), ("1", "1"), ("2", "2"), (None, "3")], pair)
    t = spark.createDataFrame([("1", "1"), ("4", "4"), ("5", "5")], pair)
    m = evaluate.micro_metrics(evaluate.outcomes(g, t)).first()
    assert (m["tp"], m["fp"], m["fn"], m["precision"], round(m["recall"], 4), round(m["f1"], 4)) == (1, 1, 2, 0.5, 0.3333, 0.4)
    empty = evaluate.micro_metrics(evaluate.outcomes(g.limit(0), t.limit(0))).first()
    assert (empty["tp"], empty["precision"], empty["recall"], empty["f1"]) == (0, 0, 0, 0)


def test_macro(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", None), ("d", "e")], "t string, p string")
    m = evaluate.macro_metrics(df, "t", "p").first()
    assert [round(m[c], 4) for c in ("precision", "recall", "f1")] == [round(0.5 / 6, 4), round(1 / 6, 4), round((2 / 3) / 6, 4)]
    assert evaluate.macro_metrics(df.limit(0), "t", "p").first()["f1"] is None


def test_category_outcomes_with_null_target(spark):
    truth = spark.createDataFrame([("a", None), ("b", "x"), ("b", "y"), ("c", "z")], "source_category string, target_category string")
    predicted = spark.createDataFrame([("a", None, 1), ("b", "q", 1), ("b", "y", 2), ("c", None, 1), ("zz", "z", 1)], "source_category string, target_category string, pos int")
    got = {(r[0], r[1], r[2]) for r in evaluate.category_outcomes(predicted, truth).collect()}
    assert got == {("a", None, "TP"), ("b", "y", "TP"), ("b", "x", "FN"), ("c", "z", "FN")}
    labels = {r["source_category"]: (r["expected"], r["predicted"]) for r in evaluate.category_labels(predicted, truth).collect()}
    assert labels == {"a": (None, None), "b": ("y", "y"), "c": ("z", None)}


def test_truth_pairs(spark):
    df = spark.createDataFrame([("007", "1", "n", 1), ("007", "1", "m", 2), ("", "2", "x", 3), ("N/A", "2", "x", 4), (None, "2", "x", 5), ("8", " ", "x", 6)], "a string, b string, t string, pos int")
    assert [tuple(r) for r in evaluate.truth_pairs(df, "a", "b", ("t", None), "pos").collect()] == [("007", "1", "m", "N/A")]


def test_report_queries_read_rawreport_and_known_matches(spark, tmp_path):
    from cotejo.plans.queries import QUERIES

    rows = [(0, "EROSKI", "1", "a", '[{"id": "M1", "distance": "0.5"}]'), (1, "EROSKI", "2", "b", '{"productIdInSupermarket": "M1"}'), (2, "EROSKI", "3", "c", '[7, {"id": "M1"}]'), (3, "EROSKI", "4", "d", "[{"), (4, "Makro", "5", "e", '[{"id": "M1"}]'), (5, "EROSKI", "6", "f", None)]
    spark.createDataFrame(rows, "rep_id long, supermarket string, id string, description string, similar_products string").write.parquet(str(tmp_path / "rawreport.parquet"))
    spark.createDataFrame([("1", "M1", "a", "m"), ("9", "M9", "x", "y")], "er_referencia_eroski string, ref_competidor string, eroski_denomination string, makro_denomination string").write.parquet(str(tmp_path / "known_matches.parquet"))
    spark.createDataFrame([("EROSKI", "leche"), ("EROSKI", "pan"), ("EROSKI", "pan"), ("Makro", "leche")], "supermarket string, category string").write.parquet(str(tmp_path / "products.parquet"))
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert run("report_norepeat") == [("M1", 0, 1)] and run("report_norepeat_message")[0][0] == 1
    assert run("report_eval_general")[0][:3] == (1, 1, 1)
    assert sorted((r[1], r[4], r[5], r[6]) for r in run("report_eval_report"))[:2] == [("FN", "9", "M9", None), ("FP", "2", "M1", 999.0)]
    assert sorted(r[2] for r in run("product_category_map")) == ["leche", "pan"]


def test_flat_records_of_any_depth(spark):
    deep = '{"a":' * 15 + '{"b":[1.0,{"c":"x]}\\\\\\"{["}]}' + "}" * 15
    df = spark.createDataFrame([(1, deep), (2, '{"a": 2}'), (3, None), (4, "no")], "r long, t string")
    got = {(r["r"], r["path"].replace("a.", ""), r["value"]) for r in flatten.flatten_json(df, "r", "t").collect()}
    assert flatten.nesting(df, "t") == 18 and got == {(1, "b.0", "1.0"), (1, "b.1.c", 'x]}\\"{['), (2, "a", "2")}
    with pytest.raises(ValueError, match="more than 1 paths"):
        flatten.ragged_table(df, "r", "t", max_paths=1)
