"""Match quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.products import percent
from cotejo.operators.skew import fragment_replicate_join

#: Texts that a truth file uses for a missing id.
MISSING_IDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def truth_pairs(truth: DataFrame, a: str, b: str, texts: tuple[str | None, str | None] = (None, None), order: str | None = None) -> DataFrame:
    """Distinct ``a_id, b_id`` with their texts (``N/A`` if none); rows lacking an id are dropped; of a repeated pair
    the last row by ``order`` counts, without an order the row with the greatest texts. Ids stay texts, zeros kept."""
    ids = [F.col(c).cast("string").alias(n) for c, n in ((a, "a_id"), (b, "b_id"))]
    names = [(F.col(c).cast("string") if c else F.lit(None).cast("string")).alias(n) for c, n in zip(texts, ("a_text", "b_text"), strict=True)]
    rows = truth.select(*ids, *names, (F.col(order) if order else F.lit(0)).alias("__o"))
    for c in ("a_id", "b_id"):
        rows = rows.where(F.col(c).isNotNull() & ~F.btrim(c).isin(MISSING_IDS))
    last = rows.groupBy("a_id", "b_id").agg(F.max(F.struct("__o", "a_text", "b_text")).alias("m"))
    return last.select("a_id", "b_id", *[F.coalesce(f"m.{c}", F.lit("N/A")).alias(c) for c in ("a_text", "b_text")])


def report_pairs(report: DataFrame, order: str = "pos") -> DataFrame:
    """``a_id, b_id, distance, a_text, b_text`` of a match report with ``similar_products``: only the first similar
    product counts; rows without an id or list are dropped; the last of a repeated pair wins."""
    first = F.get("similar_products", F.lit(0))
    fields = {f.name for f in report.schema["similar_products"].dataType.elementType.fields}
    text = F.coalesce(*[first[c] for c in ("description", "denomination") if c in fields], F.lit("N/A"))
    rows = report.where(F.col("id").isNotNull() & (F.size("similar_products") > 0))
    rows = rows.select(F.col("id").cast("string").alias("a_id"), first["id"].cast("string").alias("b_id"), F.coalesce(first["distance"].cast("double"), F.lit(999.0)).alias("distance"), F.coalesce("description", F.lit("N/A")).alias("a_text"), text.alias("b_text"), order)
    return rows.groupBy("a_id", "b_id").agg(F.max_by(F.struct("distance", "a_text", "b_text"), order).alias("m")).select("a_id", "b_id", "m.*")


def outcomes(generated: DataFrame, truth: DataFrame) -> DataFrame:
    """Every pair of either side with ``outcome`` TP, FP or FN: one full outer join on the pair. Repeated pairs count
    once; null ids never match and are dropped."""
    keys = ["a_id", "b_id"]
    side = lambda df, flag: df.where(F.col("a_id").isNotNull() & F.col("b_id").isNotNull()).select(*keys).distinct().withColumn(flag, F.lit(True))
    both = side(generated, "g").join(side(truth, "t"), keys, "full_outer")
    return both.select(*keys, F.when(F.col("g") & F.col("t"), "TP").when(F.col("g"), "FP").otherwise("FN").alias("outcome"))


def micro_metrics(found: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 (0 where undefined) of ``outcomes``."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o.lower())
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    out = found.agg(n("TP"), n("FP"), n("FN"))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def general_report(metrics: DataFrame) -> DataFrame:
    return metrics.select("tp", "fp", "fn", *[percent(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def evaluation_report(generated: DataFrame, truth: DataFrame) -> DataFrame:
    """The row-level report in its order: TP by distance, FP by distance, FN by ids. TP and FP carry ``match_type`` or
    ``error_type`` as the exchange format has them, ``outcome`` unites both."""
    keys = ["a_id", "b_id"]
    g = generated.select(*keys, "distance", F.col("a_text").alias("ga"), F.col("b_text").alias("gb"), F.lit(True).alias("g"))
    t = truth.select(*keys, F.col("a_text").alias("ta"), F.col("b_text").alias("tb"), F.lit(True).alias("t"))
    both = g.join(t, keys, "full_outer").withColumn("outcome", F.when(F.col("g") & F.col("t"), "TP").when(F.col("g"), "FP").otherwise("FN"))
    section = F.when(F.col("outcome") == "TP", 1).when(F.col("outcome") == "FP", 2).otherwise(3)
    out = both.select(section.alias("section"), "outcome", F.when(F.col("outcome") == "TP", "TP").alias("match_type"), F.when(F.col("outcome") != "TP", F.col("outcome")).alias("error_type"), *keys, "distance", F.coalesce("ga", "ta", F.lit("N/A")).alias("a_text"), F.coalesce("gb", "tb", F.lit("N/A")).alias("b_text"))
    return out.orderBy("section", "distance", "a_id", "b_id")


def macro_metrics(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row: macro precision, recall and f1 over all labels seen on either side; a null is the label ``None``;
    undefined scores are 0; an empty table gives nulls."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    pairs = rows.groupBy(label(true).alias("t"), label(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("nt"), F.lit(0).alias("np"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).alias("nt"), F.col("n").alias("np"), F.lit(0).alias("tp")))
    per = pairs.select(F.explode(sides).alias("s")).groupBy("s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("nt", "np", "tp")])
    ratio = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    per = per.select(ratio("tp", "np").alias("p"), ratio("tp", "nt").alias("r"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return per.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(f1).alias("f1"))


def category_labels(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per truth source: ``source_category, expected, predicted``. With several expected targets the label is
    the prediction if it is one of them, else the smallest; sources without a prediction get null. Of several
    predictions of a source the last by ``pos`` counts."""
    last = predicted.groupBy("source_category").agg(F.max_by("target_category", "pos").alias("predicted"))
    out = truth.join(last, "source_category", "left").groupBy("source_category", "predicted")
    hit = F.max(F.coalesce(F.col("target_category").eqNullSafe(F.col("predicted")), F.lit(False)))
    out = out.agg(hit.alias("hit"), F.min("target_category").alias("least"))
    return out.select("source_category", F.when(F.col("hit"), F.col("predicted")).otherwise(F.col("least")).alias("expected"), "predicted")


def category_outcomes(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``source_category, target_category, outcome`` over the sources of the truth. A null target may be a correct
    pair; a null prediction is no FP; FN are truth pairs that weren't predicted."""
    keys = ["source_category", "target_category"]
    sources = truth.select("source_category").distinct()
    last = predicted.groupBy("source_category").agg(F.max_by("target_category", "pos").alias("target_category")).join(sources, "source_category", "left_semi")
    both = last.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("t")).unionByName(truth.select(*keys).distinct().select(*keys, F.lit(0).alias("g"), F.lit(1).alias("t")))
    both = both.groupBy(*keys).agg(F.max("g").alias("g"), F.max("t").alias("t"))  # groups hold null targets too
    out = both.withColumn("outcome", F.when((F.col("g") == 1) & (F.col("t") == 1), "TP").when(F.col("g") == 1, "FP").otherwise("FN"))
    return out.where((F.col("outcome") != "FP") | F.col("target_category").isNotNull()).select(*keys, "outcome")


def repeats(report: DataFrame, item: str, row: str) -> DataFrame:
    """Later rows of an item with the row of its first: ``item, first_row, repeated_row``. Null and empty items are
    skipped. First rows come from an aggregate and go back to the rows by the load-balanced join, so a hot item is
    several tasks."""
    rows = report.where(F.coalesce(F.col(item).cast("string"), F.lit("")) != "").select(F.col(item).alias("item"), F.col(row).alias("repeated_row"))
    firsts = rows.groupBy("item").agg(F.min("repeated_row").alias("first_row"))
    return fragment_replicate_join(rows, firsts, "item", F.col("repeated_row")).where(F.col("repeated_row") > F.col("first_row")).select("item", "first_row", "repeated_row")


def repeat_message(found: DataFrame) -> DataFrame:
    """One row: the number of repeats and the message."""
    ok, bad = "Success: No repeated similar product IDs were found.", "Action Required: One or more similar product IDs are repeated in the report."
    return found.agg(F.count("*").alias("n_repeats")).withColumn("message", F.when(F.col("n_repeats") == 0, ok).otherwise(bad))


def similar_ids(report: DataFrame) -> DataFrame:
    """Row number and id of each report row's first similar product, by ``id`` or the older key."""
    fields = {f.name for f in report.schema["similar_products"].dataType.elementType.fields}
    first = F.get("similar_products", F.lit(0))
    keys = [first[c] for c in ("id", "productIdInSupermarket") if c in fields]
    return report.where(F.size("similar_products") > 0).select("row", F.coalesce(*keys).alias("item"))
