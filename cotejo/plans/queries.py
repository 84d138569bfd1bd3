"""The core's queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import products as P
from cotejo.functions.text import category_key, normalize, slug, strip_accents
from cotejo.operators import catalog, categories, dedup, dewey, evaluate, flatten, matching, skew, units
from cotejo.operators.vectors import knn_join
from cotejo.session import checkpoint_dir, table
from cotejo.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]

LEVELS = ("similar_products", "offers", "promos", "tiers")


def _labels(spark: SparkSession, d: str) -> list[str]:
    """The white-label configuration: one row, a short list."""
    return sorted({p for r in table(spark, d, "white_label_brands").collect() for p in r["general"] if p is not None})


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of the embeddings table as two catalogues, by even and odd id; the label stands for the brand."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"), "label")
    return rows.where(F.col("pos") % 2 == 0), rows.where(F.col("pos") % 2 == 1)


def _processed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The two groups' processed products in the source catalogue's buckets."""
    pairs = catalog.category_pairs(table(spark, d, "category_map").where("source_supermarket = 'EROSKI'"))
    rows = table(spark, d, "processed_products").where("size(product_embedding) = 64 and forall(product_embedding, x -> x is not null and x between -1e30 and 1e30)")
    a = rows.where(F.contains("supermarket", F.lit("EROSKI"))).join(pairs.select("source_key").distinct(), F.col("category_key") == F.col("source_key"), "left_semi")
    a = a.withColumn("bucket", F.col("category_key"))
    b = catalog.prefix_join(rows.where(F.contains("supermarket", F.lit("Makro"))), "category_key", pairs.select(F.col("source_key").alias("bucket"), F.col("target_key").alias("pattern")).distinct(), "pattern")
    keep = ["vec_id", "id", "bucket", "brand_type", F.upper("brand").alias("brand_key"), "product_embedding"]
    return a.select(*keep), b.select(*keep)


def _rounded(found: DataFrame) -> DataFrame:
    return found.select(*[c for c in found.columns if c not in ("distance", "rank")], F.round("distance", 5).alias("distance"))


def match_brand(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return _rounded(matching.match(a, b, ["label"], "pos", "v")).select("a_pos", "b_pos", "distance")


def match_no_brand(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return _rounded(matching.match(a, b, [], "pos", "v"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return knn_join(a, b, [], "pos", "v", 5).select("a_pos", "b_pos", "rank", F.round("distance", 5).alias("distance"))


def match_overlapping_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Buckets that overlap: every vector of the left side lies in two of them, of the right side in one or two."""
    a, b = _sides(spark, d)
    inside = lambda df, buckets: df.withColumn("bucket", F.explode(F.array_distinct(buckets)))
    left = inside(a, F.array(F.col("label") % 4, (F.col("label") + 1) % 4))
    right = inside(b, F.array(F.col("label") % 4, F.when(F.col("pos") % 3 == 0, (F.col("label") + 2) % 4).otherwise(F.col("label") % 4)))
    return _rounded(matching.match(left, right, ["bucket"], "pos", "v")).select("bucket", "a_pos", "b_pos", "distance")


def match_own_brand_flag(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda df: df.withColumn("own", F.col("label") < 3)
    a, b = map(flag, _sides(spark, d))
    return _rounded(knn_join(a, b, ["own"], "pos", "v")).drop("own")


def match_global(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    found = knn_join(a, b, ["label"], "pos", "v", 3).drop("label").unionByName(knn_join(a, b, [], "pos", "v", 1))
    return _rounded(matching.match_global(found))


def match_catalog_brand(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.where("brand_type = 'brand'") for x in _processed(spark, d))
    return _rounded(matching.match(a, b, ["bucket", "brand_key"], "vec_id", "product_embedding")).select("bucket", "a_pos", "b_pos", "distance")


def match_catalog_no_brand(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.where("brand_type = 'no_brand'") for x in _processed(spark, d))
    return _rounded(matching.match(a, b, ["bucket"], "vec_id", "product_embedding")).select("bucket", "a_pos", "b_pos", "distance")


def category_map(spark: SparkSession, d: str) -> DataFrame:
    """Labels of even vectors mapped to labels of odd ones by their mean vectors, twice weighted one half."""
    a, b = _sides(spark, d)

    def mean(df: DataFrame) -> DataFrame:
        entries = df.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), F.posexplode("v").alias("i", "x"))
        means = entries.groupBy("category", "i").agg(F.avg("x").alias("x")).groupBy("category").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e"))
        return means.select("category", F.transform("e", lambda s: s["x"]).alias("v"))

    return categories.map_categories(mean(a), mean(b), "category", ["v", "v"])


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalize(F.col("text")).alias("text_norm"))


def slug_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("pos", slug(F.col("category")).alias("slug"), category_key(F.col("category")).alias("category_key"))


def accent_removal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rawreport").select("rep_id", strip_accents(F.col("description")).alias("description"), strip_accents(F.col("category")).alias("category"))


def category_filter(spark: SparkSession, d: str) -> DataFrame:
    pairs = catalog.category_pairs(table(spark, d, "category_map"))
    rows = catalog.bucketed(table(spark, d, "products").select("pos", "category"), "category", pairs, "source")
    return rows.select("pos", "bucket")


def category_counter(spark: SparkSession, d: str) -> DataFrame:
    """Products by their own category key, once for every mapping that they fall under."""
    rows = table(spark, d, "products")
    pairs = catalog.category_pairs(table(spark, d, "category_map").where("source_supermarket = 'EROSKI'"))
    return catalog.category_counter(rows.where(F.contains("supermarket", F.lit("EROSKI"))), rows.where(F.contains("supermarket", F.lit("Makro"))), pairs)


def white_label(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.classify_brands(table(spark, d, "products").select("pos", "brand"), _labels(spark, d))
    return rows.select("pos", "brand", "brand_type")


def brand_min_count(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.classify_brands(table(spark, d, "products").select("pos", "brand", "supermarket"), _labels(spark, d), 2, ["supermarket"])
    return rows.select("pos", "brand", "brand_type")


def product_text(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.product_texts(catalog.classify_brands(table(spark, d, "products"), _labels(spark, d)))
    return rows.select("pos", "product_concatenation")


def legacy_product_text(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_size") % 7 == 0, F.lit("")).when(F.col("p_size") % 7 == 1, F.lit("x")).when(F.col("p_size") % 7 == 2, F.lit("0")).otherwise(F.col("p_size").cast("string"))
    text = P.legacy_product_text(F.col("p_name"), F.col("p_brand"), F.col("p_retailprice"), size, F.col("p_type"), F.lit("kg"))
    return table(spark, d, "part").select("p_partkey", text.alias("legacy_text"))


def dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "products").select("id", "pos", "price", "category")
    return dedup.last_wins(rows, ["id"], "pos").select("id", "pos", "price", "category", "first_pos")


def dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return dedup.first_pair_wins(rows, "user_id", "event_type", "event_id")


def _report(spark: SparkSession, d: str) -> DataFrame:
    """rawreport with its similar products as a typed list, EROSKI rows on the left. An object in place of the list is its
    only element; elements that aren't objects keep their place; the older key of an id counts where there is no id."""
    rows = table(spark, d, "rawreport").where(F.contains("supermarket", F.lit("EROSKI"))).withColumn("v", F.try_parse_json("similar_products"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.array("v")))
    get = lambda x, name, kind="string": F.try_variant_get(x, f"$.{name}", kind)
    typed = F.transform(items, lambda x: F.struct(F.coalesce(get(x, "id"), get(x, "productIdInSupermarket")).alias("id"), get(x, "description").alias("description"), get(x, "denomination").alias("denomination"), get(x, "distance", "double").alias("distance")))
    return rows.select(F.col("rep_id").alias("pos"), "id", "description", typed.alias("similar_products"))


def report_norepeat(spark: SparkSession, d: str) -> DataFrame:
    """Repeated similar products of rawreport."""
    return evaluate.repeats(evaluate.similar_ids(_report(spark, d).withColumnRenamed("pos", "row")), "item", "row")


def report_norepeat_message(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.repeat_message(report_norepeat(spark, d))


def report_eval_general(spark: SparkSession, d: str) -> DataFrame:
    """rawreport against the known matches."""
    return evaluate.general_report(evaluate.micro_metrics(evaluate.outcomes(evaluate.report_pairs(_report(spark, d)), truth_pairs(spark, d))))


def report_eval_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluation_report(evaluate.report_pairs(_report(spark, d)), _known(spark, d))


def product_category_map(spark: SparkSession, d: str) -> DataFrame:
    """The map of all product categories of the two groups, by the pipeline's stage."""
    from cotejo.plans import pipeline

    return pipeline.generate_category_map(table(spark, d, "products"), pipeline.Config()).select("source_supermarket", "target_supermarket", F.explode("mapping_results").alias("m")).select("source_supermarket", "target_supermarket", "m.*")


def _pair_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers that met in orders: all of them against those of urgent or high priority."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").cast("string").alias("a_id"), F.col("l_suppkey").cast("string").alias("b_id"), "l_quantity", "l_discount", F.lit("N/A").alias("a_text"), F.lit("N/A").alias("b_text"))
    pairs = lambda cond: rows.where(cond).groupBy("a_id", "b_id").agg(F.min("l_quantity").cast("double").alias("distance"), F.min("a_text").alias("a_text"), F.min("b_text").alias("b_text"))
    return pairs("l_quantity < 20"), pairs("l_discount >= 0.05")


def eval_matches(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.micro_metrics(evaluate.outcomes(*_pair_sets(spark, d)))
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def eval_general(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.general_report(evaluate.micro_metrics(evaluate.outcomes(*_pair_sets(spark, d))))


def eval_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluation_report(*_pair_sets(spark, d)).select("section", "outcome", "match_type", "error_type", "a_id", "b_id", "distance")


def _known(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "known_matches")
    return evaluate.truth_pairs(truth, "er_referencia_eroski", "ref_competidor", ("eroski_denomination", "makro_denomination"))


def truth_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select("a_id", "b_id")


def eval_categories_macro(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_type").alias("t"), F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).when(F.col("p_size") % 3 == 1, F.col("p_type")).otherwise(F.lit("STANDARD")).alias("p"))
    m = evaluate.macro_metrics(rows, "t", "p")
    return m.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def eval_categories(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    truth = part.select(F.col("p_name").alias("source_category"), F.col("p_brand").alias("target_category"))
    predicted = part.select(F.col("p_name").alias("source_category"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("target_category"), F.col("p_partkey").alias("pos"))
    return evaluate.category_outcomes(predicted, truth)


def norepeat(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.repeats(table(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row")), "l_partkey", "row")


def norepeat_message(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.repeat_message(norepeat(spark, d))


def flatten_json(spark: SparkSession, d: str) -> DataFrame:
    return flatten.flatten_json(table(spark, d, "events"), "event_id", "props").select("event_id", "path", "value")


def flatten_report(spark: SparkSession, d: str) -> DataFrame:
    return flatten.flatten_json(_report_documents(spark, d), "rep_id", "doc").select("rep_id", "path", "value", "is_null")


def csv_columns(spark: SparkSession, d: str) -> DataFrame:
    return flatten.ragged_table(table(spark, d, "events"), "event_id", "props").drop("item")


def _report_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each listing as one JSON document, its similar products as they are written (a number keeps its form)."""
    own = F.to_json(F.struct("id", "brand"))
    similar = F.when(F.try_parse_json("similar_products").isNotNull(), F.concat(F.lit('"similar_products":'), F.col("similar_products")))
    members = F.concat_ws(",", F.nullif(F.substring(own, F.lit(2), F.length(own) - 2), F.lit("")), similar)
    return table(spark, d, "rawreport").withColumn("doc", F.concat(F.lit("{"), members, F.lit("}")))


def csv_columns_report(spark: SparkSession, d: str) -> DataFrame:
    """The nested report as a table with a column for every path that occurs."""
    return flatten.ragged_table(_report_documents(spark, d), "rep_id", "doc").drop("item")


def _written(spark: SparkSession, name: str) -> str:
    """A folder of this run on the shared file system."""
    return f"{checkpoint_dir(spark)}/cotejo-io/{uuid.uuid4().hex}/{name}"


def io_products(spark: SparkSession, d: str) -> DataFrame:
    """Products through JSON array files and back."""
    at = _written(spark, "products")
    fields = ["id", "supermarket", "description", "denomination", "brand", "category", "price", "unit_price", "raw_ingredients", "nutrition_information"]
    sinks.write_json_arrays(table(spark, d, "products").select(*fields), at)
    rows = readers.read_products(spark, at)
    return rows.select("id", "supermarket", "description", "denomination", "brand", "category", "price", "unit_price", F.col("nutrition_information.fat.value").alias("fat"))


def io_report_csv(spark: SparkSession, d: str) -> DataFrame:
    """Listings through the ``;`` CSV and back; cells are texts, an empty one is null."""
    at = _written(spark, "report")
    sinks.write_report_csv(table(spark, d, "rawreport").select("rep_id", "id", "description", "brand", "category", "similar_products"), at)
    return readers.read_csv_report(spark, at)


def io_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Processed products through the bucket table, one brand type read back by its partition."""
    at = _written(spark, "buckets")
    sinks.write_buckets(table(spark, d, "processed_products"), at)
    return readers.read_buckets(spark, at, brand_type="brand").select("vec_id", "id", "category_key", "brand")


def io_truth(spark: SparkSession, d: str) -> DataFrame:
    """Known matches through their CSV file to distinct pairs."""
    at = _written(spark, "truth")
    names = {"er_referencia_eroski": "ER Referencia eroski", "ref_competidor": "Ref competidor", "eroski_denomination": "Eroski_Denomination", "makro_denomination": "Makro_Denomination"}
    rows = table(spark, d, "known_matches").select(*[F.col(a).alias(b) for a, b in names.items()])
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    return evaluate.truth_pairs(readers.read_truth(spark, at), "ER Referencia eroski", "Ref competidor").select("a_id", "b_id")


def io_category_map(spark: SparkSession, d: str) -> DataFrame:
    """A category map through its JSON document to usable pairs."""
    at = _written(spark, "map")
    sinks.write_json_document(table(spark, d, "category_map").where("source_supermarket = 'EROSKI'"), at)
    return catalog.category_pairs(readers.read_category_map(spark, at))


def io_white_labels(spark: SparkSession, d: str) -> DataFrame:
    at = _written(spark, "labels")
    sinks.write_json_document(table(spark, d, "white_label_brands"), at)
    return spark.createDataFrame([(p,) for p in readers.read_white_labels(spark, at)], "pattern string")


def io_translations(spark: SparkSession, d: str) -> DataFrame:
    """A translation cache written as a JSON object, read and written again with what it lacked."""
    at = _written(spark, "translations")
    sinks.write_translations(table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("original"), F.lower("n_name").alias("translated")), at)

    class Reversed:
        def translate_batch(self, texts: list[str]) -> list[str]:
            return [t[::-1] for t in texts]

        def translate(self, text: str) -> str:
            return text[::-1]

    more = categories.translate_new(table(spark, d, "nation"), "n_name", readers.read_translations(spark, at), Reversed)
    again = _written(spark, "translations")
    sinks.write_translations(more, again)
    return readers.read_translations(spark, again)


def match_compat(spark: SparkSession, d: str) -> DataFrame:
    """The literal replay in bucket order over the processed products."""
    a, b = (x.withColumn("brand_key", F.when(F.col("brand_type") == "brand", F.col("brand_key")).otherwise(F.lit(""))) for x in _processed(spark, d))
    one = lambda df: dedup.last_wins(df, ["id", "bucket"], "vec_id").drop("first_pos")
    return _rounded(matching.match_compat(one(a), one(b), "bucket", "vec_id", "product_embedding"))


def translate_lookup(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "nation").select(F.col("n_name").alias("word"))
    dictionary = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("original"), F.lower("n_name").alias("translated"))
    return categories.translate(words, "word", dictionary)


def golden_set_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.when(F.col("p_size") % 5 == 0, F.array(F.array(F.col("p_name")))).when(F.col("p_size") % 5 == 1, F.array(F.array(F.concat(F.col("p_name"), F.lit(" "))), F.array().cast("array<string>"))).otherwise(F.array(F.array("p_name"), F.array("p_brand", "p_type"))).alias("pair"))
    return categories.expand_golden_set(rows)


def bucket_pairing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processed_products").where("category_key is not null")
    return catalog.bucket_pairing(rows.where(F.contains("supermarket", F.lit("EROSKI"))), rows.where(F.contains("supermarket", F.lit("Makro"))), ["category_key", "brand_type"])


def map_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "category_map").select("source_supermarket", "target_supermarket", F.explode("mapping_results").alias("m"))
    return rows.select("source_supermarket", "target_supermarket", slug(F.col("m.source_category")).alias("source_slug"), slug(F.col("m.matched_target_category")).alias("target_slug"), "m.similarity_score").distinct()


def slug_originals(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "products").select("category").distinct()
    slugs = table(spark, d, "products").where(F.contains("supermarket", F.lit("Makro"))).select(slug(F.col("category")).alias("slug")).where("slug is not null").distinct()
    return categories.originals(slugs, "slug", names, "category")


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    """Every product with its price and unit price in common units, and where the unit was read."""
    out = units.with_unit_prices(table(spark, d, "products").select("pos", "unit_price", "price", "description", "denomination"), "unit_price", "price", ["description", "denomination"])
    return out.select("pos", "base_unit", "unit_cents", "price_cents", "content", "unit_from", "confirmed")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = p1_units(spark, d).where("price_cents is not null and unit_cents is not null and unit_from in ('field', 'text')")
    return rows.select("pos", "base_unit", "unit_cents", "price_cents")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.latest_per_key(table(spark, d, "products"), "category", "scraped_at", "pos").select("category", "pos")


def p2_since_latest(spark: SparkSession, d: str) -> DataFrame:
    """Every product row with the place of its category's latest row, by the fragment-replicate join."""
    rows = table(spark, d, "products").select("pos", "category", "scraped_at")
    latest = skew.latest_per_key(rows, "category", "scraped_at", "pos").select("category", F.col("pos").alias("latest_pos"))
    return skew.fragment_replicate_join(rows, latest, "category", F.col("pos")).select("pos", "category", "latest_pos")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = dewey.dewey_nodes(table(spark, d, "rawreport"), "rep_id", "similar_products", LEVELS)
    return nodes.select("rep_id", F.col("path").alias("child_path"))


def _level(depth: int, fields: dict) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        nodes = dewey.dewey_nodes(table(spark, d, "rawreport"), "rep_id", "similar_products", LEVELS[:depth])
        return dewey.dewey_table(nodes, "rep_id", "/".join(LEVELS[:depth]), fields)

    return run


p3_products = _level(1, {"id": (["$.id", "$.productIdInSupermarket"], "string"), "description": (["$.description", "$.denomination"], "string"), "brand": (["$.brand"], "string"), "price": (["$.price"], "double"), "unit_price": (["$.unit_price"], "string"), "distance": (["$.distance"], "double"), "calories": (["$.nutrition_information.calories.value"], "string")})
p3_offers = _level(2, {"seller": (["$.seller"], "string"), "price": (["$.price"], "double"), "stock_units": (["$.stock.units"], "int"), "zone": (["$.stock.store.zone"], "string")})
p3_promos = _level(3, {"code": (["$.code"], "string"), "label": (["$.label"], "string")})
p3_tiers = _level(4, {"min_units": (["$.min_units"], "int"), "off": (["$.off"], "double")})

QUERIES: dict[str, Query] = {f.__name__: f for f in (
    match_brand, match_no_brand, knn_topk, match_overlapping_buckets, match_own_brand_flag, match_global, match_catalog_brand, match_catalog_no_brand, category_map,
    normalize_text, slug_categories, accent_removal, category_filter, category_counter, white_label, brand_min_count, product_text,
    legacy_product_text, dedup_last_wins, dedup_pairs, eval_matches, eval_general, eval_report, truth_pairs, eval_categories_macro,
    eval_categories, norepeat, norepeat_message, flatten_json, flatten_report, csv_columns, csv_columns_report, match_compat, io_products, io_report_csv, io_buckets, io_truth, io_category_map, io_white_labels, io_translations, translate_lookup, golden_set_expand,
    bucket_pairing, map_entries, slug_originals, report_norepeat, report_norepeat_message, report_eval_general, report_eval_report, product_category_map, p1_units, p1_found, p2_found, p2_since_latest, p3_found,
)} | {"p3_products": p3_products, "p3_offers": p3_offers, "p3_promos": p3_promos, "p3_tiers": p3_tiers}
