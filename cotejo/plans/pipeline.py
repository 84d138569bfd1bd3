"""The five stages as plans in one session, and their command line (main entry points of the engine)."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.encoders import HashingEncoder, encode, main_words
from cotejo.functions.products import per_supermarket
from cotejo.functions.text import encoder_prefix
from cotejo.operators import catalog, categories, dedup, evaluate, flatten, matching
from cotejo.operators.vectors import knn_join
from cotejo.sources import readers, sinks


def execution_id(now: float | None = None) -> str:
    """``YYYYMMDD`` and epoch seconds."""
    now = time.time() if now is None else now
    return time.strftime("%Y%m%d", time.gmtime(now)) + str(int(now))


#: Each bucket alone; greedy over all buckets, every product once; buckets in order with marks handed on.
MATCH_MODES = ("independent", "global", "compat")


@dataclass(frozen=True)
class Config:
    supermarket_a: str = "EROSKI"
    supermarket_b: str = "Makro"
    match_mode: str = "independent"
    min_brand_count: int = 1
    white_labels: tuple[str, ...] = ()
    load_encoder: Callable[[], HashingEncoder] = HashingEncoder
    load_translator: Callable[[], categories.Translator] | None = None
    tag: Callable[[str], list[str]] | None = None
    run: str = field(default_factory=execution_id)

    def __post_init__(self) -> None:
        if self.match_mode not in MATCH_MODES:
            raise ValueError(f"match_mode {self.match_mode!r} is none of {', '.join(MATCH_MODES)}")


def tokenize(products: DataFrame, category_map: DataFrame, config: Config, encoder: bool = True) -> DataFrame:
    """Products of both sides in their buckets with final brand, text and vector. Text and vector are made once per
    product, before the bucket join copies it. A map without any entry filters nothing: all products share one bucket;
    entries that can't be used (no target, nothing left of a name) keep nothing."""
    ready = catalog.product_texts(catalog.classify_brands(products, list(config.white_labels), config.min_brand_count))
    if encoder:
        ready = encode(ready, "product_concatenation", "product_embedding", config.load_encoder)
    pairs = catalog.category_pairs(category_map)
    no_entries = category_map.where(F.size("mapping_results") > 0).isEmpty()  # the map is a short list
    in_buckets = lambda df, s: catalog.bucket_all(df) if no_entries else catalog.bucketed(df, "category", pairs, s)
    side = lambda name, s: in_buckets(ready.where(F.contains("supermarket", F.lit(name))), s).withColumn("side", F.lit(s))
    both = side(config.supermarket_a, "source").unionByName(side(config.supermarket_b, "target"))
    return both.withColumnRenamed("bucket", "category_key")


def find_similarities(processed: DataFrame, config: Config, pos: str = "pos") -> DataFrame:
    """``a_pos, b_pos, distance, category_key, brand_type``: brand products by equal upper-case brand, others by bucket."""
    rows = processed.withColumn("brand_key", F.when(F.col("brand_type") == "brand", F.upper("brand")).otherwise(F.lit("")))
    keys = ["category_key", "brand_type", "brand_key"]
    per_id = dedup.last_wins(rows.select("side", "id", *keys, "product_embedding", pos), ["side", "id", "category_key"], pos).drop("first_pos")
    a, b = per_id.where(F.col("side") == "source"), per_id.where(F.col("side") == "target")
    if config.match_mode == "compat":
        return matching.match_compat(a, b, "category_key", pos, "product_embedding")
    found = knn_join(a, b, keys, pos, "product_embedding")
    if config.match_mode == "global":
        first = found.groupBy("a_pos", "b_pos").agg(F.min(F.struct("distance", "category_key", "brand_type")).alias("m"))
        return matching.match_global(found).join(first.select("a_pos", "b_pos", "m.category_key", "m.brand_type"), ["a_pos", "b_pos"])
    return matching.one_to_one(found, ["category_key", "brand_type"])


def match_report(matches: DataFrame, products: DataFrame, config: Config, pos: str = "pos") -> DataFrame:
    """Report rows in the exchange form, with ``category_<supermarket>`` columns and a list of one similar product."""
    text = F.coalesce("description", "denomination").alias("description")
    words = main_words(F.col("product_concatenation"), config.tag).alias("main_words")
    common = ["id", text, "brand", "price", "unit_price", "category", "product_concatenation", words]
    a = products.select(F.col(pos).alias("a_pos"), *common)
    b = products.select(F.col(pos).alias("b_pos"), *common)
    similar = F.struct(*[F.col(f"b.{c}").alias(per_supermarket(c, config.supermarket_b) if c == "category" else c) for c in ("id", "description", "brand", "price", "unit_price", "category")], "m.distance", F.when(F.col("m.brand_type") == "no_brand", F.col("b.product_concatenation")).alias("product_concatenation"), F.when(F.col("m.brand_type") == "no_brand", F.col("b.main_words")).alias("main_words"))
    out = matches.alias("m").join(a.alias("a"), F.col("m.a_pos") == F.col("a.a_pos")).join(b.alias("b"), F.col("m.b_pos") == F.col("b.b_pos"))
    return out.select(F.col("m.a_pos").alias("pos"), *[F.col(f"a.{c}").alias(per_supermarket(c, config.supermarket_a) if c == "category" else c) for c in ("id", "description", "brand", "price", "unit_price", "category")], F.array(similar).alias("similar_products"))


def raw_category_map(products: DataFrame, config: Config, dictionary: DataFrame | None = None) -> DataFrame:
    """``source_category, matched_target_category, similarity_score`` of the two catalogues' own names: distinct names,
    translation of the source's, two encodings, weighted cosine."""

    def side(name: str, role: str) -> DataFrame:
        names = categories.distinct_categories(products.where(F.contains("supermarket", F.lit(name))))
        names = categories.translate(names, "category", dictionary if role == "query" else None)
        names = encode(names.withColumn("__q", encoder_prefix(F.col("category"), role)), "__q", "cross", config.load_encoder)
        return encode(names, "translated", "same", config.load_encoder).drop("__q")

    return categories.map_categories(side(config.supermarket_a, "query"), side(config.supermarket_b, "passage"), "category", ["cross", "same"])


def generate_category_map(products: DataFrame, config: Config, dictionary: DataFrame | None = None) -> DataFrame:
    """The one-row map of the exchange format, its names as slugs."""
    return categories.as_map_document(categories.slugged(raw_category_map(products, config, dictionary)), config.supermarket_a, config.supermarket_b)


def evaluate_matches(report: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(general report, row report) of a match report against known pairs."""
    generated = evaluate.report_pairs(report)
    known = evaluate.truth_pairs(truth, "ER Referencia eroski", "Ref competidor", ("Eroski_Denomination", "Makro_Denomination"))
    return evaluate.general_report(evaluate.micro_metrics(evaluate.outcomes(generated, known))), evaluate.evaluation_report(generated, known)


def evaluate_norepeat(report: DataFrame) -> DataFrame:
    return evaluate.repeat_message(evaluate.repeats(evaluate.similar_ids(report.withColumnRenamed("pos", "row")), "item", "row"))


def export_table(report: DataFrame) -> DataFrame:
    """The report as one flat row per pair, the first of a repeated one; a column per path that occurs."""
    return flatten.ragged_table(_export_rows(report), "pos", "doc").drop("item")


def _export_rows(report: DataFrame) -> DataFrame:
    rows = report.select("pos", F.col("id").alias("a"), F.get("similar_products", F.lit(0))["id"].alias("b"), F.to_json(F.struct(*[c for c in report.columns if c != "pos"]), {"ignoreNullFields": "false"}).alias("doc"))
    return dedup.first_pair_wins(rows, "a", "b", "pos")


def merge_reports(spark: SparkSession, paths: list[str], report: DataFrame) -> DataFrame:
    """The reports of earlier files (JSON arrays), in the order of ``paths``, and then this one; of a repeated pair the
    first row counts."""
    names = [f for f in report.schema.fields if f.name != "pos"]
    rows = readers.merge_json(spark, paths, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names))
    rows = rows.unionByName(report.withColumn("file_no", F.lit(len(paths))))
    first = F.get("similar_products", F.lit(0))["id"]
    rows = rows.withColumns({"__order": F.struct("file_no", "pos"), "__a": F.col("id"), "__b": first}).drop("file_no", "pos")
    return dedup.first_pair_wins(rows, "__a", "__b", "__order").drop("__a", "__b", "__order")


def write_category_map(products: DataFrame, config: Config, base: str, translations: str | None, evaluation: str | None) -> dict[str, str]:
    """The map stage: translation with its cache written back, the map, and its metrics where an evaluation set is
    given. Returns what was written."""
    spark = products.sparkSession
    written = {"category_map": f"{base}/category_map"}
    dictionary = readers.read_translations(spark, translations) if translations else None
    if config.load_translator:
        names = categories.distinct_categories(products.where(F.contains("supermarket", F.lit(config.supermarket_a))))
        known = dictionary if dictionary is not None else spark.createDataFrame([], "original string, translated string")
        # written first: the cache is read from the file that it may replace
        sinks.write_translations(categories.translate_new(names, "category", known, config.load_translator), f"{base}/translations")
        dictionary = readers.read_translations(spark, f"{base}/translations")
        written["translations"] = f"{base}/translations"
    raw = raw_category_map(products, config, dictionary)
    sinks.write_json(raw, f"{base}/raw_category_map")
    raw = spark.read.schema(raw.schema).json(f"{base}/raw_category_map")
    sinks.write_json_document(categories.as_map_document(categories.slugged(raw), config.supermarket_a, config.supermarket_b), written["category_map"])
    truth = readers.read_category_truth(spark, evaluation)
    if truth is not None:
        written["category_metrics"] = f"{base}/category_metrics"
        sinks.write_json(categories.map_metrics(raw, truth), written["category_metrics"])
    return written


def run_report(spark: SparkSession, products_path: str, map_path: str | None, out: str, config: Config, truth_path: str | None = None, translations: str | None = None, map_truth: str | None = None, earlier: list[str] | None = None) -> dict[str, str]:
    """All stages in order on JSON files; returns the folders written: category map (made where none is given, with its
    translations and metrics), buckets, counter, matches, report, export (flat JSON, ``;`` CSV, XLSX), merge with
    ``earlier`` reports, evaluation, repeat check, and the table of rows per stage. Vectors and matches are written and
    read again, which also cuts their lineage."""
    products = readers.read_products(spark, products_path)
    base, written = f"{out}/{config.run}", {}
    if map_path is None:
        written = write_category_map(products, config, base, translations, map_truth)
        map_path = written["category_map"]
    mapping = readers.read_category_map(spark, map_path)
    written |= {k: f"{base}/{k}" for k in ("buckets", "counter", "matches", "rawreport", "flat", "export", "xlsx", "norepeat", "progress", "summary")}
    processed = tokenize(products, mapping, config)
    sinks.write_buckets(processed, written["buckets"])
    processed = readers.read_buckets(spark, written["buckets"], schema=processed.schema)  # there are no files if no category is mapped
    sides = [products.where(F.contains("supermarket", F.lit(name))) for name in (config.supermarket_a, config.supermarket_b)]
    sinks.write_json(catalog.category_counter(*sides, catalog.category_pairs(mapping)), written["counter"])
    find_similarities(processed, config).write.mode("overwrite").parquet(written["matches"])
    matches = spark.read.parquet(written["matches"])
    one = processed.groupBy("pos").agg(F.min("product_concatenation").alias("product_concatenation"))
    report = match_report(matches, products.join(one, "pos"), config)
    sinks.write_json(report, written["rawreport"])
    report = spark.read.schema(report.schema).json(written["rawreport"])
    sinks.write_json(flatten.flatten_json(_export_rows(report), "pos", "doc"), written["flat"])
    sinks.write_report_csv(export_table(report), written["export"])
    flat = readers.read_csv_report(spark, written["export"])
    sinks.write_xlsx_file(flat, written["xlsx"], "report.xlsx")
    if earlier:
        written["merged"] = f"{base}/merged"
        sinks.write_json(merge_reports(spark, earlier, report), written["merged"])
    if truth_path and {config.supermarket_a.lower(), config.supermarket_b.lower()} <= {"eroski", "makro"}:
        general, rows = evaluate_matches(report, readers.read_truth(spark, truth_path))
        written |= {k: f"{base}/{k}" for k in ("evaluation", "metrics")}
        sinks.write_report_csv(rows, written["evaluation"])
        sinks.write_json(general, written["metrics"])
    sinks.write_json(evaluate_norepeat(report), written["norepeat"])
    sinks.write_json(sinks.progress({"products": products, "buckets": processed, "matches": matches, "report": report, "export": flat}), written["progress"])
    sinks.write_markdown(spark.read.json(written["progress"]).orderBy("stage"), written["summary"])
    return written


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("products", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--map", help="category map; made if none is given")
    parser.add_argument("--truth")
    parser.add_argument("--white-labels")
    parser.add_argument("--translations", help="JSON object of known translations of source categories")
    parser.add_argument("--map-truth", help="JSON array of source_category and target_category: metrics of the map that is made")
    parser.add_argument("--earlier", nargs="*", help="reports (JSON arrays) to merge with this one")
    parser.add_argument("--match-mode", choices=MATCH_MODES, default="independent")
    for name in ("a", "b"):
        parser.add_argument(f"--supermarket-{name}", default={"a": "EROSKI", "b": "Makro"}[name])
    x = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    labels = tuple(readers.read_white_labels(spark, x.white_labels)) if x.white_labels else ()
    config = Config(x.supermarket_a, x.supermarket_b, x.match_mode, white_labels=labels)
    for name, folder in run_report(spark, x.products, x.map, x.out, config, x.truth, x.translations, x.map_truth, x.earlier).items():
        print(f"{name}: {folder}")


if __name__ == "__main__":
    main()
