"""Catalogue preparation: category filter by prefix, brand classification, counters, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.products import NO_BRAND, base_text, brand_type, final_brand, product_text
from cotejo.functions.text import category_key


def category_pairs(category_map: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(source_key, target_key) of the usable mappings of a map table, distinct. Null or empty names are dropped, and
    so are keys that normalize to nothing, unless ``keep_empty``: such a key is a prefix of everything."""
    rows = category_map.select(F.explode("mapping_results").alias("m")).select("m.*")
    rows = rows.where((F.col("source_category") != "") & (F.col("matched_target_category") != ""))
    rows = rows.select(category_key(F.col("source_category")).alias("source_key"), category_key(F.col("matched_target_category")).alias("target_key")).distinct()
    return rows if keep_empty else rows.where((F.col("source_key") != "") & (F.col("target_key") != ""))


def prefix_join(df: DataFrame, value: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Rows of ``df`` with every pattern that begins ``value``, as an equi-join on the prefixes of the lengths that
    patterns have: no nested loop. A row gets at most one copy per pattern length. Null values match nothing; an
    empty pattern matches every value that isn't null."""
    lengths = patterns.agg(F.sort_array(F.collect_set(F.length(pattern))).alias("__lengths"))  # one row
    cut = df.crossJoin(F.broadcast(lengths))
    cut = cut.withColumn("__len", F.explode(F.filter("__lengths", lambda n: n <= F.length(value))))
    cut = cut.withColumn("__prefix", F.expr(f"substring(`{value}`, 1, __len)"))
    return cut.join(patterns, F.col("__prefix") == F.col(pattern)).drop("__len", "__prefix", "__lengths")


def bucketed(products: DataFrame, category: str, pairs: DataFrame, side: str) -> DataFrame:
    """Products in the buckets of their side (source or target); a bucket is named by the source key on both sides.
    No pairs at all keeps nothing; ``bucket_all`` is the bypass."""
    keyed = products.withColumn("__cat", category_key(F.col(category)))
    own = pairs.select(F.col("source_key").alias("bucket"), F.col(f"{side}_key").alias("__pattern")).distinct()
    return prefix_join(keyed, "__cat", own, "__pattern").drop("__cat", "__pattern")


def bucket_all(products: DataFrame) -> DataFrame:
    return products.withColumn("bucket", F.lit(""))


def filter_categories(products: DataFrame, category: str, categories: list[str]) -> DataFrame:
    """Products whose category key begins with the key of one of ``categories``, each once; no categories at all keep
    every product."""
    if not categories:
        return products
    patterns = products.sparkSession.createDataFrame([(c,) for c in sorted(set(categories))], "c string").select(category_key(F.col("c")).alias("__pattern")).distinct()
    keyed = products.withColumn("__cat", category_key(F.col(category)))
    inside = prefix_join(keyed.select("__cat").distinct(), "__cat", patterns, "__pattern").select("__cat").distinct()
    return keyed.join(inside, "__cat", "left_semi").drop("__cat")


def category_counter(source: DataFrame, target: DataFrame, pairs: DataFrame, category: str = "category") -> DataFrame:
    """``category_key, n_products``: products of both sides by their own category key, counted once for every mapping
    (``source_key, target_key``) whose pattern of their side begins it. Keys are counted first and then meet the
    patterns, so a hot category is one row."""

    def hits(products: DataFrame, side: str) -> DataFrame:
        counts = products.groupBy(category_key(F.col(category)).alias("category_key")).agg(F.count("*").alias("n"))
        return prefix_join(counts, "category_key", pairs.select(F.col(f"{side}_key").alias("__pattern")), "__pattern").select("category_key", "n")

    return hits(source, "source").unionAll(hits(target, "target")).groupBy("category_key").agg(F.sum("n").alias("n_products"))


def classify_brands(products: DataFrame, patterns: list[str], min_count: int = 1, within: list[str] | None = None) -> DataFrame:
    """``brand`` final and ``brand_type``. With ``min_count`` above 1 a brand seen less often in its group (``within``)
    becomes NO BRAND; counts are joined back by key, as hot brands are then one row only."""
    out = products.withColumn("brand", final_brand(F.col("brand"), patterns))
    if min_count > 1:
        keys = ["brand", *(within or [])]
        counts = out.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") < min_count).drop("__n")
        rare = counts.withColumn("__rare", F.lit(True))
        out = out.join(rare, keys, "left").withColumn("brand", F.when(F.col("__rare"), F.lit(NO_BRAND)).otherwise(F.col("brand"))).drop("__rare")
    return out.withColumn("brand_type", brand_type(F.col("brand")))


def product_texts(products: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``product_concatenation``; products whose text normalizes to nothing are dropped before any encoding."""
    text: Column = product_text(base_text(F.col("supermarket"), strict=strict), F.col("brand"), F.col("raw_ingredients"), F.col("nutrition_information"))
    return products.withColumn("product_concatenation", text).where(F.col("product_concatenation") != "")


def bucket_pairing(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Every bucket of the source with its sizes; ``paired`` is false where the target has no such bucket."""
    left = source.groupBy(*keys).agg(F.count("*").alias("n_source"))
    right = target.groupBy(*keys).agg(F.count("*").alias("n_target"))
    return left.join(right, keys, "left").withColumn("paired", F.col("n_target").isNotNull()).fillna(0, ["n_target"])
