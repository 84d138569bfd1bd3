"""Queries of the problems tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.functions import lookalikes
from cotejo.llm import bktree, canon, encoding, identity, mixing, quality, rpforest
from cotejo.session import table

Query = Callable[[SparkSession, str], DataFrame]


#: The two groups of the test tables; as a brand they name no maker.
SELLERS = ("EROSKI", "Makro")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return identity.same_product_pairs(table(spark, d, "rawreport"), "rep_id", sellers=SELLERS)


def p4_products(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with its product and the size of the product's group."""
    of = identity.products(table(spark, d, "rawreport"), "rep_id", sellers=SELLERS)
    sizes = of.groupBy("product").agg(F.count("*").alias("n_listings"))
    return of.join(sizes, "product").select(F.col("row").alias("rep_id"), "product", "n_listings")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "products").select("pos", "id", "description", "denomination", "brand")
    return canon.lookalike_pairs(rows, "pos", "id", ["description", "denomination", "brand"])


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its one form."""
    return canon.canonical_columns(table(spark, d, "documents").select("doc_id", "text", "brand"), ["text", "brand"])


def p5_products(spark: SparkSession, d: str) -> DataFrame:
    """Description, denomination and brand of every product row in their one form."""
    rows = table(spark, d, "products").select("pos", "id", "description", "denomination", "brand")
    return canon.canonical_columns(rows, ["description", "denomination", "brand"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return bktree.map_rows(table(spark, d, "products"), "pos", "brand", table(spark, d, "brand_reference"), "brand_id", "brand_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return rpforest.similar_pairs(table(spark, d, "processed_products"), "vec_id", "product_embedding", 64, 5, 0.9)


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Up to five most similar vectors of every vector, whatever their cosine."""
    return rpforest.most_similar(table(spark, d, "processed_products"), "vec_id", "product_embedding", 64, 5).withColumn("cosine", F.round("cosine", 5))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their tokens and repeats."""
    return mixing.mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return mixing.mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))[1]


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What any right mixture of the documents must fulfil: which sources are filled, that no document is used more often
    than its source allows, and that each filled source holds its part of the filled sources' shares to a hundredth."""
    shares = p9_shares(spark, d)
    whole = F.sum(F.when(F.col("filled"), F.col("target_share")).otherwise(0.0)).over(Window.partitionBy())  # one row a target
    wanted = F.when(F.col("filled"), F.col("target_share") / whole).otherwise(0.0)
    return shares.select("source", "filled", (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"), (F.abs(F.col("actual_share") - wanted) < 0.01).alias("shared"))


def _common(spark: SparkSession, d: str) -> list[str]:
    return [r["word"] for r in table(spark, d, "common_words").select("word").distinct().collect()]  # a fixed list


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _common(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).where("doc_kind <> 'prose'").select("doc_id", "doc_kind")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics, type and posterior of the type."""
    return _typed(spark, d).withColumn("certainty", F.array_max("posterior")).drop("votes", "posterior", "readable")


def p10_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plain counts and shares of every document."""
    rows = quality.statistics(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _common(spark, d))
    shares = ["mean_word", "letter_share", "digit_share", "symbol_share", "common_share", "ended_share"]
    return rows.select("doc_id", "n_chars", "n_lines", "n_words", "n_tokens", "n_distinct_words", *[F.round(c, 6).alias(c) for c in shares])


QUERIES: dict[str, Query] = {f.__name__: f for f in (p4_found, p4_products, p5_found, p5_canonical, p5_products, p6_found, p7_found, p7_neighbours, p8_ids, p9_mix, p9_shares, p9_invariants, p10_found, p10_statistics, p10_counts)}


def _form(column: str) -> str:
    """The one visual form in SQL: single characters, then ligatures, then composition."""
    pairs = lookalikes.one_to_one()
    out = f"translate({column}, '{''.join(pairs) + lookalikes.invisible()}', '{''.join(pairs.values()).replace(chr(39), chr(39) * 2)}')"
    for one, several in lookalikes.expansions().items():
        out = f"replace({out}, '{one}', '{several}')"
    return f"nfc_normalize({out})"


#: Cosines of all vectors that take part, ranked for each of them.
_COSINES = """WITH v AS (SELECT vec_id, CAST(product_embedding AS DOUBLE[]) AS e FROM processed_products
  WHERE len(product_embedding) = 64 AND len(list_filter(product_embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(product_embedding, lambda x: x <> 0)) > 0),
  u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
  c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.n * b.n) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 7) DESC, b) AS k FROM c)
"""

#: SQL of the queries that SQL can say; the others are tested against brute force, a library or held-out labels.
ORACLES: dict[str, str] = {
    "p5_found": f"""WITH v AS (SELECT pos, id, 'description' AS field_name, description AS x FROM products UNION ALL SELECT pos, id, 'denomination', denomination FROM products
  UNION ALL SELECT pos, id, 'brand', brand FROM products),
  f AS (SELECT *, {_form('x')} AS form FROM v WHERE id IS NOT NULL AND trim(x) <> '')
SELECT a.pos AS pos_a, b.pos AS pos_b, a.field_name FROM f a JOIN f b ON a.id = b.id AND a.field_name = b.field_name AND a.form = b.form AND a.pos < b.pos AND a.x <> b.x WHERE trim(a.form) <> ''""",
    "p7_found": _COSINES + "SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE k <= 5 AND cosine >= 0.9",
    "p7_neighbours": _COSINES + "SELECT a AS vec_id, b AS near, round(cosine, 5) AS cosine FROM r WHERE k <= 5",
    "p5_products": f"SELECT pos, id, {_form('description')} AS description, {_form('denomination')} AS denomination, {_form('brand')} AS brand FROM products",
    "p9_invariants": """WITH t AS (SELECT source, max(coalesce(max_repeats, 1)) AS m FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY 1)
SELECT source, m > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0) AS filled, true AS capped, true AS shared FROM t""",
    "p10_counts": r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents),
  l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines, regexp_extract_all(lower(t), '[\p{L}\p{M}]+') AS words FROM t),
  c AS (SELECT list(DISTINCT lower(word)) AS ws FROM common_words WHERE word <> ''),
  n AS (SELECT doc_id, length(t) AS n_chars, len(lines) AS n_lines, len(words) AS n_words, len(regexp_extract_all(t, '\S+')) AS n_tokens, len(list_distinct(words)) AS n_distinct_words,
    list_sum(list_transform(words, lambda w: length(w))) AS letters, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(t, '[^\p{Nd}]', '', 'g')) AS dg, length(regexp_replace(t, '[\p{L}\p{M}\p{N}\s\v]', '', 'g')) AS sy,
    len(list_filter(words, lambda w: list_contains(ws, w))) AS cm, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…](?:["''»”)\]]*)\s*$'))) AS en FROM l, c)
SELECT doc_id, n_chars, n_lines, n_words, n_tokens, n_distinct_words, round(coalesce(letters / nullif(n_words, 0), 0), 6) AS mean_word, round(coalesce(l / nullif(n_chars, 0), 0), 6) AS letter_share, round(coalesce(dg / nullif(n_chars, 0), 0), 6) AS digit_share,
  round(coalesce(sy / nullif(n_chars, 0), 0), 6) AS symbol_share, round(coalesce(cm / nullif(n_words, 0), 0), 6) AS common_share, round(coalesce(en / nullif(n_lines, 0), 0), 6) AS ended_share FROM n""",
}
