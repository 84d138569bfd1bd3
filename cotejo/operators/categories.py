"""Category maps between two catalogues."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import slug
from cotejo.operators.evaluate import category_labels, macro_metrics
from cotejo.operators.vectors import knn_join, weighted_vector

THRESHOLD, WEIGHTS = 0.5, (0.5, 0.5)


class Translator(Protocol):
    def translate_batch(self, texts: list[str]) -> list[str]: ...

    def translate(self, text: str) -> str: ...


def distinct_categories(products: DataFrame, category: str = "category") -> DataFrame:
    return products.where(F.col(category).isNotNull()).select(F.col(category).alias("category")).distinct()


def translate(words: DataFrame, word: str, dictionary: DataFrame | None) -> DataFrame:
    """Adds ``translated``: the dictionary's entry, or the word itself. A word listed twice takes its smallest entry;
    no dictionary translates nothing."""
    if dictionary is None:
        return words.withColumn("translated", F.col(word))
    entries = dictionary.where(F.col("original").isNotNull()).groupBy(F.col("original").alias("__o")).agg(F.min("translated").alias("__t"))
    return words.join(entries, F.col(word) == F.col("__o"), "left").withColumn("translated", F.coalesce("__t", F.col(word))).drop("__o", "__t")


def translate_new(words: DataFrame, word: str, cache: DataFrame, load: Callable[[], Translator]) -> DataFrame:
    """The cache with the words that it lacks: ``original, translated``. Each Arrow batch is tried as a whole, then word by
    word where that fails; a word that fails alone stays as it is. ``load`` makes the translator once a worker."""
    known = cache.where(F.col("original").isNotNull()).groupBy("original").agg(F.min("translated").alias("translated"))
    new = words.where(F.col(word).isNotNull()).select(F.col(word).alias("original")).distinct().join(known, "original", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translator = load()

        def one(text: str) -> str:
            try:
                return translator.translate(text)
            except Exception:  # noqa: BLE001 - whatever a caller's translator raises, the word stays
                return text

        for batch in batches:
            texts = batch["original"].tolist()
            try:
                done = list(translator.translate_batch(texts))
                if len(done) != len(texts):
                    raise ValueError("not one translation a word")
            except Exception:  # noqa: BLE001
                done = [one(t) for t in texts]
            yield pd.DataFrame({"original": texts, "translated": [t if d is None else d for d, t in zip(done, texts)]})

    return known.unionByName(new.mapInPandas(run, "original string, translated string"))


def map_metrics(mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of macro precision, recall and f1 of a map against an evaluation set, both as slugs; categories that the
    set doesn't list are left out, of a source mapped twice the greater target counts."""
    named = lambda df, target: df.select(slug(F.col("source_category")).alias("source_category"), slug(F.col(target)).alias("target_category"))
    predicted = named(mapping, "matched_target_category").withColumn("pos", F.coalesce("target_category", F.lit("")))
    return macro_metrics(category_labels(predicted, named(truth, "target_category").distinct()), "expected", "predicted")


def map_categories(source: DataFrame, target: DataFrame, name: str, vectors: list[str], weights: tuple[float, ...] = WEIGHTS, threshold: float = THRESHOLD) -> DataFrame:
    """``source_category, matched_target_category, similarity_score``: the target of the highest weighted cosine, null
    below ``threshold`` (compared before rounding to 4 places). Ties go to the first target in code-point order.
    Null names take no part, repeated names count once; an empty target side maps nothing."""

    def side(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(name).isNotNull()).groupBy(name).agg(*[F.min_by(v, F.to_json(v)).alias(v) for v in dict.fromkeys(vectors)])
        rows = rows.withColumn("__w", weighted_vector([F.col(v) for v in vectors], list(weights)))
        return rows.select(F.col(name).alias("__name"), "__w")

    best = knn_join(side(source), side(target), [], "__name", "__w", 1, "dot").withColumn("__s", -F.col("distance"))
    return best.select(F.col("a_pos").alias("source_category"), F.when(F.col("__s") >= threshold, F.col("b_pos")).alias("matched_target_category"), F.round("__s", 4).alias("similarity_score"))


def slugged(mapping: DataFrame) -> DataFrame:
    return mapping.withColumns({c: slug(F.col(c)) for c in ("source_category", "matched_target_category")})


def as_map_document(mapping: DataFrame, source: str, target: str) -> DataFrame:
    """The one-row map object of the exchange format; a map has one entry per category, so it stays small."""
    entries = F.sort_array(F.collect_list(F.struct("source_category", "matched_target_category", "similarity_score")))
    return mapping.agg(entries.alias("mapping_results")).select(F.lit(source).alias("source_supermarket"), F.lit(target).alias("target_supermarket"), "mapping_results")


def originals(slugs: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Adds ``original``: the smallest name with that slug, or the slug itself."""
    known = names.where(F.col(name).isNotNull()).groupBy(slug(F.col(name)).alias("__s")).agg(F.min(name).alias("__n"))
    return slugs.join(known, F.col(column) == F.col("__s"), "left").withColumn("original", F.coalesce("__n", F.col(column))).drop("__s", "__n")


def expand_golden_set(pairs: DataFrame, column: str = "pair") -> DataFrame:
    """Legacy ``[[sources], [targets]]`` pairs as ``source_category, target_category`` rows, trimmed; no targets give
    one null target; pairs that aren't two lists or have no source are skipped."""
    rows = pairs.where((F.size(column) == 2) & (F.size(F.get(F.col(column), F.lit(0))) > 0))
    source = F.btrim(F.get(F.get(F.col(column), F.lit(0)), F.lit(0)))
    rows = rows.select(source.alias("source_category"), F.get(F.col(column), F.lit(1)).alias("__t"))
    return rows.select("source_category", F.explode_outer("__t").alias("target_category")).withColumn("target_category", F.btrim("target_category"))
