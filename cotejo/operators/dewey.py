"""Deeply nested records as flat tables that keep their parent links: Dewey labelling (problem 3).

A node's label is the ordinal path to it (``similar_products.0.offers.2``). The parent's label is the label without
its last array and place, so no join is needed to link the levels; nodes are grouped into tables by their schema path
(``similar_products/offers``). The walk is one nested higher-order expression over the parsed VARIANT, built from the
list of array names, so a record is parsed once and exploded once, and no row of it meets another row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _elements(value: Column) -> Column:
    """The array's elements; an object in the array's place is its element 0; anything else has none."""
    one = F.when(_is_object(value), F.array(value))
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), one, F.array().cast("array<variant>"))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _nodes(value: Column, arrays: tuple[str, ...], prefix: Column, schema: str) -> Column:
    """array<struct<path, schema_path, node>> of the objects of this array and of those below it."""
    name = arrays[0]
    schema = f"{schema}/{name}" if schema else name

    def label(pair: Column) -> Column:
        return F.concat(prefix, F.lit(f"{name}."), pair["i"].cast("string"))

    def here(pair: Column) -> Column:
        own = F.array(F.struct(label(pair).alias("path"), F.lit(schema).alias("schema_path"), pair["x"].alias("node")))
        if len(arrays) == 1:
            return own
        below = F.try_variant_get(pair["x"], f"$.{arrays[1]}", "variant")
        return F.concat(own, _nodes(below, arrays[1:], F.concat(label(pair), F.lit(".")), schema))

    pairs = F.transform(_elements(value), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.flatten(F.transform(F.filter(pairs, lambda p: _is_object(p["x"])), here))


def dewey_nodes(df: DataFrame, row_id: str, text: str, arrays: tuple[str, ...]) -> DataFrame:
    """One row per object in the nested ``arrays``: row id, path, parent_path, schema_path, ordinal, depth, node.

    ``text`` holds JSON whose top value stands for ``arrays[0]``. Elements that are not objects keep their place and
    give no row; an object in an array's place is element 0; null, empty and invalid texts and a missing, null or empty
    array give none. ``node`` is the object as VARIANT, ``parent_path`` null on the first level. Repeated rows give
    their nodes again, under the same row id.
    """
    parsed = F.try_parse_json(F.col(text))
    rows = df.select(F.col(row_id).alias("row_id"), parsed.alias("v")).where(F.col("v").isNotNull())
    nodes = rows.select("row_id", F.explode(_nodes(F.col("v"), arrays, F.lit(""), "")).alias("n"))
    path = F.col("n.path")
    return nodes.select(
        F.col("row_id").alias(row_id), path.alias("path"),
        F.nullif(F.regexp_replace(path, r"\.?[^.]+\.\d+$", ""), F.lit("")).alias("parent_path"),
        F.col("n.schema_path").alias("schema_path"), F.regexp_extract(path, r"(\d+)$", 1).cast("int").alias("ordinal"),
        F.size(F.split("n.schema_path", "/")).alias("depth"), F.col("n.node").alias("node"),
    )


def dewey_table(nodes: DataFrame, row_id: str, schema_path: str, fields: dict[str, tuple[list[str], str]]) -> DataFrame:
    """The flat table of one schema path: ``fields`` maps a column to its JSON paths, tried in order, and its type.
    A field that is missing, null or of another kind is null."""
    of = lambda paths, kind: F.coalesce(*[F.try_variant_get("node", p, kind) for p in paths])
    rows = nodes.where(F.col("schema_path") == schema_path)
    return rows.select(row_id, "path", "parent_path", "ordinal", *[of(p, k).alias(c) for c, (p, k) in fields.items()])
