"""Nested JSON as flat rows and ragged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a ragged table may get unless more are asked for; more raise an error.
MAX_PATHS = 20_000
_LEAVES = "array<struct<path:string,v:variant>>"


def _kind(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), r"^(OBJECT|ARRAY)", 1), F.lit(""))


def _members(value: Column) -> Column:
    """array<struct<key, value>> of an object's members or an array's elements."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    elements = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    return F.coalesce(entries, elements)


def _walk(value: Column, path: Column, in_array: Column, depth: int) -> Column:
    kind = _kind(value)
    inner = (kind == "OBJECT") | ((kind == "ARRAY") & ~in_array)
    own = F.array(F.struct(path.alias("path"), value.alias("v")))
    if depth == 0:
        return F.when(inner, F.raise_error(F.concat(F.lit("nested deeper than max_depth: "), path)).cast("void").cast(_LEAVES)).otherwise(own)
    below = F.flatten(F.transform(_members(value), lambda m: _walk(m["value"], F.concat(path, F.lit("."), m["key"]), kind == "ARRAY", depth - 1)))
    return F.when(inner, below).otherwise(own)


def nesting(df: DataFrame, text: str) -> int:
    """Levels of the deepest record: brackets outside quotes, counted in one pass. At least 1."""
    bare = F.regexp_replace(F.regexp_replace(F.col(text), r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]++", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    signs = F.filter(F.split(bare, ""), lambda c: c != "")
    depth = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]
    return max(1, df.agg(F.max(depth)).first()[0] or 1)


def leaves(value: Column, max_depth: int) -> Column:
    """Leaves of one object as array<struct<path, v>>, in one nested expression: no explode, no shuffle."""
    return F.flatten(F.transform(_members(value), lambda m: _walk(m["value"], m["key"], F.lit(False), max_depth - 1)))


def _objects(df: DataFrame, row_id: str, text: str) -> DataFrame:
    parsed = df.select(F.col(row_id).alias("r"), F.try_parse_json(F.col(text)).alias("v"))
    one = F.when(_kind(F.col("v")) == "OBJECT", F.array("v"))
    objects = F.coalesce(one, F.try_variant_get("v", "$", "array<variant>"))
    return parsed.select("r", F.posexplode(F.filter(objects, lambda x: _kind(x) == "OBJECT")).alias("item", "v"))


def _text(value: Column) -> Column:
    """The text of a leaf. A whole number written with a point keeps it (``2.0``), as a decimal of no places tells."""
    plain = F.try_variant_get(value, "$", "string")
    pointed = F.schema_of_variant(value).rlike(r"^DECIMAL\(\d+,0\)$")
    return F.coalesce(F.when(pointed, F.concat(plain, F.lit(".0"))).otherwise(plain), F.when(~F.is_variant_null(value), F.to_json(value)))


def flatten_json(df: DataFrame, row_id: str, text: str, max_depth: int | None = None) -> DataFrame:
    """``row_id, item, path, value, is_null`` of every leaf: members by name, elements by zero-based place; an array
    inside an array stays one leaf; empty objects and arrays vanish. ``value`` is the text of a scalar, JSON of a kept
    array, null for a JSON null (``is_null`` tells it from a missing path).

    A top array gives its objects as items 0, 1, ...; elements of other kinds are skipped; other top values and null,
    empty or invalid texts give nothing. Repeated rows give their leaves again. ``max_depth`` is measured in a pass of its
    own unless given; records nested deeper than a given one are an error.
    """
    max_depth = nesting(df, text) if max_depth is None else max_depth
    rows = _objects(df, row_id, text).select("r", "item", F.explode(leaves(F.col("v"), max_depth)).alias("x"))
    return rows.select(F.col("r").alias(row_id), "item", F.col("x.path").alias("path"), _text(F.col("x.v")).alias("value"), F.is_variant_null("x.v").alias("is_null"))


def header(df: DataFrame, row_id: str, text: str, max_depth: int | None = None, max_paths: int = MAX_PATHS) -> list[str]:
    """Every path that occurs, in code-point order (``.10.`` before ``.2.``)."""
    paths = flatten_json(df, row_id, text, max_depth).select("path").distinct().limit(max_paths + 1).collect()
    if len(paths) > max_paths:
        raise ValueError(f"more than {max_paths} paths: not a table")
    return sorted(r["path"] for r in paths)


def ragged_table(df: DataFrame, row_id: str, text: str, paths: list[str] | None = None, filler: str = "Not found", max_depth: int | None = None, max_paths: int = MAX_PATHS) -> DataFrame:
    """One row per object and one text column per path: ``filler`` where the path is missing, empty where it is null.
    Cells come from a map built within the row, so there is no pivot and no shuffle."""
    max_depth = nesting(df, text) if max_depth is None else max_depth
    paths = header(df, row_id, text, max_depth, max_paths) if paths is None else paths
    cells = F.transform(leaves(F.col("v"), max_depth), lambda x: F.struct(x["path"], F.coalesce(_text(x["v"]), F.lit(""))))
    rows = _objects(df, row_id, text).select(F.col("r").alias(row_id), "item", F.map_from_entries(cells).alias("m"))
    return rows.select(row_id, "item", *[F.coalesce(F.try_element_at("m", F.lit(p)), F.lit(filler)).alias(p) for p in paths])
