"""Deduplication with a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the values of its last row with ``first_pos``, the place of its first. Null keys form a group.
    One aggregate with map-side combining; ``order`` must be unique within a key."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"), F.min(order).alias("first_pos"))
    return out.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], "first_pos")


def first_pair_wins(df: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Rows whose pair was not seen before; rows where an id is missing (null, empty, ``0``) pass through."""
    missing = lambda c: F.coalesce(F.col(c).cast("string").isin("", "0"), F.lit(True))
    unkeyed = missing(a) | missing(b)
    rest = [c for c in df.columns if c not in (a, b)]
    firsts = df.where(~unkeyed).groupBy(a, b).agg(F.min_by(F.struct(*rest), order).alias("r")).select(a, b, *[F.col(f"r.{c}").alias(c) for c in rest])
    return firsts.select(*df.columns).unionByName(df.where(unkeyed))
