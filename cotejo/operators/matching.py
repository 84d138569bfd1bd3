"""One-to-one assignment of candidates (W1-W3) in three modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.operators.vectors import knn_join
from cotejo.session import cut, release, shuffle_width


def one_to_one(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Greedy assignment when each a has one candidate per bucket: the nearest a of every b, ties to the smaller
    a_pos. An aggregate with map-side combining, so a b that is everyone's candidate is no hot spot. A loser gets no
    second choice."""
    keys = [*(keys or []), "b_pos"]
    best = candidates.groupBy(*keys).agg(F.min(F.struct("distance", "a_pos")).alias("m"))
    return best.select(*keys, F.col("m.a_pos").alias("a_pos"), F.col("m.distance").alias("distance"))


def match(a: DataFrame, b: DataFrame, keys: list[str], pos: str, vector: str) -> DataFrame:
    """Mode ``independent``: nearest neighbour inside each bucket, then one-to-one inside it."""
    return one_to_one(knn_join(a, b, keys, pos, vector), keys)


def match_global(candidates: DataFrame) -> DataFrame:
    """Mode ``global``: greedy over the candidates of all buckets by (distance, a_pos, b_pos), each a and b once.

    Rounds of locally dominant pairs: a pair that is the best of its a and of its b is what the greedy walk would take,
    so all such pairs are taken at once and their neighbours dropped. The best of all pairs is always one of them, so
    rounds end. Each round's rest is cut through reliable storage and replaces the one before. Repeated candidates
    count once; null distances are dropped.
    """
    rest = cut(candidates.where(F.col("distance").isNotNull()).groupBy("a_pos", "b_pos").agg(F.min("distance").alias("distance")))
    taken: list[DataFrame] = []
    while not rest.isEmpty():
        best_a = rest.groupBy("a_pos").agg(F.min(F.struct("distance", "a_pos", "b_pos")).alias("m")).select("m.*")
        best_b = rest.groupBy("b_pos").agg(F.min(F.struct("distance", "a_pos", "b_pos")).alias("m")).select("m.*")
        chosen = cut(best_a.join(best_b, ["distance", "a_pos", "b_pos"]))
        taken.append(chosen)
        rest = cut(rest.join(chosen.select("a_pos"), "a_pos", "left_anti").join(chosen.select("b_pos"), "b_pos", "left_anti"), before=rest)
    release(rest)
    out = candidates.select("a_pos", "b_pos", "distance").limit(0)
    for part in taken:
        out = out.unionByName(part)
    return out


def numbered(df: DataFrame, group: list[str], order: str, number: str) -> DataFrame:
    """Adds the zero-based place of each row within its group, by ``order``. Rows are sorted in ranges, so that a group of
    a third of all rows is several tasks; the sum of the ranges before is one row a group and range."""
    ranges = cut(df.repartitionByRange(shuffle_width(df.sparkSession), *group, order).withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(order)) - 1
    return ranges.join(sizes.select(*group, "__range", before.alias("__before")), [*group, "__range"]).withColumn(number, here + F.col("__before")).drop("__range", "__before")


def match_compat(a: DataFrame, b: DataFrame, bucket: str, pos: str, vector: str, block_rows: int | None = None) -> DataFrame:
    """Mode ``compat``: ``<bucket>, brand_type, a_pos, b_pos, distance`` as if buckets were worked off in order of their
    names, the brand part of each before its other part, with marks of used products handed from one to the next.

    Brand parts mark ids and drop candidates whose id is marked. Other parts leave out products whose id is marked when
    they begin, but mark places in their own remaining list, and drop candidates whose place any of them has marked
    before. Every product has one candidate a part, so who gets an id or a place is the first by (bucket, distance,
    a_pos): aggregates instead of a walk. Wants ``id, brand_type, brand_key`` and one row per id and bucket.
    """
    more = {} if block_rows is None else {"block_rows": block_rows}
    brand, other = (lambda df: df.where(F.col("brand_type") == "brand")), (lambda df: df.where(F.col("brand_type") != "brand"))
    ids = brand(b).select(bucket, F.col(pos).alias("b_pos"), F.col("id").alias("b_id"))
    found = knn_join(brand(a), brand(b), [bucket, "brand_key"], pos, vector, **more).join(ids, [bucket, "b_pos"])
    first = cut(found.groupBy("b_id").agg(F.min(F.struct(bucket, "distance", "a_pos", "b_pos")).alias("m")))
    marked = first.select(F.col("b_id").alias("id"), F.col(f"m.{bucket}").alias("__since"))
    free = other(b).join(marked, "id", "left").where(F.col("__since").isNull() | (F.col("__since") > F.col(bucket))).drop("__since")
    places = numbered(free.where(F.size(vector) > 0), [bucket], pos, "__place")
    found = knn_join(other(a), places, [bucket], pos, vector, **more).join(places.select(bucket, F.col(pos).alias("b_pos"), "__place"), [bucket, "b_pos"])
    rest = found.groupBy("__place").agg(F.min(F.struct(bucket, "distance", "a_pos", "b_pos")).alias("m"))
    shape = lambda df, kind: df.select(F.col(f"m.{bucket}").alias(bucket), F.lit(kind).alias("brand_type"), "m.a_pos", "m.b_pos", "m.distance")
    return shape(first, "brand").unionByName(shape(rest, "no_brand"))
