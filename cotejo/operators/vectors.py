"""Exact nearest neighbours inside equal keys.

Buckets are cut into blocks of bounded size on both sides, by counts taken first; each pair of blocks is one Arrow
cogroup for a NumPy kernel, so a bucket that holds a third of all rows becomes many tasks and no task holds a whole
bucket. Winners per block pair are merged by key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; two blocks of 64 doubles a row and one strip of distances take about 20 MB.
BLOCK_ROWS = 4096
_STRIP = 256


def is_vector(vector: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.size(vector) > 0, F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.asarray(column.tolist(), np.float64).reshape(len(column), -1)


def nearest(a: np.ndarray, b: np.ndarray, order: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of each row's k nearest of b; equal distances by ``order`` of b. Distances of the
    candidates, and of all within 1e-9 of the k-th, are summed directly."""
    rows, cols, dists = [], [], []
    square = (b * b).sum(1)
    for start in range(0, len(a), _STRIP):
        part = a[start : start + _STRIP]
        rough = -(part @ b.T) if metric == "dot" else (part * part).sum(1)[:, None] + square[None, :] - 2 * (part @ b.T)
        edge = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        r, c = np.nonzero(rough <= edge[:, None] + 1e-9 * (1 + np.abs(edge[:, None])))
        exact = -(part[r] * b[c]).sum(1) if metric == "dot" else ((part[r] - b[c]) ** 2).sum(1)
        sort = np.lexsort((order[c], exact, r))
        r, c, exact = r[sort], c[sort], exact[sort]
        first = np.searchsorted(r, r, side="left")
        keep = np.arange(len(r)) - first < k
        rows.append(r[keep] + start)
        cols.append(c[keep])
        dists.append(exact[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _kernel(k: int, metric: str, keys: list[str]) -> Callable:
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in (*keys, "a_pos", "b_pos", "distance")})
        place = right["pos"].to_numpy()
        order = np.unique(place, return_inverse=True)[1]
        r, c, d = nearest(_matrix(left["v"]), _matrix(right["v"]), order, k, metric)
        return pd.DataFrame({"a_pos": left["pos"].to_numpy()[r], "b_pos": place[c], "distance": d} | {name: [value] * len(r) for name, value in zip(keys, key)})

    return run


def knn_join(a: DataFrame, b: DataFrame, keys: list[str], pos: str, vector: str, k: int = 1, metric: str = "l2", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``<keys>, a_pos, b_pos, distance, rank`` of the k nearest rows of ``b`` for each row of ``a`` with equal ``keys``.

    ``metric`` is ``l2`` (squared Euclidean distance) or ``dot`` (negative inner product). Ties go to the smaller
    ``b_pos``. Rows with a null key or an empty or null vector take no part; a key on one side only gives no row.
    ``pos``, a number or a text, must be unique within a key on each side; a row that lies in several buckets is ranked
    in each of them. Vectors of one bucket must have one length; they travel in the type that they have.
    """

    def side(df: DataFrame) -> DataFrame:
        rows = df.where(is_vector(F.col(vector)))
        for key in keys:
            rows = rows.where(F.col(key).isNotNull())
        kind = dict(df.dtypes)[vector]
        v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
        return rows.select(*[F.col(key).alias(f"__{key}") for key in keys], F.col(pos).alias("pos"), v.alias("v"))

    left, right = side(a), side(b)
    named, keys = keys, [f"__{key}" for key in keys]
    blocks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    grid = blocks(left, "na").join(blocks(right, "nb"), keys) if keys else blocks(left, "na").crossJoin(blocks(right, "nb"))  # one row a key
    on = (lambda df: df.join(grid, keys)) if keys else (lambda df: df.crossJoin(F.broadcast(grid)))
    spread = lambda own, other: [F.pmod(F.xxhash64("pos"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))]
    one, all_ = spread("na", "nb")
    left = on(left).select(*keys, "pos", "v", one.alias("ba"), all_.alias("bb"))
    one, all_ = spread("nb", "na")
    right = on(right).select(*keys, "pos", "v", one.alias("bb"), all_.alias("ba"))
    group, kinds = [*keys, "ba", "bb"], dict(left.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"a_pos {kinds['pos']}", f"b_pos {dict(right.dtypes)['pos']}", "distance double"])
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(_kernel(k, metric, keys), schema)
    rank = F.row_number().over(Window.partitionBy(*keys, "a_pos").orderBy("distance", "b_pos"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(*[F.col(c).alias(name) for c, name in zip(keys, named)], "a_pos", "b_pos", "distance", "rank")


def unit_length(vector: Column) -> Column:
    """The vector scaled to length one as doubles; zeros stay zeros."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def weighted_vector(vectors: list[Column], weights: list[float]) -> Column:
    """One vector whose inner products are the weighted sums of the cosines of several vectors."""
    scaled = lambda v, root: F.transform(unit_length(v), lambda x: x * root)
    return F.concat(*[scaled(v, float(np.sqrt(w))) for v, w in zip(vectors, weights, strict=True)])
