"""The k most similar vectors of every vector (problem 7): a forest of random-projection trees, one queue for all trees.

Trees are complete binary trees whose hyperplanes go through the median of a sample that grows with the leaves up to a
bound, so leaves stay even wherever vectors crowd. Every vector is stored in its leaf of each tree and asks the ``probes`` leaves that one priority queue,
shared by all trees and ordered by the largest margin crossed, gives first. Leaves are groups of an Arrow kernel that
reranks all their vectors by exact cosine. How many leaves are asked is measured on every table: the least that finds
TARGET of the true neighbours of held-out queries, in the crowded, middle and sparse third of them each. Where that costs
more than comparing all pairs, all pairs are compared. Vectors of one direction (copies, also scaled ones) are one representative
in all this and come back at the end, so a direction that a third of all rows share is no hot leaf."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.operators.skew import fragment_replicate_join
from cotejo.session import cut

#: Rows of the sample that hyperplanes are fitted on, so many for each leaf of a tree, from the least to the most; the
#: index itself holds every row. The most bounds what reaches the driver and every worker (50 MB of vectors).
LEAF_SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 16, 20_000, 200_000
#: Where the most binds, trees grow on as long as a node has so many rows of the sample; its halves are then less even.
NODE_SAMPLE = 4
TREES, PROBES, LEAF_ROWS = 6, 8, 1024
#: Rows of one side of a kernel's block; larger leaves are cut into blocks.
BLOCK_ROWS = 4096
#: Share of the true neighbours to find, the queries it is measured on, and the most probes tried for it.
TARGET, QUERIES, MOST_PROBES = 0.99, 1024, 128
#: Rows of one side of a block when all pairs are compared; copying a row to a group costs as much as comparing so many.
EXACT_ROWS, COPY_ROWS = 32_768, 2000
#: Decimals to which directions must agree to count as copies: their cosine is 1 to within 1e-10, less than the rounding
#: of the 32-bit numbers that they are made of.
_ROUND = 6


@dataclass(frozen=True)
class Forest:
    """normals[t, node] and offsets[t, node] of complete trees; node i has children 2i + 1 and 2i + 2."""

    depth: int
    normals: np.ndarray
    offsets: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.normals)

    def leaves(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """Leaf numbers (tree * 2^depth + leaf), one row per vector and one column per probe, in the queue's order. The
        first ``trees`` columns are the vector's own leaves."""
        n, inner = len(unit), (1 << self.depth) - 1
        probes = min(probes, self.trees << self.depth)
        room = self.trees + probes * self.depth
        cost = np.full((n, room), np.inf, np.float32)
        place = np.zeros((n, room), np.int64)
        cost[:, : self.trees], place[:, : self.trees] = -1, np.arange(self.trees) * inner if inner else 0
        tree_of = np.zeros((n, room), np.int32)
        tree_of[:, : self.trees] = np.arange(self.trees)
        place[:, : self.trees] = 0
        used, rows, out = self.trees, np.arange(n), np.zeros((n, probes), np.int64)
        for p in range(probes):
            pick = cost.argmin(1)
            now, node, tree = cost[rows, pick].copy(), place[rows, pick].copy(), tree_of[rows, pick].copy()
            cost[rows, pick] = np.inf
            while True:
                open_ = node < inner
                if not open_.any():
                    break
                # entries of one round are at different levels; each goes down one level
                i = np.flatnonzero(open_)
                margin = np.einsum("ij,ij->i", unit[i], self.normals[tree[i], node[i]]) - self.offsets[tree[i], node[i]]
                right = margin > 0
                far = 2 * node[i] + np.where(right, 1, 2)
                node[i] = 2 * node[i] + np.where(right, 2, 1)
                if used == cost.shape[1]:
                    cost = np.hstack([cost, np.full((n, self.depth), np.inf, np.float32)])
                    place = np.hstack([place, np.zeros((n, self.depth), np.int64)])
                    tree_of = np.hstack([tree_of, np.zeros((n, self.depth), np.int32)])
                cost[i, used] = np.maximum(now[i], np.abs(margin))
                place[i, used], tree_of[i, used] = far, tree[i]
                used += 1
            out[:, p] = tree.astype(np.int64) * (inner + 1) + node - inner
        return out


def fit(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 3) -> Forest:
    """Directions between two random vectors of a node's sample; offsets at the sample's median on them."""
    rng = np.random.default_rng(seed)
    inner, dim = (1 << depth) - 1, sample.shape[1] if sample.size else 1
    normals, offsets = np.zeros((trees, max(inner, 1), dim), np.float32), np.zeros((trees, max(inner, 1)), np.float32)
    for t in range(trees):
        parts = {0: np.arange(len(sample))}
        for node in range(inner):
            rows = parts.pop(node)
            direction = rng.normal(size=dim)
            if len(rows) > 1:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                if np.linalg.norm(a - b) > 1e-6:
                    direction = a - b
            direction = (direction / np.linalg.norm(direction)).astype(np.float32)
            along = sample[rows] @ direction if len(rows) else np.zeros(0)
            middle = np.float32(np.median(along)) if len(rows) else np.float32(0)
            normals[t, node], offsets[t, node] = direction, middle
            parts[2 * node + 1], parts[2 * node + 2] = rows[along <= middle], rows[along > middle]
    return Forest(depth, normals, offsets)


def _prepared(dim: int):
    """Rows of ``row, vector`` with a usable vector as ``row, unit`` (float32 bytes at length one) and a 128-bit hash of
    the direction, in NumPy per Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["vector"]
            long = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
            flat = column.take(pa.array(long)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            good = np.isfinite(flat).all(1) & (flat != 0).any(1)
            flat = flat[good]
            flat = flat / np.abs(flat).max(1, keepdims=True) if len(flat) else flat  # first, so that squares stay in range
            unit = flat / np.linalg.norm(flat, axis=1, keepdims=True)
            shape = np.round(unit, _ROUND).astype(np.float32) + np.float32(0)
            hashes = [xxhash.xxh3_128_digest(x.tobytes()) for x in shape]
            words = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            raw = [x.tobytes() for x in unit.astype(np.float32)]
            rows = batch["row"].take(pa.array(long[good]))
            yield pa.RecordBatch.from_arrays([rows.cast(pa.int64()), pa.array(raw, pa.binary()), pa.array(words[:, 0]), pa.array(words[:, 1])], names=["row", "unit", "h1", "h2"])

    return run


def _kernel(k: int, floor: float, dim: int):
    def run(table: pa.Table) -> pa.Table:
        rep = table["rep"].to_numpy()
        unit = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float32).reshape(-1, dim)
        asks, held = table["asks"].to_numpy(), table["held"].to_numpy()
        a, b = np.flatnonzero(asks), np.flatnonzero(held)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s in range(0, len(a), 512):
            part = a[s : s + 512]
            cosine = unit[part] @ unit[b].T
            cosine[rep[part][:, None] == rep[b][None, :]] = -2
            least = np.full((len(part), 1), max(floor - 1e-5, -1.5), np.float32)
            if len(b) > k:
                # the k-th best of the maxima of disjoint groups is at most the k-th best; it is much cheaper
                width = max(1, len(b) // max(64, 4 * k))
                tops = cosine[:, : len(b) // width * width].reshape(len(part), -1, width).max(2)
                least = np.maximum(least, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k][:, None] - np.float32(1e-6))
            r, c = np.divmod(np.flatnonzero(cosine >= least), max(len(b), 1))
            exact = np.einsum("ij,ij->i", unit[part[r]].astype(np.float64), unit[b[c]].astype(np.float64))
            found.append((rep[part[r]], rep[b[c]], exact))
        cols = [np.concatenate(x) if found else np.zeros(0) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"rep": pa.array(cols[0], pa.int64()), "near": pa.array(cols[1], pa.int64()), "cosine": pa.array(cols[2], pa.float64())})

    return run


def _truth(rep: np.ndarray, ask: np.ndarray, k: int):
    """The k most similar rows of each query in a partition of ``rep, unit``, all rows compared: ``query, near, cosine``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, dim = ask.shape
        best, near = np.full((n, k), -2, np.float32), np.zeros((n, k, dim), np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                unit = np.frombuffer(b"".join(part["unit"].to_pylist()), np.float32).reshape(-1, dim)
                cosine = ask @ unit.T
                cosine[rep[:, None] == part["rep"].to_numpy()[None, :]] = -2
                cosine = np.hstack([best, cosine])
                pick = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
                best = np.take_along_axis(cosine, pick, 1)
                near = np.where((pick < k)[:, :, None], np.take_along_axis(near, np.minimum(pick, k - 1)[:, :, None], 1), unit[np.maximum(pick - k, 0)])
        q, c = np.nonzero(best > -1.5)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array([x.tobytes() for x in near[q, c]], pa.binary()), pa.array(best[q, c].astype(np.float64))], names=["query", "near", "cosine"])

    return run


def probes_needed(forest: Forest, ask: np.ndarray, query: np.ndarray, near: np.ndarray, cosine: np.ndarray, floor: float, target: float, most: int) -> int | None:
    """Probes with which ``target`` of the true neighbours (``query`` numbers rows of ``ask``) of cosine ``floor`` or more
    are found in each third of the queries by how near their last neighbour is; none if ``most`` don't do."""
    last = np.full(len(ask), np.inf)
    np.minimum.at(last, query, cosine)
    given, own = forest.leaves(ask, most), forest.leaves(near, forest.trees)
    hit = (given[query][:, :, None] == own[:, None, :]).any(2)
    first = np.where(hit.any(1), hit.argmax(1), most)
    needed = 0
    for third in np.array_split(np.argsort(last, kind="stable"), 3):
        mine = np.sort(first[np.isin(query, third) & (cosine >= floor)])
        if len(mine):
            needed = max(needed, int(mine[int(np.ceil(target * len(mine))) - 1]) + 1)
    return needed if needed <= given.shape[1] else None


def neighbours(reps: DataFrame, dim: int, k: int, floor: float, trees: int = TREES, probes: int = PROBES, leaf_rows: int = LEAF_ROWS, seed: int = 3) -> DataFrame:
    """``rep, near, cosine``: up to k nearest of each representative with cosine of at least ``floor``, from ``rep long,
    unit binary``. ``probes`` is the least number of leaves asked; as many as TARGET needs are."""
    total = reps.count()
    depth = 0
    while (total >> depth) > leaf_rows:
        depth += 1
    # reaches the driver: at most MOST_SAMPLE vectors, chosen by hash
    size = min(MOST_SAMPLE, max(LEAST_SAMPLE, LEAF_SAMPLE << depth))
    sample = reps.select("unit", F.xxhash64(F.lit(seed), "rep").alias("o")).orderBy("o").limit(size).select("unit").toArrow()
    fitted = np.frombuffer(b"".join(sample["unit"].to_pylist()), np.float32).reshape(-1, dim)
    while depth and (len(fitted) >> depth) < NODE_SAMPLE:
        depth -= 1
    forest = fit(fitted, depth, trees, seed)
    blocks, parts, exact = max(1, -(-(total >> depth) // BLOCK_ROWS)), max(1, -(-total // EXACT_ROWS)), depth == 0
    if depth:
        # reaches the driver: QUERIES vectors, other ones than the hyperplanes' as far as there are, and k for each
        held_out = reps.select("rep", "unit", F.xxhash64(F.lit(seed + 1), "rep").alias("o")).orderBy("o").limit(QUERIES).select("rep", "unit").toArrow()
        ask = np.frombuffer(b"".join(held_out["unit"].to_pylist()), np.float32).reshape(-1, dim)
        true = reps.select("rep", "unit").mapInArrow(_truth(held_out["rep"].to_numpy(), ask, k), "query long, near binary, cosine double")
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "near"))
        true = true.withColumn("nth", nth).where(F.col("nth") <= k).select("query", "near", "cosine").toArrow()
        near = np.frombuffer(b"".join(true["near"].to_pylist()), np.float32).reshape(-1, dim)
        needed = probes_needed(forest, ask, true["query"].to_numpy(), near, true["cosine"].to_numpy(), floor, TARGET, MOST_PROBES)
        probes = max(probes, needed or 0)
        exact = needed is None or probes * (COPY_ROWS + (total >> depth)) > 2 * parts * COPY_ROWS + total
    if exact:
        forest, probes, blocks = fit(fitted, 0, 1), 1, parts

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rep = part["rep"].to_numpy()
                raw = part["unit"].to_pylist()
                unit = np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)
                leaf = forest.leaves(unit, probes)
                n, width = leaf.shape
                rows = np.repeat(np.arange(n), width)
                # a leaf that the queue gives again is asked once
                own = np.tile(np.arange(width) < forest.trees, n)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), pa.array(rep[rows]), pa.array([raw[i] for i in rows], pa.binary()), pa.array(own)], names=["leaf", "rep", "unit", "held"])

    asked = reps.select("rep", "unit").mapInArrow(assign, "leaf long, rep long, unit binary, held boolean")
    if blocks == 1:
        asked = asked.withColumn("asks", F.lit(True))
        group = ["leaf"]
    else:
        mine = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
        cells = F.sequence(F.lit(0), F.lit(blocks - 1))
        pairs = F.array_union(F.transform(cells, lambda j: F.struct(mine.alias("qb"), j.alias("mb"))), F.when(F.col("held"), F.transform(cells, lambda i: F.struct(i.alias("qb"), mine.alias("mb")))).otherwise(F.array().cast("array<struct<qb:int,mb:int>>")))
        asked = asked.withColumn("cell", F.explode(pairs)).withColumns({"asks": F.col("cell.qb") == mine, "held": F.col("held") & (F.col("cell.mb") == mine)})
        asked = asked.withColumns({"qb": F.col("cell.qb"), "mb": F.col("cell.mb")}).drop("cell")
        group = ["leaf", "qb", "mb"]
    found = asked.groupBy(*group).applyInArrow(_kernel(k, floor, dim), "rep long, near long, cosine double")
    # a pair that one side found is known to the other side too
    both = found if exact else found.unionAll(found.select(F.col("near").alias("rep"), F.col("rep").alias("near"), "cosine"))
    both = both.where(F.col("cosine") >= floor) if exact else both.groupBy("rep", "near").agg(F.max("cosine").alias("cosine")).where(F.col("cosine") >= floor)
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "near"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def most_similar(df: DataFrame, row: str, vector: str, dim: int, k: int = 5, floor: float = -1.0, trees: int = TREES, probes: int = PROBES) -> DataFrame:
    """``<row>, near, cosine``: for every row with a usable vector up to k most similar other rows, cosine ``floor`` or
    more. Equal cosines go to the smaller row number. Vectors whose directions agree to 6 decimals count as copies, of
    cosine 1 (it is, to within 1e-10). Null, empty, short, not-a-number and all-zero vectors take no part; ``row`` must be unique."""
    rows = df.select(F.col(row).cast("long").alias("row"), F.col(vector).cast("array<float>").alias("vector"))
    rows = cut(rows.mapInArrow(_prepared(dim), "row long, unit binary, h1 long, h2 long"))
    # one pass over the vectors; copies are known by a hash of 128 bits
    groups = rows.groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.min_by("unit", "row").alias("unit"))
    groups = cut(groups)
    found = neighbours(groups.select("rep", "unit"), dim, k, floor, trees, probes)
    found = cut(found)
    member = rows.select("row", "h1", "h2").join(groups.select("h1", "h2", "rep"), ["h1", "h2"]).select("row", "rep")
    member = cut(member)
    first = F.row_number().over(Window.partitionBy("rep").orderBy("row"))
    firsts = member.withColumn("n", first).where(F.col("n") <= k + 1).select(F.col("rep").alias("near"), F.col("row").alias("other"))
    own = firsts.select(F.col("near").alias("rep"), F.lit(1.0).alias("cosine"), "other")
    lists = found.join(firsts, "near").select("rep", "cosine", "other").unionByName(own)
    # at most (k + 1) * (k + 1) entries a list
    lists = lists.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("other")))).alias("list"))
    out = fragment_replicate_join(member, lists, "rep", F.col("row"))
    mine = F.slice(F.filter("list", lambda x: x["other"] != F.col("row")), 1, k)
    out = out.select("row", F.explode(mine).alias("x")).select(F.col("row").alias(row), F.col("x.other").alias("near"), (-F.col("x.c")).alias("cosine"))
    return out.where(F.col("cosine") >= floor)


def similar_pairs(df: DataFrame, row: str, vector: str, dim: int, k: int, floor: float) -> DataFrame:
    """Pairs, smaller row first, in which one is among the other's k most similar and their cosine is ``floor`` or more."""
    near = most_similar(df, row, vector, dim, k, floor)
    return near.select(F.least(row, "near").alias("vec_a"), F.greatest(row, "near").alias("vec_b")).distinct()
