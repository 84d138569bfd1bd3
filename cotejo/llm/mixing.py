"""Sources mixed to target weights by Sainte-Lague apportionment of equal-token blocks (problem 9).

The total is the largest at which every source that has any text can hold its share without using a document more than
its cap. It is cut into equal blocks; blocks go to sources, and within a source to its shards, by highest quotients, so
quotas are whole numbers. In each shard documents stand in a seeded order and are cut into blocks; whole rounds use all
blocks, the rest of the quota takes blocks in a seeded order until its tokens are reached, so a shard errs by half a
document at most."""

from __future__ import annotations

import heapq
import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm.encoding import VOCABULARIES, token_count
from cotejo.session import cut

#: Tokens of a block: the same at every size, so quotas are as fine on small corpora as on large ones.
BLOCK_TOKENS = 100
SHARD_TOKENS = 500_000
#: Shards of one source at most; beyond it shards grow, and their sort spills.
MAX_SHARDS = 4096
#: Targets of a mixture at most.
MAX_SOURCES = 10_000
#: Times that a document of a target may be used: none given is once.
_CAP = "greatest(0, max(coalesce(max_repeats, 1)))"


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Seats by highest quotients weight / (2 * seats so far + 1), none above its cap; ties by key. Seats of quotients
    above a threshold are given at once; the threshold is found by bisection so that they don't exceed ``seats``, and the
    last ones go one by one. A party may be far from its proportional share (Sainte-Lague gives no quota rule), so no
    seat is taken for certain by share alone."""
    caps = caps or {}
    out = dict.fromkeys(weights, 0)
    keys = [k for k, w in weights.items() if w > 0 and caps.get(k, seats) > 0]
    if not keys or seats <= 0:
        return out
    w = np.array([float(weights[k]) for k in keys])
    most = np.array([min(caps.get(k, seats), seats) for k in keys], np.float64)

    def above(threshold: float) -> np.ndarray:
        return np.clip(np.ceil((w / threshold - 1) / 2), 0, most)

    low, high = w.max() / (2.0 * seats + 3), w.max()  # the largest party alone would pass the seats at low
    for _ in range(200):
        middle = (low * high) ** 0.5
        if above(middle).sum() > seats:
            low = middle
        else:
            high = middle
        if high <= low * (1 + 1e-12):
            break
    # a little above the threshold, so that rounding gives no seat too early
    for k, n in zip(keys, above(high * (1 + 1e-9)), strict=True):
        out[k] = int(n)
    heap = [(-weights[k] / (2 * out[k] + 1), str(k), k) for k in keys if out[k] < caps.get(k, seats)]
    heapq.heapify(heap)
    left = seats - sum(out.values())
    while left > 0 and heap:
        _, name, k = heapq.heappop(heap)
        out[k] += 1
        left -= 1
        if out[k] < caps.get(k, seats):
            heapq.heappush(heap, (-weights[k] / (2 * out[k] + 1), name, k))
    return out


@dataclass(frozen=True)
class MixPlan:
    blocks: int
    block_tokens: int
    quotas: dict  # source -> blocks
    shard_quotas: dict  # (source, shard) -> blocks
    shard_tokens: dict  # (source, shard) -> tokens


def read_targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, cap) of the usable targets: a configuration table of at most MAX_SOURCES rows."""
    usable = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("w"), F.expr(_CAP).alias("m"))
    rows = usable.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    return sorted((r["source"], r["w"], r["m"]) for r in rows)


def sized(df: DataFrame, row: str, text: str, source: str, wanted: list[tuple[str, float, int]], name: str, folder: str, seed: int) -> DataFrame:
    """``row, source, max_repeats, tokens, place`` of the documents that can be used, cut through storage: they are
    tokenized once."""
    caps = df.sparkSession.createDataFrame([(s, m) for s, _, m in wanted], "source string, max_repeats int")
    rows = df.select(F.col(row).alias("row"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.coalesce(F.length("text") > 0, F.lit(False)))
    rows = rows.join(F.broadcast(caps), "source")  # MAX_SOURCES rows at most
    return cut(rows.select("row", "source", "max_repeats", token_count(F.col("text"), name, folder).alias("tokens"), F.xxhash64(F.lit(seed), "row").alias("place")).where("tokens > 0"))


def plan_mix(docs: DataFrame, wanted: list[tuple[str, float, int]], block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None) -> tuple[MixPlan, DataFrame]:
    """The plan, and the documents with their shard. Reaches the driver: one row a source, then one row a shard."""
    supply = {r["source"]: r["tokens"] for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    repeats = {s: m for s, _, m in wanted}
    shares = {s: w for s, w, _ in wanted if supply.get(s) and repeats[s]}
    weight = sum(shares.values())
    most = min((supply[s] * repeats[s] * weight / w for s, w in shares.items()), default=0)
    most = most if total_tokens is None else min(most, total_tokens)
    blocks = int(most // block_tokens)
    shards = {s: max(1, min(MAX_SHARDS, -(-t // SHARD_TOKENS))) for s, t in supply.items()}
    n = F.lit(1)
    for s, k in shards.items():
        n = F.when(F.col("source") == s, F.lit(k)).otherwise(n)
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("place"), n).cast("int"))
    by_shard = {(r["source"], r["shard"]): r["tokens"] for r in docs.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).collect()}
    quotas = sainte_lague(shares, blocks)
    shard_quotas: dict = {}
    for s, quota in quotas.items():
        own = {k: t for k, t in by_shard.items() if k[0] == s}
        shard_quotas |= sainte_lague(own, quota, {k: t * repeats[s] // block_tokens for k, t in own.items()})
    return MixPlan(blocks, block_tokens, quotas, shard_quotas, by_shard), docs


def _orders(plan: MixPlan, seed: int) -> list[tuple]:
    """(source, shard, quota, tokens, blocks, step, start) of the shards that give any: block b is taken in place
    (b * step + start) mod blocks, a permutation as the step has no divisor in common with the number of blocks."""
    out = []
    for (source, shard), quota in plan.shard_quotas.items():
        if quota > 0:
            tokens = plan.shard_tokens[source, shard]
            blocks = -(-tokens // plan.block_tokens)
            draw = random.Random(f"{seed}/{source}/{shard}")
            step = draw.randrange(1, blocks + 1)
            while math.gcd(step, blocks) != 1:
                step = draw.randrange(1, blocks + 1)
            out.append((source, shard, quota, tokens, blocks, step, draw.randrange(blocks)))
    return out


def choose(docs: DataFrame, plan: MixPlan, seed: int) -> DataFrame:
    """``row, source, tokens, repeats`` of the chosen documents."""
    schema = "source string, shard int, quota long, all long, blocks long, step long, start long"
    order = F.broadcast(docs.sparkSession.createDataFrame(_orders(plan, seed), schema))  # MAX_SHARDS rows a source at most
    shard = Window.partitionBy("source", "shard")
    docs = docs.join(order, ["source", "shard"])
    before = lambda *by: F.coalesce(F.sum("tokens").over(shard.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    docs = docs.withColumn("block", F.floor((before("place", "row") + F.floor(F.col("tokens") / 2)) / plan.block_tokens))
    docs = docs.withColumn("turn", F.pmod(F.col("block") * F.col("step") + F.col("start"), F.col("blocks")))
    want = F.col("quota") * plan.block_tokens
    rounds = F.floor(want / F.col("all")).cast("int")
    middle = before("turn", "place", "row") + F.col("tokens") / 2
    extra = (middle < want - rounds * F.col("all")).cast("int")
    docs = docs.withColumn("repeats", F.least(rounds + extra, F.col("max_repeats")))
    return docs.where("repeats > 0").select("row", "source", "tokens", "repeats")


def mix(df: DataFrame, row: str, text: str, source: str, targets: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, seed: int = 7, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen documents, report). Documents without text or of a source that isn't a target are never chosen; a source
    without any document, or of no repeats, gets nothing and is reported unfilled, the others keep their proportions. Repeated texts are
    documents of their own. The report has one row per target: its share, the share reached, tokens, documents, the
    tokens that its cap allows and whether it could be filled."""
    wanted = read_targets(targets)
    plan, docs = plan_mix(sized(df, row, text, source, wanted, name, folder, seed), wanted, total_tokens=total_tokens)
    spark = df.sparkSession
    chosen = choose(docs, plan, seed).withColumnRenamed("row", row)
    listed = spark.createDataFrame(wanted, "source string, target_share double, max_repeats int")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    supply = docs.groupBy("source").agg(F.sum("tokens").alias("supply"))
    report = listed.join(got, "source", "left").join(supply, "source", "left").fillna(0, ["tokens", "documents", "most_repeats", "supply"])
    total = F.sum("tokens").over(Window.partitionBy())  # over one row a target
    report = report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)))
    report = report.withColumn("allowed_tokens", F.col("supply") * F.col("max_repeats")).withColumn("filled", F.col("tokens") > 0)
    return chosen, report.select("source", "target_share", "actual_share", "tokens", "documents", "most_repeats", "max_repeats", "allowed_tokens", "filled")
