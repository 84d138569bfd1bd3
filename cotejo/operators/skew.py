"""Per-key work without stragglers: fragment-replicate by estimated load (problem 2).

Loads are counted per key with map-side combining. Keys above a share of one task's load are heavy: there are at most
``tasks * HEAVY_PARTS`` of them, whatever the data. All other keys fall, by hash, into a fixed number of virtual
buckets. Heavy keys are split into shards in proportion to their load, and shards and buckets are packed into tasks,
largest first into the emptiest task. The plan is thus of bounded size and is broadcast; rows go to the planned task
by ``repartitionById``. The matching side of a join is replicated only to the shards of its key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.session import shuffle_width

#: A key is heavy if it holds more than 1/HEAVY_PARTS of a task's fair load.
HEAVY_PARTS = 4
#: Virtual buckets per task for the keys that aren't heavy.
BUCKETS_PER_TASK = 16


@dataclass(frozen=True)
class LoadPlan:
    tasks: int
    buckets: int
    heavy: dict[object, list[int]]  # key -> task of each of its shards
    bucket_task: list[int]
    task_load: list[int]


def pack(items: list[tuple[object, int]], tasks: int) -> tuple[dict[object, int], list[int]]:
    """Largest item first into the emptiest task; ties by task number, so the result is one only."""
    heap, load, where = [(0, t) for t in range(tasks)], [0] * tasks, {}
    for item, size in sorted(items, key=lambda x: (-x[1], str(x[0]))):
        _, t = heapq.heappop(heap)
        where[item], load[t] = t, load[t] + size
        heapq.heappush(heap, (load[t], t))
    return where, load


def plan_loads(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Counts the load of every key of all rows, in one pass, and packs it. A null key is a key like any other."""
    tasks = tasks or shuffle_width(df.sparkSession)
    buckets = tasks * BUCKETS_PER_TASK
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    total = counts.agg(F.greatest(F.lit(1), F.floor(F.sum("n") / (tasks * HEAVY_PARTS))).alias("limit"))  # one row, from the same exchange
    marked = counts.crossJoin(F.broadcast(total)).withColumns({"b": F.pmod(F.xxhash64("k"), F.lit(buckets)), "heavy": F.col("n") > F.col("limit")})
    # reaches the driver: one row a bucket, with at most tasks * HEAVY_PARTS heavy keys in all of them
    rows = marked.groupBy("b").agg(F.sum(F.when(~F.col("heavy"), F.col("n"))).alias("n"), F.max("limit").alias("limit"), F.collect_list(F.when(F.col("heavy"), F.struct("k", "n"))).alias("heavy")).collect()
    left = {r["b"]: r["n"] for r in rows if r["n"]}
    heavy = [x for r in rows for x in r["heavy"]]
    limit = max((r["limit"] for r in rows), default=1)
    shards = {x["k"]: max(1, -(-x["n"] // limit)) for x in heavy}
    items = [(("key", x["k"], i), -(-x["n"] // shards[x["k"]])) for x in heavy for i in range(shards[x["k"]])]
    where, load = pack(items + [(("bucket", b), n) for b, n in left.items()], tasks)
    return LoadPlan(tasks, buckets, {x["k"]: [where["key", x["k"], i] for i in range(shards[x["k"]])] for x in heavy}, [where.get(("bucket", b), b % tasks) for b in range(buckets)], load)


def _shards(plan: LoadPlan, df: DataFrame, key: str) -> DataFrame:
    kind = dict(df.dtypes)[key]
    rows = [(k, t) for k, t in plan.heavy.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, f"__heavy_key {kind}, __heavy_tasks array<int>"))  # at most tasks * HEAVY_PARTS rows


def _light_task(plan: LoadPlan, key: str) -> Column:
    tasks = F.split(F.lit(",".join(map(str, plan.bucket_task))), ",").cast("array<int>")  # one literal, folded when the plan is made
    return F.get(tasks, F.pmod(F.xxhash64(F.col(key)), F.lit(plan.buckets)).cast("int"))


def spread(df: DataFrame, key: str, by: Column, plan: LoadPlan) -> DataFrame:
    """Rows in their planned tasks, with ``__task``; ``by`` (any per-row value) picks the shard of a heavy key."""
    shard = F.get("__heavy_tasks", F.pmod(F.xxhash64(by), F.size("__heavy_tasks")).cast("int"))
    out = df.join(_shards(plan, df, key), F.col(key).eqNullSafe(F.col("__heavy_key")), "left")
    out = out.withColumn("__task", F.coalesce(shard, _light_task(plan, key))).drop("__heavy_key", "__heavy_tasks")
    return out.repartitionById(plan.tasks, "__task")


def latest_per_key(df: DataFrame, key: str, time: str, order: str, tasks: int | None = None) -> DataFrame:
    """One row per key: the one with the latest ``time``, on a tie the larger ``order``.

    Rows with a null key or null time are left out; a key with null times only gives no row. Repeated rows count as
    ties and give one row. Shards are reduced in their tasks first, so that the second step reads at most one row for
    each key and task.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, order)
    plan = plan_loads(rows, key, tasks)
    part = spread(rows, key, F.col(order), plan).groupBy(key, "__task").agg(F.max(F.struct(time, order)).alias("__m"))
    return part.groupBy(key).agg(F.max("__m").alias("__m")).select(key, F.col(f"__m.{time}").alias(time), F.col(f"__m.{order}").alias(order))


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner", plan: LoadPlan | None = None) -> DataFrame:
    """Equi-join on ``key`` in which a heavy key's rows of ``left`` are spread over its shards and its rows of
    ``right`` go to those shards only. ``how`` is inner, left, left_semi or left_anti; null keys never match."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"not a join that keeps the left rows whole: {how}")
    plan = plan or plan_loads(left, key)
    if not plan.heavy:
        return left.join(right, key, how)  # no key is more than a part of a task's load: hashing is even enough
    shards = _shards(plan, right, key)
    there = right.join(shards, F.col(key).eqNullSafe(F.col("__heavy_key")), "left")
    light = F.array(_light_task(plan, key))
    there = there.withColumn("__task", F.explode(F.array_distinct(F.coalesce("__heavy_tasks", light)))).drop("__heavy_key", "__heavy_tasks")
    # both sides are placed by task number, so the join takes them as they lie: no second exchange undoes the plan
    return spread(left, key, by, plan).join(there.repartitionById(plan.tasks, "__task").hint("merge"), ["__task", key], how).drop("__task")
