"""Per-key results where a few keys hold most records: fragment and replicate by estimated load.

A first pass counts the rows of every key with map-side combination. Only keys with more than a small part of one task's share
are planned one by one, so the plan has at most tasks * FINE entries whatever the data. Planned keys above one share are split into
proportionate shards, all shards are packed into tasks (largest first into the emptiest task), the remaining light keys are spread by
hash, which is even because each of them is small. Rows are placed by `repartitionById`, so the packing is what really runs.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, functions as F, types as T

from concordat.functions.lineage import cut

#: A key is planned on its own when it has at least 1/FINE of one task's even share.
FINE = 16

PLAN = T.StructType([T.StructField("__key", T.StringType()), T.StructField("__shards", T.IntegerType()), T.StructField("__tasks", T.ArrayType(T.IntegerType()))])


def pack(loads: list[tuple[str | None, int]], total: int, tasks: int) -> list[tuple[str | None, int, list[int]]]:
    """(key, shards, task of each shard) for the given heavy keys.

    A key takes ceil(load / share) shards, share = total / tasks. Shards go largest first to the task with the least load so far; ties
    go by key and task number, so the result is the same on every run.
    """
    share = max(1.0, total / tasks)
    rest = max(0, total - sum(n for _, n in loads))
    heap = [(rest / tasks, t) for t in range(tasks)]
    heapq.heapify(heap)
    pieces = sorted(((n / (k := min(tasks, math.ceil(n / share))), "" if key is None else key, key, k) for key, n in loads), key=lambda p: (-p[0], p[1]))
    out = []
    for size, _, key, shards in pieces:
        taken, used = [], []
        for _ in range(shards):
            load, task = heapq.heappop(heap)
            used.append(task)
            taken.append((load + size, task))
        for item in taken:
            heapq.heappush(heap, item)
        out.append((key, shards, used))
    return out


def plan(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """The packing of `df`'s heavy keys as a table of at most tasks * FINE rows (key as string, shards, tasks)."""
    loads = cut(df.groupBy(F.col(f"`{key}`").cast("string").alias("__key")).agg(F.count(F.lit(1)).alias("n")))  # the table is counted once
    total = loads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = loads.filter((F.col("n") >= max(1.0, total / tasks / FINE)) & (F.col("n") > 1)).collect()  # at most tasks * FINE rows, by the threshold
    return df.sparkSession.createDataFrame(pack([(r["__key"], r["n"]) for r in heavy], total, tasks), PLAN)


def place(df: DataFrame, key: str, by, tasks: int, packing: DataFrame) -> DataFrame:
    """df with `__shard` (number within its key) and `__task`; rows with the same `by` of one key share a shard."""
    spread = F.pmod(F.xxhash64(*by), F.lit(2**31)).cast("int")
    joined = df.join(F.broadcast(packing), F.col(f"`{key}`").cast("string").eqNullSafe(F.col("__key")), "left")  # at most tasks * FINE rows
    shard = F.when(F.col("__shards") > 1, F.pmod(spread, F.col("__shards"))).otherwise(F.lit(0))
    task = F.when(F.col("__shards").isNotNull(), F.element_at("__tasks", shard + 1)).otherwise(F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(tasks)).cast("int"))
    return joined.withColumn("__shard", shard).withColumn("__task", task).drop("__key", "__shards", "__tasks")


def per_key(df: DataFrame, key: str, id_col: str, text_col: str, tasks: int | None = None) -> DataFrame:
    """(key, n_rows, n_ids, mean_chars) for every value of `key`, with no task above about one even share of the rows.

    Null keys form one group of their own, null ids count as rows but not as ids, null texts count as rows but not in the mean (null
    mean where a key has no text). Repeated rows count as rows and once as ids. An empty table gives no rows. Other columns are ignored.
    """
    slim = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{id_col}`").alias("i"), F.char_length(F.col(f"`{text_col}`")).cast("bigint").alias("c"))
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = place(slim, "k", [F.col("i")], tasks, plan(slim, "k", tasks))
    # rows of one id meet in one shard, so the shards' distinct counts simply add up
    part = placed.repartitionById(tasks, F.col("__task")).groupBy("__task", "k", "__shard", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("chars"), F.count("c").alias("texts"))
    shards = part.groupBy("k", "__shard").agg(F.sum("n").alias("n"), F.count("i").alias("ids"), F.sum("chars").alias("chars"), F.sum("texts").alias("texts"))
    return shards.groupBy("k").agg(F.sum("n").alias("n_rows"), F.sum("ids").alias("n_ids"), (F.sum("chars") / F.sum("texts")).alias("mean_chars")).withColumnRenamed("k", key)


def replicate_join(left: DataFrame, right: DataFrame, key: str, by: list[str], tasks: int | None = None, how: str = "left") -> DataFrame:
    """Equi-join on `key` of a skewed left side: its large keys are split into shards, and the right side's rows of such a key are copied to those shards only.

    how is `left` or `inner`. Null keys match nothing; rows that repeat on either side join as often as they are stored; right columns other
    than the key that clash with left ones get the suffix `_right`. An empty right side leaves the left rows with nulls (or none).
    """
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packing = plan(left.select(key), key, tasks)
    placed = place(left, key, [F.col(f"`{b}`") for b in by], tasks, packing)
    clash = (set(left.columns) & set(right.columns)) - {key}
    named = right.select(F.col(f"`{key}`").alias("__rk"), *[F.col(f"`{c}`").alias(f"{c}_right" if c in clash else c) for c in right.columns if c != key])
    light = F.pmod(F.xxhash64(F.col("__rk").cast("string")), F.lit(tasks)).cast("int")
    copies = (
        named.join(F.broadcast(packing), F.col("__rk").cast("string") == F.col("__key"), "left")  # at most tasks * FINE rows
        .select("*", F.posexplode(F.coalesce(F.col("__tasks"), F.array(light))).alias("__rs", "__rt"))
        .drop("__key", "__shards", "__tasks")
    )
    # both sides go to the tasks of the packing, where shards are joined
    placed, copies = placed.repartitionById(tasks, F.col("__task")), copies.repartitionById(tasks, F.col("__rt"))
    same = (placed[key] == F.col("__rk")) & (F.col("__shard") == F.col("__rs")) & (F.col("__task") == F.col("__rt"))
    return placed.join(copies, same, how).drop("__rk", "__rs", "__rt", "__shard", "__task")


def heavy_values(df: DataFrame, keys: list[str], id_col: str, text_col: str, share: float = 0.05) -> DataFrame:
    """(field_name, key_value): the non-null values of each key that hold at least `share` of all rows; repeated rows and null keys count in the total."""
    found = None
    for key in keys:
        counts = per_key(df, key, id_col, text_col)
        total = counts.agg(F.sum("n_rows")).scalar()
        one = counts.filter(F.col(f"`{key}`").isNotNull() & (F.col("n_rows") >= total * F.lit(share))).select(F.lit(key).alias("field_name"), F.col(f"`{key}`").cast("string").alias("key_value"))
        found = one if found is None else found.unionByName(one)
    return found
