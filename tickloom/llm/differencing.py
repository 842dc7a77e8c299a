"""Sharding by Karmarkar-Karp differencing.

Rows that share a group key must land in one shard; shards should hold equal bytes. Each group
starts as a partial partition with its size in one slot. The two partial partitions of largest
spread are combined with opposite slot order, so large slots meet small ones, until one is left.

At scale the combining runs as a tree: partial partitions are hashed into blocks of about
``fan_in``, each block is combined to one partial partition in its own task, and the blocks'
results are combined again. The driver holds no groups, and levels grow with log(groups).

Defined results: null keys form one group and null sizes count as 0; an empty table gives an
empty result; repeated rows count each; a column named ``shard`` is replaced; equal sizes are
ordered by key, so that the result doesn't depend on the order of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.staging import materialise

SHARDS = 64
FAN_IN = 4096


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine n partial partitions of k slots.

    Returns (slots, total): slots[i, j] is the final slot of slot j of partition i.
    """
    n, k = sums.shape
    state = [None] * (2 * n - 1)
    sums = np.asarray(sums, np.float64)
    first = np.argsort(-sums, axis=1, kind="stable")
    heap = []
    for i in range(n):
        s = sums[i][first[i]]
        state[i] = s
        heap.append((-(s[0] - s[-1]), i))
    heapq.heapify(heap)
    links = []
    top = n - 1
    for new in range(n, 2 * n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        s = state[a] + state[b][::-1]
        order = np.argsort(-s, kind="stable")
        state[a] = state[b] = None
        state[new] = s = s[order]
        links.append((new, a, b, order))
        heapq.heappush(heap, (-(s[0] - s[-1]), new))
        top = new
    place = {top: np.arange(k)}
    for new, a, b, order in reversed(links):
        final = place.pop(new)
        back = np.empty(k, np.int64)
        back[order] = final  # the slot before sorting -> final slot
        place[a], place[b] = back, back[::-1]
    slots = np.empty((n, k), np.int64)
    for i in range(n):
        slots[i, first[i]] = place[i]
    return slots, state[top]


def _combine(shards: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["size", "a", "b"], ascending=[False, True, True], kind="stable")
        if "sums" in pdf:
            sums = np.array(pdf["sums"].tolist(), np.float64).reshape(len(pdf), shards)
        else:
            sums = np.zeros((len(pdf), shards))
            sums[:, 0] = pdf["size"]
        slots, total = difference(sums)
        out = pd.DataFrame({"a": pdf["a"].to_numpy(), "b": pdf["b"].to_numpy(), "block": key[0]})
        out["slots"] = list(slots.astype(np.int32) if "sums" in pdf else slots[:, :1].astype(np.int32))
        out["total"] = [total.tolist()] + [None] * (len(pdf) - 1)
        return out

    return run


def shard_groups(df: DataFrame, group_cols: Sequence[str], size_col: str, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """``df`` with a column ``shard`` in 0..shards-1, equal for rows with equal ``group_cols``."""
    cols = [F.col(c) for c in group_cols]
    keyed = materialise(df.withColumns({"__a": F.xxhash64(*cols), "__b": F.xxhash64(F.lit("group"), *cols)}), "shard-rows")
    nodes = keyed.groupBy(F.col("__a").alias("a"), F.col("__b").alias("b")).agg(F.sum(F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("double")).alias("size"))
    nodes = materialise(nodes, "shard-groups")
    n, levels = nodes.count(), []
    schema = "a long, b long, block long, slots array<int>, total array<double>"
    while n:
        blocks = -(-n // fan_in)
        blocked = nodes.withColumn("block", F.pmod(F.xxhash64("a", F.lit(len(levels))), F.lit(blocks)))
        done = materialise(blocked.groupBy("block").applyInPandas(_combine(shards), schema), f"shard-level{len(levels)}")
        levels.append(done)
        if blocks == 1:
            break
        nodes = done.filter("total is not null").select(F.col("block").alias("a"), F.lit(0).cast("long").alias("b"), F.expr("array_max(total) - array_min(total)").alias("size"), F.col("total").alias("sums"))
        n = nodes.count()
    out_cols = [F.col(c) for c in df.columns if c != "shard"]
    if not levels:
        return keyed.select(*out_cols, F.lit(None).cast("int").alias("shard"))
    place = levels[0].select("a", "b", "block", F.col("slots")[0].alias("shard"))
    for up in levels[1:]:
        up = up.select(F.col("a").alias("block"), F.col("slots"), F.col("block").alias("above"))
        place = place.join(up, "block").select("a", "b", F.col("above").alias("block"), F.expr("slots[shard]").alias("shard"))
    place = place.select(F.col("a").alias("__pa"), F.col("b").alias("__pb"), F.col("shard").alias("__shard"))
    return keyed.join(place, (F.col("__a") == F.col("__pa")) & (F.col("__b") == F.col("__pb"))).select(*out_cols, F.col("__shard").alias("shard"))
