"""Filling containers of fixed capacity: first-fit decreasing with a tournament tree, in randomised groups.

Items are hashed into groups of about ``group_items`` items. Each group is packed on its own in one task: pieces
in falling size, each into the first container with room, found in O(log n) by a tournament tree over the free
room. Every group leaves at most its last few containers half empty, so the waste falls with the group size.

Only an item longer than the capacity is split: into full containers and a rest that is packed like any piece.

Defined cases: null and non-positive sizes count as 0 and take no room (they are placed in the group's first
container with room, so no item is lost); equal sizes are settled by the id; repeated ids are separate items only
if the table repeats them (each row is an item); empty input gives no rows.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = "item_id bigint, piece int, size bigint, offset bigint, container_group int, container int"


class TournamentTree:
    """The free room of containers; ``place`` puts a size into the first container with room."""

    def __init__(self, leaves: int, capacity: int):
        self.base = 1
        while self.base < max(1, leaves):
            self.base *= 2
        self.room = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.base:
            at *= 2
            if room[at] < size:
                at += 1
        leaf = at - self.base
        room[at] -= size
        while at > 1:
            at //= 2
            a, b = room[2 * at], room[2 * at + 1]
            room[at] = a if a > b else b
        return leaf


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of every size; sizes must be sorted in falling order and fit the capacity."""
    tree = TournamentTree(len(sizes), capacity)
    return [tree.place(s) for s in sizes]


def pack(items: DataFrame, item_id: str, size: Column, capacity: int, n_groups: int, seed: int = 17) -> DataFrame:
    """(item_id, piece, size, offset, container_group, container) for every piece of every item.

    ``n_groups`` should grow with the number of items; ``groups_for`` derives it.
    """
    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    # the hash of the id spreads equal sizes and equal sources over all groups
    rows = rows.withColumn("container_group", F.pmod(F.xxhash64(F.col("item_id"), F.lit(seed)), F.lit(n_groups)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sizes = pdf["item_id"].to_numpy(), pdf["size"].to_numpy()
        full = np.where(sizes > capacity, sizes // capacity, 0)
        rest = sizes - full * capacity
        split_end = (full > 0) & (rest == 0)
        # full pieces of long items have containers of their own, after those of the packed rests
        keep = ~split_end
        order = np.lexsort((ids[keep], -rest[keep]))
        at = np.flatnonzero(keep)[order]
        bins = np.asarray(first_fit_decreasing(rest[at].tolist(), capacity), dtype="int64")
        used = int(bins.max()) + 1 if len(bins) else 0
        out = [pd.DataFrame({"item_id": ids[at], "piece": full[at], "size": rest[at], "offset": full[at] * capacity, "container": bins})]
        long = np.flatnonzero(full > 0)
        if len(long):
            long = long[np.argsort(ids[long], kind="stable")]
            n = full[long]
            piece = np.concatenate([np.arange(k) for k in n])
            out.append(pd.DataFrame({"item_id": np.repeat(ids[long], n), "piece": piece, "size": capacity, "offset": piece * capacity, "container": used + np.arange(n.sum())}))
        done = pd.concat(out, ignore_index=True)
        done["container_group"] = pdf["container_group"].iloc[0]
        return done[["item_id", "piece", "size", "offset", "container_group", "container"]]

    return rows.groupBy("container_group").applyInPandas(fill, _OUT)


def groups_for(n_items: int, group_items: int = 20_000) -> int:
    """As many groups as keep about ``group_items`` items in each: a task's memory does not grow with the table."""
    return max(1, -(-n_items // group_items))


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Fill of every container: (container_group, container, n_pieces, used, free)."""
    g = packed.groupBy("container_group", "container").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("size").alias("used"))
    return g.withColumn("free", F.lit(capacity) - F.col("used"))


