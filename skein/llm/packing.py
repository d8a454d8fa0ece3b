"""Problem 9: filling containers of fixed capacity by best-two-fit.

Items go into shards by a hash of their id, each shard of a bounded number of
items, and every shard is packed on its own; a shard leaves at most a few bins
with room. In a shard bins are filled greedily, the largest item that fits
first. Then the smallest item of the bin is taken out if two items that are not
packed yet fill its place and the rest of the room more tightly.

Only an item larger than a container is cut: into full containers and a rest
that is packed like an item.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Stock:
    """Unpacked items by size, with the sizes in order."""

    def __init__(self, sizes: list[int]):
        self.by: dict[int, list[int]] = {}
        for i in sorted(range(len(sizes)), reverse=True):
            self.by.setdefault(sizes[i], []).append(i)
        self.sizes = sorted(self.by)

    def largest(self, room: int) -> int:
        """The largest size that fits, 0 for none."""
        k = bisect_right(self.sizes, room)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int) -> int:
        items = self.by[size]
        i = items.pop()
        if not items:
            del self.by[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        return i

    def put(self, size: int, i: int) -> None:
        if size not in self.by:
            self.by[size] = []
            self.sizes.insert(bisect_right(self.sizes, size), size)
        self.by[size].append(i)

    def best_two(self, room: int) -> tuple[int, int] | None:
        """Two sizes of greatest sum within `room`, by two pointers from both ends."""
        s, lo, hi, best = self.sizes, 0, bisect_right(self.sizes, room) - 1, None
        while lo <= hi:
            if s[lo] + s[hi] > room or (lo == hi and len(self.by[s[lo]]) < 2):
                hi -= 1
                continue
            if best is None or s[lo] + s[hi] > sum(best):
                best = (s[lo], s[hi])
                if sum(best) == room:
                    break
            lo += 1
        return best


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; every size is from 1 to `capacity`."""
    stock, bins, number = _Stock(sizes), [0] * len(sizes), 0
    while stock.sizes:
        inside, room = [], capacity
        while (size := stock.largest(room)) > 0:
            inside.append((size, stock.take(size)))
            room -= size
        if room and stock.sizes:
            small = min(inside)
            two = stock.best_two(room + small[0])
            if two and sum(two) > small[0]:
                inside.remove(small)
                inside += [(t, stock.take(t)) for t in two]
                stock.put(*small)
        for _, i in inside:
            bins[i] = number
        number += 1
    return bins


def fill(items: DataFrame, capacity: int = 2048, shard: int = 20_000) -> DataFrame:
    """``(id, piece, start, size, container)`` from ``(id, size)`` with unique ids.

    An item of at most `capacity` is one piece; a larger one is cut at
    multiples of it. ``container`` is unique over shards. Items of size 0 or
    null need no room: they get one piece of size 0 and a null container. No
    item is dropped; `shard` is about the number of items packed together, the
    share of room lost falls with it.
    """
    n = items.count()
    shards = max(1, math.ceil(n / shard))
    size = F.coalesce(F.col("size").cast("bigint"), F.lit(0))
    pieces = items.select("id", size.alias("size")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1))))
    pieces = pieces.select("id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("bigint").alias("size"))
    kind = f"id {dict(items.dtypes)['id']}, piece int, start bigint, size bigint, container string"
    empty = pieces.filter("size <= 0").withColumn("container", F.lit(None).cast("string"))
    full = pieces.filter(F.col("size") == capacity).withColumn("container", F.concat(F.lit("f-"), F.hex(F.xxhash64("id", "piece")), F.lit("-"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string")))
    rest = pieces.filter((F.col("size") > 0) & (F.col("size") < capacity)).withColumn("s", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def run(table):
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("piece", "ascending")])
        s = table.column("s")[0].as_py()
        bins = pack(table.column("size").to_pylist(), capacity)
        return table.drop_columns(["s"]).append_column("container", pa.array([f"s-{s}-{b}" for b in bins], pa.string()))

    return rest.groupBy("s").applyInArrow(run, kind).unionByName(full).unionByName(empty)
