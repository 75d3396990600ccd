"""Sharding by best-fit-decreasing bin packing of indivisible groups.

`pack` is the packer: sizes in decreasing order each enter the bin with the least remaining capacity
that still fits, found in a balanced tree of remaining capacities; a new bin opens when none fits.
Groups of one size are interchangeable, so the packer sees a table of sizes and counts, not groups.
Sizes are rounded up to ten significant bits (under 0.2 %), which bounds that table by some 28,000
rows for any input; it alone comes to the driver. The plan that comes back says which ranks of
each size go to which shard, and is joined to groups ranked within their size. Ranks and slots
are numbered in two steps, counts of small blocks first, so that no size or shard is one task's work.

`near_equal` finds the least capacity that gives a fixed number of shards. A group larger than an even
share gets a shard of its own and the others share the rest.

A group is all rows of one text (128-bit hash; were two texts to share one they would only share a
shard). Null text counts as empty and has size 1. Null doc_ids and repeated rows are placed like any
other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of the two-step numbering, about.
BLOCK_ROWS = 100_000
SIGNIFICANT_BITS = 10


class CapacityTree:
    """Bins by remaining capacity in an AA tree: insert, and take the tightest that fits."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, level]

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (remaining, bin) with remaining >= size."""
        best, node = None, self.root
        while node:
            if node[0] >= (size, -1):
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            self.root = self._delete(self.root, best)
        return best

    @staticmethod
    def _level(node: list | None) -> int:
        return node[3] if node else 0

    def _skew(self, node: list | None) -> list | None:
        if node and node[1] and node[1][3] == node[3]:
            left = node[1]
            node[1], left[2] = left[2], node
            return left
        return node

    def _split(self, node: list | None) -> list | None:
        if node and node[2] and node[2][2] and node[2][2][3] == node[3]:
            right = node[2]
            node[2], right[1] = right[1], node
            right[3] += 1
            return right
        return node

    def _insert(self, node: list | None, key: tuple[int, int]) -> list:
        if not node:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._insert(node[side], key)
        return self._split(self._skew(node))

    def _delete(self, node: list | None, key: tuple[int, int]) -> list | None:
        if not node:
            return None
        if key < node[0]:
            node[1] = self._delete(node[1], key)
        elif key > node[0]:
            node[2] = self._delete(node[2], key)
        elif not node[1] and not node[2]:
            return None
        elif not node[1]:
            heir = node[2]
            while heir[1]:
                heir = heir[1]
            node[0], node[2] = heir[0], self._delete(node[2], heir[0])
        else:
            heir = node[1]
            while heir[2]:
                heir = heir[2]
            node[0], node[1] = heir[0], self._delete(node[1], heir[0])
        least = min(self._level(node[1]), self._level(node[2])) + 1
        if least < node[3]:
            node[3] = least
            if node[2] and least < node[2][3]:
                node[2][3] = least
        node = self._skew(node)
        if node[2]:
            node[2] = self._skew(node[2])
            if node[2][2]:
                node[2][2] = self._skew(node[2][2])
        node = self._split(node)
        node[2] = self._split(node[2])
        return node


def pack(sizes: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """(size, first rank, end rank, bin) for sizes given as (size, count).

    Items over the capacity get a bin each. None if more than most_bins would be needed.
    """
    tree, bins, plan = CapacityTree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        rank = 0
        while rank < count:
            tightest = tree.take_tightest(size)
            if tightest is None:
                if most_bins is not None and bins >= most_bins:
                    return None
                tightest = (max(capacity, size), bins)
                bins += 1
            remaining, own = tightest
            # it stays the tightest bin that fits while it takes more of the same size
            n = min(count - rank, remaining // size)
            plan.append((size, rank, rank + n, own))
            tree.insert((remaining - n * size, own))
            rank += n
    return plan


def near_equal(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """The plan of the least capacity at which at most `shards` bins hold all; see the module's note."""
    left, plan, own = dict(sizes), [], 0
    ranks: dict[int, int] = {}
    while left and own < shards - 1:
        total, largest = sum(s * n for s, n in left.items()), max(left)
        if largest * (shards - own) <= total:
            break
        plan.append((largest, ranks.get(largest, 0), ranks.get(largest, 0) + 1, own))
        ranks[largest] = ranks.get(largest, 0) + 1
        left[largest] -= 1
        if not left[largest]:
            del left[largest]
        own += 1
    if not left:
        return plan
    rest, total = shards - own, sum(s * n for s, n in left.items())
    lo, hi = max(-(-total // rest), max(left)), total
    found = None
    while lo < hi:
        mid = (lo + hi) // 2 if found else min(hi, lo + max(1, lo // 1000))
        if (tried := pack(list(left.items()), mid, rest)) is not None:
            hi, found = mid, tried
        else:
            lo = mid + 1
    found = pack(list(left.items()), lo, rest)
    return plan + [(s, a + ranks.get(s, 0), b + ranks.get(s, 0), k + own) for s, a, b, k in found]


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """df with `name`: gapless numbers from 0 within keys, made block by block."""
    blocks = max(16, -(-rows // BLOCK_ROWS))
    blocked = df.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = blocked.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys, "__block").orderBy(*order)
    return blocked.withColumn("__row", F.row_number().over(within) - 1).join(starts, [*keys, "__block"]).withColumn(name, (F.col("__row") + F.col("__start")).cast("long")).drop("__block", "__row", "__start")


def rounded_up(size: Column) -> Column:
    """The size rounded up to SIGNIFICANT_BITS significant bits."""
    shift = F.greatest(F.length(F.bin(size)) - SIGNIFICANT_BITS, F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return (F.ceil(size / unit) * unit).cast("long")


def group_plan(groups: DataFrame, key: str, weight: str, shards: int) -> DataFrame:
    """(key, shard): every group of the table in one of the shards, sizes near equal."""
    spark = groups.sparkSession
    sized = groups.select(key, rounded_up(F.col(weight)).alias("cls"))
    # bounded: sizes of ten significant bits
    sizes = [(r["cls"], r["n"]) for r in sized.groupBy("cls").agg(F.count("*").alias("n")).collect()]
    plan = spark.createDataFrame(near_equal(sizes, shards), "cls long, lo long, hi long, shard int")
    ranked = numbered(sized, ["cls"], [key], "rank", sum(n for _, n in sizes))
    return ranked.join(F.broadcast(plan), "cls").where("rank >= lo and rank < hi").select(key, "shard")


def shard_documents(df: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row; equal texts share a shard."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.unhex(F.md5(body)).alias("g"),
    )
    groups = rows.groupBy("g").agg(F.sum("size").alias("weight"))
    placed = rows.join(group_plan(groups, "g", "weight", shards), "g")
    n = df.count()
    return numbered(placed, ["shard"], ["doc_id", "g"], "slot", n).select("doc_id", "size", "text_crc32", "shard", "slot")
