"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups are rows of equal text, ordered by the md5 of the text. The smallest shard capacity for which a greedy
left-to-right filling needs no more than the wanted shards is found by binary search; the groups are then cut there.

Only sums of md5 prefixes come to the driver. A greedy cut inside a prefix lies between the prefix's two ends; filling with
the one and with the other bounds the capacity. The few prefixes that a cut may fall in are refined by further digits, all
in one job, until the bounds meet and every cut stands between two groups: the answer is exact, in a handful of jobs and
with a bounded number of sums, however many groups there are.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import materialize, utf8

#: Hexadecimal digits of the md5 prefixes whose sums are fetched first, and by which a prefix is refined.
FIRST_DIGITS, MORE_DIGITS = 4, 3
KEY_DIGITS = 32
#: Prefixes refined at a time.
REFINED = 256
#: Rows of a shard are numbered in so many independent runs.
SLOT_RUNS = 512


class PrefixSums:
    """Bytes of ordered groups by prefixes of their keys. groups: key, bytes, one row a group."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.nodes = self._fetch([], FIRST_DIGITS)
        self.largest = max((n[3] for n in self.nodes), default=0)
        self._index()

    def _fetch(self, prefixes: list[str], digits: int) -> list[tuple[str, int, bool, int]]:
        """(prefix, bytes, whether it is one group, largest group) of the parts of the prefixes, or of all."""
        rows = self.groups
        if prefixes:
            rows = rows.where(F.substring("key", 1, len(prefixes[0])).isin(prefixes))
        sums = rows.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("largest"))
        return [(r["prefix"], r["bytes"], r["n"] == 1, r["largest"]) for r in sorted(sums.collect(), key=lambda r: r["prefix"])]

    def _index(self) -> None:
        self.ends = list(accumulate(n[1] for n in self.nodes))
        self.total = self.ends[-1] if self.ends else 0

    def refine(self, at: set[int]) -> None:
        """Put the parts of some nodes in their place."""
        by_digits: dict[int, list[str]] = {}
        for i in at:
            by_digits.setdefault(len(self.nodes[i][0]), []).append(self.nodes[i][0])
        parts = [n for d, prefixes in by_digits.items() for n in self._fetch(prefixes, min(KEY_DIGITS, d + MORE_DIGITS))]
        self.nodes = sorted([n for i, n in enumerate(self.nodes) if i not in at] + parts)
        self._index()

    def fill(self, capacity: int, shards: int, low: bool) -> list[int] | None:
        """Where greedy filling ends each shard but the last, or None if so many shards are not enough. A cut inside a
        prefix is put at its beginning (low) or where the shard is full, which no greedy cut is before or behind."""
        at, cuts = 0, []
        for _ in range(shards):
            if at + capacity >= self.total:
                return cuts
            i = bisect_right(self.ends, at + capacity)
            start = self.ends[i - 1] if i else 0
            at = start if low or self.nodes[i][2] else at + capacity
            cuts.append(at)
        return None

    def open_nodes(self, low: int, high: int, shards: int) -> set[int]:
        """Nodes of several groups in which a cut may fall, for capacities from low to high."""
        first, last = self._path(low, shards, True), self._path(high, shards, False)
        found = set()
        for a, b in zip(first, last):
            for i in range(bisect_right(self.ends, a), min(bisect_right(self.ends, b), len(self.nodes) - 1) + 1):
                if not self.nodes[i][2]:
                    found.add(i)
        return found

    def _path(self, capacity: int, shards: int, low: bool) -> list[int]:
        """The fullest reach of each shard, whether or not the shards are enough."""
        at, ends = 0, []
        for _ in range(shards - 1):
            reach = min(at + capacity, self.total)
            ends.append(reach)
            i = min(bisect_right(self.ends, reach), len(self.nodes) - 1)
            start = self.ends[i - 1] if i else 0
            at = reach if reach == self.total else start if low or self.nodes[i][2] else reach
        return ends


def least(low: int, high: int, good) -> int:
    """The smallest number from low on that is good, high if none before it is."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid + 1, high)
    return high


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest capacity, and for each shard but the first the prefix that its keys begin with or follow. groups: key,
    bytes (one row a group)."""
    sums = PrefixSums(groups)
    if not sums.total:
        return 0, []
    low = max(sums.largest, -(-sums.total // shards))
    high = -(-sums.total // shards) + sums.largest  # always enough
    while True:
        high = least(low, high, lambda c: sums.fill(c, shards, low=True) is not None)
        low = least(low, high, lambda c: sums.fill(c, shards, low=False) is not None)
        still = sums.open_nodes(low, high, shards)
        if not still:
            break
        # The largest leave most open; what they still leave is refined in the next turn.
        sums.refine(set(sorted(still, key=lambda i: -sums.nodes[i][1])[:REFINED]))
    cuts = sums.fill(high, shards, low=True)
    return high, [sums.nodes[bisect_right(sums.ends, c)][0] for c in cuts]


def text_key(text: Column) -> Column:
    return F.md5(utf8(text).cast("binary"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Assign every row of docs to a shard and a slot in it.

    Returns doc_id, size, text_crc32, group_key, shard, slot, capacity. size is the text's UTF-8 bytes plus 1. Null
    texts count as empty ones: size 1, checksum 0, one group with the empty texts. Rows of equal text are never parted,
    however many; repeated rows each get a slot of their own, rows with a null doc_id too. An empty table gives no rows.
    Where there are fewer groups than shards, the last shards stay empty. Very long texts count whole. Other columns of
    docs are not read.
    """
    rows = docs.select("doc_id", F.octet_length(utf8(F.col("text"))).cast("long").alias("size"), F.crc32(utf8(F.col("text")).cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("group_key"))
    rows = materialize(rows.withColumn("size", F.col("size") + 1).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SLOT_RUNS))), "shard-rows")
    groups = rows.groupBy(F.col("group_key").alias("key")).agg(F.sum("size").alias("bytes"))
    groups = materialize(groups.repartitionByRange("key").sortWithinPartitions("key"), "shard-groups")
    capacity, cuts = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("group_key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    # Rows of one id are dealt to runs by their text, rows without an id by where they were read.
    run = F.pmod(F.xxhash64("doc_id", "group_key", F.when(F.col("doc_id").isNull(), F.col("part"))), F.lit(SLOT_RUNS)).cast("int")
    placed = rows.withColumn("shard", shard).withColumn("run", run).drop("part")
    runs = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))  # shards * SLOT_RUNS rows at most
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "run").orderBy("doc_id", "group_key")
    return (
        placed.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(runs), ["shard", "run"])
        .select("doc_id", "size", "text_crc32", "group_key", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(capacity).cast("long").alias("capacity"))
    )
