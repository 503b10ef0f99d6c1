"""Sharding by best-fit-decreasing bin packing.

Rows of one group stay together. Groups in decreasing size enter the bin with the least room that still holds them; the
bins are kept in a balanced tree by remaining room. Packing is sequential, so it sees a bounded number of items: groups
below total / (bins * `grain`) are first joined, in decreasing size, into units of about that size by a distributed prefix
sum. There are at most 2 * bins * `grain` + bins items, whatever the input (with 16 bins and a grain of 1000: 32,016).

Cases: a null text counts as the empty text; repeated rows are rows of one group; a group larger than its fair share gets
a bin of its own; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import keep, positions

GRAIN = 1000


class RoomTree:
    """A treap of (room, bin) pairs; priorities are a hash of the pair, so its shape depends on its contents alone."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _rank(key):
        return (key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if self._rank(a[0]) > self._rank(b[0]):
            a[2] = self._join(a[2], b)
            return a
        b[1] = self._join(a, b[1])
        return b

    def add(self, room, number):
        left, right = self._split(self.root, (room, number))
        self.root = self._join(self._join(left, [(room, number), None, None]), right)

    def take_tightest(self, size):
        """Remove and return the pair with the least room >= size, or None."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        first = right
        while first[1] is not None:
            first = first[1]
        _, rest = self._split(right, (first[0][0], first[0][1] + 1))
        self.root = self._join(left, rest)
        return first[0]


def best_fit_decreasing(sizes: list[int], capacity: int, limit: int | None = None) -> list[int] | None:
    """Bin of each item (in the order given, which must be decreasing); None as soon as more than `limit` bins are needed."""
    tree, bins, out = RoomTree(), 0, []
    for s in sizes:
        found = tree.take_tightest(s)
        if found is None:
            if limit is not None and bins == limit:
                return None
            found, bins = (max(capacity, s), bins), bins + 1
        tree.add(found[0] - s, found[1])
        out.append(found[1])
    return out


def pack_evenly(sizes: list[int], bins: int) -> list[int]:
    """Best fit decreasing into `bins` bins of the smallest capacity that suffices. An item above the fair share of what is left gets its own bin."""
    out, total, own = [], sum(sizes), 0
    while own < min(bins - 1, len(sizes)) and sizes[own] * (bins - own) >= total:
        total -= sizes[own]
        out.append(own)
        own += 1
    rest, left = sizes[own:], bins - own
    low = max([-(-total // left), *rest[:1]])
    high, found = low, best_fit_decreasing(rest, low, left)
    while found is None:  # widen, then halve
        low, high = high + 1, high + max(1, high // 64)
        found = best_fit_decreasing(rest, high, left)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(rest, middle, left)
        if tried is None:
            low = middle + 1
        else:
            high, found = middle, tried
    return out + [own + b for b in found]


def assign(groups: DataFrame, bins: int, grain: int = GRAIN) -> DataFrame:
    """`groups` (group, size) with their bin."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("size")).first()[0] or 0
    unit = max(1, -(-total // (bins * grain)))
    large = groups.where(F.col("size") >= unit).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    placed = positions(groups, [F.desc("size"), F.asc("group")], ["size"], "shard-groups")
    placed = placed.withColumn("unit", F.when(
        F.col("_row") < large[0], F.col("_row")).otherwise(F.lit(large[0]) + F.floor((F.col("_before_size") - F.lit(large[1])) / F.lit(unit))))
    units = placed.groupBy("unit").agg(F.sum("size").alias("size")).collect()  # bounded, see above
    units.sort(key=lambda r: (-r["size"], r["unit"]))
    found = pack_evenly([r["size"] for r in units], bins)
    if not units:
        return placed.select("group", F.lit(0).alias("shard"))
    chosen = spark.createDataFrame([(int(r["unit"]), int(b)) for r, b in zip(units, found)], "unit long, shard int")
    return placed.join(F.broadcast(chosen), "unit").select("group", "shard")


def shard(docs: DataFrame, bins: int = 16, grain: int = GRAIN) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard; rows with equal texts share a shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("group")), "shard-rows")
    chosen = assign(rows.groupBy("group").agg(F.sum("size").alias("size")), bins, grain)
    sharded = rows.join(chosen, "group")
    placed = keep(positions(sharded.drop("group"), ["shard", "doc_id", "text_crc32", "size"], [], "shard-slots"), "shard-placed")
    starts = placed.groupBy("shard").agg(F.min("_row").alias("_start"))
    return placed.join(F.broadcast(starts), "shard").select(  # a row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
