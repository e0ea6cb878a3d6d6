"""Filling containers of fixed capacity with items of varying size: bounded-space online best-fit.

Items are dealt by a hash into groups of at most GROUP_ITEMS items and GROUP_SIZE units (one item over that bound is a group
of its own), each packed in one pass in hash order, at constant memory. A pass keeps at most OPEN_BINS open bins, in a bitset whose set bits are
the free spaces that some open bin has; the best bin for an item is the lowest set bit at or above its size. When one bin
too many is open, the fullest closes first. An item larger than the capacity is split into full containers and a
remainder, and only then. Every item is packed; none is dropped.

Items of size 0 or null size, and containers of null, zero or negative capacity, take no part. Repeated rows are items
of their own, and equal or null keys are spread over the groups. The sum of sizes of a group is a bound on a task's work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsift.shared import materialize

OPEN_BINS = 128
GROUP_SIZE = 1 << 24
GROUP_ITEMS = 500_000
KINDS_AT_ONCE = 500  # kinds whose names and capacities stand in one plan; more are packed in several
_PER_GROUP = 1 << 40


class BestFit:
    """Open bins by free space. `put` gives the number of the bin that an item of a size goes to."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0
        self.bins: dict[int, list[int]] = {}
        self.n_open = self.n_made = 0

    def _add(self, free: int, number: int) -> None:
        self.bins.setdefault(free, []).append(number)
        self.bits |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> int:
        rest = self.bins[free]
        number = rest.pop()
        if not rest:
            del self.bins[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return number

    def put(self, size: int) -> int:
        """The bin for an item of 1 to capacity units."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.n_made
            self.n_made += 1
        if free > size:
            self._add(free - size, number)
            if self.n_open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number


def _lanes(items: DataFrame, key: str, size: str) -> DataFrame:
    """The items with a size, written once with a lane: a hash by which equal and null keys are spread too. What is written
    stays, so a task that runs again gives the same containers."""
    lane = F.xxhash64(F.col(key), F.monotonically_increasing_id())
    return materialize(items.select(F.col(key), F.col(size).cast("bigint").alias("size")).where("size > 0").withColumn("_lane", lane), "pack-lanes")


def n_groups(lanes: DataFrame, group_size: int = GROUP_SIZE, group_items: int = GROUP_ITEMS) -> int:
    """The number of groups, by halving until no group of several items is over either bound."""
    over = lambda n, total: max(-(-total // group_size), -(-n // group_items))
    groups = max(1, over(*lanes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()))
    while True:
        loads = lanes.groupBy(F.pmod("_lane", F.lit(groups)).alias("_g")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
        if not loads.where((F.col("n") > 1) & ((F.col("n") > group_items) | (F.col("total") > group_size))).limit(1).count():
            return groups
        groups *= 2


def pack(
    items: DataFrame, key: str, size: str, kinds: Sequence[tuple[str, int]], open_bins: int = OPEN_BINS, group_size: int = GROUP_SIZE, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """`bundle_kind, container_id, <key>, piece_no, start_at, size`: every piece of every item in a container, for each
    of the `kinds` (name, capacity), however many. container_id is unique within its kind."""
    kinds = [(k, c) for k, c in kinds if c and c > 0]
    lanes = _lanes(items, key, size)
    groups = n_groups(lanes, group_size, group_items)
    some = [kinds[n : n + KINDS_AT_ONCE] for n in range(0, len(kinds), KINDS_AT_ONCE)] or [[]]
    return reduce(DataFrame.unionByName, [_pack(lanes, key, groups, k, open_bins) for k in some])


def _pack(lanes: DataFrame, key: str, groups: int, kinds: Sequence[tuple[str, int]], open_bins: int) -> DataFrame:
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).cast("bigint").alias("c")) for k, c in kinds]) if kinds else F.array().cast("array<struct<k:string,c:bigint>>"))
    pieces = (
        lanes.withColumn("_g", F.pmod("_lane", F.lit(groups)))
        .select(F.col(key), "size", "_lane", "_g", kind.alias("_k"))
        .select(F.col(key), "_lane", "_g", F.col("_k.k").alias("bundle_kind"), F.col("_k.c").alias("_c"), "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(size - 1) div _k.c"))).alias("piece_no"))
        .select("bundle_kind", "_c", "_g", "_lane", F.col(key), F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * F.col("_c")).alias("start_at"), F.least(F.col("_c"), F.col("size") - F.col("piece_no") * F.col("_c")).alias("size"))
    )
    dealt = pieces.repartition("bundle_kind", "_g").sortWithinPartitions("bundle_kind", "_g", "_lane", key, "piece_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bins = None, None
        for batch in batches:
            out = []
            for k, c, g, s in zip(*(batch.column(x).to_pylist() for x in ("bundle_kind", "_c", "_g", "size")), strict=True):
                if (k, g) != at:
                    at, bins = (k, g), BestFit(c, open_bins)
                out.append(g * _PER_GROUP + bins.put(s))
            yield pa.RecordBatch.from_arrays([batch.column("bundle_kind"), pa.array(out, pa.int64()), *[batch.column(x) for x in (key, "piece_no", "start_at", "size")]], names=["bundle_kind", "container_id", key, "piece_no", "start_at", "size"])

    return dealt.mapInArrow(run, f"bundle_kind string, container_id bigint, `{key}` {lanes.schema[key].dataType.simpleString()}, piece_no int, start_at bigint, size bigint")
