"""Operators on extents and ordered parts: gaps, merged spans, overlaps, running offsets, completeness.

Extents are half-open, [start, end). Null bounds are left out; empty extents cover nothing. What stands before a row is carried
over blocks (`carried`): rows are range-partitioned by group and order, a window runs within a block, and one row per group
and block carries its sum over the blocks, so a group of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plainsift.shared import materialize

#: How what two blocks carry is combined, by the aggregate; nulls are no values.
_COMBINED = {"max": F.greatest, "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}


def carried(rows: DataFrame, by: str, order: Sequence[str], value: Column, how: str, name: str) -> DataFrame:
    """rows with `name`: the aggregate `how` (max or sum) of value over all rows of the group before this one in `order`.

    Rows equal in all of `order` keep some order among themselves, the same for `name` as for the rows written."""
    gather: Callable = {"max": F.max, "sum": F.sum}[how]
    cut = rows.withColumn("_value", value).repartitionByRange(by, *order).withColumns({"_block": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    cut = materialize(cut, "carried")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("_near", gather("_value").over(before(Window.partitionBy(by, "_block").orderBy(*order, "_row"))))
    ends = cut.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_b")).agg(gather("_value").alias("_all"))
    over = ends.withColumn("_far", gather("_all").over(before(Window.partitionBy("_by").orderBy("_b")))).where("_far is not null").drop("_all")
    both = near.join(over, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b")), "left")
    return both.select(*rows.columns, _COMBINED[how](F.col("_near"), F.col("_far")).alias(name))


def gaps(spans: DataFrame, by: str, bounds: DataFrame | None = None) -> DataFrame:
    """`<by>, gap_start, gap_end`: the parts that no extent covers, between the first and the last extent of a group; with
    bounds (`<by>, low, high`) all parts of [low, high), also of groups without extents. Groups without bounds are left out then."""
    known = spans.where("start is not null and end is not null and end > start").select(by, "start", "end")
    if bounds is not None:
        limits = bounds.where("low is not null and high is not null and high > low").select(F.col(by).alias("_by"), "low", "high")
        inside = known.join(limits, F.col(by).eqNullSafe(F.col("_by"))).select(by, F.greatest("start", "low").alias("start"), F.least("end", "high").alias("end")).where("end > start")
        edges = [limits.select(F.col("_by").alias(by), F.col(c).alias("start"), F.col(c).alias("end")) for c in ("low", "high")]
        known = inside.unionByName(edges[0]).unionByName(edges[1])
    seen = carried(known, by, ["start", "end"], F.col("end"), "max", "_reach")
    return seen.where("start > _reach").select(by, F.col("_reach").alias("gap_start"), F.col("start").alias("gap_end"))


def merged(spans: DataFrame, by: str) -> DataFrame:
    """`<by>, start, end, n`: overlapping or touching extents as one."""
    known = spans.where("start is not null and end is not null and end > start").select(by, "start", "end")
    seen = carried(known, by, ["start", "end"], F.col("end"), "max", "_reach").withColumn("_new", F.when(F.col("start") > F.col("_reach"), 1).otherwise(0))
    numbered = carried(seen, by, ["start", "end"], F.col("_new"), "sum", "_before").withColumn("_span", F.coalesce("_before", F.lit(0)) + F.col("_new"))
    return numbered.groupBy(by, "_span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_span")


def overlaps(spans: DataFrame, by: str, key: str) -> DataFrame:
    """`<by>, <key>`: extents that start before an earlier one ends."""
    known = spans.where("start is not null and end is not null").select(by, key, "start", "end")
    return carried(known, by, ["start", key], F.col("end"), "max", "_reach").where("start < _reach").select(by, key)


def running_offsets(parts: DataFrame, by: str, order: list[str], size: str, base: int = 0) -> DataFrame:
    """parts with `new_offset`: where each part lands when they are laid out one after the other from base."""
    laid = carried(parts, by, order, F.coalesce(F.col(size), F.lit(0)), "sum", "_before")
    return laid.select(*parts.columns, (F.coalesce("_before", F.lit(0)) + base).alias("new_offset"))


def completeness(fragments: DataFrame, by: str, number: str) -> DataFrame:
    """`<by>, complete`: whether the numbers of a group are 1 to n, each once."""
    each = fragments.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("lo"), F.max(number).alias("hi"), F.count_distinct(number).alias("d"))
    return each.select(by, F.coalesce((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n")), F.lit(False)).alias("complete"))


def first_seen(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group: an aggregate, combined before the shuffle, so a group of any size is spread."""
    rest = [c for c in rows.columns if c not in by]
    first = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return first.select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)
