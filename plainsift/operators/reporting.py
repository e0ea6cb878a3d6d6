"""Aggregates that summarise runs: modal values, intersections, ledgers, coverage, areas, slowest, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def census(rows: DataFrame, by: str, value: str) -> DataFrame:
    """`<by>, modal`: the most frequent value, ties to the least text, with ` +n more` for other distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(by).agg(F.min_by(F.col(value).cast("string"), F.struct(-F.col("_n"), F.col(value).cast("string"))).alias("_v"), (F.count(F.lit(1)) - 1).alias("_more"))
    return best.select(by, F.concat("_v", F.when(F.col("_more") > 0, F.concat(F.lit(" +"), F.col("_more"), F.lit(" more"))).otherwise("")).alias("modal"))


def consistent(rows: DataFrame, by: str, member: str, value: str) -> DataFrame:
    """`<by>, outcome`: the values that every member of a group allows, `varies` if there is none.

    A value is in the intersection if as many members hold it as there are; so sets are never gathered."""
    held = rows.where(F.col(value).isNotNull()).select(by, member, value).distinct()
    members = held.select(by, member).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    shared = held.groupBy(by, value).agg(F.count(F.lit(1)).alias("_k")).join(members, by).where("_k = _n").groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(F.col(value).cast("string"))), ",").alias("_all"))
    return members.join(shared, by, "left").select(by, F.coalesce("_all", F.lit("varies")).alias("outcome"))


def ledger(definitions: DataFrame, number: str, used: DataFrame) -> DataFrame:
    """`<number>, superseded, orphaned`: definitions of each object but the last, and whether nothing uses it."""
    each = definitions.groupBy(number).agg((F.count(F.lit(1)) - 1).alias("superseded"))
    return each.join(used.select(number).distinct().withColumn("_u", F.lit(True)), number, "left").select(number, "superseded", F.col("_u").isNull().alias("orphaned"))


def coverage(files: DataFrame, covered: Column, total: Column) -> DataFrame:
    """`gated_percent, overall_percent, untouched`: shares over files that anything covers, and over all; empty gives 100.

    Files without statements are left out."""
    known = files.select(F.coalesce(covered, F.lit(0)).alias("c"), total.alias("t")).where("t > 0")
    share = lambda c, t: F.coalesce(F.round(F.lit(100) * c / t, 2), F.lit(100.0))
    return known.agg(
        share(F.sum(F.when(F.col("c") > 0, F.col("c"))).cast("double"), F.sum(F.when(F.col("c") > 0, F.col("t")))).alias("gated_percent"),
        share(F.sum("c").cast("double"), F.sum("t")).alias("overall_percent"),
        F.count_if(F.col("c") == 0).alias("untouched"),
    )


def top(rows: DataFrame, by: str, n: int, first: str) -> DataFrame:
    """`<by>, n`: the n most frequent values, ties to the one seen first."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first", by).limit(n).select(by, "n")


def slowest(cases: DataFrame, case: str, seconds: str, leg: str, n: int = 10) -> DataFrame:
    """The n cases whose greatest time over all legs is greatest, with that leg."""
    each = cases.where(F.col(seconds).isNotNull()).groupBy(case).agg(F.max(seconds).alias(seconds), F.max_by(leg, F.struct(seconds, leg)).alias(leg))
    return each.orderBy(F.desc(seconds), case).limit(n)


def first_n(rows: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """`<by>, shown`: the first n distinct values in order, then `and k more`. Only n values of a group are gathered."""
    each = rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("string").alias("_v")).distinct()
    order = each.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_v")))
    said = order.groupBy(by).agg(F.sort_array(F.collect_list(F.when(F.col("_n") <= n, F.col("_v")))).alias("_list"), F.count(F.lit(1)).alias("_k"))
    return said.select(by, F.concat(F.array_join("_list", ", "), F.when(F.col("_k") > n, F.concat(F.lit(" and "), F.col("_k") - n, F.lit(" more"))).otherwise("")).alias("shown"))


def area_grid(cases: DataFrame, area: Column, leg: str, legs: Sequence[str], status: str, seconds: str) -> DataFrame:
    """`area`, per leg `<leg>_pass` and `<leg>_fail`, and `seconds`, with a row `all` for the totals."""
    marked = cases.withColumn("area", area)
    counts = [F.count_if((F.col(leg) == x) & (F.col(status) == s)).alias(f"{x}_{s}") for x in legs for s in ("pass", "fail")]
    return marked.rollup("area").agg(*counts, F.round(F.sum(seconds), 2).alias("seconds"), F.grouping("area").alias("_g")).withColumn("area", F.when(F.col("_g") == 1, "all").otherwise(F.col("area"))).drop("_g")


def rate_report(rows: DataFrame, maker: str, rate: str, value: str) -> DataFrame:
    """`<maker>, <rate>, n, values, histogram`: per maker and rate, the distinct values in order, and how often each occurs.
    Values are counted first, so a group gathers one entry per distinct value, of which rates and settings have few."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(maker, rate, value).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "_n")))
    told = counts.groupBy(maker, rate).agg(F.sum("_n").alias("n"), entries.alias("_e"))
    said = lambda f: F.array_join(F.transform("_e", f), " ")
    return told.select(maker, rate, "n", said(lambda e: e["v"].cast("string")).alias("values"), said(lambda e: F.concat(e["v"].cast("string"), F.lit(":"), e["_n"])).alias("histogram"))


def merge_maps(rows: DataFrame, by: str, map_: str) -> DataFrame:
    """`<by>, key, total`: maps of counts added up key by key."""
    return rows.select(by, F.explode(map_).alias("key", "v")).groupBy(by, "key").agg(F.sum("v").alias("total"))


def standardised_centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """`<label>, at, centre`: the mean of each standardised coordinate, by population deviation with 1e-12 added."""
    long = rows.where(F.col(vector).isNotNull()).select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x"))
    scale = long.groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.groupBy(label, "at").agg(F.avg("x").alias("c")).join(scale, "at").select(label, "at", ((F.col("c") - F.col("m")) / (F.col("s") + 1e-12)).alias("centre"))
