"""The statistical oracle: variation within groups against variation between groups.

A grid is a long table `group, repeat, feature_id, value`; a missing value is a null or an absent row and is skipped.
Grouping by variant, source or input turns the same decomposition into different checks. All steps are aggregates with
map-side combination: a group or feature of any size is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsift.operators.intervals import merged


def modes(grid: DataFrame) -> DataFrame:
    """`feature_id, group, n_values, mode`: distinct values of each group and the most frequent one, ties to the first repeat."""
    counts = grid.where("value is not null").groupBy("feature_id", "group", "value").agg(F.count(F.lit(1)).alias("n"), F.min("repeat").alias("first"))
    return counts.groupBy("feature_id", "group").agg(F.count(F.lit(1)).alias("n_values"), F.min_by("value", F.struct(-F.col("n"), F.col("first"), F.col("value"))).alias("mode"))


def decompose(grid: DataFrame) -> DataFrame:
    """`feature_id, floor, leak, n_between, max_within`: floor if some group varies within; leak if there are more distinct
    modes than the most values within any group, strictly, and more than one."""
    each = modes(grid).groupBy("feature_id").agg(F.max("n_values").alias("max_within"), F.count_distinct("mode").alias("n_between"))
    return each.select("feature_id", (F.col("max_within") > 1).alias("floor"), (F.col("n_between") > F.greatest("max_within", F.lit(1))).alias("leak"), "n_between", "max_within")


def noise_floor(values: DataFrame, n_repeats: int, absent_counts: bool) -> DataFrame:
    """`feature_id, n_values, floor` over the repeats of one input; where absent_counts, being absent is a value too."""
    seen = values.where("value is not null").groupBy("feature_id").agg(F.count_distinct("value").alias("n"), F.count_distinct("repeat").alias("present"))
    n = F.col("n") + (F.when(F.col("present") < n_repeats, 1).otherwise(0) if absent_counts else F.lit(0))
    return seen.select("feature_id", n.alias("n_values"), (n > 1).alias("floor"))


def verdict(decomposed: DataFrame, content_kept: Column | None = None, reason: str = "variant_correlated_leak") -> DataFrame:
    """`verdict, reason, leaks`: fail on any leak; a content check that failed comes before; else pass without reason."""
    kept = F.lit(True) if content_kept is None else content_kept
    one = decomposed.agg(F.coalesce(F.max("leak"), F.lit(False)).alias("any"), F.sort_array(F.collect_list(F.when(F.col("leak"), F.col("feature_id")))).alias("leaks"))
    said = F.when(~kept, "content_not_preserved").when(F.col("any"), reason)
    return one.select(F.when(said.isNull(), "pass").otherwise("fail").alias("verdict"), said.alias("reason"), "leaks")


def evidence(grid: DataFrame) -> DataFrame:
    """`feature_id, evidence`: the first value of each group as `group=hex`, joined by `; ` in the order of groups."""
    first = grid.where("value is not null").groupBy("feature_id", "group").agg(F.min_by("value", "repeat").alias("v"))
    told = F.concat(F.col("group"), F.lit("="), F.lower(F.hex("v")))
    return first.groupBy("feature_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", told.alias("t")))), lambda x: x["t"]), "; ").alias("evidence"))


def leaks_by_channel(decomposed: DataFrame, channels: DataFrame) -> DataFrame:
    """`channel, features`: the leaking features of each channel; features without one under `unclassified`."""
    found = decomposed.where("leak").join(F.broadcast(channels), "feature_id", "left")
    return found.groupBy(F.coalesce("channel", F.lit("unclassified")).alias("channel")).agg(F.array_join(F.sort_array(F.collect_set("feature_id")), ",").alias("features"))


def _differences(a: str, b: str) -> list[dict]:
    """The extents in which two texts differ, over their common length."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return []
    x, y = (np.frombuffer(t[:n].encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (x != y).astype(np.int8), [0]])))
    return [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)]


def disagreeing_runs(cohorts: DataFrame, cohort: str, member: str, blob: str) -> DataFrame:
    """`<cohort>, feature_id`: where the members of a cohort differ.

    Members of one length: each maximal run of differing places, `byte@offset:length`. Of different lengths: exactly
    `byte_tail@first` and `length_divergence`. A cohort of one has no features; null members are left out.

    All members agree at a place if each agrees with the first; so each is compared with the first of its cohort, and only
    the extents that differ are gathered and merged, never the places one by one.
    """
    known = cohorts.where(F.col(blob).isNotNull()).select(F.col(cohort).alias("_c"), F.col(member).alias("_m"), F.col(blob).alias("_b"))
    sizes = known.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"), F.min(F.length("_b")).alias("_min"), F.max(F.length("_b")).alias("_max"), F.min("_m").alias("_m")).where("_n > 1")
    firsts = sizes.join(known, ["_c", "_m"]).groupBy("_c", "_min", "_max").agg(F.min("_b").alias("_first"))
    pairs = known.join(firsts, "_c").where("_b <> _first").select("_c", "_min", "_max", "_first", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [_differences(a, b) for a, b in zip(batch.column("_first").to_pylist(), batch.column("_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, kind)], names=["_c", "_min", "_max", "_runs"])

    kind = known.schema["_c"].dataType.simpleString()
    extents = pairs.mapInArrow(run, f"_c {kind}, _min int, _max int, _runs array<struct<start:int,end:int>>").select("_c", "_min", "_max", F.explode("_runs").alias("_r")).select("_c", "_min", "_max", "_r.start", "_r.end").where("start < _min").distinct()
    even = merged(extents.where("_min = _max"), "_c").select(F.col("_c").alias(cohort), F.concat(F.lit("byte@"), F.col("start"), F.lit(":"), F.col("end") - F.col("start")).alias("feature_id"))
    firsts = extents.where("_min < _max").groupBy("_c").agg(F.min("start").alias("_at"))
    odd = sizes.where("_n > 1 and _min < _max").select("_c", "_min").join(firsts, "_c", "left")
    odd = odd.select(F.col("_c").alias(cohort), F.explode(F.array(F.concat(F.lit("byte_tail@"), F.coalesce("_at", "_min")), F.lit("length_divergence"))).alias("feature_id"))
    return even.unionByName(odd)


def shared_grams(outputs: DataFrame, inputs: DataFrame, text: str, key: str, size: int, constants: list[str] = ()) -> DataFrame:
    """`gram`: substrings of `size` characters in every output, in no input and in no constant."""
    cut = lambda df: df.where(F.length(text) >= size).select(F.col(key).alias("_k"), F.explode(F.expr(f"transform(sequence(1, length({text}) - {size} + 1), i -> substring({text}, i, {size}))")).alias("gram")).distinct()
    n = outputs.where(F.col(text).isNotNull()).select(key).distinct().count()
    common = cut(outputs).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("gram")
    return common.join(cut(inputs).select("gram").distinct(), "gram", "left_anti").where(~F.array_contains(F.lit(list(constants)) if constants else F.array().cast("array<string>"), F.col("gram")))


def cohort_grams(rows: DataFrame, cohort: str, text: str, size: int) -> DataFrame:
    """`<cohort>, gram`: the substrings of `size` characters that every text of a cohort holds. Texts shorter than that, and null
    ones, are members that hold none. Each row gives its distinct substrings, counted before the shuffle."""
    known = rows.select(F.col(cohort), F.col(text).alias("_t"))
    members = known.groupBy(cohort).agg(F.count(F.lit(1)).alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column("_t").to_pylist()):  # a text at a time: cutting by place is linear here, not in SQL
                if text and (held := {text[i : i + size] for i in range(len(text) - size + 1)}):
                    yield pa.RecordBatch.from_arrays([batch.column(cohort).take(pa.array([at] * len(held), pa.int32())), pa.array(list(held))], names=[cohort, "gram"])

    grams = known.mapInArrow(run, f"`{cohort}` {rows.schema[cohort].dataType.simpleString()}, gram string")
    shared = grams.groupBy(cohort, "gram").agg(F.count(F.lit(1)).alias("_k"))
    return shared.join(members, cohort).where("_k = _n").select(cohort, "gram")
