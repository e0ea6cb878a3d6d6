"""Exact percentiles per group by distributed multi-select, and summaries of groups that can be merged.

`percentiles` works on ranges of values: at first one per group, with the ranks wanted of it. Each round takes all ranges of
more than `limit` values of all groups at once: every partition proposes the median of its values in a range, the weighted
median of the proposals becomes the range's pivot, and the values below, at and above it are counted. A rank that falls on the
pivot is found. The parts below and above that hold a wanted rank are the ranges of the next round; the values of all other
parts are discarded: what is left is written anew, so a round reads only what the round before has kept. A range that has
come down to `limit` values is sorted as one window partition. `limit` is a constant and doesn't grow with the data. A
group of any size, or one value repeated any number of times, never meets in one task. Ranges, ranks and pivots are tables, not
literals or driver collections: the driver only sees whether a round has left anything open, and Spark joins them by their size.

The p-th percentile of n values is the value of rank ceil(p * n / 100), at least 1: an observed value, with no error.
Percentiles are whole numbers from 1 to 100. Null values take no part; a null group is a group of its own.

`summaries`: per group and part (at most `limit` rows each), the values at POINTS + 1 equidistant ranks. `merged` combines
summaries of any parts, days or files: each part of n rows may be off by n / POINTS ranks, so a merged percentile is
within 1 / POINTS (0.5 %) of rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plainsift.shared import materialize

LIMIT = 1000
PART_ROWS = 100_000
POINTS = 200
PROPOSAL_ACCURACY = 1000


def _rank(percent: Column | int, n: Column) -> Column:
    """ceil(percent * n / 100) in whole numbers."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor((F.lit(percent) * n + 99) / 100).cast("bigint"))


def _pivots(active: DataFrame, value: str) -> DataFrame:
    """`range, pivot`: the weighted median of the medians that the partitions propose for each range."""
    local = active.groupBy("range", F.spark_partition_id().alias("_part")).agg(F.percentile_approx(value, 0.5, PROPOSAL_ACCURACY).alias("_median"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("range")  # a row per partition
    weighed = local.withColumn("_upto", F.sum("_n").over(whole.orderBy("_median"))).withColumn("_all", F.sum("_n").over(whole))
    return weighed.where("_upto * 2 >= _all").groupBy("range").agg(F.min("_median").alias("pivot"))


def _step(active: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """`pivot, found` and the parts `low`, `high` of each range: id, size and wanted ranks, or null if none is wanted."""
    halves = active.join(_pivots(active, value), "range").groupBy("range", "pivot")
    counts = halves.agg(F.count_if(F.col(value) < F.col("pivot")).alias("_below"), F.count_if(F.col(value) == F.col("pivot")).alias("_at"))
    upto = F.col("_below") + F.col("_at")
    low = F.filter("wanted", lambda w: w["rank"] <= F.col("_below"))
    high = F.transform(F.filter("wanted", lambda w: w["rank"] > upto), lambda w: F.struct(w["percent"].alias("percent"), (w["rank"] - upto).alias("rank")))
    hit = F.transform(F.filter("wanted", lambda w: (w["rank"] > F.col("_below")) & (w["rank"] <= upto)), lambda w: w["percent"])
    part = lambda side, n, wanted: F.when(F.size(wanted) > 0, F.struct((F.monotonically_increasing_id() * 2 + side).alias("id"), n.alias("n"), wanted.alias("wanted")))
    return ranges.join(counts, "range").select("range", "group", "pivot", hit.alias("found"), part(0, F.col("_below"), low).alias("low"), part(1, F.col("n") - upto, high).alias("high"))


def _children(step: DataFrame) -> DataFrame:
    """`range, group, n, wanted` of the parts that a round has left."""
    parts = F.explode(F.array_compact(F.array("low", "high"))).alias("c")
    return step.select("group", parts).select(F.col("c.id").alias("range"), "group", F.col("c.n").alias("n"), F.col("c.wanted").alias("wanted"))


def _sorted_picks(small: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """`group, percent, value` of ranges of at most `limit` values, each sorted whole; a range is known by round and number."""
    at = small.withColumn("_rn", F.row_number().over(Window.partitionBy("round", "range").orderBy(value)))
    wanted = ranges.select("round", "range", "group", F.explode("wanted").alias("w")).select("round", "range", "group", F.col("w.percent").alias("percent"), F.col("w.rank").cast("int").alias("_rn"))
    return at.join(wanted, ["round", "range", "_rn"]).select("group", "percent", F.col(value).alias("value"))


def multi_select(values: DataFrame, ranges: DataFrame, value: str, limit: int = LIMIT, rounds: list[int] | None = None) -> DataFrame:
    """`group, percent, value` for `ranges` (range, group, n, wanted) over `values` (range, <value>). Both should be written tables.
    The number of values that each round has read is added to `rounds`."""
    picks, fits, small, active, open_, number = [], [], [], values, ranges, 0
    every = lambda found: reduce(DataFrame.unionByName, found)
    while True:
        few = open_.where(F.col("n") <= limit)
        down = active.join(few.select("range"), "range", "left_semi") if active is values else active.where(~F.col("large"))
        fits.append(down.select(F.lit(number).alias("round"), "range", value))
        small.append(few.select(F.lit(number).alias("round"), "range", "group", "wanted"))
        number += 1
        open_ = open_.where(F.col("n") > limit)
        left = open_.agg(F.sum("n")).first()[0]
        if not left:
            return every([_sorted_picks(every(fits), every(small), value), *picks])
        if rounds is not None:
            rounds.append(left)
        active = active.join(open_.select("range"), "range", "left_semi") if active is values else active.where("large").select("range", value)
        step = materialize(_step(active, open_, value), "select-step")
        picks.append(step.select("group", F.explode("found").alias("percent"), F.col("pivot").alias("value")))
        side = F.when(F.col(value) < F.col("pivot"), F.col("low")).when(F.col(value) > F.col("pivot"), F.col("high"))
        kept = active.join(step.select("range", "pivot", *[F.struct(F.col(f"{s}.id").alias("id"), (F.col(f"{s}.n") > limit).alias("large")).alias(s) for s in ("low", "high")]), "range")
        survivors = kept.select(side.alias("s"), value).where("s.id is not null").select(F.col("s.id").alias("range"), F.col("s.large").alias("large"), value)
        active, open_ = materialize(survivors, "select-survivors"), _children(step)


def percentiles(values: DataFrame, by: Sequence[str], value: str, percents: Sequence[int], limit: int = LIMIT, rounds: list[int] | None = None) -> DataFrame:
    """`by, n, p<percent>...`: the exact percentiles of the column `value` in each group. values should be a written table."""
    known = values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    wanted = F.array(*[F.struct(F.lit(p).alias("percent"), _rank(p, F.col("n")).alias("rank")) for p in percents])
    names = {c: f"_b{i}" for i, c in enumerate(by)}
    sizes = known.select(*[F.col(c).alias(b) for c, b in names.items()]).groupBy(*names.values()).agg(F.count(F.lit(1)).alias("n"))
    groups = materialize(sizes.withColumn("group", F.monotonically_increasing_id()), "select-groups")
    ranges = groups.select(F.col("group").alias("range"), "group", "n", wanted.alias("wanted"))
    on = [known[c].eqNullSafe(groups[b]) for c, b in names.items()]
    tagged = known.join(groups, on).select(F.col("group").alias("range"), "_v")
    found = multi_select(materialize(tagged, "select-values"), ranges, "_v", limit, rounds)
    wide = found.groupBy("group").agg(*[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(f"p{p}") for p in percents])
    return groups.join(wide, "group").select(*[F.col(b).alias(c) for c, b in names.items()], "n", *[f"p{p}" for p in percents])


def summaries(values: DataFrame, by: Sequence[str], value: str, points: int = POINTS, limit: int = PART_ROWS) -> DataFrame:
    """`by, part, n, points`: of each part of each group, the values at ranks 1 and ceil(i * n / points), i = 1 .. points."""
    known = values.where(F.col(value).isNotNull()).select(*by, value)
    sizes = materialize(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")), "summary-sizes").where(F.col("_size") > limit)
    names = {f"_b{i}": c for i, c in enumerate(by)}
    hot = sizes.select(*[F.col(c).alias(b) for b, c in names.items()], F.ceil(F.col("_size") / limit).cast("int").alias("_parts"))
    split = known.join(hot, [F.col(c).eqNullSafe(F.col(b)) for b, c in names.items()], "left").withColumn("part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts").cast("bigint")), F.lit(0)).cast("int"))
    part = Window.partitionBy(*by, "part")
    at = split.withColumn("_rn", F.row_number().over(part.orderBy(value))).withColumn("n", F.count(F.lit(1)).over(part))
    step = F.floor(F.col("_rn") * points / F.col("n"))
    times = (step - F.floor((F.col("_rn") - 1) * points / F.col("n"))).cast("int")
    marks = at.withColumn("_times", F.when(F.col("n") <= points, F.lit(1)).otherwise(times)).where((F.col("_times") > 0) | (F.col("_rn") == 1))
    return marks.groupBy(*by, "part", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).alias("value")))), lambda x: F.struct(x["_rn"].alias("rank"), x["value"].alias("value"))).alias("points"))


def merged(found: DataFrame, by: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """`by, n, p<percent>...` from summaries, whose other columns (a day, a part) are merged away."""
    every = found.select(*by, F.explode(F.transform("points", lambda x, i: F.struct(x["value"].alias("value"), (x["rank"] - F.coalesce(F.get("points", i - 1)["rank"], F.lit(0))).alias("w")))).alias("x")).select(*by, "x.value", "x.w")
    same = every.groupBy(*by, "value").agg(F.sum("w").alias("w"))
    part = Window.partitionBy(*by)
    upto = same.withColumn("_upto", F.sum("w").over(part.orderBy("value"))).withColumn("n", F.sum("w").over(part))
    return upto.groupBy(*by, "n").agg(*[F.min(F.when(F.col("_upto") >= _rank(p, F.col("n")), F.col("value"))).alias(f"p{p}") for p in percents])
