"""Queries of the statistical oracle and of extents, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.operators import intervals, variance
from plainsift.shared import table

FEATURES = ("quantity", "discount", "tax", "linestatus", "shipyear")
CHANNELS = {"quantity": "numbers", "discount": "numbers", "tax": "numbers", "linestatus": "states"}


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # tells lines apart: order and line number alone don't


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every line (a repeat of its supplier, the group) the features, as a long table."""
    money = lambda c: F.col(c).cast("decimal(12,2)").cast("string")
    features = {"quantity": money("l_quantity"), "discount": money("l_discount"), "tax": money("l_tax"), "linestatus": F.col("l_linestatus"), "shipyear": F.year("l_shipdate").cast("string")}
    wide = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("group"), F.struct(*LINE).alias("repeat"), *[c.alias(f) for f, c in features.items()])
    return wide.unpivot(["group", "repeat"], list(FEATURES), "feature_id", "value")


def variance_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features vary within suppliers, and which separate them, over every line."""
    return variance.decompose(_lines(spark, sf_dir))


def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that vary over all lines, taken as the repeats of one input."""
    n = table(spark, sf_dir, "lineitem").select(F.count_distinct(F.struct(*LINE))).first()[0]
    return variance.noise_floor(_lines(spark, sf_dir), n, True)


def a1_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict over all features of every line, with the leaking ones."""
    return variance.verdict(variance.decompose(_lines(spark, sf_dir))).select("verdict", "reason", F.array_join("leaks", ",").alias("leaks"))


def leak_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each supplier's first line, per feature; every line is compared for it."""
    return variance.evidence(_lines(spark, sf_dir))


def leaks_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features per channel that separate suppliers, over every line."""
    channels = spark.createDataFrame(list(CHANNELS.items()), "feature_id string, channel string")
    found = variance.decompose(_lines(spark, sf_dir)).withColumn("leak", F.col("n_between") > 1)
    return variance.leaks_by_channel(found, channels)


def disagreeing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the texts of one kind and language and about one length differ."""
    cohort = F.concat_ws("/", "doc_kind", "lang", F.expr("n_chars div 4"))
    docs = table(spark, sf_dir, "documents").select("doc_id", cohort.alias("cohort"), "text")
    return variance.disagreeing_runs(docs, "cohort", "doc_id", "text")


def common_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many substrings of 12 characters all documents of a cohort share, and the least of them: of one kind and language and
    about one length, over whole texts."""
    cohort = F.concat_ws("/", "doc_kind", "lang", F.expr("n_chars div 4"))
    found = variance.cohort_grams(table(spark, sf_dir, "documents").select(cohort.alias("cohort"), "text"), "cohort", "text", 12)
    return found.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.min("gram").alias("least"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as extents of seconds: from their time, as long as their value."""
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return table(spark, sf_dir, "events").select("user_id", "event_id", start.alias("start"), (start + F.ceil(F.col("value") * 60)).alias("end"))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of a user's days, from the first to the last, that no event covers."""
    spans = _spans(spark, sf_dir)
    day = lambda c: F.floor(c / 86400) * 86400
    days = spans.groupBy("user_id").agg(day(F.min("start")).alias("low"), (day(F.max("start")) + 86400).alias("high"))
    return intervals.gaps(spans, "user_id", days)


def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covered times of each user."""
    return intervals.merged(_spans(spark, sf_dir), "user_id")


def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that begin before an earlier one of their user ends."""
    return intervals.overlaps(_spans(spark, sf_dir), "user_id", "event_id")


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of an order lands when the lines are laid out one after the other."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("size"))
    return intervals.running_offsets(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "size", 8).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "new_offset")


def fragments_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the line numbers of each order are complete."""
    return intervals.completeness(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    return intervals.first_seen(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


QUERIES = {f.__name__: f for f in (variance_decompose, noise_floor, a1_verdict, leak_evidence, leaks_by_channel, disagreeing_runs, common_grams, coverage_gaps, merge_spans, interval_overlaps, running_offsets, fragments_complete, first_seen)}

_LINES = """with lines as (select cast(l_suppkey as varchar) grp, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) rep, cast(cast(l_quantity as decimal(12,2)) as varchar) quantity, cast(cast(l_discount as decimal(12,2)) as varchar) discount,
  cast(cast(l_tax as decimal(12,2)) as varchar) tax, l_linestatus linestatus, cast(year(l_shipdate) as varchar) shipyear from lineitem),
grid as (""" + " union all ".join(f"select grp, rep, '{f}' feature_id, {f} as value from lines where {f} is not null" for f in FEATURES) + """),
counts as (select feature_id, grp, value, count(*) n, min(rep) first from grid group by 1, 2, 3),
mode as (select feature_id, grp, value, count(*) over (partition by feature_id, grp) n_values from counts qualify row_number() over (partition by feature_id, grp order by n desc, first, value) = 1),
verdicts as (select feature_id, max(n_values) > 1 floor, count(distinct value) > greatest(max(n_values), 1) leak, count(distinct value) n_between, max(n_values) max_within from mode group by 1)
"""
_SPANS = "with spans as (select user_id, event_id, cast(floor(epoch(ts)) as bigint) s, cast(floor(epoch(ts)) as bigint) + cast(ceil(value * 60) as bigint) e from events), full_spans as (select * from spans where e > s)"
SQL = {
    "variance_decompose": _LINES + "select * from verdicts",
    "noise_floor": _LINES + ", n as (select count(distinct rep) n from lines) select feature_id, count(distinct value) + case when count(distinct rep) < max(n) then 1 else 0 end n_values, count(distinct value) + case when count(distinct rep) < max(n) then 1 else 0 end > 1 floor from grid, n group by 1",
    "a1_verdict": _LINES + "select case when bool_or(leak) then 'fail' else 'pass' end verdict, case when bool_or(leak) then 'variant_correlated_leak' end reason, coalesce(string_agg(feature_id, ',' order by feature_id) filter (where leak), '') leaks from verdicts",
    "leak_evidence": _LINES + "select feature_id, string_agg(grp || '=' || lower(hex(encode(value))), '; ' order by grp) evidence from (select * from grid qualify row_number() over (partition by feature_id, grp order by rep) = 1) group by 1",
    "leaks_by_channel": _LINES + "select case feature_id " + " ".join(f"when '{f}' then '{c}'" for f, c in CHANNELS.items()) + " else 'unclassified' end channel, string_agg(feature_id, ',' order by feature_id) features from verdicts where n_between > 1 group by 1",
    "common_grams": "with d as (select concat_ws('/', doc_kind, lang, n_chars // 4) cohort, doc_id, text from documents), m as (select cohort, count(*) n from d group by 1), grams as (select distinct cohort, doc_id, substring(text, i, 12) gram from d, unnest(range(1, length(text) - 10)) t(i)), s as (select cohort, gram, count(*) k from grams group by 1, 2) select s.cohort, count(*) n, min(gram) least from s join m on m.cohort = s.cohort and k = m.n group by 1",
    "coverage_gaps": _SPANS + """, days as (select user_id, min(s) // 86400 * 86400 low, max(s) // 86400 * 86400 + 86400 high from spans group by 1),
inside as (select f.user_id, greatest(s, low) s, least(e, high) e from full_spans f join days using (user_id) where least(e, high) > greatest(s, low) union all select user_id, low, low from days union all select user_id, high, high from days)
select user_id, reach gap_start, s gap_end from (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) reach from inside) where s > reach""",
    "merge_spans": _SPANS + " select user_id, min(s) as \"start\", max(e) as \"end\", count(*) n from (select *, sum(fresh) over (partition by user_id order by s, e rows unbounded preceding) span from (select *, case when s > max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end fresh from full_spans)) group by user_id, span",
    "interval_overlaps": _SPANS + " select user_id, event_id from (select *, max(e) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding) reach from spans) where s < reach",
    "running_offsets": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 8 + coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0) new_offset from lineitem",
    "fragments_complete": "select l_orderkey, min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*) complete from lineitem group by 1",
    "first_seen": "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    "disagreeing_runs": """with docs as (select concat_ws('/', doc_kind, lang, n_chars // 4) cohort, doc_id, text t from documents where text is not null),
sizes as (select cohort, count(*) n, min(length(t)) lo, max(length(t)) hi from docs group by 1),
places as (select cohort, i - 1 at_, substring(t, i, 1) c from docs, unnest(range(1, length(t) + 1)) u(i)),
differ as (select d.cohort, at_, lo, hi from (select cohort, at_ from places group by 1, 2 having min(c) <> max(c)) d join sizes s on s.cohort = d.cohort where n > 1 and at_ < lo),
runs as (select *, at_ - row_number() over (partition by cohort order by at_) island from differ)
select cohort, 'byte@' || min(at_) || ':' || count(*) feature_id from runs where lo = hi group by cohort, island
union all select s.cohort, 'byte_tail@' || coalesce((select min(at_) from runs r where r.cohort = s.cohort), lo) from sizes s where n > 1 and lo < hi
union all select cohort, 'length_divergence' from sizes where n > 1 and lo < hi""",
}
