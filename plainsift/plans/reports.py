"""Reporting queries over the test tables, which stand in for test runs, censuses and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.functions import text
from plainsift.operators import matching, reporting
from plainsift.operators.folder import WRITTEN
from plainsift.shared import clean, current_rows, table

OUTCOMES = ("cleaned", "kept as text", "kept unscrubbed", "not supported", "refused", "dropped", "skipped", "error")
LEGS = ("click", "view", "purchase")
SLOW_AT = 20.0


def _records(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "scrub_results"), "row_id", ["loaded_at"], ["row_id", *cols])


def results_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file, in the order of paths, with its format in plain spelling and its sizes told."""
    rows = _records(spark, sf_dir, "path", "outcome", "format", "bytes_before", "removed")
    return rows.select("row_id", "path", "outcome", F.lower(clean(F.col("format"))).alias("format"), text.human_size(F.when(F.col("bytes_before") >= 0, F.col("bytes_before"))).alias("size"), "removed").orderBy("path", "row_id")


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of files of each outcome, and in all."""
    return _records(spark, sf_dir, "outcome").rollup("outcome").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("outcome", F.lit("all")).alias("outcome"), "n")


def run_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each tree's run is complete: every file but sidecars was written, so a refusal or an unsupported type counts."""
    rows = _records(spark, sf_dir, "tree_id", "outcome")
    return rows.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_files"), F.bool_and(F.coalesce(F.col("outcome").isin(*WRITTEN, "dropped"), F.lit(False))).alias("complete"))


def modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent order priority of each customer."""
    return reporting.census(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return flags that every line number of a supplier has."""
    return reporting.consistent(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", "l_returnflag")


def object_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events all but one are superseded; a user without a purchase is orphaned."""
    events = table(spark, sf_dir, "events")
    return reporting.ledger(events.select("user_id"), "user_id", events.where("event_type = 'purchase'").select("user_id"))


def tag_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per locus, how many cells have it in either copy, and whether it is gone from the measured one."""
    counts = []
    for copy in ("published", "measured"):
        rows = current_rows(table(spark, sf_dir, f"cells_{copy}"), "cell_id", ["loaded_at"], ["cell_id", "adversary", "reason", "verdict"])
        counts.append(rows.unpivot("cell_id", ["adversary", "reason", "verdict"], "locus", "value").where("value is not null").groupBy("locus").agg(F.count(F.lit(1)).alias(f"n_{copy}")))
    both = counts[0].join(counts[1], "locus", "full_outer")
    state = F.when(F.coalesce("n_measured", F.lit(0)) == 0, "gone").when(F.coalesce("n_published", F.lit(0)) == 0, "new").otherwise("remaining")
    return both.withColumn("state", state)


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files, lines sold with a return flag R as covered statements."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30)).alias("covered"))
    return reporting.coverage(lines, F.col("covered"), F.col("total"))


def area_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: area by the first pattern of the priority that holds, leg by status."""
    area = F.when(F.contains("o_orderpriority", F.lit("URGENT")), "hot").when(F.contains("o_orderpriority", F.lit("HIGH")), "warm").when(F.contains("o_orderpriority", F.lit("E")), "cool").otherwise("cold")
    cases = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_totalprice") > 250000, "fail").otherwise("pass")).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return reporting.area_grid(cases, area, "o_orderstatus", ["F", "O", "P"], "status", "cents").withColumn("seconds", F.col("seconds").cast("bigint"))


def slowest_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten customers with the greatest order, and its status."""
    return reporting.slowest(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderstatus")


def unique_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an error, once, with the legs they were also seen on."""
    events = table(spark, sf_dir, "events")
    failed = events.where("event_type = 'error'").select("user_id").distinct()
    return events.join(failed, "user_id").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("event_type").isin(*LEGS), F.col("event_type")))), ",").alias("legs"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


def missing_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types a user was never seen on."""
    events = table(spark, sf_dir, "events")
    wanted = events.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, LEGS))).alias("leg"))
    return wanted.join(events.select("user_id", F.col("event_type").alias("leg")), ["user_id", "leg"], "left_anti")


def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons with digits folded, by frequency."""
    cells = current_rows(table(spark, sf_dir, "cells_measured"), "cell_id", ["loaded_at"], ["cell_id", "reason"])
    return cells.where("reason is not null").groupBy(text.fold_digits(F.col("reason")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent outcomes' notes; ties to the one seen first."""
    return reporting.top(_records(spark, sf_dir, "notes"), "notes", 12, "row_id")


def first_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three formats of each tree, and how many more."""
    return reporting.first_n(_records(spark, sf_dir, "tree_id", "format").withColumn("format", F.lower(clean(F.col("format")))), "tree_id", "format", 3)


def shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in more than one supplier's lines, with the number of suppliers."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_suppliers")).where("n_suppliers > 1")


def fuzz_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: the refused classes added up from the maps of single events."""
    events = table(spark, sf_dir, "events").select("user_id", F.create_map("event_type", F.from_json("props", "k bigint")["k"]).alias("m"))
    return reporting.merge_maps(events, "user_id", "m")


def sweep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per format: files, cleaned, refused and the range of their sizes."""
    rows = _records(spark, sf_dir, "format", "outcome", "bytes_before").withColumn("format", F.coalesce(F.lower(clean(F.col("format"))), F.lit("")))
    size = F.when(F.col("bytes_before") >= 0, F.col("bytes_before"))
    return rows.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "cleaned").alias("cleaned"), F.count_if(F.col("outcome") == "refused").alias("refused"), F.min(size).alias("least"), F.max(size).alias("most"))


def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each family of identifiers occurs in the texts of a kind."""
    families = {"level": r"F[123]\b", "adversary": r"\bA[123]\b", "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}"}
    counts = table(spark, sf_dir, "documents").where("text is not null").select("doc_kind", *[F.regexp_count("text", F.lit(p)).alias(n) for n, p in families.items()])
    return counts.unpivot("doc_kind", list(families), "family", "n").groupBy("doc_kind", "family").agg(F.sum("n").alias("n"))


def capability_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per format, the levels at which a cell passed against each adversary."""
    cells = current_rows(table(spark, sf_dir, "cells_published"), "cell_id", ["loaded_at"], ["cell_id", "format", "adversary", "fidelity", "verdict"])
    plain = cells.select("format", F.upper(clean(F.col("adversary"))).alias("a"), F.upper(clean(F.col("fidelity"))).alias("f"), F.lower(clean(F.col("verdict"))).alias("v"))
    return plain.groupBy("format").pivot("a", ["A1", "A2", "A3"]).agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("v") == "pass", F.col("f")))), ","))


def run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the run may pass: no error, and every handler's format seen."""
    rows = _records(spark, sf_dir, "format", "outcome").withColumn("format", F.lower(clean(F.col("format"))))
    missing = table(spark, sf_dir, "handlers").select("format").join(rows.select("format"), "format", "left_anti")
    marks = rows.select((F.col("outcome") == "error").cast("int").alias("failed"), F.lit(0).alias("missing")).unionByName(missing.select(F.lit(0).alias("failed"), F.lit(1).alias("missing")))
    told = marks.agg(F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    return told.select("failed", "missing", ((F.col("failed") == 0) & (F.col("missing") == 0)).alias("ok"))


def memory_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files fit: their size times the factor of their format's family, against 1 GB for each of 4 workers."""
    factors = spark.createDataFrame([("image", 4.0), ("page", 6.2), ("office", 5.6), ("audio", 4.0), ("video", 1.0)], "family string, factor double")
    handlers = table(spark, sf_dir, "handlers").join(factors, "family", "left").select("format", F.coalesce("factor", F.lit(5.0)).alias("factor"))
    rows = _records(spark, sf_dir, "format", "bytes_before").withColumn("format", F.lower(clean(F.col("format"))))
    return rows.join(handlers, "format").where("bytes_before >= 0").select("row_id", (F.col("bytes_before") * F.col("factor") <= 1e9 / 4).alias("fits"))


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as nested containers: the number of things within each, at each depth."""
    edges = table(spark, sf_dir, "nation").select((F.col("n_regionkey").cast("bigint")).alias("src"), (F.col("n_nationkey") + 100).cast("bigint").alias("dst"))
    edges = edges.union(table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 100).cast("bigint"), F.col("c_custkey") + 1000))
    return matching.closure(edges, table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("node"))).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (results_sheet, outcome_counts, run_complete, modal_value, set_intersection, object_ledger, tag_groups, coverage_gate, area_buckets, slowest_ten, unique_failures, missing_legs, reason_histogram, top_reasons, first_formats, shared_parts, fuzz_merge, sweep_stats, family_counts, capability_rows, run_gate, memory_preflight, containment)
}

_R = "with r as (select * exclude (format), lower(trim(format, ' \t\n\r')) format from scrub_results qualify row_number() over (partition by row_id order by loaded_at desc nulls last) = 1)\n"
_CELLS = "(select * from cells_{} qualify row_number() over (partition by cell_id order by loaded_at desc nulls last) = 1)"
_SIZE = "case when bytes_before < 1024 then bytes_before || ' B' when bytes_before < 1048576 then cast(round(bytes_before / 1024, 1) as decimal(20,1)) || ' KB' else cast(round(bytes_before / 1048576, 1) as decimal(20,1)) || ' MB' end"
SQL = {
    "results_sheet": _R + f"select row_id, path, outcome, format, case when bytes_before >= 0 then {_SIZE} end size, removed from r",
    "outcome_counts": _R + "select coalesce(outcome, 'all') outcome, count(*) n from r group by rollup(outcome)",
    "run_complete": _R + "select tree_id, count(*) n_files, count(*) filter (where outcome in ('cleaned', 'kept as text', 'kept unscrubbed', 'dropped')) = count(*) complete from r group by 1",
    "modal_value": "with c as (select o_custkey, o_orderpriority v, count(*) n from orders group by 1, 2) select o_custkey, v || case when k > 0 then ' +' || k || ' more' else '' end modal from (select *, count(*) over (partition by o_custkey) - 1 k from c qualify row_number() over (partition by o_custkey order by n desc, v) = 1)",
    "set_intersection": "with h as (select distinct l_suppkey, l_linenumber, l_returnflag from lineitem), m as (select l_suppkey, count(distinct l_linenumber) n from h group by 1), s as (select l_suppkey, l_returnflag, count(*) k from h group by 1, 2) select m.l_suppkey, coalesce(string_agg(l_returnflag, ',' order by l_returnflag) filter (where k = n), 'varies') outcome from m join s on s.l_suppkey = m.l_suppkey group by 1",
    "object_ledger": "select user_id, count(*) - 1 superseded, not bool_or(event_type = 'purchase') orphaned from events group by 1",
    "tag_groups": "select *, case when n_measured = 0 then 'gone' when n_published = 0 then 'new' else 'remaining' end state from (select unnest(['adversary', 'reason', 'verdict']) locus, unnest([count(adversary), count(reason), count(verdict)]) n_published from " + _CELLS.format("published") + ") join (select unnest(['adversary', 'reason', 'verdict']) locus, unnest([count(adversary), count(reason), count(verdict)]) n_measured from " + _CELLS.format("measured") + ") using (locus)",
    "coverage_gate": "with f as (select l_partkey, count(*) t, count(*) filter (where l_returnflag = 'R' and l_quantity > 30) c from lineitem group by 1) select round(100 * cast(sum(c) filter (where c > 0) as double) / (sum(t) filter (where c > 0)), 2) gated_percent, round(100 * cast(sum(c) as double) / sum(t), 2) overall_percent, count(*) filter (where c = 0) untouched from f",
    "area_buckets": "with c as (select *, case when contains(o_orderpriority, 'URGENT') then 'hot' when contains(o_orderpriority, 'HIGH') then 'warm' when contains(o_orderpriority, 'E') then 'cool' else 'cold' end a, case when o_totalprice > 250000 then 'fail' else 'pass' end s from orders) select case when grouping(a) = 1 then 'all' else a end area, "
    + ", ".join(f"count(*) filter (where o_orderstatus = '{x}' and s = '{s}') \"{x}_{s}\"" for x in "FOP" for s in ("pass", "fail"))
    + ", cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as seconds from c group by rollup(a)",
    "slowest_ten": "select o_custkey, max(o_totalprice) o_totalprice, max_by(o_orderstatus, (o_totalprice, o_orderstatus)) o_orderstatus from orders group by 1 order by 2 desc, 1 limit 10",
    "unique_failures": "select user_id, coalesce(string_agg(distinct event_type, ',' order by event_type) filter (where event_type in ('click', 'view', 'purchase')), '') legs, count(*) filter (where event_type = 'error') n_errors from events group by 1 having count(*) filter (where event_type = 'error') > 0",
    "missing_legs": "select u.user_id, leg from (select distinct user_id from events) u, unnest(['click', 'view', 'purchase']) t(leg) where not exists (select 1 from events e where e.user_id = u.user_id and event_type = leg)",
    "reason_histogram": "select regexp_replace(reason, '[0-9]+', '#', 'g') as rule, count(*) n from " + _CELLS.format("measured") + " where reason is not null group by 1",
    "top_reasons": _R + "select notes, count(*) n from r where notes is not null group by 1 order by 2 desc, min(row_id), 1 limit 12",
    "first_formats": _R + "select tree_id, string_agg(format, ', ' order by format) filter (where n <= 3) || case when count(*) > 3 then ' and ' || (count(*) - 3) || ' more' else '' end shown from (select tree_id, format, row_number() over (partition by tree_id order by format) n from (select distinct tree_id, format from r where format is not null)) group by 1",
    "shared_parts": "select l_partkey, count(distinct l_suppkey) n_suppliers from lineitem group by 1 having count(distinct l_suppkey) > 1",
    "fuzz_merge": "select user_id, event_type as key, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) total from events group by 1, 2",
    "sweep_stats": _R + "select coalesce(format, '') format, count(*) n, count(*) filter (where outcome = 'cleaned') cleaned, count(*) filter (where outcome = 'refused') refused, min(case when bytes_before >= 0 then bytes_before end) least, max(case when bytes_before >= 0 then bytes_before end) most from r group by 1",
    "family_counts": "select doc_kind, family, cast(sum(len(regexp_extract_all(text, p))) as bigint) n from documents, (values ('level', 'F[123]\\b'), ('adversary', '\\bA[123]\\b'), ('date', '[0-9]{4}-[0-9]{2}-[0-9]{2}')) f(family, p) where text is not null group by 1, 2",
    "capability_rows": "with c as (select format, upper(trim(adversary, ' \t\n\r')) a, upper(trim(fidelity, ' \t\n\r')) f, lower(trim(verdict, ' \t\n\r')) v from " + _CELLS.format("published") + ") select format, " + ", ".join(f"coalesce(string_agg(distinct f, ',' order by f) filter (where v = 'pass' and a = '{a}'), case when bool_or(a = '{a}') then '' end) \"{a}\"" for a in ("A1", "A2", "A3")) + " from c group by 1",
    "run_gate": _R + "select failed, missing, failed = 0 and missing = 0 ok from (select count(*) filter (where outcome = 'error') failed from r), (select count(*) missing from handlers h where not exists (select 1 from r where r.format = h.format))",
    "memory_preflight": _R + "select row_id, bytes_before * case family when 'image' then 4.0::double when 'page' then 6.2::double when 'office' then 5.6::double when 'audio' then 4.0::double when 'video' then 1.0::double else 5.0::double end <= 250000000 fits from r join handlers h on r.format = h.format where bytes_before >= 0",
    "containment": "select 0 depth, count(*) n from region union all select 1, count(*) from nation join region on n_regionkey = r_regionkey union all select 2, count(*) from customer join nation on c_nationkey = n_nationkey",
}
