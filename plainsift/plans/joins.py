"""Join-shaped queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.operators import matching
from plainsift.shared import current_rows, table

LOCI = ("adversary", "fidelity", "verdict", "reason", "repeats", "deterministic")


def _described(spark: SparkSession, sf_dir: str, copy: str) -> DataFrame:
    """One copy of the cells as described fields; a null is a field that is absent."""
    rows = current_rows(table(spark, sf_dir, f"cells_{copy}"), "cell_id", ["loaded_at"], ["cell_id", *LOCI])
    return rows.select(F.col("cell_id").alias("file_id"), *[F.col(c).cast("string").alias(c) for c in LOCI]).unpivot("file_id", list(LOCI), "locus", "value").where("value is not null")


def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields removed, changed, kept and added between the two copies of the cells."""
    return matching.field_diff(_described(spark, sf_dir, "published"), _described(spark, sf_dir, "measured"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields of each locus were removed, changed, kept and added."""
    return field_diff(spark, sf_dir).groupBy("locus").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("removed", "changed", "kept", "added")])


def evidence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published verdicts against measured ones: confirmed, different or unmeasured."""
    sides = [current_rows(table(spark, sf_dir, f"cells_{c}"), "cell_id", ["loaded_at"], ["cell_id", "verdict"]) for c in ("published", "measured")]
    return matching.evidence_diff(*sides, ["cell_id"], "verdict")


def install_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of the same number whose nation isn't the same, nulls equal."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("left_nation"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("right_nation"))
    return a.join(b, "k", "full_outer").where(~F.col("left_nation").eqNullSafe(F.col("right_nation")))


EXPECTED_GROUPS = ("Title",)
EXPECTED_TAGS = ("Line1",)


def leak_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's source, format, kind and language, the first line of its text that still holds it. The first line is
    the title, where a value is expected, as it is in the line after."""
    docs = table(spark, sf_dir, "documents")
    line = F.transform(F.split("text", "\n"), lambda x, n: F.struct(F.concat(F.when(n == 0, "Title:Line").otherwise("Text:Line"), n).alias("key"), x.alias("text")))
    rows = docs.where("text is not null").select(F.col("doc_id").alias("file_id"), F.array("source", "about_format", "doc_kind", "lang").alias("values"), line.alias("tags"))
    return matching.leaks_within(rows, "file_id", "values", "tags", EXPECTED_GROUPS, EXPECTED_TAGS)


def leak_search_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values removed between the two copies of the cells, searched in what the measured copy and the notes of its files hold."""
    gone = field_diff(spark, sf_dir).where("status in ('removed', 'changed')").select("file_id", F.col("before").alias("value"))
    kept = _described(spark, sf_dir, "measured").select("file_id", F.col("locus").alias("seq"), F.concat(F.lit("Cell:"), F.col("locus")).alias("key"), F.col("value").alias("text"))
    return matching.leak_search(gone, kept, expected_tags=["reason"])


def planted_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many leaks are left per value."""
    return leak_search(spark, sf_dir).where("not expected").groupBy("value").agg(F.count(F.lit(1)).alias("n_files"))


SIGNATURES = [(1, "suffix", ".jpg", "jpeg"), (2, "suffix", ".m4a", "m4a"), (3, "suffix", ".mp4", "mp4"), (4, "suffix", ".docx", "docx"), (5, "suffix", ".xlsx", "xlsx"), (6, "suffix", ".pdf", "pdf"), (7, "prefix", "exports/", "export"), (8, "contains", "/", "nested"), (9, "regexp", "^[a-z_0-9]+\\.[a-z0-9]+$", "plain")]


def dispatch_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first signature that matches each path of the results sheet."""
    rows = table(spark, sf_dir, "scrub_results").select("row_id", "loaded_at", "path")
    return matching.first_match(rows, "row_id", "path", SIGNATURES, "unknown")


def asof_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sign-up of the user at or before each purchase."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    return matching.as_of(left, right, "user_id", "ts", "event_id").select("event_id", F.col("asof").alias("signup_id"))


PRICE_BANDS = [(0.0, 1000.0, "low"), (1000.0, 50000.0, "middle"), (30000.0, 200000.0, "upper"), (150000.0, 1e12, "top")]


def range_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price band of each order; of overlapping bands the one that starts last."""
    return matching.in_interval(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", PRICE_BANDS).select("o_orderkey", "label")


BOXES = [(0, -0.2, 0.0, -0.2, 0.2), (100, 0.0, 0.1, 0.0, 0.3), (200, -0.1, 0.3, -0.3, -0.05)]


def text_under_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points covered by a box painted after them: the first two coordinates of a vector, its id being its order."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    inside = [F.when((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1) & (F.col("vec_id") < seq), seq) for seq, x0, x1, y0, y1 in BOXES]
    return points.select("vec_id", F.explode(F.array_compact(F.array(*inside))).alias("box"))


def semi_used_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that some line uses."""
    return table(spark, sf_dir, "part").select("p_partkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


def unused_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of more than 300,000."""
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose tree is not listed as one that may be written to."""
    trees = table(spark, sf_dir, "source_trees").where("not read_only").select("tree_id")
    return table(spark, sf_dir, "scrub_results").select("row_id", "tree_id").join(trees, "tree_id", "left_anti").select("row_id")


def reachable_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts reached from part 1 along number, half number, with large parts as barriers."""
    parts = table(spark, sf_dir, "part")
    edges = parts.where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    return matching.closure(edges, parts.where("p_partkey = 1").select(F.col("p_partkey").alias("node")), parts.where("p_size > 45").select(F.col("p_partkey").alias("node")))


def connected_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least node of each component of suppliers, nations and regions, suppliers offset by 1000."""
    edges = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("src"), (F.col("s_nationkey") + 100).cast("bigint").alias("dst"))
    edges = edges.union(table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("bigint"), F.col("n_regionkey").cast("bigint")))
    return matching.components(edges)


def positional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers matched by position, and whether their balances have the same sign; a position that one side lacks
    is a mismatch and has no answer."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_acctbal") >= 0).alias("a"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), (F.col("s_acctbal") >= 0).alias("b"))
    return a.join(b, "pos", "full_outer").select("pos", (F.col("a") == F.col("b")).alias("same"), (F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"))


EXIT_CODES = {"cleaned": 0, "kept as text": 0, "kept unscrubbed": 0, "skipped": 8, "dropped": 0, "not supported": 3, "refused": 4, "error": 1}


def exit_code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit code of each record's outcome, and 9 for an unknown one."""
    codes = spark.createDataFrame(list(EXIT_CODES.items()), "outcome string, code int")
    rows = table(spark, sf_dir, "scrub_results").select("row_id", "loaded_at", "outcome")
    return rows.join(F.broadcast(codes), "outcome", "left").select("row_id", "loaded_at", F.coalesce("code", F.lit(9)).alias("code"))


QUERIES = {
    f.__name__: f
    for f in (field_diff, status_counts, evidence_diff, install_diff, leak_search, leak_search_tables, planted_left, dispatch_first_match, asof_runs, range_annotate, text_under_box, semi_used_parts, unused_customers, orphan_lines, reachable_parts, connected_nations, positional_match, exit_code_lookup)
}

_LATEST = "(select * from cells_{0} qualify row_number() over (partition by cell_id order by loaded_at desc nulls last) = 1)"
_EAV = "{0} as (" + " union all ".join(f"select cell_id file_id, '{c}' locus, cast({c} as varchar) as value from {_LATEST.format('{0}')} where {c} is not null" for c in LOCI) + ")"
_DIFF = f"""with {_EAV.format('published')}, {_EAV.format('measured')}, diff as (select coalesce(p.file_id, m.file_id) file_id, coalesce(p.locus, m.locus) locus,
  case when m.file_id is null then 'removed' when p.file_id is null then 'added' when p.value is not distinct from m.value then 'kept' else 'changed' end status, p.value before, m.value after
  from published p full join measured m on p.file_id = m.file_id and p.locus = m.locus)
"""
_LEAKS = """with vals as (select distinct file_id, trim(value) as value from (select doc_id file_id, unnest([source, about_format, doc_kind, lang]) as value from documents) where length(trim(value)) >= 5 and not starts_with(trim(value), '(')),
tags as (select doc_id file_id, i - 1 seq, case when i = 1 then 'Title:Line0' else 'Text:Line' || (i - 1) end as key, lines[i] txt from (select doc_id, string_split(text, chr(10)) lines from documents where text is not null), unnest(range(1, len(lines) + 1)) u(i)),
leaks as (select v.file_id, value, arg_min(key, seq) as key, min(seq) <= 1 expected from vals v join tags t on t.file_id = v.file_id where contains(lower(key || ' ' || txt), lower(value)) group by 1, 2)
"""
SQL = {
    "field_diff": _DIFF + "select * from diff",
    "status_counts": _DIFF + "select locus, " + ", ".join(f"count(*) filter (where status = '{s}') {s}" for s in ("removed", "changed", "kept", "added")) + " from diff group by 1",
    "evidence_diff": f"select p.cell_id, p.verdict published, m.verdict measured, case when m.verdict is null or (m.verdict = 'not_tested' and p.verdict is not null and p.verdict <> 'not_tested') then 'unmeasured' when p.verdict is not distinct from m.verdict then 'confirmed' else 'difference' end status from {_LATEST.format('published')} p left join {_LATEST.format('measured')} m on p.cell_id = m.cell_id",
    "install_diff": "select coalesce(c_custkey, s_suppkey) k, c_nationkey left_nation, s_nationkey right_nation from customer full join supplier on c_custkey = s_suppkey where c_nationkey is distinct from s_nationkey",
    "leak_search": _LEAKS + "select * from leaks",
    "leak_search_tables": _DIFF + ", vals as (select distinct file_id, trim(before) as value from diff where status in ('removed', 'changed') and length(trim(before)) >= 5 and not starts_with(trim(before), '(')), hits as (select v.file_id, v.value, m.locus from vals v join measured m on m.file_id = v.file_id where contains(lower('Cell:' || m.locus || ' ' || m.value), lower(v.value))) select file_id, value, 'Cell:' || min(locus) as key, min(locus) = 'reason' expected from hits group by 1, 2",
    "planted_left": _LEAKS + "select value, count(*) n_files from leaks where not expected group by 1",
    "dispatch_first_match": "select row_id, loaded_at, path, case when path like '%.jpg' then 'jpeg' when path like '%.m4a' then 'm4a' when path like '%.mp4' then 'mp4' when path like '%.docx' then 'docx' when path like '%.xlsx' then 'xlsx' when path like '%.pdf' then 'pdf' when path like 'exports/%' then 'export' when path like '%/%' then 'nested' when regexp_matches(path, '^[a-z_0-9]+\\.[a-z0-9]+$') then 'plain' else 'unknown' end matched from scrub_results",
    "asof_runs": "select p.event_id, max_by(s.event_id, (s.ts, s.event_id)) signup_id from (select * from events where event_type = 'purchase') p left join (select * from events where event_type = 'signup') s on p.user_id = s.user_id and s.ts <= p.ts group by 1",
    "range_annotate": "select o_orderkey, case when o_totalprice >= 150000 and o_totalprice < 1e12 then 'top' when o_totalprice >= 30000 and o_totalprice < 200000 then 'upper' when o_totalprice >= 1000 and o_totalprice < 50000 then 'middle' when o_totalprice >= 0 and o_totalprice < 1000 then 'low' end label from orders",
    "text_under_box": "with p as (select vec_id, cast(embedding[1] as double) x, cast(embedding[2] as double) y from embeddings), b(seq, x0, x1, y0, y1) as (values " + ", ".join(f"({s}, {a}::double, {b}::double, {c}::double, {d}::double)" for s, a, b, c, d in BOXES) + ") select vec_id, seq box from p join b on x between x0 and x1 and y between y0 and y1 and vec_id < seq",
    "semi_used_parts": "select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey)",
    "unused_customers": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "orphan_lines": "select row_id from scrub_results r where not exists (select 1 from source_trees t where t.tree_id = r.tree_id and not t.read_only)",
    "reachable_parts": "with recursive r(node, depth) as (select p_partkey, 0 from part where p_partkey = 1 union all select p_partkey, depth + 1 from r join part on p_partkey // 2 = node and p_partkey > 1 where p_size <= 45) select node, depth from r",
    "connected_nations": "select s_suppkey + 1000 node, cast(n_regionkey as bigint) component from supplier join nation on s_nationkey = n_nationkey union all select n_nationkey + 100, n_regionkey from nation union all select distinct n_regionkey, n_regionkey from nation",
    "positional_match": "select coalesce(c_custkey, s_suppkey) pos, (c_acctbal >= 0) = (s_acctbal >= 0) same, c_custkey is null or s_suppkey is null unmatched from customer full join supplier on c_custkey = s_suppkey",
    "exit_code_lookup": "select row_id, loaded_at, case outcome " + " ".join(f"when '{k}' then {v}" for k, v in EXIT_CODES.items()) + " else 9 end code from scrub_results",
}
