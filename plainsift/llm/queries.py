"""Queries of the problems on text and very large columns: 1, 4, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.llm import binpack, bpe, lookalike, selection, terms
from plainsift.operators.packed import unpack, value_code
from plainsift.plans.pipeline import ITEMS_SQL
from plainsift.shared import clean, current_rows, materialize, table

PERCENTS = (50, 90, 99)


def _format_term() -> Column:
    return F.lower(clean(F.col("format")))


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every listed field name and every format, with its mark."""
    records = current_rows(table(spark, sf_dir, "scrub_results"), "row_id", ["loaded_at"], ["row_id", "format", "removed_fields"])
    records = materialize(records, "term-records")
    listed = unpack(records, "row_id", ["removed_fields"], value_code(records, ["removed_fields"])).select("field_name", F.col("item").alias("term"), "row_id")
    formats = records.select(F.lit("format").alias("field_name"), _format_term().alias("term"), "row_id")
    return terms.term_table(listed.unionByName(formats), records.count(), "field_name", "term", "row_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that are too rare or too common to be useful."""
    return p1_terms(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p1_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked frequencies of the formats alone."""
    records = current_rows(table(spark, sf_dir, "scrub_results"), "row_id", ["loaded_at"], ["row_id", "format"])
    pairs = materialize(records.select(F.lit("format").alias("field_name"), _format_term().alias("term"), "row_id"), "format-pairs")
    return terms.term_table(pairs, pairs.count(), "field_name", "term", "row_id")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`format, day, metric, value`: the known sizes of every record, once."""
    records = current_rows(table(spark, sf_dir, "scrub_results"), "row_id", ["loaded_at"], ["row_id", "format", "written_at", "bytes_before", "bytes_after"])
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("bytes_before", "bytes_after")]))
    rows = records.select(F.coalesce(_format_term(), F.lit("")).alias("format"), F.to_date("written_at").alias("day"), metrics.alias("m"))
    return materialize(rows.select("format", "day", "m.metric", "m.value").where("value >= 0"), "sizes")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 90th and 99th percentile of both sizes, per format and per format and day; a format that is null or blank is ''."""
    days = _sizes(spark, sf_dir).select(F.lit("day").alias("scope"), "format", "day", "metric", "value")
    whole = days.withColumns({"scope": F.lit("all"), "day": F.lit(None).cast("date")})
    return selection.percentiles(days.unionByName(whole), ["scope", "format", "day", "metric"], "value", PERCENTS)


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.summaries(_sizes(spark, sf_dir), ["format", "day", "metric"], "value")


def p4_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every format and day, the summary that can be merged with those of other days: a row per kept rank."""
    return _summaries(spark, sf_dir).select("format", "day", "metric", "part", "n", F.explode("points").alias("x")).select("format", "day", "metric", "part", "n", "x.rank", "x.value")


def p4_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of every format, from the summaries of its days."""
    return selection.merged(_summaries(spark, sf_dir), ["format", "metric"], PERCENTS)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k, without special tokens."""
    return bpe.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in containers of each kind of bundle. The kinds are a short list by their nature."""
    kinds = [(r["bundle_kind"], r["capacity"]) for r in table(spark, sf_dir, "bundles").orderBy("capacity", "bundle_kind").collect()]
    return binpack.pack(bpe.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens", kinds)


def p8_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of bundle, the number of containers and the share of their space that is used."""
    kinds = table(spark, sf_dir, "bundles").select("bundle_kind", "capacity")
    used = p8_containers(spark, sf_dir).groupBy("bundle_kind", "container_id").agg(F.sum("size").alias("size"))
    per_kind = used.groupBy("bundle_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("size").alias("tokens"))
    return per_kind.join(kinds, "bundle_kind").select("bundle_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used_share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents that look the same and differ in their characters."""
    return lookalike.pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document that looks like a differently written one, the canonical member of its class."""
    return lookalike.members(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "class_id")


def p9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every class of texts that look the same, its different texts by their least document, and the copies of each."""
    return lookalike.links(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p1_formats, p4_percentiles, p4_summaries, p4_merged, p7_ids, p8_containers, p8_use, p9_found, p9_forms, p9_links)}

_RECORDS = "records as (select row_id, lower(trim(format, ' \t\n\r')) format, cast(written_at as date) as day, bytes_before, bytes_after from scrub_results qualify row_number() over (partition by row_id order by loaded_at desc nulls last) = 1)"


def _percentile_sql(by: str) -> str:
    picked = ", ".join(f"max(value) filter (where rn = greatest(1, ({p} * n + 99) // 100)) p{p}" for p in PERCENTS)
    return f"select {by}, metric, n, {picked} from (select *, row_number() over (partition by {by}, metric order by value) rn, count(*) over (partition by {by}, metric) n from sizes) group by {by}, metric, n"


_TERMS = (
    f"with {ITEMS_SQL}, pairs as (select field_name, item term, row_id from items where field_name = 'removed_fields' union all select 'format', lower(trim(format, ' ' || chr(9) || chr(10) || chr(13))), row_id from latest), "
    "counts as (select field_name, term, count(*) occurrences, count(distinct row_id) records from pairs where term <> '' group by 1, 2), "
    "marked as (select *, case when records <= 2 then 'rare' when records > 0.1 * (select count(*) from latest) then 'common' end mark from counts) "
)


def _looks_sql() -> str:
    """One form of every text in SQL: composed, mapped character by character, composed again. What has no composed form
    after mapping would be missed; the operator decomposes first and has no such gap."""
    import sys
    import unicodedata

    simple, unseen = lookalike.tables()
    to = dict(simple)
    for c in map(chr, range(0xC0, min(sys.maxunicode, 0x2000))):
        full = unicodedata.normalize("NFD", c)
        if len(full) > 1 and full[0] in to and len(form := unicodedata.normalize("NFC", to[full[0]] + full[1:])) == 1:
            to[c] = form
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    mapped = lambda col, t: f"translate({col}, {quoted(''.join(t) + ''.join(c for c in unseen if c > ' '))}, {quoted(''.join(t.values()))})"
    return (
        f"with f as (select doc_id, text, nfc_normalize({mapped('nfc_normalize(text)', to)}) form from documents where text is not null), v as (select * from f where regexp_matches(form, '[^\\s]')), "
        "r as (select form, text, min(doc_id) rep, count(*) n_rows from v group by 1, 2), many as (select form from r group by 1 having count(*) > 1), "
        f"c as (select form, coalesce(min(rep) filter (where text = {mapped('text', simple)}), min(rep)) class_id from r semi join many using (form) group by 1) "
    )


_LOOKS = _looks_sql()
_SIZES = f"with {_RECORDS}, sizes as (select coalesce(format, '') format, day, 'bytes_before' metric, bytes_before as value from records where bytes_before >= 0 union all select coalesce(format, ''), day, 'bytes_after', bytes_after from records where bytes_after >= 0)"
#: Of groups of at most one part, as all are at the scales of the tables.
_SUMMARIES = (
    _SIZES + ", ranked as (select *, row_number() over (partition by format, day, metric order by value) as rank, count(*) over (partition by format, day, metric) n from sizes), "
    f"points as (select format, day, metric, 0 part, n, rank, value from ranked where n <= {selection.POINTS} or rank = 1 or floor(rank * {selection.POINTS} / n) > floor((rank - 1) * {selection.POINTS} / n))"
)
SQL = {
    "p4_summaries": _SUMMARIES + " select * from points",
    "p4_merged": _SUMMARIES + ", weighed as (select format, metric, value, rank - lag(rank, 1, 0) over (partition by format, day, metric order by rank) w from points), same as (select format, metric, value, sum(w) w from weighed group by 1, 2, 3), "
    "upto as (select *, sum(w) over (partition by format, metric order by value) u, sum(w) over (partition by format, metric) n from same) select format, metric, cast(n as bigint) n, "
    + ", ".join(f"min(value) filter (where u >= greatest(1, ({p} * n + 99) // 100)) p{p}" for p in PERCENTS) + " from upto group by 1, 2, n",
    "p9_found": _LOOKS + "select a.doc_id doc_id_a, b.doc_id doc_id_b from v a join v b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text",
    "p9_forms": _LOOKS + "select doc_id, class_id from v join c using (form)",
    "p9_links": _LOOKS + "select class_id, rep, n_rows from r join c using (form)",
    "p1_terms": _TERMS + "select * from marked",
    "p1_found": _TERMS + "select field_name, term, mark from marked where mark is not null",
    "p1_formats": f"with {_RECORDS}, counts as (select 'format' field_name, format term, count(*) occurrences, count(distinct row_id) records from records where format <> '' group by 2) "
    "select *, case when records <= 2 then 'rare' when records > 0.1 * (select count(*) from records) then 'common' end mark from counts",
    "p4_percentiles": _SIZES + ", "
    f"w as ({_percentile_sql('format')}), d as ({_percentile_sql('format, day')}) select 'all' scope, format, cast(null as date) as day, metric, n, p50, p90, p99 from w union all select 'day', format, day, metric, n, p50, p90, p99 from d",
}
