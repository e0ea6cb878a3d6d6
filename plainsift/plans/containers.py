"""Queries over containers, which are made from the test tables, and over event times."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.operators import folder, guard, variance
from plainsift.operators.cleaning import clean
from plainsift.shared import ship, table
from plainsift.sources import files, fixtures
from plainsift.sources.containers import pack_toyf
from plainsift.streaming.folder import sessions as session_counts
from plainsift.streaming.folder import windowed_counts


def _toys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a toy file: its text as the content, source and kind as records."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    number = lambda n, width: F.unhex(F.lpad(F.hex(n), width * 2, "0"))
    record = lambda kind, value: F.concat(F.lit(bytes([kind])), number(F.octet_length(value), 2), F.encode(value, "utf-8"))
    body = F.encode("text", "utf-8")
    blob = F.concat(F.lit(b"TOYF"), number(F.octet_length(body), 4), body, record(7, F.coalesce("source", F.lit(""))), record(16, F.coalesce("doc_kind", F.lit(""))))
    return docs.select("doc_id", blob.alias("content"))


def toy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each toy file, in order."""
    found = files.records(_toys(spark, sf_dir), "doc_id", "content")
    return found.select("doc_id", "seq", "kind", "offset", "length", F.sha2("payload", 256).alias("digest"))


def toy_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of toy files without their records, rebuilt from the parts."""
    found = files.records(_toys(spark, sf_dir), "doc_id", "content")
    return files.rebuilt(found, "doc_id", F.col("kind") == "content").select("doc_id", F.sha2("content", 256).alias("digest"))


def _made(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.lit(only) if only else F.element_at(F.array(*map(F.lit, fixtures.KINDS)), (F.pmod("doc_id", F.lit(len(fixtures.KINDS))) + 1).cast("int"))
    return fixtures.made(docs.select("doc_id", kind.alias("kind"), F.concat_ws("/", "source", "doc_kind", F.lit("note")).alias("note")), "doc_id", "kind", "note")


def png_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a picture made for every document."""
    return files.records(_made(spark, sf_dir, "png"), "doc_id", "content").select("doc_id", "seq", "kind", "offset", "length")


def cleaned_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of cleaning a file made for every document, of a kind by its number."""
    made = _made(spark, sf_dir).withColumn("relative", F.concat(F.col("doc_id"), F.lit("."), F.col("kind")))
    return folder.clean_files(made).select("path", "outcome", "format", "removed", "notes")


def cleaned_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether cleaning a cleaned file changes nothing, per kind."""
    made = _made(spark, sf_dir).withColumn("relative", F.concat(F.col("doc_id"), F.lit("."), F.col("kind")))
    once = folder.clean_files(made).where("outcome = 'cleaned' and format is not null").select("path", "format", "cleaned")
    again = folder.clean_files(once.select("path", "cleaned"), "path", "cleaned").select("path", F.col("cleaned").alias("again"))
    return once.join(again, "path").groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("cleaned") == F.col("again")).alias("stable"))


STUBS = {"clean": lambda b: clean("toyf", b), "leaky": lambda b: b, "version": lambda b: clean("toyf", b) + b"\x63\0\5tag-1", "noisy": None}


def harness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toy cleaners held against a toy file of every customer: the name is the record that must go, the segment is the group,
    and the customers of a segment are its repeats. What leaks or is noisy, by the decomposition over the bytes that differ."""
    toys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repeat"), F.col("c_mktsegment").alias("group"))
    names = list(STUBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repeat, group in zip(batch.column("repeat").to_pylist(), batch.column("group").to_pylist(), strict=True):
                blob = pack_toyf(b"the same content", [(7, (group or "").encode())])
                for stub in names:
                    out = STUBS[stub](blob) if STUBS[stub] else clean("toyf", blob) + bytes([0x20, 0, 4]) + (repeat or 0).to_bytes(4, "big", signed=True)
                    rows.append((stub, group, repeat, out[24:].hex()))  # what follows the content, which all of them keep
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["feature_id", "group", "repeat", "value"])

    grid = toys.mapInArrow(run, "feature_id string, group string, repeat bigint, value string")
    found = variance.decompose(grid)
    # a mode is one value of many where all differ, so noise is told before leaks
    return found.select(F.col("feature_id").alias("stub"), (F.col("leak") & ~F.col("floor")).alias("leaks"), F.col("floor").alias("noisy"))


def guard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that rewrite comments, one for each region: those of odd regions leave their name behind the text. Which leave a
    mark of their own, by the runs that all outputs of a tool share and no input has."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.col("n_name"), F.lit("."))
    marked = F.when(F.col("r_regionkey") % 2 == 1, F.concat(text, F.lit("~by "), F.col("r_name"), F.lit("~"))).otherwise(text)
    trials = nations.select(F.col("r_name").alias("tool"), F.encode(text, "utf-8").alias("input"), F.encode(marked, "utf-8").alias("output"))
    return guard.tool_verdicts(trials)


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type."""
    return windowed_counts(table(spark, sf_dir, "events"), "1 hour")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per two hours, begun every hour, and type."""
    return windowed_counts(table(spark, sf_dir, "events"), "2 hours", "1 hour")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, closed after three quiet hours."""
    return session_counts(table(spark, sf_dir, "events"), "3 hours")


QUERIES = {f.__name__: f for f in (toy_records, toy_rebuilt, png_parts, cleaned_folder, cleaned_twice, harness_gate, guard_gate, tumbling, sliding, user_sessions)}

_REMOVED = {"toyf": 1, "png": 1, "jpeg": 2, "gif": 1, "webp": 1, "flac": 1, "mp3": 2, "bmp": 1, "svg": 2, "mp4": 1, "tiff": 1, "zip": 1, "docx": 1, "pdf": 4, "empty": 0}
_KIND = "[" + ", ".join(f"'{k}'" for k in fixtures.KINDS) + f"][doc_id % {len(fixtures.KINDS)} + 1]"
SQL = {
    "toy_records": """with d as (select doc_id, encode(text) b, encode(coalesce(source, '')) s, encode(coalesce(doc_kind, '')) k from documents where text is not null)
select doc_id, 0 seq, 'content' kind, 0 "offset", 8 + octet_length(b) length, sha256(b) digest from d union all select doc_id, 1, 'record 7', 8 + octet_length(b), 3 + octet_length(s), sha256(s) from d
union all select doc_id, 2, 'record 16', 8 + octet_length(b) + 3 + octet_length(s), 3 + octet_length(k), sha256(k) from d""",
    "toy_rebuilt": "select doc_id, sha256(text) digest from documents where text is not null",
    "png_parts": """with d as (select doc_id, octet_length(encode(concat_ws('/', source, doc_kind, 'note'))) n from documents) select doc_id, seq, kind, case seq when 0 then 0 when 1 then 8 when 2 then 33 when 3 then 52 + n when 4 then 74 + n end "offset",
  case seq when 0 then 8 when 1 then 25 when 2 then 19 + n when 3 then 22 when 4 then 12 end length from d, (values (0, 'signature'), (1, 'IHDR'), (2, 'tEXt'), (3, 'IDAT'), (4, 'IEND')) c(seq, kind)""",
    "cleaned_folder": f"with d as (select doc_id, {_KIND} k from documents) select doc_id || '.' || k path, case k when 'text' then 'kept as text' when 'unknown' then 'not supported' else 'cleaned' end outcome, case when k not in ('text', 'unknown', 'empty') then k end format, case k "
    + " ".join(f"when '{k}' then {n}" for k, n in _REMOVED.items())
    + " end removed, case k when 'text' then 'text only, no place for fields' when 'unknown' then 'unknown type, left out' when 'empty' then 'no bytes, so no fields' end notes from d",
    "cleaned_twice": f"select {_KIND} format, count(*) n, true stable from documents where {_KIND} not in ('text', 'unknown', 'empty') group by 1",
    "harness_gate": "with n as (select count(distinct c_mktsegment) groups, count(distinct c_custkey) repeats from customer) select stub, stub = 'leaky' and groups > 1 leaks, stub = 'noisy' and repeats > 1 noisy from n, (values ('clean'), ('leaky'), ('version'), ('noisy')) t(stub)",
    "guard_gate": """with t as (select r_name tool, r_regionkey k, n_name || '.' i, n_name || '.' || case when r_regionkey % 2 = 1 then '~by ' || r_name || '~' else '' end o from nation join region on n_regionkey = r_regionkey),
runs as (select distinct tool, substring(o, a, n) run from (select *, row_number() over (partition by tool order by length(o), o) rn from t) f, unnest(range(1, 60)) x(a), unnest(range(4, 60)) y(n) where rn = 1 and a + n - 1 <= length(o)),
kept as (select tool, run from runs r where (select count(*) from t where t.tool = r.tool and contains(o, run)) = (select count(*) from t where t.tool = r.tool) and not exists (select 1 from t where t.tool = r.tool and contains(i, run))),
best as (select tool, arg_min(run, (-length(run), run)) run from kept group by 1)
select tool, case when run is null then 'pass' else 'fail' end verdict, run signature from (select distinct tool from t) left join best using (tool)""",
    "tumbling": "select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n from events group by 1, 2",
    "sliding": "select window_start, event_type, count(*) n from (select time_bucket(interval '1 hour', ts) - to_hours(k) window_start, event_type from events, unnest([0, 1]) t(k)) group by 1, 2",
    "user_sessions": "with m as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval '3 hours' then 1 else 0 end fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from m) select user_id, min(ts) session_start, count(*) n from s group by user_id, k",
}
