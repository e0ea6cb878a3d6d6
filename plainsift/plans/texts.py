"""Queries of text and byte functions, over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.functions import binary, text
from plainsift.shared import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")


def clip_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts on one line each, cut with an ellipsis."""
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", text.clip(F.col("text")).alias("clipped"))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths of texts as sizes."""
    return _documents(spark, sf_dir).select("doc_id", text.human_size(F.col("n_chars")).alias("size"))


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are plain."""
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", text.is_text(F.col("text")).alias("plain"))


def _page() -> Column:
    """A page around a text's number, with what the cleaners must find."""
    return F.concat(F.lit('<?xml version="1.0"?><?app x?><html id="a" data-n=\''), F.col("doc_id"), F.lit("'><!-- made <b> "), F.col("doc_id"), F.lit(" --><![CDATA[<!-- kept -->]]><script src=\"x\">var a;</script><p title=\"t"), F.col("n_chars"), F.lit('">'), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p><!-- open"))


def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of pages, around whole texts, without comments, instructions, scripts and titles."""
    page = _page().alias("page")
    pages = table(spark, sf_dir, "documents").select("doc_id", page).where("page is not null")
    cleaned = text.strip_attribute(text.strip_element(text.strip_instructions(text.strip_comments(F.col("page"))), "script"), "title")
    return pages.select("doc_id", F.sha2(cleaned, 256).alias("cleaned"))


def user_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home folders in a path put together from the results sheet."""
    path = F.concat(F.lit("see /home/u"), F.col("tree_id"), F.lit("/"), F.col("path"), F.lit(" or C:\\Users\\n"), F.col("row_id"), F.lit("\\x"))
    return table(spark, sf_dir, "scrub_results").select("row_id", "loaded_at", F.array_join(text.user_paths(path), "|").alias("found"))


def file_like_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths look like files."""
    return table(spark, sf_dir, "scrub_results").where("path is not null").select("row_id", "loaded_at", text.looks_like_file(F.col("path")).alias("file_like"))


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target resolved against the part it is named in."""
    return table(spark, sf_dir, "part").select("p_partkey", text.relative_path(F.concat(F.lit("word/"), F.col("p_brand"), F.lit("/doc.xml")), F.concat(F.lit("../../../media/./"), F.col("p_type"), F.lit(".png"))).alias("target"))


def humanised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as words."""
    return table(spark, sf_dir, "part").select("p_partkey", text.humanise(F.concat(F.lit("test_"), F.regexp_replace("p_name", " ", "__"))).alias("words"), text.bar(F.col("p_size") / 50).alias("bar"))


def tag_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and name of tags."""
    key = F.concat(F.col("p_type"), F.lit(":Copy1:"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.tag_group(key).alias("tag_group"), text.tag_name(key).alias("tag"))


def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each order's lines, in their order."""
    line = F.concat_ws("|", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice").cast("decimal(15,2)"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("all"))
    return lines.select("l_orderkey", F.sha2(F.array_join(F.transform("all", lambda x: x["t"]), "\n"), 256).alias("digest"))


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole texts."""
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


def uuid_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable identifier of each text."""
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", binary.uuid8(F.col("text")).alias("uuid"))


def hex_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes around the tenth byte of each text."""
    return _documents(spark, sf_dir).where("length(encode(text, 'utf-8')) >= 40").select("doc_id", binary.hex_context(F.encode("text", "utf-8"), F.lit(10), F.lit(4)).alias("context"))


def byte_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read from bytes in either order, and a packed time."""
    raw = F.unhex(F.lpad(F.hex(F.col("o_orderkey") * 2654435 + 77), 16, "0"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return orders.select(
        "o_orderkey",
        binary.big_endian(F.col("raw"), 2, 4).alias("big"),
        binary.little_endian(F.col("raw"), 4, 4).alias("little"),
        F.date_format(binary.dos_time(F.pmod("o_orderkey", F.lit(65536)).cast("int"), F.lit(0x6B2D)), "yyyy-MM-dd HH:mm:ss").alias("dos"),
    )


QUERIES = {f.__name__: f for f in (clip_notes, human_sizes, plain_texts, strip_markup, user_paths, file_like_names, resolved_paths, humanised, tag_parts, ordered_digest, checksums, uuid_of_text, hex_context, byte_numbers)}

_PAGE = "'<html id=\"a\" data-n=''' || doc_id || '''><![CDATA[<!-- kept -->]]><p>' || replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;') || '</p><!-- open'"
SQL = {
    "clip_notes": "with f as (select doc_id, regexp_replace(trim(regexp_replace(text, '[ \\t\\r\\n\\x0b\\x0c]+', ' ', 'g')), '[\\x00-\\x1f\\x7f]', '.', 'g') t from documents where text is not null) select doc_id, case when length(t) > 58 then substring(t, 1, 57) || '…' else t end clipped from f",
    "human_sizes": "select doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then cast(round(n_chars / 1024, 1) as decimal(20,1)) || ' KB' else cast(round(n_chars / 1048576, 1) as decimal(20,1)) || ' MB' end size from documents",
    "plain_texts": "select doc_id, not regexp_matches(text, '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]') and not regexp_matches(text, '(?s)^.{0,256}(<\\?xpacket|<x:xmpmeta)') plain from documents where text is not null",
    "strip_markup": f"select doc_id, sha256('<?xml version=\"1.0\"?>' || {_PAGE}) cleaned from documents where n_chars is not null",
    "user_paths": "select row_id, loaded_at, '/home/u' || tree_id || '|C:\\Users\\n' || row_id found from scrub_results",
    "file_like_names": "select row_id, loaded_at, regexp_matches(path, '(?i)[\\\\/]|\\.(jpe?g|png|gif|tiff?|bmp|svg|webp|heic|emf|wmf|docx?|pdf)$') file_like from scrub_results where path is not null",
    "resolved_paths": "select p_partkey, 'media/' || p_type || '.png' target from part",
    "humanised": "select p_partkey, upper(substring(p_name, 1, 1)) || substring(p_name, 2) words, repeat('█', cast(round(p_size / 50 * 20) as int)) || repeat('░', 20 - cast(round(p_size / 50 * 20) as int)) bar from part",
    "tag_parts": "select p_partkey, p_type tag_group, p_brand tag from part",
    "ordered_digest": "select l_orderkey, sha256(string_agg(t, chr(10) order by l_linenumber, t)) digest from (select l_orderkey, l_linenumber, concat_ws('|', l_linenumber, l_partkey, l_suppkey, cast(l_extendedprice as decimal(15,2))) t from lineitem) group by 1",
    "checksums": "select doc_id, md5(text) md5, sha256(text) sha256 from documents where text is not null",
    "uuid_of_text": "with h as (select doc_id, sha256(text) h from documents where text is not null) select doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-8' || substring(h, 14, 3) || '-' || substring('89ab', (strpos('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) uuid from h",
    "hex_context": "select doc_id, lower(substring(hex(encode(text)), 5, 40)) context from documents where octet_length(encode(text)) >= 40",
    "byte_numbers": "with r as (select o_orderkey, o_orderkey * 2654435 + 77 n from orders) select o_orderkey, (n >> 16) & 4294967295 big, ((n & 255) << 24) | (((n >> 8) & 255) << 16) | (((n >> 16) & 255) << 8) | ((n >> 24) & 255) little, strftime(try_cast(format('{:04d}-{:02d}-{:02d} 13:25:26', ((o_orderkey % 65536) >> 9) + 1980, ((o_orderkey % 65536) >> 5) & 15, o_orderkey & 31) as timestamp), '%Y-%m-%d %H:%M:%S') dos from r",
}
