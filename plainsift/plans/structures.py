"""Queries over the parts of containers and the structures inside them: each made of every document, and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.operators import features, folder, mutations, variance
from plainsift.shared import table
from plainsift.sources import files, fixtures, inner



def _note() -> Column:
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.lit("note"))


_NOTE_SQL = "concat_ws('/', coalesce(source, ''), 'note')"

#: Of the files of fixtures, the parts in order: kind, and place and size as a + b times the length of the note.
LAYOUTS: dict[str, list[tuple[str, int, int, int, int]]] = {
    "jpeg": [("SOI", 0, 0, 2, 0), ("APP0 JFIF", 2, 0, 18, 0), ("APP1 Exif", 20, 0, 10, 1), ("COM", 30, 1, 4, 1), ("DQT", 34, 2, 69, 0), ("SOF0", 103, 2, 13, 0), ("SOS", 116, 2, 17, 0), ("EOI", 133, 2, 2, 0)],
    "gif": [("header", 0, 0, 19, 0), ("comment", 19, 0, 4, 1), ("image", 23, 1, 15, 0), ("end", 38, 1, 1, 0)],
    "webp": [("header", 0, 0, 12, 0), ("VP8X", 12, 0, 18, 0), ("VP8 ", 30, 0, 14, 0), ("EXIF", 44, 0, 8, 1)],
    "flac": [("magic", 0, 0, 4, 0), ("STREAMINFO", 4, 0, 38, 0), ("VORBIS_COMMENT", 42, 0, 12, 1), ("audio", 54, 1, 7, 0)],
    "mp3": [("ID3v2", 0, 0, 20, 1), ("audio", 20, 1, 1251, 0), ("ID3v1", 1271, 1, 128, 0)],
    "bmp": [("file header", 0, 0, 14, 0), ("picture header", 14, 0, 40, 0), ("pixels", 54, 0, 8, 0), ("trailer", 62, 0, 0, 1)],
    "mp4": [("ftyp", 0, 0, 20, 0), ("moov", 20, 0, 184, 1), ("moov/mvhd", 28, 0, 108, 0), ("moov/trak", 136, 0, 52, 0), ("moov/trak/mdia", 144, 0, 44, 0), ("moov/trak/mdia/minf", 152, 0, 36, 0), ("moov/trak/mdia/minf/stbl", 160, 0, 28, 0), ("moov/trak/mdia/minf/stbl/stco", 168, 0, 20, 0), ("moov/udta", 188, 0, 16, 1), ("moov/udta/name", 196, 0, 8, 1), ("mdat", 204, 1, 19, 0)],
    "tiff": [("header", 0, 0, 8, 0), ("IFD0 0100", 10, 0, 12, 0), ("IFD0 0131", 22, 0, 12, 0)],
    "svg": [("http://www.w3.org/2000/svg svg", 21, 0, 92, 2), ("comment", 61, 0, 8, 1), ("http://www.w3.org/2000/svg metadata", 69, 1, 21, 1), ("http://www.w3.org/2000/svg rect", 90, 2, 23, 0)],
    "exe": [("header", 0, 0, 64, 0), ("section .note", 64, 0, 0, 1), ("section .shstrtab", 64, 1, 17, 0)],
}


def _made(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return fixtures.made(table(spark, sf_dir, "documents").select("doc_id", F.lit(kind).alias("kind"), _note().alias("note")), "doc_id", "kind", "note")


def _walked(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return files.records(_made(spark, sf_dir, kind), "doc_id", "content").select("doc_id", "seq", "kind", "offset", "length")

    query.__doc__ = f"The parts of a file of the kind {kind} made for every document."
    return query


def _read(reader: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inner.rows(_made(spark, sf_dir, f"inner {reader}"), "doc_id", "content", reader)

    query.__doc__ = f"The rows of {reader} over a structure made for every document."
    return query


def metafile_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a metafile made for every document; sizes are padded to four bytes."""
    return _walked("metafile")(spark, sf_dir)


def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of an archive made for every document, by name and the size they inflate to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("zip").alias("kind"), _note().alias("note"))
    found = files.records(fixtures.made(docs, "doc_id", "kind", "note"), "doc_id", "content").where("kind like 'member %'")
    return found.select("doc_id", "seq", F.substr("kind", F.lit(8)).alias("member"))


def cleaned_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives in archives, with a picture and a document at every depth, cleaned: outcome, and fields taken from each kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("nested").alias("kind"), _note().alias("note"))
    made = fixtures.made(docs, "doc_id", "kind", "note").withColumn("relative", F.concat("doc_id", F.lit(".zip")))
    rows = folder.clean_files(made).select("path", "outcome", "removed", "removed_fields", "cleaned", "independent_check")
    count = lambda what: F.regexp_count("removed_fields", F.lit(what))
    return rows.select("path", "outcome", "removed", count("a\\.png: ").alias("of_pictures"), count("docx: member docProps/core\\.xml").alias("of_documents"), F.startswith("independent_check", F.lit("none of")).alias("searched"))


BLANKED = ("heic", "metafile", "windows metafile", "built", "dated", "mac")


def cleaned_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Still pictures, metafiles and programs made of every document, cleaned: what went, that the note is gone, that a second
    cleaning changes nothing, and whether the length stayed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, BLANKED))).alias("kind"), F.concat(_note(), F.lit(" of twenty signs or more")).alias("note"))
    made = fixtures.made(docs.select(F.concat_ws("|", "doc_id", "kind", "note").alias("relative"), "kind", "note"), "relative", "kind", "note")
    once = folder.clean_files(made).select("path", "outcome", "format", "removed", "bytes_before", "bytes_after", "cleaned", "independent_check")
    again = folder.clean_files(once.select("path", "cleaned"), "path", "cleaned").select("path", F.col("cleaned").alias("again"))
    part = lambda n: F.split_part("path", F.lit("|"), F.lit(n))
    left = F.contains(F.hex("cleaned"), F.hex(F.encode(part(3), "utf-8")))
    return once.join(again, "path").select(part(1).cast("bigint").alias("doc_id"), part(2).alias("made"), "outcome", "format", "removed", (~left).alias("gone"), (F.col("cleaned") == F.col("again")).alias("stable"), (F.col("bytes_before") == F.col("bytes_after")).alias("same_length"))


def mutations_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged copies of a picture made for every document: how many, and the sizes of the two that are only shortened."""
    found = mutations.mutations(_made(spark, sf_dir, "png"), "doc_id", "content", 6)
    size = lambda kind: F.max(F.when(F.col("kind") == kind, F.octet_length("content")))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), size("half").alias("half"), size("head").alias("head"))


def fuzz_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaners held against damaged files of every kind: trials by kind, and those that ended in an error, which none may."""
    kinds = ("png", "jpeg", "gif", "webp", "flac", "mp3", "bmp", "svg", "mp4", "tiff", "zip", "docx", "pdf", "heic", "metafile", "windows metafile", "built", "dated", "mac")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, kinds)), (F.pmod("doc_id", F.lit(len(kinds))) + 1).cast("int")).alias("kind"), _note().alias("note"))
    made = fixtures.made(docs, "doc_id", "kind", "note")
    damaged = mutations.mutations(made.withColumn("relative", F.concat_ws(".", "doc_id", "kind")), "relative", "content", 4)
    tried = folder.clean_files(damaged).select(F.split_part("path", F.lit("."), F.lit(2)).alias("shape"), "outcome", "notes", F.lit(0.0).alias("seconds"))
    return mutations.campaign(tried, "shape").select("shape", "n", "errors")


def feature_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistical oracle over the structural features of files made for every document: the kind of a document is the
    group, its documents are the repeats."""
    kinds = ("png", "jpeg", "flac", "mp3", "zip", "docx", "pdf", "mp4")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("doc_kind", F.lit("")).alias("group"), F.explode(F.array(*map(F.lit, kinds))).alias("kind"), _note().alias("note"))
    keyed = docs.select(F.concat_ws("|", "doc_id", "group").alias("key"), "kind", "note")
    found = features.feature_table(fixtures.made(keyed, "key", "kind", "note"), ["key"], "content")
    part = lambda n: F.split_part("key", F.lit("|"), F.lit(n))
    grid = found.select(F.concat_ws(" ", "format", "feature_id").alias("feature_id"), part(2).alias("group"), part(1).cast("bigint").alias("repeat"), "value")
    return variance.decompose(grid)


def _layout_sql(kind: str) -> str:
    rows = ", ".join(f"({n}, '{k}', {a}, {b}, {c}, {d})" for n, (k, a, b, c, d) in enumerate(LAYOUTS[kind]))
    return f"with d as (select doc_id, octet_length(encode({_NOTE_SQL})) n from documents), p(seq, kind, a, b, c, d) as (values {rows}) select doc_id, seq, kind, a + b * n \"offset\", c + p.d * n length from d, p where c + p.d * n > 0 or kind like 'section%'"


def _reader_sql(*rows: tuple[str, str]) -> str:
    """The rows of a reader: names and SQL of values, of the note s and its length n."""
    each = " union all ".join(f"select doc_id, {k} seq, '{name}' as name, {value} as value from d" for k, (name, value) in enumerate(rows))
    return f"with d as (select doc_id, {_NOTE_SQL} s, octet_length(encode({_NOTE_SQL})) n from documents) select *, cast(null as varchar) error from ({each})"


def _json(**values: str) -> str:
    return "'{" + ", ".join(f'"{k}": \' || {v} || \'' for k, v in values.items()) + "}'"


_PADDED = "((n + 3) // 4 * 4)"
READER_ROWS: dict[str, list[tuple[str, str]]] = {
    "vorbis_comments": [("vendor", "'v'"), ("ARTIST", "s")],
    "id3_frames": [("TIT2", "s")],
    "photoshop_resources": [("0404", "lower(hex(encode(s)))")],
    "iptc_datasets": [("2:80", "s")],
    "apple_attributes": [("key", "lower(hex(encode(s)))")],
    "media_chunks": [(f"track 0 chunk {k + 1}", "'{\"offset\": ' || (" + str(100 * k + 100) + " + n) || ', \"sizes\": [" + sizes + "]}'") for k, sizes in enumerate(("1, 2", "3, 4", "' || n || '"))],
    "picture_items": [("item 1", "'hvc1'"), ("item 2", "'Exif'"), ("reference cdsc 2", "'[1]'")],
    "item_places": [("place 1", "'{\"method\": 0, \"extents\": [[500, 9]]}'"), ("place 2", "'{\"method\": 0, \"extents\": [[509, ' || n || ']]}'"), ("properties 1", "'[1, 2]'")],
    "content_operations": [("q", "''"), ("cm", "'1 0 0 1 100 ' || n"), ("BT", "''"), ("Tf", "'/F1 12'"), ("Td", "'10 20'"), ("Tj", "'(a)'"), ("Td", "'5 -7'"), ("Tj", "'(b)'"), ("ET", "''"), ("Q", "''"), ("BT", "''"), ("Tf", "'/F2 9.5'"), ("TL", "'14'"), ("Tm", "'2 0 0 2 3 4'"), ("T*", "''"), ("Tj", "'(c)'"), ("ET", "''")],
    "page_positions": [("(a)", "'110 ' || (n + 20) || ' 12'"), ("(b)", "'115 ' || (n + 13) || ' 12'"), ("(c)", "'3 -24 9.5'")],
    "pe_sections": [(".text", _json(offset="128", size="n"))],
    "macho_commands": [("command 1B", _json(offset="32", size="16")), ("command 2A", _json(offset="48", size=f"(8 + {_PADDED})"))],
    "sound_frames": [(f"frame {k}", f"'{{\"offset\": ' || (n + {20 + 417 * k}) || ', \"size\": 417, \"kbit\": 128, \"hertz\": 44100, \"channels\": 2}}'") for k in range(3)],
    "wmf_records": [("0626", "cast(2 * (3 + (n + 1) // 2) as varchar)"), ("0000", "'6'")],
}

QUERIES = {
    **{f"{kind}_parts": _walked(kind) for kind in LAYOUTS},
    **{reader: _read(reader) for reader in (*READER_ROWS, "package_relations")},
    **{f.__name__: f for f in (metafile_parts, zip_members, cleaned_nested, cleaned_in_place, mutations_made, fuzz_campaign, feature_decompose)},
}
_N = f"octet_length(encode({_NOTE_SQL}))"
SQL = {
    **{f"{kind}_parts": _layout_sql(kind) for kind in LAYOUTS},
    **{reader: _reader_sql(*rows) for reader, rows in READER_ROWS.items()},
    "package_relations": _reader_sql(*[("[Content_Types].xml Override", "'{\"ContentType\": \"" + kind + "\", \"PartName\": \"" + part + "\"}'") for part, kind in (("/docProps/core.xml", "x"), ("/word/document.xml", "y"))]),
    "webp_parts": _layout_sql("webp").replace("c + p.d * n length", "c + p.d * (n + n % 2) length"),
    "metafile_parts": f"with d as (select doc_id, ({_N} + 3) // 4 * 4 p from documents) select doc_id, seq, kind, case seq when 0 then 0 when 1 then 108 else 120 + p end \"offset\", case seq when 0 then 108 when 1 then 12 + p else 20 end length from d, (values (0, 'record 1'), (1, 'record 70'), (2, 'record 14')) v(seq, kind)",
    "zip_members": "select doc_id, seq, member from documents, (values (0, 'a.txt'), (1, '__MACOSX/._a.txt')) v(seq, member)",
    "cleaned_nested": "select doc_id || '.zip' path, 'cleaned' outcome, 6 removed, 3 of_pictures, 3 of_documents, true searched from documents",
    "cleaned_in_place": "select doc_id, made, 'cleaned' outcome, format, removed, true gone, true stable, same_length from documents, (values ('heic', 'heic', 1, true), ('metafile', 'metafile', 1, false), ('windows metafile', 'metafile', 1, false), ('built', 'exe', 2, true), ('dated', 'exe', 3, true), ('mac', 'exe', 1, true)) v(made, format, removed, same_length)",
    "mutations_made": f"select doc_id, 8 n, (86 + {_N}) // 2 half, 16 head from documents",
    "fuzz_campaign": "select ['png', 'jpeg', 'gif', 'webp', 'flac', 'mp3', 'bmp', 'svg', 'mp4', 'tiff', 'zip', 'docx', 'pdf', 'heic', 'metafile', 'windows metafile', 'built', 'dated', 'mac'][doc_id % 19 + 1] shape, 6 * count(*) n, 0 errors from documents group by 1",
}
