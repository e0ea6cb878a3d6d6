"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP_AT = 58


def clip(col: Column, width: int = CLIP_AT) -> Column:
    """col on one line: white space collapsed, other non-printable ASCII as '.', cut to width with an ellipsis."""
    flat = F.regexp_replace(F.trim(F.regexp_replace(col, r"[ \t\r\n\x0b\x0c]+", " ")), r"[\x00-\x1f\x7f]", ".")
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def human_size(n: Column) -> Column:
    """A number of bytes as B, KB or MB of 1024, one decimal from KB on."""
    one = lambda x: F.round(x, 1).cast("decimal(20,1)").cast("string")
    return F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(one(n / 1024), F.lit(" KB"))).otherwise(F.concat(one(n / (1024 * 1024)), F.lit(" MB")))


def tag_group(key: Column) -> Column:
    """The group of `Group:Copy3:Tag`."""
    return F.split_part(key, F.lit(":"), F.lit(1))


def tag_name(key: Column) -> Column:
    """The tag of `Group:Copy3:Tag`."""
    return F.split_part(key, F.lit(":"), F.lit(-1))


def is_text(col: Column) -> Column:
    """Whether a text has no control characters but tab, line feed, carriage return and form feed, and is no XMP packet."""
    return ~col.rlike(r"[\x00-\x08\x0b\x0e-\x1f\x7f]") & ~col.rlike(r"^(?s).{0,256}(<\?xpacket|<x:xmpmeta)")


def strip_comments(col: Column) -> Column:
    """Without XML comments; one that is never closed stays, and so do those inside CDATA."""
    return F.regexp_replace(col, r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->", "$1")


def strip_instructions(col: Column) -> Column:
    """Without processing instructions other than the XML declaration and style sheets."""
    return F.regexp_replace(col, r"(?s)<\?(?!xml[ \t\r\n]|xml-stylesheet).*?\?>", "")


def strip_attribute(col: Column, name: str) -> Column:
    """Without the attribute of the written name, in any tag."""
    return F.regexp_replace(col, rf"""(<[^<>]*?)\s{name}\s*=\s*("[^"]*"|'[^']*')""", "$1")


def strip_element(col: Column, name: str) -> Column:
    """Without elements of the written name that hold no element of the same name."""
    return F.regexp_replace(col, rf"(?s)<{name}(?:\s[^<>]*)?(?:/>|>.*?</{name}\s*>)", "")


def user_paths(col: Column) -> Column:
    """The home folders of users named in a text."""
    return F.regexp_extract_all(col, F.lit(r"(/(?:home|Users)/[A-Za-z0-9._-]+|[A-Za-z]:\\Users\\[A-Za-z0-9._-]+)"), F.lit(1))


def looks_like_file(col: Column) -> Column:
    """Whether a picture's name is a path or a file name."""
    return col.rlike(r"(?i)[\\/]|\.(jpe?g|png|gif|tiff?|bmp|svg|webp|heic|emf|wmf|docx?|pdf)$")


def generated_by(col: Column) -> Column:
    """Whether a text is a generator's own label."""
    return col.rlike(r"(?i)^\s*(created|generated|made|produced|exported) (with|by|using|from) ")


def fold_digits(col: Column) -> Column:
    """Runs of digits as #, so that messages differing in numbers fall together."""
    return F.regexp_replace(col, r"[0-9]+", "#")


def relative_path(base: Column, target: Column) -> Column:
    """A target resolved against the folder of base, with `.` and `..` folded; above the root stays at the root."""
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), target))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(folded, "/")


def humanise(name: Column) -> Column:
    """A test's name as words."""
    words = F.trim(F.regexp_replace(F.regexp_replace(name, "^test_", ""), "_+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def bar(share: Column, width: int = 20) -> Column:
    """A share from 0 to 1 as a bar of full and empty blocks."""
    full = F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def data_uris(col: Column) -> Column:
    """The data URIs of a text, each with its type and its decoded bytes; what doesn't decode gives null bytes."""
    found = F.regexp_extract_all(col, F.lit(r"(data:[a-zA-Z0-9.+/-]*(?:;[a-zA-Z0-9.=-]+)*(?:;base64)?,[A-Za-z0-9+/=%._~-]*)"), F.lit(1))

    def one(uri: Column) -> Column:
        head, body = F.substring_index(uri, ",", 1), F.substring_index(uri, ",", -1)
        content = F.when(head.endswith(";base64"), F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(F.try_url_decode(body), "utf-8"))
        return F.struct(F.regexp_extract(head, "^data:([^;,]*)", 1).alias("type"), content.alias("content"))

    return F.transform(found, one)
