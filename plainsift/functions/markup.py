"""Functions on markup as column expressions; where elements nest, Arrow batches of a scanner in Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Relations that name a page's maker, names of properties a book keeps, and the attributes that name pictures.
AUTHOR_RELATIONS = ("author", "me", "meta", "schema.dc", "schema.dcterms")
KEPT_PROPERTIES = ("rendition:layout", "rendition:orientation", "rendition:spread", "rendition:flow", "rendition:viewport", "media:active-class", "media:playback-active-class", "media:duration")
KEPT_REFINEMENTS = ("title-type", "display-seq", "group-position")
NAMING_ATTRIBUTES = ("name", "descr", "title", "o:title", "alt")
DUBLIN_CORE = "http://purl.org/dc/elements/1.1/"
BOOK = "http://www.idpf.org/2007/opf"
#: Published colour profiles, by the beginning of their description.
STANDARD_PROFILES = ("srgb", "display p3", "dci(p3)", "dci-p3", "smpte rp 431-2", "p3", "adobe rgb (1998)", "generic rgb profile", "generic gray profile", "generic gray gamma 2.2 profile", "generic cmyk profile", "generic lab profile", "generic xyz profile",
    "rec. itu-r bt.2020", "rec. itu-r bt.709", "itu-r bt.2020", "itu-r bt.709", "itu-2020", "itu-709", "rec. 2020", "rec. 709", "romm rgb", "prophoto rgb", "aces cg linear", "acescg linear", "coated fogra39", "uncoated fogra29",
    "u.s. web coated (swop) v2", "japan color 2001 coated", "dot gain 20%", "gray gamma 2.2", "linear gray", "sgray", "image p3")


def has_doctype(col: Column) -> Column:
    """Whether a document type is declared before the root element; comments and instructions before it don't matter."""
    return col.rlike(r"(?s)\A(?:\s|\x{FEFF}|<\?.*?\?>|<!--.*?-->)*<!DOCTYPE")


def declaration(col: Column) -> Column:
    """The XML declaration as it is spelt, with the line end after it, or ''."""
    return F.regexp_extract(col, r"\A<\?xml[^>]*\?>(?:\r\n|\r|\n)?", 0)


def self_closing(col: Column) -> Column:
    """How empty elements are closed: `spaced`, `tight`, `mixed`, or `none` where there are none."""
    spaced, every = F.regexp_count(col, F.lit(r"\s/>")), F.regexp_count(col, F.lit(r"/>"))
    return F.when(every == 0, "none").when(spaced == every, "spaced").when(spaced == 0, "tight").otherwise("mixed")


def order_policy(names: Column, first: str = "[Content_Types].xml") -> Column:
    """How the members of a package are ordered: by name, the types first and then by name, the types first or last, or otherwise."""
    rest = F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0)))
    leads = F.get(names, F.lit(0)) == first
    ordered = lambda x: x == F.array_sort(x)
    return (
        F.when(F.size(names) == 0, "empty")
        .when(leads & ordered(rest), "types first, then sorted")
        .when(ordered(names), "sorted")
        .when(F.element_at(names, -1) == first, "types last")
        .when(leads, "types first")
        .otherwise("own order")
    )


def time_scheme(stamps: Column) -> Column:
    """What the packed times (arrays of date and time) of a package's members are: one of two constants, or a clock's."""
    kinds = F.array_distinct(stamps)
    is_ = lambda date: (F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == F.array(F.lit(date), F.lit(0)))
    return F.when(F.size(kinds) == 0, "empty").when(is_(33), "first day").when(is_(0), "unset").otherwise(F.concat(F.lit("clock, "), F.size(kinds), F.lit(" times")))


def unescape(col: Column) -> Column:
    """A text with the five named entities of XML read."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        col = F.replace(col, F.lit(f"&{name};"), F.lit(sign))
    return col


def document_text(col: Column) -> Column:
    """The visible text of a word processor's part: runs of text, tabs, and line breaks, in order."""
    marks = F.regexp_extract_all(col, F.lit(r"<w:t(?:\s[^<>]*)?>[^<]*</w:t>|<w:(?:tab|br|cr)(?:\s[^<>]*)?/>"), F.lit(0))
    said = lambda m: F.when(m.startswith("<w:tab"), "\t").when(m.startswith("<w:br") | m.startswith("<w:cr"), "\n").otherwise(unescape(F.regexp_extract(m, ">([^<]*)<", 1)))
    return F.array_join(F.transform(marks, said), "")


def page_text(col: Column) -> Column:
    """The visible text of a page: without comments, scripts, styles and tags, blanks collapsed."""
    bare = F.regexp_replace(col, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>|<[^<>]*>", " ")
    return F.trim(F.regexp_replace(unescape(bare), r"\s+", " "))


def sheet_cells(col: Column) -> Column:
    """The cells of a sheet's part, as structs of reference, type and value."""
    cells = F.regexp_extract_all(col, F.lit(r"<c\s[^<>]*>(?:(?!</c>).)*</c>"), F.lit(0))
    part = lambda c, p: F.regexp_extract(c, p, 1)
    return F.transform(cells, lambda c: F.struct(part(c, r'\sr="([^"]*)"').alias("ref"), part(c, r'\st="([^"]*)"').alias("type"), unescape(part(c, r"<v>([^<]*)</v>")).alias("value")))


def hidden_counts(col: Column) -> Column:
    """Of a sheet's part: hidden rows, hidden columns, and headers or footers with text."""
    hidden = lambda tag: F.regexp_count(col, F.lit(rf"""<{tag}\s(?:[^<>]*\s)?hidden=["'](?:1|true)["']"""))
    return F.struct(hidden("row").alias("rows"), hidden("col").alias("columns"), F.regexp_count(col, F.lit(r"<(?:odd|even|first)(?:Header|Footer)>\s*[^<\s]")).alias("headers"))


def clean_head(col: Column) -> Column:
    """A page without named metadata (but the viewport), links to its author, and the metadata of drawings in it."""
    rels = "|".join(re.escape(r) for r in AUTHOR_RELATIONS)
    quiet = F.regexp_replace(col, r"""(?i)<meta\b(?=[^<>]*\s(?:name|property)\s*=)(?![^<>]*\s(?:name|property)\s*=\s*["']viewport["'])[^<>]*>""", "")
    quiet = F.regexp_replace(quiet, rf"""(?i)<link\b(?=[^<>]*\srel\s*=\s*["'](?:[^"'<>]*\s)?(?:{rels})(?:\s[^"'<>]*)?["'])[^<>]*>""", "")
    return F.regexp_replace(quiet, r"(?s)<(?:svg:)?metadata\b[^<>]*(?:/>|>.*?</(?:svg:)?metadata\s*>)", "")


def metadata_verdict(namespace: Column, name: Column, id_: Column, attributes: Column, unique: Column, kept: Column) -> Column:
    """What becomes of a child of a book's metadata: `keep`, `identifier`, `modified` or `drop`.

    attributes is a map; unique the id of the book's identifier; kept the ids of kept titles, an array."""
    at = lambda a: F.try_element_at(attributes, F.lit(a))
    core = F.when(name == "identifier", F.when(id_.eqNullSafe(unique), "identifier").otherwise("drop")).when(name.isin("title", "language"), "keep").otherwise("drop")
    prop, refines = at("property"), at("refines")
    refined = F.when(prop == "media:duration", "keep").when(prop.isin(*KEPT_REFINEMENTS) & F.array_contains(kept, F.regexp_replace(refines, "^#+", "")), "keep").otherwise("drop")
    own = F.when(prop.isNull(), F.when(at("name") == "cover", "keep").otherwise("drop")).when(F.coalesce(refines, F.lit("")) != "", refined).when(prop == "dcterms:modified", "modified").when(prop.isin(*KEPT_PROPERTIES), "keep").otherwise("drop")
    return F.when(namespace == DUBLIN_CORE, core).when((namespace == BOOK) & (name == "meta"), own).otherwise("drop")


FILE_LIKE = r"""(?i)\.(?:jpe?g|jpe|png|gif|bmp|tiff?|emf|wmf|heic|webp|svg|wdp)\b|(?:^|[\s("'])(?:[A-Z]:\\|\\\\[\w$.-]+\\|file:/)|/(?:Users|home)/"""


def blank_picture_names(col: Column) -> Column:
    """A part whose pictures' names and descriptions are empty where they are file names or paths."""
    names = "|".join(re.escape(a) for a in NAMING_ATTRIBUTES)

    @F.pandas_udf(T.StringType())
    def blanked(parts: pd.Series) -> pd.Series:
        tags = re.compile(r"<(?:(?:\w+:)?cNvPr|wp:docPr|v:imagedata|v:shape)\s[^<>]*>")
        value = re.compile(rf'(\s({names})\s*=\s*")([^"]*)(?=")')
        like = re.compile(FILE_LIKE)
        emptied = lambda tag: value.sub(lambda a: a[1] + ("" if like.search(a[3]) or (a[2] == "o:title" and "imagedata" in tag) else a[3]), tag)
        return parts.map(lambda p: None if p is None else tags.sub(lambda m: emptied(m[0]), p))

    return blanked(col)


def coordinates(col: Column) -> Column:
    """The places on earth that a text names in the form of ISO 6709."""
    return F.regexp_extract_all(col, F.lit(r"([+-]\d{2}\.\d{3,}[+-]\d{3}\.\d{3,})"), F.lit(1))


def standard_profile(description: Column) -> Column:
    """Whether a colour profile's description begins with a published one's name, at a word's end."""
    names = "|".join(re.escape(n) for n in sorted(STANDARD_PROFILES, key=len, reverse=True))
    return F.lower(F.trim(description)).rlike(rf"\A(?:{names})(?![\p{{L}}\p{{N}}])")


def _elements(text: str, name: str) -> Iterator[tuple[int, int, int, int]]:
    """Start and end of the opening and of the closing tag of every complete element of a written name, inner ones first."""
    open_: list[tuple[int, int]] = []
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", text):
        if m[0].endswith("/>"):
            yield m.start(), m.end(), m.end(), m.end()
        elif not m[1]:
            open_.append(m.span())
        elif open_:
            start, end = open_.pop()
            yield start, end, m.start(), m.end()


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            out.append(text[at : max(at, start)])
            at = end
    return "".join([*out, text[at:]])


def _rewritten(col: Column, spans: Callable[[str], list[tuple[int, int]]]) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _cut(t, spans(t)))

    return run(col)


def remove_elements(col: Column, name: str, where: str | None = None) -> Column:
    """Without the elements of a written name, with all they hold; with `where`, those whose opening tag matches the pattern."""
    return _rewritten(col, lambda t: [(a, d) for a, b, _, d in _elements(t, name) if where is None or re.search(where, t[a:b])])


def unwrap_elements(col: Column, name: str) -> Column:
    """Without the tags of the elements of a written name; what they hold stays."""
    return _rewritten(col, lambda t: [s for a, b, c, d in _elements(t, name) for s in ((a, b), (c, d))])


def canonical_text(part: str) -> str:
    """A part in one spelling: declaration, namespaces on the root under prefixes in the order of first use, attributes by
    namespace and name, empty elements closed in one tag, no comments or instructions. Raises ParseError if it isn't well formed."""
    root = ElementTree.fromstring(part)
    prefixes: dict[str, str] = {"http://www.w3.org/XML/1998/namespace": "xml"}

    def name(qualified: str) -> str:
        space, _, local = qualified.rpartition("}")
        return f"{prefixes.setdefault(space[1:], f'ns{len(prefixes) - 1}')}:{local}" if space else local

    def quoted(text: str | None, *more: tuple[str, str]) -> str:
        text = text or ""
        for sign, means in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *more):
            text = text.replace(sign, means)
        return text

    out: list[str] = []
    todo: list = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        held = "".join(f' {name(k)}="{quoted(v, (chr(34), "&quot;"), (chr(10), "&#10;"), (chr(9), "&#9;"))}"' for k, v in sorted(node.attrib.items()))
        full = bool(len(node) or node.text)
        out.append(f"<{name(node.tag)}{held}{'>' if full else '/>'}")
        after = [quoted(node.text), *(x for child in node for x in (child, quoted(child.tail))), f"</{name(node.tag)}>"] if full else []
        todo.extend(reversed(after))
    told = "".join(f' xmlns:{p}="{quoted(u)}"' for u, p in prefixes.items() if p != "xml")
    first = re.match(r"<[^\s/>]+", out[0])[0]
    return '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + first + told + out[0][len(first) :] + "".join(out[1:])


@F.pandas_udf(T.StringType())
def canonical(parts: pd.Series) -> pd.Series:
    """`canonical_text` of each part; null if it isn't well formed."""

    def one(part: str | None) -> str | None:
        try:
            return None if part is None else canonical_text(part)
        except (ElementTree.ParseError, ValueError):
            return None

    return parts.map(one)
