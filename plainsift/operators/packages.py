"""Light cleaning of office packages and books: parts, elements and attributes that only tell about a document go.

Everything is a deletion, or a value replaced in place; no part is written anew. What a document shows or uses and what
names people at once (tracked changes, comments, data connections, signatures, macros) is refused. Names are compared by
their namespace, whatever prefix a part writes; a prefix that is never bound counts as written.
"""

from __future__ import annotations

import base64
import hashlib
import html
import posixpath
import re
import urllib.parse
from collections.abc import Callable
from xml.parsers import expat

from plainsift.operators.beside import sidecar
from plainsift.sources.containers import Malformed, recognise

# The namespaces that rules name, each by one prefix; both spellings of the office standard count as one.
SPACES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w", "http://purl.oclc.org/ooxml/wordprocessingml/main": "w",
    "http://schemas.openxmlformats.org/spreadsheetml/2006/main": "x", "http://purl.oclc.org/ooxml/spreadsheetml/main": "x",
    "http://schemas.openxmlformats.org/presentationml/2006/main": "p", "http://purl.oclc.org/ooxml/presentationml/main": "p",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a", "http://purl.oclc.org/ooxml/drawingml/main": "a",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r", "http://purl.oclc.org/ooxml/officeDocument/relationships": "r",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing": "wp", "http://schemas.openxmlformats.org/markup-compatibility/2006": "mc",
    "http://schemas.microsoft.com/office/spreadsheetml/2010/11/ac": "x15ac", "http://schemas.microsoft.com/office/drawing/2014/main": "a16",
    "http://schemas.microsoft.com/office/powerpoint/2010/main": "p14", "urn:schemas-microsoft-com:vml": "v", "urn:schemas-microsoft-com:office:office": "o",
    "http://schemas.openxmlformats.org/package/2006/relationships": "", "http://schemas.openxmlformats.org/package/2006/content-types": "",
    "http://www.idpf.org/2007/opf": "opf", "http://purl.org/dc/elements/1.1/": "dc", "http://www.daisy.org/z3986/2005/ncx/": "ncx",
    "http://www.w3.org/1999/xhtml": "h", "http://www.w3.org/2000/svg": "svg", "urn:oasis:names:tc:opendocument:xmlns:container": "ocf",
    "http://www.w3.org/2001/04/xmlenc#": "enc",
}
FAMILIES = ((re.compile(r"http://schemas\.microsoft\.com/office/word/20\d\d/.*|w1\d\w*"), "w14"), (re.compile(r"http://schemas\.microsoft\.com/office/spreadsheetml/20\d\d/revision\d*|xr\d*"), "xr"))

_SHARED_GONE = r"docProps/(?:core|app|custom|meta)\.xml|docProps/thumbnail\.\w+|customXml/.*|__MACOSX/.*|(?:.*/)?(?:\.DS_Store|Thumbs\.db|\._.*)"
GONE = {
    "docx": re.compile(_SHARED_GONE + r"|word/people\.xml|word/(?:webextensions|printerSettings)/.*"),
    "xlsx": re.compile(_SHARED_GONE + r"|xl/(?:printerSettings|webextensions|persons)/.*"),
    "pptx": re.compile(_SHARED_GONE + r"|ppt/(?:printerSettings|webextensions|tags|changesInfos)/.*|ppt/(?:revisionInfo|viewProps|commentAuthors|authors)\.xml"),
}
_SHARED_REFUSED = {
    r"_xmlsignatures/.*": "a digital signature", r"(?:.*/)?vbaProject\.bin": "macros", r"(?:word|xl|ppt)/embeddings/.*": "an embedded object",
    r"(?:.*/)?(?:EncryptedPackage|EncryptionInfo)": "an encrypted package", r"(?:word|xl|ppt)/activeX/.*": "a binary control",
}
REFUSED_PARTS = {
    "docx": _SHARED_REFUSED | {r"word/comments.*\.xml|word/threadedComments/.*": "comments"},
    "xlsx": _SHARED_REFUSED | {
        r"xl/comments\d*\.xml|xl/threadedComments/.*": "comments", r"xl/revisions/.*": "a log of changes", r"xl/externalLinks/.*": "a link to another workbook",
        r"xl/pivotCache/pivotCacheRecords.*": "a pivot table's copy of its data", r"xl/connections\.xml|xl/queryTables/.*": "a data connection", r"xl/model/.*": "a data model",
    },
    "pptx": _SHARED_REFUSED | {r"ppt/comments/.*": "comments", r"ppt/fonts/.*": "embedded fonts"},
}
REFUSED_ELEMENTS = frozenset(f"w:{n}" for n in "ins del moveFrom moveTo commentReference rPrChange pPrChange sectPrChange tblPrChange tblPrExChange trPrChange tcPrChange tblGridChange numberingChange cellIns cellDel cellMerge".split())
GONE_ELEMENTS = {
    "docx": frozenset("w:rsids w:rsid w:rsidRoot w14:docId w:attachedTemplate w:proofState w:proofErr w:lastRenderedPageBreak w:documentProtection w:mailMerge w:writeProtection w:docVars w:permStart w:permEnd".split()),
    "xlsx": frozenset("xr:revisionPtr x:selection x:customWorkbookViews x:customSheetViews x:securityDescriptor x15ac:absPath".split()),
    "pptx": frozenset(),
}
#: Marks of sessions and windows: they go with no count, as one stands at nearly every element.
MARKS = {"docx": re.compile(r"w:rsid\w*|w14:(?:paraId|textId)"), "xlsx": re.compile(r"xr:.*"), "pptx": re.compile(r"(?!)")}
CREDENTIALS = re.compile(r"(?:workbook|revisions)?(?:[pP]assword|[hH]ashValue|[sS]altValue|[sS]pinCount|[aA]lgorithmName)|securityDescriptor|reservationPassword|userName")
CREDENTIAL_ELEMENTS = frozenset("x:workbookProtection x:sheetProtection x:protectedRange x:fileSharing".split())
OBJECT_IDS = frozenset("a16:creationId a16:rowId a16:colId a16:predDERef p14:creationId".split())
FILE_LIKE = re.compile(r"""\.(?:jpe?g|jpe|png|gif|bmp|tiff?|emf|wmf|heic|webp|svg|wdp)\b|(?:^|[\s("'])(?:[A-Za-z]:\\|\\\\[\w$.-]+\\|file:/)|/(?:Users|home)/""", re.I)
ARCHIVES = ("docx", "xlsx", "pptx", "epub", "zip")

_TAG = re.compile(rb"""<(?:[^"'>]|"[^"]*"|'[^']*')*>""")
_ATTRIBUTE = re.compile(rb"""\s+([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
Told = list[tuple[str, bytes]]
Clean = Callable[[str, bytes], bytes]


class Element:
    """An element with its place in the bytes of its part; `spaces` are the prefixes bound there."""

    __slots__ = ("attrs", "children", "end", "inner_end", "name", "open_end", "parent", "spaces", "start", "text")

    def __init__(self, name: str, attrs: dict, start: int, open_end: int, parent: Element | None, spaces: dict):
        self.name, self.attrs, self.start, self.open_end, self.parent, self.spaces = name, attrs, start, open_end, parent, spaces
        self.end = self.inner_end = open_end
        self.children: list[Element] = []
        self.text = ""


def _canonical(written: str, spaces: dict, attribute: bool = False) -> str:
    prefix, _, local = written.rpartition(":")
    if attribute and not prefix:
        return local
    space = spaces.get(prefix, prefix)
    short = SPACES.get(space)
    if short is None:
        short = next((s for rule, s in FAMILIES if rule.fullmatch(space)), space)
    return f"{short}:{local}" if short else local


def tree(data: bytes, what: str, doctype: bool = False) -> tuple[list[Element], list[tuple[int, int]]]:
    """The elements of a part in order, and the spans of its comments and instructions. Malformed if it isn't XML."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise Malformed(f"{what}: UTF-16 text")
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    found, notes, stack = [], [], []

    def start(name: str, attrs: list) -> None:
        at, up = parser.CurrentByteIndex, stack[-1] if stack else None
        pairs = list(zip(attrs[::2], attrs[1::2], strict=True))
        spaces = up.spaces if up else {}
        bound = {k[6:]: v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
        spaces = {**spaces, **bound} if bound else spaces
        tag = _TAG.match(data, at)
        if tag is None:
            raise Malformed(f"{what}: a start tag with no end")
        el = Element(_canonical(name, spaces), {_canonical(k, spaces, True): v for k, v in pairs if not k.startswith("xmlns")}, at, tag.end(), up, spaces)
        if up:
            up.children.append(el)
        stack.append(el)
        found.append(el)

    def stop(_: str) -> None:
        el = stack.pop()
        if data[el.open_end - 2 : el.open_end - 1] != b"/":
            el.inner_end = parser.CurrentByteIndex
            el.end = data.find(b">", el.inner_end) + 1

    def chars(text: str) -> None:
        if stack:
            stack[-1].text += text

    def note(end: bytes) -> Callable:
        def seen(*said: str) -> None:
            at = parser.CurrentByteIndex
            if len(said) == 1 or not (doctype and said[0] == "xml-stylesheet"):
                notes.append((at, data.find(end, at) + len(end)))

        return seen

    def refuse(reason: str) -> Callable:
        def seen(*_: object) -> None:
            raise Malformed(f"{what}: {reason}")

        return seen

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, stop, chars
    parser.CommentHandler, parser.ProcessingInstructionHandler = note(b"-->"), note(b"?>")
    parser.EntityDeclHandler = parser.ExternalEntityRefHandler = refuse("an entity is declared")
    if not doctype:
        parser.StartDoctypeDeclHandler = refuse("a document type is declared")
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, LookupError, ValueError) as e:
        if isinstance(e, Malformed):
            raise
        raise Malformed(f"{what}: not well-formed") from e
    return found, notes


def _attributes(data: bytes, el: Element) -> list[tuple[str, str, int, int, int, int]]:
    """Name and value of each attribute, the place of the whole and the place of the value."""
    out = []
    for m in _ATTRIBUTE.finditer(data, el.start, el.open_end):
        k = 2 if m[2] is not None else 3
        out.append((_canonical(m[1].decode("utf-8", "replace"), el.spaces, True), html.unescape(m[k].decode("utf-8", "replace")), m.start(), m.end(), *m.span(k)))
    return out


def _spliced(data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Every place replaced; what lies within a replaced place goes with it."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start >= at:
            out += [data[at:start], new]
            at = end
    return b"".join([*out, data[at:]])


def _words(data: bytes, el: Element) -> bytes:
    """What an element says: its text and the values of its attributes, with those of its children."""
    text = re.sub(rb"<[^>]*>", b" ", data[el.start : el.end])
    tags = b" ".join(b" ".join(a or b for _, a, b in _ATTRIBUTE.findall(t)) for t in _TAG.findall(data[el.start : el.end]))
    return b" ".join((text + b" " + tags).split())


def _resolved(source: str, target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(source), target)).lstrip("/")


def _source(rels: str) -> str:
    base = posixpath.basename(rels)[: -len(".rels")]
    return posixpath.join(posixpath.dirname(posixpath.dirname(rels)), base) if base else ""


def _relations(name: str, data: bytes) -> list[tuple[Element, str, bool]]:
    """Each relationship with the part it leads to, and whether it leads out of the package."""
    out = []
    for el in tree(data, name)[0]:
        if el.name == "Relationship":
            outside = el.attrs.get("TargetMode") == "External"
            out.append((el, el.attrs.get("Target", "") if outside else _resolved(_source(name), el.attrs.get("Target", "")), outside))
    return out


def _broken(members: dict[str, bytes]) -> list[str]:
    return [f"{name}: {target}" for name, data in members.items() if name.endswith(".rels") and _source(name) in (*members, "") for _, target, outside in _relations(name, data) if not outside and target not in members]


def embedded(name: str, data: bytes, cleaners: Clean, text: bool = False) -> bytes:
    """A file within a package by the rules of its own kind; refused if it has none."""
    kind = recognise(data)
    if kind is None and text and (not data or _is_text(data)):
        return data
    if kind is None or kind in ARCHIVES:
        raise Malformed(f"{name}: an embedded file no rule reads")
    return cleaners(kind, data)


def _is_text(data: bytes) -> bool:
    from plainsift.operators.folder import is_text

    return is_text(data)


def _wrapped(el: Element) -> Element:
    """The outermost alternative that holds nothing but this element."""
    while el.parent and el.parent.name in ("mc:Choice", "mc:AlternateContent") and len(el.parent.children) == 1:
        el = el.parent
    return el


def _field_ids(name: str, data: bytes) -> bytes:
    """Text fields' identifiers, which a save draws anew, as ones derived from the part."""
    places = [(b[4], b[5]) for el in tree(data, name)[0] if el.name == "a:fld" for b in _attributes(data, el) if b[0] == "id"] if b"fld" in data else []
    if not places:
        return data
    blank = _spliced(data, [(a, b, b"{00000000-0000-8000-8000-000000000000}") for a, b in places])
    return _spliced(data, [(a, b, f"{{{_uuid(name.encode() + bytes(1) + blank + bytes(1) + str(n).encode()).upper()}}}".encode()) for n, (a, b) in enumerate(places)])


def _uuid(data: bytes) -> str:
    b = bytearray(hashlib.sha256(data).digest()[:16])
    b[6], b[8] = b[6] & 0x0F | 0x80, b[8] & 0x3F | 0x80
    x = b.hex()
    return f"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"


def _strings_used(members: dict[str, bytes]) -> set[int]:
    used = set()
    for name, data in members.items():
        if name.endswith(".xml") and name != "xl/sharedStrings.xml" and b"spreadsheetml" in data:
            for el in tree(data, name)[0]:
                if el.name == "x:v" and el.parent and el.parent.name == "x:c" and el.parent.attrs.get("t") == "s":
                    if not re.fullmatch(r"\s*[0-9]{1,9}\s*", el.text):
                        raise Malformed(f"{name}: a cell's string isn't a number")
                    used.add(int(el.text))
    return used


def _office_part(kind: str, name: str, data: bytes, lost: set[str], used: set[int], told: Told) -> bytes:
    """A part without what only tells about the document; `lost` are its relationships to parts that go."""
    els, notes = tree(data, name)
    edits = [(a, b, b"") for a, b in notes]
    told += [(f"{name}: note", data[a:b]) for a, b in notes]
    back = {el.attrs.get("w:id") for el in els if el.name == "w:bookmarkStart" and el.attrs.get("w:name") == "_GoBack"}
    strings = [el for el in els if el.name == "x:si" and el.parent is els[0]] if name == "xl/sharedStrings.xml" else []

    until = 0

    def cut(el: Element, what: str | None = None) -> None:
        nonlocal until
        until = el.end
        edits.append((el.start, el.end, b""))
        told.append((f"{name}: {what or el.name}", _words(data, el)))

    def only_ids(el: Element) -> bool:
        return el.name in ("a:ext", "p:ext") and bool(el.children) and all(c.name in OBJECT_IDS for c in el.children)

    for n, el in enumerate(strings):
        if n not in used and re.sub(rb"<[^>]*>|\s", b"", data[el.open_end : el.inner_end]):
            tag = data[el.start : el.open_end].split(None, 1)[0].strip(b"</>")
            edits.append((el.open_end, el.inner_end, b"<" + tag.removesuffix(b"si") + b"t/>"))
            told.append((f"{name}: unused string", _words(data, el)))
    for el in els:
        if el.start < until:  # goes with what it stands in
            continue
        if el.name in GONE_ELEMENTS[kind]:
            cut(_wrapped(el) if el.name == "x15ac:absPath" else el, el.name)
        elif el.name == "w:bookmarkStart" and el.attrs.get("w:name") == "_GoBack":
            cut(el)
        elif el.name == "w:bookmarkEnd" and el.attrs.get("w:id") in back:
            edits.append((el.start, el.end, b""))
        elif kind == "pptx" and el.name in ("a:extLst", "p:extLst") and el.children and all(map(only_ids, el.children)):
            cut(el, "object identifier")
        elif kind == "pptx" and only_ids(el):
            cut(el, "object identifier")
        elif name == "ppt/presProps.xml" and el.name == "p:clrMru":
            cut(el)
        elif el.name == "p:custDataLst" and all(c.attrs.get("r:id") in lost for c in el.children):
            edits.append((el.start, el.end, b""))
        elif el.name in ("p:tags", "p:custData") and el.attrs.get("r:id") in lost:
            edits.append((el.start, el.end, b""))
        else:
            drawing = el.name.endswith(":cNvPr") or el.name in ("cNvPr", "wp:docPr", "v:imagedata", "v:shape")
            for k, value, start, end, a, b in _attributes(data, el):
                if MARKS[kind].fullmatch(k) or (el.name in ("x:workbookView", "x:customWorkbookView") and k in ("xWindow", "yWindow", "windowWidth", "windowHeight")) or (k == "r:id" and value in lost):
                    edits.append((start, end, b""))
                elif (
                    (el.name in CREDENTIAL_ELEMENTS and CREDENTIALS.fullmatch(k))
                    or (name.startswith("xl/pivotCache/pivotCacheDefinition") and k in ("refreshedBy", "refreshedDate", "refreshedDateIso"))
                    or (el.name == "a:blip" and k == "r:link" and "r:embed" in el.attrs)
                    or (el.name == "v:imagedata" and k == "o:href" and "r:id" in el.attrs)
                ):
                    edits.append((start, end, b""))
                    told.append((f"{name}: {el.name} {k}", value.encode()))
                elif drawing and value and k in ("name", "descr", "title", "o:title", "alt") and (FILE_LIKE.search(value) or (el.name, k) == ("v:imagedata", "o:title")):
                    edits.append((a, b, b""))
                    told.append((f"{name}: {el.name} {k}", value.encode()))
    return _field_ids(name, _spliced(data, edits))


def _vml(name: str, data: bytes, told: Told) -> bytes:
    """A legacy drawing, which needn't be well-formed: names of files and paths of links."""

    def tag(m: re.Match) -> bytes:
        edits, seen = [], {k for k, _, _ in _ATTRIBUTE.findall(m[0])}
        for a in _ATTRIBUTE.finditer(m[0]):
            k, g = a[1], 2 if a[2] is not None else 3
            if m[1] == b"imagedata" and k == b"o:href" and seen & {b"r:id", b"o:relid"}:
                edits.append((*a.span(), b""))
            elif a[g] and k in (b"name", b"descr", b"title", b"o:title", b"alt") and ((m[1], k) == (b"imagedata", b"o:title") or FILE_LIKE.search(a[g].decode("utf-8", "replace"))):
                edits.append((*a.span(g), b""))
            else:
                continue
            told.append((f"{name}: {m[1].decode()} {k.decode()}", a[g]))
        return _spliced(m[0], edits)

    return re.sub(rb"""<v:(imagedata|shape)(?=[\s/>])(?:[^"'>]|"[^"]*"|'[^']*')*>""", tag, data)


def office(kind: str, members: dict[str, bytes], cleaners: Clean) -> tuple[dict[str, bytes], Told]:
    """The members of a cleaned package, and what was taken from parts that stay."""
    if "[Content_Types].xml" not in members:
        raise Malformed("a package without its content types")
    files = {n: d for n, d in members.items() if not n.endswith("/")}
    for name, data in files.items():
        for rule, what in REFUSED_PARTS[kind].items():
            if re.fullmatch(rule, name):
                raise Malformed(f"{name}: {what}")
        if kind == "xlsx" and name.startswith("customXml/") and b"DataMashup" in data.replace(b"\0", b""):
            raise Malformed(f"{name}: a data query")
    gone = {n for n in files if GONE[kind].fullmatch(n)}
    if broken := _broken(files):
        raise Malformed("relationships to parts that aren't there: " + "; ".join(broken))
    lost: dict[str, set[str]] = {}
    for name in files:
        if name.endswith(".rels") and name not in gone:
            lost[_source(name)] = {el.attrs.get("Id", "") for el, target, outside in _relations(name, files[name]) if not outside and target in gone}
    used = _strings_used({n: d for n, d in files.items() if n not in gone}) if kind == "xlsx" else set()
    kept, told = {}, []
    for name, data in files.items():
        if name in gone:
            continue
        if name == "[Content_Types].xml":
            els, notes = tree(data, name)
            data = _spliced(data, [(a, b, b"") for a, b in notes] + [(el.start, el.end, b"") for el in els if el.name == "Override" and el.attrs.get("PartName", "").lstrip("/") in gone])
        elif name.endswith(".rels"):
            cuts = [(el.start, el.end, b"") for el, target, outside in _relations(name, data) if not outside and target in gone]
            data = _spliced(data, cuts + [(a, b, b"") for a, b in tree(data, name)[1]])
        elif name.endswith(".xml"):
            if kind == "docx" and (seen := {el.name for el in tree(data, name)[0]} & REFUSED_ELEMENTS):
                raise Malformed(f"{name}: tracked changes or comments ({', '.join(sorted(seen))})")
            data = _office_part(kind, name, data, lost.get(name, set()), used, told)
        elif name.endswith(".vml"):
            data = _vml(name, data, told)
        elif kind != "docx" or name.startswith("word/media/") or (not name.endswith(".odttf") and recognise(data) is not None):
            data = embedded(name, data, cleaners)
        kept[name] = data
    for name in [n for n in kept if n.endswith(".rels")]:  # what nothing refers to any more
        source = _source(name)
        if source in kept:
            named = {v for a, b in re.findall(rb"""=\s*(?:"([^"]*)"|'([^']*)')""", kept[source]) for v in (a, b)}
            cuts = []
            for el, target, outside in _relations(name, kept[name]):
                if (outside or name == "word/_rels/settings.xml.rels") and el.attrs.get("Id", "").encode() not in named:
                    cuts.append((el.start, el.end, b""))
                    told.append((f"{name}: unused relationship", target.encode()))
            kept[name] = _spliced(kept[name], cuts)
        if not _relations(name, kept[name]):
            del kept[name]
    if broken := _broken(kept):
        raise Malformed("relationships left without parts: " + "; ".join(broken))
    return kept, told


# Books. What a reading system needs, and what is no part of a book.
KEPT_PROPERTIES = re.compile(r"media:(?:duration|active-class|playback-active-class)|ibooks:specified-fonts|rendition:.*|schema:access.*")
KEPT_META_INF = frozenset(f"META-INF/{n}" for n in ("container.xml", "encryption.xml", "com.apple.ibooks.display-options.xml"))
AUTHOR_LINKS = frozenset("author me meta schema.dc schema.dcterms".split())
CHAPTERS = frozenset(["application/xhtml+xml", "text/html", "text/x-oeb1-document"])
MODIFIED = "1980-01-01T00:00:00Z"
NO_ID = "urn:uuid:00000000-0000-8000-8000-000000000000"
HIDDEN_FONTS = {"http://www.idpf.org/2008/embedding": 1040, "http://ns.adobe.com/pdf/enc#RC": 1024}


def _tidy(data: bytes, el: Element) -> tuple[int, int, bytes]:
    """The place of an element with the blanks before it, where it stands on a line of its own."""
    start = el.start
    while data[start - 1 : start] in (b" ", b"\t", b"\r", b"\n"):
        start -= 1
    return (start if data[start - 1 : start] == b">" else el.start), el.end, b""


def _text(data: bytes, el: Element, value: str) -> tuple[int, int, bytes]:
    if el.children:
        raise Malformed(f"{el.name} holds elements")
    new = html.escape(value, quote=False).encode()
    if el.open_end != el.end:
        return el.open_end, el.inner_end, new
    tag = data[el.start : el.open_end]
    return el.start, el.end, tag[:-2].rstrip() + b">" + new + b"</" + re.match(rb"<([^\s/>]+)", tag)[1] + b">"


def _opf(name: str, data: bytes, identifier: str, told: Told) -> bytes:
    els, notes = tree(data, name, True)
    edits = [(a, b, b"") for a, b in notes]
    told += [(f"{name}: note", data[a:b]) for a, b in notes]
    unique = els[0].attrs.get("unique-identifier", "")
    titles = {el.attrs["id"] for el in els if el.name == "dc:title" and "id" in el.attrs}
    wrappers = ("opf:dc-metadata", "opf:x-metadata", "opf:metadata")
    for el in els:
        if el.parent is None or el.parent.name not in wrappers or el.name in wrappers:
            continue
        prop, about = el.attrs.get("property"), el.attrs.get("refines", "")
        if el.name in ("dc:title", "dc:language") or (el.name == "opf:meta" and prop is None and el.attrs.get("name") == "cover"):
            continue
        if el.name == "dc:identifier" and el.attrs.get("id") == unique:
            if el.text.strip() != identifier:
                told.append((f"{name}: dc:identifier", el.text.strip().encode()))
            edits.append(_text(data, el, identifier))
            edits += [(s, e, b"") for k, _, s, e, _, _ in _attributes(data, el) if k.rpartition(":")[2] == "scheme" and el.open_end != el.end]
        elif el.name == "opf:meta" and prop == "dcterms:modified" and not about:
            if el.text.strip() != MODIFIED:
                told.append((f"{name}: dcterms:modified", el.text.strip().encode()))
            edits.append(_text(data, el, MODIFIED))
        elif el.name == "opf:meta" and prop and ((prop == "media:duration" or (prop in ("title-type", "display-seq", "alternate-script") and about.lstrip("#") in titles)) if about else KEPT_PROPERTIES.fullmatch(prop)):
            continue
        else:
            edits.append(_tidy(data, el))
            said = el.text.strip() or el.attrs.get("content") or el.attrs.get("href") or ""
            told.append((f"{name}: {el.name if el.name.startswith('dc:') else prop or el.attrs.get('name') or el.name}", said.encode()))
    return _spliced(data, edits)


def _ncx(name: str, data: bytes, identifier: str, told: Told) -> bytes:
    els, notes = tree(data, name, True)
    edits = [(a, b, b"") for a, b in notes]
    told += [(f"{name}: note", data[a:b]) for a, b in notes]
    for el in els:
        if el.name == "ncx:docAuthor":
            edits.append(_tidy(data, el))
            told.append((f"{name}: docAuthor", _words(data, el)))
        elif el.name == "ncx:meta" and el.parent and el.parent.name == "ncx:head":
            called = el.attrs.get("name", "")
            if called not in ("dtb:uid", "dtb:depth", "dtb:totalPageCount", "dtb:maxPageNumber", ""):
                edits.append(_tidy(data, el))
                told.append((f"{name}: {called}", el.attrs.get("content", "").encode()))
            elif called == "dtb:uid":
                edits += [(a, b, html.escape(identifier).encode()) for k, _, _, _, a, b in _attributes(data, el) if k == "content"]
    return _spliced(data, edits)


def _chapter(name: str, data: bytes, cleaners: Clean, told: Told) -> bytes:
    def inlined(m: re.Match) -> bytes:
        try:
            body = base64.b64decode(urllib.parse.unquote_to_bytes(re.sub(rb"\s", b"", m[2])), validate=True)
        except ValueError as e:
            raise Malformed(f"{name}: an inlined file that doesn't decode") from e
        return m[1] + base64.b64encode(embedded(f"{name}: inlined", body, cleaners, True))

    data = re.sub(rb"(data:[\w.+/-]*(?:;[\w.=-]+)*;base64,)([A-Za-z0-9+/=%\s]*)", inlined, data)
    els, notes = tree(data, name, True)
    edits = [(a, b, b"") for a, b in notes]
    told += [(f"{name}: note", data[a:b]) for a, b in notes]
    for el in els:
        named = el.attrs.get("name") or el.attrs.get("property")
        if (el.name == "h:meta" and named and named.lower() != "viewport") or (el.name == "h:link" and AUTHOR_LINKS & set(el.attrs.get("rel", "").lower().split())) or el.name == "svg:metadata":
            edits.append(_tidy(data, el) if el.parent and el.parent.name == "h:head" else (el.start, el.end, b""))
            told.append((f"{name}: {el.name} {named or ''}".strip(), (el.attrs.get("content") or el.attrs.get("href") or "").encode() or _words(data, el)))
    return _spliced(data, edits)


def _font(data: bytes, identifier: str, algorithm: str) -> bytes:
    """A font hidden by, or freed from, the book's identifier."""
    if algorithm.endswith("embedding"):
        key = hashlib.sha1(re.sub(r"[ \t\r\n]", "", identifier).encode()).digest()
    else:
        digits = re.sub(r"(?i)^urn:uuid:|-", "", identifier.strip())
        if not re.fullmatch(r"[0-9a-fA-F]{32}", digits):
            raise Malformed("a font is hidden by an identifier that is no UUID")
        key = bytes.fromhex(digits)
    n = min(len(data), HIDDEN_FONTS[algorithm])
    return bytes(b ^ key[i % len(key)] for i, b in enumerate(data[:n])) + data[n:]


def epub(members: dict[str, bytes], cleaners: Clean) -> tuple[dict[str, bytes], Told, set[str]]:
    """The members of a cleaned book, what was taken from those that stay, and the names of those that go."""
    if members.get("mimetype", b"").strip() != b"application/epub+zip":
        raise Malformed("a book without its type")
    for name in ("META-INF/rights.xml", "META-INF/signatures.xml"):
        if name in members:
            raise Malformed(f"{name}: rights or signatures")
    roots = [el.attrs.get("full-path") for el in tree(members["META-INF/container.xml"], "META-INF/container.xml")[0] if el.name == "ocf:rootfile" and el.attrs.get("media-type") == "application/oebps-package+xml"]
    if len(roots) != 1 or roots[0] not in members:
        raise Malformed("a book without one package document")
    opf = roots[0]
    els, _ = tree(members[opf], opf, True)
    if els[0].name != "opf:package":
        raise Malformed(f"{opf}: not a package document")
    old = next((el.text.strip() for el in els if el.name == "dc:identifier" and el.attrs.get("id") == els[0].attrs.get("unique-identifier", "")), "")
    listed = {}
    for el in els:
        href = el.attrs.get("href", "")
        if el.name == "opf:item" and not re.match(r"[a-z][a-z0-9+.-]*:", href, re.I):
            listed[posixpath.normpath(posixpath.join(posixpath.dirname(opf), urllib.parse.unquote(href.split("#")[0])))] = el.attrs.get("media-type", "").lower()
    fonts = {}
    if "META-INF/encryption.xml" in members:
        for el in tree(members["META-INF/encryption.xml"], "META-INF/encryption.xml")[0]:
            if el.name == "enc:EncryptedKey":
                raise Malformed("an encrypted book")
            if el.name == "enc:EncryptedData":
                ways = [c.attrs.get("Algorithm", "") for c in el.children if c.name == "enc:EncryptionMethod"]
                refs = [r.attrs.get("URI", "") for c in el.children if c.name == "enc:CipherData" for r in c.children]
                if len(ways) != 1 or ways[0] not in HIDDEN_FONTS or len(refs) != 1 or not refs[0]:
                    raise Malformed("an encrypted book")
                fonts[urllib.parse.unquote(refs[0])] = ways[0]
    kept, late, told = {}, {}, []
    for name, data in members.items():
        kind = listed.get(name)
        if name.endswith("/") or name == "mimetype" or sidecar(name, data[:64]):
            continue
        if name == opf or kind == "application/x-dtbncx+xml":
            late[name] = _opf if name == opf else _ncx
        elif name in KEPT_META_INF:
            notes = tree(data, name, True)[1]
            told += [(f"{name}: note", data[a:b]) for a, b in notes]
            kept[name] = _spliced(data, [(a, b, b"") for a, b in notes])
        elif name.startswith("META-INF/") or (kind is None and name not in fonts):
            continue
        elif name in fonts:
            kept[name] = _font(data, old, fonts[name])
            if not old or kept[name][:4] not in (b"\0\1\0\0", b"OTTO", b"true", b"wOFF", b"wOF2", b"ttcf"):
                raise Malformed(f"{name}: a font the book's identifier doesn't free")
        elif kind in CHAPTERS:
            kept[name] = _chapter(name, data, cleaners, told)
        elif kind.startswith(("font/", "application/font", "application/x-font", "application/vnd.ms-opentype")):
            kept[name] = data
        else:
            kept[name] = embedded(name, data, cleaners, True)

    def whole(identifier: str, told: Told) -> dict[str, bytes]:
        return kept | {name: rule(name, members[name], identifier, told) for name, rule in late.items()}

    first = whole(NO_ID, [])
    identifier = "urn:uuid:" + _uuid(b"".join(n.encode() + b"\0" + hashlib.sha256(first[n]).digest() for n in sorted(first)))
    out = whole(identifier, told)
    out |= {n: _font(out[n], identifier, way) for n, way in fonts.items() if n in out}
    gone = {n for n in members if n not in out and n != "mimetype" and not n.endswith("/")}
    return {"mimetype": b"application/epub+zip"} | out, told, gone
