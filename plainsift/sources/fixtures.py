"""Small files of every kind, made from a few values: what the walkers and cleaners are tried on."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plainsift.operators.cleaning import zip_bytes
from plainsift.sources.containers import PNG_HEAD, pack_toyf, png_chunk


def png_file(note: bytes) -> bytes:
    """A grey pixel with a text chunk."""
    return PNG_HEAD + png_chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + png_chunk(b"tEXt", b"Source\0" + note) + png_chunk(b"IDAT", zlib.compress(b"\0\x80")) + png_chunk(b"IEND", b"")


def jpeg_file(note: bytes) -> bytes:
    """Segments of a picture, with a comment and an Exif block; the scan is no real one."""
    segment = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\2\1\0\x48\0\x48\0\0") + segment(0xE1, b"Exif\0\0" + note) + segment(0xFE, note) + segment(0xDB, bytes(65)) + segment(0xC0, bytes(9)) + segment(0xDA, bytes(6)) + b"\x12\xff\0\x34\xff\xd0\x56\xff\xd9"


def gif_file(note: bytes) -> bytes:
    """One pixel with a comment."""
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xfe" + bytes([min(len(note), 255)]) + note[:255] + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"


def webp_file(note: bytes) -> bytes:
    """An extended picture with an Exif chunk."""
    chunk = lambda k, body: k + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = chunk(b"VP8X", bytes([0x08]) + bytes(9)) + chunk(b"VP8 ", b"\1\2\3\4\5") + chunk(b"EXIF", note)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def flac_file(note: bytes) -> bytes:
    """Stream information, a comment block, sound."""
    block = lambda k, body, last=0: bytes([k | last]) + len(body).to_bytes(3, "big") + body
    return b"fLaC" + block(0, bytes(34)) + block(4, struct.pack("<I", len(note)) + note + bytes(4), 0x80) + b"\xff\xf8sound"


def mp3_file(note: bytes) -> bytes:
    """Three frames of 128 kbit/s between two tags."""
    n = len(note) + 10
    size = bytes(n >> s & 127 for s in (21, 14, 7, 0))
    return b"ID3\4\0\0" + size + b"COMM" + struct.pack(">IH", len(note), 0) + note + (b"\xff\xfb\x90\x00" + bytes(413)) * 3 + b"TAG" + note[:125].ljust(125, b"\0")


def bmp_file(note: bytes) -> bytes:
    """Two pixels of 24 bits, the note in the padding of its row and behind it."""
    return b"BM" + struct.pack("<IHHI", 62, 7, 9, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, 8, 2835, 2835, 0, 0) + b"abcdef" + b"\1\2" + note


def svg_file(note: bytes) -> bytes:
    """A drawing with a comment and a metadata element."""
    safe = note.replace(b"&", b"").replace(b"<", b"").replace(b"--", b"")
    safe = bytes(b for b in safe if b >= 32)
    return b'<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg"><!--' + safe + b" --><metadata>" + safe + b'</metadata><rect width="1"/></svg>'


def mp4_file(note: bytes) -> bytes:
    """A type, a movie with one offset table and user data, and media."""
    box = lambda k, body: struct.pack(">I", 8 + len(body)) + k + body
    media = b"media bytes"
    build = lambda at: box(b"ftyp", b"isom\0\0\0\0isom") + box(b"moov", box(b"mvhd", bytes(4) + b"timetime" + bytes(88)) + box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stco", struct.pack(">III", 0, 1, at)))))) + box(b"udta", box(b"name", note)))
    return build(len(build(0)) + 8) + box(b"mdat", media)


def tiff_file(note: bytes) -> bytes:
    """A directory with a software entry."""
    value = note.ljust(5, b" ")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x0100, 3, 1, 1) + struct.pack("<HHII", 0x0131, 2, len(value), 38) + struct.pack("<I", 0) + value


def zip_file(note: bytes) -> bytes:
    """Two members, one of them the attributes a Mac keeps of the other."""
    return zip_bytes([("a.txt", note), ("__MACOSX/._a.txt", b"\0\5\26\7" + note[::-1] + b"!")])


def nested_file(note: bytes, depth: int = 2) -> bytes:
    """A picture and a document with the note, and an archive of the same within, `depth` deep."""
    held = [("a.png", png_file(note)), ("d/b.docx", docx_file(note)), ("read.me", b"plain")]
    return zip_bytes([*held, ("more.zip", nested_file(note, depth - 1))] if depth else held)


def docx_file(note: bytes) -> bytes:
    """A package with core properties."""
    types = b'<Types><Override PartName="/docProps/core.xml" ContentType="x"/><Override PartName="/word/document.xml" ContentType="y"/></Types>'
    return zip_bytes([("[Content_Types].xml", types), ("docProps/core.xml", b"<c>" + note + b"</c>"), ("word/document.xml", b'<w:p w:rsidR="00AA"/>')])


def docx_named(note: bytes, inside: bytes = b"", extra: dict[str, bytes] | None = None) -> bytes:
    """A package whose settings, people, picture and relationships carry the note beside its properties."""
    w = b'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml"'
    rels = lambda *r: b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + b"".join(b'<Relationship Id="rId%d" Type="t" Target="%b"/>' % (n, t) for n, t in enumerate(r)) + b"</Relationships>"
    members = {
        "[Content_Types].xml": b'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="x"/><Override PartName="/word/people.xml" ContentType="x"/></Types>',
        "_rels/.rels": rels(b"word/document.xml", b"docProps/core.xml"),
        "docProps/core.xml": b'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>' + note + b"</dc:creator></c>",
        "word/_rels/document.xml.rels": rels(b"settings.xml", b"people.xml", b"media/a.png"),
        "word/document.xml": b"<w:document " + w + b'><w:body><!--' + note + b'--><w:p w:rsidR="00AA" w14:paraId="11"><w:r><w:t>shown</w:t></w:r>' + inside + b"</w:p></w:body></w:document>",
        "word/settings.xml": b"<w:settings " + w + b'><w:attachedTemplate r:id="rId0" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"/><w:rsids><w:rsidRoot w:val="00AA"/><w:rsid w:val="00AA"/></w:rsids><w14:docId w14:val="1F"/><w15:docId w15:val="{2F}"/></w:settings>',
        "word/_rels/settings.xml.rels": rels(b"x").replace(b'Target="x"', b'Target="file:///' + note + b'" TargetMode="External"'),
        "word/people.xml": b"<w15:people " + w + b'><w15:person w15:author="' + note + b'"/></w15:people>',
        "word/media/a.png": png_file(note),
    }
    return zip_bytes(list((members | (extra or {})).items()))


def xlsx_file(note: bytes, extra: dict[str, bytes] | None = None) -> bytes:
    """A workbook with its folder, a reservation, a sheet's identifier and a string that no cell uses."""
    x = b'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:xr="http://schemas.microsoft.com/office/spreadsheetml/2014/revision"'
    members = {
        "[Content_Types].xml": b"<Types/>",
        "xl/workbook.xml": b"<workbook " + x + b'><fileSharing userName="' + note + b'" readOnlyRecommended="1"/><mc:AlternateContent><mc:Choice Requires="x15"><x15ac:absPath url="' + note + b'" xmlns:x15ac="http://schemas.microsoft.com/office/spreadsheetml/2010/11/ac"/></mc:Choice></mc:AlternateContent><bookViews><workbookView xWindow="5" activeTab="0"/></bookViews></workbook>',
        "xl/worksheets/sheet1.xml": b"<worksheet " + x + b' xr:uid="{00AA}"><sheetData><row><c t="s"><v>1</v></c></row></sheetData></worksheet>',
        "xl/sharedStrings.xml": b"<sst " + x + b"><si><t>" + note + b"</t></si><si><t>shown</t></si></sst>",
    }
    return zip_bytes(list((members | (extra or {})).items()))


def pptx_file(note: bytes, extra: dict[str, bytes] | None = None) -> bytes:
    """A deck with co-authors, an add-in's data, a shape's identifier and the path of a picture."""
    members = {
        "[Content_Types].xml": b"<Types/>",
        "ppt/presentation.xml": b'<p:presentation xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><p:custDataLst><p:tags r:id="rId1"/></p:custDataLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="tags/tag1.xml"/><Relationship Id="rId2" Type="t" Target="slides/slide1.xml"/></Relationships>',
        "ppt/tags/tag1.xml": b"<t>" + note + b"</t>",
        "ppt/changesInfos/c.xml": b"<c>" + note + b"</c>",
        "ppt/slides/slide1.xml": b'<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><p:cNvPr id="1" descr="C:\\Users\\' + note + b'\\a.png"><a:extLst><a:ext uri="{F}"><a16:creationId xmlns:a16="http://schemas.microsoft.com/office/drawing/2014/main" id="{00AA}"/></a:ext></a:extLst></p:cNvPr><a:fld id="{0000AAAA}"/><a:t>shown</a:t></p:sld>',
    }
    return zip_bytes(list((members | (extra or {})).items()))


def epub_file(note: bytes, extra: dict[str, bytes] | None = None) -> bytes:
    """A book that names its author in the package document, the navigation, a chapter's head and a picture."""
    members = {
        "mimetype": b"application/epub+zip",
        "META-INF/container.xml": b'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/b.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "META-INF/calibre_bookmarks.txt": note,
        "o/b.opf": b'<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="u"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title id="t">Title</dc:title><dc:language>en</dc:language>\n<dc:identifier id="u">urn:uuid:random-of-export</dc:identifier>\n<dc:creator id="c">' + note + b'</dc:creator><dc:contributor>' + note + b'</dc:contributor><dc:date>2024-05-06</dc:date><meta refines="#c" property="role">aut</meta><meta property="dcterms:modified">2024-05-06T07:08:09Z</meta><meta name="generator" content="'
        + note + b'"/></metadata><manifest><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="p" href="p.png" media-type="image/png"/></manifest></package>',
        "o/t.ncx": b'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><head><meta name="dtb:uid" content="urn:uuid:random-of-export"/><meta name="made" content="' + note + b'"/></head><docAuthor><text>' + note + b"</text></docAuthor></ncx>",
        "o/a.xhtml": b'<!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml"><head><meta name="author" content="' + note + b'"/><meta name="viewport" content="width=1"/></head><body><p>shown&#160;text</p></body></html>',
        "o/p.png": png_file(note),
        "o/unlisted.txt": note,
    }
    return zip_bytes(list((members | (extra or {})).items()))


def pdf_file(note: bytes) -> bytes:
    """A catalogue, its information and a metadata packet; the cross-reference table is left to readers to rebuild."""
    safe = bytes(b for b in note if b not in b"()\\<>\r\n")
    return b"%PDF-1.4\n1 0 obj<</Type/Catalog/Metadata 3 0 R>>endobj\n2 0 obj<</Author(" + safe + b")>>endobj\n3 0 obj<</Type/Metadata/Length " + str(len(safe)).encode() + b">>stream\n" + safe + b"\nendstream endobj\ntrailer<</Root 1 0 R/Info 2 0 R/ID[<AB12><AB12>]>>\n%%EOF\n"


MAKERS = {
    "toyf": lambda note: pack_toyf(b"content", [(7, note[:65535])]),
    "png": png_file,
    "jpeg": lambda note: jpeg_file(note[:60000]),
    "gif": gif_file,
    "webp": webp_file,
    "flac": flac_file,
    "mp3": mp3_file,
    "bmp": bmp_file,
    "svg": svg_file,
    "mp4": mp4_file,
    "tiff": tiff_file,
    "zip": zip_file,
    "docx": docx_file,
    "pdf": pdf_file,
    "text": lambda note: b"plain text",
    "unknown": lambda note: b"\0\1\2 unknown",
    "empty": lambda note: b"",
}
KINDS = tuple(MAKERS)  # the kinds that queries deal out by number


def made(rows: DataFrame, key: str, kind: str, note: str) -> DataFrame:
    """`<key>, kind, content`: a file of the kind named in each row, with the note in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [MAKERS[k]((n or "").encode("utf-8")) for k, n in zip(batch.column(kind).to_pylist(), batch.column(note).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(kind), pa.array(files, pa.binary())], names=[key, "kind", "content"])

    return rows.select(key, kind, note).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, kind string, content binary")


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + kind + body


def emf_file(note: bytes) -> bytes:
    """A metafile whose only record between its ends is a comment."""
    padded = note + bytes(-len(note) % 4)
    head = (struct.pack("<II", 1, 108) + bytes(32) + b" EMF").ljust(108, b"\0")
    return head + struct.pack("<III", 70, 12 + len(padded), len(note)) + padded + struct.pack("<IIIII", 14, 20, 0, 0, 20)


def wmf_file(note: bytes) -> bytes:
    """A placeable metafile with a comment, a record that sets the window, and its end."""
    padded = note + bytes(len(note) % 2)
    comment = struct.pack("<IHHH", (10 + len(padded)) // 2, 0x0626, 15, len(note)) + padded
    window = struct.pack("<IHHH", 5, 0x020C, 9, 9)
    body = comment + window + struct.pack("<IH", 3, 0)
    return b"\xd7\xcd\xc6\x9a" + bytes(18) + struct.pack("<HHHIHIH", 1, 9, 0x0300, (18 + len(body)) // 2, 0, len(comment) // 2, 0) + body


def built_file(note: bytes) -> bytes:
    """A program for Linux with the name of its compiler and a build identifier, and code that stays."""
    names = b"\0.comment\0.note.gnu.build-id\0.text\0.shstrtab\0"
    held = [(1, 1, note), (10, 7, struct.pack("<III", 4, 20, 3) + b"GNU\0" + note.ljust(20, b"x")[:20]), (29, 1, b"code that stays"), (35, 3, names)]
    at, rows, body = 64, bytes(64), b""
    for name, kind, content in held:
        rows += struct.pack("<IIQQQQ", name, kind, 0, 0, at + len(body), len(content)).ljust(64, b"\0")
        body += content
    head = (b"\x7fELF\2\1\1".ljust(40, b"\0") + struct.pack("<Q", at + len(body))).ljust(58, b"\0") + struct.pack("<HHH", 64, 5, 4)
    return head + body + rows


def dated_program(note: bytes) -> bytes:
    """A program for Windows with a time, a checksum, and debug data that name a file."""
    optional = bytearray(b"\x0b\x02" + bytes(238))
    struct.pack_into("<I", optional, 64, 1234)
    struct.pack_into("<II", optional, 112 + 8 * 6, 0x1000, 28)
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0x5F5E0FF, 0, 0, len(optional), 0) + optional
    start = len(head) + 40
    section = b".rdata\0\0" + struct.pack("<IIII", 28 + len(note), 0x1000, 28 + len(note), start) + bytes(16)
    return head + section + struct.pack("<IIHHIIII", 0, 77, 0, 0, 2, len(note), 0x101C, start + 28) + note


def elf_file(note: bytes) -> bytes:
    """A program with a section of notes and one of names."""
    names = b"\0.note\0.shstrtab\0"
    at = 64 + len(note)
    head = (b"\x7fELF\2\1\1".ljust(40, b"\0") + struct.pack("<Q", at + len(names))).ljust(58, b"\0") + struct.pack("<HHH", 64, 3, 2)
    row = lambda name, kind, place, size: struct.pack("<IIQQQQ", name, kind, 0, 0, place, size).ljust(64, b"\0")
    return head + note + names + bytes(64) + row(1, 7, 64, len(note)) + row(7, 3, at, len(names))


def pe_file(note: bytes) -> bytes:
    """A program for Windows with one section that holds the note."""
    return b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0, 1, 0, 0, 0, 0, 0) + b".text\0\0\0" + struct.pack("<IIII", 0, 0, len(note), 128) + bytes(16) + note


def macho_file(note: bytes) -> bytes:
    """A program for a Mac with an identifier and a command that holds the note."""
    padded = note + bytes(-len(note) % 4)
    return b"\xcf\xfa\xed\xfe" + bytes(12) + struct.pack("<II", 2, 24 + len(padded)) + bytes(8) + struct.pack("<II", 0x1B, 16) + bytes(8) + struct.pack("<II", 0x2A, 8 + len(padded)) + padded


def picture_file(note: bytes) -> bytes:
    """A still picture with an item of pixels and one of Exif, their places and properties; the note is the second's."""
    item = lambda n, kind: _box(b"infe", b"\2\0\0\0" + struct.pack(">HH", n, 0) + kind + b"\0")
    places = b"\1\0\0\0\x44\x40\0\2" + struct.pack(">HHHIHII", 1, 0, 0, 500, 1, 0, 9) + struct.pack(">HHHIHII", 2, 0, 0, 509, 1, 0, len(note))
    owned = struct.pack(">II", 0, 1) + struct.pack(">HB", 1, 2) + b"\x81\x02"
    meta = b"\0\0\0\0" + _box(b"hdlr", bytes(20)) + _box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 2) + item(1, b"hvc1") + item(2, b"Exif")) + _box(b"iref", b"\0\0\0\0" + _box(b"cdsc", struct.pack(">HHH", 2, 1, 1))) + _box(b"iloc", places) + _box(b"iprp", _box(b"ipma", owned))
    return _box(b"ftyp", b"heic\0\0\0\0heic") + _box(b"meta", meta) + _box(b"mdat", bytes(9) + note)


def still_file(note: bytes) -> bytes:
    """A still picture as `picture_file`, with the places that its items really have."""
    made = picture_file(note)
    start = made.index(b"mdat") + 4
    at = made.index(struct.pack(">HHHIHII", 1, 0, 0, 500, 1, 0, 9))
    right = struct.pack(">HHHIHII", 1, 0, 0, start, 1, 0, 9) + struct.pack(">HHHIHII", 2, 0, 0, start + 9, 1, 0, len(note))
    return made[:at] + right + made[at + len(right) :]


def chunked_film(note: bytes) -> bytes:
    """A film of three chunks, the places moved by the length of the note."""
    n = len(note)
    table = _box(b"stco", struct.pack(">IIIII", 0, 3, 100 + n, 200 + n, 300 + n)) + _box(b"stsc", struct.pack(">IIIIIIII", 0, 2, 1, 2, 1, 3, 1, 1)) + _box(b"stsz", struct.pack(">III5I", 0, 0, 5, 1, 2, 3, 4, n))
    return _box(b"ftyp", b"isom") + _box(b"moov", _box(b"trak", _box(b"mdia", _box(b"minf", _box(b"stbl", table)))))


def page_stream(note: bytes) -> bytes:
    """Operations of a page that show three strings, one of them moved by the length of the note."""
    return b"q 1 0 0 1 100 %d cm BT /F1 12 Tf 10 20 Td (a) Tj 5 -7 Td (b) Tj ET Q BT /F2 9.5 Tf 14 TL 2 0 0 2 3 4 Tm T* (c) Tj ET" % len(note)


def attributes_file(note: bytes) -> bytes:
    """The attributes a Mac keeps beside a file: an entry of the finder and one attribute with the note."""
    held = b"ATTR" + bytes(30) + struct.pack(">H", 1) + struct.pack(">IIHB", 50 + 88, len(note), 0, 4) + b"key\0" + b"\0"
    body = (bytes(32) + held).ljust(88, b"\0") + note
    return b"\0\5\26\7" + bytes(20) + struct.pack(">H", 1) + struct.pack(">III", 9, 50, len(body)) + bytes(12) + body


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


#: For each reader of structures inside parts, what it reads, made with a note.
INNER = {
    "vorbis_comments": lambda note: struct.pack("<I", 1) + b"v" + struct.pack("<II", 1, 7 + len(note)) + b"artist=" + note,
    "id3_frames": lambda note: b"ID3\4\0\0" + _syncsafe(11 + len(note)) + b"TIT2" + _syncsafe(1 + len(note)) + b"\0\0\3" + note,
    "photoshop_resources": lambda note: b"Photoshop 3.0\0" + b"8BIM\4\4\0\0" + struct.pack(">I", len(note)) + note + bytes(len(note) % 2),
    "iptc_datasets": lambda note: b"\x1c\2\x50" + struct.pack(">H", len(note)) + note,
    "apple_attributes": attributes_file,
    "package_relations": docx_file,
    "media_chunks": chunked_film,
    "picture_items": picture_file,
    "item_places": picture_file,
    "content_operations": page_stream,
    "page_positions": page_stream,
    "sound_frames": mp3_file,
    "pe_sections": pe_file,
    "macho_commands": macho_file,
    "wmf_records": lambda note: bytes(18) + struct.pack("<IH", 3 + (len(note) + 1) // 2, 0x0626) + note + bytes(len(note) % 2) + struct.pack("<IH", 3, 0),
}
MAKERS |= {"nested": nested_file, "heic": lambda note: still_file(note), "windows metafile": wmf_file, "built": built_file, "dated": dated_program, "mac": lambda note: macho_file(note), "metafile": emf_file, "exe": elf_file, **{f"inner {reader}": make for reader, make in INNER.items()}}
