"""Office packages and books: what tells about them goes from every part, and what is content is refused."""

import pytest

from plainsift.operators import cleaning, folder
from plainsift.sources import containers, fixtures

NOTE = b"Planted Name"
MAKERS = {"docx": fixtures.docx_named, "xlsx": fixtures.xlsx_file, "pptx": fixtures.pptx_file, "epub": fixtures.epub_file}


def members(data: bytes) -> dict[str, bytes]:
    return {p.more[0]: containers.member_bytes(data, p) for p in containers.parts("zip", data) if p.kind.startswith("member ")}


@pytest.mark.parametrize("kind", MAKERS)
def test_names_go_from_every_member(kind):
    data = MAKERS[kind](NOTE)
    assert containers.recognise(data) == kind
    assert cleaning.residuals(kind, data)
    out = cleaning.clean(kind, data)
    inner = members(out)
    for sign in (NOTE, b"00AA", b"docId", b"attachedTemplate", b"random-of-export", b"2024-05-06", b"people", b"absPath", b"tags/"):
        assert not [n for n, body in inner.items() if sign in body], sign
    assert [n for n, body in inner.items() if b"shown" in body]
    assert containers.recognise(out) == kind
    assert cleaning.residuals(kind, out) == []
    assert cleaning.clean(kind, out) == out
    row, _ = folder.clean_one("x", data)
    assert row["outcome"] == "cleaned", row["notes"]


def test_only_these_parts_of_a_document_change():
    before, after = members(fixtures.docx_named(NOTE)), members(cleaning.clean("docx", fixtures.docx_named(NOTE)))
    assert sorted(set(before) - set(after)) == ["docProps/core.xml", "word/_rels/settings.xml.rels", "word/people.xml"]
    assert after["word/document.xml"] == before["word/document.xml"].replace(b"<!--" + NOTE + b"-->", b"").replace(b' w:rsidR="00AA" w14:paraId="11"', b"")


def test_book_keeps_what_readers_need():
    after = members(cleaning.clean("epub", fixtures.epub_file(NOTE)))
    assert sorted(after) == ["META-INF/container.xml", "mimetype", "o/a.xhtml", "o/b.opf", "o/p.png", "o/t.ncx"]
    opf = after["o/b.opf"]
    assert b"Title" in opf and b">en<" in opf and b"1980-01-01T00:00:00Z" in opf and b"role" not in opf
    identifier = opf.split(b"urn:uuid:")[1][:36]
    assert identifier in after["o/t.ncx"]
    assert b"viewport" in after["o/a.xhtml"]
    assert members(cleaning.clean("epub", fixtures.epub_file(b"Other")))["o/b.opf"] == opf


REFUSED = {
    "docx": [{"word/comments.xml": b"<c/>"}, {"_xmlsignatures/s.xml": b"<c/>"}, {"word/vbaProject.bin": b"x"}, {"word/media/b.bin": b"\0\1"}, {"word/broken.xml": b"<a>"}, {"word/d.xml": b"<!DOCTYPE a><a/>"}],
    "xlsx": [{"xl/comments1.xml": b"<c/>"}, {"xl/connections.xml": b"<c/>"}, {"xl/externalLinks/l.xml": b"<c/>"}, {"xl/pivotCache/pivotCacheRecords1.xml": b"<c/>"}],
    "pptx": [{"ppt/comments/c.xml": b"<c/>"}, {"ppt/embeddings/e.bin": b"x"}],
    "epub": [{"META-INF/rights.xml": b"<c/>"}, {"META-INF/encryption.xml": b'<e xmlns:n="http://www.w3.org/2001/04/xmlenc#"><n:EncryptedData/></e>'}, {"o/p.png": b"\0\1"}],
}


@pytest.mark.parametrize(("kind", "extra"), [(k, e) for k, es in REFUSED.items() for e in es])
def test_refused(kind, extra):
    row, out = folder.clean_one("x", MAKERS[kind](NOTE, extra=extra))
    assert (row["outcome"], out) == ("refused", None)


@pytest.mark.parametrize("tag", [b"ins", b"del", b"rPrChange", b"commentReference", b"cellMerge"])
def test_tracked_changes_are_refused(tag):
    row, _ = folder.clean_one("x", fixtures.docx_named(NOTE, b"<w:" + tag + b' w:author="' + NOTE + b'"/>'))
    assert row["outcome"] == "refused"
    assert "w:" + tag.decode() in row["notes"]


def test_hidden_fonts_follow_the_identifier():
    from plainsift.operators.packages import _font

    way = "http://www.idpf.org/2008/embedding"
    font = b"OTTO" + bytes(range(256)) * 8
    data = fixtures.epub_file(NOTE, {"META-INF/encryption.xml": f'<e xmlns:n="http://www.w3.org/2001/04/xmlenc#"><n:EncryptedData><n:EncryptionMethod Algorithm="{way}"/><n:CipherData><n:CipherReference URI="o/f.otf"/></n:CipherData></n:EncryptedData></e>'.encode(), "o/f.otf": _font(font, "urn:uuid:random-of-export", way)})
    after = members(cleaning.clean("epub", data))
    identifier = "urn:uuid:" + after["o/b.opf"].split(b"urn:uuid:")[1][:36].decode()
    assert after["o/f.otf"] != font
    assert _font(after["o/f.otf"], identifier, way) == font


def test_a_removed_member_is_searched_in_inflated_ones():
    long = b"\0\5\26\7" + bytes(n % 251 for n in range(9000))
    held = lambda value: cleaning.zip_bytes([("a.png", fixtures.png_file(NOTE).replace(b"IDAT", b"IDAT", 1)), ("b.bmp", fixtures.bmp_file(b"")[:-0 or None]), ("__MACOSX/._a", value)])
    row, out = folder.clean_one("x", held(long))
    assert (row["outcome"], row["independent_check"]) == ("cleaned", "none of the removed values found")
    again = cleaning.zip_bytes([("a.txt", long[4:100].hex().encode()), ("__MACOSX/._a", MAC + long[4:100].hex().encode())])
    row, out = folder.clean_one("x", again)
    assert row["outcome"] == "cleaned" and "none of the removed" in row["independent_check"]
    assert members(out) == {"a.txt": long[4:100].hex().encode()}


MAC = b"\0\5\26\7"


def test_members_are_cleaned_by_their_own_rules_at_every_depth():
    row, out = folder.clean_one("x", fixtures.nested_file(NOTE))
    assert row["outcome"] == "cleaned" and row["removed"] >= 6, row
    assert "more.zip: more.zip: a.png: tEXt" in row["removed_fields"]
    inner, held = out, []
    for _ in range(3):
        found = members(inner)
        held += found.values()
        inner = found.get("more.zip", b"")
    assert not any(NOTE in h for h in held)
    assert folder.clean_one("x", out)[1] == out
    deep = out
    for _ in range(cleaning.MAX_NESTED + 2):
        deep = cleaning.zip_bytes([("z.zip", deep)])
    assert "deep" in folder.clean_one("x", deep)[0]["notes"]


def test_unknown_members_refuse_an_archive_by_name():
    row, out = folder.clean_one("x", cleaning.zip_bytes([("a.txt", b"text"), ("d/core.bin", b"\1\2\0"), ("__MACOSX/kept.bin", b"\0\1")]))
    assert (row["outcome"], out) == ("refused", None)
    assert "d/core.bin" in row["notes"] and "__MACOSX/kept.bin" in row["notes"]
    row, out = folder.clean_one("x", cleaning.zip_bytes([("d/", b""), ("e/", b""), ("e/a.txt", b"t"), ("e/.DS_Store", b"\0\0\0\1Bud1 rest")]))
    assert row["outcome"] == "cleaned" and list(members(out)) == ["d/", "e/a.txt"]
    row, _ = folder.clean_one("x", cleaning.zip_bytes([("d/b.docx", fixtures.docx_file(NOTE).replace(b"<w:p", b"<w:p"))]))
    assert row["outcome"] == "cleaned"


def test_an_author_in_another_member_is_found():
    row, out = folder.clean_one("x", fixtures.docx_named(NOTE, extra={"word/numbering.xml": b'<n made="' + NOTE + b'"/>'}))
    assert (row["outcome"], out) == ("refused", None)
    assert "docProps/core.xml dc:creator" in row["notes"]
    row, out = folder.clean_one("x", fixtures.docx_named(NOTE, b"<w:t>by Planted</w:t><w:t> Name</w:t>"))
    assert row["outcome"] == "cleaned" and out is not None
    assert row["independent_check"].startswith("2 removed values stand in shown text: ")
    row, out = folder.clean_one("x", fixtures.epub_file(NOTE, {"o/a.xhtml": b'<html xmlns="http://www.w3.org/1999/xhtml"><body class="' + NOTE + b'"/></html>'}))
    assert (row["outcome"], out) == ("refused", None)


def test_raw_values_of_pictures_are_searched_and_counted():
    import struct

    entry = lambda tag, kind, n, at: struct.pack("<HHII", tag, kind, n, at)
    place = b"place of the shot"
    build = lambda tail: b"II*\0" + struct.pack("<IH", 8, 1) + entry(0x8825, 4, 1, 26) + struct.pack("<I", 0) + struct.pack("<H", 1) + entry(0x001B, 2, len(place), 44) + struct.pack("<I", 0) + place + tail
    row, _ = folder.clean_one("x", build(b""))
    assert (row["outcome"], row["removed"], row["removed_fields"]) == ("cleaned", 1, "GPS 001B")
    assert row["independent_check"] == "none of the removed values found"
    row, _ = folder.clean_one("x", build(b"again " + place))
    assert row["independent_check"] == "disagrees: 1 removed values still readable"


def test_no_search_is_said():
    row, _ = folder.clean_one("x", cleaning.zip_bytes([("a.txt", b"plain")]))
    assert (row["outcome"], row["independent_check"]) == ("cleaned", "not run: no value to search")
