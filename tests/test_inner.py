"""Structures inside parts."""

import json
import struct

import pytest

from plainsift.sources import containers, fixtures, inner

NOTE = b"note"


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def test_comments_of_a_made_file():
    part = next(p for p in containers.parts("flac", fixtures.flac_file(NOTE)) if p.kind == "VORBIS_COMMENT")
    assert inner.vorbis_comments(part.payload(fixtures.flac_file(NOTE))) == [("vendor", "note")]
    assert inner.vorbis_comments(struct.pack("<I", 1) + b"v" + struct.pack("<II", 1, 9) + b"artist=me") == [("vendor", "v"), ("ARTIST", "me")]
    with pytest.raises(containers.Malformed):
        inner.vorbis_comments(struct.pack("<I", 99))


def test_tag_frames():
    assert inner.id3_frames(b"ID3\4\0\0\0\0\0\x11TIT2\0\0\0\x03\0\0\x03hi\0\0\0") == [("TIT2", "hi")]


def test_resources_and_datasets():
    assert inner.photoshop_resources(b"Photoshop 3.0\x008BIM\x04\x04\0\0\0\0\0\x03abc\0") == [("0404", "616263")]
    assert inner.iptc_datasets(b"\x1c\x02\x50\x00\x03Ann") == [("2:80", "Ann")]


def test_package_relations():
    rows = inner.package_relations(fixtures.docx_file(NOTE))
    assert [json.loads(v)["PartName"] for _, v in rows] == ["/docProps/core.xml", "/word/document.xml"]


def test_chunks_follow_runs():
    table = box(b"stco", struct.pack(">IIIII", 0, 3, 100, 200, 300)) + box(b"stsc", struct.pack(">IIIIIIII", 0, 2, 1, 2, 1, 3, 1, 1)) + box(b"stsz", struct.pack(">III5I", 0, 0, 5, 1, 2, 3, 4, 5))
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", table)))))
    assert [json.loads(v) for _, v in inner.media_chunks(data)] == [{"offset": 100, "sizes": [1, 2]}, {"offset": 200, "sizes": [3, 4]}, {"offset": 300, "sizes": [5]}]


def test_picture_items():
    item = lambda n, kind: box(b"infe", b"\2\0\0\0" + struct.pack(">HH", n, 0) + kind + b"\0")
    meta = b"\0\0\0\0" + box(b"hdlr", bytes(20)) + box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 2) + item(1, b"hvc1") + item(2, b"Exif")) + box(b"iref", b"\0\0\0\0" + box(b"cdsc", struct.pack(">HHH", 2, 1, 1)))
    data = box(b"ftyp", b"heic") + box(b"meta", meta)
    assert inner.picture_items(data) == [("item 1", "hvc1"), ("item 2", "Exif"), ("reference cdsc 2", "[1]")]


def test_content_streams():
    assert inner.content_operations(b"q 1 0 0 1 5 5 cm % c\n/F1 12 Tf (a\\)b) Tj [<0A> -3] TJ Q") == [("q", ""), ("cm", "1 0 0 1 5 5"), ("Tf", "/F1 12"), ("Tj", "(a\\)b)"), ("TJ", "[ <0A> -3 ]"), ("Q", "")]


def test_packets_and_profiles():
    assert inner.joined_packets([(b"k", 4, 2, b"cd"), (b"k", 4, 0, b"ab")]) == {b"k": b"abcd"}
    with pytest.raises(containers.Malformed):
        inner.joined_packets([(b"k", 4, 3, b"d"), (b"k", 4, 0, b"ab")])
    segment = lambda n, c, body: b"ICC_PROFILE\0" + bytes([n, c]) + body
    assert inner.profile_from_segments([segment(2, 2, b"b"), segment(1, 2, b"a")]) == b"ab"
    with pytest.raises(containers.Malformed):
        inner.profile_from_segments([segment(1, 2, b"a")])


def test_programs_and_metafiles():
    pe = bytearray(b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0, 1, 0, 0, 0, 0, 0) + b".text\0\0\0" + struct.pack("<IIII", 0, 0, 4, 128) + bytes(16) + b"code")
    assert json.loads(inner.pe_sections(bytes(pe))[0][1]) == {"offset": 128, "size": 4}
    assert inner.pe_checksum(b"\1\0\2\0\xff\xff\xff\xff", 4) == 3 + 8
    macho = b"\xcf\xfa\xed\xfe" + bytes(12) + struct.pack("<II", 1, 16) + bytes(8) + struct.pack("<II", 0x1B, 16) + bytes(8)
    assert [n for n, _ in inner.macho_commands(macho)] == ["command 1B"]
    assert inner.wmf_records(bytes(18) + struct.pack("<IHH", 4, 0x0103, 8) + struct.pack("<IH", 3, 0)) == [("0103", "8"), ("0000", "6")]


def test_headers_by_seeks(tmp_path):
    (tmp_path / "a.mp4").write_bytes(fixtures.mp4_file(NOTE))
    found = inner.box_headers(str(tmp_path / "a.mp4"))
    assert [(n, b is None) for n, _, _, b in found] == [("ftyp", False), ("moov", False), ("mdat", True)]


def test_table_of_rows(spark):
    df = spark.createDataFrame([(1, b"q Q", "x"), (2, None, "y"), (3, b"", "z")], "k int, content binary, name string")
    assert [(r["k"], r["name"]) for r in inner.rows(df, "k", "content", "content_operations").orderBy("k", "seq").collect()] == [(1, "q"), (1, "Q")]
    bad = inner.rows(df, "k", "content", "vorbis_comments").where("k = 1").first()
    assert bad["error"] is not None
