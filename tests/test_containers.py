"""Walkers, cleaners and the folder job."""

import os
import random

import pytest
from pyspark.sql import functions as F

from plainsift.operators import cleaning, folder
from plainsift.sources import containers, files, fixtures

NOTE = b"a planted note"
CONTAINERS = [k for k in fixtures.KINDS if k not in ("text", "unknown", "empty")]


@pytest.mark.parametrize("kind", CONTAINERS)
def test_recognised_walked_cleaned(kind):
    data = fixtures.MAKERS[kind](NOTE)
    assert containers.recognise(data) == kind
    walked = containers.parts(kind, data)
    if kind not in ("svg", "mp4", "tiff", "zip", "docx", "pdf"):
        assert sum(p.size for p in walked) == len(data)
    out = cleaning.clean(kind, data)
    assert cleaning.residuals(kind, out) == []
    assert cleaning.clean(kind, out) == out
    if kind not in ("zip",):
        assert NOTE not in out
    assert containers.recognise(out) == kind


@pytest.mark.parametrize("kind", CONTAINERS)
def test_damage_is_refused_or_survived(kind):
    rng = random.Random(7)
    data = fixtures.MAKERS[kind](NOTE)
    for _ in range(150):
        broken = bytearray(data[: rng.randrange(len(data) + 1)] if rng.random() < 0.3 else data)
        for _ in range(rng.randrange(1, 8)):
            if broken:
                broken[rng.randrange(len(broken))] = rng.randrange(256)
        row, _ = folder.clean_one("x", bytes(broken))
        assert row["outcome"] != "error", row["notes"]


def test_media_offsets_follow():
    out = cleaning.clean("mp4", fixtures.mp4_file(NOTE))
    at = int.from_bytes(out[out.find(b"stco") + 12 : out.find(b"stco") + 16], "big")
    assert out[at : at + 11] == b"media bytes"


def test_offsets_are_found_by_boxes_not_by_letters():
    import struct

    box = lambda k, body: struct.pack(">I", 8 + len(body)) + k + body
    name = box(b"hdlr", bytes(8) + b"soun" + bytes(12) + b"stco\0\0\0\1\0\0\0\5")  # a name that holds the letters of a table
    movie = lambda at: box(b"ftyp", b"isom\0\0\0\0") + box(b"free", b"note" * 4) + box(b"moov", box(b"trak", box(b"mdia", name + box(b"minf", box(b"stbl", box(b"stco", struct.pack(">III", 0, 1, at))))))) + box(b"mdat", b"media")
    data = movie(movie(0).index(b"media"))
    out = cleaning.clean("mp4", data)
    assert name in out
    at = out.rindex(b"stco") + 12
    assert int.from_bytes(out[at : at + 4], "big") == out.index(b"media")


def test_archives_refused():
    good = fixtures.zip_file(NOTE)
    for broken in (good + b"x", b"x" + good, good.replace(b"a.txt", b"../ab")):
        with pytest.raises(containers.Malformed):
            containers.parts("zip", broken)


def test_png_checksum_is_checked():
    data = bytearray(fixtures.png_file(NOTE))
    data[45] ^= 1
    with pytest.raises(containers.Malformed):
        containers.parts("png", bytes(data))


def test_records_and_rebuild(spark):
    rows = spark.createDataFrame([(1, fixtures.png_file(NOTE)), (2, None), (3, b"\0\1"), (4, b"GIF89a"), (5, containers.pack_toyf(b"c" * 70_000, [(1, b"v"), (2, b"")]))], "k int, content binary")
    found = files.records(rows, "k", "content")
    assert [r["kind"] for r in found.where("k = 1").orderBy("seq").collect()] == ["signature", "IHDR", "tEXt", "IDAT", "IEND"]
    assert {r["k"]: r["error"] for r in found.where("error is not null").collect()} == {2: "no content", 3: "no handler reads it", 4: "no GIF header"}
    assert files.rebuilt(found, "k", F.col("kind") == "content").first()["content"] == b"c" * 70_000


def test_folder_job(spark, tmp_path):
    src, dst = tmp_path / "in", tmp_path / "out"
    for name, data in {"a/x.png": fixtures.png_file(NOTE), "b.txt": b"plain", "c.bin": b"\0\0", "d.txt": b"", "__MACOSX/._x": b"\0\5\26\7", "e.gif": b"GIF89a"}.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(data)
    cleaned = folder.clean_files(files.folder(spark, str(src)))
    assert {r["path"]: r["outcome"] for r in folder.sheet(cleaned).collect()} == {"a/x.png": "cleaned", "b.txt": "kept as text", "c.bin": "not supported", "d.txt": "cleaned", "__MACOSX/._x": "dropped", "e.gif": "refused"}
    assert sorted(r["path"] for r in folder.write_cleaned(cleaned, str(dst)).where("written").collect()) == ["a/x.png", "b.txt", "d.txt"]
    assert NOTE not in (dst / "a/x.png").read_bytes()
    assert not [f for _, _, fs in os.walk(dst) for f in fs if ".part-" in f]
    assert {r["outcome"]: r["complete"] for r in folder.summary(cleaned).collect()}["refused"] is False


def test_arriving_files(spark, tmp_path):
    from plainsift.streaming.folder import clean_arriving

    src = tmp_path / "in"
    src.mkdir()
    run = lambda: clean_arriving(spark, str(src), str(tmp_path / "sheet"), str(tmp_path / "state"), str(tmp_path / "out")).awaitTermination()
    (src / "a.png").write_bytes(fixtures.png_file(NOTE))
    run()
    (src / "b.txt").write_bytes(b"plain")
    run()
    assert {r["path"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "sheet")).collect()} == {"a.png": "cleaned", "b.txt": "kept as text"}
    assert (tmp_path / "out" / "b.txt").read_bytes() == b"plain"


def test_orientation_alone_stays():
    exif = b"Exif\0\0II*\0" + (8).to_bytes(4, "little") + (2).to_bytes(2, "little") + bytes.fromhex("0f010200040000004d6500000112030001000000".replace("0112", "1201")) + (6).to_bytes(4, "little") + bytes(4)
    plain = fixtures.jpeg_file(NOTE)
    turned = plain[:2] + b"\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + plain[2:]
    out = cleaning.clean("jpeg", turned)
    assert b"Me\0" not in out
    assert [n for s, n in cleaning.JPEG_ORIENTATION.items() if s in out] == [6]
    assert cleaning.residuals("jpeg", out) == []
    assert cleaning.clean("jpeg", out) == out


def test_documents_that_hide_are_refused():
    plain = fixtures.pdf_file(NOTE)
    assert len(cleaning.clean("pdf", plain)) == len(plain)
    for sign in (b"/Encrypt 9 0 R", b"/ObjStm"):
        with pytest.raises(containers.Malformed):
            cleaning.clean("pdf", plain.replace(b"trailer<<", b"trailer<<" + sign))
