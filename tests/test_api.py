"""Entry points and exit codes."""

import pytest

from plainsift import api
from plainsift.sources import fixtures


def test_one_file(tmp_path):
    src, dst = tmp_path / "a.png", tmp_path / "b.png"
    src.write_bytes(fixtures.png_file(b"planted"))
    assert api.main([str(src), str(dst)]) == api.OK
    assert b"planted" not in dst.read_bytes()
    assert api.main([str(src), str(tmp_path / "c"), "--fidelity", "F3"]) == api.LEVEL
    assert api.main([str(src), str(tmp_path / "c"), "--fidelity", "F2", "--no-report", "--no-verify", "--skip-memory-check"]) == api.OK
    (tmp_path / "a.gif").write_bytes(fixtures.gif_file(b"planted"))
    assert api.main([str(tmp_path / "a.gif"), str(tmp_path / "g"), "--fidelity", "F2"]) == api.LEVEL
    assert api.main([str(tmp_path / "none"), "x"]) == api.USAGE
    src.write_bytes(b"\0\1")
    assert api.main([str(src), str(tmp_path / "d")]) == api.UNSUPPORTED
    src.write_bytes(b"GIF89a")
    assert api.main([str(src), str(tmp_path / "e")]) == api.STRUCTURE
    assert not (tmp_path / "e").exists()


def test_layout(tmp_path):
    (tmp_path / "in").mkdir()
    for bad in (tmp_path / "in", tmp_path / "in" / "x", tmp_path):
        with pytest.raises(ValueError):
            api.check_layout(str(tmp_path / "in"), str(bad))
    api.check_layout(str(tmp_path / "in"), str(tmp_path / "out"))


def test_folder(spark, tmp_path):
    src, dst = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.png").write_bytes(fixtures.png_file(b"planted"))
    (src / "scrub-results.csv").write_bytes(b"a,b\n")
    code, sheet = api.clean_folder(spark, str(src), str(dst))
    assert (code, sheet.rpartition("/")[2]) == (api.OK, "scrub-results-2.csv")
    with open(sheet, encoding="utf-8-sig") as file:
        lines = file.read().splitlines()
    assert lines[0].startswith("path,outcome,format")
    assert [x.split(",")[:2] for x in lines[1:]] == [["a.png", "cleaned"], ["scrub-results.csv", "kept as text"]]
    (src / "b.bin").write_bytes(b"\0")
    assert api.clean_folder(spark, str(src), str(tmp_path / "out2"))[0] == api.INCOMPLETE


def test_second_level_of_pictures():
    import struct
    import zlib

    from plainsift.operators import cleaning
    from plainsift.sources import containers as c

    rows = bytes(range(256)) * 40
    def made(level, cut):
        packed = zlib.compress(rows, level)
        head = c.png_chunk(b"IHDR", struct.pack(">IIBBBBB", 255, 40, 8, 0, 0, 0, 0))
        return c.PNG_HEAD + head + c.png_chunk(b"tEXt", b"a\0b") + b"".join(c.png_chunk(b"IDAT", packed[n : n + cut]) for n in range(0, len(packed), cut)) + c.png_chunk(b"IEND", b"")

    outs = {cleaning.clean("png", made(level, cut), "F2") for level in (0, 1, 6, 9) for cut in (50, 1 << 16)}
    assert len(outs) == 1 and cleaning.clean("png", next(iter(outs)), "F2") in outs
    out = next(iter(outs))
    assert zlib.decompress(next(p.payload(out) for p in c.parts("png", out) if p.kind == "IDAT")) == rows
    held = {cleaning.clean("zip", cleaning.zip_bytes([("p.png", made(level, 99))]), "F2") for level in (1, 9)}
    assert len(held) == 1


def test_memory_and_doctor(tmp_path, monkeypatch, capsys):
    (tmp_path / "a.png").write_bytes(fixtures.png_file(b"planted"))
    monkeypatch.setattr(api, "free_memory", lambda: 10)
    assert api.clean_file(str(tmp_path / "a.png"), str(tmp_path / "b"))[0] == api.MEMORY
    assert not (tmp_path / "b").exists()
    assert api.main(["doctor"]) == api.OK
    assert "pyspark: found" in capsys.readouterr().out


def test_progress_and_evidence(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in "ba":
        (src / f"{name}.png").write_bytes(fixtures.png_file(b"planted"))
    seen = []
    code, path = api.clean_folder(spark, str(src), str(tmp_path / "out"), report=False, verify=False, progress=lambda r: seen.append((r["path"], r["independent_check"])))
    assert (code, path) == (api.OK, None)
    assert seen == [("a.png", "not run: switched off"), ("b.png", "not run: switched off")]
    df = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert api.check_evidence(df([(1, "pass")]), df([(1, "pass")]), ["k"], "v")[0] == api.OK
    code, found = api.check_evidence(df([(1, "pass"), (2, "fail")]), df([(1, "fail")]), ["k"], "v")
    assert code == api.CONTENT and {r["k"]: r["status"] for r in found.collect()} == {1: "difference", 2: "unmeasured"}
