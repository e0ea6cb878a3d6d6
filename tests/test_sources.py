"""Report files and marked text."""

from plainsift.sources import reports


def test_test_runs(spark, tmp_path):
    (tmp_path / "junit-linux.xml").write_text('<testsuite><testcase classname="a" name="t1" time="0.5"/><testcase classname="a" name="t2" time="1"><failure message="no">x</failure></testcase><testcase classname="a" name="t3"><skipped message="later"/></testcase></testsuite>')
    rows = {r["nodeid"]: (r["status"], r["time"], r["leg"], r["message"]) for r in reports.test_runs(spark, str(tmp_path)).collect()}
    assert rows == {"a::t1": ("pass", 0.5, "linux", None), "a::t2": ("fail", 1.0, "linux", "no"), "a::t3": ("skip", 0.0, "linux", "later")}


def test_blocks_and_rows(spark, tmp_path):
    (tmp_path / "a.md").write_text("x <!-- LIMITS:BEGIN -->\n| # | text |\n| 1 | one |\n| 12 | two, three |\n<!-- LIMITS:END --> y")
    blocks = reports.marked_blocks(spark, str(tmp_path / "a.md"), "LIMITS")
    assert sorted(map(tuple, reports.numbered_rows(blocks, "block").collect())) == [(1, "one"), (12, "two, three")]


def test_json_and_schema_checks(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"format": "png",\n "cells": [{"adversary": "A1", "fidelity": "F1", "verdict": "pass"}, {"adversary": "A9", "fidelity": "F1"}]}')
    doc = reports.json_documents(spark, str(tmp_path / "m.json"))
    cells = doc.selectExpr("inline(cells)")
    assert [r["reason"] for r in reports.invalid_cells(cells).collect()] == ["adversary unknown; verdict missing"]


def test_sheet_is_one_sorted_file(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "path string, n int")
    reports.write_sheet(df, str(tmp_path / "sheet"))
    files = list((tmp_path / "sheet").glob("*.csv"))
    assert len(files) == 1
    assert files[0].read_text().splitlines() == ["path,n", "a,2", "b,1"]
