"""Schemas that drift between files."""

import datetime
import json
import random

import pytest

from plainsift.operators import drift


@pytest.mark.parametrize(("a", "b", "c"), [("null", "number", "number"), ("boolean", "number", "string"), ("integer", "number", "number"), ("boolean", "integer", "string"), ("number", "string", "string"), ("string", "array", "array"), ("boolean", "boolean", "boolean")])
def test_lattice(a, b, c):
    assert drift.join_kinds(a, b) == drift.join_kinds(b, a) == c


def test_lattice_is_associative():
    for a in drift.KINDS:
        for b in drift.KINDS:
            for c in drift.KINDS:
                assert drift.join_kinds(drift.join_kinds(a, b), c) == drift.join_kinds(a, drift.join_kinds(b, c))


@pytest.mark.parametrize(("path", "name"), [("why", "reason"), ("detail.reason", "reason"), ("evidence-directory", "evidence_dir"), ("baseline.noise.is_deterministic", "noise_floor.deterministic"), ("repeats", "noise_floor.repeats"), ("peak_mb", "peak_mb")])
def test_names(path, name):
    assert drift.common_name(path) == name


def files(spark, rows):
    at = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, s, at + datetime.timedelta(hours=h), json.dumps({"cells": c}) if c is not None else None) for i, s, h, c in rows], "f int, s int, at timestamp, body string")


def run(spark, df):
    return sorted(map(tuple, drift.changes(drift.headers(df, ["f", "s", "at"], "body"), "f", "s", "at").collect()))


def test_kinds_of_change(spark):
    df = files(spark, [(1, 1, 0, [{"reason": "x", "queue": None}]), (2, 1, 1, [{"why": ["x"]}, {"queue": "a"}]), (3, 1, 2, []), (4, 1, 3, None), (5, 2, 0, [{"reason": "x"}])])
    assert run(spark, df) == [(2, "queue", "added"), (2, "reason", "renamed"), (2, "reason", "retyped"), (3, "queue", "removed"), (3, "reason", "removed")]


def test_one_long_series_across_blocks(spark):
    rng = random.Random(1)
    rows, want, before = [], [], None
    for n in range(300):
        fields = {f for f in "abc" if rng.random() > 0.5}
        rows.append((n, 1, n, [dict.fromkeys(fields, 1)]))
        if before is not None:
            want += [(n, f, "added") for f in fields - before] + [(n, f, "removed") for f in before - fields]
        before = fields
    rng.shuffle(rows)
    assert run(spark, files(spark, rows)) == sorted(want)


def test_unified_and_union(spark):
    df = files(spark, [(1, 1, 0, [{"adversary": "A1", "why": "x", "floor": {"runs": 5, "stable": True}, "Queue": 3, "queue": 1.5}]), (2, 1, 1, [{"reason": ["p", 4], "repeats": 2, "deterministic": "maybe", "big": 1 << 70, "f": None}])])
    schema = drift.union_schema(drift.headers(df, ["f"], "body"))
    kinds = {r["field_name"]: r["kind"] for r in schema.collect()}
    assert kinds == {"adversary": "string", "reason": "array", "noise_floor.repeats": "integer", "noise_floor.deterministic": "string", "Queue": "integer", "queue": "number", "big": "number"}
    found = drift.unified(df, ["f"], "body", schema)
    assert dict(found.dtypes) == {"f": "int", "cell_no": "int", "Queue": "bigint", "adversary": "string", "big": "double", "noise_floor_deterministic": "string", "noise_floor_repeats": "bigint", "queue_2": "double", "reason": "array<string>", "others": "map<string,string>"}
    rows = {r["f"]: r.asDict() for r in found.collect()}
    assert (rows[1]["reason"], rows[1]["noise_floor_repeats"], rows[1]["noise_floor_deterministic"], rows[1]["queue_2"], rows[1]["others"]) == (["x"], 5, "true", 1.5, {})
    assert (rows[2]["reason"], rows[2]["noise_floor_repeats"], rows[2]["noise_floor_deterministic"], rows[2]["big"]) == (["p", "4"], 2, "maybe", float(1 << 70))


def test_fields_beyond_the_columns_are_kept(spark, monkeypatch):
    monkeypatch.setattr(drift, "MAX_COLUMNS", 2)
    df = files(spark, [(1, 1, 0, [{"a": 1, "b": 2}, {"a": 1, "c": [3]}]), (2, 1, 1, [{"a": 1, "b": 2}])])
    found = drift.unified(df, ["f"], "body", drift.union_schema(drift.headers(df, ["f"], "body")))
    assert found.columns == ["f", "cell_no", "a", "b", "others"]
    assert {(r["f"], r["cell_no"]): (r["a"], r["b"], r["others"]) for r in found.collect()} == {(1, 0): (1, 2, {}), (1, 1): (1, None, {"c": "[3]"}), (2, 0): (1, 2, {})}


def test_a_rename_that_no_list_foretells(spark):
    said = ["no second decoder on the machine", "level not built", "floor covers it"]
    rows = []
    for s in range(4):
        for h in range(8):
            name = "reason" if (h // 2 + s) % 2 else "grounds_given"
            rows.append((s * 10 + h, s, h, [{name: said[(h + k) % 3], "queue": f"q{k}", **({"rank": k} if h % 3 == s % 3 else {})} for k in range(3)]))
    bodies = files(spark, rows)
    heads = drift.headers(bodies, ["f", "s", "at"], "body")
    learned = drift.learned_names(heads, "f", "s", "at", bodies, "body")
    assert [tuple(r) for r in learned.collect()] == [("grounds_given", "reason")]
    found = {tuple(r) for r in drift.changes(drift.renamed(heads, learned, "f"), "f", "s", "at").collect()}
    want = {(s * 10 + h, "reason", "renamed") for s in range(4) for h in range(2, 8, 2)}
    assert {c for c in found if c[1] != "rank"} == want
    cells = drift.unified(files(spark, rows), ["f"], "body", drift.union_schema(drift.renamed(heads, learned, "f")), learned)
    assert cells.where("reason is null").count() == 0 and "grounds_given" not in cells.columns


def test_fields_that_only_come_and_go_are_no_renames(spark):
    rng = random.Random(4)
    rows = [(n, 1, n, [{f: rng.choice(["runs ok", "runs late"]) for f in ("reason", "queue", "note") if rng.random() > 0.4}]) for n in range(60)]
    bodies = files(spark, rows)
    assert drift.learned_names(drift.headers(bodies, ["f", "s", "at"], "body"), "f", "s", "at", bodies, "body").isEmpty()


def test_broken_and_empty(spark):
    df = spark.createDataFrame([(1, 1, None, "{"), (2, None, None, ""), (3, 1, None, "[1, 2]")], "f int, s int, at timestamp, body string")
    assert run(spark, df) == []
    assert run(spark, df.where("false")) == []
