"""Nested records as flat tables."""

import json

import pytest

from plainsift.operators import shred


def tables(spark, bodies, wanted=None):
    df = spark.createDataFrame([(n, b if b is None or isinstance(b, str) else json.dumps(b)) for n, b in enumerate(bodies)], "k int, body string")
    plan = shred.plan_of(df, "body", shred.MATRIX)
    return shred.shred(df, ["k"], "body", shred.MATRIX, plan, wanted), plan


CELL = {"verdict": "fail", "noise_floor": {"repeats": "5"}, "leaks": [{"locus": [{"offset": "7"}], "evidence": ["a", "b"]}, None, {"locus": None, "evidence": {"text": "c"}}]}


def test_all_arrangements_give_the_same_leaks(spark):
    cell = CELL | {"adversary": "A1", "fidelity": "F2"}
    arrangements = [{"cells": [cell]}, {"cells": cell}, {"cells": {"A1/F2": CELL}}, {"cells": {"A1": {"F2": CELL}}}, {"envelope": {"v": 1}, "matrix": {"format": "x", "cells": [cell]}}]
    arrangements.append(json.dumps(json.dumps(arrangements[0])))
    df, _ = tables(spark, arrangements)
    for row in df.collect():
        assert [(c["adversary"], c["fidelity"], c["noise_floor_repeats"]) for c in row["cells"]] == [("A1", "F2", "5")]
        assert [(x["parent_no"], x["no"]) for x in row["leaks"]] == [(0, 0), (0, 1)]
        assert [(x["parent"], x["parent_no"], x["offset"]) for x in row["locus"]] == [("leaks", 0, "7")]
        assert [(x["parent_no"], x["text"]) for x in row["evidence"]] == [(0, "a"), (0, "b"), (1, "c")]
    assert df.count() == len(arrangements)


def test_broken_bodies_give_nothing(spark):
    df, _ = tables(spark, [None, "", "{", '{"cells": [', "5", '"text"', {"cells": None}, {"other": 1}])
    assert [r["k"] for r in df.collect()] == [6]


def test_shared_and_recursive_elements_get_tables():
    edges = [("document", "a", "a", False, True), ("document", "b", "b", False, True), ("a", "place", "place", False, True), ("b", "place", "place", False, True), ("a", "tree", "tree", False, True), ("tree", "tree", "tree", False, True), ("place", "x", "x", False, False), ("b", "list", "list", True, False)]
    plan = shred.relations(edges, shred.Shape("document", ("a",)))
    assert plan.tables == ["document", "list", "place", "tree"]
    assert plan.columns["place"] == ["x"]


def test_flat_table_has_foreign_keys(spark):
    df, plan = tables(spark, [{"cells": [CELL, CELL]}])
    rows = shred.flat(df, ["k"], "leaks").orderBy("leaks_no").collect()
    assert [(r["leaks_no"], r["parent"], r["parent_no"], r["no"]) for r in rows] == [(0, "cells", 0, 0), (1, "cells", 0, 1), (2, "cells", 1, 0), (3, "cells", 1, 1)]
    assert "noise_floor.repeats" in plan.columns["cells"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "k int, body string")
    plan = shred.plan_of(df, "body", shred.MATRIX)
    assert shred.shred(df, ["k"], "body", shred.MATRIX, plan).count() == 0


def test_deep_body_is_no_crash(spark):
    df, _ = tables(spark, ["[" * 100_000, {"cells": [CELL]}])
    assert df.count() == 1


def test_names_that_are_data_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(shred, "MAX_EDGES", 20)
    df = spark.createDataFrame([(n, json.dumps({"cells": [], f"k{n}": 1})) for n in range(30)], "k int, body string")
    with pytest.raises(ValueError, match="must be declared"):
        shred.plan_of(df, "body", shred.MATRIX)
