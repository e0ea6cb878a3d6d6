"""Join-shaped operators, extents and the oracle, against brute force on small tables."""

import random

import numpy as np
import pytest

from plainsift.operators import intervals, matching, reporting, variance


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_as_of_against_brute_force(spark):
    rng = random.Random(2)
    left = [(n, rng.choice([1, 1, 1, 2, None]), rng.choice([*range(50), None])) for n in range(200)]
    right = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(50), rng.randrange(1000)) for _ in range(80)]
    lf, rf = spark.createDataFrame(left, "n int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int")
    for strict in (False, True):
        want = []
        for n, k, t in left:
            hits = [(rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and (rt < t if strict else rt <= t)]
            want.append((n, k, t, max(hits)[1] if hits else None))
        assert got(matching.as_of(lf, rf, "k", "t", "v", strict)) == sorted(want, key=repr)
    assert got(matching.as_of(lf, rf.where("false"), "k", "t", "v")) == sorted(((*r, None) for r in left), key=repr)
    assert matching.as_of(lf.where("false"), rf, "k", "t", "v").count() == 0


def test_field_diff_and_leaks(spark):
    b = spark.createDataFrame([(1, "x", "a"), (1, "y", None), (1, "z", "c")], "file_id int, locus string, value string")
    a = spark.createDataFrame([(1, "y", None), (1, "z", "d"), (1, "w", "e")], "file_id int, locus string, value string")
    assert {(r["locus"], r["status"]) for r in matching.field_diff(b, a).collect()} == {("x", "removed"), ("y", "kept"), ("z", "changed"), ("w", "added")}
    values = spark.createDataFrame([(1, "Annika"), (1, ""), (1, None), (2, "Annika"), (1, "Annika")], "file_id int, value string")
    tags = spark.createDataFrame([(1, 2, "B:t", "by ANN"), (1, 1, "A:t", "Annikaex"), (1, 0, "Z:t", None), (2, 1, "C:t", "nobody")], "file_id int, seq int, key string, text string")
    assert got(matching.leak_search(values, tags)) == [(1, "Annika", "A:t", False)]


def test_evidence_statuses(spark):
    p = spark.createDataFrame([(1, "pass"), (2, "pass"), (3, "not_tested"), (4, "fail"), (5, "pass")], "k int, v string")
    m = spark.createDataFrame([(1, "pass"), (2, "not_tested"), (3, "not_tested"), (4, "pass")], "k int, v string")
    assert {r["k"]: r["status"] for r in matching.evidence_diff(p, m, ["k"], "v").collect()} == {1: "confirmed", 2: "unmeasured", 3: "confirmed", 4: "difference", 5: "unmeasured"}


def test_closure_with_loop_and_barrier(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (None, 6)], "src int, dst int")
    roots = spark.createDataFrame([(1,)], "node int")
    assert got(matching.closure(edges, roots)) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert got(matching.closure(edges, roots, spark.createDataFrame([(4,)], "node int"))) == [(1, 0), (2, 1), (3, 2)]
    assert got(matching.closure(edges.where("false"), roots)) == [(1, 0)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 130)]
    random.Random(4).shuffle(edges)
    found = dict(matching.components(spark.createDataFrame(edges, "src int, dst int")).collect())
    assert found == {n: 0 for n in range(41)} | {n: 100 for n in range(100, 130)}


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 16)
    x = np.random.default_rng(1).integers(0, 4, (90, 3)).astype(float)  # with ties
    rows = spark.createDataFrame([(n, v.tolist(), int(n % 3)) for n, v in enumerate(x)] + [(90, None, 0)], "id int, v array<double>, l int")
    want = {}
    for n in range(0, 90, 20):
        d = np.sqrt(((x - x[n]) ** 2).sum(1))
        d[n] = np.inf
        want[n] = (int(d.argmin()), round(float(d.min()), 9))
    found = matching.nearest_other(rows.where("id % 20 = 0 and id < 90"), rows, "id", "v", "l").collect()
    assert {r["query"]: (r["neighbour"], round(r["distance"], 9)) for r in found} == want


def test_neighbours_outside_the_document(spark):
    rows = spark.createDataFrame([(0, 0, [0.0], 1), (1, 0, [0.1], 1), (2, 1, [3.0], 2), (3, None, [9.0], 2), (4, None, [9.0], 2)], "id int, d int, v array<double>, l int")
    found = matching.nearest_other(rows, rows, "id", "v", "l", "d").collect()
    assert {r["query"]: r["neighbour"] for r in found} == {0: 2, 1: 2, 2: 1, 3: 2, 4: 2}
    assert matching.nearest_other(rows, rows.where("d = 0"), "id", "v", "l", "d").where("query < 2").count() == 0


@pytest.mark.parametrize("within", [True, False])
def test_leaks_by_the_rule(spark, within):
    values = {1: ["ACME corp", "abcd", "(Binary data 9 bytes)", None, "  Camera X ", "title line"], 2: ["ACME corp"], 3: ["gone value"]}
    tags = {1: [("ICC:Copyright", "acme CORP 2001"), ("EXIF:Model", "camera x"), ("XMP:Title", None), ("XMP:Line", "abcd")], 2: [("EXIF:Make", "nobody"), ("XMP:ACME corp", "")], 3: []}
    if within:
        rows = spark.createDataFrame([(f, values[f], tags[f]) for f in values], "f int, v array<string>, t array<struct<key:string,text:string>>")
        found = matching.leaks_within(rows, "f", "v", "t", ["ICC"], ["Model"])
    else:
        v = spark.createDataFrame([(f, x) for f, xs in values.items() for x in xs], "f int, value string")
        t = spark.createDataFrame([(f, n, *x) for f, xs in tags.items() for n, x in enumerate(xs)], "f int, seq int, key string, text string")
        found = matching.leak_search(v, t, "f", ["ICC"], ["Model"])
    assert got(found) == [(1, "ACME corp", "ICC:Copyright", True), (1, "Camera X", "EXIF:Model", True), (2, "ACME corp", "XMP:ACME corp", False)]


def test_first_match_order_and_nulls(spark):
    df = spark.createDataFrame([("a.zip",), ("b",), (None,)], "t string")
    rules = [(2, "suffix", ".zip", "zip"), (1, "prefix", "a", "first")]
    assert got(matching.first_match(df, "t", "t", rules, "none")) == [("a.zip", "first"), ("b", "none"), (None, "none")]


@pytest.mark.parametrize("seed", range(3))
def test_extents_against_brute_force(spark, seed):
    rng = random.Random(seed)
    spans = [(1, s, s + rng.randrange(4)) for s in (rng.randrange(60) for _ in range(25))]
    df = spark.createDataFrame([*spans, (1, None, 5), (2, 3, 3)], "f int, start int, end int")
    covered = sorted({p for _, s, e in spans for p in range(s, e)})
    runs, holes = [], []
    for p in covered:
        if runs and runs[-1][1] == p:
            runs[-1][1] = p + 1
        else:
            runs.append([p, p + 1])
    holes = [(1, a[1], b[0]) for a, b in zip(runs, runs[1:])]
    assert got(intervals.merged(df, "f").select("f", "start", "end")) == sorted(((1, *r) for r in runs), key=repr)
    assert got(intervals.gaps(df, "f")) == sorted(holes, key=repr)
    bounds = spark.createDataFrame([(1, 5, 80), (2, 3, 9), (3, 4, 4), (4, None, 2)], "f int, low int, high int")
    free, inner = sorted(set(range(5, 80)) - set(covered)), []
    for p in free:
        if inner and inner[-1][2] == p:
            inner[-1][2] = p + 1
        else:
            inner.append([1, p, p + 1])
    assert got(intervals.gaps(df, "f", bounds)) == sorted([*map(tuple, inner), (2, 3, 9)], key=repr)


def test_offsets_and_completeness(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 7), (2, 2, 1)], "f int, n int, size int")
    assert got(intervals.running_offsets(df, "f", ["n"], "size", 8).select("f", "n", "new_offset")) == [(1, 1, 8), (1, 2, 13), (1, 3, 13), (2, 2, 8)]
    assert got(intervals.completeness(df, "f", "n")) == [(1, True), (2, False)]


def oracle(cells):
    """The decomposition of cells {(group, repeat): {feature: value}}, one feature at a time."""
    out = {}
    for f in {f for c in cells.values() for f in c}:
        groups = {}
        for (g, r), c in sorted(cells.items()):
            if f in c:
                groups.setdefault(g, []).append(c[f])
        within = max(len(set(v)) for v in groups.values())
        modes = {max(dict.fromkeys(v), key=v.count) for v in groups.values()}
        out[f] = (within > 1, len(modes) > max(within, 1), len(modes), within)
    return out


def test_decompose_against_brute_force(spark):
    rng = random.Random(5)
    cells = {(g, r): {f: rng.choice(v) for f, v in {"same": "a", "noise": "abcd", "leak": g, "some": "ab"}.items() if rng.random() > 0.15} for g in "xyz" for r in range(4)}
    rows = [(g, r, f, v) for (g, r), c in cells.items() for f, v in c.items()] + [("x", 9, "gone", None)]
    found = variance.decompose(spark.createDataFrame(rows, "group string, repeat int, feature_id string, value string")).collect()
    assert {r["feature_id"]: (r["floor"], r["leak"], r["n_between"], r["max_within"]) for r in found} == oracle(cells)


def test_floor_counts_absence(spark):
    df = spark.createDataFrame([(r, "f", "a") for r in range(3)] + [(0, "g", "a")], "repeat int, feature_id string, value string")
    assert got(variance.noise_floor(df, 3, True)) == [("f", 1, False), ("g", 2, True)]
    assert got(variance.noise_floor(df, 3, False)) == [("f", 1, False), ("g", 1, False)]


def test_runs_of_differences(spark):
    df = spark.createDataFrame([("a", 1, "xxabcx"), ("a", 2, "xxAbCx"), ("a", 3, "xxAbcx"), ("b", 4, "abc"), ("b", 5, "abX1"), ("c", 6, "ab"), ("c", 7, "abc"), ("d", 8, "z"), ("e", 9, None)], "c string, m int, t string")
    assert got(variance.disagreeing_runs(df, "c", "m", "t")) == [("a", "byte@2:1"), ("a", "byte@4:1"), ("b", "byte_tail@2"), ("b", "length_divergence"), ("c", "byte_tail@2"), ("c", "length_divergence")]


def test_grams(spark):
    out = spark.createDataFrame([(1, "--tag-7--"), (2, "xtag-7y"), (3, None)], "k int, t string")
    inputs = spark.createDataFrame([(1, "ag-7")], "k int, t string")
    assert got(variance.shared_grams(out, inputs, "t", "k", 4)) == [("tag-",)]


def test_reports_on_ties_and_empties(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), ("c", "z"), ("c", "z"), ("c", "y")], "k string, v string")
    assert got(reporting.census(df, "k", "v")) == [("a", "x +1 more"), ("c", "z +1 more")]
    assert got(reporting.first_n(df, "k", "v", 1)) == [("a", "x and 1 more"), ("c", "y and 1 more")]
    empty = reporting.coverage(spark.createDataFrame([], "c int, t int"), *[__import__("pyspark").sql.functions.col(x) for x in "ct"]).first()
    assert (empty["gated_percent"], empty["overall_percent"], empty["untouched"]) == (100.0, 100.0, 0)
