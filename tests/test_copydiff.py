"""Differences between two copies."""

import random

from plainsift.operators import copydiff

FIELDS = {"a": copydiff.loose, "b": copydiff.squeezed, "c": copydiff.same}


def run(left, right):
    return sorted(((r["k"], r["difference"]) for r in copydiff.differences(left, right, "k", ["at"], FIELDS, ("l", "r")).collect()), key=lambda r: (r[0] is not None, r))


def test_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda: {k: (rng.choice(["x", "X ", "y", None]), rng.choice(["p q", " p  q", "", None]), rng.choice([1, 2, None])) for k in range(400) if rng.random() > 0.1}
    a, b = make(), make()
    for k in list(a)[:250]:
        b[k] = a[k]
    rows = lambda d: [(k, *v, t) for k, v in d.items() for t in (5, 5)] + [(k, "old", "old", 9, 1) for k in list(d)[:50]]
    df = lambda d: spark.createDataFrame(rows(d), "k int, a string, b string, c int, at int")
    flat = lambda v: (None if v[0] is None else v[0].strip().upper(), " ".join((v[1] or "").split()), v[2])
    want = [(k, "l") for k in a.keys() - b.keys()] + [(k, "r") for k in b.keys() - a.keys()]
    want += [(k, f) for k in a.keys() & b.keys() for f, x, y in zip("abc", flat(a[k]), flat(b[k]), strict=True) if x != y]
    assert run(df(a), df(b)) == sorted(want)


def test_equal_and_empty(spark):
    df = spark.createDataFrame([(1, "x", None, None, None)], "k int, a string, b string, c int, at int")
    assert run(df, df) == []
    assert run(df, df.where("false")) == [(1, "l")]
    assert run(df.where("false"), df.where("false")) == []


def test_null_keys_and_clashing_names(spark):
    left = spark.createDataFrame([(None, "x", "y", 1, 1, "n"), (1, "x", "y", 1, 1, "n")], "k int, a string, b string, c int, at int, bucket string")
    right = spark.createDataFrame([(1, "x", "y", 1, 1, "m")], "k int, a string, b string, c int, at int, difference string")
    assert run(left, right) == [(None, "l")]


def test_values_that_change_places_within_a_bucket(spark):
    left = [(k, "pass" if k % 2 else "fail", "x", k % 3, 1) for k in range(3000)]
    swapped = {90: 981, 981: 90, 4: 7, 7: 4}
    right = [(k, *left[swapped.get(k, k)][1:3], left[k][3], 1) for k in range(3000)]
    df = lambda r: spark.createDataFrame(r, "k int, a string, b string, c int, at int")
    want = sorted((k, "a") for k in swapped if left[k][1] != right[k][1])
    assert len(want) == 4
    for rows in (1, 4):
        found = copydiff.differences(df(left), df(right), "k", ["at"], FIELDS, ("l", "r"), rows)
        assert sorted(map(tuple, found.collect())) == want
    one = {"a": copydiff.loose}
    sums = [copydiff.checksums(df(r), "k", ["at"], one, 4) for r in (left, right)]  # 16 buckets of some 190 rows
    assert copydiff.unequal_buckets(*sums, ["a"]).count() == len({b for b in _buckets(spark, list(swapped), 4)})


def _buckets(spark, keys, bits):
    return [r["bucket"] for r in spark.createDataFrame([(k,) for k in keys], "k int").select(copydiff._bucket("k", bits)).collect()]


def test_more_buckets_than_the_coarse_list(spark, monkeypatch):
    monkeypatch.setattr(copydiff, "COARSE_BITS", 3)
    left = spark.createDataFrame([(k, "x", "y", k, 1) for k in range(500)], "k int, a string, b string, c int, at int")
    right = spark.createDataFrame([(k, "x", "y", k + (k % 97 == 5), 1) for k in range(3, 500)], "k int, a string, b string, c int, at int")
    assert copydiff.bucket_bits(500) > 3
    assert run(left, right) == sorted([(k, "l") for k in range(3)] + [(k, "c") for k in range(500) if k % 97 == 5])


def test_ties_with_different_content_are_settled_alike(spark):
    rows = [(k, a, "y", 1, 7) for k in range(200) for a in ("p", "q", "r")]
    left = spark.createDataFrame(rows, "k int, a string, b string, c int, at int")
    right = spark.createDataFrame(rows[::-1], "k int, a string, b string, c int, at int")
    assert run(left, right) == []


def test_rows_without_a_key_are_listed_on_both_sides(spark):
    df = spark.createDataFrame([(None, "x", "y", 1, 1)] * 2 + [(1, "x", "y", 1, 1)], "k int, a string, b string, c int, at int")
    assert run(df, df) == [(None, "l")] * 2 + [(None, "r")] * 2


def test_a_hot_key_and_a_very_long_text(spark):
    rows = [(1, "v", "b", 1, n) for n in range(2000)] + [(k, "w " * 50_000, None, None, None) for k in range(2, 6)]
    left = spark.createDataFrame(rows, "k int, a string, b string, c int, at int")
    right = spark.createDataFrame([(1, "V", "b", 2, 0), *[(k, "w " * 49_999, "", None, 3) for k in range(2, 6)]], "k int, a string, b string, c int, at int")
    assert run(left, right) == [(1, "c")] + [(k, "a") for k in range(2, 6)]
