"""Operators of the subpackage llm: against brute force, exact round trips and edge cases."""

from __future__ import annotations

import datetime
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plainsift.llm import binpack, bpe, lookalike, queries, selection, terms
from tests.conftest import SMALL, same_as_sql


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, duck, name):
    same_as_sql(queries.QUERIES[name](spark, SMALL), duck, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() >= 0


# --- problem 1


def test_terms_against_counter(spark):
    rng = random.Random(1)
    rows = [(rng.choice("fg"), rng.choice(["hot"] * 6 + ["b", "c", "", None, "Ünï"]), rng.choice([*range(40), None])) for _ in range(900)]
    occ, rec = Counter(), defaultdict(set)
    for f, t, r in rows:
        if t:
            occ[f, t] += 1
            rec[f, t].add(r)
    found = terms.term_table(spark.createDataFrame(rows, "f string, t string, r int"), 41, "f", "t", "r").collect()
    assert {(x["f"], x["t"]): (x["occurrences"], x["records"]) for x in found} == {k: (n, len(rec[k])) for k, n in occ.items()}


def test_runs_across_batches_and_partitions(spark):
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((rng.choice("fg"), rng.choice("ab"), rng.choice([0, 1, 2, 3])) for _ in range(60))
    occ, rec = Counter((f, t) for f, t, _ in rows), defaultdict(set)
    for f, t, r in rows:
        rec[f, t].add(r)
    for size in (1, 2, 7, 60):
        cut = [rows[n : n + size] for n in range(0, 60, size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*c, strict=True)], names=["f", "t", "r"]) for c in cut]
        found = [tuple(x.values()) for b in terms.run_lengths(iter(batches), "f", "t", "r", 3) for x in b.to_pylist()]
        assert [(f, t, n, k) for f, t, n, k, *_ in found] == [(f, t, occ[f, t], len(rec[f, t])) for f, t in sorted(occ)]


@pytest.mark.parametrize("record", [1, None])
def test_one_record_that_repeats_one_term_is_spread(spark, record):
    pairs = spark.createDataFrame([("f", "hot", record)] * 3000 + [("f", "hot", 2), ("f", "x", record)], "f string, t string, r int").repartition(3)
    runs = terms.sorted_runs(pairs, "f", "t", "r")
    assert {(r["t"], r["occurrences"], r["records"]) for r in terms.frequencies(pairs, "f", "t", "r").collect()} == {("hot", 3001, 2), ("x", 1, 1)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert terms.sorted_runs(pairs, "f", "t", "r").where("t = 'hot'").count() > 1
        assert {(r["t"], r["records"]) for r in terms.frequencies(pairs, "f", "t", "r").collect()} == {("hot", 2), ("x", 1)}
        plan = runs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Sort" in plan[plan.index("MapInArrow") : plan.index("rangepartitioning")], plan


def test_marks_and_empty(spark):
    df = spark.createDataFrame([("f", "a", n) for n in range(2)] + [("f", "b", n) for n in range(3)] + [("f", "c", n) for n in range(11)], "f string, t string, r int")
    assert {r["t"]: r["mark"] for r in terms.term_table(df, 100, "f", "t", "r").collect()} == {"a": "rare", "b": None, "c": "common"}
    assert terms.term_table(df.where("false"), 0, "f", "t", "r").count() == 0


# --- problem 4


def nearest_rank(values, p):
    return sorted(values)[max(1, -(-p * len(values) // 100)) - 1]


@pytest.mark.parametrize("limit", [1, 40, 256])
def test_percentiles_are_exact(spark, limit):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([rng.randrange(1000), 7, None])) for _ in range(700)]
    want = defaultdict(list)
    for g, v in rows:
        if v is not None:
            want[g].append(v)
    df = spark.createDataFrame(rows, "g string, v bigint").repartition(5)
    rounds = []
    found = selection.percentiles(df, ["g"], "v", (1, 50, 90, 99, 100), limit, rounds).collect()
    assert rounds and rounds[-1] <= rounds[0]  # the group `hot` is over every limit
    assert {r["g"]: (r["n"], r["p1"], r["p50"], r["p90"], r["p99"], r["p100"]) for r in found} == {g: (len(v), *(nearest_rank(v, p) for p in (1, 50, 90, 99, 100))) for g, v in want.items()}


def test_one_value_only_and_empty(spark):
    df = spark.createDataFrame([("g", 3)] * 300, "g string, v bigint")
    rounds = []
    assert [tuple(r) for r in selection.percentiles(df, ["g"], "v", (50,), 10, rounds).collect()] == [("g", 300, 3)]
    assert rounds == [300]
    assert selection.percentiles(df.where("false"), ["g"], "v", (50,)).count() == 0


def test_rounds_discard_what_is_ruled_out(spark):
    df = spark.range(20_000).selectExpr("id % 3 = 0 as b", "'x' as range", "cast(id * 7919 % 20000 as double) v")
    rounds = []
    found = selection.percentiles(df, ["b", "range"], "v", (50, 99), 300, rounds)
    want = {b: sorted((n * 7919 % 20000) for n in range(20_000) if (n % 3 == 0) == b) for b in (True, False)}
    assert {r["b"]: (r["p50"], r["p99"]) for r in found.collect()} == {b: (nearest_rank(v, 50), nearest_rank(v, 99)) for b, v in want.items()}
    assert rounds[0] == 20_000 and rounds[-1] < rounds[0] / 8 and len(rounds) > 4
    assert "Literal" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_query_goes_through_the_selection(spark, monkeypatch):
    made, real = [], selection.percentiles
    monkeypatch.setattr(selection, "percentiles", lambda *a: real(*a, rounds=made))
    assert queries.p4_percentiles(spark, "/root/testdata/sf0.01").count() > 100
    assert len(made) >= 1


def test_merged_within_one_percent(spark):
    rng = random.Random(3)
    rows = [(d, rng.lognormvariate(8, 3)) for d in range(4) for _ in range(rng.choice([3, 800, 3000]))]
    df = spark.createDataFrame(rows, "d int, v double").selectExpr("d", "'x' g", "v")
    parts = selection.summaries(df, ["g", "d"], "v", limit=1000)
    assert parts.selectExpr("max(size(points))").first()[0] <= selection.POINTS + 1
    row = selection.merged(parts, ["g"], (50, 90, 99)).first()
    values = sorted(v for _, v in rows)
    assert row["n"] == len(values)
    for p in (50, 90, 99):
        at = sum(v <= row[f"p{p}"] for v in values)
        assert abs(at - p * len(values) / 100) <= 0.01 * len(values) + 1


# --- problem 7

ENCODER = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read(), bpe.default_pattern())


def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


REFERENCE = reference()


def mine(text):
    import numpy as np

    return np.frombuffer(ENCODER.encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert mine(text) == REFERENCE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 20_000, " " * 5000 + "x", "don't we'll  \n\n x", "=" * 999, "\x85\x1c\x1f᠎　x", "ab" * 9999])
def test_ids_of_odd_texts(text):
    assert mine(text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_every_token_encodes_as_itself():
    signs = bpe._byte_signs()
    for token, number in REFERENCE.get_vocab().items():
        if token != "<|endoftext|>" and number % 7 == 0:
            import numpy as np

            word = bytes(signs[c] for c in token)
            try:
                text = word.decode("utf-8")
            except UnicodeDecodeError:
                continue
            assert np.frombuffer(ENCODER.encode_word(text), np.int32).tolist() == [number]


def test_ids_of_a_table(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (4, "x" * 9, 5)], "k int, text string, ids int")
    found = {r["k"]: r["ids"] for r in bpe.token_ids(df, "k", "text").collect()}
    assert found == {1: [31373, 995], 2: [], 3: [], 4: REFERENCE.encode("x" * 9).ids}
    assert {r["k"]: r["n_tokens"] for r in bpe.token_counts(df, "k", "text").collect()} == {k: len(v) for k, v in found.items()}
    assert bpe.token_ids(df.where("false"), "k", "text").count() == 0


# --- problem 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300), st.integers(1, 20))
def test_best_fit_never_overfills(sizes, open_bins):
    bins, used = binpack.BestFit(50, open_bins), Counter()
    for s in sizes:
        used[bins.put(s)] += s
        assert bins.n_open <= open_bins
        assert sum(map(len, bins.bins.values())) == bins.n_open
    assert all(u <= 50 for u in used.values())


def test_best_fit_takes_the_fullest_that_fits():
    bins = binpack.BestFit(10)
    assert [bins.put(s) for s in (6, 7, 3, 4, 10, 1)] == [0, 1, 1, 0, 2, 3]


def test_pack_keeps_every_token(spark):
    rng = random.Random(4)
    items = [(n, rng.choice([1, 3, 100, 250, 1000, 0, None])) for n in range(500)] + [(7, 3)]
    df = spark.createDataFrame(items, "k int, size int")
    rows = binpack.pack(df, "k", "size", [("s", 100), ("l", 1000), ("none", 0)]).collect()
    for kind, capacity in (("s", 100), ("l", 1000)):
        load, per = Counter(), Counter()
        for r in rows:
            if r["bundle_kind"] == kind:
                load[r["container_id"]] += r["size"]
                per[r["k"]] += r["size"]
                assert r["start_at"] == r["piece_no"] * capacity
        want = Counter()
        for k, s in items:
            want[k] += s or 0
        assert max(load.values()) <= capacity
        assert per == +want
        assert all(r["piece_no"] == 0 for r in rows if kind == "l" and r["bundle_kind"] == "l")
        assert len(load) <= 1.05 * sum(load.values()) / capacity + 1
    assert binpack.pack(df.where("false"), "k", "size", [("s", 100)]).count() == 0


# --- problem 9


def look(text):
    """A whole normal form, made differently: decompose, map, drop, compose."""
    to, unseen = lookalike.tables()
    mapped = "".join(to.get(c, c) for c in unicodedata.normalize("NFD", text) if c not in unseen)
    return unicodedata.normalize("NFC", mapped)


TEXTS = ["café noir", "café noir", "cafe noir", "Café noir", "cafе́ noir", "ｃafé　noir", "café​ noir", "café  noir", "café\nnoir", "x²", "x2", "ｘ２", "ﾌﾞﾛｯｸ", "ブロック", "フロック", "​", "", None, " ", "x2", "a;b", "a;b", "K", "K", "don’t", "don't", "👩‍💻", "Ή", "H́"]


def test_pairs_against_brute_force(spark):
    rows = list(enumerate(TEXTS))
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and x != y and look(x).strip() and look(x) == look(y)}
    df = spark.createDataFrame(rows, "k int, t string").selectExpr("k", "t", "'z' look", "'z' rep")
    assert {tuple(r) for r in lookalike.pairs(df, "k", "t").collect()} == want
    assert (0, 1) in want and (9, 10) not in want and (1, 2) not in want and (1, 3) not in want
    assert lookalike.pairs(df.where("false"), "k", "t").count() == 0


@pytest.mark.parametrize(("odd", "plain"), [("ρ", "p"), ("Ⅰ", "I"), ("ⅽ", "c"), ("ꓐ", "B"), ("Ⲟ", "O"), ("Ꭰ", "D"), ("ᏙᎪ", "VA"), ("ѵ", "v"), ("Տ", "S")])
def test_letters_of_other_scripts(spark, odd, plain):
    df = spark.createDataFrame([(1, f"a{odd}b"), (2, f"a{plain}b")], "k int, t string")
    assert [tuple(r) for r in lookalike.pairs(df, "k", "t").collect()] == [(1, 2)]
    assert lookalike.tables()[0][odd[0]] == plain[0]


def test_recall_over_the_whole_table(spark):
    """Every mapped letter, in a word of its own that no fixture of the tables uses, against its plain twin."""
    to = [(a, b) for a, b in lookalike.tables()[0].items() if b.strip() and unicodedata.category(b) not in ("Mn", "Me")]
    rows = [(2 * n, f"w{n}{a}x") for n, (a, _) in enumerate(to)] + [(2 * n + 1, f"w{n}{b}x") for n, (_, b) in enumerate(to)]
    found = {tuple(r) for r in lookalike.pairs(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    want = {(2 * n, 2 * n + 1) for n in range(len(to))}
    assert not [to[a // 2] for a, _ in want - found]
    assert not found - want


def test_links_name_every_text_of_a_class(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "аb"), (4, "zz"), (5, "a\u200bb")], "k int, t string")
    assert {tuple(r) for r in lookalike.links(df, "k", "t").collect()} == {(1, 1, 2), (1, 3, 1), (1, 5, 1)}


def test_copies_share_a_class_and_make_no_pair(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "аb"), (4, "zz"), (5, "zz")], "k int, t string")
    assert {tuple(r) for r in lookalike.pairs(df, "k", "t").collect()} == {(1, 3), (2, 3)}
    assert {r["k"]: r["class_id"] for r in lookalike.members(df, "k", "t").collect()} == {1: 1, 2: 1, 3: 1}


def test_long_text_is_compared_whole(spark):
    long = "word " * 40_000
    df = spark.createDataFrame([(1, long + "a"), (2, long + "а"), (3, long + "b")], "k int, t string")
    assert [tuple(r) for r in lookalike.pairs(df, "k", "t").collect()] == [(1, 2)]


def test_null_days_have_their_own_group(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", datetime.date(2025, 1, 1), 5)], "g string, d date, v bigint")
    assert {(r["g"], r["d"]): r["p50"] for r in selection.percentiles(df, ["g", "d"], "v", (50,)).collect()} == {("a", None): 1, ("a", datetime.date(2025, 1, 1)): 5}
