"""Functions of markup, values and signals, on the cases that tables don't bring."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plainsift.functions import binary, markup, values
from plainsift.operators import features, matching, mutations, reporting
from plainsift.sources import files, fixtures, inner


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


NAMES = st.sampled_from(["a", "b", "p:c", "q:d"])


def tree(depth):
    attrs = st.dictionaries(st.sampled_from(["x", "y", "p:z"]), st.text(alphabet="ab<&\"\n", max_size=4), max_size=2)
    inner_ = st.lists(tree(depth - 1), max_size=3) if depth else st.just([])
    return st.tuples(NAMES, attrs, st.text(alphabet="ab <&>", max_size=5), inner_)


def written(node, quote="\"", root=True):
    from xml.sax.saxutils import escape

    name, attrs, text, children = node
    space = " xmlns:p='u:p' xmlns:q='u:q'" if root else ""
    held = "".join(f" {k}={quote}{escape(v, {quote: '&quot;' if quote == chr(34) else '&apos;', chr(10): '&#10;'})}{quote}" for k, v in attrs.items())
    return f"<{name}{space}{held}>{escape(text)}{''.join(written(c, quote, False) for c in children)}</{name} >"


@settings(max_examples=200, deadline=None)
@given(tree(2))
def test_canonical_is_one_spelling_and_stable(node):
    once = markup.canonical_text(written(node))
    assert markup.canonical_text(once) == once
    assert markup.canonical_text(written(node, "'").replace("xmlns:p='u:p' xmlns:q='u:q'", "xmlns:q='u:q' xmlns:p='u:p'")) == once


def test_canonical_of_what_is_no_markup(spark):
    df = spark.createDataFrame([("<a>",), (None,), ("",), ("<a/>",)], "t string")
    assert [r["v"] is None for r in df.select(markup.canonical("t").alias("v")).collect()] == [True, True, True, False]


def test_nesting_and_quotes(spark):
    part = F.lit('<a><x k=">"><x/>in<x>q</x></x><xy/>t<x></a>')
    assert value(spark, markup.remove_elements(part, "x")) == "<a><xy/>t<x></a>"
    assert value(spark, markup.unwrap_elements(part, "x")) == "<a>inq<xy/>t<x></a>"
    assert value(spark, markup.remove_elements(part, "x", 'k="')) == "<a><xy/>t<x></a>"
    assert value(spark, markup.remove_elements(F.lit(None).cast("string"), "x")) is None


@pytest.mark.parametrize(("kind", "raw", "n", "little", "want"), [(3, b"\1\0", 1, True, "1"), (10, b"\xff\xff\xff\xff\0\0\0\2", 1, False, "-0.5"), (5, bytes(8), 1, False, "0"), (7, b"\xff\xfe", 2, False, "(2 bytes)"), (2, b"\0x", 2, False, None), (99, b"x", 1, False, None), (4, b"\1", 1, True, None)])
def test_field_values(spark, kind, raw, n, little, want):
    assert value(spark, values.field_value(F.lit(raw), F.lit(kind), F.lit(n), F.lit(little))) == want


def test_page_spellings(spark):
    for number, want in (("-0.0000", "0"), ("12.5000", "12.5"), ("100", "100"), ("-3.10", "-3.1"), ("0.00000001", "0.00000001")):
        assert value(spark, values.page_number(F.lit(number).cast("decimal(20,10)"))) == want
    assert value(spark, values.page_name(F.lit("/A#42 x"))) == "/AB#20x"
    assert value(spark, values.page_string(F.lit(b"a\n"))) == "<610A>"


def test_font_keys_and_copies(spark):
    assert value(spark, values.font_key(F.lit("no uuid"), "adobe")) is None
    key = values.font_key(F.lit("urn:uuid:00000000-0000-0000-0000-0000000000ff"), "adobe")
    assert value(spark, values.hidden_font(F.lit(bytes(2000)), key, "adobe")) == (bytes(15) + b"\xff") * 64 + bytes(976)
    texts = F.array(F.lit(b"ab"), F.lit(b"abc"), F.lit(None).cast("binary"), F.lit(b""))
    assert value(spark, values.blank_copies(F.lit(b"xabcabx"), texts)) == b"x\0\0\0\0\0x"


def test_signals_against_definitions(spark):
    rng = np.random.default_rng(1)
    wave = rng.normal(size=3000)
    array = lambda x: F.array(*[F.lit(float(v)) for v in x[:600]])
    assert value(spark, binary.best_lag(array(wave), array(wave[75:])))["lag"] == 75
    assert value(spark, binary.best_lag(array(np.zeros(30)), array(wave))).asDict() == {"lag": 0, "correlation": 0.0}
    assert value(spark, binary.envelope_similarity(array(wave), array(wave), 64, 32, 4)) > 0.999
    whole = binary.band_limited(wave, 3000, 400, block=1 << 20)
    blocks = binary.band_limited(wave, 3000, 400, block=1024, overlap=256)
    assert np.abs(whole - blocks)[300:-300].max() < 0.2
    assert np.abs(np.fft.rfft(whole))[401:].max() < 1e-9
    assert len(binary.band_limited([], 10, 1)) == 0


def test_damage_is_the_same_in_every_run(spark):
    df = spark.createDataFrame([(1, fixtures.png_file(b"n"), "x"), (2, b"", "y"), (3, None, "z")], "k int, c binary, kind string")
    a, b = (mutations.mutations(df, "k", "c", 5).collect() for _ in range(2))
    assert a == b and len(a) == 7 and {r["k"] for r in a} == {1}
    within = mutations.mutations(df, "k", "c", 20, within=True).collect()
    from plainsift.sources import containers

    assert len(within) == 20 and all(containers.parts("png", bytes(r["content"])) for r in within if "IHDR" not in r["kind"])


def test_campaign_adds_up(spark):
    rows = spark.createDataFrame([("a", "cleaned", None, 0.1), ("a", "refused", "at 5", 0.5), ("a", "refused", "at 77", 0.2), ("b", "error", "x", 9.0)], "s string, outcome string, notes string, seconds double")
    got = {r["s"]: (r["n"], r["cleaned"], r["refused"], r["errors"], r["slowest"], r["rules"]) for r in mutations.campaign(rows, "s").collect()}
    assert got == {"a": (3, 1, 2, 0, 0.5, 1), "b": (1, 0, 0, 1, 9.0, 0)}


@pytest.mark.parametrize("kind", ["png", "jpeg", "gif", "webp", "flac", "mp3", "bmp", "svg", "mp4", "tiff", "zip", "docx", "pdf"])
def test_features_of_every_kind(kind):
    got = dict(features.features(kind, fixtures.MAKERS[kind](b"a note")))
    assert "struct:malformed" not in got and len(got) >= 4, got
    assert features.features(kind, fixtures.MAKERS[kind](b"a note")) == sorted(got.items())
    assert dict(features.features(kind, b"\0\1")) == {"struct:malformed": "true"}


def test_features_see_what_a_writer_chooses(spark):
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as out:
        out.writestr(zipfile.ZipInfo("b.txt", (2024, 5, 1, 1, 1, 2)), "x")
        out.writestr(zipfile.ZipInfo("a.txt", (2024, 5, 1, 1, 1, 2)), "y")
    got = dict(features.features("zip", held.getvalue()))
    assert (got["zip:times"], got["zip:order"], got["zip:methods"]) == ("clock, 1 times", "own order", "[0]")
    df = spark.createDataFrame([(1, held.getvalue()), (2, None), (3, b"\0"), (4, b"")], "k int, c binary")
    assert {r["k"] for r in features.feature_table(df, ["k"], "c").collect()} == {1}


def test_small_comparisons(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "v string, n int")
    right = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "v string, n int")
    assert {tuple(r) for r in matching.multiset_diff(left, right, ["v", "n"]).collect()} == {("a", 1, 2, 1), ("b", 3, 0, 1)}
    assert matching.multiset_diff(left, left.where("true"), ["v", "n"]).isEmpty()
    streams = lambda rows: spark.createDataFrame(rows, "s int, at int, v string")
    wrong = matching.sequence_diff(streams([(1, 1, "a"), (1, 2, None), (2, 1, "x")]), streams([(1, 1, "a"), (1, 2, None), (2, 1, "y"), (2, 2, "z")]), "s", "at", "v")
    assert [tuple(r) for r in wrong.collect()] == [(2, 2, 1)]
    assert reporting.rate_report(left.withColumnRenamed("n", "r"), "v", "r", "r").count() == 2
    found = files.discovered(spark.createDataFrame([("x/gen_a.py",), ("y/gen_a.py",), ("gen.py",), (None,)], "p string"), "p", r"^gen_(\w+)\.py$", {"gen.py": "first"})
    assert {tuple(r) for r in found.collect()} == {("a", "y/gen_a.py"), ("first", "gen.py")}


def test_a_page_that_restores_too_much():
    from plainsift.sources.containers import Malformed

    with pytest.raises(Malformed):
        inner.page_positions(b"Q")
    assert inner.page_positions(b"BT 1 2 TD (a) Tj T* (b) ' ET") == [("(a)", "1 2 0"), ("(b)", "1 6 0")]
