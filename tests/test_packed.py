"""Splitting of packed fields."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plainsift.operators import packed
from plainsift.operators.packed import Code, unpack, unpack_records, value_code

CODE = Code({"EXIF block": 50, "GPS position": 30, "capture time, local": 10, "orientation": 10}, 100)


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("EXIF block; GPS position", ["EXIF block", "GPS position"]),
        ("EXIF block,GPS position", ["EXIF block", "GPS position"]),
        ("EXIF block | GPS position\tx", ["EXIF block", "GPS position", "x"]),
        ("EXIF block；GPS position\r\nx", ["EXIF block", "GPS position", "x"]),
        ('"capture time, local"; EXIF block', ["capture time, local", "EXIF block"]),
        ("'capture time, local'; 'EXIF block'", ["capture time, local", "EXIF block"]),
        ("capture time\\, local, EXIF block", ["capture time, local", "EXIF block"]),
        ('["capture time, local", "a ""b"""]', ["capture time, local", 'a "b"']),
        ('["capture time, local","say \\"x\\"; y"]', ["capture time, local", 'say "x"; y']),
        ("[EXIF block; GPS position]", ["EXIF block", "GPS position"]),
        ('"edit history (""saved"" steps)"; x', ['edit history ("saved" steps)', "x"]),
        ("owner's name, publisher's remark", ["owner's name", "publisher's remark"]),
        ("; ;", []),
        ("none", []),
        ("[]", []),
        ("–", []),
        ("  ", []),
        ("x; x; x", ["x", "x", "x"]),
        ('"never closed; x', ['"never closed', "x"]),
    ],
)
def test_each_dialect(text, items):
    assert list(CODE.cheapest(text)) == items


STYLES = {
    "double": lambda xs: "; ".join('"' + x.replace('"', '""') + '"' for x in xs),
    "single": lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs),
    "backslash": lambda xs: " | ".join("".join("\\" + c if c in ';,|\\"' else c for c in x) for x in xs),
}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.from_regex(r"[a-z]{3,8}[;,|] [a-z]{3,8}", fullmatch=True), min_size=1, max_size=5), st.sampled_from(sorted(STYLES)))
def test_round_trip(items, style):
    assert list(CODE.cheapest(STYLES[style](items))) == items


def test_very_long_field():
    items = [f"item {n}; part" for n in range(50_000)]
    assert list(CODE.cheapest(STYLES["double"](items))) == items


def test_rows_keep_key_and_position(spark):
    df = spark.createDataFrame([(1, "a; b", None, "x"), (2, None, "", "y"), (3, "c", "d,e", "z")], "k int, item string, pos_no string, field_name string")
    got = unpack(df, "k", ["item", "pos_no"], value_code(df, ["item", "pos_no"]))
    assert sorted(map(tuple, got.collect())) == [(1, "item", 0, "a"), (1, "item", 1, "b"), (3, "item", 0, "c"), (3, "pos_no", 0, "d"), (3, "pos_no", 1, "e")]


def test_repeated_records_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a; b", 1), (1, "a; b", 2), (None, "c", 1), (None, "c", 1)], "k int, f string, at int")
    assert sorted(r["item"] for r in unpack_records(df, "k", ["f"], ["at"]).collect()) == ["a", "b", "c", "c"]
    assert unpack_records(df.where("false"), "k", ["f"], ["at"]).count() == 0


def test_delimiters_are_scored():
    code = packed.Code({"Author": 50, "GPS": 30, "Make": 20}, 100)
    assert code.cheapest("Author; GPS, Make") == ("Author", "GPS", "Make")
    assert packed.delimiter_sets("a;b,c") == [packed.SEPARATORS, ";", ","]
    assert packed.delimiter_sets("a;b;c") == [packed.SEPARATORS]
    parses = dict((tuple(items), bare) for items, bare in packed.candidates("Author; GPS, Make"))
    assert parses == {("Author", "GPS", "Make"): 0, ("Author", "GPS, Make"): 1, ("Author; GPS", "Make"): 1}
    assert code.cheapest('"a;b;c;d;e", x') == ("a;b;c;d;e", "x")  # protected separators cost nothing more
    assert code.cheapest("q; r | s, t") == ("q", "r", "s", "t")
