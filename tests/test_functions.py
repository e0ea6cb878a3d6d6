"""Text and byte functions on fixed cases."""

import math

import pytest
from pyspark.sql import functions as F

from plainsift.functions import binary, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: text.clip(F.lit(" a\n b\x01 ")), "a b."),
        (lambda: text.clip(F.lit("x" * 70)), "x" * 57 + "…"),
        (lambda: text.human_size(F.lit(1536)), "1.5 KB"),
        (lambda: text.human_size(F.lit(5)), "5 B"),
        (lambda: text.is_text(F.lit("a\tb\n")), True),
        (lambda: text.is_text(F.lit("a\x00")), False),
        (lambda: text.is_text(F.lit("<?xpacket begin")), False),
        (lambda: text.strip_comments(F.lit("a<!-- x --><![CDATA[<!-- k -->]]><!-- open")), "a<![CDATA[<!-- k -->]]><!-- open"),
        (lambda: text.strip_instructions(F.lit('<?xml version="1.0"?><?app x?>b')), '<?xml version="1.0"?>b'),
        (lambda: text.strip_element(F.lit("<a/><meta x='1'>t</meta><metab/>"), "meta"), "<a/><metab/>"),
        (lambda: text.relative_path(F.lit("word/document.xml"), F.lit("../media/./a.png")), "media/a.png"),
        (lambda: text.relative_path(F.lit("a.xml"), F.lit("../../b")), "b"),
        (lambda: text.humanise(F.lit("test_one__two")), "One two"),
        (lambda: text.generated_by(F.lit("Created with Tool 3")), True),
        (lambda: text.looks_like_file(F.lit("C:\\x")), True),
        (lambda: text.user_paths(F.lit("in /home/ann/x")), ["/home/ann"]),
        (lambda: text.data_uris(F.lit('<a href="data:text/plain;base64,aGk=" b="data:,x%20y">')), [("text/plain", bytearray(b"hi")), ("", bytearray(b"x y"))]),
        (lambda: text.tag_name(F.lit("Group:Copy3:Tag")), "Tag"),
        (lambda: binary.big_endian(F.lit(b"\0\1\2\3"), 1, 3), 66051),
        (lambda: binary.little_endian(F.lit(b"\0\1\2\3"), 1, 2), 513),
        (lambda: binary.syncsafe(F.lit(b"\0\0\x01\x7f"), 0), 255),
        (lambda: binary.blanked(F.lit(b"abcdef"), 2, 3), bytearray(b"ab\0\0\0f")),
        (lambda: binary.hex_context(F.lit(b"0123456789"), F.lit(4), F.lit(1), 2), "3233343536"),
        (lambda: binary.shifted(F.array(F.lit(5), F.lit(9)), F.lit(-5), F.lit(10)), [0, 4]),
        (lambda: binary.shifted(F.array(F.lit(4)), F.lit(-5), F.lit(10)), None),
        (lambda: binary.hamming(F.lit(5), F.lit(6)), 2),
        (lambda: binary.rmse(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))), 3.54),
        (lambda: binary.band_limit(F.lit(22050)), 10143),
        (lambda: binary.similar_enough(F.lit(0.8), F.lit(0.99)), True),
        (lambda: binary.pooled(F.array(*[F.lit(float(n)) for n in range(4)]), 2), [0.5, 2.5]),
    ],
)
def test_value(spark, make, want):
    found = value(spark, make())
    assert ([tuple(x) if isinstance(x, tuple) else x for x in found] if isinstance(found, list) else found) == want


def test_uuid_has_version_and_variant(spark):
    found = value(spark, binary.uuid8(F.lit("x")))
    assert found[14] == "8"
    assert found[19] in "89ab"


def test_binomial_tail(spark):
    want = sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(5, 11))
    assert abs(value(spark, binary.binomial_tail(F.lit(5), F.lit(10), F.lit(0.3))) - want) < 1e-12
    assert value(spark, binary.binomial_tail(F.lit(0), F.lit(10), F.lit(0.3))) == 1.0
    assert value(spark, binary.binomial_tail(F.lit(None).cast("int"), F.lit(10), F.lit(0.3))) is None


def test_signals(spark):
    wave = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.sin(i / 10.0))
    assert value(spark, binary.lag_correlation(wave, wave)) > 0.999
    assert len(value(spark, binary.framed_energy(wave, 256, 128, 4))) == 6
