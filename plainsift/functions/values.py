"""Spellings and encodings of single values: sizes, picture fields, page descriptions, hidden fonts, copies of texts."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The widths and codes of the types of picture fields, and the first bytes of a font that each way of hiding covers.
FIELD_TYPES = {1: (1, "B"), 2: (1, ""), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, ""), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
HIDDEN_BYTES = {"idpf": 1040, "adobe": 1024}


def decimal_size(n: Column) -> Column:
    """A number of bytes in MB or GB of 10^6 and 10^9, one decimal."""
    one = lambda x: F.round(x, 1).cast("decimal(20,1)").cast("string")
    return F.when(n >= 1_000_000_000, F.concat(one(n / 1_000_000_000), F.lit(" GB"))).otherwise(F.concat(one(n / 1_000_000), F.lit(" MB")))


def seconds(n: Column) -> Column:
    """A time in seconds, or in minutes and seconds from a minute on."""
    whole = F.round(n).cast("bigint")
    return F.when(n < 60, F.concat(F.round(n, 1).cast("decimal(20,1)").cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor(whole / 60), F.lit(" min "), F.lpad(F.pmod(whole, F.lit(60)).cast("string"), 2, "0"), F.lit(" s")))


def share_colour(percent: Column, steps: tuple = ((90, "brightgreen"), (75, "green"), (60, "yellow"), (40, "orange"))) -> Column:
    """The colour of a share by falling thresholds; red below them."""
    chain = F.lit("red")
    for least, colour in reversed(steps):
        chain = F.when(percent >= least, colour).otherwise(chain)
    return chain


def badge_text(col: Column) -> Column:
    """A text as an address of a badge takes it: dashes and underscores doubled, blanks as underscores."""
    return F.replace(F.replace(F.replace(col, F.lit("-"), F.lit("--")), F.lit("_"), F.lit("__")), F.lit(" "), F.lit("_"))


@F.pandas_udf(T.StringType())
def field_value(raw: pd.Series, kind: pd.Series, count: pd.Series, little: pd.Series) -> pd.Series:
    """A picture field's value as text: texts to their first zero byte, numbers joined by commas, three ratios as degrees,
    minutes and seconds. Null for unknown types and for bytes that are too few."""

    def one(data: bytes | None, kind: int, n: int, little: bool) -> str | None:
        width, code = FIELD_TYPES.get(kind, (0, ""))
        if data is None or not width or n < 0 or len(data) < width * n:
            return None
        data = bytes(data[: width * n])
        if kind in (2, 7):
            text = data.partition(b"\0")[0]
            return f"({len(data)} bytes)" if kind == 7 and not text.isascii() else text.decode("utf-8", "replace") or None
        numbers = struct.unpack(("<" if little else ">") + code * n, data)
        if kind in (5, 10):
            ratios = [a / b if b else 0.0 for a, b in zip(numbers[::2], numbers[1::2], strict=True)]
            return f"{ratios[0]:.0f}° {ratios[1]:.0f}' {ratios[2]:.2f}\"" if n == 3 else ", ".join(f"{r:g}" for r in ratios) or None
        return ", ".join(map(str, numbers))

    return pd.Series([one(*x) for x in zip(raw, kind, count, little, strict=True)])


def page_number(col: Column) -> Column:
    """A decimal number in one spelling: no exponent, no zeros at the end, no sign of zero, at most 8 places."""
    text = F.regexp_replace(F.regexp_replace(col.cast("decimal(30,8)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(text.isin("-0", ""), "0").otherwise(text)


def page_string(col: Column) -> Column:
    """Bytes as a string of a page description: literal where all is printable ASCII, else hex."""
    text = F.decode(col, "ISO-8859-1")
    literal = F.concat(F.lit("("), F.regexp_replace(text, r"([\\()])", r"\\$1"), F.lit(")"))
    return F.when(text.rlike(r"\A[\x20-\x7e]*\z"), literal).otherwise(F.concat(F.lit("<"), F.hex(col), F.lit(">")))


@F.pandas_udf(T.StringType())
def page_name(names: pd.Series) -> pd.Series:
    """A name of a page description in one spelling: escapes read, then written only where they must be."""
    import re

    plain = frozenset(range(33, 127)) - frozenset(b"#()<>[]{}/%")
    read = lambda n: re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), n.removeprefix("/").encode("latin-1", "replace"))
    return names.map(lambda n: None if n is None else "/" + "".join(chr(b) if b in plain else f"#{b:02X}" for b in read(n)))


def font_key(identifier: Column, way: str) -> Column:
    """The key that hides a book's fonts, of its identifier; null where a UUID is needed and it is none."""
    if way == "idpf":
        return F.unhex(F.sha1(F.regexp_replace(identifier, r"[ \t\r\n]", "")))
    digits = F.regexp_replace(F.trim(identifier), r"(?i)^urn:uuid:|-", "")
    return F.when(digits.rlike(r"\A[0-9a-fA-F]{32}\z"), F.unhex(digits))


def hidden_font(font: Column, key: Column, way: str) -> Column:
    """A font hidden by a key, or freed: its own inverse."""
    n = HIDDEN_BYTES[way]

    @F.pandas_udf(T.BinaryType())
    def crossed(fonts: pd.Series, keys: pd.Series) -> pd.Series:
        import numpy as np

        def one(font: bytes | None, key: bytes | None) -> bytes | None:
            if font is None or not key:
                return None
            head = np.frombuffer(font[:n], np.uint8)
            return (head ^ np.resize(np.frombuffer(key, np.uint8), len(head))).tobytes() + bytes(font[n:])

        return pd.Series([one(f, k) for f, k in zip(fonts, keys, strict=True)], dtype=object)

    return crossed(font, key)


@F.pandas_udf(T.BinaryType())
def blank_copies(regions: pd.Series, texts: pd.Series) -> pd.Series:
    """Regions of bytes with every copy of the given texts as zeros, longer texts first."""

    def one(region: bytes | None, wanted) -> bytes | None:  # noqa: ANN001
        if region is None or wanted is None:
            return region
        region = bytes(region)
        for text in sorted({bytes(t) for t in wanted if t is not None and len(t)}, key=lambda t: (-len(t), t)):
            region = region.replace(text, bytes(len(text)))
        return region

    return pd.Series([one(r, t) for r, t in zip(regions, texts, strict=True)], dtype=object)
