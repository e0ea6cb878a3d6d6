"""Texts that look the same but differ in their characters: equivalence classes, one form for each, and their pairs.

1. `look_keys`: every text is folded coarsely (decomposed; marks and invisible characters dropped; width forms, blanks
   and look-alikes mapped) to a 64-bit key. Equal looks give equal keys, so only texts whose key occurs with another text
   can be in a class; the others are classes of their own. Only keys and digests are shuffled.
2. `classes`: of these, one representative per exact text is mapped in SQL by `translate`, and the mapped values are
   grouped under the accent-sensitive Unicode collation UNICODE, for which case, accents, raised digits, punctuation,
   line breaks and the number of blanks count, and the composition of accents doesn't. Each class has a canonical member:
   one whose text needs no mapping if there is one, and the least key among these. It is joined back by the collation.
3. `members` carries the class to all copies of the representatives; `links` pairs representatives with their canonical
   member, a row per text and not per pair; `pairs` gives all pairs of differently written rows, as many as there are.
   Spark splits a class that holds many rows while it joins (adaptive skew join).

Letters read alike are those of the public confusables data in Greek capitals, Cyrillic, Armenian, Coptic, Cherokee, Lisu
and Roman numerals, and a fixed list. Ligatures, dotless and styled letters (bold, script) count as visibly different.
Null texts and texts without a visible character have no class. Exact copies share a class but make no pair.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsift.llm.confusables import letters
from plainsift.shared import materialize

COLLATION = "UNICODE"

# Letters and signs of the same shape, and what each is read as; beside the letters of confusables.letters.
SAME_SHAPE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ԍ": "G", "Ғ": "F",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Latin, Armenian and others
    "ɡ": "g", "ɑ": "a", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "Ս": "U", "Օ": "O", "Ꭺ": "A", "Ꭼ": "E", "Ꮯ": "C", "Ꮪ": "S", "Ꭲ": "T", "Ꮋ": "H", "Ꮇ": "M", "Ꮲ": "P", "Ꮃ": "W",
    # signs
    ";": ";", "‐": "-", "‑": "-", "−": "-", "﹣": "-", "∶": ":", "꞉": ":", "։": ":", "׃": ":", "⁄": "/", "∕": "/", "∣": "|", "ǀ": "|", "ǃ": "!", "․": ".", "∗": "*", "﹨": "\\", "∖": "\\", "ˆ": "^", "˜": "~", "∼": "~", "‚": ",", "·": "·", "∙": "·", "⋅": "·", "ꓸ": ".",
}


def _all() -> Iterator[str]:
    return (chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)


@lru_cache(1)
def tables() -> tuple[dict[str, str], str]:
    """The characters that are read as another one (width forms, blanks, same shapes), and those that can't be seen.

    Width forms are those that Unicode decomposes as wide or narrow; blanks are its space separators; invisible are its
    format and control characters (but for tabs and line breaks), the variation selectors, the joiner of graphemes, and
    the fillers.
    """
    to, unseen = {}, []
    for c in _all():
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Lo") and not 0xFF00 <= ord(c) < 0xFFF0:
            continue
        if unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            to[c] = unicodedata.normalize("NFKC", c)
        elif kind == "Zs":
            to[c] = " "
        elif kind == "Cf" or (kind == "Cc" and c not in "\t\n\v\f\r\x85") or unicodedata.name(c, "").startswith("VARIATION SELECTOR"):
            unseen.append(c)
    shapes = letters() | SAME_SHAPE
    to |= shapes | {"゛": "゙", "゜": "゚", "ﾞ": "゙", "ﾟ": "゚"}
    unseen = dict.fromkeys([*unseen, *"͏ᅟᅠ឴឵ㅤﾠ"])
    to = {a: shapes.get(b, b) for a, b in to.items() if a != b and len(b) == 1 and a not in unseen}
    return to, "".join(unseen)


@lru_cache(2)
def _coarse_table(to: tuple[tuple[str, str], ...], unseen: str) -> dict[int, str | None]:
    to = dict(to)
    out: dict[int, str | None] = {ord(a): None if unicodedata.category(b) in ("Mn", "Me") else b for a, b in to.items()}
    out |= {ord(c): None for c in _all() if unicodedata.category(c) in ("Mn", "Me")} | {ord(c): None for c in unseen}
    return out


_VISIBLE = re.compile(r"\S")


def coarse(text: str, table: dict[int, str | None]) -> str:
    """The text as it looks, but for accents and other marks."""
    return text if text.isascii() and text.isprintable() else unicodedata.normalize("NFD", text).translate(table)


def look_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """`<key>, look, digest`: the coarse key and the exact digest of each text with a visible character. The tables go to
    the tasks with the function: some thousand characters, whatever the data."""
    to, unseen = tables()
    pairs_ = tuple(to.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _coarse_table(pairs_, unseen)
        for batch in batches:
            at, looks, digests = [], [], []
            for n, value in enumerate(batch.column(text).to_pylist()):
                if value and _VISIBLE.search(folded := coarse(value, table)):
                    at.append(n)
                    looks.append(xxhash.xxh3_64_intdigest(folded.encode("utf-8", "surrogatepass")) - (1 << 63))
                    digests.append(xxhash.xxh3_128_digest(value.encode("utf-8", "surrogatepass")))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int32())), pa.array(looks, pa.int64()), pa.array(digests, pa.binary())], names=[key, "look", "digest"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, look bigint, digest binary")


def _candidates(keys: DataFrame, key: str) -> DataFrame:
    """`rep, look, digest` of texts whose look occurs with another text: one row per exact text."""
    texts = keys.groupBy("look", "digest").agg(F.min(key).alias("rep"))
    looks = texts.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("look")
    return texts.join(looks, "look", "left_semi")


def _decomposed(df: DataFrame, text: str) -> DataFrame:
    @F.pandas_udf("string")
    def nfd(values):  # noqa: ANN001, ANN202
        return values.map(lambda v: unicodedata.normalize("NFD", v))

    return df.withColumn("_nfd", nfd(F.col(text)))


def mapped(col):  # noqa: ANN001, ANN201
    """A decomposed text with width forms, blanks and same shapes mapped, and without invisible characters, in SQL."""
    to, unseen = tables()
    return F.translate(col, "".join(to) + unseen, "".join(to.values()))


def classes(df: DataFrame, keys: DataFrame, key: str, text: str) -> DataFrame:
    """`rep, look, digest, class_id, form`: the class and its form of every exact text that may share its look.

    class_id is the key of the canonical member, form its mapped text.
    """
    found = materialize(_candidates(keys, key), "look-candidates")
    # a written table has a known size: it is broadcast below Spark's threshold, and shuffled with the texts beyond it
    texts = df.select(F.col(key).alias("rep"), F.col(text).alias("_text")).join(found, "rep")
    looks = _decomposed(texts, "_text").select("rep", "look", "digest", mapped(F.col("_nfd")).alias("form"), (F.col("_text") != mapped(F.col("_text"))).alias("changed"))
    looks = materialize(looks, "look-forms").withColumn("seen", F.expr(f"form COLLATE {COLLATION}"))
    canon = looks.groupBy("seen").agg(F.min(F.struct("changed", "rep")).alias("canon"), F.count(F.lit(1)).alias("n")).where("n > 1")
    chosen = looks.alias("l").join(canon.alias("c"), F.col("l.seen") == F.col("c.seen"))
    return chosen.select("l.rep", "l.look", "l.digest", F.col("c.canon.rep").alias("class_id"), "l.form")


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """`<key>, rep, class_id`: the class of every text that looks like another, differently written one."""
    keys = materialize(look_keys(df, key, text), "look-keys")
    found = classes(df, keys, key, text).select("rep", "look", "digest", "class_id")
    return keys.join(found, ["look", "digest"]).select(key, "rep", "class_id")


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """`class_id, rep, n_rows`: each exact text of a class by its least key, with the number of its copies. With `members` this
    is every link between different texts, without expanding copies or all pairs of a class."""
    return members(df, key, text).groupBy("class_id", "rep").agg(F.count(F.lit(1)).alias("n_rows"))


def pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """`<key>_a, <key>_b` with a before b: texts that look the same and differ in their characters.

    Copies of a text are paired with every text that differs from it, as the result asks for pairs of rows; they make
    no pairs among themselves.
    """
    every = materialize(members(df, key, text), "look-members")
    a, b = every.alias("a"), every.alias("b")
    on = (F.col("a.class_id") == F.col("b.class_id")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.col("a.rep") != F.col("b.rep"))
    return a.join(b, on).select(F.col(f"a.{key}").alias(f"{key}_a"), F.col(f"b.{key}").alias(f"{key}_b"))
