"""Several values packed in one field: parse every field with the dialect of minimum description length.

A dialect is a wrapper (none, square brackets, a JSON list), a quote sign (none, double, single), an escape (the doubled quote,
or a backslash) and its delimiters: all of SEPARATORS, or one of those that a field holds. Dialects are scored by code lengths,
in bits:

* `value_code` counts, over the fields that no dialect could read differently, how often each value occurs (a
  distributed aggregate), and keeps the values with at least 1/CODE_VALUES of all occurrences. There can be at most
  CODE_VALUES such values, so the code has a proven size and may go to every task. Their length is -log2(share).
* any other value costs an escape, and bits for each of its characters; signs that quote or escape cost more.
* a separator that a dialect leaves bare within an item costs BARE_BITS: writers protect separators within items, so it is
  a rare sign. A dialect whose items are frequent values without bare separators is the cheapest.

Each field takes its cheapest dialect; equal lengths are settled by the order of DIALECTS.

Nulls, empty fields, fields of separators only, and marks for "nothing" give no rows. A quote that is never closed is
an ordinary sign. Fields of any length are parsed whole. Values longer than MAX_CODED are never in the code.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsift.shared import BLANKS, clean, current_rows, materialize

# What separates items, and what stands for "nothing found".
SEPARATORS = ";,|\t\n\r；"
NOTHING = frozenset(["-", "–", "—", "none", "(none)", "n/a", "null", "[]"])

CODE_VALUES = 4096
MAX_CODED = 200
_SPECIAL = re.compile("[\"'\\\\\\[]")
_SEP = f"[{re.escape(SEPARATORS)}]"
_SPLIT = re.compile(f"{_SEP}+")
_CHAR_BITS, _SIGN_BITS, _ITEM_BITS = 5.0, 12.0, 2.0
BARE_BITS = 24.0
_KINDS_OF_SEP = re.compile(_SEP)
_SIGNS = re.compile("[\"'\\\\\\[\\]]")
ITEM_SCHEMA = "field_name string, pos_no int, item string"


@lru_cache(256)
def _pattern(quote: str, backslash: bool, delimiters: str = SEPARATORS) -> re.Pattern:
    sep = f"[{re.escape(delimiters)}]"
    bare = rf"((?:[^{re.escape(delimiters)}\\]|\\.|\\$)*)" if backslash else f"([^{re.escape(delimiters)}]*)"
    inner = rf"{quote}((?:[^{quote}\\]|\\.)*){quote}" if backslash else f"{quote}((?:[^{quote}]|{quote}{quote})*){quote}"
    quoted = f"{inner}[  　]*(?={sep}|$)|" if quote else "()(?!)|"
    return re.compile(f"(?:^|{sep})[  　]*(?:{quoted}{bare})", re.S)


#: (quote, backslash) in order of preference; the last reads every sign as itself.
DIALECTS = (('"', False), ("'", False), ("", True), ('"', True), ("'", True), ("", False))
_ESCAPED = re.compile(r"\\(.)", re.S)


def delimiter_sets(text: str) -> list[str]:
    """The delimiters that a field may have: all, and each alone where it holds several."""
    held = sorted(set(_KINDS_OF_SEP.findall(text)), key=SEPARATORS.index)
    return [SEPARATORS, *held] if len(held) > 1 else [SEPARATORS]


def _kept(items: Iterable[str]) -> list[str]:
    return [x for x in (y.strip(BLANKS) for y in items) if x and x.lower() not in NOTHING]


def _parse(text: str, quote: str, backslash: bool, delimiters: str = SEPARATORS) -> tuple[list[str], int]:
    """The items of a field under a dialect, and the separators it leaves bare within them."""
    out, left = [], 0
    for quoted, bare in _pattern(quote, backslash, delimiters).findall(text):
        if delimiters != SEPARATORS and bare:
            left += len(_KINDS_OF_SEP.findall(_ESCAPED.sub("", bare) if backslash else bare))
        if backslash:
            out.append(_ESCAPED.sub(r"\1", quoted or bare))
        else:
            out.append(quoted.replace(quote * 2, quote) if quoted else bare)
    return _kept(out), left


def _json_items(text: str) -> list[str] | None:
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, list) or any(isinstance(x, (list, dict)) for x in found):
        return None
    return _kept(x if isinstance(x, str) else "" if x is None else json.dumps(x) for x in found)


def candidates(text: str) -> list[tuple[list[str], int]]:
    """The parses of a field under every dialect that its signs allow, in order of preference, each with its bare separators."""
    out = []
    wrapped = text[:1] == "[" and text[-1:] == "]" and len(text) > 1
    if wrapped and (found := _json_items(text)) is not None:
        out.append((found, 0))
    for body in (text[1:-1], text) if wrapped else (text,):
        for quote, backslash in DIALECTS:
            if (not quote or quote in body) and (not backslash or "\\" in body):
                out += [_parse(body, quote, backslash, d) for d in delimiter_sets(body)]
    return out


class Code:
    """Lengths of values in bits, from the shares of the frequent values."""

    def __init__(self, counts: dict[str, int], total: int):
        self.bits = {v: -math.log2(n / total) for v, n in counts.items()} if total else {}
        self.escape = math.log2(max(2, CODE_VALUES))
        self.cheapest = lru_cache(1 << 16)(self._cheapest)

    def length(self, item: str) -> float:
        known = self.bits.get(item)
        if known is not None:
            return known + _ITEM_BITS
        return self.escape + _ITEM_BITS + _CHAR_BITS * len(item) + (_SIGN_BITS - _CHAR_BITS) * len(_SIGNS.findall(item))

    def cost(self, parse: tuple[list[str], int]) -> float:
        """The length of a field's parse in bits."""
        items, bare = parse
        return sum(map(self.length, items)) + BARE_BITS * bare

    def _cheapest(self, text: str) -> tuple[str, ...]:
        text = text.strip(BLANKS)
        if not _SPECIAL.search(text) and len(set(_KINDS_OF_SEP.findall(text))) < 2:
            return tuple(_kept(_SPLIT.split(text)))  # one dialect only: there is nothing to choose
        parses = candidates(text)
        first = parses[0]
        if all(p[0] == first[0] for p in parses):
            return tuple(first[0])
        return tuple(min(parses, key=self.cost)[0])

    def __reduce__(self):
        return (_restored, (self.bits,))


def _restored(bits: dict[str, float]) -> Code:
    code = Code({}, 0)
    code.bits = bits
    return code


def value_code(df: DataFrame, fields: Sequence[str]) -> Code:
    """The value code of the packed columns `fields`, from all rows of df."""
    plain = F.array(*[F.when(~F.col(f).rlike(_SPECIAL.pattern), F.col(f)) for f in fields])
    items = (
        df.select(F.explode(F.flatten(F.transform(F.array_compact(plain), lambda v: F.split(v, f"{_SEP}+")))).alias("v"))
        .select(clean(F.col("v")).alias("v"))
        .where(f"v <> '' and length(v) <= {MAX_CODED}")
        .groupBy("v")
        .count()
    )
    items = materialize(items, "value-code")
    total = items.agg(F.sum("count")).first()[0] or 0
    frequent = items.where(F.col("count") * CODE_VALUES >= total).collect()  # at most CODE_VALUES rows, by the shares
    return Code({r["v"]: r["count"] for r in frequent if r["v"].lower() not in NOTHING}, total)


def unpack(df: DataFrame, key: str, fields: Sequence[str], code: Code | None = None) -> DataFrame:
    """`key, field_name, pos_no, item`: one row per item of the packed columns `fields` of every row of df.

    Items come without surrounding blanks, quoting or escaping; pos_no counts the kept items of a field from 0.
    """
    code = code or value_code(df, fields)
    source = df.select(key, *fields)
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = code.cheapest
        for batch in batches:
            at: list[int] = []
            which: list[int] = []
            pos: list[int] = []
            items: list[str] = []
            for n, name in enumerate(names):
                for row, text in enumerate(batch.column(name).to_pylist()):
                    if text and (found := parse(text)):
                        k = len(found)
                        at.extend([row] * k)
                        which.extend([n] * k)
                        pos.extend(range(k))
                        items.extend(found)
            for cut in range(0, len(items), 1 << 16):
                end = cut + (1 << 16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(at[cut:end], pa.int32())), pa.array(names, pa.string()).take(pa.array(which[cut:end], pa.int32())), pa.array(pos[cut:end], pa.int32()), pa.array(items[cut:end], pa.string())],
                    names=[key, "field_name", "pos_no", "item"],
                )

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, {ITEM_SCHEMA}")


def unpack_records(df: DataFrame, key: str, fields: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """`unpack` over the records of df, each key once: the row latest by the columns `latest`."""
    return unpack(current_rows(df, key, latest, [key, *fields]), key, fields, value_code(df, fields))
