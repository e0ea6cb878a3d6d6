"""Encoding of texts with a public byte-level BPE vocabulary, by dynamic programming over prefixes.

For every prefix of a word exactly one token can end its encoding. An automaton over the vocabulary reports, at each
position, all tokens that are suffixes of the prefix; a token is the last one if it is compatible with the last token of
the prefix before it: if no merge could have crossed the seam between the two. Back-pointers then give the ids. The work
is linear in the length of a word, so words of any length are encoded whole.

A seam is crossed if some piece on the right spine of the left token and some piece on the left spine of the right token
have a merge that comes before both pieces are merged within their own tokens; among equal ranks the leftmost goes
first. This is decided from the merges alone and remembered per pair.

Empty and null texts give an empty list. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words remembered by a Python worker before its memory of words is emptied.
MEMORY = 200_000
_LAST = 1 << 62


def default_vocabulary() -> str:
    """The path of byte_bpe_50k where the public vocabularies are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    """The pattern that splits a text into words, with white space as Unicode defines it."""
    import public_tokenizers

    return public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """A byte-level BPE vocabulary with merges, ready to encode."""

    def __init__(self, vocabulary: str, pattern: str):
        import ahocorasick

        model = json.loads(vocabulary)["model"]
        signs = str.maketrans({s: chr(b) for s, b in _byte_signs().items()})
        ids = {t.translate(signs): i for t, i in model["vocab"].items()}
        self.split_words = regex.compile(pattern).findall
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for n, merge in enumerate(model["merges"]):
            left, right = (x.translate(signs) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = (ids[left], ids[right])
            self.rank[pair] = n
            parts.setdefault(ids[left + right], (*pair, n))
        self.parts = parts
        made = {t for t in ids if len(t) == 1 or ids[t] in parts}
        self.machine = ahocorasick.Automaton()
        for t in made:
            self.machine.add_word(t, (ids[t], len(t)))
        self.machine.make_automaton()
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.seams: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token, each with the rank at which it is merged into the next larger one."""
        out, until = [(token, _LAST)], _LAST
        while token in self.parts:
            *pair, until = self.parts[token]
            token = pair[side]
            out.append((token, until))
        return out

    def _uncrossed(self, ends: list[tuple[int, int]], starts: list[tuple[int, int]]) -> bool:
        rank = self.rank.get
        for x, x_until in ends:
            for y, y_until in starts:
                m = rank((x, y))
                if m is not None and m < x_until and m <= y_until:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay as they are when they stand side by side."""
        key = a << 32 | b
        found = self.seams.get(key)
        if found is None:
            if (ends := self.right.get(a)) is None:
                ends = self.right[a] = self._spine(a, 1)
            if (starts := self.left.get(b)) is None:
                starts = self.left[b] = self._spine(b, 0)
            found = self.seams[key] = self._uncrossed(ends, starts)
        return found

    def encode_word(self, word: str) -> bytes:
        """The ids of one word as 32-bit integers, by the last token of every prefix."""
        data = word.encode("utf-8", "surrogatepass").decode("latin-1")
        last = [-1] * (len(data) + 1)
        back = [0] * (len(data) + 1)
        compatible = self.compatible
        for at, (token, size) in self.machine.iter(data):
            end = at + 1
            if last[end] < 0 and ((start := end - size) == 0 or (last[start] >= 0 and compatible(last[start], token))):
                last[end], back[end] = token, start
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        words = self.split_words(text)
        known = self.known
        if len(known) >= MEMORY:
            known.clear()
            self.seams.clear()
        for word in words:
            if word not in known:
                known[word] = self.encode_word(word)
        return b"".join([known[w] for w in words])

    def count(self, text: str) -> int:
        """The number of ids of a text."""
        return len(self.encode(text)) // 4


_READY: dict[tuple[int, str], Encoder] = {}


def encoder(vocabulary: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary's text, made once in each Python process."""
    key = (hash(vocabulary), pattern)
    if key not in _READY:
        _READY[key] = Encoder(vocabulary, pattern)
    return _READY[key]


def _shipped(df: DataFrame, vocabulary: str | None, pattern: str | None):
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read()), pattern or default_pattern()


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`<key>, ids`: the token ids of the column `text` of every row. `vocabulary` is the path of a vocabulary file of
    fixed size (1.5 MB for byte_bpe_50k), which is sent to every executor once."""
    sent, split = _shipped(df, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent.value, split)
        for batch in batches:
            column, first, parts, ends = batch.column(text), 0, [], [0]
            for n in range(len(column)):
                value = column[n].as_py()
                if value:
                    parts.append(own.encode(value))
                    ends.append(ends[-1] + len(parts[-1]) // 4)
                else:
                    ends.append(ends[-1])
                if ends[-1] > 1 << 22 or n == len(column) - 1:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))]))
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, n + 1 - first), ids], names=[key, "ids"])
                    first, parts, ends = n + 1, [], [0]

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`<key>, n_tokens`: the number of token ids of the column `text` of every row."""
    sent, split = _shipped(df, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent.value, split)
        for batch in batches:
            counts = [own.count(v) if (v := x.as_py()) else 0 for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint")
