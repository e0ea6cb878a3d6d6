"""Damaged copies of files, for trials of cleaners, and what the trials come to."""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsift.sources.containers import Malformed, parts

KINDS = ("flipped bits", "zeros", "cut out", "grown")


def _damaged(data: bytes, kind: str, rng: random.Random) -> bytes:
    at = rng.randrange(len(data))
    if kind == "flipped bits":
        out = bytearray(data)
        for _ in range(rng.randint(1, 8)):
            out[rng.randrange(len(out))] ^= 1 << rng.randrange(8)
        return bytes(out)
    if kind == "zeros":
        n = min(rng.randint(1, 64), len(data) - at)
        return data[:at] + bytes(n) + data[at + n :]
    if kind == "cut out":
        return data[:at] + data[at + rng.randint(1, 128) :]
    return data[:at] + rng.randbytes(rng.randint(1, 32)) + data[at:]


def damaged(data: bytes, key: object, n: int, seed: int = 7) -> Iterator[tuple[str, bytes]]:
    """Two shortened copies of a file and n damaged ones, the same for the same key and seed; none of an empty file."""
    if not data:
        return
    yield "half", data[: len(data) // 2]
    yield "head", data[:16]
    rng = random.Random(xxhash.xxh64_intdigest(f"{seed}/{key}"))
    for _ in range(n):
        kind = rng.choice(KINDS)
        yield kind, _damaged(data, kind, rng)


def damaged_within(data: bytes, key: object, n: int, seed: int = 7) -> Iterator[tuple[str, bytes]]:
    """Damaged copies of a PNG whose chunks' checksums hold again, so that what reads the chunks meets the damage."""
    try:
        chunks = [p for p in parts("png", data) if p.kind != "signature" and p.size > 12]
    except Malformed:
        return
    rng = random.Random(xxhash.xxh64_intdigest(f"{seed}/within/{key}"))
    for _ in range(n if chunks else 0):
        p, kind = rng.choice(chunks), rng.choice(KINDS)
        body = _damaged(p.payload(data), kind, rng)
        name = data[p.at + 4 : p.at + 8]
        yield f"{kind} in {p.kind}", data[: p.at] + struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body)) + data[p.end :]


def mutations(files: DataFrame, key: str, content: str, n: int, seed: int = 7, within: bool = False) -> DataFrame:
    """`<key>, no, kind, content`: the damaged copies of every file, made where the file is. Null and empty files have none."""
    make = damaged_within if within else damaged
    kind_of_key = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                k, data = batch.column(key)[at].as_py(), batch.column(content)[at].as_py()
                if found := list(make(data, k, n, seed)) if data else []:
                    same = batch.column(key).take(pa.array([at] * len(found), pa.int32()))
                    yield pa.RecordBatch.from_arrays([same, pa.array(range(len(found)), pa.int32()), pa.array([x for x, _ in found]), pa.array([d for _, d in found], pa.binary())], names=[key, "no", "kind", "content"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind_of_key}, no int, kind string, content binary")


def campaign(outcomes: DataFrame, by: str) -> DataFrame:
    """`<by>, n, cleaned, refused, errors, slowest, reasons`: what the trials of a shape come to. Rows need `outcome`, `notes` and
    `seconds`; the parts of a campaign can be added up, as all columns are sums, a maximum and a set of refusal rules."""
    rule = F.when(F.col("outcome") == "refused", F.regexp_replace("notes", "[0-9]+", "#"))
    counts = {"cleaned": "cleaned", "refused": "refused", "errors": "error"}
    return outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("outcome") == o).alias(c) for c, o in counts.items()], F.max("seconds").alias("slowest"), F.count_distinct(rule).alias("rules"))
