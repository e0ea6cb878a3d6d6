"""Folders of files as tables, and files as tables of parts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.sources.containers import Malformed, parts, recognise
from plainsift.shared import ship

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


LISTING = "path string, relative string, link boolean, length bigint"


def _entries(root: str, place: str, deep: bool) -> tuple[list[tuple], list[str]]:
    """The files below a folder, in the order of names, and the folders not entered: with deep, none is left out."""
    rows, later, todo = [], [], [place]
    while todo:
        at = todo.pop()
        for entry in sorted(os.scandir(at), key=lambda e: e.name):
            if entry.is_dir(follow_symlinks=False):
                (todo if deep else later).append(entry.path)
            else:
                rows.append((entry.path, os.path.relpath(entry.path, root).replace(os.sep, "/"), entry.is_symlink(), entry.stat(follow_symlinks=False).st_size))
    return rows, later


def listing(spark: SparkSession, root: str) -> DataFrame:
    """`path, relative, link, length` of every file below a mounted folder, links listed but never followed. The driver lists two
    levels of folders; what lies below is listed by the tasks, a folder at a time, and never gathered."""
    ship(spark)
    rows, folders = _entries(root, root, False)
    below: list[str] = []
    for place in folders:
        found, inner = _entries(root, place, False)
        rows += found
        below += inner
    near = spark.createDataFrame(rows, LISTING)
    if not below:
        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        for batch in batches:
            for place in batch.column("place").to_pylist():
                if found := _entries(root, place, True)[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["path", "relative", "link", "length"])

    far = spark.createDataFrame([(p,) for p in below], "place string").repartition(min(len(below), 1000)).mapInArrow(run, LISTING)
    return near.unionByName(far)


def folder(spark: SparkSession, root: str, per_task: int = 64) -> DataFrame:
    """`path, relative, length, content` of every file below root; a link has no content.

    A mounted folder is listed by `listing` and read by the tasks, some `per_task` files each: unlike the built-in reader this
    also sees empty files and names that begin with `_` or `.`. Other file systems are read by the built-in reader.
    """
    ship(spark)
    if "://" in root and not root.startswith("file://"):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        base = root.split("://", 1)[-1].strip("/")
        return found.select("path", F.substring_index("path", base + "/", -1).alias("relative"), "length", "content")
    files = listing(spark, root.removeprefix("file://"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, relative, link, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = None
                if not link:
                    with open(path, "rb") as file:
                        content = file.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([relative]), pa.array([length], pa.int64()), pa.array([content], pa.binary())], names=["path", "relative", "length", "content"])

    tasks = max(1, -(-files.count() // per_task))
    return files.repartition(tasks).mapInArrow(run, "path string, relative string, length bigint, content binary")


def records(files: DataFrame, key: str, content: str) -> DataFrame:
    """`<key>, format, seq, kind, offset, length, payload, error`: one row per part of each file, in order.

    A file of no known kind, or one that isn't accounted for, gives a single row with the reason in `error`; a null
    content too. seq counts from 0.
    """
    kinds = [("format", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]

    def rows(data: bytes | None) -> list[tuple]:
        if data is None:
            return [(None, 0, None, None, None, None, "no content")]
        kind = recognise(data)
        if kind is None:
            return [(None, 0, None, None, None, None, "no handler reads it")]
        try:
            return [(kind, n, p.kind, p.at, p.size, p.payload(data), None) for n, p in enumerate(parts(kind, data))]
        except Malformed as e:
            return [(kind, 0, None, None, None, None, str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in enumerate(batch.column(content)):
                found = rows(data.as_py())
                same = pa.array([n] * len(found), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(same), *[pa.array([r[i] for r in found], t) for i, (_, t) in enumerate(kinds)]], names=[key, *[n for n, _ in kinds]])

    return files.select(key, content).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, format string, seq int, kind string, offset bigint, length bigint, payload binary, error string")


def rebuilt(found: DataFrame, key: str, keep) -> DataFrame:  # noqa: ANN001
    """`<key>, content`: the payloads of the parts that `keep` (a column) holds for, in order, as one binary."""
    kept = found.where(keep).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("all"))
    # joined as text of one sign per byte: adding binaries one after the other would copy the first ones again and again
    joined = F.array_join(F.transform("all", lambda x: F.decode(x["payload"], "ISO-8859-1")), "")
    return kept.select(key, F.encode(joined, "ISO-8859-1").alias("content"))


def discovered(paths: DataFrame, path: str, pattern: str, former: dict[str, str] | None = None) -> DataFrame:
    """`name, path`: of listed files whose base name matches a pattern, the name its first group gives; of several files of one
    name the last path counts. `former` names base names from before the rule."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    name = F.nullif(F.regexp_extract(base, pattern, 1), F.lit(""))
    for old, means in (former or {}).items():
        name = F.when(base == old, means).otherwise(name)
    return paths.select(name.alias("name"), F.col(path).alias("path")).where("name is not null").groupBy("name").agg(F.max("path").alias("path"))
