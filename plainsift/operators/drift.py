"""Schemas that drift between files: one union schema, one table, and the ordered log of changes.

`headers` reads the schema of every file in parallel: each leaf of its records, under its common name, with the path the file
uses and the kind of its values folded over the records by the lattice `join_kinds`. `learned_names` finds renames that no
list of names foretells, from fields that go and come together with values alike (by `sketches`); `renamed` applies them. `changes` compares each file with the one before it in its series. `union_schema` folds the headers of all files
through the same lattice, and `unified` casts every record to the columns and kinds of the union schema.

A body that is null, not complete JSON or has no records gives a file without fields. Null values are no presence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plainsift.shared import materialize

KINDS = ("null", "boolean", "integer", "number", "string", "array")
JSON_KINDS = {"integer": "number"}
SKETCH = 24
LEARN_STEPS = 2
LEARN_SHARE = 0.5
LEARN_LIKENESS = 0.5
MAX_COLUMNS = 1000

# The common name of a field, and the names (without case and separators) and places it has had.
NOISE_PLACES = ("", "noisefloor", "floor", "noise", "baseline", "baseline.noise", "baseline.noisefloor")
ALIASES = {
    "reason": ("reason", "reasontext", "why", "explanation", "verdictreason", "detail.reason", "details.reason"),
    "evidence_dir": ("evidencedir", "evidencedirectory", "evidencepath", "artifacts", "artifactsdir", "evidence.dir", "evidence.path", "evidence.directory"),
    "noise_floor.deterministic": tuple(f"{p}.{n}".lstrip(".") for p in NOISE_PLACES for n in ("deterministic", "isdeterministic", "sameeveryrun", "stable")),
    "noise_floor.repeats": tuple(f"{p}.{n}".lstrip(".") for p in NOISE_PLACES for n in ("repeats", "runs", "nrepeats", "numrepeats", "repeatcount")),
}
COMMON = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
_NOT_PLAIN = re.compile(r"[^a-z0-9.]")
FIELD = "struct<name:string,path:string,kind:string>"
_WORDS = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")


def join_kinds(a: str, b: str) -> str:
    """The least kind that holds both: null below all, integer below number, boolean and number below string, array above all.

    A boolean and a number only meet in string; an array is an array of strings.
    """
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if "array" in (a, b):
        return "array"
    return "number" if {a, b} == {"integer", "number"} else "string"


def kind_of(value: object) -> str:
    """The kind of a leaf; a whole number beyond 64 bits is a number."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer" if -(1 << 63) <= value < 1 << 63 else "number"
    return "number" if isinstance(value, float) else "array" if isinstance(value, list) else "string"


def leaves(record: Mapping, place: str = "") -> Iterator[tuple[str, object]]:
    """Path and value of every leaf of a record; only objects are entered."""
    todo = [(place, record)]
    while todo:
        at, node = todo.pop()
        for name, value in node.items():
            if isinstance(value, dict):
                todo.append((f"{at}{name}.", value))
            else:
                yield f"{at}{name}", value


def common_name(path: str) -> str:
    """The common name of a field whatever the file calls it, or its own path."""
    return COMMON.get(_NOT_PLAIN.sub("", path.lower()), path)


def records(body: str | None, within: str = "cells") -> list[dict]:
    """The records of a file: the objects of its list `within`."""
    try:
        found = json.loads(body) if body else None
        while isinstance(found, str):
            found = json.loads(found)
    except (ValueError, RecursionError):
        return []
    found = found.get(within) if isinstance(found, dict) else found
    found = list(found.values()) if isinstance(found, dict) and found and all(isinstance(x, dict) for x in found.values()) else found
    return [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]


def signs(value: object) -> Iterator[str]:
    """What is compared of a value: the words of a text without regard to digits, the magnitude of a number, a boolean."""
    if isinstance(value, list):
        for x in value:
            yield from signs(x)
    elif isinstance(value, str):
        yield from (w.lower() if w.isalpha() else "#" if w.isdigit() else w for w in _WORDS.findall(value))
    elif isinstance(value, bool):
        yield str(value)
    elif value is not None:
        yield f"~{len(str(int(abs(value)))) if value == value and abs(value) != float('inf') else value}"


def header(body: str | None) -> list[dict]:
    """The schema of a file: name, path and kind of each field present, ordered by name."""
    found: dict[str, tuple[set, str]] = {}
    for record in records(body):
        for path, value in leaves(record):
            if value is not None:
                paths, kind = found.get(name := common_name(path), (set(), "null"))
                found[name] = (paths | {path}, join_kinds(kind, kind_of(value)))
    return [{"name": n, "path": " ".join(sorted(p)), "kind": k} for n, (p, k) in sorted(found.items())]


def sketches(df: DataFrame, body: str) -> DataFrame:
    """`name, sketch`: of each field, the least SKETCH hashes of the signs of its values over all bodies. Each partition gives
    its own least ones, and sketches of any files can be joined in the same way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, set[int]] = {}
        for batch in batches:
            for text in batch.column(body).to_pylist():
                for record in records(text):
                    for path, value in leaves(record):
                        if value is not None:
                            held = least.setdefault(common_name(path), set())
                            held.update(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in signs(value))
                            if len(held) > 50 * SKETCH:
                                least[common_name(path)] = set(sorted(held)[:SKETCH])
        rows = [(name, h) for name, held in least.items() for h in sorted(held)[:SKETCH]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["name", "h"])

    each = df.select(body).mapInArrow(run, "name string, h bigint").distinct()
    order = each.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("h"))).where(F.col("_n") <= SKETCH)
    return order.groupBy("name").agg(F.collect_list("h").alias("sketch"))


def headers(df: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """The columns `keys` and `fields`, the schema of the file in column `body`."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("name", "path", "kind")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([header(x) for x in batch.column(body).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], found], names=[*keys, "fields"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, body).mapInArrow(run, f"{schema}, fields array<{FIELD}>")


def _with_previous(files: DataFrame, file: str, series: str, order: str) -> DataFrame:
    """`file, fields, before, first`: each file with the fields of the one before it in its series.

    A series may hold a third of all files, so no task takes a series whole: files are range-partitioned by series and
    order; within a block the one before is the row before; the first of a block takes the last of the block before,
    over one row per series and block.
    """
    cut = materialize(files.repartitionByRange(series, order, file).withColumn("_block", F.spark_partition_id()), "drift-blocks")
    inside = Window.partitionBy(series, "_block").orderBy(order, file)
    near = cut.withColumn("before", F.lag("fields").over(inside)).withColumn("_n", F.row_number().over(inside)).where("_n > 1")
    at = F.struct(F.col(order), F.col(file))
    row = F.struct(F.col(file), F.col("fields"))
    ends = cut.groupBy(series, "_block").agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))
    over = ends.withColumn("before", F.lag("last.fields").over(Window.partitionBy(series).orderBy("_block"))).where("before is not null")
    return near.select(file, "fields", "before").unionByName(over.select(f"first.{file}", "first.fields", "before"))


def learned_names(files: DataFrame, file: str, series: str, order: str, bodies: DataFrame, body: str) -> DataFrame:
    """`name, known`: names that stand for a field with a common name, though no list says so. files is a result of `headers`;
    the values in bodies are only read if names go and come in a way that asks for it.

    A name is taken for a known field if, over all steps between files, the two go and come in opposite directions at
    LEARN_STEPS steps or more and at LEARN_SHARE or more of the steps at which the name comes or goes, if no file has both, and if
    their values are alike: LEARN_LIKENESS or more of the smaller sketch is in the other, over all files. A name takes the
    field it meets most often; a name on the list keeps its meaning.
    """
    known = sorted(set(ALIASES))
    is_known = lambda x: F.array_contains(F.array(*[F.lit(k) for k in known]), x)
    names = lambda c: F.transform(c, lambda x: x["name"])
    steps = _with_previous(files, file, series, order).select(F.array_except(names("fields"), names("before")).alias("came"), F.array_except(names("before"), names("fields")).alias("went"))
    moves = steps.select(F.explode(F.array(F.struct(F.col("came").alias("a"), F.col("went").alias("b")), F.struct(F.col("went").alias("a"), F.col("came").alias("b")))).alias("m"))
    news = moves.select(F.explode(F.filter("m.a", lambda x: ~is_known(x))).alias("name"), F.filter("m.b", is_known).alias("others"))
    total = news.groupBy("name").agg(F.count(F.lit(1)).alias("_moves"))
    met = news.select("name", F.explode("others").alias("known")).groupBy("name", "known").agg(F.count(F.lit(1)).alias("_met"))
    likely = materialize(met.join(total, "name").where((F.col("_met") >= LEARN_STEPS) & (F.col("_met") >= LEARN_SHARE * F.col("_moves"))).select("name", "known", "_met"), "likely-names")
    if likely.isEmpty():
        return likely.select("name", "known")
    values = materialize(sketches(bodies, body), "value-sketches")
    pairs = likely.join(values.withColumnRenamed("sketch", "s"), "name").join(values.select(F.col("name").alias("known"), F.col("sketch").alias("t")), "known")
    alike = pairs.where(F.size(F.array_intersect("s", "t")) >= LEARN_LIKENESS * F.least(F.size("s"), F.size("t"))).select("name", "known", "_met")
    present = files.select(F.filter(names("fields"), lambda x: ~is_known(x)).alias("n"), F.filter(names("fields"), is_known).alias("k"))
    both = present.select(F.explode("n").alias("name"), "k").select("name", F.explode("k").alias("known")).distinct()
    best = Window.partitionBy("name").orderBy(F.col("_met").desc(), "known")
    return alike.join(both, ["name", "known"], "left_anti").withColumn("_n", F.row_number().over(best)).where("_n = 1").select("name", "known")


def renamed(files: DataFrame, learned: DataFrame, file: str) -> DataFrame:
    """files with the fields under the names that `learned_names` has found; unchanged where it has found none."""
    if learned.isEmpty():
        return files
    others = [c for c in files.columns if c != "fields"]
    fields = files.select(file, F.explode("fields").alias("_f")).select(file, F.col("_f.name").alias("name"), "_f").join(learned, "name", "left")
    field = F.struct(F.coalesce("known", "name").alias("name"), "_f.path", "_f.kind")
    again = fields.groupBy(file).agg(F.array_sort(F.collect_list(field)).alias("fields"))
    return files.select(*others).join(again, file, "left").withColumn("fields", F.coalesce("fields", F.array().cast(f"array<{FIELD}>")))


def changes(files: DataFrame, file: str, series: str, order: str) -> DataFrame:
    """`file, field_name, change_kind` of a result of `headers`: added, removed, renamed or retyped since the file before."""
    pairs = _with_previous(files, file, series, order)
    names = lambda c: F.transform(c, lambda x: x["name"])
    one = lambda n, k: F.struct(n.alias("field_name"), F.lit(k).alias("change_kind"))
    fresh = F.transform(F.array_except(names("fields"), names("before")), lambda n: one(n, "added"))
    gone = F.transform(F.array_except(names("before"), names("fields")), lambda n: one(n, "removed"))
    json_kind = lambda k: reduce(lambda c, x: F.when(k == x[0], x[1]).otherwise(c), JSON_KINDS.items(), k)

    def both(part, kind: str):
        said = lambda c: F.transform(c, lambda x: F.struct(x["name"].alias("name"), part(x).alias("part")))
        kept = F.filter(F.array_except(said("fields"), said("before")), lambda x: F.array_contains(names("before"), x["name"]))
        return F.transform(kept, lambda x: one(x["name"], kind))

    every = F.concat(fresh, gone, both(lambda x: x["path"], "renamed"), both(lambda x: json_kind(x["kind"]), "retyped"))
    return pairs.select(file, F.explode(every).alias("c")).select(file, "c.field_name", "c.change_kind")


def union_schema(files: DataFrame) -> DataFrame:
    """`field_name, kind, kinds, paths, n_files`: each field of any file with the kind that holds all its kinds, by the lattice."""
    seen = files.select(F.explode("fields").alias("f")).groupBy("f.name").agg(F.array_sort(F.collect_set("f.kind")).alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("f.path", " "))))).alias("paths"), F.count(F.lit(1)).alias("n_files"))
    table = F.create_map(*[F.lit(x) for a in KINDS for b in KINDS for x in (f"{a} {b}", join_kinds(a, b))])
    kind = F.aggregate("kinds", F.lit("null"), lambda a, b: F.element_at(table, F.concat_ws(" ", a, b)))
    return seen.select(F.col("name").alias("field_name"), kind.alias("kind"), "kinds", "paths", "n_files")


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _number(value: float) -> float:
    try:
        return float(value)
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


#: How a value comes under each kind of the lattice; a value always fits, as the kind holds all kinds of its field.
CASTS = {
    "null": (pa.string(), "string", _text),
    "boolean": (pa.bool_(), "boolean", bool),
    "integer": (pa.int64(), "bigint", int),
    "number": (pa.float64(), "double", _number),
    "string": (pa.string(), "string", _text),
    "array": (pa.list_(pa.string()), "array<string>", lambda v: [_text(x) for x in v] if isinstance(v, list) else [_text(v)]),
}


def columns_of(schema: DataFrame, taken: Sequence[str] = ()) -> list[tuple[str, str, str]]:
    """(field, column, kind) for the table of a union schema: the MAX_COLUMNS fields of most files, in the order of names.
    Columns whose names would clash, letter case aside, get a number."""
    rows = schema.orderBy(F.col("n_files").desc(), "field_name").limit(MAX_COLUMNS).select("field_name", "kind").collect()
    used, out = {t.lower() for t in taken}, []
    for r in sorted(rows, key=lambda r: r["field_name"]):
        name = column = re.sub(r"[^A-Za-z0-9_]+", "_", r["field_name"]).strip("_") or "field"
        n = 1
        while column.lower() in used:
            n += 1
            column = f"{name}_{n}"
        used.add(column.lower())
        out.append((r["field_name"], column, r["kind"]))
    return out


def unified(df: DataFrame, keys: Sequence[str], body: str, schema: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """All records of all files in one table: the columns `keys`, `cell_no`, a column for each field of the union schema, of
    the kind that holds all its kinds, and `others`, a map from path to text of the fields beyond MAX_COLUMNS and of fields that
    the schema lacks. A field that a record holds twice keeps the value that comes last in it."""
    columns = columns_of(schema, [*keys, "cell_no", "others"])
    place = {field: (column, CASTS[kind][2]) for field, column, kind in columns}
    aliases = {} if learned is None else {r["name"]: r["known"] for r in learned.where(F.col("known").isin(list(place))).limit(MAX_COLUMNS).collect()}
    own = [("cell_no", pa.int32()), *[(column, CASTS[kind][0]) for _, column, kind in columns], ("others", pa.map_(pa.string(), pa.string()))]

    def row(no: int, record: dict) -> dict:
        out: dict = {"cell_no": no}
        others = {}
        for path, value in leaves(record):
            if value is None:
                continue
            name = common_name(path)
            column, cast = place.get(aliases.get(name, name), (None, None))
            if column is None:
                others[path] = _text(value)
            else:
                out[column] = cast(value)
        return out | {"others": list(others.items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column(body).to_pylist()):
                if found := [row(no, record) for no, record in enumerate(records(text))]:
                    same = pa.array([at] * len(found), pa.int32())
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(same) for k in keys], *[pa.array([r.get(n) for r in found], t) for n, t in own]], names=[*keys, *[n for n, _ in own]])

    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    typed = "".join(f", `{column}` {CASTS[kind][1]}" for _, column, kind in columns)
    return df.select(*keys, body).mapInArrow(run, f"{head}, cell_no int{typed}, others map<string,string>")
