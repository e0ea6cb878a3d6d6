"""Deeply nested records as related flat tables, by shared inlining.

1. `schema_graph` reads all bodies in parallel and folds them into the graph of elements: an edge says that an element
   holds another, once or repeatedly. An object that only collects others under keys made of their own attributes
   (`{"A1/F2": {...}}`, also nested) is no element of its own: its children are repeated, and the keys are attributes.
2. `relations` decides: the root and every repeated, shared (several parents) or recursive element gets a table; every
   other descendant is inlined into the nearest table above it, its name kept as a prefix.
3. `shred` cuts each body into its tables: one row per body with an array per table. Each element carries its parent's
   number within the body, so parent and child meet without a shuffle; `flat` unfolds a table with its foreign keys.

Forms accepted as the same content: a body wrapped as a JSON string, a document inside an envelope, one object in place
of a list of one, a list of one in place of an object, numbers as text, absent or null or empty parts, any order of
names. Null members of lists are left out before counting. A body that is not complete JSON, or is null, gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAX_EDGES = 50_000


@dataclass(frozen=True)
class Shape:
    """What must be known of a kind of document beforehand: its root, and which elements may be collected under keys.

    `keyed` gives, for an element, the attributes its keys state, each with the pattern of a value. `types` gives the
    element type of a name where it differs from the name; `texts` gives the name of the text of an element that may
    be a bare value. `declared` names elements that the published schema already declares repeated or shared, so that they
    have tables even where no body of the data at hand shows it.
    """

    root: str
    marks: tuple[str, ...]
    keyed: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    types: Mapping[str, str] = field(default_factory=dict)
    texts: Mapping[str, str] = field(default_factory=dict)
    declared: tuple[str, ...] = ()


MATRIX = Shape(
    root="document",
    marks=("cells", "format"),
    keyed={"cells": {"adversary": r"A[1-3]", "fidelity": r"F[1-3]"}},
    types={"variable_loci": "locus"},
    texts={"evidence": "text"},
    declared=("cells", "evidence", "leaks", "locus", "signatures"),
)


def read(body: str | None, shape: Shape) -> dict | None:
    """The document in a body, out of any wrapping, or None."""
    try:
        found = json.loads(body) if body else None
        while isinstance(found, str):
            found = json.loads(found)
    except (ValueError, RecursionError):
        return None
    todo = [found]
    while todo:
        node = todo.pop(0)
        if isinstance(node, dict):
            if any(m in node for m in shape.marks):
                return node
            todo.extend(node.values())
        elif isinstance(node, list):
            todo.extend(node)
    return None


def members(name: str, value: object, shape: Shape) -> list[tuple[object, dict]]:
    """The elements that a value of the name stands for, each with the attributes its keys state."""
    if value is None:
        return []
    stated = shape.keyed.get(name)
    out: list[tuple[object, dict]] = []
    todo: list[tuple[object, dict]] = [(value, {})]
    while todo:
        node, attrs = todo.pop()
        if node is None:
            continue
        if isinstance(node, list):
            todo.extend((x, attrs) for x in reversed(node))
        elif stated and isinstance(node, dict) and node and (keys := _keys(node, stated)) is not None:
            todo.extend((x, attrs | k) for x, k in reversed(list(zip(node.values(), keys, strict=True))))
        else:
            out.append((node, attrs))
    return out


def _keys(node: dict, stated: Mapping[str, str]) -> list[dict] | None:
    """The attributes stated by each key of a keyed collection, or None if the object is an element itself."""
    out = []
    for key in node:
        found = {a: m.group(0) for a, p in stated.items() if (m := re.search(rf"(?<![A-Za-z0-9]){p}(?![A-Za-z0-9])", key.upper()))}
        if not found:
            return None
        out.append(found)
    return out


def fold(document: dict, shape: Shape, edges: dict[tuple[str, str, str], list[bool]]) -> None:
    """Fold the edges of a document into edges: (parent, child, name) with whether it repeats and whether it holds others."""
    todo: list[tuple[str, dict]] = [(shape.root, document)]
    types, keyed = shape.types, shape.keyed
    while todo:
        parent, node = todo.pop()
        for name, value in node.items():
            kind = types.get(name, name)
            edge = edges.get(key := (parent, kind, name))
            if edge is None:
                edge = edges[key] = [False, False]
            if type(value) is dict and (name not in keyed or not value or _keys(value, keyed[name]) is None):
                edge[1] = True
                todo.append((kind, value))
            elif type(value) is list or type(value) is dict:
                found = [x for x, _ in members(name, value, shape)]
                if len(found) > 1:
                    edge[0] = True
                for x in found:
                    if type(x) is dict:
                        edge[1] = True
                        todo.append((kind, x))


def schema_graph(df: DataFrame, body: str, shape: Shape) -> DataFrame:
    """`parent, child, name, many, holds`: the element graph of all bodies, folded over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str, str], list[bool]] = {}
        for batch in batches:
            for text in batch.column(body).to_pylist():
                if (document := read(text, shape)) is not None:
                    fold(document, shape, total)
        if total:
            rows = [(*e, *v) for e, v in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["parent", "child", "name", "many", "holds"])

    read_ = df.select(body).mapInArrow(run, "parent string, child string, name string, many boolean, holds boolean")
    return read_.groupBy("parent", "child", "name").agg(F.max("many").alias("many"), F.max("holds").alias("holds"))


@dataclass
class Plan:
    """The tables, and for each the columns inlined into it: (path, column)."""

    tables: list[str]
    columns: dict[str, list[str]]
    parents: dict[str, list[str]]


def relations(edges: Sequence[tuple[str, str, str, bool, bool]], shape: Shape) -> Plan:
    """The tables of a graph: root, repeated, shared or recursive elements; the rest is inlined."""
    parents, children = defaultdict(set), defaultdict(list)
    repeated, simple = set(), {}
    for parent, child, name, many, holds in edges:
        parents[child].add(parent)
        children[parent].append((child, name))
        simple[child] = simple.get(child, True) and not holds
        if many:
            repeated.add(child)

    def reaches_itself(start: str) -> bool:
        todo, seen = [c for c, _ in children[start]], set()
        while todo:
            at = todo.pop()
            if at == start:
                return True
            if at not in seen:
                seen.add(at)
                todo.extend(c for c, _ in children[at])
        return False

    own = {e for e in parents if e in repeated or (not simple[e] and (len(parents[e]) > 1 or reaches_itself(e)))} | {shape.root, *shape.declared}
    columns: dict[str, list[str]] = {}
    above: dict[str, set] = defaultdict(set)
    for table in sorted(own):
        cols, todo = [], [(table, "")]
        while todo:
            at, prefix = todo.pop()
            for child, name in children[at]:
                if child in own:
                    above[child].add(table)
                elif simple[child]:
                    cols.append(prefix + name)
                else:
                    todo.append((child, f"{prefix}{name}."))
        if table in shape.texts and simple.get(table, False):
            cols.append(shape.texts[table])
        columns[table] = sorted({*cols, *shape.keyed.get(table, {}), *([shape.texts[table]] if table in shape.texts else [])})
    return Plan(sorted(own), columns, {t: sorted(p) for t, p in above.items()})


def plan_of(df: DataFrame, body: str, shape: Shape) -> Plan:
    """The tables for all bodies of df. The graph has one row per pair of element names, and at most MAX_EDGES of them come to
    the driver: bodies whose names are data give more, and need an entry in `keyed`; this is an error, as none may be left out."""
    rows = schema_graph(df, body, shape).orderBy("parent", "child", "name").limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} pairs of element names: names that are data must be declared as keys")
    return relations([(r["parent"], r["child"], r["name"], r["many"], r["holds"]) for r in rows], shape)


def _value(node: object) -> str | None:
    return None if node is None or node == {} else node if isinstance(node, str) else json.dumps(node, ensure_ascii=False)


def needed(plan: Plan, wanted: Mapping[str, Sequence[str]]) -> set[str]:
    """The wanted tables and all tables above them."""
    out, todo = set(), list(wanted)
    while todo:
        at = todo.pop()
        if at not in out:
            out.add(at)
            todo.extend(plan.parents.get(at, ()))
    return out


def cut(document: dict, shape: Shape, plan: Plan, wanted: Mapping[str, Sequence[str]], reached: set[str] | None = None) -> dict[str, list[dict]]:
    """The tables of one document; each element has `_parent` (table), `_parent_no`, `_no` (in its parent, by name), `_name`."""
    reached = needed(plan, wanted) if reached is None else reached
    out: dict[str, list[dict]] = {t: [] for t in reached}
    own, types = set(plan.tables), shape.types
    keeps = {t: frozenset(wanted.get(t, ())) for t in reached}
    todo: list[tuple[str, object, dict, str | None, int, int, str]] = [(shape.root, document, {}, None, -1, 0, shape.root)]
    while todo:
        table, node, stated, parent, parent_no, no, name = todo.pop()
        rows = out[table]
        here = len(rows)
        row = stated | {"_parent": parent, "_parent_no": parent_no, "_no": no, "_name": name}
        rows.append(row)
        keep = keeps[table]
        if type(node) is not dict:
            row[shape.texts.get(table, "value")] = _value(node)
            continue
        later = []
        inner: list[tuple[str, dict]] = [("", node)]
        while inner:
            prefix, at = inner.pop()
            for key, value in at.items():
                if value is None:
                    continue
                kind = types.get(key, key)
                if kind in own:
                    if kind in reached:
                        later.extend((kind, x, attrs, table, here, k, key) for k, (x, attrs) in enumerate(members(key, value, shape)))
                    continue
                if type(value) is list and len(value) == 1:
                    value = value[0]
                if type(value) is dict:
                    inner.append((f"{prefix}{key}.", value))
                elif keep and value is not None and (path := prefix + key) in keep:
                    row[path] = _value(value)
        later.reverse()
        todo.extend(later)
    return out


def column_name(path: str) -> str:
    """The column of an inlined path."""
    return path.replace(".", "_")


def shred(df: DataFrame, keys: Sequence[str], body: str, shape: Shape, plan: Plan, wanted: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The columns `keys`, and per table of `wanted` (all, by default) an array of its elements, in order.

    An element has `parent`, `parent_no` (its place in the parent's array), `name`, `no` and the inlined columns, as text.
    """
    wanted = dict(wanted) if wanted is not None else dict(plan.columns)
    fields = [("parent", "_parent", pa.string()), ("parent_no", "_parent_no", pa.int32()), ("name", "_name", pa.string()), ("no", "_no", pa.int32())]
    reached = needed(plan, wanted)
    kinds = {t: pa.list_(pa.struct([*[(n, k) for n, _, k in fields], *[(column_name(c), pa.string()) for c in cols]])) for t, cols in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {t: [] for t in wanted}
            at = []
            for k, text in enumerate(batch.column(body).to_pylist()):
                document = read(text, shape)
                if document is None:
                    continue
                at.append(k)
                tables = cut(document, shape, plan, wanted, reached)
                for t, cols in wanted.items():
                    found[t].append([{**{n: r.get(f) for n, f, _ in fields}, **{column_name(c): r.get(c) for c in cols}} for r in tables.get(t, ())])
            if at:
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(at, pa.int32())) for k in keys], *[pa.array(found[t], kinds[t]) for t in wanted]], names=[*keys, *wanted])

    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    struct = lambda cols: "parent: string, parent_no: int, name: string, no: int" + "".join(f", `{column_name(c)}`: string" for c in cols)
    arrays = "".join(f", `{t}` array<struct<{struct(cols)}>>" for t, cols in wanted.items())
    return df.select(*keys, body).mapInArrow(run, key_schema + arrays)


def flat(shredded: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """One table: the document's keys, `<table>_no`, `parent`, `parent_no`, `name`, `no` and the inlined columns."""
    return shredded.select(*keys, F.posexplode(table).alias(f"{table}_no", "_e")).select(*keys, f"{table}_no", "_e.*")
