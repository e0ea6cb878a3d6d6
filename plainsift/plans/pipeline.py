"""Queries of the general training-data operators: problems 2, 3, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.operators import copydiff, drift, shred
from plainsift.operators.packed import unpack_records
from plainsift.shared import current_rows, materialize, table

PACKED_FIELDS = ("removed_fields", "changed_fields", "kept_fields")
CELL_FIELDS = {"adversary": copydiff.loose, "fidelity": copydiff.loose, "verdict": copydiff.loose, "reason": copydiff.squeezed, "repeats": copydiff.same, "deterministic": copydiff.same}
FILE_KEYS = ["file_id", "series_id", "generated_at"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell missing in one copy, and every field that differs."""
    copies = (table(spark, sf_dir, f"cells_{c}") for c in ("published", "measured"))
    return copydiff.differences(*copies, "cell_id", ["loaded_at"], CELL_FIELDS, ("only_published", "only_measured"))


def p2_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unequal buckets of the two copies, with the columns unequal in each."""
    copies = [table(spark, sf_dir, f"cells_{c}") for c in ("published", "measured")]
    bits = copydiff.bucket_bits(max(c.count() for c in copies))
    copies = (copydiff.checksums(c, "cell_id", ["loaded_at"], CELL_FIELDS, bits) for c in copies)
    return copydiff.unequal_buckets(*copies, list(CELL_FIELDS))


def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of cells of each kind of difference."""
    return p2_found(spark, sf_dir).groupBy("difference").agg(F.count(F.lit(1)).alias("n_cells"))


def _file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "matrix_files")
    read = drift.headers(files, [*FILE_KEYS, "received_at"], "body")
    return current_rows(read, "file_id", ["received_at"], [*FILE_KEYS, "fields"])


def _drifting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The headers of all files under their common names, listed and learned, and the learned names."""
    files = materialize(_file_headers(spark, sf_dir), "drift-headers")
    learned = materialize(drift.learned_names(files, "file_id", "series_id", "generated_at", table(spark, sf_dir, "matrix_files"), "body"), "drift-learned")
    return drift.renamed(files, learned, "file_id"), learned


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of cell fields between each file and the one before it in its series."""
    return drift.changes(_drifting(spark, sf_dir)[0], "file_id", "series_id", "generated_at")


def p3_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union schema of all files."""
    found = drift.union_schema(_drifting(spark, sf_dir)[0])
    return found.withColumns({c: F.array_join(c, " ") for c in ("kinds", "paths")})


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of all files in one table, each file once, with the columns and types of the union schema; lists as JSON."""
    files = current_rows(table(spark, sf_dir, "matrix_files"), "file_id", ["received_at"], [*FILE_KEYS, "body"])
    headers, learned = _drifting(spark, sf_dir)
    cells = drift.unified(files, FILE_KEYS, "body", drift.union_schema(headers), learned)
    return cells.withColumns({c: F.to_json(c) for c, kind in cells.dtypes if kind.startswith(("array", "map"))})


def _shredded(spark: SparkSession, sf_dir: str, wanted: dict | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "matrix_docs")
    plan = shred.plan_of(docs, "body", shred.MATRIX)
    return shred.shred(docs, ["matrix_id", "received_at"], "body", shred.MATRIX, plan, wanted)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leak of each document, with its cell's keys and floor and its place."""
    wanted = {"cells": ["adversary", "fidelity", "noise_floor.repeats"], "leaks": [], "locus": ["feature_id", "offset"]}
    docs = _shredded(spark, sf_dir, wanted)
    places = F.map_from_entries(
        F.transform(F.filter("locus", lambda x: (x["parent"] == "leaks") & (x["no"] == 0)), lambda x: F.struct(x["parent_no"], F.struct(x["feature_id"].alias("feature_id"), x["offset"].alias("offset"))))
    )
    numbered = docs.select("matrix_id", "received_at", "cells", F.transform("leaks", lambda x, k: F.struct(x["parent_no"].alias("cell"), x["no"].alias("no"), k.alias("k"))).alias("leaks"), places.alias("places"))
    rows = F.transform(
        "leaks",
        lambda x: F.struct(
            F.element_at("cells", x["cell"] + 1)["adversary"].alias("adversary"),
            F.element_at("cells", x["cell"] + 1)["fidelity"].alias("fidelity"),
            x["no"].alias("leak_no"),
            F.coalesce(F.try_element_at("places", x["k"])["feature_id"], F.lit("")).alias("feature_id"),
            F.coalesce(F.try_element_at("places", x["k"])["offset"].try_cast("bigint"), F.lit(-1)).alias("locus_offset"),
            F.coalesce(F.element_at("cells", x["cell"] + 1)["noise_floor_repeats"].try_cast("int"), F.lit(-1)).alias("repeats"),
        ),
    )
    once = current_rows(numbered.select("matrix_id", "received_at", rows.alias("leaks")), "matrix_id", ["received_at"], ["matrix_id", "leaks"])
    return once.select("matrix_id", F.explode("leaks").alias("x")).select("matrix_id", "x.*")


def _p5_table(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "matrix_docs")
        plan = shred.plan_of(docs, "body", shred.MATRIX)
        if name not in plan.tables:
            return spark.createDataFrame([], "matrix_id bigint")
        read = shred.shred(docs, ["matrix_id", "received_at"], "body", shred.MATRIX, plan, {name: plan.columns[name]})
        return shred.flat(current_rows(read, "matrix_id", ["received_at"], ["matrix_id", name]), ["matrix_id"], name)

    query.__doc__ = f"The flat table `{name}` of all documents, each element with its parent's key."
    return query


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item of the three packed fields of each record."""
    return unpack_records(table(spark, sf_dir, "scrub_results"), "row_id", PACKED_FIELDS, ["loaded_at"])


QUERIES = {
    "p2_found": p2_found,
    "p2_buckets": p2_buckets,
    "p2_summary": p2_summary,
    "p3_found": p3_found,
    "p3_schema": p3_schema,
    "p3_cells": p3_cells,
    "p5_found": p5_found,
    **{f"p5_{name}": _p5_table(name) for name in ("document", "cells", "leaks", "locus", "evidence")},
    "p6_found": p6_found,
}

_SEPS = r";,|\t\n\r；"
_MARK = rf"""[{_SEPS}][ ]*(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*''|(?:[^{_SEPS}\\]|\\.)*)"""
_UNQUOTED = """case when length(x) > 1 and x[1] = '"' and x[-1] = '"' then replace(x[2:-2], '""', '"') when length(x) > 1 and x[1] = '''' and x[-1] = '''' then replace(x[2:-2], '''''', '''') else regexp_replace(x, '\\\\(.)', '\\1', 'g') end"""
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
#: The items of the packed fields, in one pass of a pattern that reads every style at once; for DuckDB.
ITEMS_SQL = f"""latest as (select * from scrub_results qualify row_number() over (partition by row_id order by loaded_at desc nulls last) = 1),
packed as (select row_id, field_name, trim(value, {_BLANK}) t from (select row_id, unnest(['removed_fields', 'changed_fields', 'kept_fields']) field_name, unnest([removed_fields, changed_fields, kept_fields]) as value from latest) where value is not null),
raw as (select row_id, field_name, case when t like '[%]' and json_valid(t) then cast(cast(t as json) as varchar[])
  else list_transform(list_transform(regexp_extract_all(';' || case when t like '[%]' then t[2:-2] else t end, '{_MARK}'), lambda m: trim(m[2:], {_BLANK})), lambda x: {_UNQUOTED}) end all_items from packed),
kept as (select row_id, field_name, list_filter(list_transform(all_items, lambda x: trim(x, {_BLANK})), lambda x: x <> '' and lower(x) not in ('-', '–', '—', 'none', '(none)', 'n/a', 'null', '[]')) items from raw),
items as (select row_id, field_name, cast(i - 1 as int) pos_no, items[i] item from kept, unnest(range(1, len(items) + 1)) u(i))
"""
_STATE = """{name} as (select cell_id, upper(regexp_replace(adversary, '[\\s_-]+', '', 'g')) adversary, upper(regexp_replace(fidelity, '[\\s_-]+', '', 'g')) fidelity,
  upper(regexp_replace(verdict, '[\\s_-]+', '', 'g')) verdict, coalesce(trim(regexp_replace(reason, '\\s+', ' ', 'g')), '') reason, repeats, deterministic
  from cells_{name} qualify row_number() over (partition by cell_id order by loaded_at desc nulls last) = 1)"""
_P2 = f"""with {_STATE.format(name='published')}, {_STATE.format(name='measured')},
both_sides as (select coalesce(p.cell_id, m.cell_id) cell_id, p.cell_id is null no_p, m.cell_id is null no_m, {', '.join(f'p.{f} is distinct from m.{f} d_{f}' for f in CELL_FIELDS)}
  from published p full join measured m on p.cell_id = m.cell_id),
found as (select cell_id, 'only_published' difference from both_sides where no_m union all select cell_id, 'only_measured' from both_sides where no_p
  {' '.join(f"union all select cell_id, '{f}' from both_sides where d_{f} and not no_p and not no_m" for f in CELL_FIELDS)})
"""
_ALIAS_CASES = " ".join(f"when '{alias}' then '{name}'" for alias, name in drift.COMMON.items())
_P3 = f"""with files as (select * from matrix_files qualify row_number() over (partition by file_id order by received_at desc nulls last) = 1),
cells as (select file_id, series_id, generated_at, unnest(from_json(json_extract(body, '$.cells'), '["JSON"]')) cell from files where json_valid(body)),
leaves as (select file_id, replace(substring(t.fullkey, 3), '"', '') path, case when t.type = 'ARRAY' then 'array' when t.type = 'BOOLEAN' then 'boolean' when t.type = 'VARCHAR' then 'string' else 'number' end kind
  from cells, lateral (select * from json_tree(cell)) t where t.type not in ('OBJECT', 'NULL') and t.fullkey not like '%[%' and t.fullkey <> '$'),
named as (select file_id, case regexp_replace(lower(path), '[^a-z0-9.]', '', 'g') {_ALIAS_CASES} else path end field_name, path, kind from leaves),
fields as (select file_id, field_name, string_agg(distinct path, ' ' order by path) path, any_value(kind) kind from named group by 1, 2),
steps as (select file_id, lag(file_id) over (partition by series_id order by generated_at, file_id) before from files),
now_ as (select s.file_id, f.* exclude (file_id) from steps s join fields f on f.file_id = s.file_id where before is not null),
then_ as (select s.file_id, f.* exclude (file_id) from steps s join fields f on f.file_id = s.before),
both_ as (select coalesce(n.file_id, t.file_id) file_id, coalesce(n.field_name, t.field_name) field_name, n.path np, t.path tp, n.kind nk, t.kind tk from now_ n full join then_ t on n.file_id = t.file_id and n.field_name = t.field_name)
select file_id, field_name, 'added' change_kind from both_ where tp is null union all select file_id, field_name, 'removed' from both_ where np is null
union all select file_id, field_name, 'renamed' from both_ where np <> tp union all select file_id, field_name, 'retyped' from both_ where nk <> tk"""
#: The columns of p3_cells at scale 0.01: SQL can't derive them, so they are stated with the kinds they fold to.
_CELL_COLUMNS = {
    "adversary": "string", "decoder": "string", "duration_s": "integer", "evidence_dir": "array", "fidelity": "string", "noise_floor.deterministic": "string", "noise_floor.repeats": "string",
    "peak_mb": "integer", "peer_count": "integer", "reason": "array", "retry": "integer", "reviewed": "boolean", "tags": "array", "verdict": "string",
}


def _cell_sql() -> str:
    text = "case when t = 'VARCHAR' then v ->> '$' else cast(v as varchar) end"
    forms = {"string": text, "integer": f"try_cast({text} as bigint)", "boolean": f"try_cast({text} as boolean)", "array": "case when t = 'ARRAY' then cast(v as varchar) else cast(to_json([v ->> '$']) as varchar) end"}
    picked = ", ".join(f"max({forms[kind]}) filter (where field_name = '{f}') {f.replace('.', '_')}" for f, kind in _CELL_COLUMNS.items())
    return f"""with files as (select * from matrix_files qualify row_number() over (partition by file_id order by received_at desc nulls last) = 1),
held as (select file_id, series_id, generated_at, from_json(json_extract(body, '$.cells'), '["JSON"]') cells from files where json_valid(body)),
cells as (select file_id, series_id, generated_at, cast(i - 1 as int) cell_no, cells[i] cell from held, unnest(range(1, len(cells) + 1)) u(i)),
leaves as (select file_id, cell_no, replace(substring(t.fullkey, 3), '"', '') path, t.type t, json_extract(cell, t.fullkey) v
  from cells, lateral (select * from json_tree(cell)) t where t.type not in ('OBJECT', 'NULL') and t.fullkey not like '%[%' and t.fullkey <> '$'),
named as (select file_id, cell_no, case regexp_replace(lower(path), '[^a-z0-9.]', '', 'g') {_ALIAS_CASES} else path end field_name, t, v from leaves)
select c.file_id, c.series_id, c.generated_at, c.cell_no, {picked}, '{{}}' others from cells c left join named n on n.file_id = c.file_id and n.cell_no = c.cell_no group by 1, 2, 3, 4"""


_P3_FIELDS = _P3[: _P3.index("steps as")].rstrip(",\n ")
_P3_SCHEMA = (
    _P3_FIELDS.replace("else 'number' end kind", "when t.type in ('BIGINT', 'UBIGINT') then 'integer' else 'number' end kind").replace("any_value(kind) kind", "case when bool_or(kind = 'array') then 'array' when count(distinct kind) = 1 then any_value(kind) when bool_and(kind in ('integer', 'number')) then 'number' else 'string' end kind")
    + ", each_ as (select field_name, string_agg(distinct kind, ' ' order by kind) kinds, count(*) n_files, case when bool_or(kind = 'array') then 'array' when count(distinct kind) = 1 then any_value(kind) when bool_and(kind in ('integer', 'number')) then 'number' else 'string' end kind from fields group by 1) "
    "select field_name, kind, kinds, (select string_agg(distinct path, ' ' order by path) from named n where n.field_name = each_.field_name) paths, n_files from each_"
)
_P5 = """with docs as (select * from matrix_docs qualify row_number() over (partition by matrix_id order by received_at desc nulls last) = 1),
valid as (select matrix_id, case when json_type(body) = 'VARCHAR' then body ->> '$' else body end b from docs where json_valid(body)),
opened as (select matrix_id, case when json_type(b, '$.matrix') = 'OBJECT' then json_extract(b, '$.matrix') else cast(b as json) end j from valid where json_valid(b)),
held as (select matrix_id, json_extract(j, '$.cells') c from opened),
keyed as (select matrix_id, unnest(json_keys(c)) k, c from held where json_type(c) = 'OBJECT' and json_extract(c, '$.verdict') is null),
one as (select matrix_id, k, json_extract(c, '$."' || k || '"') v from keyed),
two as (select matrix_id, k, unnest(json_keys(v)) k2, v from one where json_extract(v, '$.verdict') is null),
cells as (select matrix_id, '' k, unnest(from_json(c, '["JSON"]')) cell from held where json_type(c) = 'ARRAY' union all select matrix_id, '', c from held where json_extract(c, '$.verdict') is not null
  union all select matrix_id, k, v from one where json_extract(v, '$.verdict') is not null union all select matrix_id, k || '|' || k2, json_extract(v, '$."' || k2 || '"') from two),
stated as (select matrix_id, coalesce(cell ->> '$.adversary', regexp_extract(k, 'A[1-3]')) adversary, coalesce(cell ->> '$.fidelity', regexp_extract(k, 'F[1-3]')) fidelity, coalesce(try_cast(cell ->> '$.noise_floor.repeats' as int), -1) repeats,
  case json_type(cell, '$.leaks') when 'ARRAY' then from_json(json_extract(cell, '$.leaks'), '["JSON"]') when 'OBJECT' then [json_extract(cell, '$.leaks')] end leaks from cells),
counted as (select * exclude (leaks), list_filter(leaks, lambda x: x is not null and json_type(x) <> 'NULL') leaks from stated),
rows_ as (select * exclude (leaks), i - 1 leak_no, case json_type(leaks[i], '$.locus') when 'ARRAY' then json_extract(leaks[i], '$.locus[0]') else json_extract(leaks[i], '$.locus') end l from counted, unnest(range(1, len(leaks) + 1)) u(i))
select matrix_id, adversary, fidelity, cast(leak_no as int) leak_no, coalesce(l ->> '$.feature_id', '') feature_id, coalesce(try_cast(l ->> '$.offset' as bigint), -1) locus_offset, repeats from rows_"""


def _scalar(value: str) -> str:
    """A JSON value as the text of an inlined column: texts as they are, a list of one as its member, empty objects as null."""
    plain = "case json_type({0}) when 'VARCHAR' then {0} ->> '$' when 'NULL' then null when 'OBJECT' then case when {0}::varchar <> '{{}}' then {0}::varchar end when 'ARRAY' then replace({0}::varchar, '\",\"', '\", \"') else {0}::varchar end"
    only = f"json_extract({value}, '$[0]')"
    return f"case when json_type({value}) = 'ARRAY' and json_array_length({value}) = 1 then {plain.format(only)} else {plain.format(f'({value})')} end"


def _columns(node: str, paths: list[str]) -> str:
    at = lambda p: f"json_extract({node}, '$." + ".".join(f'"{x}"' for x in p.split(".")) + "')"
    return ", ".join(f'{_scalar(at(p))} "{shred.column_name(p)}"' for p in paths)


def _listed(value: str) -> str:
    """The elements of a JSON value: of a list its members, else itself alone; nulls left out."""
    return f"list_filter(case json_type({value}) when 'ARRAY' then from_json({value}, '[\"JSON\"]') when 'NULL' then [] else case when {value} is null then [] else [{value}] end end, lambda x: x is not null and json_type(x) <> 'NULL')"


_FLAT = (
    _P5[: _P5.index("held as (")]
    + """held as (select matrix_id, j, json_extract(j, '$.cells') c from opened),
keyed as (select matrix_id, c, json_keys(c) ks from held where json_type(c) = 'OBJECT' and json_extract(c, '$.verdict') is null),
one as (select matrix_id, i * 1000 o, ks[i] k, json_extract(c, '$."' || ks[i] || '"') v from keyed, unnest(range(1, len(ks) + 1)) u(i)),
inner_ as (select matrix_id, o, k, v, json_keys(v) ks from one where json_type(v) = 'OBJECT' and json_extract(v, '$.verdict') is null),
listed as (select matrix_id, from_json(c, '["JSON"]') l from held where json_type(c) = 'ARRAY'),
found as (select matrix_id, i o, '' k, l[i] cell from listed, unnest(range(1, len(l) + 1)) u(i) union all select matrix_id, 0, '', c from held where json_extract(c, '$.verdict') is not null
  union all select matrix_id, o, k, v from one where json_extract(v, '$.verdict') is not null union all select matrix_id, o + i, k || '|' || ks[i], json_extract(v, '$."' || ks[i] || '"') from inner_, unnest(range(1, len(ks) + 1)) u(i)),
cells as (select matrix_id, k, cell, cast(row_number() over (partition by matrix_id order by o) - 1 as int) cn from found where cell is not null and json_type(cell) <> 'NULL'),
"""
    + f"""leak_lists as (select matrix_id, cn, {_listed("json_extract(cell, '$.leaks')")} l from cells),
leaks as (select matrix_id, cn, cast(i - 1 as int) no, l[i] leak, cast(row_number() over (partition by matrix_id order by cn, i) - 1 as int) ln from leak_lists, unnest(range(1, len(l) + 1)) u(i)),
locus_lists as (select matrix_id, cn, 0 late, no above, 'leaks' parent, ln parent_no, 'locus' as name, {_listed("json_extract(leak, '$.locus')")} l from leaks
  union all select matrix_id, cn, 1, 0, 'cells', cn, 'variable_loci', {_listed("json_extract(cell, '$.noise_floor.variable_loci')")} from cells),
loci as (select matrix_id, parent, parent_no, name, cast(i - 1 as int) no, l[i] x, cast(row_number() over (partition by matrix_id order by cn, late, above, i) - 1 as int) xn from locus_lists, unnest(range(1, len(l) + 1)) u(i)),
evidence_lists as (select matrix_id, ln, {_listed("json_extract(leak, '$.evidence')")} l from leaks)
"""
)
_SHRED_COLUMNS = {
    "document": ["format", "generated_at", "harness_version", "scrubber_fingerprint.checked", "scrubber_fingerprint.verdict", "tool.name", "tool.version"],
    "cells": ["evidence_dir", "noise_floor.deterministic", "noise_floor.repeats", "perceptual.checked", "perceptual.distance", "perceptual.metric", "perceptual.preserved", "perceptual.threshold", "reason", "verdict"],
    "leaks": ["correlates_with", "kind"],
    "locus": ["annotated_as", "feature_id", "hex_context", "length", "offset", "space"],
}
SQL = {
    "p5_document": _FLAT + f"select matrix_id, 0 document_no, null::varchar parent, -1 parent_no, 'document' as name, 0 no, {_columns('j', _SHRED_COLUMNS['document'])} from opened where json_type(j) = 'OBJECT'",
    "p5_cells": _FLAT + f"""select matrix_id, cn cells_no, 'document' parent, 0 parent_no, 'cells' as name, cn no, coalesce(cell ->> '$.adversary', nullif(regexp_extract(k, 'A[1-3]'), '')) adversary, coalesce(cell ->> '$.fidelity', nullif(regexp_extract(k, 'F[1-3]'), '')) fidelity, {_columns('cell', _SHRED_COLUMNS['cells'])} from cells""",
    "p5_leaks": _FLAT + f"select matrix_id, ln leaks_no, 'cells' parent, cn parent_no, 'leaks' as name, no, {_columns('leak', _SHRED_COLUMNS['leaks'])} from leaks",
    "p5_locus": _FLAT + f"select matrix_id, xn locus_no, parent, parent_no, name, no, {_columns('x', _SHRED_COLUMNS['locus'])} from loci",
    "p5_evidence": _FLAT + f"select matrix_id, cast(row_number() over (partition by matrix_id order by ln, i) - 1 as int) evidence_no, 'leaks' parent, ln parent_no, 'evidence' as name, cast(i - 1 as int) no, case when json_type(l[i]) = 'OBJECT' then {_scalar("json_extract(l[i], '$.text')")} else {_scalar('l[i]')} end as text from evidence_lists, unnest(range(1, len(l) + 1)) u(i)",
    "p2_found": _P2 + "select cell_id, difference from found",
    "p3_found": _P3,
    "p3_schema": _P3_SCHEMA,
    "p3_cells": _cell_sql(),
    "p5_found": _P5,
    "p6_found": f"with {ITEMS_SQL} select * from items",
    "p2_summary": _P2 + "select difference, count(*) n_cells from found group by 1",
}
