"""Join-shaped operators: differences of described fields, leak search, first match, as-of, ranges, closure, neighbours."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plainsift.operators.intervals import carried
from plainsift.shared import materialize, shared_dir


def field_diff(before: DataFrame, after: DataFrame, file: str = "file_id") -> DataFrame:
    """`<file>, locus, status, before, after`: removed, changed, kept or added, for every locus of either side.

    Both sides have `<file>, locus, value`, a locus once per file. A null value is a value: it equals null only.
    """
    b = before.select(file, "locus", F.col("value").alias("before"), F.lit(True).alias("_b"))
    a = after.select(file, "locus", F.col("value").alias("after"), F.lit(True).alias("_a"))
    status = F.when(F.col("_a").isNull(), "removed").when(F.col("_b").isNull(), "added").when(F.col("before").eqNullSafe(F.col("after")), "kept").otherwise("changed")
    return b.join(a, [file, "locus"], "full_outer").select(file, "locus", status.alias("status"), "before", "after")


def evidence_diff(published: DataFrame, measured: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """`on, published, measured, status`: confirmed, difference, or unmeasured where the measured side has no answer."""
    p = published.select(*on, F.col(value).alias("published"))
    m = measured.select(*on, F.col(value).alias("measured"))
    unmeasured = F.col("measured").isNull() | ((F.col("measured") == "not_tested") & (F.col("published") != "not_tested"))
    status = F.when(unmeasured, "unmeasured").when(F.col("published").eqNullSafe(F.col("measured")), "confirmed").otherwise("difference")
    return p.join(m, list(on), "left").select(*on, "published", "measured", status.alias("status"))


MIN_SEARCHABLE = 5


def _searchable(value):  # noqa: ANN001, ANN202
    """A removed value that can be searched: without surrounding blanks, long enough to tell, and no reader's remark."""
    return (F.length(value) >= MIN_SEARCHABLE) & ~F.startswith(value, F.lit("("))


def _expected(key, groups: Sequence[str], tags: Sequence[str]):  # noqa: ANN001, ANN202
    """Whether a tag is one that may keep the value: by its group, its whole key, or its name."""
    one_of = lambda c, names: c.isin(list(names)) if names else F.lit(False)
    return one_of(F.split_part(key, F.lit(":"), F.lit(1)), groups) | one_of(key, tags) | one_of(F.element_at(F.split(key, ":"), -1), tags)


def leak_search(values: DataFrame, tags: DataFrame, file: str = "file_id", expected_groups: Sequence[str] = (), expected_tags: Sequence[str] = ()) -> DataFrame:
    """`<file>, value, key, expected`: of each removed value, the first tag of its file that still holds it in its key or text,
    letter case left aside, and whether that tag is expected to.

    values: `<file>, value`; tags: `<file>, seq, key, text`. The join is by file, so a value only meets the tags of its
    own file. Null values, values under MIN_SEARCHABLE characters and remarks in brackets aren't searched.
    """
    wanted = values.select(file, F.trim("value").alias("value")).where(_searchable(F.col("value"))).distinct()
    said = F.lower(F.concat_ws(" ", "key", "text"))
    hits = wanted.join(tags.select(file, "seq", "key", "text"), file).where(F.contains(said, F.lower("value")))
    return hits.groupBy(file, "value").agg(F.min_by("key", "seq").alias("key")).withColumn("expected", _expected(F.col("key"), expected_groups, expected_tags))


def leaks_within(rows: DataFrame, file: str, values: str, tags: str, expected_groups: Sequence[str] = (), expected_tags: Sequence[str] = ()) -> DataFrame:
    """`leak_search` where a row holds the values (array of texts) and the tags (array of key and text, in order) of its
    file: nothing is joined or shuffled."""
    wanted = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), _searchable))
    first = lambda v: F.get(F.filter(tags, lambda t: F.contains(F.lower(F.concat_ws(" ", t["key"], t["text"])), F.lower(v))), F.lit(0))["key"]
    found = rows.select(file, F.explode(F.transform(wanted, lambda v: F.struct(v.alias("value"), first(v).alias("key")))).alias("x")).where("x.key is not null")
    return found.select(file, "x.value", "x.key", _expected(F.col("x.key"), expected_groups, expected_tags).alias("expected"))


def first_match(items: DataFrame, key: str, text: str, rules: Sequence[tuple[int, str, str, str]], other: str | None = None) -> DataFrame:
    """items with `matched`: the name of the rule of least priority that holds, or other.

    A rule is (priority, kind, sign, name), its kind `prefix`, `suffix`, `contains` or `regexp`. Rules are few and given
    as values, so they become one expression and nothing is joined or shuffled. Null texts match nothing.
    """
    tests = {"prefix": lambda s: F.col(text).startswith(s), "suffix": lambda s: F.col(text).endswith(s), "contains": lambda s: F.col(text).contains(s), "regexp": lambda s: F.col(text).rlike(s)}
    chain = None
    for _, kind, sign, name in sorted(rules):
        chain = F.when(tests[kind](sign), name) if chain is None else chain.when(tests[kind](sign), name)
    return items.withColumn("matched", F.lit(other) if chain is None else chain.otherwise(F.lit(other)))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, strict: bool = False) -> DataFrame:
    """left with `asof`: the value of the latest right row of the same key at or before (strict: before) its time.

    Both sides are range-partitioned together by key and time, so a key of any size is spread; within a block the value
    is carried by a window, and across blocks by one row per key and block boundary, of which there are at most as many
    as partitions. Rows with a null key or time get null. Right rows of equal time: the greatest value counts.
    """
    cols = left.columns
    r = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(at).alias("_t")).agg(F.max(value).alias("_v")).withColumn("_s", F.lit(1))
    l_ = left.select(F.col(by).alias("_k"), F.col(at).alias("_t"), (F.lit(2) if not strict else F.lit(0)).alias("_s"), F.struct(*cols).alias("_row"))
    both = l_.unionByName(r, allowMissingColumns=True)
    cut = materialize(both.repartitionByRange("_k", "_t", "_s").withColumn("_block", F.spark_partition_id()), "as-of")
    inside = Window.partitionBy("_k", "_block").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    near = cut.withColumn("_near", F.last("_v", ignorenulls=True).over(inside))
    ends = cut.groupBy("_k", "_block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_last"))
    over = ends.withColumn("_far", F.last("_last", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).where("_far is not null").select("_k", "_block", "_far")
    joined = near.where("_row is not null").join(over, ["_k", "_block"], "left")
    return joined.select("_row.*", F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_near", "_far")).alias("asof"))


def in_interval(points: DataFrame, at: str, intervals: Sequence[tuple[float, float, str]]) -> DataFrame:
    """points with `label`: of the intervals [start, end) that hold the point, the one that starts last."""
    chain = F.lit(None).cast("string")
    for start, end, label in sorted(intervals, key=lambda x: x[0]):
        chain = F.when((F.col(at) >= start) & (F.col(at) < end), label).otherwise(chain)
    return points.withColumn("label", chain)


def closure(edges: DataFrame, roots: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """`node, depth`: all nodes reached from roots (column `node`) along edges (`src`, `dst`), breadth first.

    Nodes of barriers (column `node`) aren't entered. Each round is written to the shared folder, so the plan stays flat.
    """
    edges = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    if barriers is not None:  # no edge leads into a barrier, so rounds needn't look at them
        edges = edges.join(barriers.select(F.col("node").alias("dst")), "dst", "left_anti")
    edges = materialize(edges.select("src", "dst"), "closure-edges")
    spark, path, depth = roots.sparkSession, f"{shared_dir(roots.sparkSession)}/closure-{uuid.uuid4().hex}", 0
    step = roots.where("node is not null").select("node").distinct()
    while True:
        step.write.parquet(f"{path}/depth={depth}")
        frontier = spark.read.schema(step.schema).parquet(f"{path}/depth={depth}")
        if frontier.isEmpty():
            break
        # one scan of the folder is all that was reached so far, however many rounds there were
        reached = spark.read.schema(step.schema).parquet(*[f"{path}/depth={d}" for d in range(depth + 1)])
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti")
        depth += 1
    return spark.read.schema(T.StructType([*step.schema.fields, T.StructField("depth", T.IntegerType())])).option("basePath", path).parquet(path)


def numbered_breadth_first(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """`node, depth, number`: the nodes reached from roots, numbered from 1 by depth and node. The numbers are carried over
    range blocks, so no task sorts all nodes."""
    found = closure(edges, roots).withColumn("_all", F.lit(0))
    laid = carried(found, "_all", ["depth", "node"], F.lit(1), "sum", "_before")
    return laid.select("node", "depth", (F.coalesce("_before", F.lit(0)) + 1).alias("number"))


def multiset_diff(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """`by, n_left, n_right` of the values that the two sides don't hold equally often; nulls are equal. Two multisets are equal
    if there is no row. Each side is counted before the shuffle."""
    sides = [df.select(*by, F.lit(int(df is left)).alias("_l"), F.lit(int(df is not left)).alias("_r")) for df in (left, right)]
    counts = sides[0].unionByName(sides[1]).groupBy(*by).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    return counts.where("n_left <> n_right")


def sequence_diff(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """`<by>, n_wrong, first_wrong`: of each stream, the places at which the two sides' values differ or one has none."""
    l_, r = (df.select(F.col(by), F.col(at).alias("_at"), F.struct(F.col(value)).alias(n)) for df, n in ((left, "_l"), (right, "_r")))
    wrong = l_.join(r, [by, "_at"], "full_outer").where(~F.col("_l").eqNullSafe(F.col("_r")))
    return wrong.groupBy(by).agg(F.count(F.lit(1)).alias("n_wrong"), F.min("_at").alias("first_wrong"))


def sample_of_each(rows: DataFrame, kind: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each kind, or all where there are fewer, the same in every run: those of the least digest of key and seed.
    Only n rows of a kind leave each partition."""
    order = Window.partitionBy(kind).orderBy(F.sha2(F.concat_ws("/", F.lit(seed), F.col(key).cast("string")), 256), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def components(edges: DataFrame) -> DataFrame:
    """`node, component`: the least node of each connected component, by hooking and pointer jumping.

    Rounds grow with the logarithm of the longest path; each is written to the shared folder.
    """
    pairs = edges.where("src is not null and dst is not null").select("src", "dst")
    both = materialize(pairs.union(pairs.select("dst", "src")).distinct(), "component-edges")
    label = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "components")
    while True:
        near = both.join(label, both["dst"] == label["node"]).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("_near"))
        hooked = label.join(near, "node").select("node", F.least("component", "_near").alias("component"))
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        fresh = materialize(hooked.join(jump, "component", "left").select("node", F.least("component", F.coalesce("_next", "component")).alias("component")), "components")
        if fresh.join(label, ["node", "component"], "left_anti").isEmpty():
            return fresh
        label = fresh


BLOCK = 2048


def _blocks(rows: DataFrame, key: str, vector: str, label: str, own: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([pa.array([x.to_pylist()], t) for x, t in [*[(part.column(n), pa.list_(pa.int64())) for n in ("id", "label", "own")], (part.column("vector"), pa.list_(pa.list_(pa.float64())))]], names=["ids", "labels", "owns", "vectors"])

    plain = [F.col(c).cast("bigint").alias(n) for c, n in ((key, "id"), (label, "label"), (own, "own"))]
    return rows.where(F.col(vector).isNotNull()).select(*plain, F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, "ids array<bigint>, labels array<bigint>, owns array<bigint>, vectors array<array<double>>")


def nearest_other(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str, own: str | None = None) -> DataFrame:
    """`query, query_label, neighbour, neighbour_label, distance`: of each query the nearest row of another document, which the
    column `own` numbers (by default the key: every row is its own document). A query without such a row has none.

    A stated query set is held against all rows in blocks of BLOCK rows: block pairs are compared by matrix products, and
    only one candidate per query and block pair is shuffled. Ties go to the smaller key. Null vectors take no part.
    """
    q = _blocks(queries, key, vector, label, own or key, BLOCK).select(F.struct("ids", "labels", "owns", "vectors").alias("q"))
    r = _blocks(rows, key, vector, label, own or key, BLOCK).select(F.struct("ids", "labels", "owns", "vectors").alias("r"))
    pairs = q.join(r, F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("q").to_pylist(), batch.column("r").to_pylist(), strict=True):
                x, y = np.array(a["vectors"]), np.array(b["vectors"])
                ids, labels = np.array(b["ids"]), np.array(b["labels"])
                rough = (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :]
                same = np.array(a["owns"], object)[:, None] == np.array(b["owns"], object)[None, :]  # exact for any bigint; null equals null
                rough[same] = np.inf
                out = []
                for n in range(len(x)):
                    near = np.flatnonzero(rough[n] <= rough[n].min() + 1e-9)
                    near = near[np.isfinite(rough[n][near])]
                    if len(near):
                        exact = np.sqrt(((y[near] - x[n]) ** 2).sum(1))
                        best = near[np.lexsort((ids[near], exact))[0]]
                        out.append((a["ids"][n], a["labels"][n], int(ids[best]), int(labels[best]), float(np.sqrt(((y[best] - x[n]) ** 2).sum()))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["query", "query_label", "neighbour", "neighbour_label", "distance"])

    found = pairs.mapInArrow(run, "query bigint, query_label bigint, neighbour bigint, neighbour_label bigint, distance double")
    best = found.groupBy("query", "query_label").agg(F.min(F.struct("distance", "neighbour", "neighbour_label")).alias("b"))
    return best.select("query", "query_label", "b.neighbour", "b.neighbour_label", "b.distance")
