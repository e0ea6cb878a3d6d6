"""Classifier and similarity queries over the vectors of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.functions import binary
from plainsift.operators import matching, reporting
from plainsift.shared import table

EVERY = 20


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, with the document each belongs to: of four neighbouring numbers."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).alias("document"), F.col("label").cast("bigint").alias("label"), "embedding")


def _nearest(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return matching.nearest_other(rows.where(F.col("vec_id") % EVERY == 0), rows, "vec_id", vector, "label", "document")


def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector whose id is divisible by 20, the nearest of all vectors outside its own document."""
    found = _nearest(_vectors(spark, sf_dir))
    return found.select("query", "neighbour", "query_label", "neighbour_label", F.round("distance", 6).alias("distance"))


def loo_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of queries whose nearest other vector has their label, against chance."""
    none = F.lit(None)
    found = nearest_neighbour(spark, sf_dir).select((F.col("query_label") == F.col("neighbour_label")).cast("int").alias("hit"), none.cast("bigint").alias("label"))
    every = found.unionByName(_vectors(spark, sf_dir).select(none.cast("int").alias("hit"), "label"))
    told = every.agg(F.count("hit").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count_distinct("label").alias("k"))
    return told.select("n", "hits", F.round(F.try_divide("hits", "n"), 6).alias("accuracy"), F.round(F.try_divide(F.lit(1), F.col("k")), 6).alias("chance"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by their own label and their neighbour's."""
    return nearest_neighbour(spark, sf_dir).groupBy("query_label", "neighbour_label").agg(F.count(F.lit(1)).alias("n"))


def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the accuracy beats chance: the upper binomial tail, at 5 %."""
    row = loo_accuracy(spark, sf_dir).withColumn("p", F.round(binary.binomial_tail(F.col("hits"), F.col("n"), F.col("chance")), 6))
    return row.select("n", "hits", "p", ((F.col("p") < 0.05) & (F.col("accuracy") > F.col("chance"))).alias("significant"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standardised centre of each label."""
    found = reporting.standardised_centroids(_vectors(spark, sf_dir), "label", "embedding")
    return found.select("label", "at", F.round("centre", 6).alias("centre"))


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy of the nearest vector outside its own document, by the whole vectors and by each half of them alone."""
    rows = _vectors(spark, sf_dir).where("embedding is not null")
    cut = F.floor(F.size("embedding") / 2).cast("int")
    slices = {"whole": F.col("embedding"), "first half": F.slice("embedding", F.lit(1), cut), "second half": F.slice("embedding", cut + 1, F.size("embedding") - cut)}
    told = []
    for name, part in slices.items():
        found = _nearest(rows.withColumn("embedding", part))
        told.append(found.select(F.lit(name).alias("slice"), (F.col("query_label") == F.col("neighbour_label")).cast("int").alias("hit")))
    every = told[0].unionByName(told[1]).unionByName(told[2])
    return every.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("accuracy"))


def to_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE and PSNR of each vector against the reversed one, and its profile pooled into 8 bins."""
    rows = _vectors(spark, sf_dir).where("size(embedding) > 0").withColumn("e", F.col("embedding").cast("array<double>"))
    return rows.select("vec_id", binary.rmse(F.col("e"), F.reverse("e"), 6).alias("rmse"), F.round(binary.psnr(F.col("e"), F.reverse("e")), 6).alias("psnr"), F.round(F.element_at(binary.pooled(F.col("e"), 8), 3), 6).alias("third_bin"))


def bit_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of equal bits of two numbers made of each order."""
    a, b = F.col("o_orderkey") * 40503 % 4294967296, F.col("o_custkey") * 40503 % 4294967296
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(binary.bit_agreement(F.array(a, b), F.array(b, b)), 6).alias("agreement"), binary.hamming(a, b).alias("distance"))


QUERIES = {f.__name__: f for f in (nearest_neighbour, loo_accuracy, confusion, significance, centroids, ablation, to_centre, bit_agreement)}

_V = "with v as (select vec_id, vec_id // 4 doc, cast(label as bigint) as label, cast(embedding as double[]) e from embeddings where embedding is not null)"
_BEST = """select q.vec_id query, q.label query_label, arg_min(r.vec_id, (d, r.vec_id)) neighbour, arg_min(r.label, (d, r.vec_id)) neighbour_label, min(d) distance
  from (select *, 1 j from {0} where vec_id % 20 = 0) q join (select *, 1 j from {0}) r on q.j = r.j and q.doc <> r.doc, lateral (select list_distance(q.e, r.e) d) group by 1, 2"""
_NN = f"{_V}, nn as ({_BEST.format('v')})\n"
_HALVES = {"whole": "e", "first half": "e[1:len(e) // 2]", "second half": "e[len(e) // 2 + 1:]"}
SQL = {
    "nearest_neighbour": _NN + "select query, neighbour, query_label, neighbour_label, round(distance, 6) distance from nn",
    "loo_accuracy": _NN + "select count(*) n, count(*) filter (where query_label = neighbour_label) hits, round(count(*) filter (where query_label = neighbour_label) / count(*), 6) accuracy, round(1 / (select count(distinct label) from v), 6) chance from nn",
    "significance": _NN + ", a as (select count(*) n, count(*) filter (where query_label = neighbour_label) hits, (select count(distinct label) from v) k from nn), t as (select n, hits, k, round(least(1.0, case when hits <= 0 then 1.0 else list_sum(list_transform(range(hits, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(round(1 / k, 6)) + (n - i) * ln(1 - round(1 / k, 6))))) end), 6) p from a) select n, hits, p, p < 0.05 and hits / n > 1 / k significant from t",
    "to_centre": "with v as (select vec_id, cast(embedding as double[]) e from embeddings where len(embedding) > 0), d as (select vec_id, e, len(e) n, list_sum(list_transform(list_zip(e, list_reverse(e)), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / len(e) m from v) select vec_id, round(sqrt(m), 6) rmse, case when m = 0 then 'inf'::double else round(10 * log10(65025.0 / m), 6) end psnr, round(case when 3 * n // 8 > 2 * n // 8 then list_sum(e[2 * n // 8 + 1 : 3 * n // 8]) / (3 * n // 8 - 2 * n // 8) else 0 end, 6) third_bin from d",
    "confusion": _NN + "select query_label, neighbour_label, count(*) n from nn group by 1, 2",
    "centroids": "with l as (select cast(label as bigint) as label, i - 1 as at_, cast(embedding[i] as double) x from embeddings, unnest(range(1, len(embedding) + 1)) t(i)), s as (select at_, avg(x) m, stddev_pop(x) d from l group by 1), c as (select label, at_, avg(x) c from l group by 1, 2) select label, cast(c.at_ as int) as \"at\", round((c - m) / (d + 1e-12), 6) centre from c join s on s.at_ = c.at_",
    "ablation": _V
    + "".join(f", s{n} as (select vec_id, doc, label, {e} e from v), n{n} as ({_BEST.format(f's{n}')})" for n, e in enumerate(_HALVES.values()))
    + " select slice, count(*) n, cast(sum(hit) as bigint) hits, round(avg(hit), 6) accuracy from ("
    + " union all ".join(f"select '{name}' slice, cast(query_label = neighbour_label as int) hit from n{n}" for n, name in enumerate(_HALVES))
    + ") group by 1",
    "bit_agreement": "with o as (select o_orderkey, o_orderkey * 40503 % 4294967296 a, o_custkey * 40503 % 4294967296 b from orders) select o_orderkey, round(1 - bit_count(xor(a, b)) / 64, 6) agreement, cast(bit_count(xor(a, b)) as int) distance from o",
}
