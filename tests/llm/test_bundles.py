"""Kinds of bundles of any number, and groups that stay within their bounds."""

from plainsift.llm import binpack, queries


def test_more_kinds_than_one_plan_holds(spark, tmp_path):
    spark.range(1001).selectExpr("concat('k', id) bundle_kind", "id + 512 capacity").write.parquet(str(tmp_path / "bundles.parquet"))
    spark.createDataFrame([(1, "text")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.p8_containers(spark, str(tmp_path)).collect()
    assert sorted(r["bundle_kind"] for r in rows) == sorted(f"k{n}" for n in range(1001))
    assert {(r["doc_id"], r["size"]) for r in rows} == {(1, 1)}


def test_one_key_for_all_rows_is_spread_within_bounds(spark):
    rows = [(None if n % 2 else 7, 1 + n % 90) for n in range(4000)] + [(8, 100_000)]
    df = spark.createDataFrame(rows, "k int, size int").repartition(4)
    out = binpack.pack(df, "k", "size", [("s", 1000)], group_size=20_000, group_items=500)
    per = out.selectExpr(f"container_id div {binpack._PER_GROUP} g", "size", "piece_no", "k").groupBy("g").agg({"size": "sum", "*": "count"}).collect()
    assert len(per) >= 9
    assert all(r["count(1)"] <= 500 for r in per)
    over = [r for r in per if r["sum(size)"] > 20_000]
    assert [r["sum(size)"] for r in over] == [100_000]  # the one item over the bound, alone
    assert out.groupBy("container_id").sum("size").where("`sum(size)` > 1000").count() == 0
    assert out.selectExpr("sum(size)").first()[0] == sum(s for _, s in rows)
