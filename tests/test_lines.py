"""The decomposition over every line sees what stands in no group's first line."""

import datetime

from plainsift.plans import oracle


def lineitem(spark, tmp_path, status) -> str:
    """A table of 20 suppliers with 30 lines each; `status` gives the line status by supplier and place."""
    day = datetime.datetime(2020, 1, 1)
    rows = [(k, 1, 1, s, 1 + k % 7, 1.0, 2.0, 0.0, 0.0, "N", status(s, k), day) for s in range(20) for k in range(1, 31)]
    names = "l_orderkey bigint, l_partkey bigint, x bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).drop("x").write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def status_of(df) -> dict:
    return df.where("feature_id = 'linestatus'").first().asDict()


def test_variation_and_leak_in_later_lines(spark, tmp_path):
    folder = lineitem(spark, tmp_path, lambda s, k: "O" if k <= 7 else f"S{s}")
    assert status_of(oracle.variance_decompose(spark, folder)) == {"feature_id": "linestatus", "floor": True, "leak": True, "n_between": 20, "max_within": 2}
    assert oracle.a1_verdict(spark, folder).first().asDict() == {"verdict": "fail", "reason": "variant_correlated_leak", "leaks": "linestatus"}
    assert oracle.leaks_by_channel(spark, folder).collect()[0].asDict() == {"channel": "states", "features": "linestatus"}
    assert status_of(oracle.noise_floor(spark, folder))["n_values"] == 21


def test_every_line_reaches_the_operator(spark, tmp_path):
    folder = lineitem(spark, tmp_path, lambda s, k: None if (s, k) == (3, 30) else "O")
    assert oracle._lines(spark, folder).count() == 600 * 5
    assert status_of(oracle.noise_floor(spark, folder)) == {"feature_id": "linestatus", "n_values": 2, "floor": True}
