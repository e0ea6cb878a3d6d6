"""Reading tables, cutting lineage through the shared folder, and keeping the current row of a key."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLANKS = " \t\n\r 　"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, as they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="plainsift-ship-"), "plainsift.zip")  # on the driver, which serves it
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a folder of our own where it is unset and Spark runs in this
    process alone (tests). On a cluster without the setting this is an error, as no machine's own folder is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plainsift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by then
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    The table stays until the Python process ends, since the result is read lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def clean(col: Column) -> Column:
    """col without blanks at its ends."""
    return F.trim(col, F.lit(BLANKS))


def current_rows(df: DataFrame, key: str, latest: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per `key` with the columns `payload`: the one latest by the columns `latest`.

    Equal times are settled by content, so the choice is the same in every run. A row without key can't be
    recognised as a repetition and is kept as a row of its own; such rows are spread, not gathered in one task.
    """
    lone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    rest = [c for c in payload if c != key]
    tie = F.xxhash64(*[F.col(c).cast("string") for c in rest]) if rest else F.lit(0)
    keep = df.select(key, *rest, *[F.col(c).alias(f"_at{i}") for i, c in enumerate(latest)]).withColumn("_lone", lone).withColumn("_tie", tie)
    by = Window.partitionBy(key, "_lone").orderBy(*[F.col(f"_at{i}").desc_nulls_last() for i in range(len(latest))], F.col("_tie"))
    return keep.withColumn("_n", F.row_number().over(by)).where("_n = 1").select(key, *rest)
