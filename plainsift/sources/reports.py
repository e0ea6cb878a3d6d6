"""Report files as tables: test runs, JSON documents, marked blocks of text, and the checks on matrix documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICTS = ("pass", "fail", "not_applicable", "not_tested")
CASE = "_classname string, _name string, _time double, _file string, _line int, failure struct<_message:string,_VALUE:string>, error struct<_message:string,_VALUE:string>, skipped struct<_message:string,_VALUE:string>"


def test_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """`nodeid, name, status, time, leg, file, line, message` of the cases of JUnit files; malformed rows are left out.

    The leg is what follows `junit-` in the file's name, or its folder."""
    cases = spark.read.format("xml").option("rowTag", "testcase").option("mode", "DROPMALFORMED").schema(CASE).load(paths).withColumn("_source", F.col("_metadata.file_path"))
    status = F.when(F.col("failure").isNotNull() | F.col("error").isNotNull(), "fail").when(F.col("skipped").isNotNull(), "skip").otherwise("pass")
    leg = F.coalesce(F.nullif(F.regexp_extract("_source", r"junit-([^/]+)\.xml$", 1), F.lit("")), F.regexp_extract("_source", r"([^/]+)/[^/]+$", 1))
    message = F.coalesce("failure._message", "error._message", "skipped._message")
    return cases.select(F.concat_ws("::", "_classname", "_name").alias("nodeid"), F.col("_name").alias("name"), status.alias("status"), F.coalesce("_time", F.lit(0.0)).alias("time"), leg.alias("leg"), F.col("_file").alias("file"), F.col("_line").alias("line"), message.alias("message"))


def json_documents(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """JSON files, one document each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(paths)


def marked_blocks(spark: SparkSession, paths: str | list[str], name: str) -> DataFrame:
    """`path, block`: the text between the comments `name:BEGIN` and `name:END` of each file."""
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.select("path", F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)<!--\s*{name}:BEGIN[^>]*-->(.*?)<!--\s*{name}:END"), F.lit(1))).alias("block"))


def numbered_rows(blocks: DataFrame, block: str) -> DataFrame:
    """`number, text` of the rows `| n | text |` of a table in text."""
    rows = blocks.select(F.explode(F.split(block, "\n")).alias("r")).where(F.col("r").rlike(r"^\|\s*[0-9]+\s*\|"))
    return rows.select(F.regexp_extract("r", r"^\|\s*([0-9]+)\s*\|", 1).cast("int").alias("number"), F.trim(F.regexp_extract("r", r"^\|[^|]*\|([^|]*)\|?", 1)).alias("text"))


def invalid_cells(cells: DataFrame) -> DataFrame:
    """`reason` beside the columns of cells: rows that break the schema of matrix documents; a valid table gives none."""
    allowed = {"adversary": ("A1", "A2", "A3"), "fidelity": ("F1", "F2", "F3"), "verdict": VERDICTS}
    checks = [F.when(F.col(c).isNull(), F.concat(F.lit(c), F.lit(" missing"))).when(~F.col(c).isin(*v), F.concat(F.lit(c), F.lit(" unknown"))) for c, v in allowed.items()]
    return cells.withColumn("reason", F.concat_ws("; ", *checks)).where("reason <> ''")


def write_sheet(rows: DataFrame, path: str) -> None:
    """One CSV file of the sheet's rows in the order of paths, with a header; names only, never values."""
    rows.coalesce(1).sortWithinPartitions("path").write.option("header", True).option("encoding", "UTF-8").mode("errorifexists").csv(path)
