"""Folders cleaned as files arrive, and windows over event times."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plainsift.operators.folder import clean_files
from plainsift.shared import ship
from plainsift.sources.files import FILE_SCHEMA


def clean_arriving(spark: SparkSession, source: str, sheet: str, checkpoint: str, target: str | None = None, once: bool = True) -> StreamingQuery:
    """Clean the files that arrive below source and append their rows to the Parquet sheet, batch by batch.

    The checkpoint remembers what was done, so a run that was stopped goes on where it was. A batch that is repeated after
    a failure overwrites its own part of the sheet.
    """
    ship(spark)
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).load(source)
    base = source.split(":", 1)[-1].strip("/")
    files = files.withColumn("relative", F.substring_index("path", base + "/", -1))

    def each(batch: DataFrame, number: int) -> None:
        from plainsift.operators.folder import write_cleaned

        rows = clean_files(batch.select("relative", "content"))
        if target is not None:
            write_cleaned(rows, target).write.mode("overwrite").format("noop").save()
        rows.drop("cleaned").write.mode("overwrite").parquet(f"{sheet}/batch={number}")

    query = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per window and type; rows later than `late` are left out where events are a stream."""
    marked = events.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return marked.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of users: events less than gap apart."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


TALLY = "n bigint, unfinished bigint, bytes_before bigint"


def running_tallies(rows: DataFrame, by: str, idle: str = "NoTimeout", idle_ms: int = 0) -> DataFrame:
    """`<by>, n, unfinished, bytes_before, closed` of a stream of sheet rows: after each batch, the tally of every group that it
    touched, over all batches so far. The state of a group is three numbers, however many rows it has had.

    With idle `ProcessingTimeTimeout`, a group without rows for idle_ms gives a last row with `closed` and its state is dropped.
    """
    kind = rows.schema[by].dataType.simpleString()
    written = ("cleaned", "kept as text", "kept unscrubbed", "dropped")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, unfinished, size = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            state.remove()
        else:
            for frame in frames:
                n += len(frame)
                unfinished += int((~frame["outcome"].isin(written)).sum())
                size += int(frame["bytes_before"].fillna(0).clip(lower=0).sum())
            state.update((n, unfinished, size))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({by: [key[0]], "n": [n], "unfinished": [unfinished], "bytes_before": [size], "closed": [not state.exists]})

    picked = rows.select(by, "outcome", "bytes_before")
    return picked.groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, {TALLY}, closed boolean", TALLY, "update", idle)
