"""Frequency of every distinct term: a range-partitioned external sort of (term, record) pairs, and a run-length scan of it.

1. Pairs are range-partitioned by field, term, record and a spreading number and sorted within partitions; the sort spills.
   As all four are part of the range, a term of any frequency, and even one record that repeats one term any number of
   times, is spread over as many partitions as it needs.
2. Each sorted partition is scanned once, batch by batch, with one open run carried from batch to batch: the scan gives per
   term the length of its run, the number of distinct records within it, and its first and last record.
3. A term's runs of neighbouring partitions are joined: a record that ends one run and begins the next is counted once. Only
   one row per term and partition is shuffled for this.

A null record identifier counts as one record; null and empty terms are no terms. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plainsift.shared import materialize

RARE_RECORDS = 2
COMMON_SHARE = 0.1
SPREAD = 64


def _changes(column: pa.Array) -> np.ndarray:
    """Of rows 1, 2, ... of a column, whether each differs from the row before; two nulls are equal."""
    before, now = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.fill_null(pc.not_equal(before, now), False)
    return np.asarray(pc.or_(differ, pc.xor(pc.is_null(before), pc.is_null(now))))


def _spans(batch: pa.RecordBatch, group: str, term: str, record: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sorted batch: where its terms begin, their lengths, and the number of records begun in each."""
    fresh = _changes(batch.column(group)) | _changes(batch.column(term))
    other = fresh | _changes(batch.column(record))
    starts = np.flatnonzero(np.concatenate(([True], fresh)))
    records = np.add.reduceat(np.concatenate(([1], other.astype(np.int64))), starts)
    return starts, np.diff(np.append(starts, batch.num_rows)), records


def run_lengths(batches: Iterator[pa.RecordBatch], group: str, term: str, record: str, part: int) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition, a row per term: group, term, occurrences, records, first and last record, part."""
    names = [group, term, "occurrences", "records", "first", "last", "part"]
    open_: pa.RecordBatch | None = None

    def joined(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
        """The open run a continued by b, the first run of the next batch."""
        again = a.column("last")[0].as_py() == b.column("first")[0].as_py()
        sums = [a.column(c)[0].as_py() + b.column(c)[0].as_py() for c in ("occurrences", "records")]
        sums[1] -= again
        return pa.RecordBatch.from_arrays([a.column(group), a.column(term), *[pa.array([x], pa.int64()) for x in sums], a.column("first"), b.column("last"), a.column("part")], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        starts, lengths, records = _spans(batch, group, term, record)
        first, last = pa.array(starts), pa.array(starts + lengths - 1)
        runs = pa.RecordBatch.from_arrays(
            [batch.column(group).take(first), batch.column(term).take(first), pa.array(lengths, pa.int64()), pa.array(records, pa.int64()), batch.column(record).take(first), batch.column(record).take(last), pa.array(np.full(len(starts), part), pa.int32())],
            names=names,
        )
        if open_ is not None:
            if all(open_.column(c)[0].as_py() == runs.column(c)[0].as_py() for c in (group, term)):
                open_, runs = joined(open_, runs.slice(0, 1)), runs.slice(1)
            if not runs.num_rows:
                continue
            yield open_
        if runs.num_rows > 1:
            yield runs.slice(0, runs.num_rows - 1)
        open_ = runs.slice(runs.num_rows - 1)
    if open_ is not None:
        yield open_


def sorted_runs(pairs: DataFrame, group: str, term: str, record: str) -> DataFrame:
    """`<group>, <term>, occurrences, records, first, last, part`: the runs of each sorted partition of pairs."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (group, term, record)}
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
    known = pairs.where(F.col(term) != "").select(group, term, record, spread.alias("_spread"))
    by = (group, term, record, "_spread")
    ordered = known.repartitionByRange(*by).sortWithinPartitions(*by)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run_lengths(batches, group, term, record, TaskContext.get().partitionId())

    return ordered.mapInArrow(scan, f"`{group}` {kinds[group]}, `{term}` {kinds[term]}, occurrences bigint, records bigint, first {kinds[record]}, last {kinds[record]}, part int")


def frequencies(pairs: DataFrame, group: str, term: str, record: str) -> DataFrame:
    """`<group>, <term>, occurrences, records` over all rows of pairs."""
    runs = sorted_runs(pairs, group, term, record)
    before = F.lag(F.struct("last")).over(Window.partitionBy(group, term).orderBy("part"))  # at most a row per partition
    again = F.when(before.isNotNull() & before["last"].eqNullSafe(F.col("first")), 1).otherwise(0)
    return runs.withColumn("_again", again).groupBy(group, term).agg(F.sum("occurrences").alias("occurrences"), (F.sum("records") - F.sum("_again")).alias("records"))


def marked(counts: DataFrame, n_records: int, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """counts with `mark`: `rare` in at most `rare` records, `common` in more than the share `common` of n_records."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * n_records, "common")
    return counts.withColumn("mark", mark)


def term_table(pairs: DataFrame, n_records: int, group: str, term: str, record: str) -> DataFrame:
    """The marked frequencies of pairs. They are written once: a range partition reads its input twice."""
    return marked(frequencies(materialize(pairs.select(group, term, record), "term-pairs"), group, term, record), n_records)
