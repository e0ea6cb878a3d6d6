"""Streams: late events, sessions, and tallies kept from batch to batch."""

import datetime

from plainsift.streaming import folder

AT = datetime.datetime(2025, 1, 1)


def arrive(path, spark, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path))


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_late_events_are_left_out(spark, tmp_path):
    schema = "user_id int, event_type string, ts timestamp"
    hour = lambda h: AT + datetime.timedelta(hours=h)
    spark.createDataFrame([(1, "a", hour(0))], schema).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = folder.windowed_counts(stream, "1 hour").writeStream.outputMode("append").format("memory").queryName("late_counts").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    for rows in ([(1, "a", hour(9))], [(1, "a", hour(0)), (1, "a", hour(8.5))], [(1, "a", hour(30))]):
        arrive(tmp_path / "in", spark, rows, schema, 0)
        query.processAllAvailable()
    drained(query)
    found = {(r["window_start"], r["n"]) for r in spark.table("late_counts").collect()}
    assert found == {(hour(0), 1), (hour(8), 1), (hour(9), 1)}  # the event of hour 0 that came after hour 9 isn't counted


def test_tallies_go_on_over_batches(spark, tmp_path):
    schema = "tree int, outcome string, bytes_before bigint, extra string"
    batches = [[(1, "cleaned", 5, "x"), (1, "refused", None, "x"), (2, "dropped", -1, None)], [(1, "cleaned", 7, "y"), (None, None, 1, "z")]]
    arrive(tmp_path / "in", spark, batches[0], schema, 0)
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = folder.running_tallies(stream, "tree").writeStream.outputMode("update").format("memory").queryName("tallies").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    arrive(tmp_path / "in", spark, batches[1], schema, 1)
    query.processAllAvailable()
    drained(query)
    found = {(r["tree"], r["n"], r["unfinished"], r["bytes_before"], r["closed"]) for r in spark.table("tallies").collect()}
    assert found == {(1, 2, 1, 5, False), (2, 1, 0, 0, False), (1, 3, 1, 12, False), (None, 1, 1, 1, False)}
