"""A stream that is stopped and goes on gives what the batch query gives."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.streaming import logs

SCHEMA = "event_id long, ts timestamp, event_type string"
START = datetime(2024, 1, 1)


def test_restart_late_rows_and_repeats(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    minutes = lambda i, m, t="a": (i, START + timedelta(minutes=m), t)

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}")

    def run():
        return logs.run_counts(spark.readStream.schema(SCHEMA).parquet(f"file://{folder}"), "event_id", "10 minutes", "15 minutes", out, state)

    arrive([minutes(i, i) for i in range(40)] + [minutes(3, 3)])
    first = run().count()
    assert first == 2  # windows from 0 and from 10 end by 39 - 15 = 24
    assert run().count() == first  # nothing new: nothing is written again
    arrive([minutes(100, 30, "b"), minutes(101, 5), minutes(39, 39), minutes(102, 90)])  # in time, too late, a repeat, and one that closes windows
    got = {((r["start"] - START).seconds // 60, r["event_type"]): r["n"] for r in run().collect()}
    assert got == {(0, "a"): 10, (10, "a"): 10, (20, "a"): 10, (30, "a"): 10, (30, "b"): 1}
    kept = spark.createDataFrame([minutes(i, i) for i in range(40)] + [minutes(100, 30, "b"), minutes(102, 90)], SCHEMA)
    batch = logs.tumbling(kept, "10 minutes").filter(F.col("start") < F.lit(START + timedelta(minutes=60)))
    assert {((r["start"] - START).seconds // 60, r["event_type"]): r["n"] for r in batch.collect()} == got
