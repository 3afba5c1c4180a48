"""Rate-limited checks and sessions, batch against stream."""

import datetime

from pyspark.sql import functions as F

from graphloom.streaming import refresh


def test_accepted_batch_and_stream_agree(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1, t0 + datetime.timedelta(seconds=s), i) for i, s in enumerate((0, 1, 2, 3, 3.5, 5.1))] + [(2, t0, 9)]
    df = spark.createDataFrame(rows, "k long, at timestamp, n int")
    got = refresh.accepted(df, "k", "at", "n", 2)
    assert sorted(r["n"] for r in got.where("accepted").collect()) == [0, 2, 5, 9]
    df.select("k", "at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, at timestamp").parquet(str(tmp_path / "in"))
    q = refresh.accepted_stream(stream, "k", "at", 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_sessions_and_rebuild(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(t0,), (t0 + datetime.timedelta(seconds=1),), (t0 + datetime.timedelta(seconds=9),)], "at timestamp").write.parquet(str(tmp_path / "in"))
    batch = refresh.sessions(spark.read.parquet(str(tmp_path / "in")), "at", "2 seconds", "1 minute")
    assert sorted(r["n"] for r in batch.collect()) == [1, 2]
    seen = []
    q = refresh.rebuild_on_change(spark.readStream.schema("at timestamp").parquet(str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(seen) == 3


def test_changed(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y")], "k string, n int, fp string")
    assert {r["n"] for r in refresh.changed(df, "k", "n", "fp").collect()} == {1, 3}
    assert refresh.changed(df, "k", "n", "fp").where(F.col("n") == 2).isEmpty()
