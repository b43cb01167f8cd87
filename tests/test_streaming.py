"""The event-time operators as streams give what they give as batches."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillon.streaming import events as E


def batch(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("op", [E.tumbling, E.sliding, E.sessions])
def test_stream_is_batch(spark, tmp_path, op):
    for k in range(2):
        spark.read.parquet(f"{SF}/events.parquet").filter(f"event_id % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        next((tmp_path / f"in{k}").glob("part*.parquet")).rename(tmp_path / f"in/events{k}.parquet")
    streamed = op(E.stream(spark, str(tmp_path / "in"), per_trigger=2), late="60 days")
    got = E.drained(streamed, str(tmp_path / "cp"), f"out_{op.__name__}", "complete" if op is not E.sessions else "append")
    want = op(batch(spark))
    if op is E.sessions:
        assert got.count() <= want.count()  # the last sessions stay open until the watermark passes them
    else:
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_append_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    both = batch(spark).limit(50)
    both.union(both).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("part*.parquet")).rename(tmp_path / "in/events0.parquet")
    E.appended(E.stream(spark, str(tmp_path / "in")).withWatermark("ts", "60 days"), str(tmp_path / "out"), str(tmp_path / "cp"), "event_id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
