"""Event-time operators: the same functions run on a static and on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """events as a stream of files; ts becomes TIMESTAMP, which watermarks need."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum for each window and type; what is later than the watermark is left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drained(df: DataFrame, checkpoint: str, name: str, mode: str = "append") -> DataFrame:
    """Runs a streaming DataFrame over what is there and returns what it wrote to memory; for tests and small files."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def appended(df: DataFrame, path: str, checkpoint: str, key: str):
    """Appends a stream to a table of Parquet files, each key once within the watermark, and each batch once."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return df.dropDuplicatesWithinWatermark([key]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
