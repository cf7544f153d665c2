"""Streaming counterparts of the batch operators, over event time with watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.session import shared_dir, table

#: The time of the row that ends a stream, and the setting of the state store.
END, STORE = "2200-01-01 00:00:00", "spark.sql.streaming.stateStore.providerClass"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream of its file, or of the files of its folder.

    The path is a pattern that fits the table alone: Spark takes a plain path of a stream for a folder.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with a timestamp fit for watermarks."""
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """A row for each user's session: events until ``gap`` passes without one."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def near_pairs(left: DataFrame, right: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Inner join of two streams of a user's events within ``seconds``; both sides' state is bounded by watermarks."""
    a = left.select(F.col("user_id").alias("a_user"), F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts")).withWatermark("a_ts", late)
    b = right.select(F.col("user_id").alias("b_user"), F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts")).withWatermark("b_ts", late)
    band = F.expr(f"b_ts >= a_ts AND b_ts <= a_ts + INTERVAL {seconds} SECONDS")
    return a.join(b, (F.col("a_user") == F.col("b_user")) & band).select("a_id", "b_id")


def ended(stream: DataFrame, time_col: str = "ts") -> tuple[DataFrame, Callable[[], None]]:
    """A stream that can end: the stream and one that is empty until the function that comes with it is called. That puts
    a row there, all null but for a time after every other, and the watermark then passes whatever came before, so
    append mode gives what is open at the end, too. An endless stream needs none of it."""
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/end-{uuid.uuid4().hex}"
    one = spark.range(1).select(*[(F.lit(END) if f.name == time_col else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema])
    one.limit(0).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path)), lambda: one.write.mode("append").parquet(path)


def run_available(stream: DataFrame, end: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what is there now, in append mode, and return its output, written as Parquet in the shared folder.

    With ``end`` (of ``ended``) the stream is ended afterwards, and goes on from its checkpoint to give what was open.
    """
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    held = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for before in (None, end) if end else (None,):
            if before:
                before()
            writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows")
            writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, held) if held else spark.conf.unset(STORE)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
