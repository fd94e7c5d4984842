"""A streaming event log: announcements as they land, each once, joined to the prices known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.session import shared_path

EVENT_SCHEMA = "event_id long, announced timestamp, code string, event_label string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).parquet(folder)


def unique_events(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Each event once; repeats later than `late` after the newest announcement are past remembering."""
    return events.withWatermark("announced", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each code, label and day."""
    windowed = events.withWatermark("announced", late).groupBy(F.window("announced", "1 day"), "code", "event_label")
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("date").alias("day"), "code", "event_label", "n")


def with_latest_price(events: DataFrame, latest: DataFrame) -> DataFrame:
    """Events with the static latest price of their code; events without one stay."""
    return events.join(latest.select("code", F.col("close").alias("latest_close")), "code", "left")


def drained(stream: DataFrame, label: str) -> DataFrame:
    """The rows that a stream gives for all that its source holds now, as a table in the shared folder.

    Groups that the watermark hasn't passed are still open and stay out, as do rows later than it. A job that is
    run again goes on from the folder's checkpoint.
    """
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, label)
    sink = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", shared_path(spark, f"{label}-state"))
    sink.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
