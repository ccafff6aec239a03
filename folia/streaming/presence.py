"""Presence and activity counters as streams with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def presence_stream(activity: DataFrame, late: str = LATE) -> DataFrame:
    """Actors of each quarter of an hour, counted once however often they come; late rows beyond the watermark go."""
    bucket = F.window("ts", "15 minutes")
    seen = activity.withWatermark("ts", late).select(bucket.alias("bucket"), "actor").dropDuplicates(["bucket", "actor"])
    return seen.groupBy("bucket").agg(F.count("*").alias("actors")).select(F.col("bucket.start").alias("bucket"), "actors")


def minute_rates(activity: DataFrame, late: str = LATE, most: int = 90) -> DataFrame:
    """Actors with ``most`` requests or more in a minute."""
    rates = activity.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("minute"), "actor").agg(F.count("*").alias("requests"))
    return rates.where(F.col("requests") >= most).select(F.col("minute.start").alias("minute"), "actor", "requests")


def daily_counters(activity: DataFrame, late: str = LATE) -> DataFrame:
    """Requests, last page and last time of each actor, day and feature."""
    day = F.window("ts", "1 day").alias("day")
    counted = activity.withWatermark("ts", late).groupBy(day, "actor", "feature").agg(F.count("*").alias("requests"), F.max_by("page", "ts").alias("last_page"), F.max("ts").alias("last_seen"))
    return counted.withColumn("day", F.to_date(F.col("day.start")))
