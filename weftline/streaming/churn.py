"""Structured Streaming variants: windowed churn, deduplicated events, running co-change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def churn(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Events per window and type; a window is final once the watermark has passed it."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "1 day", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user that end after a pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def cochange(commits: DataFrame, late: str = "1 day", most: int = 30) -> DataFrame:
    """Pairs of files of each commit as soon as its window is final: ``commit_id, path, ts``."""
    groups = commits.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "commit_id").agg(F.sort_array(F.collect_set("path")).alias("m")).filter(F.size("m").between(2, most))
    first = groups.select("commit_id", "m", F.posexplode("m").alias("i", "src"))
    return first.select("commit_id", "src", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("dst"))
