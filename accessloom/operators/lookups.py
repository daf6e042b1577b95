"""Lookups over the clean log: journeys, access histories, top resources, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import ORDER, touches

LATEST = (1 << 63) - 1
TOP = 10


def within(log: DataFrame, start: int = 0, end: int = LATEST) -> DataFrame:
    """Rows of a time range, both ends included."""
    if start > end:
        raise ValueError("the start of a time range can't lie after its end")
    return log.where(F.col("timestamp").between(start, end))


def user_journey(log: DataFrame, user: str, start: int = 0, end: int = LATEST) -> DataFrame:
    rows = within(log.where(F.col("user") == user), start, end).orderBy(*ORDER)
    return rows.select("timestamp", "user", "device", "app", "resource", "event_type", "location", F.col("cnt").alias("count"))


def resource_access(log: DataFrame, resource: str, start: int = 0, end: int = LATEST) -> DataFrame:
    rows = within(log.where(F.col("resource") == resource), start, end).orderBy(*ORDER)
    return rows.select("timestamp", "user", "device", "app", "resource", "event_type", "location", F.col("cnt").alias("count"))


def top_resources(log: DataFrame, start: int = 0, end: int = LATEST, k: int = TOP) -> DataFrame:
    """The most touched resources; ties go to the later last touch, then to the earlier first appearance."""
    sums = within(log, start, end).where(touches()).groupBy("resource", "resource_ord").agg(F.sum("cnt").alias("count"), F.max("timestamp").alias("last_ts"))
    return sums.orderBy(F.desc("count"), F.desc("last_ts"), "resource_ord").limit(k).select("resource", "count", "last_ts")


def stats(log: DataFrame) -> DataFrame:
    """Numbers of distinct ids and of records."""
    return log.agg(*[F.countDistinct(c).alias(f"{c}s") for c in ("user", "device", "app", "resource")], F.count("*").alias("records"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("accepted"))
