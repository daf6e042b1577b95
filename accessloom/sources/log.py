"""From accepted rows to the clean log: first appearances, ranks, and repeats merged with their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import EVENTS, LOCATIONS, PREFIXES, rank_of

FIELDS = ("user", "device", "app", "resource", "event_type", "location", "timestamp")
COLUMNS = (*FIELDS, "cnt", "user_ord", "device_ord", "app_ord", "resource_ord", "event_tag", "loc_tag")


def clean(accepted: DataFrame) -> DataFrame:
    """The clean log of accepted rows (FIELDS and `pos`, the place in the file).

    Ids rank by first appearance, for which the place of their first row does: no table is numbered in one task. Rows are
    read once, to be merged; the small tables of first places are made from the merged rows, of which one shuffle serves
    all. (The filter keeps every reader of it asking for the same columns.)
    """
    rows = accepted.groupBy(*FIELDS).agg(F.count("*").alias("cnt"), F.min("pos").alias("pos")).where("cnt > 0")
    merged = rows
    for kind in PREFIXES:
        merged = merged.join(rows.groupBy(kind).agg(F.min("pos").alias(f"{kind}_ord")), kind)
    return merged.withColumns({"event_tag": rank_of(F.col("event_type"), EVENTS), "loc_tag": rank_of(F.col("location"), LOCATIONS)}).select(*COLUMNS)


def dimension(log: DataFrame, kind: str) -> DataFrame:
    """(ord, name) of a kind of id, ord being its place by first appearance."""
    return log.select(F.col(f"{kind}_ord").alias("ord"), F.col(kind).alias("name")).distinct()


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table as a clean log."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return clean(mapped(events))


def mapped(events: DataFrame) -> DataFrame:
    """Accepted rows of an events table: each event becomes one row of the log."""
    e, u = F.col("event_id"), F.col("user_id")
    clicks = F.element_at(F.array(*map(F.lit, ("LOGOUT", "TOKEN_REFRESH", "OPEN_APP", "ADMIN_ACTION"))), (e % 4 + 1).cast("int"))
    named = F.create_map(*map(F.lit, ("signup", "LOGIN", "error", "FAILED_LOGIN", "view", "ACCESS", "purchase", "DOWNLOAD")))
    moved = F.when(e % 10 == 0, F.floor(e / 10)).otherwise(F.lit(0))
    return events.select(
        F.concat(F.lit("U"), u).alias("user"),
        F.concat(F.lit("D"), u * 3 + e % 3).alias("device"),
        F.concat(F.lit("APP"), e % 12).alias("app"),
        F.concat(F.lit("R"), F.get_json_object("props", "$.k")).alias("resource"),
        F.coalesce(F.try_element_at(named, F.col("event_type")), clicks).alias("event_type"),
        F.element_at(F.array(*map(F.lit, LOCATIONS)), ((u + moved) % 15 + 1).cast("int")).alias("location"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("timestamp"),
        e.alias("pos"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a raw file (`value`, `pos`) made from the events table, of which most have one fault of those that files have."""
    rows = mapped(spark.read.parquet(f"{sf_dir}/events.parquet"))
    line, at = F.concat_ws(",", *[F.col(c).cast("string") for c in FIELDS]), F.col("pos") % 16
    after = F.substr("line", F.instr("line", ","))
    faults = {
        1: F.concat("line", F.lit(",")), 2: F.replace("line", F.lit(","), F.lit(";")), 3: F.concat("line", F.lit("x")), 4: F.lower("line"), 5: F.concat(F.lit(" "), "line"),
        6: F.concat(F.lit("U18446744073709551616"), after), 7: F.concat(F.lit("U018446744073709551615"), after), 8: F.replace("line", F.lit(",APP"), F.lit(",")), 9: F.concat("line", F.lit("00000000000000")),
        10: F.concat(F.lit('"'), "line"), 11: F.lit(",,,,,,7"), 12: F.replace("line", F.lit(",R"), F.lit(",Rx")), 13: F.concat("line", F.lit(".0")),
    }
    forms = F.array(*[faults.get(n, F.col("line")) for n in range(16)])
    return rows.select("pos", line.alias("line")).select(F.get(forms, at.cast("int")).alias("value"), "pos")
