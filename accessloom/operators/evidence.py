"""Alerts with their evidence: one row per alert, flat or with the rows that triggered it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import utc_text
from .detectors import DETAIL, DETECTORS, SEVERITY, Found, Params

RECORD = "struct<event_type:string,user:string,device:string,app:string,resource:string,location:string,timestamp:bigint,cnt:bigint>"
SCHEMA = f"type string, severity string, user string, device string, app string, resource string, location string, timestamp long, end_timestamp long, count long, detail string, records array<{RECORD}>"
ANCHOR = ("user", "device", "app", "resource", "location")
_IDENTITY = ("user_ord", "device_ord", "app_ord", "resource_ord", "event_tag", "loc_tag", "hi_seq", "lo_seq", "lo_ts", "grp", "key")


def _placed(found: Found, names: list[str]) -> DataFrame:
    """Alerts with `_lo` and `_hi`, places in their key and group counted from the last row back, and `_from`, the time of their first evidence.

    The evidence is what lies from `_hi` + 1 to `_lo`. One sweep from the last row back passes every alert's own row and
    its lower bound, so the work is a sort, however many rows lie between.
    """
    a = found.alerts.select(F.struct(*names).alias("_a"), "key", "grp", "timestamp", "hi_seq", "lo_ts", "lo_seq")
    none = F.lit(None)
    rows = found.rows.select("key", "grp", F.col("timestamp").alias("_at"), F.col("seq").alias("_by"), F.lit(1).alias("_phase"), none.cast(a.schema["_a"].dataType).alias("_a"))
    first = F.coalesce("lo_seq", F.lit(0).cast("long"))
    # From the back an alert's own row comes after its upper mark, and a bound after the rows that it lets in.
    marks = [F.struct(F.col("timestamp").alias("_at"), F.col("hi_seq").alias("_by"), F.lit(0).alias("_phase")), F.struct(F.coalesce("lo_ts", F.lit(-1).cast("long")).alias("_at"), first.alias("_by"), F.lit(2).alias("_phase"))]
    a = a.withColumn("_m", F.explode(F.array(*marks))).select("key", "grp", "_m._at", "_m._by", "_m._phase", "_a")
    back = Window.partitionBy("key", "grp").orderBy(F.desc("_at"), F.desc("_by"), "_phase").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("_phase") == 1
    swept = rows.unionByName(a).withColumns({"_n": F.count(F.when(own, 1)).over(back), "_from": F.min(F.when(own, F.col("_at"))).over(back)}).where("_phase != 1")
    upper = F.col("_phase") == 0
    return swept.groupBy("_a").agg(F.max(F.when(~upper, F.col("_n"))).alias("_lo"), F.max(F.when(upper, F.col("_n"))).alias("_hi"), F.max(F.when(~upper, F.col("_from"))).alias("_from")).select("_a.*", "_lo", "_hi", "_from")


def _merged(log: DataFrame, kind: str, params: Params, with_records: bool) -> DataFrame:
    """Alerts with start, end and number of their evidence, and with the rows of it if asked for."""
    found = DETECTORS[kind](log, params)
    names = [*ANCHOR, "event_type", "timestamp", "cnt", "count", *_IDENTITY]
    own = F.struct("event_type", *ANCHOR, "timestamp", "cnt")
    if found.rows is None:
        return found.alerts.select(*names, F.col("timestamp").alias("start"), F.col("timestamp").alias("end"), F.lit(1).cast("long").alias("n_records"), F.array(own).alias("records"))
    placed = _placed(found, names).withColumn("n_records", F.col("_lo") - F.col("_hi"))
    place = F.explode(F.when(F.col("_lo") > F.col("_hi"), F.sequence(F.col("_hi") + 1, F.col("_lo"))))
    rows = found.rows.withColumn("_place", F.row_number().over(Window.partitionBy("key", "grp").orderBy(F.desc("timestamp"), F.desc("seq"))).cast("long"))
    placed = placed.withColumns({"start": F.least("timestamp", "_from"), "end": F.col("timestamp")})
    if not with_records:
        return placed
    # Each alert asks for its rows by their places, so the join has as many rows as the evidence.
    asked = placed.select(*placed.columns, place.alias("_place"))
    given = rows.select("key", "grp", "_place", "seq", own.alias("_row"))
    kept = [c for c in asked.columns if c != "_place"]
    grouped = asked.join(given, ["key", "grp", "_place"]).groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct("seq", "_row"))).alias("_rows"))
    return grouped.withColumn("records", F.transform("_rows", lambda x: x["_row"])).drop("_rows")


def flat_alerts(log: DataFrame, kind: str, params: Params = Params()) -> DataFrame:
    """Anchor, count, number of evidence rows and time span of each alert, without the rows."""
    rows = _merged(log, kind, params, False)
    return rows.select(*ANCHOR, "event_type", F.col("timestamp").alias("anchor_ts"), F.col("start").alias("start_ts"), F.col("end").alias("end_ts"), "count", "n_records")


def alerts(log: DataFrame, kind: str, params: Params = Params()) -> DataFrame:
    """Alerts with evidence in order (SCHEMA). An unknown kind gives none."""
    spark = log.sparkSession
    if kind not in DETECTORS:
        return spark.createDataFrame([], SCHEMA)
    rows = _merged(log, kind, params, True)
    text = F.format_string(DETAIL[kind], F.col("count").cast("string"))
    key = {"A3": "device_ord", "D11": "device_ord"}.get(kind, "user_ord")
    order = ("timestamp",) if kind in ("A4", "D10") else (key, "timestamp")
    rows = rows.orderBy(*order, "user_ord", "device_ord", "app_ord", "resource_ord", "event_tag", "loc_tag")
    records = F.transform("records", lambda x: F.struct(*[x[c].alias(c) for c in ("event_type", "user", "device", "app", "resource", "location", "timestamp", "cnt")]))
    return rows.select(F.lit(kind).alias("type"), F.lit(SEVERITY[kind]).alias("severity"), *ANCHOR, F.col("start").alias("timestamp"), F.col("end").alias("end_timestamp"), "count", text.alias("detail"), records.alias("records"))


def screen(rows: DataFrame) -> DataFrame:
    """The form shown on a screen: evidence with UTC text, without end and counts."""
    records = F.transform("records", lambda x: F.struct(x["event_type"].alias("eventType"), *[x[c].alias(c) for c in ("user", "device", "app", "resource", "location", "timestamp")], utc_text(x["timestamp"]).alias("timestampUtc")))
    return rows.select("type", "severity", "user", "device", "app", "resource", "location", "timestamp", "count", "detail", records.alias("records"))


def lines(rows: DataFrame) -> DataFrame:
    """The form written to files, one JSON object per alert."""
    records = F.transform("records", lambda x: F.struct(x["event_type"].alias("eventType"), *[x[c].alias(c) for c in ("user", "device", "app", "resource", "location", "timestamp")], utc_text(x["timestamp"]).alias("timestampUtc"), x["cnt"].alias("count")))
    form = F.struct("type", "severity", "user", "timestamp", utc_text(F.col("timestamp")).alias("timestampUtc"), F.col("end_timestamp").alias("endTimestamp"), utc_text(F.col("end_timestamp")).alias("endTimestampUtc"), "count", F.col("detail").alias("reason"), records.alias("records"))
    return rows.select(F.to_json(form).alias("value"))


def preview(log: DataFrame, kind: str, params: Params, cap: int) -> DataFrame:
    """The first `cap` alerts, each with the exact total."""
    total = flat_alerts(log, kind, params).count()
    shown = alerts(log, kind, params).limit(cap).select("type", "severity", "user", "timestamp", "count", "detail", F.size("records").alias("n_records"))
    return shown.withColumn("total", F.lit(total).cast("long"))
