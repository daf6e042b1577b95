"""The seventeen detectors, each a plan over the clean log.

A detector gives its alerts (the anchor row's columns, `key`, `count`, and the bounds of its evidence) and the rows
that can be evidence (with the same key and `grp`). `alerts` in evidence.py puts the two together. Rows are those of
one key (user, device or location) in the log's total order; `seq` is a row's position in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import local_hour, travel
from ..functions.values import known_location, resource_key, touches, utc_day, whole
from ..functions.windows import by_seq, crossing, island, sliding, upto, with_seq


@dataclass(frozen=True)
class Params:
    """Tunables of all detectors, with their defaults."""

    n: int = 3
    windowSec: int = 3600
    minGapSec: int = 2
    minSpacingSec: int = 43200
    minEvents: int = 6
    maxCvPercent: int = 10
    failureRatioPercent: int = 90
    startHour: int = 8
    endHour: int = 18
    sessionSec: int = 43200
    maxDurationSec: int = 5
    silenceSec: int = 86400
    burstSec: int = 3600
    coveragePercent: int = 80

    @classmethod
    def of(cls, **given) -> Params:
        known = {f.name for f in fields(cls)}
        return cls(**{k: int(v) for k, v in given.items() if k in known and v is not None})


#: Seconds of a slice of a location's time, if four windows aren't longer.
SLICE = 21_600


@dataclass(frozen=True)
class Found:
    """Alerts, with the bounds of their evidence, and the rows that can be evidence.

    An alert's evidence is the rows of its key and group from (lo_ts, lo_seq) on, as far as these are given, up to its own seq.
    """

    alerts: DataFrame
    rows: DataFrame | None


SEVERITY = {
    "A1": "high", "A2": "medium", "A3": "high", "A4": "low", "A5": "critical", "A6": "medium", "A7": "medium", "A8": "medium", "A9": "critical",
    "B1": "critical", "B2": "high", "C4": "high", "D2": "high", "D8": "medium", "D10": "critical", "D11": "critical", "E1": "high",
}

def _none() -> Column:
    return F.lit(None).cast("long")


def _is(*events: str) -> Column:
    return F.col("event_type").isin(*events)


def _at_least(count: Column, n: int) -> Column:
    return count >= n


def _above(count: Column, n: int) -> Column:
    return count > n


def _keyed(rows: DataFrame, key: str, grp: Column | None = None) -> DataFrame:
    return rows.withColumn("key", F.col(key)).withColumn("grp", F.lit(0).cast("long") if grp is None else grp.cast("long"))


def _bounded(rows: DataFrame, count: Column, lo_seq: Column | None = None, lo_ts: Column | None = None) -> DataFrame:
    return rows.withColumn("count", count.cast("long")).withColumn("lo_seq", _none() if lo_seq is None else lo_seq).withColumn("lo_ts", _none() if lo_ts is None else lo_ts).withColumn("hi_seq", F.col("seq"))


def _many_distinct(recs: DataFrame, key: str, value: str, which: Column, p: Params) -> Found:
    rows = _keyed(with_seq(recs, key).where(which), key)
    counted = sliding(rows, key, p.windowSec, {}, {"_n": value})
    counted = counted.withColumn("_hit", crossing(_above(F.col("_n"), p.n), by_seq(key)))
    return Found(_bounded(counted.where("_hit"), F.col("_n"), lo_ts=F.col("timestamp") - p.windowSec), rows)


def many_devices(recs: DataFrame, p: Params) -> Found:
    return _many_distinct(recs, "user", "device", _is("LOGIN"), p)


def many_resources(recs: DataFrame, p: Params) -> Found:
    return _many_distinct(recs, "device", "resource", touches(), p)


def _streaks(recs: DataFrame) -> DataFrame:
    """Rows with the streak of failed logins they are in (`isle`) and its failures so far (`run`)."""
    rows = with_seq(recs, "user").withColumn("isle", island("user", ~_is("FAILED_LOGIN", "TOKEN_REFRESH")))
    return rows.withColumn("_w", F.when(_is("FAILED_LOGIN"), F.col("cnt")).otherwise(0)).withColumn("run", F.sum("_w").over(upto(by_seq("user", "isle"))))


def failed_streak(recs: DataFrame, p: Params) -> Found:
    rows = _keyed(_streaks(recs), "user", F.col("isle")).where(_is("FAILED_LOGIN"))
    hit = rows.withColumn("_hit", crossing(_at_least(F.col("run"), p.n), by_seq("user", "isle"))).where("_hit")
    return Found(_bounded(hit, F.col("run")), rows)


def brute_force(recs: DataFrame, p: Params) -> Found:
    """At a login, the streak before it: the login opens the next one, whose previous row holds the total."""
    rows = _streaks(recs).withColumn("_before", F.coalesce(F.lag("run").over(by_seq("user")), F.lit(0)))
    rows = _keyed(rows.where(_is("FAILED_LOGIN", "LOGIN")), "user", F.col("isle") - F.when(_is("LOGIN"), 1).otherwise(0))
    hit = rows.where(_is("LOGIN") & _at_least(F.col("_before"), p.n))
    return Found(_bounded(hit, F.col("_before")), rows.where(_is("FAILED_LOGIN")).unionByName(hit))


def off_hours(recs: DataFrame, p: Params) -> Found:
    """Every row outside the working hours of its location; no window, so rows stay where they are."""
    hour = local_hour(F.col("timestamp"), F.col("location"))
    outside = (hour < p.startHour) | (hour >= p.endHour) if p.startHour <= p.endHour else (hour < p.startHour) & (hour >= p.endHour)
    rows = recs.where(outside).withColumn("seq", _none())
    return Found(_bounded(_keyed(rows, "user"), hour), None)


def impossible_travel(recs: DataFrame, p: Params) -> Found:
    rows = _keyed(with_seq(recs, "user").where(known_location()), "user")
    w = by_seq("user")
    rows = rows.withColumn("origin", F.lag("location").over(w)).withColumn("_ts", F.lag("timestamp").over(w)).withColumn("_seq", F.lag("seq").over(w))
    hit = rows.join(F.broadcast(travel(recs.sparkSession)), ["origin", "location"]).where(F.col("timestamp") - F.col("_ts") < F.col("least_sec"))
    return Found(_bounded(hit, F.col("timestamp") - F.col("_ts"), lo_seq=F.col("_seq"), lo_ts=F.col("_ts")), rows)


def location_flapping(recs: DataFrame, p: Params) -> Found:
    rows = _keyed(with_seq(recs, "user"), "user", utc_day(F.col("timestamp")))
    w = by_seq("user", "grp")
    known = rows.where(known_location()).withColumn("_from", F.lag("location").over(w)).withColumn("_moved", F.coalesce(F.col("_from") != F.col("location"), F.lit(False)))
    moves = known.withColumn("_n", F.sum(F.col("_moved").cast("long")).over(upto(w)))
    hit = moves.where(F.col("_moved") & (F.col("_n") == max(p.n, 0) + 1))
    return Found(_bounded(hit, F.col("_n")), rows)


def long_session(recs: DataFrame, p: Params) -> Found:
    rows = _keyed(with_seq(recs, "user").where(_is("LOGIN", "LOGOUT")), "user")
    w = by_seq("user")
    rows = rows.withColumn("_event", F.lag("event_type").over(w)).withColumn("_ts", F.lag("timestamp").over(w)).withColumn("_seq", F.lag("seq").over(w))
    lasted = F.col("timestamp") - F.col("_ts")
    return Found(_bounded(rows.where(_is("LOGOUT") & (F.col("_event") == "LOGIN") & (lasted > p.sessionSec)), lasted, lo_seq=F.col("_seq"), lo_ts=F.col("_ts")), rows)


def login_burst(recs: DataFrame, p: Params) -> Found:
    rows = _keyed(with_seq(recs, "user").where(_is("LOGIN")), "user")
    counted = sliding(rows, "user", p.windowSec, {"_n": F.col("cnt")})
    hit = counted.withColumn("_hit", crossing(_at_least(F.col("_n"), p.n), by_seq("user"))).where("_hit")
    return Found(_bounded(hit, F.col("_n"), lo_ts=F.col("timestamp") - p.windowSec), rows)


def admin_downloads(recs: DataFrame, p: Params) -> Found:
    """Runs of downloads in a session after an admin action; the run's evidence holds that action if it opened the run."""
    rows = with_seq(recs, "user").withColumn("_part", island("user", _is("LOGIN", "LOGOUT")))
    in_part = upto(by_seq("user", "_part"))
    opened = F.first(_is("LOGIN")).over(in_part)
    after = F.sum(_is("ADMIN_ACTION").cast("long")).over(in_part) > 0
    rows = rows.withColumn("_counts", opened & after).withColumn("isle", island("user", ~_is("DOWNLOAD", "TOKEN_REFRESH")))
    rows = _keyed(rows, "user", F.col("isle")).where(F.col("_counts") & _is("DOWNLOAD", "ADMIN_ACTION"))
    runs = rows.where(_is("DOWNLOAD"))
    runs = runs.withColumn("_n", F.sum("cnt").over(upto(by_seq("user", "grp"))))
    hit = runs.withColumn("_hit", crossing(_at_least(F.col("_n"), p.n), by_seq("user", "grp"))).where("_hit")
    return Found(_bounded(hit, F.col("_n")), rows)


def silence_burst(recs: DataFrame, p: Params) -> Found:
    """Each row after a silence opens a count of the rows of its next burstSec.

    The first row to pass n is the first whose running total passes by more than n the total before the silence. Totals ascend, so
    in one sweep from the last row back, what precedes a silence's mark in the order of totals is that row.
    """
    rows = _keyed(with_seq(recs, "user"), "user")
    w = by_seq("user")
    rows = rows.withColumn("_all", F.sum("cnt").over(upto(w)))
    gaps = rows.withColumn("_ts", F.lag("timestamp").over(w)).where(F.col("timestamp") - F.col("_ts") >= p.silenceSec)
    none, place = F.lit(None), F.struct("seq", "timestamp", "_all")
    own = rows.select("key", F.col("_all").alias("_at"), F.lit(0).alias("_mark"), place.alias("_row"), none.cast("struct<seq:bigint,timestamp:bigint,_all:bigint,_ts:bigint>").alias("_gap"))
    mark = F.col("_all") - F.col("cnt") + (max(p.n, 0) + 1)
    marks = gaps.select("key", mark.alias("_at"), F.lit(1).alias("_mark"), none.cast("struct<seq:bigint,timestamp:bigint,_all:bigint>").alias("_row"), F.struct("seq", "timestamp", (F.col("_all") - F.col("cnt")).alias("_all"), "_ts").alias("_gap"))
    back = Window.partitionBy("key").orderBy(F.desc("_at"), "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = own.unionAll(marks).withColumn("_found", F.last("_row", ignorenulls=True).over(back)).where("_mark = 1")
    met = met.where(F.col("_found.timestamp") - F.col("_gap.timestamp") <= p.burstSec)
    met = met.select("key", F.col("_found.seq").alias("seq"), F.col("_gap.seq").alias("_seq"), F.col("_gap._all").alias("_base"), F.col("_gap._ts").alias("_from"))
    hit = rows.join(met, ["key", "seq"])
    return Found(_bounded(hit, F.col("_all") - F.col("_base"), lo_seq=F.col("_seq") - 1, lo_ts=F.col("_from")), rows)


def _spaced(gap: int) -> Callable[[Iterator], Iterator]:
    """Marks rows (key, seq, timestamp), sorted, that lie at least `gap` after the last marked one of their key. Holds one key's last mark, not its rows."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, last = None, None
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            numbers, times, taken = codes.indices.to_numpy(), batch.column(2).to_numpy(), np.zeros(batch.num_rows, bool)
            starts = np.flatnonzero(np.diff(numbers, prepend=-1))
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                name = codes.dictionary[int(numbers[start])].as_py()
                at = start if name != key else start + np.searchsorted(times[start:end] - last, gap)
                key = name
                while at < end:
                    taken[at], last = True, times[at]
                    at += np.searchsorted(times[at:end] - last, max(gap, 0)) if gap > 0 else 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(taken)], names=["key", "seq", "taken"])

    return run


def slow_brute_force(recs: DataFrame, p: Params) -> Found:
    """A queue of spaced failures: one is taken if the last taken one is far enough back, or out of the window so that the queue is empty.

    Which are taken depends on the one taken before, which no window can say, so that is marked in a pass over the sorted rows. The
    queue is what is taken in a row's window. It alerts when full, unless it was full at the row before and enough of it
    is left. Only a taken row can make it full.
    """
    rows = _keyed(with_seq(recs, "user").where(_is("FAILED_LOGIN")), "user")
    narrow = rows.select("key", "seq", "timestamp").repartition("key").sortWithinPartitions("key", "seq")
    taken = narrow.mapInArrow(_spaced(min(p.minSpacingSec, p.windowSec + 1)), "key string, seq long, taken boolean")
    rows = rows.join(taken, ["key", "seq"])
    counted = sliding(rows, "key", p.windowSec, {"_n": F.col("taken").cast("long")})
    before = F.lag("_n").over(by_seq("key"))
    left = F.col("_n") - F.col("taken").cast("long")
    hit = counted.withColumn("_hit", (F.col("_n") >= p.n) & ~F.coalesce((before >= p.n) & (left >= p.n), F.lit(False))).where("_hit")
    return Found(_bounded(hit, F.col("_n"), lo_ts=F.col("timestamp") - p.windowSec), rows.where("taken"))


def machine_speed(recs: DataFrame, p: Params) -> Found:
    rows = with_seq(recs, "user")
    slow = ~F.coalesce(F.col("timestamp") - F.lag("timestamp").over(by_seq("user")) < p.minGapSec, F.lit(False))
    rows = rows.withColumn("_slow", slow).withColumn("isle", island("user", F.col("_slow")))
    rows = _keyed(rows, "user", F.col("isle")).withColumn("_n", F.sum(F.col("cnt") - F.col("_slow").cast("long")).over(upto(by_seq("user", "isle"))))
    hit = rows.withColumn("_hit", crossing(_at_least(F.col("_n"), p.n), by_seq("user", "isle"))).where("_hit")
    return Found(_bounded(hit, F.col("_n")), rows)


def robot_timing(recs: DataFrame, p: Params) -> Found:
    """Days of even gaps: population CV within the limit, tested on exact whole-number sums."""
    rows = _keyed(with_seq(recs, "user"), "user", utc_day(F.col("timestamp")))
    gap = (F.col("timestamp") - F.lag("timestamp").over(by_seq("user", "grp"))).cast("decimal(19,0)")
    gaps = rows.withColumn("_gap", gap)
    big = lambda c: c.cast("decimal(38,0)")
    days = gaps.groupBy("key", "grp").agg(F.sum("cnt").alias("_n"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("_s1"), F.coalesce(F.sum(big(F.col("_gap") * F.col("_gap"))), F.lit(0)).alias("_s2"), F.max("seq").alias("seq"))
    m, s1, s2 = big(F.col("_n") - 1), big(F.col("_s1")), big(F.col("_s2"))
    even = big(big(m * s2) - big(s1 * s1)) * 10_000 <= big(F.lit(p.maxCvPercent**2)) * big(s1 * s1)
    days = days.where((F.col("_n") >= p.minEvents) & (m >= 2) & (s1 > 0) & even).select("key", "grp", "seq", "_n")
    hit = rows.join(days, ["key", "grp", "seq"])
    return Found(_bounded(hit, F.col("_n")), rows)


def failing_location(recs: DataFrame, p: Params) -> Found:
    """Locations are few, so each is cut into slices of time, which are worked on apart.

    A slice also has the rows of the one before that its windows reach; these only count, and whether the row before
    a slice's first one was bad comes from that row's own slice.
    """
    size = max(4 * (p.windowSec + 1), SLICE)
    inside = F.pmod("timestamp", F.lit(size))
    known = recs.where(known_location()).withColumn("_slice", whole(F.col("timestamp"), F.lit(size)))
    copies = F.when(inside >= size - p.windowSec, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = known.withColumn("_copy", F.explode(copies)).withColumn("_slice", F.col("_slice") + F.col("_copy")).withColumn("key", F.concat_ws(":", "location", "_slice"))
    rows = _keyed(with_seq(rows, "key"), "key")
    failed = F.when(_is("FAILED_LOGIN"), F.col("cnt")).otherwise(0)
    counted = sliding(rows, "key", p.windowSec, {"_total": F.col("cnt"), "_failed": failed}).where("_copy = 0")
    counted = counted.withColumn("_bad", (F.col("_total") >= p.minEvents) & (F.col("_failed") * 100 >= F.col("_total") * p.failureRatioPercent))
    counted = counted.withColumn("_before", F.lag("_bad").over(by_seq("key")))
    ends = counted.groupBy("location", "_slice").agg(F.max_by("_bad", "seq").alias("_ended"))
    ends = ends.withColumn("_ended", F.lag("_ended").over(Window.partitionBy("location").orderBy("_slice")))
    counted = counted.where("_bad AND NOT coalesce(_before, false)").join(ends, ["location", "_slice"])
    hit = counted.where(~F.coalesce("_before", "_ended", F.lit(False)))
    return Found(_bounded(hit, F.col("_failed"), lo_ts=F.col("timestamp") - p.windowSec), rows)


def sequential_scan(recs: DataFrame, p: Params) -> Found:
    """Runs of consecutive resource numbers as long as a share of all resources."""
    percent = min(max(p.coveragePercent, 1), 100)
    total = recs.agg(F.countDistinct("resource").alias("_t"))
    total = total.withColumn("_need", F.least(F.greatest(F.ceil(F.col("_t") * percent / 100), F.lit(2)), F.col("_t"))).where("_t >= 2")
    rows = with_seq(recs.where(touches()), "device").withColumn("_number", resource_key(F.col("resource")))
    goes_on = F.coalesce(F.col("_number") == F.lag("_number").over(by_seq("device")) + 1, F.lit(False))
    rows = _keyed(rows.withColumn("isle", island("device", ~goes_on)), "device", F.col("isle"))
    rows = rows.withColumn("_n", F.row_number().over(by_seq("device", "isle")).cast("long")).where(F.col("_number").isNotNull())
    hit = rows.join(F.broadcast(total), F.col("_n") == F.col("_need"))
    return Found(_bounded(hit, F.col("_n")), rows)


def micro_sessions(recs: DataFrame, p: Params) -> Found:
    """Short sessions with activity: from a login to the first logout before the next login. A session has one login row."""
    rows = with_seq(recs, "user").withColumn("_part", island("user", _is("LOGIN"))).where("_part > 0")
    part = by_seq("user", "_part")
    rows = rows.withColumn("_outs", F.coalesce(F.sum(_is("LOGOUT").cast("long")).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_outs = 0")
    session, user = Window.partitionBy("user", "_part"), Window.partitionBy("user")
    rows = rows.withColumns({"_a": F.min("timestamp").over(session), "_b": F.max(F.when(_is("LOGOUT"), F.col("timestamp"))).over(session), "_active": F.max(_is("ACCESS", "DOWNLOAD")).over(session)})
    rows = _keyed(rows.where(F.col("_active") & (F.col("_b") - F.col("_a") <= p.maxDurationSec)), "user")
    rows = rows.withColumns({"_n": F.sum(_is("LOGIN").cast("long")).over(user), "_last": F.max("seq").over(user)})
    return Found(_bounded(rows.where(_above(F.col("_n"), p.n) & (F.col("seq") == F.col("_last"))), F.col("_n")), rows)


DETECTORS: dict[str, Callable[[DataFrame, Params], Found]] = {
    "A1": many_devices, "A2": failed_streak, "A3": many_resources, "A4": off_hours, "A5": impossible_travel, "A6": location_flapping,
    "A7": long_session, "A8": login_burst, "A9": admin_downloads, "B1": brute_force, "B2": silence_burst, "C4": slow_brute_force,
    "D2": machine_speed, "D8": robot_timing, "D10": failing_location, "D11": sequential_scan, "E1": micro_sessions,
}

DETAIL = {
    "A1": "logged in from %s devices within the window", "A2": "%s failed logins in a row", "A3": "touched %s resources within the window", "A4": "active at local hour %s",
    "A5": "moved between distant locations in %s seconds", "A6": "changed location %s times in a day", "A7": "session of %s seconds", "A8": "%s logins within the window",
    "A9": "%s downloads in a row after an admin action", "B1": "login after %s failures in a row", "B2": "%s events in a burst after silence", "C4": "%s spaced failed logins",
    "D2": "%s gaps at machine speed", "D8": "%s evenly timed events in a day", "D10": "%s failed events at one location", "D11": "%s resources in sequence", "E1": "%s very short sessions",
}
