"""All registered queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import lookups
from .operators.detectors import Params
from .operators.evidence import alerts, flat_alerts, lines, preview
from .plans import oracle
from .sources.csvlog import counters, parsed
from .sources.log import COLUMNS, FIELDS, clean, events_log, raw_events

#: Parameters under which every detector finds something in the mapped events.
SETTINGS = {
    "A1": {"n": 1, "windowSec": 86400}, "A2": {"n": 3}, "A3": {"n": 2, "windowSec": 86400}, "A4": {"startHour": 8, "endHour": 18}, "A5": {}, "A6": {"n": 1},
    "A7": {"sessionSec": 43200}, "A8": {"n": 3, "windowSec": 86400}, "A9": {"n": 1}, "B1": {"n": 2}, "B2": {"n": 1, "silenceSec": 86400, "burstSec": 43200},
    "C4": {"n": 3, "minSpacingSec": 43200, "windowSec": 604800}, "D2": {"n": 1, "minGapSec": 1800}, "D8": {"minEvents": 3, "maxCvPercent": 35},
    "D10": {"windowSec": 7200, "minEvents": 3, "failureRatioPercent": 60}, "D11": {"coveragePercent": 2}, "E1": {"maxDurationSec": 86400, "n": 0},
}


def _detector(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: flat_alerts(events_log(spark, sf_dir), kind, Params.of(**SETTINGS[kind]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "q1_user_journey": lambda s, d: lookups.user_journey(events_log(s, d), "U3", 0, lookups.LATEST),
        "q2_resource_access": lambda s, d: lookups.resource_access(events_log(s, d), "R26"),
        "q3_top_resources": lambda s, d: lookups.top_resources(events_log(s, d)),
        "q4_stats": lambda s, d: lookups.stats(events_log(s, d)),
        "s8_clean_log": lambda s, d: events_log(s, d).select(*COLUMNS),
    }
    found |= {
        "s5_parsed_lines": lambda s, d: parsed(raw_events(s, d)).select("pos", "accepted", "replaced", "beyond", *FIELDS),
        "s1_ingested_log": lambda s, d: clean(parsed(raw_events(s, d)).where("accepted")).select(*FIELDS, "cnt"),
        "s5_counters": lambda s, d: (lambda rows: rows.agg(*counters(rows)))(parsed(raw_events(s, d))),
        "s17_alert_lines": lambda s, d: lines(alerts(events_log(s, d), "A8", Params.of(**SETTINGS["A8"]))),
        "s17_streak_lines": lambda s, d: lines(alerts(events_log(s, d), "A2", Params.of(**SETTINGS["A2"]))),
        "q6_preview": lambda s, d: preview(events_log(s, d), "A8", Params.of(**SETTINGS["A8"]), 25),
    }
    return found | {f"{kind.lower()}_alerts": _detector(kind) for kind in SETTINGS}


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql(SETTINGS)
