import random
from datetime import datetime, timedelta

import pytest
from model import detect
from pyspark.sql import functions as F

from accessloom.functions.values import EVENTS, LOCATIONS, ORDER, utc_text
from accessloom.operators.detectors import DETECTORS, Params
from accessloom.operators.evidence import SCHEMA, alerts, flat_alerts, lines, screen
from accessloom.sources.log import FIELDS, clean

SETS = {
    "default": {},
    "loose": dict(n=1, windowSec=20000, minGapSec=60, minEvents=2, maxCvPercent=80, failureRatioPercent=20, sessionSec=10, maxDurationSec=3000, silenceSec=2000, burstSec=5000, coveragePercent=30, startHour=18, endHour=8, minSpacingSec=500),
    "zero": dict(n=0, windowSec=0, maxCvPercent=200, minEvents=0, coveragePercent=0),
    "tight": dict(n=4, windowSec=600, minGapSec=1000, failureRatioPercent=50, startHour=9, endHour=9, coveragePercent=100),
}


def rows_of(seed, span, draws):
    r = random.Random(seed)
    users, out = r.choice([1, 5, 19]), []
    places = r.choice([(*LOCATIONS, "UNKNOWN"), ("US", "VN", "UNKNOWN")])
    for _ in range(draws):
        at = r.randrange(span) if r.random() < 0.6 else 5000 * r.randrange(max(1, span // 5000)) + r.randrange(6)
        row = (f"U{r.randrange(users + 1)}", f"D{r.randrange(5)}", f"APP{r.randrange(3)}", r.choice([*(f"R{i}" for i in range(6)), "UNKNOWN_RESOURCE"]), r.choice([*EVENTS, "UNKNOWN"]), r.choice(places), at)
        out += [row] * (1 if r.random() < 0.8 else 3)
    return out


#: Moments far out that a log may name.
FAR = (0, 10**15, (1 << 63) - 1)


@pytest.fixture(scope="module", params=[(1, 5_000, 300, False), (3, 900_000, 700, False), (5, 60_000, 250, True)])
def log(request, spark):
    """Random logs; one also has rows at the ends of time and around them."""
    made = rows_of(*request.param[:3])
    if request.param[3]:
        r = random.Random(6)
        made += [(*row[:6], min(max(at - 40 + r.randrange(80), 0), FAR[-1])) for at in FAR for row in r.choices(made, k=60)]
    rows = [(*r, i) for i, r in enumerate(made)]
    frame = clean(spark.createDataFrame(rows, ", ".join(f"{f} {'long' if f == 'timestamp' else 'string'}" for f in FIELDS) + ", pos long"))
    kept = spark.createDataFrame(frame.orderBy(*ORDER).toPandas())
    return kept.withColumns({"event_tag": F.col("event_tag").cast("byte"), "loc_tag": F.col("loc_tag").cast("byte")}).cache(), [r.asDict() for r in frame.orderBy(*ORDER).collect()]


@pytest.mark.parametrize("kind", DETECTORS)
def test_detectors_equal_the_sequential_model(log, kind):
    frame, rows = log
    found = None
    far = rows[-1]["timestamp"] > 10**9
    for given in (SETS["default"], SETS["loose"]) if far else SETS.values():
        p = Params.of(**given)
        want = sorted((r["user"], r["device"], r["app"], r["resource"], r["location"], r["event_type"], r["timestamp"], min(x["timestamp"] for x in [*e, r]), max(x["timestamp"] for x in [*e, r]), c, len(e)) for r, c, e in detect(kind, rows, p))
        got = flat_alerts(frame, kind, p).select("user", "device", "app", "resource", "location", "event_type", "anchor_ts", "start_ts", "end_ts", "count", "n_records")
        found = sorted(map(tuple, got.collect()))
        assert found == want


def test_records_and_forms(log):
    frame, rows = log
    p = Params.of(**SETS["loose"])
    got = alerts(frame, "A2", p)
    assert got.schema.simpleString() == alerts(frame, "none").schema.simpleString()
    by_anchor = {(r["timestamp"], r["user"]): e for r, _, e in detect("A2", rows, p)}
    for a in got.collect():
        assert (a.type, a.severity) == ("A2", "medium") and a.records[-1].timestamp == a.end_timestamp
        assert [x.timestamp for x in a.records] == [x["timestamp"] for x in by_anchor[a.end_timestamp, a.user]]
    assert screen(got).columns[0] == "type" and "reason" in lines(got).head()[0]
    assert SCHEMA.startswith("type") and alerts(frame, "none").count() == 0


@pytest.mark.parametrize("kind", ["A4", "B2", "C4", "D10"])
def test_records_equal_the_sequential_model(log, kind):
    frame, rows = log
    p = Params.of(**SETS["loose"])
    plain = lambda e: tuple((r["timestamp"], r["user"], r["event_type"], r["location"], r["cnt"]) for r in e)
    got = sorted((a.user, a["count"], plain([x.asDict() for x in a.records])) for a in alerts(frame, kind, p).collect())
    assert got == sorted((r["user"], c, plain(e)) for r, c, e in detect(kind, rows, p))


def test_texts_of_any_moment(log):
    frame, rows = log
    found = {x.timestamp: x.text for x in frame.select("timestamp", utc_text(F.col("timestamp")).alias("text")).distinct().collect()}
    assert {r["timestamp"] for r in rows} == set(found)
    for at, text in found.items():
        year, rest = text.split("-", 1)
        assert len(year) >= 4 and (datetime(1970, 1, 1) + timedelta(seconds=at % 12_622_780_800)).strftime("%m-%dT%H:%M:%SZ") == rest
        assert int(year) - at // 12_622_780_800 * 400 == (datetime(1970, 1, 1) + timedelta(seconds=at % 12_622_780_800)).year
    assert lines(alerts(frame, "A7", Params.of(sessionSec=10))).count() >= 0
