import json
import threading
import urllib.request

import pytest

from accessloom import http
from accessloom.functions import geo
from accessloom.operators import lookups
from accessloom.operators.detectors import Params
from accessloom.sources.catalog import Catalog
from accessloom.sources.csvlog import parsed, raw_lines

GOOD = "U1,D1,APP1,R1,LOGIN,US,5"
LINES = [
    "user_id,device_id,app_id,resource_id,event_type,location,timestamp", GOOD, GOOD, GOOD + "\r", "", "\r", "U1,D1,APP1,R1,LOGIN,US", GOOD + ",", "U1,D1,APP1,R1,LOGIN,US,-5", "U1,D1,APP1,R1,LOGIN,US,5.0",
    "U1,D1,APP1,R1,LOGIN,US, 5", "u1,D1,APP1,R1,LOGIN,US,", "u1,D1,APP1,R1,LOGIN,US,6", "U,D1x,APP1,R1,LOGIN,US,6", "U18446744073709551616,D1,APP1,R1,LOGIN,US,7", "U18446744073709551615,D1,APP1,R1,LOGIN,US,7",
    "U01,D1,APP1,R1,LOGIN,US,8", "U1,D1,APP1,R1,login,XX,9", '"U1",D1,APP1,R1,LOGIN,US,10', "U1,D1,APP1,R1,LOGIN,US,18446744073709551615", "U1,D1,APP1,R1,LOGOUT,VN,11",
]


@pytest.fixture
def catalog(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.csv").write_bytes("\n".join(LINES).encode())
    (tmp_path / "data" / "b.csv").write_bytes(b"header\n")
    (tmp_path / "data" / "c.txt").write_bytes(b"")
    return Catalog(spark, str(tmp_path / "data"), str(tmp_path / "store"))


def test_cleaning(spark, catalog):
    rows = parsed(raw_lines(spark, f"{catalog.data}/a.csv")).orderBy("pos").collect()
    kept = [r for r in rows if r.accepted]
    assert (len(rows), len(kept), sum(r.replaced for r in kept), sum(r.beyond for r in rows)) == (18, 11, 5, 1)
    assert [r.user for r in kept] == ["U1", "U1", "U1", "UNKNOWN_USER", "UNKNOWN_USER", "UNKNOWN_USER", "U18446744073709551615", "U01", "U1", "UNKNOWN_USER", "U1"]
    assert (kept[4].device, kept[8].event_type, kept[8].location) == ("UNKNOWN_DEVICE", "UNKNOWN", "UNKNOWN")


def test_places_in_many_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("h\n" + "".join(f"line {i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = raw_lines(spark, str(tmp_path / "big.csv"))
        assert rows.rdd.getNumPartitions() > 5
        assert [r.value for r in rows.orderBy("pos").collect()] == [f"line {i}" for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_catalog(catalog, tmp_path):
    assert catalog.datasets() == ["a.csv", "b.csv"] and catalog.loaded() == []
    assert set(catalog.stats("a.csv").values()) == {0} and catalog.log("a.csv") is None
    first = catalog.load("a.csv", sortMode="radix")
    assert first["stats"] == {"users": 4, "devices": 2, "apps": 1, "resources": 1, "records": 9, "totalRead": 18, "skipped": 7, "replaced": 5, "duplicates": 2}
    assert first["outOfRange"] == 1 and not first["fromCache"] and catalog.load("a.csv")["fromCache"] and catalog.loaded() == ["a.csv"]
    journey = lookups.user_journey(catalog.log("a.csv"), "U1").collect()
    assert [(r.timestamp, r["count"]) for r in journey] == [(5, 3), (9, 1), (11, 1)]
    assert [r.timestamp for r in lookups.resource_access(catalog.log("a.csv"), "R1", 6, 7).collect()] == [6, 6, 7, 7]
    assert lookups.top_resources(catalog.log("a.csv")).count() == 0
    with pytest.raises(ValueError, match="range"):
        lookups.within(catalog.log("a.csv"), 2, 1)
    shown = catalog.anomalies("a.csv", "A8", Params.of(n=3))
    assert shown["total"] == 2 and shown["alerts"][0]["records"][0]["timestampUtc"] == "1970-01-01T00:00:05Z"
    written = catalog.anomalies("a.csv", "A8", Params.of(n=3), to_file=True)
    assert catalog.alert_files() == [written["file"]]
    line = json.loads(catalog.alert_file(written["file"])["lines"][0])
    assert line["records"][0]["count"] == 3 and line["endTimestampUtc"] == "1970-01-01T00:00:05Z"
    assert catalog.anomalies("a.csv", "none")["total"] == 0
    with pytest.raises(ValueError, match="path"):
        catalog.alert_file("../a.csv.json")
    by_user, by_resource = (catalog.log("a.csv", layout) for layout in ("by-user", "by-resource"))
    assert by_user.count() == by_resource.count() == 9 and [(r.timestamp, r["count"]) for r in lookups.user_journey(by_user, "U1").collect()] == [(5, 3), (9, 1), (11, 1)]
    (tmp_path / "data" / "a.csv").write_text("h\n" + GOOD)
    assert catalog.loaded() == [] and catalog.load("a.csv")["stats"]["records"] == 1
    assert catalog.load("b.csv")["stats"]["records"] == 0


def test_loads_resume_after_the_parsed_rows(catalog, monkeypatch):
    """A load that fails after its checkpoint goes on from there; one that failed before, or of a file changed since, starts over."""
    parse, calls = Catalog._parse, []
    monkeypatch.setattr(Catalog, "_parse", lambda self, *a: calls.append(a) or parse(self, *a))
    monkeypatch.setattr("accessloom.sources.catalog.clean", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        catalog.load("a.csv")
    assert catalog.loaded() == [] and catalog.manifest("a.csv") is None
    monkeypatch.undo()
    monkeypatch.setattr(Catalog, "_parse", lambda self, *a: calls.append(a) or parse(self, *a))
    found = catalog.load("a.csv")
    assert len(calls) == 1 and found["resumed"] and found["stats"]["records"] == 9 and found["stats"]["totalRead"] == 18
    assert 0 < found["estimatedRows"] < 40 and set(found["ms"]) == {"parse", "clean", "layouts"}
    again = catalog.load("a.csv", fresh=True)
    assert len(calls) == 2 and not again["resumed"] and again["stats"] == found["stats"]
    assert catalog.load("b.csv", keep=False)["stats"]["records"] == 0 and catalog.loaded() == ["a.csv"]
    left = catalog.files.names(catalog.store)
    assert sum(n.startswith("a.csv-") for n in left) == 1 and not any(n.startswith("b.csv") or n.endswith(".import") for n in left)


def test_http(catalog):
    run = http.server(catalog)
    threading.Thread(target=run.serve_forever, daemon=True).start()
    ask = lambda path: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{run.server_port}{path}").read())
    try:
        assert "<form" in urllib.request.urlopen(f"http://127.0.0.1:{run.server_port}/").read().decode()
        assert ask(f"/api/query-user?loadedFile=a.csv&userId=U1&startTime={'9' * 5000}")["success"]
        assert ask("/api/load-dataset?file=a.csv&sortMode=radix&saveCache=1&resumeCheckpoint=0&parallelCsv=1&checkpointRows=9")["success"] and not ask("/api/load-dataset?file=x.csv")["success"]
        assert [r["timestamp"] for r in ask("/api/query-user?loadedFile=a.csv&userId=U1&startTime=6")["data"]] == [9, 11]
        assert ask("/api/query-user?loadedFile=none.csv&userId=U1") == {"success": True, "data": []}
        assert not ask("/api/query-top?loadedFile=a.csv&startTime=3&endTime=2")["success"]
        assert ask("/api/stats?loadedFile=a.csv")["totalRead"] == 18
        assert ask("/api/anomalies?loadedFile=a.csv&type=A8&n=bad")["total"] == 2
        with pytest.raises(urllib.error.HTTPError, match="404"):
            ask("/other")
    finally:
        run.shutdown()


def test_travel_times():
    table = geo.least_seconds()
    assert len(table) == 15 * 14 - 10 and ("US", "CA") not in table and table["US", "VN"] == table["VN", "US"]
    assert abs(geo.distance_km("DE", "FR") - 815) < 15
