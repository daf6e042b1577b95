"""Workspaces: logs loaded once, kept as Parquet with a manifest, and found again by name.

A load writes everything into a folder of its own and the manifest last, so a failed or repeated load never leaves a
workspace half filled. All files are reached through Spark's file systems.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.values import ORDER
from ..operators import lookups
from ..operators.detectors import DETECTORS, Params
from ..operators.evidence import alerts, flat_alerts, lines, screen
from .csvlog import COUNTERS, counters, parsed, raw_lines
from .log import FIELDS, clean

PREVIEW, FILE_PREVIEW = 500, 500
#: Lines from which a file's number of rows is estimated, and what is allowed for besides.
SAMPLE, SPARE = 4096, 1.03
#: Layouts of a log, by what its files are ordered by first. Each lookup reads the one in which its rows lie together.
LAYOUTS = {"log": ("timestamp",), "by-user": ("user", *ORDER), "by-resource": ("resource", *ORDER)}
EMPTY_STATS = dict.fromkeys(("users", "devices", "apps", "resources", "records", "totalRead", "skipped", "replaced", "duplicates"), 0)


class Files:
    """The few file operations a catalog needs, on any file system Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.spark = spark

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def stamp(self, path: str) -> tuple[int, int] | None:
        """Size and time of change, None if there is no such file."""
        at = self.path(path)
        if not self.fs.exists(at):
            return None
        status = self.fs.getFileStatus(at)
        return status.getLen(), status.getModificationTime()

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def write(self, path: str, text: str) -> None:
        """Puts the text there whole: written beside it first, then renamed."""
        part = f"{path}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self.path(path), False)
        self.fs.rename(self.path(part), self.path(path))

    def read(self, path: str) -> str | None:
        if not self.fs.exists(self.path(path)):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(path).collect())


class Catalog:
    """Logs in `data` (CSV files), their loaded forms in `store`, alerts written to `store`/alerts."""

    def __init__(self, spark: SparkSession, data: str, store: str):
        self.spark, self.data, self.store = spark, data.rstrip("/"), store.rstrip("/")
        self.files = Files(spark, store)
        self.sources = Files(spark, data)

    def _named(self, name: str) -> str:
        if not name or "/" in name or "\\" in name:
            raise ValueError("a name can't hold a path")
        return name

    def datasets(self) -> list[str]:
        return [n for n in self.sources.names(self.data) if n.endswith(".csv")]

    def manifest(self, name: str) -> dict | None:
        """A workspace's manifest if it was made from the file as it is now (or the file is gone)."""
        text = self.files.read(f"{self.store}/{self._named(name)}.json")
        if text is None:
            return None
        found, now = json.loads(text), self.sources.stamp(f"{self.data}/{name}")
        return found if now is None or list(now) == found["source"] else None

    def loaded(self) -> list[str]:
        return [n[:-5] for n in self.files.names(self.store) if n.endswith(".csv.json") and self.manifest(n[:-5])]

    def estimated_rows(self, name: str) -> int:
        """Rows that a file has by its size, from the length of its first lines."""
        size = self.sources.stamp(f"{self.data}/{self._named(name)}")[0]
        lines = self.spark.read.option("lineSep", "\n").text(f"{self.data}/{name}").limit(SAMPLE).agg(F.avg(F.octet_length("value") + 1)).head()[0]
        return int(size / lines * SPARE) if lines else 0

    def _checkpoint(self, name: str, source: tuple[int, int]) -> dict | None:
        """What an unfinished load of this very file has parsed: the folder and its counters."""
        text = self.files.read(f"{self.store}/{name}.import")
        found = json.loads(text) if text else None
        return found if found and found["source"] == list(source) else None

    def _parse(self, name: str, folder: str) -> dict[str, int]:
        seen = Observation()
        rows = parsed(raw_lines(self.spark, f"{self.data}/{name}"))
        rows.observe(seen, *counters(rows)).where("accepted").select(*FIELDS, "pos").write.parquet(f"{folder}/accepted")
        return {k: seen.get[k] for k in COUNTERS}

    def load(self, name: str, fresh: bool = False, resume: bool = True, keep: bool = True, **physical) -> dict:
        """Loads a file, or takes what is loaded already unless `fresh`.

        The parsed rows are a checkpoint: a load that failed after them goes on from there if `resume`. With `keep` false
        the log is not found again by its name, as if only this answer were wanted. `physical` options (sort mode, parallel
        parsing, rows between checkpoints) change nothing here.
        """
        if not fresh and (found := self.manifest(name)):
            return found | {"fromCache": True}
        began, source = time.time(), self.sources.stamp(f"{self.data}/{self._named(name)}")
        if source is None:
            raise FileNotFoundError(name)
        before = self._checkpoint(name, source)
        resumed = bool(resume and before)
        folder = before["folder"] if resumed else f"{self.store}/{name}-{uuid.uuid4().hex}"
        counts = before["counts"] if resumed else self._parse(name, folder)
        if not resumed:
            if before:
                self.files.remove(before["folder"])
            self.files.write(f"{self.store}/{name}.import", json.dumps({"folder": folder, "source": list(source), "counts": counts}))
        parsed_at = time.time()
        cleaned = clean(self.spark.read.parquet(f"{folder}/accepted"))
        cleaned.repartitionByRange("timestamp").sortWithinPartitions("timestamp").write.mode("overwrite").parquet(f"{folder}/log")
        log = self.spark.read.parquet(f"{folder}/log")
        cleaned_at = time.time()
        for layout, order in LAYOUTS.items():
            if layout != "log":
                log.repartitionByRange(*order[:2]).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/{layout}")
        numbers = lookups.stats(log).head().asDict()
        taken = numbers.pop("accepted")
        stats = numbers | {k: counts[k] for k in ("totalRead", "skipped", "replaced")} | {"duplicates": taken - numbers["records"]}
        ms = {"parse": parsed_at - began, "clean": cleaned_at - parsed_at, "layouts": time.time() - cleaned_at}
        found = {"name": name, "log": f"{folder}/log", "source": list(source), "stats": stats, "outOfRange": counts["outOfRange"], "estimatedRows": self.estimated_rows(name), "resumed": resumed, "loadMs": int((time.time() - began) * 1000), "ms": {k: int(v * 1000) for k, v in ms.items()}}
        self.files.remove(f"{folder}/accepted")
        if not keep:
            self.files.remove(folder)
            self.files.remove(f"{self.store}/{name}.import")
            return found | {"fromCache": False}
        old = self.files.read(f"{self.store}/{name}.json")
        self.files.write(f"{self.store}/{name}.json", json.dumps(found))
        self.files.remove(f"{self.store}/{name}.import")
        if old:
            self.files.remove(json.loads(old)["log"].rpartition("/")[0])
        return found | {"fromCache": False}

    def log(self, name: str, layout: str = "log") -> DataFrame | None:
        """A loaded log, in the layout of LAYOUTS that suits what is asked of it."""
        found = self.manifest(name)
        return self.spark.read.parquet(f"{found['log'].rpartition('/')[0]}/{layout}") if found else None

    def stats(self, name: str) -> dict:
        found = self.manifest(name)
        return found["stats"] if found else dict(EMPTY_STATS)

    def anomalies(self, name: str, kind: str, params: Params = Params(), to_file: bool = False) -> dict:
        """Alerts of one kind: the exact total, the first PREVIEW of them, and the file they were all written to."""
        log = self.log(name)
        if log is None:
            return {"total": 0, "alerts": []}
        if to_file and kind in DETECTORS:
            seen, file = Observation(), f"anomaly_{kind}_{int(time.time() * 1000)}.jsonl"
            # Counted as they are written, so alerts are sought once.
            lines(alerts(log, kind, params)).observe(seen, F.count("*").alias("n")).write.text(f"{self.store}/alerts/{file}")
            return {"file": file, "total": seen.get["n"], "alerts": []}
        if to_file or kind not in DETECTORS:
            return {"total": 0, "alerts": []}
        shown = [r[0] for r in screen(alerts(log, kind, params)).limit(PREVIEW + 1).select(F.to_json(F.struct("*"))).collect()]
        # A preview that isn't full tells the total; else it is counted without the evidence.
        total = len(shown) if len(shown) <= PREVIEW else flat_alerts(log, kind, params).count()
        return {"total": total, "alerts": [json.loads(r) for r in shown[:PREVIEW]]}

    def alert_files(self) -> list[str]:
        return [n for n in self.files.names(f"{self.store}/alerts") if re.fullmatch(r"anomaly_.*\.jsonl", n)]

    def alert_file(self, name: str) -> dict:
        """The first lines of a file of alerts, and whether there are more."""
        rows = [r[0] for r in self.spark.read.text(f"{self.store}/alerts/{self._named(name)}").limit(FILE_PREVIEW + 1).collect()]
        return {"lines": rows[:FILE_PREVIEW], "truncated": len(rows) > FILE_PREVIEW}
