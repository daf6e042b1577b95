"""HTTP front for a catalog: every route answers with JSON, problems included; only unknown paths are 404."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from .operators import lookups
from .operators.detectors import Params
from .sources.catalog import Catalog

LARGEST_INT = (1 << 31) - 1
#: The page at /: what is loaded, and forms for the lookups and detectors.
PAGE = """<!doctype html><meta charset="utf-8"><title>Access logs</title>
<h1>Access logs</h1>
<form action="/api/load-dataset"><input name="file" placeholder="file.csv"><button>load</button></form>
<form action="/api/query-user"><input name="loadedFile" placeholder="file.csv"><input name="userId" placeholder="U1"><button>journey</button></form>
<form action="/api/query-resource"><input name="loadedFile" placeholder="file.csv"><input name="resourceId" placeholder="R1"><button>accesses</button></form>
<form action="/api/query-top"><input name="loadedFile" placeholder="file.csv"><button>top resources</button></form>
<form action="/api/anomalies"><input name="loadedFile" placeholder="file.csv"><input name="type" placeholder="A1"><button>alerts</button></form>
<p><a href="/api/list-datasets">files</a> <a href="/api/list-loaded">loaded</a> <a href="/api/list-anomaly-files">alert files</a></p>
"""


def _number(value: str | None, default: int, largest: int) -> int:
    """A run of digits up to `largest`; anything else is the default."""
    digits = value.lstrip("0") or "0" if value and value.isascii() and value.isdigit() else ""
    return int(digits) if digits and len(digits) <= len(str(largest)) and int(digits) <= largest else default


def _flag(value: str | None, default: bool) -> bool:
    return value.lower() in ("1", "true", "yes", "on") if value else default


def _range(q: dict[str, str]) -> tuple[int, int]:
    return _number(q.get("startTime"), 0, lookups.LATEST), _number(q.get("endTime"), lookups.LATEST, lookups.LATEST)


def _rows(frame) -> list[dict]:
    return [r.asDict() for r in frame.toLocalIterator()]


def _renamed(rows: list[dict]) -> list[dict]:
    return [{("eventType" if k == "event_type" else k): v for k, v in r.items()} for r in rows]


def answer(catalog: Catalog, path: str, q: dict[str, str]) -> dict | None:
    """The answer of one route, None for an unknown path."""
    name = q.get("loadedFile", "")

    def looked_up(find, drop: str, layout: str = "log") -> dict:
        span = _range(q)
        if span[0] > span[1]:
            raise ValueError("the start of a time range can't lie after its end")
        log = catalog.log(name, layout) if name else None
        return {"data": [] if log is None else _renamed(_rows(find(log, *span).drop(drop)))}

    routes = {
        "/api/list-datasets": lambda: {"datasets": catalog.datasets()},
        "/api/list-loaded": lambda: {"loaded": catalog.loaded()},
        "/api/load-dataset": lambda: catalog.load(q.get("file", ""), _flag(q.get("fresh"), False), _flag(q.get("resumeCheckpoint"), True), _flag(q.get("saveCache"), True), sortMode=q.get("sortMode"), parallelCsv=q.get("parallelCsv"), checkpointRows=q.get("checkpointRows")),
        "/api/query-user": lambda: looked_up(lambda log, a, b: lookups.user_journey(log, q.get("userId", ""), a, b), "user", "by-user"),
        "/api/query-resource": lambda: looked_up(lambda log, a, b: lookups.resource_access(log, q.get("resourceId", ""), a, b), "resource", "by-resource"),
        "/api/query-top": lambda: looked_up(lookups.top_resources, "last_ts"),
        "/api/anomalies": lambda: catalog.anomalies(name, q.get("type", ""), Params.of(**{k: _number(q[k], getattr(Params(), k), LARGEST_INT) for k in Params.__dataclass_fields__ if k in q}), q.get("output") == "file"),
        "/api/list-anomaly-files": lambda: {"files": catalog.alert_files()},
        "/api/get-anomaly-file-content": lambda: catalog.alert_file(q.get("file", "")),
        "/api/stats": lambda: catalog.stats(name) if name else {},
    }
    if path == "/":
        return {"page": PAGE}
    if path not in routes:
        return None
    try:
        return {"success": True} | routes[path]()
    except Exception as problem:  # every problem is an answer
        return {"success": False, "message": str(problem).splitlines()[0] if str(problem) else type(problem).__name__}


def server(catalog: Catalog, port: int = 0) -> HTTPServer:
    """A server on localhost; port 0 picks a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            found = answer(catalog, url.path, {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()})
            page = found.get("page") if found else None
            body = (page or json.dumps({"success": False, "message": "not found"} if found is None else found)).encode()
            self.send_response(404 if found is None else 200)
            for key, value in (("Content-Type", f"{'text/html' if page else 'application/json'}; charset=utf-8"), ("Access-Control-Allow-Origin", "*"), ("Content-Length", str(len(body)))):
                self.send_header(key, value)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
