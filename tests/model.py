"""The detectors' rules over one key's rows in order, as plain definitions: what each alert is, not how to scan for it.

Numbers of places and clocks are written out here, so that a wrong table in the library shows.
"""

from bisect import bisect_right
from collections import defaultdict
from itertools import accumulate, groupby, pairwise
from math import atan2, ceil, cos, hypot, radians, sin

TOUCH = {"ACCESS", "DOWNLOAD", "OPEN_APP", "ADMIN_ACTION"}
# Minutes ahead of UTC; latitude and longitude; countries that share a border.
AHEAD = {"US": -300, "CA": -300, "BR": -180, "UK": 0, "DE": 60, "FR": 60, "RU": 180, "IN": 330, "VN": 420, "TH": 420, "SG": 480, "CN": 480, "JP": 540, "KR": 540, "AU": 600}
WHERE = {
    "US": (39.8283, -98.5795), "CA": (56.1304, -106.3468), "BR": (-14.2350, -51.9253), "UK": (55.3781, -3.4360), "DE": (51.1657, 10.4515),
    "FR": (46.2276, 2.2137), "RU": (61.5240, 105.3188), "IN": (20.5937, 78.9629), "VN": (14.0583, 108.2772), "TH": (15.8700, 100.9925),
    "SG": (1.3521, 103.8198), "CN": (35.8617, 104.1954), "JP": (36.2048, 138.2529), "KR": (35.9078, 127.7669), "AU": (-25.2744, 133.7751),
}
NEIGHBOURS = ("US CA", "VN CN", "CN IN", "CN RU", "DE FR")


def least_travel(a, b):
    """Seconds that a journey takes at least: 900 km an hour along the great circle and two hours besides. The angle is that of two vectors."""
    if a == b or f"{a} {b}" in NEIGHBOURS or f"{b} {a}" in NEIGHBOURS:
        return -1
    (p, q), (r, s) = (map(radians, WHERE[x]) for x in (a, b))
    u, v = ((cos(x) * cos(y), cos(x) * sin(y), sin(x)) for x, y in ((p, q), (r, s)))
    cross = hypot(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return ceil((6371 * atan2(cross, sum(x * y for x, y in zip(u, v, strict=True))) / 900 + 2) * 3600)


def detect(kind, log, p):
    """Alerts as (anchor row, count, evidence rows). `log` is in total order."""
    out = []
    keyed = defaultdict(list)
    for r in log:
        keyed[{"A3": r["device"], "D11": r["device"], "D10": r["location"]}.get(kind, r["user"])].append(r)
    total = len({r["resource"] for r in log})
    for key, rows in keyed.items():
        if kind != "D10" or key != "UNKNOWN":
            out += globals()[f"_{kind}"](rows, p, total) if kind == "D11" else globals()[f"_{kind}"](rows, p)
    return out


def _of(rows, *events):
    return [r for r in rows if r["event_type"] in events]


def _runs(rows, same):
    """Stretches of rows on which `same` has one value, as (value, rows)."""
    return [(value, list(run)) for value, run in groupby(rows, same)]


def _first_reaching(rows, totals, n):
    """The alert at the first row whose total reaches n, with the rows up to there."""
    return next(([(rows[i], t, rows[: i + 1])] for i, t in enumerate(totals) if t >= n), [])


def _within(rows, i, width):
    return [x for x in rows[: i + 1] if rows[i]["timestamp"] - x["timestamp"] <= width]


def _edges(rows, width, value, holds):
    """Alerts at the rows whose window holds what the one before doesn't."""
    windows = [_within(rows, i, width) for i in range(len(rows))]
    values = [value(w) for w in windows]
    return [(rows[i], v, windows[i]) for i, v in enumerate(values) if holds(v) and not (i and holds(values[i - 1]))]


def _count(rows):
    return sum(r["cnt"] for r in rows)


def _A1(rows, p):
    return _edges(_of(rows, "LOGIN"), p.windowSec, lambda w: len({x["device"] for x in w}), lambda c: c > p.n)


def _A3(rows, p):
    return _edges(_of(rows, *TOUCH), p.windowSec, lambda w: len({x["resource"] for x in w}), lambda c: c > p.n)


def _A8(rows, p):
    return _edges(_of(rows, "LOGIN"), p.windowSec, _count, lambda c: c >= p.n)


def _D10(rows, p):
    found = _edges(rows, p.windowSec, lambda w: (_count(_of(w, "FAILED_LOGIN")), _count(w)), lambda c: c[1] >= p.minEvents and c[0] * 100 >= c[1] * p.failureRatioPercent)
    return [(r, failed, w) for r, (failed, _), w in found]


def _streaks(rows):
    """Streaks of failures and of other events, refreshes left out."""
    return _runs([r for r in rows if r["event_type"] != "TOKEN_REFRESH"], lambda r: r["event_type"] == "FAILED_LOGIN")


def _A2(rows, p):
    return [a for failed, run in _streaks(rows) if failed for a in _first_reaching(run, accumulate(r["cnt"] for r in run), p.n)]


def _B1(rows, p):
    """Only the first row after a streak has it before itself; any other login has none."""
    out, before = [], []
    for failed, run in _streaks(rows):
        for i, r in enumerate(run if not failed else ()):
            streak = before if i == 0 else []
            if r["event_type"] == "LOGIN" and _count(streak) >= p.n:
                out.append((r, _count(streak), [*streak, r]))
        before = run
    return out


def _A4(rows, p):
    hours = [((r["timestamp"] + AHEAD.get(r["location"], 0) * 60) // 3600 % 24, r) for r in rows]
    early, late = (lambda h: h < p.startHour), (lambda h: h >= p.endHour)
    return [(r, h, [r]) for h, r in hours if (early(h) or late(h) if p.startHour <= p.endHour else early(h) and late(h))]


def _A5(rows, p):
    known = [r for r in rows if r["location"] != "UNKNOWN"]
    return [(b, b["timestamp"] - a["timestamp"], [a, b]) for a, b in pairwise(known) if b["timestamp"] - a["timestamp"] < least_travel(a["location"], b["location"])]


def _days(rows):
    return [day for _, day in _runs(rows, lambda r: r["timestamp"] // 86400)]


def _A6(rows, p):
    out = []
    for day in _days(rows):
        known = [i for i, r in enumerate(day) if r["location"] != "UNKNOWN"]
        arrivals = [j for i, j in pairwise(known) if day[i]["location"] != day[j]["location"]]
        out += [(day[j], p.n + 1, day[: j + 1]) for j in arrivals[p.n : p.n + 1]]
    return out


def _A7(rows, p):
    return [(b, b["timestamp"] - a["timestamp"], [a, b]) for a, b in pairwise(_of(rows, "LOGIN", "LOGOUT")) if (a["event_type"], b["event_type"]) == ("LOGIN", "LOGOUT") and b["timestamp"] - a["timestamp"] > p.sessionSec]


def _A9(rows, p):
    """A run of downloads counts if its session was opened by a login and has an admin action before the run."""
    rows, out, at = [r for r in rows if r["event_type"] != "TOKEN_REFRESH"], [], 0
    for download, run in _runs(rows, lambda r: r["event_type"] == "DOWNLOAD"):
        bounds = [i for i in range(at) if rows[i]["event_type"] in ("LOGIN", "LOGOUT")]
        if download and bounds and rows[bounds[-1]]["event_type"] == "LOGIN" and _of(rows[bounds[-1] : at], "ADMIN_ACTION"):
            opener = _of(rows[at - 1 : at], "ADMIN_ACTION")
            out += [(r, t, [*opener, *seen]) for r, t, seen in _first_reaching(run, accumulate(r["cnt"] for r in run), p.n)]
        at += len(run)
    return out


def _B2(rows, p):
    """From running totals: the burst's row is the first whose total passes the one before the silence by more than n."""
    totals, out = [0, *accumulate(r["cnt"] for r in rows)], []
    for i in range(1, len(rows)):
        if rows[i]["timestamp"] - rows[i - 1]["timestamp"] >= p.silenceSec:
            j = max(bisect_right(totals, totals[i] + p.n) - 1, i)
            if j < len(rows) and rows[j]["timestamp"] - rows[i]["timestamp"] <= p.burstSec:
                out.append((rows[j], totals[j + 1] - totals[i], rows[i - 1 : j + 1]))
    return out


def _C4(rows, p):
    """A failure is taken if none taken lies in its window, or the last taken one is far enough back. Its queue: those taken in its window.

    It alerts if its queue is full, unless the row before had a full one of which enough are left.
    """
    failed, taken = _of(rows, "FAILED_LOGIN"), []
    for r in failed:
        if not taken or r["timestamp"] - taken[-1]["timestamp"] > p.windowSec or r["timestamp"] - taken[-1]["timestamp"] >= p.minSpacingSec:
            taken.append(r)
    place = {id(r): i for i, r in enumerate(failed)}
    queues = [[t for t in taken if place[id(t)] <= i and r["timestamp"] - t["timestamp"] <= p.windowSec] for i, r in enumerate(failed)]
    out = []
    for i, (r, queue) in enumerate(zip(failed, queues, strict=True)):
        left = [t for t in queue if t is not r]
        if len(queue) >= p.n and not (i and len(queues[i - 1]) >= p.n and len(left) >= p.n):
            out.append((r, len(queue), queue))
    return out


def _D2(rows, p):
    """Chains are cut where a gap is wide; a row counts for all its repeats, a chain's first one less."""
    cuts = [i for i in range(len(rows)) if i == 0 or rows[i]["timestamp"] - rows[i - 1]["timestamp"] >= p.minGapSec]
    chains = [rows[a:b] for a, b in pairwise([*cuts, len(rows)])]
    return [a for chain in chains for a in _first_reaching(chain, accumulate(r["cnt"] - (r is chain[0]) for r in chain), p.n)]


def _D8(rows, p):
    out = []
    for day in _days(rows):
        gaps = [b["timestamp"] - a["timestamp"] for a, b in pairwise(day)] + [0] * sum(r["cnt"] - 1 for r in day)
        count = _count(day)
        if count >= p.minEvents and len(gaps) >= 2 and sum(gaps) > 0:
            m, s1, s2 = len(gaps), sum(gaps), sum(g * g for g in gaps)
            if (m * s2 - s1 * s1) * 10_000 <= p.maxCvPercent**2 * s1 * s1:
                out.append((day[-1], count, day))
    return out


def _D11(rows, p, total):
    """Runs of one number after the other; an id without a number is in none."""
    if total < 2:
        return []
    need = min(max(ceil(total * min(max(p.coveragePercent, 1), 100) / 100), 2), total)
    touched = _of(rows, *TOUCH)
    numbers = [int(r["resource"][1:]) if r["resource"][0] == "R" and r["resource"][1:].isdigit() else None for r in touched]
    steps = [(i, n if n is None else n - i) for i, n in enumerate(numbers)]
    runs = [[touched[i] for i, _ in run] for start, run in groupby(steps, lambda s: s[1]) if start is not None]
    return [(run[need - 1], need, run[:need]) for run in runs if len(run) >= need]


def _E1(rows, p):
    """A session goes from a login to the first logout before the next login."""
    logins = [i for i, r in enumerate(rows) if r["event_type"] == "LOGIN"]
    sessions = []
    for a, b in pairwise([*logins, len(rows)]):
        outs = [i for i in range(a, b) if rows[i]["event_type"] == "LOGOUT"]
        session = rows[a : outs[0] + 1] if outs else []
        if session and session[-1]["timestamp"] - session[0]["timestamp"] <= p.maxDurationSec and _of(session, "ACCESS", "DOWNLOAD"):
            sessions.append(session)
    found = [r for s in sessions for r in s]
    return [(found[-1], len(sessions), found)] if len(sessions) > p.n else []
