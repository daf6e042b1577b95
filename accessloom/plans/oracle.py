"""DuckDB SQL of the registered queries, written from the rules and not from the Spark plans.

Sliding windows are self-joins here, and slow brute force a recursive query, where the Spark side sweeps and folds.
"""

from __future__ import annotations

from ..functions.values import EVENTS, LOCATIONS
from ..operators.detectors import Params

_TAGS = lambda column, values: f"coalesce(list_position({list(values)}, {column}), {len(values) + 1})"
ORDER = "ts, usr_ord, dev_ord, app_ord, res_ord, ev_tag, loc_tag"

LOG = f"""
m AS (SELECT event_id AS pos, 'U' || user_id AS usr, 'D' || (user_id * 3 + event_id % 3) AS dev, 'APP' || (event_id % 12) AS app, 'R' || json_extract_string(props, '$.k') AS res,
  CASE event_type WHEN 'signup' THEN 'LOGIN' WHEN 'error' THEN 'FAILED_LOGIN' WHEN 'view' THEN 'ACCESS' WHEN 'purchase' THEN 'DOWNLOAD'
    ELSE ['LOGOUT', 'TOKEN_REFRESH', 'OPEN_APP', 'ADMIN_ACTION'][event_id % 4 + 1] END AS ev,
  {list(LOCATIONS)}[(user_id + CASE WHEN event_id % 10 = 0 THEN event_id // 10 ELSE 0 END) % 15 + 1] AS loc, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
g AS (SELECT usr, dev, app, res, ev, loc, ts, count(*) AS cnt FROM m GROUP BY ALL),
log AS (SELECT g.*, uo.o AS usr_ord, dd.o AS dev_ord, ao.o AS app_ord, ro.o AS res_ord, {_TAGS("ev", EVENTS)} - 1 AS ev_tag, {_TAGS("loc", LOCATIONS)} - 1 AS loc_tag FROM g
  JOIN (SELECT usr, min(pos) AS o FROM m GROUP BY usr) uo USING (usr) JOIN (SELECT dev, min(pos) AS o FROM m GROUP BY dev) dd USING (dev)
  JOIN (SELECT app, min(pos) AS o FROM m GROUP BY app) ao USING (app) JOIN (SELECT res, min(pos) AS o FROM m GROUP BY res) ro USING (res)),
u AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY {ORDER}) AS seq FROM log),
d AS (SELECT *, row_number() OVER (PARTITION BY dev ORDER BY {ORDER}) AS seq FROM log),
l AS (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY {ORDER}) AS seq FROM log WHERE loc <> 'UNKNOWN')"""
# Hours ahead of UTC, and latitude and longitude.
HOURS = "'US': -5, 'CA': -5, 'BR': -3, 'UK': 0, 'DE': 1, 'FR': 1, 'RU': 3, 'IN': 5.5, 'VN': 7, 'TH': 7, 'SG': 8, 'CN': 8, 'JP': 9, 'KR': 9, 'AU': 10"
PLACES = """('US', 39.8283, -98.5795), ('CA', 56.1304, -106.3468), ('BR', -14.2350, -51.9253), ('UK', 55.3781, -3.4360), ('DE', 51.1657, 10.4515),
  ('FR', 46.2276, 2.2137), ('RU', 61.5240, 105.3188), ('IN', 20.5937, 78.9629), ('VN', 14.0583, 108.2772), ('TH', 15.8700, 100.9925),
  ('SG', 1.3521, 103.8198), ('CN', 35.8617, 104.1954), ('JP', 36.2048, 138.2529), ('KR', 35.9078, 127.7669), ('AU', -25.2744, 133.7751)"""
TOUCHING = "('ACCESS', 'DOWNLOAD', 'OPEN_APP', 'ADMIN_ACTION')"


def _alerts(steps: str, evidence: str, meets: str) -> str:
    """`steps` end in a CTE `a` of alerts (anchor columns, seq, c, lo); `evidence` names the rows e that `meets` selects."""
    return f"""WITH RECURSIVE {LOG},
{steps}
SELECT a.usr AS "user", a.dev AS device, a.app AS app, a.res AS resource, a.loc AS location, a.ev AS event_type, a.ts AS anchor_ts,
  CAST(least(a.ts, min(e.ts)) AS BIGINT) AS start_ts, CAST(greatest(a.ts, max(e.ts)) AS BIGINT) AS end_ts, CAST(a.c AS BIGINT) AS count, CAST(count(e.ts) AS BIGINT) AS n_records
FROM a LEFT JOIN {evidence} e ON {meets}
GROUP BY a.usr, a.dev, a.app, a.res, a.loc, a.ev, a.ts, a.c, a.seq, a.lo"""


def _distinct(rows: str, key: str, value: str, p: Params) -> str:
    return _alerts(
        f"""r AS ({rows}),
w AS (SELECT r.*, (SELECT count(DISTINCT b.{value}) FROM r b WHERE b.{key} = r.{key} AND b.seq <= r.seq AND b.ts >= r.ts - {p.windowSec}) AS c FROM r),
x AS (SELECT *, lag(c) OVER (PARTITION BY {key} ORDER BY seq) AS before FROM w),
a AS (SELECT *, 0 AS lo FROM x WHERE c > {p.n} AND coalesce(before, 0) <= {p.n})""",
        "r",
        f"e.{key} = a.{key} AND e.seq <= a.seq AND e.ts >= a.ts - {p.windowSec}",
    )


_STREAKS = """s AS (SELECT *, sum(CASE WHEN ev IN ('FAILED_LOGIN', 'TOKEN_REFRESH') THEN 0 ELSE 1 END) OVER (PARTITION BY usr ORDER BY seq) AS g FROM u),
f AS (SELECT *, sum(cnt) OVER (PARTITION BY usr, g ORDER BY seq) AS run FROM s WHERE ev = 'FAILED_LOGIN')"""


def _sql(kind: str, p: Params) -> str:
    if kind == "A1":
        return _distinct("SELECT * FROM u WHERE ev = 'LOGIN'", "usr", "dev", p)
    if kind == "A3":
        return _distinct(f"SELECT * FROM d WHERE ev IN {TOUCHING}", "dev", "res", p)
    if kind == "A2":
        steps = f"""{_STREAKS},
a AS (SELECT *, run AS c, 0 AS lo FROM f WHERE run >= {p.n} AND run - cnt < {p.n})"""
        return _alerts(steps, "f", "e.usr = a.usr AND e.g = a.g AND e.seq <= a.seq")
    if kind == "B1":
        steps = f"""{_STREAKS},
t AS (SELECT usr, g, sum(cnt) AS total FROM f GROUP BY usr, g),
a AS (SELECT s.*, coalesce(t.total, 0) AS c, 0 AS lo FROM s LEFT JOIN t ON t.usr = s.usr AND t.g = s.g - 1 WHERE s.ev = 'LOGIN' AND coalesce(t.total, 0) >= {p.n}),
ev2 AS (SELECT usr, g AS g, seq, ts FROM f UNION ALL SELECT usr, g - 1, seq, ts FROM a)"""
        return _alerts(steps, "ev2", "e.usr = a.usr AND e.g = a.g - 1 AND e.seq <= a.seq")
    if kind == "A4":
        offset = f"CAST(coalesce(MAP {{{HOURS}}}[loc], 0) * 3600 AS BIGINT)"
        outside = f"h < {p.startHour} OR h >= {p.endHour}" if p.startHour <= p.endHour else f"h < {p.startHour} AND h >= {p.endHour}"
        steps = f"""h AS (SELECT *, CAST((((ts + {offset}) % 86400 + 86400) % 86400) // 3600 AS BIGINT) AS h FROM u),
a AS (SELECT *, h AS c, 0 AS lo FROM h WHERE {outside})"""
        return _alerts(steps, "u", "e.usr = a.usr AND e.seq = a.seq")
    if kind == "A5":
        steps = f"""place(c, lat, lon) AS (VALUES {PLACES}),
xyz AS (SELECT c, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM place),
travel AS (SELECT a.c AS origin, b.c AS target, CAST(ceil((6371 * 2 * asin(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2) / 900 + 2) * 3600) AS BIGINT) AS sec
  FROM xyz a JOIN xyz b ON a.c <> b.c WHERE least(a.c, b.c) || greatest(a.c, b.c) NOT IN ('CAUS', 'CNVN', 'CNIN', 'CNRU', 'DEFR')),
k AS (SELECT *, lag(loc) OVER w AS origin, lag(ts) OVER w AS pts, lag(seq) OVER w AS lo FROM u WHERE loc <> 'UNKNOWN' WINDOW w AS (PARTITION BY usr ORDER BY seq)),
a AS (SELECT k.*, ts - pts AS c FROM k JOIN travel ON k.origin = travel.origin AND k.loc = travel.target WHERE ts - pts < sec)"""
        return _alerts(steps, "k", "e.usr = a.usr AND e.seq IN (a.lo, a.seq)")
    if kind == "A6":
        steps = f"""y AS (SELECT *, ts // 86400 AS day FROM u),
k AS (SELECT *, CASE WHEN lag(loc) OVER (PARTITION BY usr, day ORDER BY seq) <> loc THEN 1 ELSE 0 END AS moved FROM y WHERE loc <> 'UNKNOWN'),
n AS (SELECT *, sum(moved) OVER (PARTITION BY usr, day ORDER BY seq) AS c FROM k),
a AS (SELECT *, 0 AS lo FROM n WHERE moved = 1 AND c = {p.n} + 1)"""
        return _alerts(steps, "y", "e.usr = a.usr AND e.day = a.day AND e.seq <= a.seq")
    if kind == "A7":
        steps = f"""k AS (SELECT *, lag(ev) OVER w AS pev, lag(ts) OVER w AS pts, lag(seq) OVER w AS lo FROM u WHERE ev IN ('LOGIN', 'LOGOUT') WINDOW w AS (PARTITION BY usr ORDER BY seq)),
a AS (SELECT *, ts - pts AS c FROM k WHERE ev = 'LOGOUT' AND pev = 'LOGIN' AND ts - pts > {p.sessionSec})"""
        return _alerts(steps, "k", "e.usr = a.usr AND e.seq IN (a.lo, a.seq)")
    if kind == "A8":
        steps = f"""r AS (SELECT * FROM u WHERE ev = 'LOGIN'),
w AS (SELECT r.*, (SELECT sum(b.cnt) FROM r b WHERE b.usr = r.usr AND b.seq <= r.seq AND b.ts >= r.ts - {p.windowSec}) AS c FROM r),
x AS (SELECT *, lag(c) OVER (PARTITION BY usr ORDER BY seq) AS before FROM w),
a AS (SELECT *, 0 AS lo FROM x WHERE c >= {p.n} AND (before IS NULL OR before < {p.n}))"""
        return _alerts(steps, "r", f"e.usr = a.usr AND e.seq <= a.seq AND e.ts >= a.ts - {p.windowSec}")
    if kind == "A9":
        steps = f"""s AS (SELECT *, sum(CASE WHEN ev IN ('LOGIN', 'LOGOUT') THEN 1 ELSE 0 END) OVER (PARTITION BY usr ORDER BY seq) AS part,
  sum(CASE WHEN ev IN ('DOWNLOAD', 'TOKEN_REFRESH') THEN 0 ELSE 1 END) OVER (PARTITION BY usr ORDER BY seq) AS g FROM u),
o AS (SELECT usr, part, min(seq) AS opened, min(CASE WHEN ev = 'ADMIN_ACTION' THEN seq END) AS admin FROM s GROUP BY usr, part),
q AS (SELECT s.* FROM s JOIN o ON s.usr = o.usr AND s.part = o.part JOIN s f ON f.usr = o.usr AND f.seq = o.opened WHERE f.ev = 'LOGIN' AND s.seq >= o.admin),
r AS (SELECT *, sum(cnt) OVER (PARTITION BY usr, g ORDER BY seq) AS c FROM q WHERE ev = 'DOWNLOAD'),
a AS (SELECT *, 0 AS lo FROM r WHERE c >= {p.n} AND c - cnt < {p.n})"""
        return _alerts(steps, "q", "e.usr = a.usr AND e.g = a.g AND e.seq <= a.seq AND e.ev IN ('DOWNLOAD', 'ADMIN_ACTION')")
    if kind == "B2":
        steps = f"""k AS (SELECT *, lag(ts) OVER (PARTITION BY usr ORDER BY seq) AS pts FROM u),
b AS (SELECT u.*, k.seq - 1 AS lo, sum(u.cnt) OVER (PARTITION BY k.usr, k.seq ORDER BY u.seq) AS c FROM k JOIN u ON u.usr = k.usr AND u.seq >= k.seq AND u.ts <= k.ts + {p.burstSec} WHERE k.ts >= k.pts + {p.silenceSec}),
a AS (SELECT * FROM b WHERE c > {p.n} AND c - cnt <= {p.n})"""
        return _alerts(steps, "u", "e.usr = a.usr AND e.seq BETWEEN a.lo AND a.seq")
    if kind == "C4":
        steps = f"""r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY seq) AS n FROM u WHERE ev = 'FAILED_LOGIN'),
q AS (SELECT usr, n, ts, [{{'ts': ts, 'seq': seq}}] AS w, 1 >= {p.n} AS rep, 1 >= {p.n} AS fire FROM r WHERE n = 1
  UNION ALL
  SELECT usr, n, ts, w2, (rep AND len(kept) >= {p.n}) OR len(w2) >= {p.n}, NOT (rep AND len(kept) >= {p.n}) AND len(w2) >= {p.n} FROM (
    SELECT *, CASE WHEN len(kept) = 0 OR ts >= kept[len(kept)].ts + {p.minSpacingSec} THEN list_append(kept, {{'ts': ts, 'seq': seq}}) ELSE kept END AS w2 FROM (
      SELECT r.usr, r.n, r.ts, r.seq, q.rep, list_filter(q.w, lambda y: y.ts + {p.windowSec} >= r.ts) AS kept FROM q JOIN r ON r.usr = q.usr AND r.n = q.n + 1))),
a AS (SELECT r.*, len(q.w) AS c, q.w[1].seq AS lo, list_transform(q.w, lambda y: y.seq) AS only FROM q JOIN r ON r.usr = q.usr AND r.n = q.n WHERE q.fire)"""
        return _alerts(steps, "r", "e.usr = a.usr AND list_contains(a.only, e.seq)")
    if kind == "D2":
        steps = f"""b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY usr ORDER BY seq) < {p.minGapSec} THEN 0 ELSE 1 END AS brk FROM u),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY usr ORDER BY seq) AS isle FROM b),
n AS (SELECT *, sum(cnt - brk) OVER (PARTITION BY usr, isle ORDER BY seq) AS c FROM isl),
x AS (SELECT *, lag(c) OVER (PARTITION BY usr, isle ORDER BY seq) AS before FROM n),
a AS (SELECT *, 0 AS lo FROM x WHERE c >= {p.n} AND (before IS NULL OR before < {p.n}))"""
        return _alerts(steps, "isl", "e.usr = a.usr AND e.isle = a.isle AND e.seq <= a.seq")
    if kind == "D8":
        steps = f"""y AS (SELECT *, ts // 86400 AS day, ts - lag(ts) OVER (PARTITION BY usr, ts // 86400 ORDER BY seq) AS gap FROM u),
t AS (SELECT usr, day, max(seq) AS seq, sum(cnt) AS c, CAST(sum(cnt) - 1 AS HUGEINT) AS k, CAST(coalesce(sum(gap), 0) AS HUGEINT) AS s1, coalesce(sum(CAST(gap AS HUGEINT) * gap), 0) AS s2 FROM y GROUP BY usr, day),
a AS (SELECT y.*, t.c, 0 AS lo FROM t JOIN y ON y.usr = t.usr AND y.seq = t.seq WHERE c >= {p.minEvents} AND k >= 2 AND s1 > 0 AND (k * s2 - s1 * s1) * 10000 <= {p.maxCvPercent**2} * s1 * s1)"""
        return _alerts(steps, "y", "e.usr = a.usr AND e.day = a.day")
    if kind == "D10":
        steps = f"""w AS (SELECT l.*, (SELECT sum(b.cnt) FROM l b WHERE b.loc = l.loc AND b.seq <= l.seq AND b.ts BETWEEN l.ts - {p.windowSec} AND l.ts) AS total,
  (SELECT coalesce(sum(b.cnt), 0) FROM l b WHERE b.loc = l.loc AND b.seq <= l.seq AND b.ts BETWEEN l.ts - {p.windowSec} AND l.ts AND b.ev = 'FAILED_LOGIN') AS c FROM l),
x AS (SELECT *, total >= {p.minEvents} AND c * 100 >= total * {p.failureRatioPercent} AS bad FROM w),
z AS (SELECT *, lag(bad) OVER (PARTITION BY loc ORDER BY seq) AS before FROM x),
a AS (SELECT *, 0 AS lo FROM z WHERE bad AND NOT coalesce(before, false))"""
        return _alerts(steps, "l", f"e.loc = a.loc AND e.seq <= a.seq AND e.ts >= a.ts - {p.windowSec}")
    if kind == "D11":
        percent = min(max(p.coveragePercent, 1), 100)
        steps = f"""t AS (SELECT n, least(greatest(CAST(ceil(n * {percent} / 100.0) AS BIGINT), 2), n) AS need FROM (SELECT count(DISTINCT res) AS n FROM log)),
k AS (SELECT *, CASE WHEN regexp_full_match(res, 'R[0-9]+') THEN CAST(substr(res, 2) AS HUGEINT) END AS num FROM d WHERE ev IN {TOUCHING}),
b AS (SELECT *, CASE WHEN num = lag(num) OVER (PARTITION BY dev ORDER BY seq) + 1 THEN 0 ELSE 1 END AS brk FROM k),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY dev ORDER BY seq) AS isle FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY dev, isle ORDER BY seq) AS c FROM isl WHERE num IS NOT NULL),
a AS (SELECT r.*, 0 AS lo FROM r, t WHERE t.n >= 2 AND r.c = t.need)"""
        return _alerts(steps, "r", "e.dev = a.dev AND e.isle = a.isle AND e.seq <= a.seq")
    steps = f"""s AS (SELECT *, sum(CASE WHEN ev = 'LOGIN' THEN 1 ELSE 0 END) OVER (PARTITION BY usr ORDER BY seq) AS part FROM u),
o AS (SELECT usr, part, min(ts) AS began, min(seq) FILTER (WHERE ev = 'LOGOUT') AS out FROM s WHERE part > 0 GROUP BY usr, part),
i AS (SELECT s.*, o.began, o.out FROM s JOIN o ON s.usr = o.usr AND s.part = o.part AND s.seq <= o.out),
q AS (SELECT usr, part FROM i GROUP BY usr, part HAVING max(CASE WHEN seq = out THEN ts END) - min(began) <= {p.maxDurationSec} AND max(CASE WHEN ev IN ('ACCESS', 'DOWNLOAD') THEN 1 ELSE 0 END) = 1),
r AS (SELECT i.* FROM i JOIN q ON i.usr = q.usr AND i.part = q.part),
t AS (SELECT usr, count(DISTINCT part) AS c, max(seq) AS seq FROM r GROUP BY usr),
a AS (SELECT r.*, t.c, 0 AS lo FROM r JOIN t ON r.usr = t.usr AND r.seq = t.seq WHERE t.c > {p.n})"""
    return _alerts(steps, "r", "e.usr = a.usr")


#: Lines of a raw file made from the events, some of them faulty; `value` and `pos` as a scan gives them.
RAW = r"""raw AS (SELECT pos, CASE pos % 16 WHEN 1 THEN line || ',' WHEN 2 THEN replace(line, ',', ';') WHEN 3 THEN line || 'x' WHEN 4 THEN lower(line) WHEN 5 THEN ' ' || line
    WHEN 6 THEN 'U18446744073709551616' || substr(line, strpos(line, ',')) WHEN 7 THEN 'U018446744073709551615' || substr(line, strpos(line, ',')) WHEN 8 THEN replace(line, ',APP', ',') WHEN 9 THEN line || '00000000000000'
    WHEN 10 THEN '"' || line WHEN 11 THEN ',,,,,,7' WHEN 12 THEN replace(line, ',R', ',Rx') WHEN 13 THEN line || '.0' ELSE line END AS value
  FROM (SELECT pos, usr || ',' || dev || ',' || app || ',' || res || ',' || ev || ',' || loc || ',' || ts AS line FROM m))"""

_ID = lambda i, prefix, kind: f"CASE WHEN regexp_full_match(f[{i}], '{prefix}[0-9]+') AND try_cast(substr(f[{i}], {len(prefix) + 1}) AS UBIGINT) IS NOT NULL THEN f[{i}] ELSE 'UNKNOWN_{kind}' END"

PARSED = f"""p AS (SELECT pos, f, len(f) = 7 AND regexp_full_match(f[7], '[0-9]+') AND try_cast(f[7] AS UBIGINT) IS NOT NULL AS good, try_cast(f[7] AS BIGINT) AS seconds,
    {_ID(1, "U", "USER")} AS usr, {_ID(2, "D", "DEVICE")} AS dev, {_ID(3, "APP", "APP")} AS app, {_ID(4, "R", "RESOURCE")} AS res,
    CASE WHEN f[5] IN ({", ".join(f"'{e}'" for e in EVENTS)}) THEN f[5] ELSE 'UNKNOWN' END AS ev, CASE WHEN f[6] IN ({", ".join(f"'{x}'" for x in LOCATIONS)}) THEN f[6] ELSE 'UNKNOWN' END AS loc
  FROM (SELECT pos, string_split(value, ',') AS f FROM raw)),
k AS (SELECT *, good AND seconds IS NOT NULL AS accepted, good AND (usr LIKE 'UNK%' OR dev LIKE 'UNK%' OR app LIKE 'UNK%' OR res LIKE 'UNK%' OR ev = 'UNKNOWN' OR loc = 'UNKNOWN') AS replaced FROM p)"""


def _records(kind: str, p: Params) -> str:
    """Alerts of login bursts or failed streaks, with their evidence joined to one text."""
    if kind == "A8":
        steps = f"""r AS (SELECT * FROM u WHERE ev = 'LOGIN'),
w AS (SELECT r.*, (SELECT sum(b.cnt) FROM r b WHERE b.usr = r.usr AND b.seq <= r.seq AND b.ts >= r.ts - {p.windowSec}) AS c FROM r),
x AS (SELECT *, lag(c) OVER (PARTITION BY usr ORDER BY seq) AS before FROM w),
a AS (SELECT * FROM x WHERE c >= {p.n} AND (before IS NULL OR before < {p.n}))"""
        rows, meets, severity, text = "r", f"e.usr = a.usr AND e.seq <= a.seq AND e.ts >= a.ts - {p.windowSec}", "medium", "' logins within the window'"
    else:
        steps = f"""{_STREAKS},
a AS (SELECT *, run AS c FROM f WHERE run >= {p.n} AND run - cnt < {p.n})"""
        rows, meets, severity, text = "f", "e.usr = a.usr AND e.g = a.g AND e.seq <= a.seq", "medium", "' failed logins in a row'"
    utc = "strftime(epoch_ms({0} * 1000), '%Y-%m-%dT%H:%M:%SZ')".format
    fields = lambda t: f"'{{\"eventType\":\"' || {t}.ev || '\",\"user\":\"' || {t}.usr || '\",\"device\":\"' || {t}.dev || '\",\"app\":\"' || {t}.app || '\",\"resource\":\"' || {t}.res || '\",\"location\":\"' || {t}.loc || '\",\"timestamp\":' || {t}.ts || ',\"timestampUtc\":\"' || {utc(t + '.ts')} || '\",\"count\":' || {t}.cnt || '}}'"
    return f"""{steps},
al AS (SELECT '{kind}' AS type, '{severity}' AS severity, a.usr AS "user", a.usr_ord, a.dev_ord, a.app_ord, a.res_ord, a.ev_tag, a.loc_tag, a.ts, a.seq, min(e.ts) AS t0, max(e.ts) AS t1, CAST(a.c AS BIGINT) AS count,
  a.c || {text} AS reason, string_agg({fields("e")}, ',' ORDER BY e.seq) AS records FROM a JOIN {rows} e ON {meets} GROUP BY ALL)"""


def _lines(kind: str, p: Params) -> str:
    utc = "strftime(epoch_ms({0} * 1000), '%Y-%m-%dT%H:%M:%SZ')".format
    return f"""WITH {LOG}, {_records(kind, p)}
SELECT '{{"type":"' || type || '","severity":"' || severity || '","user":"' || "user" || '","timestamp":' || t0 || ',"timestampUtc":"' || {utc("t0")} || '","endTimestamp":' || t1 || ',"endTimestampUtc":"' || {utc("t1")}
  || '","count":' || count || ',"reason":"' || reason || '","records":[' || records || ']}}' AS value FROM al"""


def _preview(kind: str, p: Params, cap: int) -> str:
    return f"""WITH {LOG}, {_records(kind, p)}
SELECT (SELECT count(*) FROM al) AS total, type, severity, "user", t0 AS "timestamp", count, reason AS detail, CAST(len(string_split(records, '}},')) AS INTEGER) AS n_records
FROM al ORDER BY usr_ord, t0, usr_ord, dev_ord, app_ord, res_ord, ev_tag, loc_tag LIMIT {cap}"""


def all_sql(settings: dict[str, dict[str, int]]) -> dict[str, str]:
    row = 'SELECT ts AS "timestamp", usr AS "user", dev AS device, app, res AS resource, ev AS event_type, loc AS location, cnt AS count FROM log'
    found = {
        "q1_user_journey": f"WITH {LOG} {row} WHERE usr = 'U3'",
        "q2_resource_access": f"WITH {LOG} {row} WHERE res = 'R26'",
        "q3_top_resources": f"WITH {LOG} SELECT res AS resource, CAST(sum(cnt) AS BIGINT) AS count, max(ts) AS last_ts FROM log WHERE ev IN {TOUCHING} GROUP BY res, res_ord ORDER BY 2 DESC, 3 DESC, res_ord LIMIT 10",
        "q4_stats": f"WITH {LOG} SELECT count(DISTINCT usr) AS users, count(DISTINCT dev) AS devices, count(DISTINCT app) AS apps, count(DISTINCT res) AS resources, count(*) AS records, CAST(sum(cnt) AS BIGINT) AS accepted FROM log",
        "s8_clean_log": f"""WITH {LOG} SELECT usr AS "user", dev AS device, app, res AS resource, ev AS event_type, loc AS location, ts AS "timestamp", cnt,
  usr_ord AS user_ord, dev_ord AS device_ord, app_ord, res_ord AS resource_ord, CAST(ev_tag AS TINYINT) AS event_tag, CAST(loc_tag AS TINYINT) AS loc_tag FROM log""",
    }
    found |= {
        "s5_parsed_lines": f"""WITH {LOG}, {RAW}, {PARSED} SELECT pos, accepted, replaced, good AND seconds IS NULL AS beyond, usr AS "user", dev AS device, app, res AS resource, ev AS event_type, loc AS location, CASE WHEN regexp_full_match(f[7], '[0-9]+') THEN seconds END AS "timestamp" FROM k""",
        "s1_ingested_log": f"""WITH {LOG}, {RAW}, {PARSED} SELECT usr AS "user", dev AS device, app, res AS resource, ev AS event_type, loc AS location, seconds AS "timestamp", count(*) AS cnt FROM k WHERE accepted GROUP BY ALL""",
        "s5_counters": f"""WITH {LOG}, {RAW}, {PARSED} SELECT count(*) AS "totalRead", count(*) FILTER (WHERE NOT accepted) AS skipped, count(*) FILTER (WHERE accepted AND replaced) AS replaced, count(*) FILTER (WHERE good AND seconds IS NULL) AS "outOfRange" FROM k""",
        "s17_alert_lines": _lines("A8", Params.of(**settings["A8"])),
        "s17_streak_lines": _lines("A2", Params.of(**settings["A2"])),
        "q6_preview": _preview("A8", Params.of(**settings["A8"]), 25),
    }
    return found | {f"{k.lower()}_alerts": _sql(k, Params.of(**v)) for k, v in settings.items()}
