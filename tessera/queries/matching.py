"""Place and time: candidates, checks of reports, account risk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.geo import box, haversine_sql, in_country
from tessera.operators import checks, matching, spacetime
from tessera.plans.bindings import NOW, bound, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_UNTIL = f"coalesce(ended, least({NOW}, greatest(started, coalesce(latest, started)) + 604800e0))"
#: The present of the checks of reports: inside the table's time, so that all of them find something.
CHECK_NOW = 1705104000.0


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], tables: list[str], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, with_ctes(tables, sql)


def incidents(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, "incidents").withColumn("until", matching.effective_end(F.col("started"), F.col("ended"), F.col("latest"), NOW))


def report_items(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, "reports").selectExpr("report_id", "t AS start", "t AS end", "lat", "lon", "5e0 AS reach", "type", "item_status")


def signal_items(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, "signals").selectExpr("signal_id", "least(t, coalesce(valid_until, t)) AS start", "greatest(t, coalesce(valid_until, t)) AS end", "lat", "lon", "5 + least(coalesce(precision_m, 0) / 1000, 300e0) AS reach", "type", "item_status")


_PAIR = f", e AS (SELECT *, {_UNTIL} AS until FROM incidents), r AS (SELECT report_id AS id, t AS s, t AS u, lat, lon, 5e0 AS reach, type, item_status FROM reports)"
_SIG = f", e AS (SELECT *, {_UNTIL} AS until FROM incidents), r AS (SELECT signal_id AS id, least(t, coalesce(valid_until, t)) AS s, greatest(t, coalesce(valid_until, t)) AS u, lat, lon, 5 + least(coalesce(precision_m, 0) / 1000, 300e0) AS reach, type, item_status FROM signals)"
_KM = haversine_sql("r.lat", "r.lon", "e.elat", "e.elon")
_NEAR = f"{_KM} <= r.reach AND e.started <= r.u + 172800 AND e.until >= r.s - 172800"
_GAP = "greatest(0, e.started - r.u, r.s - e.until) / 3600"
_RANK = "row_number() OVER (PARTITION BY {k} ORDER BY {first}(type <> etype)::INT, round(km, 2), {o})::INT AS place"


def _ranked(key: str, other: str, id_name: str, limit: int, first: str = "") -> str:
    return f" SELECT {id_name}, event_id, km, hours, place FROM (SELECT id AS {id_name}, event_id, round(km, 6) AS km, round(hours, 6) AS hours, {_RANK.format(k=key, o=other, first=first)} FROM p) WHERE place <= {limit}"


def _event_candidates(kind: str, id_name: str) -> str:
    return f", p AS (SELECT r.id, e.event_id, {_KM} AS km, {_GAP} AS hours, type, etype FROM r JOIN e ON {_NEAR} WHERE e.status <> 'dismissed' AND NOT EXISTS (SELECT 1 FROM linked_{kind} l WHERE l.{id_name} = r.id AND l.event_id = e.event_id))" + _ranked("id", "event_id", id_name, 10)


_add("candidate_events", lambda s, d: matching.candidates_of_items(report_items(s, d), incidents(s, d), bound(s, d, "linked_reports"), "report_id", 5.0), ["incidents", "reports", "linked_reports"], _PAIR + _event_candidates("reports", "report_id"))
_add("candidate_events_for_signal", lambda s, d: matching.candidates_of_items(signal_items(s, d), incidents(s, d), bound(s, d, "linked_signals"), "signal_id", 305.0), ["incidents", "signals", "linked_signals"], _SIG + _event_candidates("signals", "signal_id"))
_add(
    "candidate_reports",
    lambda s, d: matching.candidates_of_incidents(report_items(s, d), incidents(s, d), bound(s, d, "linked_reports"), "report_id", 5.0, answers=bound(s, d, "answers")),
    ["incidents", "reports", "linked_reports", "answers"],
    _PAIR + f", p AS (SELECT r.id, e.event_id, {_KM} AS km, {_GAP} AS hours, type, etype, CASE WHEN a.report_id IS NULL THEN 1 ELSE 0 END AS asked FROM r JOIN e ON true LEFT JOIN answers a ON a.report_id = r.id AND a.event_id = e.event_id WHERE (a.report_id IS NOT NULL OR ({_NEAR})) AND r.item_status <> 'dismissed' AND NOT EXISTS (SELECT 1 FROM linked_reports l WHERE l.report_id = r.id AND l.event_id = e.event_id))" + _ranked("event_id", "id", "report_id", 25, "asked, "),
)
_add(
    "candidate_signals",
    lambda s, d: matching.candidates_of_incidents(signal_items(s, d), incidents(s, d), bound(s, d, "linked_signals"), "signal_id", 305.0),
    ["incidents", "signals", "linked_signals"],
    _SIG + f", p AS (SELECT r.id, e.event_id, {_KM} AS km, {_GAP} AS hours, type, etype FROM r JOIN e ON {_NEAR} WHERE r.item_status <> 'dismissed' AND NOT EXISTS (SELECT 1 FROM linked_signals l WHERE l.signal_id = r.id AND l.event_id = e.event_id))" + _ranked("event_id", "id", "signal_id", 25),
)
_add(
    "retrieve",
    lambda s, d: matching.retrieved(signal_items(s, d).withColumn("reach", F.col("reach") + 45), incidents(s, d), "signal_id", limit=None),
    ["incidents", "signals"],
    _SIG + f", p AS (SELECT r.id AS signal_id, e.event_id, row_number() OVER (PARTITION BY r.id ORDER BY e.started DESC, e.event_id)::INT AS place FROM r JOIN e ON {_KM} <= r.reach + 45 AND e.started <= r.u + 1209600 AND e.until >= r.s - 1209600 WHERE e.status <> 'dismissed') SELECT * FROM p",
)
_add("effective_end", lambda s, d: incidents(s, d).select("event_id", "until"), ["incidents"], f" SELECT event_id, {_UNTIL} AS until FROM incidents")
_add(
    "interval_gap",
    lambda s, d: incidents(s, d).select("event_id", F.bround(matching.hours_outside(F.lit(CHECK_NOW), F.col("started"), F.col("until")), 4).alias("hours")),
    ["incidents"],
    f" SELECT event_id, round_even(greatest(0, started - {CHECK_NOW}, {CHECK_NOW} - {_UNTIL}) / 3600, 4) AS hours FROM incidents",
)
_add(
    "bounding_box",
    lambda s, d: bound(s, d, "reports").where(F.abs(F.col("lat") - 22.0) <= box(F.lit(22.0), 40.0)[0]).where(F.abs(F.col("lon") - 89.5) <= box(F.lit(22.0), 40.0)[1]).select("report_id"),
    ["reports"],
    " SELECT report_id FROM reports WHERE abs(lat - 22) <= 40 / 110.574 AND abs(lon - 89.5) <= 40 / (111.320 * cos(radians(22)))",
)
_add("in_country", lambda s, d: bound(s, d, "reports").where(in_country(F.col("lat") + 3.2, F.col("lon") + 2.5)).select("report_id"), ["reports"], " SELECT report_id FROM reports WHERE lat + 3.2e0 BETWEEN 20.5e0 AND 26.7e0 AND lon + 2.5e0 BETWEEN 88e0 AND 92.7e0")
# Centres of the test's districts.
_CENTRES = [("north", 23.4, 89.1), ("south", 20.9, 89.0), ("east", 22.1, 90.1), ("west", 22.0, 88.2)]
_add(
    "nearest_district",
    lambda s, d: matching.nearest_centre(bound(s, d, "reports"), s.createDataFrame(_CENTRES, "name string, clat double, clon double"), "report_id"),
    ["reports"],
    f", c(name, clat, clon) AS (VALUES {', '.join(f"('{n}', {a}e0, {o}e0)" for n, a, o in _CENTRES)}) SELECT report_id, arg_min(name, (pow(clat - lat, 2) + pow((clon - lon) * cos(radians(lat)), 2))) AS centre FROM reports, c GROUP BY report_id",
)
_NEAREST = ", n AS (SELECT a.report_id, a.reporter, a.t, a.lat, a.lon, arg_min(b, (abs(b.t - a.t), b.t, b.report_id)) AS b FROM reports a JOIN reports b ON a.reporter = b.reporter AND a.report_id <> b.report_id GROUP BY ALL)"
_add("nearest_time_travel", lambda s, d: matching.nearest_in_time(bound(s, d, "reports")).select("report_id", F.bround(F.abs(F.col("t") - F.col("near.t")), 3).alias("apart_s")), ["reports"], _NEAREST + " SELECT report_id, round_even(abs(t - b.t), 3) AS apart_s FROM n")
_add(
    "impossible_travel",
    lambda s, d: matching.impossible_travel(bound(s, d, "reports"), least_km=0.02, most_kmh=0.05),
    ["reports"],
    _NEAREST + f", k AS (SELECT *, {haversine_sql('b.lat', 'b.lon', 'lat', 'lon')} AS km, abs(t - b.t) / 3600 AS hours FROM n) SELECT report_id, reporter, round(km, 4) AS km FROM k WHERE km > 0.02 AND km > 0.05 * hours",
)
_add(
    "burst_window",
    lambda s, d: matching.burst(bound(s, d, "reports"), minutes=2880.0, least=3),
    ["reports"],
    ", n AS (SELECT a.report_id, a.reporter, count(*) - 1 AS n_before FROM reports a JOIN reports b ON a.reporter = b.reporter AND b.received_us > a.received_us - 172800000000 AND b.received_us <= a.received_us GROUP BY 1, 2) SELECT * FROM n WHERE n_before >= 3",
)
_add(
    "rare_hours",
    lambda s, d: spacetime.rare_hours(bound(s, d, "reports")),
    ["reports"],
    ", t AS (SELECT reporter, count(*) AS total FROM reports GROUP BY 1), h AS (SELECT reporter, (floor(t / 3600) + 6) % 24 AS hour, count(*) AS n FROM reports GROUP BY 1, 2), g AS (SELECT t.reporter, g.hour::INT AS hour, coalesce(h.n, 0) AS n, total FROM t, range(24) g(hour) LEFT JOIN h ON h.reporter = t.reporter AND h.hour = g.hour) SELECT reporter, hour, n FROM g WHERE n < 0.02e0 * total",
)
_FLAGS = f"SELECT report_id, 'observed_in_future' AS code FROM reports WHERE t > {CHECK_NOW} + 300 UNION ALL SELECT report_id, 'old_observation' FROM reports WHERE {CHECK_NOW} - t > 86400"
_add("timing_flags", lambda s, d: checks.timing_flags(bound(s, d, "reports"), CHECK_NOW).select("report_id", F.array_join("flags", ",").alias("flags")), ["reports"], f", f AS ({_FLAGS}) SELECT report_id, code AS flags FROM f")
_add(
    "report_checks",
    lambda s, d: checks.flag_counts(bound(s, d, "reports"), CHECK_NOW, least_burst=2),
    ["reports"],
    _NEAREST + f", k AS (SELECT *, {haversine_sql('b.lat', 'b.lon', 'lat', 'lon')} AS km, abs(t - b.t) / 3600 AS hours FROM n), q AS (SELECT a.report_id FROM reports a JOIN reports b ON a.reporter = b.reporter AND b.received_us > a.received_us - 600000000 AND b.received_us <= a.received_us GROUP BY 1 HAVING count(*) >= 3), f AS ({_FLAGS} UNION ALL SELECT report_id, 'impossible_travel' FROM k WHERE km > 2 AND km > 150 * hours UNION ALL SELECT report_id, 'submission_burst' FROM q) SELECT report_id, string_agg(code, ',' ORDER BY code) AS codes FROM f GROUP BY 1",
)
_TAIL = "CASE WHEN n <= 0 THEN 1 ELSE greatest(0, 1 - list_sum([exp(-per_day + i * ln(per_day) - lgamma(i + 1)) for i in range(n)])) END"
_R = "least(greatest(({x} - {a}) / ({b} - {a}), 0), 1)"
_add(
    "account_risk",
    lambda s, d: checks.account_risk(bound(s, d, "reports"), bound(s, d, "reports").where("report_id % 6 = 0"), CHECK_NOW),
    ["reports"],
    f", a AS (SELECT *, received_us > {(CHECK_NOW - 86400) * 1e6:.0f} AS recent, (floor(received_us / 3.6e9) + 6) % 24 AS hour FROM reports WHERE received_us <= {CHECK_NOW * 1e6:.0f}), h AS (SELECT reporter, median(lat) AS hlat, median(lon) AS hlon, count(*) AS n_base, max(received_us) - min(received_us) AS us FROM a WHERE NOT recent GROUP BY 1)"
    f", k AS (SELECT a.*, n_base, {haversine_sql('hlat', 'hlon', 'lat', 'lon')} AS km FROM a JOIN h USING (reporter)), u AS (SELECT reporter, greatest(2, list_sort(list(km))[floor(0.9e0 * (min(n_base) - 1))::INT + 1]) AS usual FROM k WHERE NOT recent GROUP BY 1), f AS (SELECT reporter, median(km) AS away FROM k WHERE recent GROUP BY 1)"
    ", b AS (SELECT reporter, hour, count(*) AS m FROM a WHERE NOT recent GROUP BY 1, 2), o AS (SELECT k.reporter, count(*) AS n_odd FROM k LEFT JOIN b USING (reporter, hour) WHERE recent AND coalesce(m, 0) / n_base < 0.02 GROUP BY 1), c AS (SELECT reporter, count(*) FILTER (recent) AS n, count(*) FILTER (recent AND report_id % 6 = 0) AS n_flagged FROM a GROUP BY 1)"
    ", j AS (SELECT *, n_base / greatest(us / 8.64e10, 1) AS per_day, coalesce(n_base >= 10, false) AS known FROM c LEFT JOIN h USING (reporter) LEFT JOIN u USING (reporter) LEFT JOIN f USING (reporter) LEFT JOIN o USING (reporter))"
    f", p AS (SELECT reporter, n, coalesce(n_base, 0) AS n_base, {_R.format(x='n_flagged / n', a=0.1, b=0.5)} AS flagged, CASE WHEN known THEN {_R.format(x='away / usual', a=3, b=10)} ELSE 0 END AS far, CASE WHEN known THEN {_R.format(x=f'-log10(greatest({_TAIL}, 1e-12))', a=2, b=6)} ELSE 0 END AS rate, CASE WHEN known THEN {_R.format(x='coalesce(n_odd, 0) / n', a=0.2, b=0.6)} ELSE 0 END AS hours FROM j)"
    " SELECT reporter, n, n_base, CASE WHEN n > 0 THEN round_even(1 - (1 - 0.9 * flagged) * (1 - 0.9 * far) * (1 - 0.6 * rate) * (1 - 0.5 * hours), 3) ELSE 0 END AS risk FROM p",
)
_add(
    "priority_points",
    lambda s, d: checks.priority(bound(s, d, "incidents").selectExpr("event_id", "event_id % 3 + 1 AS hazard", "IF(event_id % 6 = 1, 'households', 'people') AS affected_unit", "element_at(array('knee-deep', 'waist-deep', 'above-head'), cast(event_id % 3 AS int) + 1) AS depth", "event_id % 8 = 3 AS rising", "event_id % 25 - 5 AS deaths", "event_id * 977 % 200000 AS affected", "IF(event_id % 2 = 0, 'road_infrastructure', 'weather') AS family", "event_id % 5 AS n_recent", "ended", f"({NOW} - started) / 86400 AS age_days", "IF(event_id % 11 = 0, 'refuted', 'unverified') AS assessment", "event_id % 10 / 10e0 AS p", "event_id % 4 AS n_sources", "status")),
    ["incidents"],
    f", q AS (SELECT event_id, status IN ('resolved', 'dismissed') AS over, event_id % 3 + 1 + CASE WHEN event_id % 25 >= 15 THEN 4 WHEN event_id % 25 > 5 THEN 2 ELSE 0 END + CASE WHEN a >= 100000 THEN 3 WHEN a >= 10000 THEN 2 WHEN a >= 1000 THEN 1 ELSE 0 END + (event_id % 3 > 0)::INT + (event_id % 8 = 3)::INT + (event_id % 2 = 0)::INT + (event_id % 5 >= 3)::INT + (ended IS NULL AND ({NOW} - started) / 86400 >= 2)::INT + CASE WHEN event_id % 11 = 0 THEN -4 WHEN event_id % 10 < 3 THEN -3 WHEN event_id % 4 <= 1 THEN -1 ELSE 0 END AS s FROM (SELECT *, event_id * 977 % 200000 * CASE WHEN event_id % 6 = 1 THEN 4 ELSE 1 END AS a FROM incidents)), r AS (SELECT event_id, over, CASE WHEN over THEN 0 ELSE s END::INT AS points FROM q) SELECT event_id, points, CASE WHEN over THEN 'low' WHEN points >= 8 THEN 'critical' WHEN points >= 5 THEN 'high' WHEN points >= 3 THEN 'medium' ELSE 'low' END AS level FROM r",
)
_add(
    "rate_limit",
    lambda s, d: checks.rate_limited(bound(s, d, "reports").select("report_id", "reporter", "received_us"), "reporter", "received_us", 2, 1440.0).selectExpr("report_id", "n", "retry_s"),
    ["reports"],
    ", n AS (SELECT a.report_id, count(*) - 1 AS n, round_even((min(b.received_us) + 86400000000 - any_value(a.received_us)) / 1e6, 3) AS retry_s FROM reports a JOIN reports b ON a.reporter = b.reporter AND b.received_us > a.received_us - 86400000000 AND b.received_us <= a.received_us GROUP BY 1) SELECT * FROM n WHERE n >= 2",
)
