"""The engine's entities, bound to the supplied tables (they hold no geography, so it follows from keys).

Each binding is one list of expressions that Spark and DuckDB both read; {us} is a time's microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.session import read_table

#: The present of all queries, in seconds: 2024-02-01 00:00:00 UTC.
NOW = 1706745600.0
_LAT = "20.5e0 + ((user_id * 7) % 31) / 10e0 + (event_id * 37 % 50) / 1000e0"
_LON = "88e0 + ((user_id * 11) % 23) / 10e0 + (event_id * 53 % 50) / 1000e0"
_T = "{us} / 1e6"
_END = f"CASE WHEN event_id % 3 <> 0 THEN {_T} + (event_id % 72) * 3600e0 END"

#: name: (table, condition, columns)
BINDINGS = {
    "incidents": ("events", "event_type = 'error'", ["event_id", f"{_T} AS started", f"{_END} AS ended", f"CASE WHEN event_id % 5 = 0 THEN {_T} + (event_id % 200) * 3600e0 END AS latest", f"{_LAT} AS elat", f"{_LON} AS elon", "event_id % 3 AS etype", "CASE WHEN event_id % 13 = 0 THEN 'dismissed' WHEN event_id % 4 = 0 THEN 'resolved' WHEN event_id % 4 = 1 THEN 'monitoring' ELSE 'active' END AS status"]),
    "reports": ("events", "event_type IN ('view', 'click')", ["event_id AS report_id", "user_id AS reporter", f"{_T} AS t", "{us} + (event_id % 240) * 60000000 AS received_us", f"{_LAT} AS lat", f"{_LON} AS lon", "value AS accuracy", "event_id % 3 AS type", "CASE WHEN event_id % 17 = 0 THEN 'dismissed' ELSE 'new' END AS item_status"]),
    "signals": ("events", "event_type = 'signup'", ["event_id AS signal_id", "user_id % 20 AS source", f"{_T} AS t", f"CASE WHEN event_id % 4 = 0 THEN {_T} + (event_id % 48) * 3600e0 END AS valid_until", f"{_LAT} AS lat", f"{_LON} AS lon", "value * 100 AS precision_m", "event_id % 3 AS type", "CASE WHEN event_id % 17 = 0 THEN 'dismissed' ELSE 'new' END AS item_status"]),
    "answers": ("events", "event_type IN ('view', 'click') AND event_id % 5 = 0", ["event_id AS report_id", "event_id + 1 AS event_id"]),
    "linked_reports": ("events", "event_type IN ('view', 'click')", ["event_id AS report_id", "event_id - 1 - event_id % 5 AS event_id"]),
    "linked_signals": ("events", "event_type = 'signup'", ["event_id AS signal_id", "event_id - 1 - event_id % 5 AS event_id"]),
    "votes": ("events", "true", ["event_id AS vote_id", "event_id % 97 AS item", "user_id AS source", f"{_T} AS seen", "CASE WHEN event_id % 5 < 2 THEN 1 WHEN event_id % 5 = 2 THEN -1 END AS vote", "CASE user_id % 4 WHEN 0 THEN 'field' WHEN 1 THEN 'news' WHEN 2 THEN 'social' ELSE 'public_record' END AS source_type", "event_id % 5 AS relation", "CASE WHEN event_id % 7 = 0 AND event_id > 97 THEN event_id - 97 END AS copy_of", "CAST(value AS DOUBLE) AS stated", "CASE event_id % 3 WHEN 0 THEN 'occurrence' WHEN 1 THEN 'casualty_count' END AS conflict"]),
    "incident_facts": ("events", "event_id < 120", ["event_id AS item", "CASE event_id % 3 WHEN 0 THEN 'flash_flood' WHEN 1 THEN 'fire' ELSE 'road_accident' END AS event_type", "CASE WHEN event_id % 4 > 0 THEN concat('Ward ', event_id % 9) END AS place_name", f"{_T} AS started", f"CASE WHEN event_id % 5 = 0 THEN {_T} + 7200e0 END AS ended"]),
    "evidence": ("events", "event_id % 11 <> 3", ["event_id AS id", "event_id % 97 AS item", "concat('S', user_id % 50) AS source", "user_id % 10 / 10e0 AS rate", f"{_T} AS seen", "CASE WHEN event_id % 5 = 4 THEN 3 ELSE event_id % 5 END AS relation", "CASE WHEN event_id % 7 = 0 AND event_id > 97 THEN event_id - 97 END AS copy_of", "CASE event_id % 4 WHEN 0 THEN 'casualty_count' WHEN 1 THEN 'affected_count' END AS attribute", "CAST(floor(value * (event_id % 40)) AS DOUBLE) AS number"]),
    "requests": ("events", "event_type = 'purchase'", ["event_id AS request_id", "event_id % 500 AS event_id", f"{_T} AS created", "CASE event_id % 3 WHEN 0 THEN 'answered' ELSE 'open' END AS status", f"CASE WHEN event_id % 3 = 0 THEN {_T} + 3600e0 END AS closed"]),
    "responses": ("events", "event_type <> 'purchase'", ["event_id - event_id % 4 AS request_id"]),
    "event_states": ("events", "event_id < 450", ["event_id", "CASE event_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' ELSE 'active' END AS status", f"{_T} AS changed"]),
    "statements": ("events", "event_type = 'signup'", ["event_id AS statement_id", "user_id % 40 AS page_id", "CASE WHEN event_id % 3 = 0 THEN event_id - event_id % 20 END AS supersedes"]),
    "official_pages": ("nation", "true", ["n_nationkey AS page_id", "CASE WHEN n_nationkey % 3 = 0 THEN 'pending' ELSE 'verified' END AS status"]),
    "outcomes": ("events", "event_id < 97 AND event_id % 3 <> 0", ["event_id AS item", "event_id % 2 AS happened"]),
    "forecasts": ("events", "true", ["event_id AS id", "(event_id * 7919 % 1000) / 1000e0 AS p", "CASE WHEN (event_id * 31 % 100) * 10 < (event_id * 7919 % 1000) THEN 1 ELSE 0 END AS y"]),
    "ratings": ("events", "true", ["event_id % 499 AS unit", "user_id AS rater", "(event_id % 499 + CASE WHEN event_id % 7 < 2 THEN event_id ELSE 0 END) % 3 AS label"]),
    "photos": ("events", "event_type = 'purchase'", ["event_id AS photo_id", "(event_id * 2654435761) % 16 AS hi", "(event_id * event_id * 40503) % 65536 AS hash16"]),
}

#: Expressions that Spark computes in steps, each modulo the divisor: equal values, but no overflow of a long at event_id 15,090,000 and above.
STEPWISE = {"(event_id * event_id * 40503) % 65536 AS hash16": "(event_id % 65536) * (event_id % 65536) % 65536 * 40503 % 65536 AS hash16"}


def sql_of(name: str) -> str:
    table, where, columns = BINDINGS[name]
    return f"SELECT {', '.join(columns)} FROM {table} WHERE {where}".replace("{us}", "epoch_us(ts)")


def with_ctes(names: list[str], body: str) -> str:
    """A query over bindings, for DuckDB; body begins with a space, or with a comma for further tables."""
    return "WITH " + ", ".join(f"{n} AS ({sql_of(n)})" for n in names) + body


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, where, columns = BINDINGS[name]
    return read_table(spark, sf_dir, table).where(where).selectExpr(*[STEPWISE.get(c, c).replace("{us}", "unix_micros(CAST(ts AS TIMESTAMP))") for c in columns])
