"""Lists, counts, change feeds, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import checks, lists, spacetime
from tessera.plans.bindings import bound, with_ctes
from tessera.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str, tables: tuple[str, ...] = ()) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, with_ctes(list(tables), sql) if tables else sql


def _t(table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: read_table(s, d, table)


events, orders, documents, labels, customer, pages, lineitem = map(_t, ("events", "orders", "documents", "labels", "customer", "pages", "lineitem"))

_add(
    "list_events_search",
    lambda s, d: lists.page(documents(s, d).where(lists.contains_text("a_b%", "text") | lists.contains_text("APACHE license", "text", "source")).select("doc_id", "source"), [F.desc("source"), F.col("doc_id")], 20, 2),
    "WITH q AS (SELECT doc_id, source, count(*) OVER () AS total FROM documents WHERE text ILIKE '%a$_b$%%' ESCAPE '$' OR text ILIKE '%apache license%' OR source ILIKE '%apache license%') SELECT * FROM q ORDER BY source DESC, doc_id LIMIT 20 OFFSET 2",
)
_add(
    "list_signals",
    lambda s, d: lists.page(lists.listed(bound(s, d, "signals"), {"source": [1, 2, 3], "item_status": ["new"]}, since=("t", 1704500000.0), present={"valid_until": False}).select("signal_id", "source"), [F.col("signal_id")], 50),
    ", q AS (SELECT signal_id, source FROM signals WHERE source IN (1, 2, 3) AND item_status = 'new' AND t >= 1704500000 AND valid_until IS NULL) SELECT *, (SELECT count(*) FROM q) AS total FROM q ORDER BY signal_id LIMIT 50",
    ("signals",),
)
_add(
    "list_reports",
    lambda s, d: lists.listed(bound(s, d, "reports"), {"reporter": list(range(10)), "item_status": ["new", "dismissed"]}, since=("t", 1704500000.0)).where("accuracy > 50").select("report_id", "reporter"),
    " SELECT report_id, reporter FROM reports WHERE reporter < 10 AND t >= 1704500000 AND accuracy > 50",
    ("reports",),
)
_add(
    "list_audit",
    lambda s, d: lists.listed(events(s, d).selectExpr("event_id", "concat(event_type, '.', user_id % 3) AS action", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS at"), since=("at", 1704500000.0), until=("at", 1706000000.0), prefix={"action": "error."}).select("event_id", "action"),
    "SELECT event_id, event_type || '.' || (user_id % 3) AS action FROM events WHERE event_type = 'error' AND epoch_us(ts) / 1e6 >= 1704500000 AND epoch_us(ts) / 1e6 < 1706000000",
)
_add("audit_actions", lambda s, d: events(s, d).selectExpr("concat(event_type, '.', user_id % 3) AS action").distinct(), "SELECT DISTINCT event_type || '.' || (user_id % 3) AS action FROM events")
_add("moderation_queue", lambda s, d: orders(s, d).join(lineitem(s, d).where("l_returnflag = 'R'").groupBy("l_orderkey").count().where("count >= 3"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 3)")
_add("verified_feed", lambda s, d: lists.page(orders(s, d).join(customer(s, d).where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 30, 5), "SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 5")
_add("bulk_selection", lambda s, d: bound(s, d, "signals").where("source < 5").join(bound(s, d, "linked_signals").where("event_id % 2 = 0").select("signal_id").distinct().withColumn("used", F.lit(True)), "signal_id", "left").select("signal_id", F.coalesce("used", F.lit(False)).alias("used")), " SELECT signal_id, EXISTS (SELECT 1 FROM linked_signals l WHERE l.signal_id = s.signal_id AND l.event_id % 2 = 0) AS used FROM signals s WHERE source < 5", ("signals", "linked_signals"))
_add("list_paged", lambda s, d: events(s, d).where(F.col("event_type").isin("error", "signup") & (F.col("value") > 10)).orderBy(F.desc("ts"), "event_id").offset(20).limit(25).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND value > 10 ORDER BY ts DESC, event_id LIMIT 25 OFFSET 20")
_add("links_of_item", lambda s, d: lineitem(s, d).where("l_orderkey = 7").select("l_orderkey", "l_linenumber", "l_shipdate").orderBy("l_shipdate", "l_linenumber"), "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_orderkey = 7 ORDER BY l_shipdate, l_linenumber")
_add("dashboard_counts", lambda s, d: events(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("value") > 50).alias("n_large"), F.countDistinct("event_type").alias("n_types")), "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER (value > 50) AS n_large, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id")
_add("source_counts_filter", lambda s, d: bound(s, d, "signals").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("t") >= 1705500000.0).alias("n_since")), " SELECT source, count(*) AS n, count(*) FILTER (t >= 1705500000) AS n_since FROM signals GROUP BY source", ("signals",))
_STATES = ["active", "monitoring", "resolved", "dismissed", "unknown"]
_add("status_zero_fill", lambda s, d: lists.counts_of(bound(s, d, "incidents"), "status", _STATES), f", v(status) AS (VALUES {', '.join(f"('{x}')" for x in _STATES)}) SELECT v.status, count(i.status) AS n FROM v LEFT JOIN incidents i USING (status) GROUP BY 1", ("incidents",))
_add(
    "latest_evidence",
    lambda s, d: lists.latest_evidence(bound(s, d, "reports").selectExpr("reporter AS event_id", "t AS at").where("event_id % 5 <> 4"), bound(s, d, "signals").selectExpr("source AS event_id", "coalesce(valid_until, t) AS at")),
    ", a AS (SELECT reporter AS event_id, t AS moment FROM reports WHERE reporter % 5 <> 4 UNION ALL SELECT source, coalesce(valid_until, t) FROM signals) SELECT event_id, max(moment) AS latest FROM a GROUP BY 1",
    ("reports", "signals"),
)
_add("likes_comments", lambda s, d: orders(s, d).select("o_orderkey").join(lineitem(s, d).groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("likes"), F.count_if(F.col("l_linestatus") == "O").alias("comments")), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("comments", F.lit(0)).alias("comments")), "SELECT o_orderkey, count(*) FILTER (l_returnflag = 'N') AS likes, count(*) FILTER (l_linestatus = 'O') AS comments FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
_add("superseded", lambda s, d: events(s, d).selectExpr("event_id", "event_id * 2 AS next_id").join(events(s, d).selectExpr("event_id AS next_id", "event_type AS next_type"), "next_id", "left").select("event_id", "next_type"), "SELECT a.event_id, b.event_type AS next_type FROM events a LEFT JOIN events b ON b.event_id = a.event_id * 2")
_add("few_judgements", lambda s, d: bound(s, d, "ratings").groupBy("unit").agg(F.countDistinct("rater").alias("n")).where("n < 19"), " SELECT unit, count(DISTINCT rater) AS n FROM ratings GROUP BY 1 HAVING count(DISTINCT rater) < 19", ("ratings",))
_add("disagreements", lambda s, d: lists.disagreements(bound(s, d, "ratings"), "unit", "rater", "label"), " SELECT unit, count(DISTINCT rater) AS raters, count(DISTINCT label) AS labels FROM ratings GROUP BY 1 HAVING count(DISTINCT rater) > 1 AND count(DISTINCT label) > 1", ("ratings",))
_add("annotation_majority", lambda s, d: lists.majority_label(bound(s, d, "ratings"), "unit", "label", "rater", bound(s, d, "ratings").where("unit % 50 = 0").groupBy("unit").agg(F.max("label").alias("label"))), ", c AS (SELECT unit, label, count(*) AS n, min(rater) AS f FROM ratings GROUP BY ALL), b AS (SELECT unit, arg_min(label, (-n, f, label)) AS m FROM c GROUP BY 1) SELECT unit, CASE WHEN unit % 50 = 0 THEN (SELECT max(label) FROM ratings r WHERE r.unit = b.unit) ELSE m END AS label FROM b", ("ratings",))
_add("group_label", lambda s, d: lists.unanimous(lineitem(s, d), "l_orderkey", "l_returnflag"), "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS label FROM lineitem GROUP BY 1")
_add("label_compatible", lambda s, d: bound(s, d, "votes").selectExpr("vote_id", "CASE WHEN relation = 1 THEN vote_id % 3 > 0 WHEN relation >= 3 THEN vote_id % 3 = 0 ELSE true END AS fits"), " SELECT vote_id, CASE WHEN relation = 1 THEN vote_id % 3 > 0 WHEN relation >= 3 THEN vote_id % 3 = 0 ELSE true END AS fits FROM votes", ("votes",))
_add("template_keys", lambda s, d: lists.frequent_keys(lineitem(s, d), "l_suppkey", "l_orderkey", "l_linenumber", 0.1), "WITH g AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS items FROM lineitem GROUP BY 1), k AS (SELECT l_suppkey, l_linenumber, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_linenumber, n, items FROM k JOIN g USING (l_suppkey) WHERE items >= 10 AND n >= 0.1 * items")
_add("recurrence", lambda s, d: lists.recurring(lineitem(s, d), "l_partkey", "l_orderkey"), "SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 5 ORDER BY n DESC, l_partkey LIMIT 40")
_add("corpus_statistics", lambda s, d: documents(s, d).groupingSets([["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"), F.sum("n_chars").alias("chars")), "SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_texts, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((source), (lang))")
_add("sources_in_two_items", lambda s, d: bound(s, d, "votes").groupBy("source").agg(F.countDistinct("item").alias("items")).where("items >= 2").agg(F.count("*").alias("n")), ", q AS (SELECT source FROM votes GROUP BY 1 HAVING count(DISTINCT item) >= 2) SELECT count(*) AS n FROM q", ("votes",))
_add("suggestion_usage", lambda s, d: events(s, d).groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.get_json_object(F.to_json(F.struct((F.col("event_id") % 5).alias("rank"))), "$.rank") == "0").alias("first"), F.count_if(F.get_json_object(F.to_json(F.struct((F.col("event_id") % 5).alias("rank"))), "$.rank").cast("int") < 3).alias("top3")), "SELECT event_type, count(*) AS total, count(*) FILTER (event_id % 5 = 0) AS first, count(*) FILTER (event_id % 5 < 3) AS top3 FROM events GROUP BY 1")
_add("history_left_join", lambda s, d: customer(s, d).join(orders(s, d).groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_orderdate").alias("last_order")), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "last_order"), "SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_add("evidence_reports", lambda s, d: bound(s, d, "reports").join(bound(s, d, "linked_reports"), "report_id").join(bound(s, d, "incidents"), "event_id").select("event_id", "report_id", "t"), " SELECT i.event_id, r.report_id, r.t FROM reports r JOIN linked_reports l USING (report_id) JOIN incidents i ON i.event_id = l.event_id", ("reports", "linked_reports", "incidents"))
_add("not_linked", lambda s, d: bound(s, d, "reports").join(bound(s, d, "linked_reports").join(bound(s, d, "incidents"), "event_id", "left_semi"), "report_id", "left_anti").select("report_id"), " SELECT report_id FROM reports r WHERE NOT EXISTS (SELECT 1 FROM linked_reports l JOIN incidents i ON i.event_id = l.event_id WHERE l.report_id = r.report_id)", ("reports", "linked_reports", "incidents"))
_add("semi_join", lambda s, d: documents(s, d).join(labels(s, d).where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source"), "SELECT doc_id, source FROM documents SEMI JOIN (SELECT * FROM labels WHERE toxic = 1) USING (doc_id)")
_add("set_operations", lambda s, d: events(s, d).where("event_type = 'error'").select("user_id").intersect(events(s, d).where("event_type = 'signup'").select("user_id")).subtract(events(s, d).where("event_type = 'purchase' AND value > 90").select("user_id")), "(SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup') EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90")
_add("first_of_each", lambda s, d: events(s, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])), lambda x: x), ",").alias("types")), "WITH f AS (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS types FROM f GROUP BY 1")
_add("boolean_sort", lambda s, d: orders(s, d).selectExpr("o_custkey", "o_orderkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderstatus <> 'O' AS INT), o_totalprice DESC, o_orderkey) AS k").where("k <= 2"), "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'O')::INT, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
_add("top_k_per_group", lambda s, d: orders(s, d).selectExpr("o_custkey", "o_orderkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k").where("k <= 3"), "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
_add("scored_first_ten", lambda s, d: bound(s, d, "forecasts").selectExpr("id % 40 AS item", "id", "p").where("p >= 0.05").selectExpr("item", "id", "row_number() OVER (PARTITION BY item ORDER BY p DESC, id) AS place").where("place <= 10"), " SELECT * FROM (SELECT id % 40 AS item, id, row_number() OVER (PARTITION BY id % 40 ORDER BY p DESC, id) AS place FROM forecasts WHERE p >= 0.05) WHERE place <= 10", ("forecasts",))
_add("sequential_ids", lambda s, d: lists.numbered(bound(s, d, "incidents").select("event_id", "started"), "EVT", "started", "event_id").select("event_id", "id"), " SELECT event_id, format('EVT-{:06d}', row_number() OVER (ORDER BY started, event_id)) AS id FROM incidents", ("incidents",))
_add(
    "asof_label",
    lambda s, d: spacetime.asof_last(events(s, d).where("event_type = 'click'").withColumnRenamed("event_id", "id"), events(s, d).where("event_type = 'purchase'"), "user_id", "ts", "value"),
    "SELECT c.event_id AS id, c.user_id, p.value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts",
)
_OLD = "event_id % 200 AS external_id, event_id % 7 AS source, event_id AS seq, CAST(floor(value / 20) AS BIGINT) AS content"
_add(
    "upsert_latest",
    lambda s, d: lists.upserted(events(s, d).where("event_type = 'view'").selectExpr(*_OLD.split(", ")).groupBy("source", "external_id").agg(F.max("seq").alias("seq"), F.max_by("content", "seq").alias("content")), events(s, d).where("event_type = 'click'").selectExpr(*_OLD.split(", ")), ["source", "external_id"], "seq", ["content"]),
    f"WITH o AS (SELECT source, external_id, arg_max(content, seq) AS content FROM (SELECT {_OLD} FROM events WHERE event_type = 'view') GROUP BY 1, 2), b AS (SELECT source, external_id, arg_max(content, seq) AS content FROM (SELECT {_OLD} FROM events WHERE event_type = 'click') GROUP BY 1, 2) SELECT source, external_id, CASE WHEN o.content IS NULL THEN 'created' WHEN b.content IS NULL THEN 'kept' WHEN o.content = b.content THEN 'skipped' ELSE 'updated' END AS action, coalesce(b.content, o.content) AS content FROM o FULL JOIN b USING (source, external_id)",
)
_add(
    "offline_submission",
    lambda s, d: lists.submissions(events(s, d).selectExpr("event_id", "user_id", "event_id % 50 AS client_id", "event_id % 3 AS content"), ["user_id", "client_id"], ["event_id"], "content").select("event_id", "outcome"),
    "WITH q AS (SELECT event_id, row_number() OVER w AS k, first_value(event_id % 3) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, event_id % 50 ORDER BY event_id)) SELECT event_id, CASE WHEN k = 1 THEN 'accepted' WHEN f = event_id % 3 THEN 'repeat' ELSE 'conflict' END AS outcome FROM q",
)
_add("checkpoint_views", lambda s, d: lists.checkpoint_views(bound(s, d, "votes")), ", f AS (SELECT item, min(seen) AS first FROM votes GROUP BY 1) SELECT v.item, h.hours::INT AS hours, count(*) AS n, sum(coalesce(vote, 0))::BIGINT AS score FROM votes v JOIN f USING (item), (VALUES (1), (6), (24), (168)) h(hours) WHERE seen <= first + h.hours * 3600 GROUP BY 1, 2", ("votes",))
_add(
    "change_log",
    lambda s, d: lists.change_log(events(s, d).selectExpr("user_id", "event_id", "event_type", "CAST(floor(value / 50) AS BIGINT) AS band"), "user_id", ["event_id"], ["event_type", "band"]),
    "WITH q AS (SELECT user_id, event_id, event_type AS a, floor(value / 50)::BIGINT::VARCHAR AS b, lag(event_type) OVER w AS pa, lag(floor(value / 50)::BIGINT::VARCHAR) OVER w AS pb, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, 'event_type' AS field, pa AS old, a AS new FROM q WHERE k > 1 AND pa IS DISTINCT FROM a UNION ALL SELECT user_id, event_id, 'band', pb, b FROM q WHERE k > 1 AND pb IS DISTINCT FROM b",
)
_add("status_side_effects", lambda s, d: bound(s, d, "incidents").join(bound(s, d, "answers").groupBy("event_id").agg(F.count("*").alias("n")), "event_id", "left").selectExpr("event_id", "CASE WHEN status IN ('resolved', 'dismissed') THEN 'cancelled' WHEN n > 0 THEN 'answered' ELSE 'open' END AS request"), ", a AS (SELECT event_id, count(*) AS n FROM answers GROUP BY 1) SELECT i.event_id, CASE WHEN status IN ('resolved', 'dismissed') THEN 'cancelled' WHEN n > 0 THEN 'answered' ELSE 'open' END AS request FROM incidents i LEFT JOIN a USING (event_id)", ("incidents", "answers"))
_add("auto_hidden", lambda s, d: bound(s, d, "reports").groupBy("type", F.floor(F.col("t") / 864000).alias("span")).agg(F.countDistinct("reporter").alias("n")).where("n >= 3"), " SELECT type, floor(t / 864000)::BIGINT AS span, count(DISTINCT reporter) AS n FROM reports GROUP BY 1, 2 HAVING count(DISTINCT reporter) >= 3", ("reports",))
_add("due_sources", lambda s, d: bound(s, d, "signals").groupBy("source").agg(F.max("t").alias("last")).where("last + greatest(source, 5) * 60 <= 1706745600 - source * 3600").select("source"), ", q AS (SELECT source, max(t) AS last FROM signals GROUP BY 1) SELECT source FROM q WHERE last + greatest(source, 5) * 60 <= 1706745600 - source * 3600", ("signals",))
_add("run_ledger", lambda s, d: events(s, d).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("fetched"), F.countDistinct("user_id").alias("created"), (F.count("*") - F.countDistinct("user_id")).alias("skipped")), "SELECT ts::DATE::VARCHAR AS day, count(*) AS fetched, count(DISTINCT user_id) AS created, count(*) - count(DISTINCT user_id) AS skipped FROM events GROUP BY 1")
_add("backfill_windows", lambda s, d: s.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-31', INTERVAL 7 DAYS)) AS day").join(events(s, d).select(F.to_date("ts").alias("e"), "event_id"), F.col("e").between(F.col("day"), F.date_add("day", 6)), "left").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("event_id").alias("n")), "SELECT w.day::DATE::VARCHAR AS day, count(event_id) AS n FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 7 DAY) w(day) LEFT JOIN events ON ts::DATE BETWEEN w.day::DATE AND w.day::DATE + 6 GROUP BY 1")
# validation
_add("duplicate_ids", lambda s, d: checks.duplicates(events(s, d).selectExpr("event_id * event_id % 5003 AS key", "event_id AS place"), "key", "place"), "WITH q AS (SELECT event_id * event_id % 5003 AS key, event_id AS place, min(event_id) OVER (PARTITION BY event_id * event_id % 5003) AS first FROM events) SELECT * FROM q WHERE place > first")
_add("dangling_refs", lambda s, d: documents(s, d).join(labels(s, d), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
_add("type_family", lambda s, d: events(s, d).join(F.broadcast(s.createDataFrame([("view", "passive"), ("click", "active"), ("purchase", "active"), ("error", "passive")], "event_type string, family string")), "event_type", "left").where("family IS NULL OR (family = 'passive') <> (event_id % 2 = 0)").select("event_id", "event_type"), "WITH m(event_type, family) AS (VALUES ('view', 'passive'), ('click', 'active'), ('purchase', 'active'), ('error', 'passive')) SELECT event_id, event_type FROM events LEFT JOIN m USING (event_type) WHERE family IS NULL OR (family = 'passive') <> (event_id % 2 = 0)")
_add("time_order", lambda s, d: lineitem(s, d).join(orders(s, d), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
_add("annotator_repeats", lambda s, d: bound(s, d, "ratings").groupBy("unit", "rater").agg(F.count("*").alias("n")).where("n > 1"), " SELECT unit, rater, count(*) AS n FROM ratings GROUP BY 1, 2 HAVING count(*) > 1", ("ratings",))
_add("constraint_violations", lambda s, d: lineitem(s, d).select("l_orderkey", "l_linenumber", F.array_join(F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_tax") > 0.07, "tax"), F.when(~F.col("l_quantity").between(1, 45), "quantity"))), ",").alias("broken")).where("broken <> ''"), "WITH q AS (SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.07 THEN 'tax' END, CASE WHEN NOT l_quantity BETWEEN 1 AND 45 THEN 'quantity' END) AS broken FROM lineitem) SELECT * FROM q WHERE broken <> ''")
_add("vocab_counts", lambda s, d: events(s, d).groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
_add("export_problems", lambda s, d: bound(s, d, "incidents").selectExpr("event_id", "'needs_ground_truth' AS problem").where("event_id % 4 = 0").union(bound(s, d, "incidents").where("elat > 23.2").selectExpr("event_id", "'outside'")).union(bound(s, d, "incidents").where("ended < latest").selectExpr("event_id", "'contradiction'")), " SELECT event_id, 'needs_ground_truth' AS problem FROM incidents WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 'outside' FROM incidents WHERE elat > 23.2e0 UNION ALL SELECT event_id, 'contradiction' FROM incidents WHERE ended < latest", ("incidents",))
