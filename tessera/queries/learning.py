"""Copies, scorers, calibration and thresholds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import learning, textual
from tessera.plans.bindings import bound, with_ctes
from tessera.session import read_table

from .text import _TFIDF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str, tables: tuple[str, ...] = ()) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, with_ctes(list(tables), sql) if tables else sql


def _items(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "benchmark").selectExpr("item_id AS id", "text", "item_id % 7 AS source", "IF(item_id % 6 = 0, 'field', 'news') AS kind", "item_id % 3 - 1 AS stance")


def _copies(s: SparkSession, d: str) -> DataFrame:
    items = read_table(s, d, "benchmark")
    cosines = textual.cosine_within(textual.tfidf(items, "item_id", "text"), items.selectExpr("item_id", "item_id % 2 AS topic"), "item_id", "topic")
    return learning.copies(cosines, _items(s, d), 0.2, 0.25)


_COPIES = _TFIDF + ", p AS (SELECT a.item_id AS a, b.item_id AS b, round_even(sum(a.w * b.w), 5) AS cosine FROM x a JOIN x b ON a.gram = b.gram AND a.item_id % 2 = b.item_id % 2 AND a.item_id < b.item_id GROUP BY 1, 2), k AS (SELECT b AS id, arg_min(a, (-cosine, a)) AS origin, max(cosine) AS cosine FROM p JOIN benchmark o ON o.item_id = a JOIN benchmark c ON c.item_id = b WHERE a % 7 <> b % 7 AND (a % 3 - 1) * (b % 3 - 1) >= 0 AND cosine >= CASE WHEN b % 6 = 0 THEN 0.25 ELSE 0.2 END AND length(trim(o.text)) >= 40 AND length(trim(c.text)) >= 40 GROUP BY 1)"
_add("copy_detect", _copies, _COPIES + " SELECT * FROM k")
_add(
    "copy_decisions",
    lambda s, d: learning.decided(_copies(s, d), _items(s, d).where("id % 4 < 2").selectExpr("id", "IF(id % 4 = 0, 'rejected', 'named') AS decision", "IF(id % 4 = 1, id - 1, NULL) AS named")),
    _COPIES + " SELECT item_id AS id, CASE WHEN item_id % 4 = 1 THEN item_id - 1 ELSE origin END AS origin FROM benchmark LEFT JOIN k ON id = item_id WHERE item_id % 4 <> 0 AND (item_id % 4 = 1 OR origin IS NOT NULL)",
)
_add("copy_summary", lambda s, d: learning.copy_summary(_items(s, d), _copies(s, d)), _COPIES + " SELECT item_id % 7 AS source, count(*) AS n, count(k.id) AS n_copies, round_even(count(k.id) / count(*), 6) AS share FROM benchmark LEFT JOIN k ON k.id = item_id GROUP BY 1")
_SCORES = ["id", "p * 6 - 2 AS score", "y"]
_NEWTON = ", g{k} AS MATERIALIZED (SELECT any_value(a) AS a, any_value(b) AS b, sum((q - y) * score) + 0.01 * (any_value(a) - 1) AS g1, sum(q - y) AS g2, sum(q * (1 - q) * score * score) + 0.01 + 1e-9 AS h11, sum(q * (1 - q) * score) AS h12, sum(q * (1 - q)) + 1e-9 AS h22 FROM (SELECT score, y, a, b, 1 / (1 + exp(-greatest(-50, least(50, a * score + b)))) AS q FROM s, m{j})), m{k} AS (SELECT a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM g{k})"
_add(
    "platt_calibration",
    lambda s, d: learning.calibrated(bound(s, d, "forecasts").selectExpr(*_SCORES), learning.platt(bound(s, d, "forecasts").selectExpr(*_SCORES))).select("id", "p"),
    ", s AS MATERIALIZED (SELECT id, p * 6 - 2 AS score, y FROM forecasts), m0 AS (SELECT 1e0 AS a, 0e0 AS b)" + "".join(_NEWTON.format(k=k, j=k - 1) for k in range(1, 9)) + " SELECT id, round_even(1 / (1 + exp(-(a * score + b))), 4) AS p FROM s, m8",
    ("forecasts",),
)
_GRID = [k / 20 for k in range(1, 20)]
_CURVE = f", g(threshold) AS (SELECT unnest([{', '.join(f'{t}e0' for t in _GRID)}])), c AS (SELECT threshold, sum(y) FILTER (p >= threshold)::DOUBLE AS hit, count(*) FILTER (p >= threshold)::DOUBLE AS said, sum(y)::DOUBLE AS gold FROM forecasts, g GROUP BY 1), r AS (SELECT threshold, round_even(CASE WHEN said > 0 THEN hit / said ELSE 0 END, 6) AS precision, round_even(CASE WHEN gold > 0 THEN hit / gold ELSE 0 END, 6) AS recall, round_even(2 * hit / (said + gold), 6) AS f1 FROM c)"
_add("threshold_curve", lambda s, d: learning.threshold_scores(bound(s, d, "forecasts"), _GRID), _CURVE + " SELECT * FROM r", ("forecasts",))
_add("threshold_tuning", lambda s, d: learning.best_threshold(bound(s, d, "forecasts"), _GRID), _CURVE + " SELECT arg_min(threshold, (-f1, threshold)) AS threshold, max(f1) AS f1 FROM r", ("forecasts",))
_add("balanced_weights", lambda s, d: learning.balanced_weights(read_table(s, d, "labels"), "quality"), "WITH c AS (SELECT quality, count(*) AS n_c FROM labels GROUP BY 1) SELECT quality, round_even((SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c), 6) AS weight FROM c")
_add(
    "paired_seeds",
    lambda s, d: learning.paired(read_table(s, d, "events"), "user_id", "event_type", "value", "view", "click"),
    "WITH a AS (SELECT user_id, avg(value) AS va FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, avg(value) AS vb FROM events WHERE event_type = 'click' GROUP BY 1), d AS (SELECT round_even(va - vb, 9) AS d FROM a JOIN b USING (user_id)) SELECT count(*) AS n, count(*) FILTER (d > 0) AS wins_a, count(*) FILTER (d < 0) AS wins_b, round_even(avg(d), 6) AS mean, round_even(stddev_pop(d), 6) AS sd FROM d",
)
_add("detail_agreement", lambda s, d: bound(s, d, "votes").select("vote_id", learning.counts_agree(F.col("stated"), F.col("stated") * 0.9 + F.col("vote_id") % 20).alias("agrees")), " SELECT vote_id, CASE WHEN greatest(abs(stated), abs(stated * 0.9e0 + vote_id % 20)) = 0 THEN stated = stated * 0.9e0 + vote_id % 20 ELSE abs(stated - (stated * 0.9e0 + vote_id % 20)) <= 0.2e0 * greatest(abs(stated), abs(stated * 0.9e0 + vote_id % 20)) END AS agrees FROM votes", ("votes",))
_add("recall_by_scenario", lambda s, d: bound(s, d, "forecasts").where("y = 1").groupBy((F.col("id") % 9).alias("scenario")).agg(F.bround(F.avg((F.col("p") >= 0.5).cast("double")), 6).alias("recall"), F.bround(F.avg("p"), 6).alias("mean_p"), F.count_if(F.col("p") >= 0.8).alias("verified")), " SELECT id % 9 AS scenario, round_even(avg((p >= 0.5)::INT), 6) AS recall, round_even(avg(p), 6) AS mean_p, count(*) FILTER (p >= 0.8) AS verified FROM forecasts WHERE y = 1 GROUP BY 1", ("forecasts",))
