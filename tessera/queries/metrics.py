"""Agreement, calibration, ranking and clustering measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import metrics
from tessera.plans.bindings import bound, with_ctes
from tessera.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str, tables: tuple[str, ...] = ()) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, with_ctes(list(tables), sql) if tables else sql


_F = ("forecasts",)
_add(
    "kappa",
    lambda s, d: metrics.kappa(read_table(s, d, "labels"), "quality", "toxic"),
    "WITH n AS (SELECT count(*)::DOUBLE AS t, count(*) FILTER (quality = toxic) AS same FROM labels), a AS (SELECT quality AS k, count(*)::DOUBLE AS na FROM labels GROUP BY 1), c AS (SELECT toxic AS k, count(*)::DOUBLE AS nb FROM labels GROUP BY 1), e AS (SELECT sum(na * nb) AS x FROM a JOIN c USING (k)), p AS (SELECT same / t AS po, x / (t * t) AS pe FROM n, e) SELECT round_even(po, 6) AS observed, round_even(pe, 6) AS expected, round_even((po - pe) / (1 - pe), 6) AS kappa FROM p",
)
_add("confusion", lambda s, d: metrics.confusion(read_table(s, d, "labels"), "quality", "toxic"), "SELECT quality AS gold, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
_add(
    "brier_logloss",
    lambda s, d: metrics.brier_and_log_loss(bound(s, d, "forecasts")),
    ", c AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM forecasts) SELECT count(*) AS n, round_even(avg((p - y) * (p - y)), 6) AS brier, round_even(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM c",
    _F,
)
_add("accuracy_bias", lambda s, d: metrics.accuracy_and_bias(bound(s, d, "forecasts")), " SELECT round_even(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, round_even(avg(p - y), 6) AS bias FROM forecasts", _F)
_BIN = ", g AS (SELECT *, CAST(least(floor(p * 10), 9) AS INT) AS bin FROM forecasts)"
_add("calibration_bins", lambda s, d: metrics.calibration_bins(bound(s, d, "forecasts")), _BIN + " SELECT bin, count(*) AS n, round_even(avg(p), 6) AS mean_p, round_even(avg(y), 6) AS share FROM g GROUP BY bin", _F)
_add("ece_equal_width", lambda s, d: metrics.ece(bound(s, d, "forecasts")), _BIN + ", h AS (SELECT bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM g GROUP BY bin) SELECT round_even(sum(n * gap) / sum(n), 6) AS ece FROM h", _F)
_add("ece_equal_count", lambda s, d: metrics.ece_equal_count(bound(s, d, "forecasts")), ", g AS (SELECT *, ntile(10) OVER (ORDER BY p, id) AS bin FROM forecasts), h AS (SELECT bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM g GROUP BY bin) SELECT round_even(sum(n * gap) / sum(n), 6) AS ece FROM h", _F)
_add("selective_accuracy", lambda s, d: metrics.selective_accuracy(bound(s, d, "forecasts")), ", g AS (SELECT *, row_number() OVER (ORDER BY round_even(-abs(p - 0.5), 9), id) AS k, count(*) OVER () AS n FROM forecasts) SELECT round_even(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM g WHERE k <= floor(0.8 * n)", _F)
_add(
    "auc_midrank",
    lambda s, d: metrics.auc(bound(s, d, "forecasts")),
    ", r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS k FROM forecasts), t AS (SELECT sum(k) FILTER (y = 1) AS s, count(*) FILTER (y = 1)::DOUBLE AS np, count(*) FILTER (y = 0)::DOUBLE AS nn FROM r) SELECT round_even((s - np * (np + 1) / 2) / (np * nn), 6) AS auc FROM t",
    _F,
)
_CELLS = "WITH c AS (SELECT lang AS g, source AS c, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2)"
_PAIRS = ", b AS (SELECT sum(n * (n - 1) / 2) AS x FROM c), g AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY g)), k AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY c))"
_add(
    "bcubed",
    lambda s, d: metrics.bcubed(read_table(s, d, "documents"), "lang", "source"),
    _CELLS + ", x AS (SELECT n, sum(n) OVER (PARTITION BY g) AS ng, sum(n) OVER (PARTITION BY c) AS nc FROM c), y AS (SELECT sum(n * n / nc) / sum(n) AS p, sum(n * n / ng) / sum(n) AS r FROM x) SELECT round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(2 * p * r / (p + r), 6) AS f1 FROM y",
)
_add("pairwise_f1", lambda s, d: metrics.pairwise_f1(read_table(s, d, "documents"), "lang", "source"), _CELLS + _PAIRS + " SELECT round_even(b.x / k.x, 6) AS precision, round_even(b.x / g.x, 6) AS recall FROM b, g, k")
_add("adjusted_rand", lambda s, d: metrics.adjusted_rand(read_table(s, d, "documents"), "lang", "source"), _CELLS + _PAIRS + ", t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS x FROM c) SELECT round_even((b.x - g.x * k.x / t.x) / ((g.x + k.x) / 2 - g.x * k.x / t.x), 6) AS ari FROM b, g, k, t")
_add(
    "krippendorff",
    lambda s, d: metrics.alpha(bound(s, d, "ratings")),
    ", u AS (SELECT unit, label, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY unit) AS m FROM ratings GROUP BY unit, label), p AS (SELECT a.label AS c, b.label AS k, sum(a.c * (b.c - (a.label = b.label)::INT) / (a.m - 1)) AS v FROM u a JOIN u b USING (unit) WHERE a.m >= 2 GROUP BY ALL), n AS (SELECT c, sum(v) AS n FROM p GROUP BY c), o AS (SELECT sum(v) FILTER (c <> k) AS x, sum(v) AS n FROM p), e AS (SELECT sum(a.n * b.n) FILTER (a.c <> b.c) AS x FROM n a, n b) SELECT round_even(1 - o.x / (e.x / (o.n - 1)), 6) AS alpha FROM o, e",
    ("ratings",),
)
_SIDES = "WITH c AS (SELECT quality AS g, toxic AS p, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), l AS (SELECT g AS label FROM c UNION SELECT p FROM c), t AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM c WHERE g = label) AS gold, (SELECT coalesce(sum(n), 0) FROM c WHERE p = label) AS said, (SELECT coalesce(sum(n), 0) FROM c WHERE g = label AND p = label) AS hit FROM l), s AS (SELECT label, round_even(CASE WHEN said > 0 THEN hit / said ELSE 0 END, 6) AS precision, round_even(CASE WHEN gold > 0 THEN hit / gold ELSE 0 END, 6) AS recall, round_even(2 * hit / (gold + said), 6) AS f1, gold::BIGINT AS n_gold FROM t)"
_add("label_scores", lambda s, d: metrics.label_scores(read_table(s, d, "labels"), "quality", "toxic"), _SIDES + " SELECT * FROM s")
_add("macro_f1", lambda s, d: metrics.macro_f1(read_table(s, d, "labels"), "quality", "toxic"), _SIDES + " SELECT (SELECT round_even(avg(f1), 5) FROM s WHERE n_gold > 0) AS macro_f1, (SELECT round_even(avg((quality = toxic)::INT), 6) FROM labels) AS accuracy")
_TESTS = "SELECT nation.n_name AS name, (n_nationkey * 37 % 101) / 2020e0 AS p FROM nation"
_add(
    "holm",
    lambda s, d: metrics.holm(read_table(s, d, "nation").selectExpr("n_name AS name", "(n_nationkey * 37 % 101) / 2020e0 AS p")),
    f"WITH t AS ({_TESTS}), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM t) SELECT name, round_even(least(1, max(p * (m - k + 1)) OVER (ORDER BY p, name)), 6) AS adjusted FROM r",
)
_add("sweep_summary", lambda s, d: metrics.spread(read_table(s, d, "events"), "event_type"), "SELECT event_type, round_even(avg(value), 6) AS mean, round_even(stddev_pop(value), 6) AS sd, count(*) AS n FROM events GROUP BY 1")
