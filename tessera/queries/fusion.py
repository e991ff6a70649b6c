"""Votes, rates, labels, truth discovery and stated values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import checks, fusion
from tessera.plans.bindings import bound, with_ctes
from tessera.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    """A query of votes and outcomes."""
    QUERIES[name] = lambda s, d: query(bound(s, d, "votes"), bound(s, d, "outcomes"))
    ORACLE_SQL[name] = with_ctes(["votes", "outcomes"], sql)


_CLAMP = "greatest(0.05e0, least(0.98e0, {x}))"
_START = "CASE source_type WHEN 'field' THEN 0.8e0 WHEN 'public_record' THEN 0.9e0 WHEN 'news' THEN 0.75e0 ELSE 0.6e0 END"
_LATEST = ", l AS (SELECT item, source, arg_max(vote, (seen, vote_id)) AS vote, arg_max(vote_id, (seen, vote_id)) AS vote_id, arg_max(source_type, (seen, vote_id)) AS source_type, arg_max(relation, (seen, vote_id)) AS relation FROM votes WHERE vote IS NOT NULL AND copy_of IS NULL GROUP BY item, source)"
_RATES = (
    _LATEST
    + ", j AS (SELECT l.*, (vote = CASE WHEN happened = 1 THEN 1 ELSE -1 END)::INT AS ok FROM l JOIN outcomes USING (item))"
    + f", tr AS (SELECT source_type, {_CLAMP.format(x=f'(sum(ok) + 2 * any_value({_START})) / (count(*) + 2)')} AS type_rate, sum(ok)::BIGINT AS \"right\", count(*) AS n FROM j GROUP BY 1)"
    + f", sr AS (SELECT source, sum(ok)::BIGINT AS \"right\", count(*) AS n, {_CLAMP.format(x='(sum(ok) + 3 * any_value(type_rate)) / (count(*) + 3)')} AS rate FROM j JOIN tr USING (source_type) GROUP BY source, source_type)"
)
_SCORES = _RATES + f", rv AS (SELECT l.*, coalesce(sr.rate, tr.type_rate, {_START.replace('source_type', 'l.source_type')}) AS rate FROM l LEFT JOIN sr USING (source) LEFT JOIN tr ON tr.source_type = l.source_type), z AS (SELECT item, sum(vote * ln(rate / (1 - rate))) AS z FROM rv GROUP BY item)"
_SIG = "1 / (1 + exp(-greatest(-50, least(50, {z}))))"

_add("latest_vote_per_source", lambda v, o: fusion.latest_votes(v).select("item", "source", "vote_id", "vote"), _LATEST + " SELECT item, source, vote_id, vote FROM l")
_add("evidence_tally_pivot", lambda v, o: fusion.evidence_tally(v), " SELECT item, count(*) FILTER (relation < 2) AS n_for, count(*) FILTER (relation = 2) AS n_against, count(*) FILTER (relation > 2) AS n_other, count(DISTINCT source) FILTER (relation < 3) AS n_sources FROM votes GROUP BY item")
_add("equal_vote", lambda v, o: fusion.equal_vote(v), _LATEST + " SELECT item, sum(vote)::BIGINT AS score FROM l GROUP BY item")
_add("majority_logit", lambda v, o: fusion.majority(v), ", q AS (SELECT item, (count(*) FILTER (vote > 0) + 1) / (count(*) + 2) AS p FROM votes WHERE vote IS NOT NULL GROUP BY item) SELECT item, round(ln(p / (1 - p)), 6) AS log_odds FROM q")
_add("type_rates", lambda v, o: fusion.type_rates(v, o).select("source_type", "right", "n", F.bround("type_rate", 6).alias("rate")), _RATES + ' SELECT source_type, "right", n, round_even(type_rate, 6) AS rate FROM tr')
_add("reliability_rates", lambda v, o: fusion.source_rates(v, o).select("source", "right", "n", F.bround("rate", 6).alias("rate")), _RATES + ' SELECT source, "right", n, round_even(rate, 6) AS rate FROM sr')
_add("reliability_score", lambda v, o: fusion.scores(v, o).select("item", F.bround("z", 4).alias("log_odds"), F.bround(fusion.sigmoid(F.col("z")), 4).alias("p")), _SCORES + f" SELECT item, round_even(z, 4) AS log_odds, round_even({_SIG.format(z='z')}, 4) AS p FROM z")
_add(
    "label_rule",
    lambda v, o: fusion.label_rule(v, o),
    _SCORES
    + f", e AS MATERIALIZED (SELECT rv.*, conflict, stated, seen FROM rv JOIN (SELECT vote_id, conflict, stated, seen FROM votes) USING (vote_id)), x AS (SELECT DISTINCT a.item FROM e a JOIN e b ON a.item = b.item AND abs(a.seen - b.seen) <= 43200 AND abs(a.stated - b.stated) > 0.2 * greatest(abs(a.stated), abs(b.stated)) WHERE a.rate >= 0.5 AND b.rate >= 0.5 AND a.vote > 0 AND b.vote > 0), s AS (SELECT item, bool_or(rate >= 0.5 AND vote > 0) AS up, bool_or(rate >= 0.5 AND vote < 0) AS down, bool_or(rate >= 0.5 AND relation = 1 AND coalesce(conflict <> 'occurrence', false)) AS marked FROM e GROUP BY item), a AS (SELECT i.item, {_SIG.format(z='z')} AS p, up, down, marked OR x.item IS NOT NULL AS disputed FROM (SELECT DISTINCT item FROM votes) i LEFT JOIN z USING (item) LEFT JOIN s USING (item) LEFT JOIN x USING (item)) SELECT item, round(p, 6) AS p, CASE WHEN p IS NULL THEN 'insufficient_evidence' WHEN p >= 0.8 AND disputed THEN 'partially_verified' WHEN p >= 0.8 THEN 'verified' WHEN p <= 0.2 THEN 'refuted' WHEN up AND down THEN 'conflicting' ELSE 'unverified' END AS label FROM a",
)
_ZONE = "CASE WHEN {p} IS NULL THEN 'none' WHEN {p} >= 0.8 THEN 'yes' WHEN {p} <= 0.2 THEN 'no' ELSE 'open' END"
_add("triage_zone", lambda v, o: fusion.scores(v, o).select("item", fusion.zone(fusion.sigmoid(F.col("z"))).alias("zone"), checks.percent(F.bround(fusion.sigmoid(F.col("z")), 6)).alias("shown")), _SCORES + f", q AS (SELECT item, {_SIG.format(z='z')} AS p, round_even({_SIG.format(z='z')}, 6) AS r FROM z) SELECT item, {_ZONE.format(p='p')} AS zone, CASE WHEN r >= 0.995 THEN '>99%' WHEN r <= 0.005 THEN '<1%' ELSE round_even(r * 100, 0)::INT || '%' END AS shown FROM q")
_add(
    "check_value",
    lambda v, o: fusion.check_value(v, o),
    _SCORES + f", r AS (SELECT coalesce(max(type_rate) FILTER (source_type = 'field'), 0.8) AS r FROM tr), a AS (SELECT i.item, r, CASE WHEN z.z IS NOT NULL THEN {_SIG.format(z='z.z')} END AS p, {_SIG.format(z='coalesce(z.z, 0) + ln(r / (1 - r))')} AS plus, {_SIG.format(z='coalesce(z.z, 0) - ln(r / (1 - r))')} AS minus FROM (SELECT DISTINCT item FROM votes) i LEFT JOIN z USING (item), r), b AS (SELECT *, CASE WHEN p IS NULL THEN 0.5 ELSE p * r + (1 - p) * (1 - r) END AS chance FROM a), c AS (SELECT *, CASE WHEN p IS NULL THEN 1 ELSE chance * ({_ZONE.format(p='plus')} <> {_ZONE.format(p='p')})::INT + (1 - chance) * ({_ZONE.format(p='minus')} <> {_ZONE.format(p='p')})::INT END AS changes, CASE WHEN p IS NULL THEN 1 ELSE 1 - abs(2 * p - 1) END AS unsure FROM b) SELECT item, round(chance, 6) AS chance, round(changes, 6) AS changes, round((unsure + changes) / 2, 6) AS need FROM c",
)
_CHAIN = "w(node, root) AS (SELECT vote_id, coalesce(copy_of, vote_id) FROM votes UNION SELECT w.node, coalesce(v.copy_of, v.vote_id) FROM w JOIN votes v ON v.vote_id = w.root WHERE v.copy_of IS NOT NULL), roots AS (SELECT node, min(root) AS root FROM w GROUP BY node)"


def _add_roots(name: str, query: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    _add(name, query, ", " + _CHAIN + sql)
    ORACLE_SQL[name] = ORACLE_SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)


_add_roots("root_of_chain", lambda v, o: fusion.roots(v, "vote_id", "copy_of"), " SELECT node, root FROM roots")
_add_roots(
    "independent_votes",
    lambda v, o: fusion.independent(v).select("item", "root", "vote_id", "vote"),
    " SELECT item, root, arg_min(vote_id, ((vote_id <> root)::INT, seen, vote_id)) AS vote_id, arg_min(vote, ((vote_id <> root)::INT, seen, vote_id)) AS vote FROM votes JOIN roots ON node = vote_id WHERE vote IS NOT NULL GROUP BY item, root",
)
_add_roots("story_weights", lambda v, o: fusion.weighted_by_story(v).select("vote_id", F.round("weight", 6).alias("weight")), " SELECT vote_id, round(1 / count(*) OVER (PARTITION BY item, root), 6) AS weight FROM votes JOIN roots ON node = vote_id")
_add_roots(
    "value_strategies",
    lambda v, o: fusion.four_values(v.join(fusion.roots(v, "vote_id", "copy_of"), v["vote_id"] == F.col("node")).selectExpr("item", "floor(stated / 25) AS v", "seen", "root", "vote_id % 7 + 1 AS w"), "item", "v", "seen", "root", "w"),
    ", q AS (SELECT item, floor(stated / 25)::BIGINT AS v, seen, root, vote_id % 7 + 1 AS w FROM votes JOIN roots ON node = vote_id), o AS (SELECT item, root, v, min(seen) AS seen FROM q GROUP BY ALL), f AS (SELECT item, arg_min(v, (seen, v)) AS first FROM q GROUP BY item), m AS (SELECT item, arg_min(v, (-n, s, v)) AS majority FROM (SELECT item, v, count(*) AS n, min(seen) AS s FROM q GROUP BY ALL) GROUP BY item), c AS (SELECT item, arg_min(v, (-n, s, v)) AS per_cascade FROM (SELECT item, v, count(*) AS n, min(seen) AS s FROM o GROUP BY ALL) GROUP BY item), x AS (SELECT item, arg_min(v, (-n, s, v)) AS weighted FROM (SELECT item, v, sum(w) AS n, min(seen) AS s FROM q GROUP BY ALL) GROUP BY item) SELECT * FROM f JOIN m USING (item) JOIN c USING (item) JOIN x USING (item)",
)
_add("cycle_check", lambda v, o: checks.cycles(v.selectExpr("vote_id AS node", "IF(vote_id % 10 < 4, vote_id - vote_id % 10 + (vote_id + 1) % 4, vote_id - 3) AS up"), "node", "up"), ", n AS MATERIALIZED (SELECT vote_id AS node, CASE WHEN vote_id % 10 < 4 THEN vote_id - vote_id % 10 + (vote_id + 1) % 4 ELSE vote_id - 3 END AS up FROM votes), w(node, place) AS (SELECT node, up FROM n UNION SELECT w.node, n.up FROM w JOIN n ON n.node = w.place), c AS (SELECT node FROM w WHERE node = place), r AS (SELECT w.node, w.place FROM w JOIN c ON c.node = w.place), m AS (SELECT node, min(place) AS root FROM r GROUP BY node), o AS (SELECT m.* FROM m JOIN n USING (node)) SELECT root, count(*) AS n_nodes FROM o WHERE root NOT IN (SELECT node FROM n WHERE node = up) GROUP BY root")
ORACLE_SQL["cycle_check"] = ORACLE_SQL["cycle_check"].replace("WITH ", "WITH RECURSIVE ", 1)
_DISPUTE = ", q AS (SELECT item, stated AS v, seen FROM votes), p AS (SELECT a.item FROM q a JOIN q b ON a.item = b.item AND b.seen - a.seen BETWEEN 0 AND 43200 AND (a.seen < b.seen OR a.v < b.v) WHERE abs(a.v - b.v) > 0.2 * greatest(abs(a.v), abs(b.v))) SELECT item, count(*) AS n_pairs FROM p GROUP BY item"
_add("dispute_pairs", lambda v, o: fusion.disputed(v, "item", "stated", "seen"), _DISPUTE)
_add(
    "weighted_mode",
    lambda v, o: fusion.weighted_mode(v.selectExpr("item", "relation", "vote_id % 5 + 1 AS w", "seen"), "item", "relation", "w", "seen"),
    ", q AS (SELECT item, relation, sum(vote_id % 5 + 1) AS w, min(seen) AS s FROM votes GROUP BY ALL) SELECT item, arg_min(relation, (-w, s, relation)) AS mode FROM q GROUP BY item",
)
_ROUND = ", t{k} AS (SELECT source, (sum(f * p + (n - f) * (1 - p)) + 3.5) / (sum(n) + 5) AS trust FROM c JOIN (SELECT item, 1 / (1 + exp(-greatest(-30, least(30, z)))) AS p FROM z{j}) USING (item) GROUP BY source), z{k} AS (SELECT item, sum(net * ln(greatest(0.0001, least(0.9999, trust)) / (1 - greatest(0.0001, least(0.9999, trust))))) AS z FROM c JOIN t{k} USING (source) GROUP BY item)"
_add(
    "truthfinder",
    lambda v, o: fusion.truthfinder(v),
    ", c AS MATERIALIZED (SELECT item, source, sum(vote)::DOUBLE AS net, count(*) FILTER (vote > 0)::DOUBLE AS f, count(*)::DOUBLE AS n FROM votes WHERE vote IS NOT NULL GROUP BY ALL), z0 AS (SELECT item, sum(net * ln(0.7e0 / 0.3e0)) AS z FROM c GROUP BY item)" + "".join(_ROUND.format(k=k, j=k - 1).replace("AS (", "AS MATERIALIZED (") for k in range(1, 30)) + " SELECT item, round(z, 4) AS log_odds FROM z29",
)
_EM = (
    ", r{k} AS MATERIALIZED (SELECT source, (sum(p * f) + 2) / (sum(p * (f + a)) + 3) AS sens, (sum((1 - p) * a) + 2) / (sum((1 - p) * (f + a)) + 3) AS spec FROM c JOIN p{j} USING (item) GROUP BY source)"
    ", n{k} AS (SELECT item, 1 / (1 + exp(-greatest(-50, least(50, sum(f * ln(sens / (1 - spec)) + a * ln((1 - sens) / spec)) + any_value(ln(m.b / (1 - m.b))))))) AS np FROM c JOIN r{k} USING (source), m{j} m GROUP BY item)"
    ", p{k} AS MATERIALIZED (SELECT item, CASE WHEN done THEN p ELSE np END AS p, done OR max(abs(np - p)) OVER () < 1e-6 AS done FROM p{j} JOIN n{k} USING (item)), m{k} AS MATERIALIZED (SELECT greatest(0.02, least(0.98, avg(p))) AS b FROM p{k})"
)
_add(
    "dawid_skene",
    lambda v, o: fusion.dawid_skene(v),
    ", c AS MATERIALIZED (SELECT item, source, count(*) FILTER (vote > 0)::DOUBLE AS f, count(*) FILTER (vote < 0)::DOUBLE AS a FROM votes WHERE vote IS NOT NULL GROUP BY ALL), p0 AS MATERIALIZED (SELECT item, (sum(f) + 1) / (sum(f + a) + 2) AS p, false AS done FROM c GROUP BY item), m0 AS (SELECT 0.5e0 AS b)" + "".join(_EM.format(k=k, j=k - 1) for k in range(1, 51)) + " SELECT item, round(p, 4) AS p FROM p50",
)
_DAY_END = 1706659200  # the end of the last day of the votes
_add(
    "rising_count",
    lambda v, o: fusion.rising(fusion.rated_votes(v, o).where("rate >= 0.5 AND vote > 0").join(v.select("vote_id", "seen"), "vote_id").selectExpr("source AS item", "seen AS at", "CAST(floor(stated / 4) AS double) AS count"), _DAY_END),
    _SCORES + f", q AS (SELECT rv.source AS item, max(c) FILTER (seen < {_DAY_END - 86400}) AS before, max(c) FILTER (seen >= {_DAY_END - 86400}) AS since FROM rv JOIN (SELECT vote_id, seen, floor(stated / 4) AS c FROM votes) USING (vote_id) WHERE rate >= 0.5 AND vote > 0 AND seen <= {_DAY_END} GROUP BY 1) SELECT * FROM q WHERE since > before * 1.2e0",
)
QUERIES["weighted_median"] = lambda s, d: fusion.weighted_median(read_table(s, d, "lineitem"), "l_suppkey", "l_quantity", "l_linenumber").withColumn("median", F.col("median").cast("double"))
ORACLE_SQL["weighted_median"] = "WITH v AS (SELECT l_suppkey, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL), r AS (SELECT l_suppkey, l_quantity, sum(w) OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS up, sum(w) OVER (PARTITION BY l_suppkey) AS al FROM v) SELECT l_suppkey, CAST(min(l_quantity) AS DOUBLE) AS median FROM r WHERE 2 * up >= al GROUP BY l_suppkey"
