"""Stories from a stream of texts, models fitted on them, calibration and tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.geo import haversine_sql
from tessera.operators import clustering, fusion, graphs, inference, learning, similar, textual, triage
from tessera.plans.bindings import bound, with_ctes
from tessera.session import read_table, stored

from .fusion import _RATES, _SCORES, ORACLE_SQL as votes_sql
from .text import _BM, _WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str = "", tables: tuple[str, ...] = ()) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, (with_ctes(list(tables), sql) if tables else sql)


#: A document is an item of the stream: the time, place, type and reach are those of the event of the same number.
def _items(s: SparkSession, d: str) -> DataFrame:
    texts = read_table(s, d, "documents").select("doc_id", "text", "source")
    events = read_table(s, d, "events").selectExpr("event_id", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS t", "IF(event_id % 9 = 0, NULL, 20.5e0 + ((user_id * 7) % 31) / 10e0) AS lat", "IF(event_id % 9 = 0, NULL, 88e0 + ((user_id * 11) % 23) / 10e0) AS lon", "value / 10 AS reach", "IF(event_id % 8 = 0, NULL, event_id % 3) AS type")
    return texts.join(events, F.col("doc_id") == F.col("event_id")).select(F.col("doc_id").alias("id"), "t", "lat", "lon", "reach", "type", "text")


_ITEMS = "items AS MATERIALIZED (SELECT doc_id AS id, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 9 <> 0 THEN 20.5e0 + ((user_id * 7) % 31) / 10e0 END AS lat, CASE WHEN event_id % 9 <> 0 THEN 88e0 + ((user_id * 11) % 23) / 10e0 END AS lon, value / 10 AS reach, CASE WHEN event_id % 8 <> 0 THEN event_id % 3 END AS type, text FROM documents JOIN events ON doc_id = event_id)"
_VECTORS = r""", wc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[\s.,;:!?''"()\[\]{}।/\\|–—-]+')) AS term FROM items) WHERE term <> '' GROUP BY ALL), wi AS (SELECT term, ln((1 + (SELECT count(*) FROM items)) / (1 + count(*))) + 1 AS idf FROM wc GROUP BY 1), wv AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM wc JOIN wi USING (term)), v AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM wv)"""


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return similar.weighted_terms(_items(s, d), "id", F.filter(F.split(F.lower("text"), textual.SPLIT), lambda w: w != ""))


def _clusters(s: SparkSession, d: str, least: float = 0.5) -> DataFrame:
    vectors = _vectors(s, d)
    items = clustering.items_with_terms(_items(s, d), vectors)
    return clustering.online(items, clustering.rule_links(items, vectors, least), clustering.by_mean(least))


_add("online_clusters", lambda s, d: _clusters(s, d).select("id", "label"))
_add(
    "similar_documents",
    lambda s, d: _similar(s, d),
    "WITH " + _ITEMS + _VECTORS + ", f AS (SELECT id, sha256(lower(text)) AS mark FROM items), u AS MATERIALIZED (SELECT v.* FROM v WHERE id IN (SELECT min(id) FROM f GROUP BY mark)) SELECT a.id AS a, b.id AS b, round_even(sum(a.w * b.w), 4) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8",
)


def _similar(s: SparkSession, d: str) -> DataFrame:
    """Pairs between texts that differ; of equal ones the first stands for all."""
    vectors = _vectors(s, d)
    first = stored(_items(s, d).groupBy(F.sha2(F.lower("text"), 256)).agg(F.min("id").alias("id")).select("id"), "stories-first")
    return similar.similar_pairs(vectors.join(first, "id"), 0.8).select("a", "b", F.bround("cosine", 4).alias("cosine"))


def _gold(s: SparkSession, d: str) -> DataFrame:
    """A gold story: documents of a source in a week about one type."""
    return _items(s, d).join(read_table(s, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id").select("id", F.expr("concat_ws('|', source, cast(floor(t / 604800) AS long), cast(id % 5 AS string))").alias("cluster"))


_GOLD = ", gold AS MATERIALIZED (SELECT id, concat_ws('|', source, floor(t / 604800)::BIGINT, id % 5) AS cluster FROM items JOIN documents ON doc_id = id)"


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Each item with its own story and that of the item before it."""
    gold = _gold(s, d)
    return gold.union(gold.selectExpr("id + 1 AS id", "cluster").join(gold.select("id"), "id", "left_semi")).distinct()


_FEATURES_SQL = (
    "WITH " + _ITEMS + _VECTORS + _GOLD + ", asked AS (SELECT id, cluster FROM gold UNION SELECT id + 1, cluster FROM gold WHERE id + 1 IN (SELECT id FROM gold))"
    ", m AS MATERIALIZED (SELECT gold.cluster, items.* FROM items JOIN gold USING (id))"
    ", r AS MATERIALIZED (SELECT i.id AS my_id, i.t AS my_t, i.type AS my_type, " + haversine_sql("i.lat", "i.lon", "m.lat", "m.lon") + " AS km, i.reach + m.reach AS reaches, m.* FROM asked JOIN items i USING (id) JOIN m ON m.cluster = asked.cluster AND (m.t, m.id) < (i.t, i.id))"
    ", p AS (SELECT DISTINCT my_id, id FROM r UNION SELECT a.id, b.id FROM m a JOIN m b ON a.cluster = b.cluster AND (b.t, b.id) < (a.t, a.id))"
    ", c AS MATERIALIZED (SELECT my_id, p.id, sum(a.w * b.w) AS cos FROM p JOIN v a ON a.id = my_id JOIN v b ON b.id = p.id AND b.term = a.term GROUP BY 1, 2)"
    ", g AS (SELECT a.id, sum(cos) AS with_sum FROM m a JOIN m b ON a.cluster = b.cluster AND (b.t, b.id) < (a.t, a.id) JOIN c ON c.my_id = a.id AND c.id = b.id GROUP BY 1)"
    ", x AS (SELECT r.my_id AS id, cluster, sum(least(coalesce(cos, 0), 1)) / sqrt(sum(1 + 2 * coalesce(with_sum, 0))) AS centroid, max(least(coalesce(cos, 0), 1)) AS mc, (any_value(my_t) - max(t)) / 3600 AS since, (any_value(my_t) - min(t)) / 3600 AS age, (max(t) - min(t)) / 3600 / greatest(count(*) - 1, 1) AS gap, count(*) AS n, min(km) AS km, min(km / (1 + reaches)) AS scaled, count(*) FILTER (type = my_type) AS same, count(type = my_type) AS known FROM r LEFT JOIN g ON g.id = r.id LEFT JOIN c ON c.my_id = r.my_id AND c.id = r.id GROUP BY 1, 2)"
    " SELECT id, cluster, round_even(centroid, 4) AS centroid_cos, round_even(mc, 4) AS max_cos, round_even(ln(1 + since), 4) AS log_hours_newest, round_even(ln(1 + age), 4) AS log_hours_oldest, round_even(ln(n), 4) AS log_size, (km IS NOT NULL)::INT::DOUBLE AS any_located, round_even(coalesce(ln(1 + km), 0), 4) AS log_min_km, round_even(coalesce(ln(1 + scaled), 0), 4) AS log_min_scaled_km, round_even(same / greatest(known, 1), 4) AS same_type_share, (known = 0)::INT::DOUBLE AS type_unknown, round_even(centroid * ln(1 + since), 4) AS cos_x_recency, round_even(ln(1 + since / (gap + 1)), 4) AS log_gap_ratio FROM x"
)


def _stream(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items without their texts, their vectors and gold stories, each computed once."""
    return stored(_items(s, d).drop("text"), "stories-items"), _vectors(s, d), stored(_gold(s, d), "stories-gold")


def _features(s: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    items, vectors, gold = _stream(s, d)
    return clustering.cluster_features(items, vectors, gold, asked)


_add("cluster_features", lambda s, d: _features(s, d, _asked(s, d)).select("id", "cluster", *[F.bround(c, 4).alias(c) for c in clustering.FEATURES]), _FEATURES_SQL)


def _decided(items: DataFrame, gold: DataFrame, alike: DataFrame) -> DataFrame:
    """What a model learns from: the decisions that the gold stories give; alike: a, b, cosine."""
    both = alike.select("a", "b", "cosine").union(alike.select("b", "a", "cosine"))
    near = both.join(gold.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"), "cluster").agg(F.max("cosine").alias("cos"))
    return stored(clustering.decisions(items, gold, near), "stories-decisions")


def _model(features: DataFrame, pairs: DataFrame) -> dict:
    return inference.fit_logistic(features.join(pairs, ["id", "cluster"]), clustering.FEATURES)


def _modelled(s: SparkSession, d: str, links: float = 0.3) -> DataFrame:
    """Clusters of the whole stream by a model fitted on the gold stories; links are texts alike within a week."""
    items, vectors, gold = _stream(s, d)
    alike = similar.similar_pairs(vectors, links)
    t = items.select("id", "t")
    pairs = alike.join(t.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").where("abs(ta - tb) <= 604800").select("a", "b")
    learned = _decided(items, gold, alike)
    model = _model(clustering.cluster_features(items, vectors, gold, learned.select("id", "cluster")), learned)
    return clustering.online(clustering.items_with_terms(items, vectors), pairs, clustering.by_model(model, 0.5), open_hours=168.0)


_add("modelled_clusters", lambda s, d: _modelled(s, d).select("id", "label"))
_EDGES = "SELECT vote_id AS a, vote_id - 97 AS b FROM votes WHERE vote_id % 7 = 0 AND vote_id > 97 UNION ALL SELECT vote_id, vote_id - 1000 FROM votes WHERE vote_id % 11 = 0 AND vote_id > 1000"


def _edges(s: SparkSession, d: str) -> DataFrame:
    v = bound(s, d, "votes")
    return v.where("vote_id % 7 = 0 AND vote_id > 97").selectExpr("vote_id AS a", "vote_id - 97 AS b").union(v.where("vote_id % 11 = 0 AND vote_id > 1000").selectExpr("vote_id AS a", "vote_id - 1000 AS b"))


_add("connected_components", lambda s, d: graphs.connected(_edges(s, d)), f", e AS ({_EDGES}), b AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), w(node, low) AS (SELECT a, a FROM b UNION SELECT b.b, w.low FROM w JOIN b ON b.a = w.node) SELECT node, min(low) AS component FROM w GROUP BY node", ("votes",))
ORACLE_SQL["connected_components"] = ORACLE_SQL["connected_components"].replace("WITH ", "WITH RECURSIVE ", 1)


# Jaccard joins of whole texts' words, and claims that repeat earlier ones
def _word_sets(s: SparkSession, d: str) -> DataFrame:
    """The distinct words of each different text; of equal texts the first."""
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("id"), F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9ঀ-৿]+"), F.lit(0)))).alias("words"))
    first = docs.where(F.size("words") > 0).groupBy("words").agg(F.min("id").alias("id"))
    return first.select("id", F.explode("words").alias("term"))


_SETS = r"WITH w AS (SELECT doc_id AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{0980}-\x{09FF}]+'))) AS words FROM documents), u AS MATERIALIZED (SELECT min(id) AS id, words FROM w WHERE len(words) > 0 GROUP BY words), t AS MATERIALIZED (SELECT id, unnest(words) AS term, len(words) AS n FROM u)"
_add("word_jaccard_join", lambda s, d: similar.similar_sets(stored(_word_sets(s, d), "stories-words"), 0.6).select("a", "b", F.bround("jaccard", 6).alias("jaccard")), _SETS + " SELECT a.id AS a, b.id AS b, round_even(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard FROM t a JOIN t b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6")


def _claims(s: SparkSession, d: str) -> DataFrame:
    """A document's first line is its claim's title, the day is that of the event of its number."""
    events = read_table(s, d, "events").selectExpr("event_id AS id", "IF(event_id % 10 = 0, NULL, CAST(ts AS DATE)) AS day")
    return read_table(s, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title")).join(events, "id")


_add(
    "claim_hints",
    lambda s, d: similar.claim_hints(_claims(s, d)),
    r"""WITH RECURSIVE c AS MATERIALIZED (SELECT doc_id AS id, regexp_extract(text, '^[^.!?\n]*', 0) AS title, CASE WHEN event_id % 10 <> 0 THEN ts::DATE END AS day FROM documents JOIN events ON doc_id = event_id), t AS MATERIALIZED (SELECT id, unnest(list_distinct([w for w in regexp_split_to_array(lower(title), '[\s"''‘’“”:;,.!?।()\[\]{}|/—–-]+') if length(w) > 1])) AS term FROM c), k AS MATERIALIZED (SELECT t.* FROM t WHERE term IN (SELECT term FROM t GROUP BY 1 HAVING count(*) <= greatest(3, floor((SELECT count(*) FROM c) * 0.1)))), z AS MATERIALIZED (SELECT id, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 3), q AS MATERIALIZED (SELECT id, day, n, term FROM z JOIN c USING (id) JOIN k USING (id) WHERE day IS NOT NULL), p AS (SELECT b.id, a.id AS up, any_value(a.day) AS day FROM q a JOIN q b ON a.term = b.term AND (a.day, a.id) < (b.day, b.id) AND b.day - a.day <= 3 GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5), f AS MATERIALIZED (SELECT id, arg_min(up, (day, up)) AS up FROM p GROUP BY 1), w(id, same) AS (SELECT id, up FROM f UNION ALL SELECT w.id, f.up FROM w JOIN f ON f.id = w.same) SELECT id, arg_min(same, (day, same)) AS same FROM w JOIN (SELECT id AS same, day FROM c) USING (same) GROUP BY id""",
)


# Models, calibrators and tests
def _scored(s: SparkSession, d: str) -> DataFrame:
    """Whether a text is of good quality, by what can be counted in it."""
    words = F.greatest(F.size(F.split(F.trim("text"), r"\s+")), F.lit(1))
    docs = read_table(s, d, "documents").select(
        F.col("doc_id").alias("id"), F.log1p(F.length("text")).alias("log_chars"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / words).alias("capitals"),
        (F.length(F.regexp_replace("text", r"[^.,;:!?]", "")) / words).alias("marks"), (F.length(F.regexp_replace("text", "[^0-9]", "")) / words).alias("digits"), (F.size(F.array_distinct(F.split(F.lower("text"), r"\s+"))) / words).alias("variety"),
    )
    return docs.join(read_table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y")), "id").withColumn("fold", F.pmod("id", F.lit(5)))


_COUNTED = ["log_chars", "capitals", "marks", "digits", "variety"]


def _weights(s: SparkSession, d: str) -> DataFrame:
    model = inference.fit_logistic(_scored(s, d), _COUNTED)
    rows = [(n, round(m, 6), round(c, 6)) for n, m, c in zip(model["names"], model["mean"], model["coef"], strict=True)] + [("intercept", 0.0, round(model["intercept"], 6))]
    return s.createDataFrame(rows, "name string, mean double, coef double")


_add("logistic_weights", _weights)
_add("out_of_fold_scores", lambda s, d: inference.out_of_fold(_scored(s, d), _COUNTED, "fold").select("id", "fold", "y", F.bround("score", 6).alias("score")))


def _calibrated(s: SparkSession, d: str) -> DataFrame:
    scored = inference.out_of_fold(_scored(s, d), _COUNTED, "fold")
    return inference.stepped(scored, inference.isotonic(scored)).select("id", F.bround("p", 6).alias("p"))


_add("out_of_fold_isotonic", _calibrated)
_F = ("forecasts",)
_add(
    "isotonic_calibration",
    lambda s, d: inference.stepped(bound(s, d, "forecasts").selectExpr("id", "p AS score", "y"), inference.isotonic(bound(s, d, "forecasts").selectExpr("p AS score", "y"))).select("id", F.bround("p", 6).alias("p")),
    ", g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p) AS k, p, n, t, sum(n) OVER (ORDER BY p) AS un, sum(t) OVER (ORDER BY p) AS ut FROM (SELECT p, count(*) AS n, sum(y) AS t FROM forecasts GROUP BY p)), m AS (SELECT b.k, min((b.ut - a.ut + a.t) / (b.un - a.un + a.n)) OVER (PARTITION BY a.k ORDER BY b.k DESC) AS low FROM g a JOIN g b ON a.k <= b.k), v AS (SELECT k, max(low) AS p FROM m GROUP BY k) SELECT id, round_even(v.p, 6) AS p FROM forecasts f JOIN g ON g.p = f.p JOIN v USING (k)",
    _F,
)
_TEMPERATURE = "".join(f", t{k} AS MATERIALIZED (SELECT any_value(a) - (sum((q - y) * x) + any_value(a) / 100) / (sum(q * (1 - q) * x * x) + 0.01) AS a FROM (SELECT x, y, a, 1 / (1 + exp(-greatest(-50, least(50, a * x)))) AS q FROM z, t{k - 1}))" for k in range(1, 13))
_add(
    "temperature_calibration",
    lambda s, d: s.createDataFrame([(round(inference.temperature(bound(s, d, "forecasts").selectExpr("p * 6 - 3 AS score", "y")), 6),)], "a double"),
    ", z AS MATERIALIZED (SELECT p * 6 - 3 AS x, y FROM forecasts), t0 AS (SELECT 0e0 AS a)" + _TEMPERATURE + " SELECT round(a, 6) AS a FROM t12",
    _F,
)
_add(
    "paired_bootstrap",
    lambda s, d: inference.paired_bootstrap(bound(s, d, "forecasts").selectExpr("id", "(p - y) * (p - y) AS a", "(0.5D - y) * (0.5D - y) AS b"), 200, 7),
    ", l AS (SELECT id, (0.5 - y) * (0.5 - y) - (p - y) * (p - y) AS d FROM forecasts), h0 AS (SELECT d, r, (id % 2147483647 * 48271 + r * 69621 + 7 * 16807) % 2147483647 AS h FROM l, (SELECT unnest(range(1, 201)) AS r)), h1 AS (SELECT d, r, (h * h + r * 48271 + 12345) % 2147483647 * 69621 % 2147483647 AS h FROM h0), h2 AS (SELECT d, r, (h * h + r * 48272 + 12345) % 2147483647 * 69621 % 2147483647 AS h FROM h1), c AS (SELECT d, r, "
    + " + ".join(f"(h / 2147483647.0::DOUBLE >= {t!r}::DOUBLE)::INT" for t in inference.POISSON)
    + " AS n FROM h2), m AS (SELECT r, sum(n * d) / sum(n) AS m FROM c GROUP BY r) SELECT (SELECT count(*) FROM l) AS n, round_even((SELECT avg(d) FROM l), 5) AS diff, round_even(quantile_cont(m, 0.025), 5) AS ci_low, round_even(quantile_cont(m, 0.975), 5) AS ci_high, least(1, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))) AS p_value FROM m",
    _F,
)


def _daily(s: SparkSession, d: str) -> DataFrame:
    """A run a day; how two kinds of events differ in it, for two measures."""
    e = read_table(s, d, "events").withColumn("day", F.col("ts").cast("date"))
    per = e.groupBy("day").agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(f"v_{k}") for k in ("view", "click")], *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in ("view", "click")])
    return per.selectExpr("day", "stack(2, 'mean', bround(v_view - v_click, 6), 'count', cast(n_view - n_click AS double)) AS (metric, d)")


_add(
    "wilcoxon_signed_rank",
    lambda s, d: inference.wilcoxon(_daily(s, d), "metric", "d"),
    "WITH RECURSIVE e AS (SELECT ts::DATE AS day, avg(value) FILTER (event_type = 'view') - avg(value) FILTER (event_type = 'click') AS v, (count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'click'))::DOUBLE AS n FROM events GROUP BY 1), x AS (SELECT 'mean' AS metric, round_even(v, 6) AS d FROM e UNION ALL SELECT 'count', n FROM e), r AS MATERIALIZED (SELECT metric, d, (2 * rank() OVER (PARTITION BY metric ORDER BY abs(d)) + count(*) OVER (PARTITION BY metric, abs(d)) - 1)::BIGINT AS twice, row_number() OVER (PARTITION BY metric ORDER BY abs(d)) AS k FROM x WHERE round(abs(d), 9) > 0), f(metric, k, v, p) AS (SELECT DISTINCT metric, 0::BIGINT, 0::BIGINT, 1e0 FROM r UNION ALL SELECT metric, k, v, sum(p) / 2 FROM (SELECT f.metric, r.k, unnest([v, v + twice]) AS v, p FROM f JOIN r ON r.metric = f.metric AND r.k = f.k + 1) GROUP BY metric, k, v), s AS (SELECT metric, count(*) AS n, sum(twice) FILTER (d > 0) AS w, sum(twice) AS t FROM r GROUP BY 1) SELECT metric, n::INT AS n, w / 2 AS w, round_even(least(1, 2 * (SELECT sum(p) FROM f WHERE f.metric = s.metric AND f.k = s.n AND v <= least(w, t - w))), 9) AS p FROM s",
)
_V = ("votes", "outcomes")
_LATEST_ALL = ", l AS MATERIALIZED (SELECT item, source, arg_max(vote, (seen, vote_id)) > 0 AS up FROM votes WHERE vote IS NOT NULL GROUP BY item, source)"


def _sensing_sql(silence: bool, known: bool, rounds: int = 100) -> str:
    """The rounds of the estimation, each as three tables; when no belief moves, the beliefs stay."""
    fixed = "(SELECT happened FROM outcomes o WHERE o.item = {t}.item)" if known else "NULL"
    sql = _LATEST_ALL + f", i0 AS MATERIALIZED (SELECT item, coalesce({fixed.format(t='l')}, (count(*) FILTER (up) + 1) / (count(*) + 2))::DOUBLE AS q, {fixed.format(t='l')} AS fixed, 0e0 AS z, false AS done FROM l GROUP BY item), g0 AS MATERIALIZED (SELECT count(*) AS n, sum(q) AS total FROM i0)"
    st, sf = ("total - ut - dt", "n - total - uf - df") if silence else ("0e0", "0e0")
    for k in range(1, rounds + 1):
        j = k - 1
        sql += (
            f", s{k} AS (SELECT source, coalesce(sum(q) FILTER (up), 0) AS ut, coalesce(sum(1 - q) FILTER (up), 0) AS uf, coalesce(sum(q) FILTER (NOT up), 0) AS dt, coalesce(sum(1 - q) FILTER (NOT up), 0) AS df FROM l JOIN i{j} USING (item) GROUP BY source)"
            f", w{k} AS MATERIALIZED (SELECT source, ln((ut + 1) / (ut + dt + st + 3)) - ln((uf + 1) / (uf + df + sf + 3)) AS a, ln((dt + 1) / (ut + dt + st + 3)) - ln((df + 1) / (uf + df + sf + 3)) AS b, ln((st + 1) / (ut + dt + st + 3)) - ln((sf + 1) / (uf + df + sf + 3)) AS c FROM (SELECT *, {st} AS st, {sf} AS sf FROM s{k}, g{j}))"
            f", z{k} AS (SELECT item, sum(CASE WHEN up THEN a ELSE b END{' - c' if silence else ''}) + any_value(ln(d / (1 - d))){' + any_value((SELECT sum(c) FROM w%d))' % k if silence else ''} AS z FROM l JOIN w{k} USING (source), (SELECT greatest(0.001, least(0.999, total / n)) AS d FROM g{j}) GROUP BY item)"
            f", i{k} AS MATERIALIZED (SELECT item, CASE WHEN done THEN q ELSE nq END AS q, fixed, CASE WHEN done THEN oz ELSE nz END AS z, done OR max(abs(nq - q)) OVER () < 1e-6 AS done FROM (SELECT item, q, fixed, done, i{j}.z AS oz, z{k}.z AS nz, coalesce(fixed, 1 / (1 + exp(-greatest(-30, least(30, z{k}.z))))) AS nq FROM i{j} JOIN z{k} USING (item)))"
            f", g{k} AS MATERIALIZED (SELECT count(*) AS n, sum(q) AS total FROM i{k})"
        )
    return sql + f" SELECT item, round_even(z, 3) AS z FROM i{rounds}"


for _name, _silence, _known in (("social_sensing", True, False), ("social_sensing_spoken", False, False), ("social_sensing_supervised", True, True)):
    _add(_name, lambda s, d, silence=_silence, known=_known: fusion.social_sensing(bound(s, d, "votes"), silence, bound(s, d, "outcomes") if known else None).select("item", F.bround("z", 3).alias("z")), _sensing_sql(_silence, _known), _V)
_add(
    "vote_budget",
    lambda s, d: inference.budgeted(bound(s, d, "votes"), "item", "vote_id", 5, 3).select("item", "vote_id"),
    ", h0 AS (SELECT item, vote_id, (vote_id % 2147483647 * 48271 + 69621 + 3 * 16807) % 2147483647 AS h FROM votes), h1 AS (SELECT item, vote_id, (h * h + 48271 + 12345) % 2147483647 * 69621 % 2147483647 AS h FROM h0), h2 AS (SELECT item, vote_id, (h * h + 48272 + 12345) % 2147483647 * 69621 % 2147483647 AS h FROM h1) SELECT item, vote_id FROM h2 QUALIFY row_number() OVER (PARTITION BY item ORDER BY h, vote_id) <= 5",
    ("votes",),
)


# Copies by counted grams among the articles found for a question, and a balanced choice
def _found(s: SparkSession, d: str, top: int) -> DataFrame:
    return textual.bm25(read_table(s, d, "documents"), read_table(s, d, "benchmark").selectExpr("item_id", "text AS q"), "doc_id", "text", "item_id", top=top)


def _found_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of the twenty best articles of each question: a list is bounded."""
    found = _found(s, d, 20)
    return found.selectExpr("item_id", "doc_id AS a").join(found.selectExpr("item_id", "doc_id AS b"), "item_id").where("a < b").select("a", "b").distinct()


def _gram_cosines(s: SparkSession, d: str, pairs: DataFrame, least: float) -> DataFrame:
    asked = pairs.select("a").union(pairs.select("b")).distinct()
    docs = read_table(s, d, "documents").join(asked, F.col("doc_id") == F.col("a")).select(F.col("doc_id").alias("id"), "text")
    return similar.pair_cosines(similar.weighted_terms(docs, "id", similar.counted_grams(F.col("text")), idf=False), pairs).where(F.col("cosine") >= least)


def _copy_reasons(s: SparkSession, d: str) -> DataFrame:
    """An article's title is its first line, its agency its source."""
    pairs = stored(_found_pairs(s, d), "found-pairs")
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"), F.array("source").alias("agencies"))
    titles = docs.select("id", F.array_distinct(textual.words_of(F.col("title"))).alias("ws"))
    both = pairs.join(titles.selectExpr("id AS a", "ws AS wa"), "a").join(titles.selectExpr("id AS b", "ws AS wb"), "b")
    alike = both.where(textual.jaccard(F.col("wa"), F.col("wb")) >= 0.6).select("a", "b")
    return similar.copy_reasons(docs, _gram_cosines(s, d, pairs, 0.3), alike)


_BM_TOP = _BM + ", top AS (SELECT item_id, doc_id FROM r WHERE rank < 20), q2 AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM top x JOIN top y ON x.item_id = y.item_id AND x.doc_id < y.doc_id), t2 AS (SELECT doc_id AS id, substr(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 2000) AS t FROM documents WHERE doc_id IN (SELECT a FROM q2 UNION SELECT b FROM q2)), g2 AS (SELECT id, gram, count(*)::DOUBLE AS n FROM (SELECT id, unnest([substr(t, k, 4) for k in range(1, length(t) - 2)]) AS gram FROM t2) GROUP BY ALL), v2 AS MATERIALIZED (SELECT id, gram, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM g2), c2 AS MATERIALIZED (SELECT a, b, sum(x.w * y.w) AS cosine FROM q2 JOIN v2 x ON x.id = a JOIN v2 y ON y.id = b AND y.gram = x.gram GROUP BY 1, 2)".replace("\\\\", "\\")
_TITLES = ", w2 AS (SELECT doc_id AS id, source, list_distinct(" + _WORDS.format(c="regexp_extract(text, '^[^.!?\\n]*', 0)") + ") AS ws FROM documents)"
_add("gram_copies", lambda s, d: _gram_cosines(s, d, stored(_found_pairs(s, d), "found-pairs"), 0.6).select("a", "b", F.bround("cosine", 5).alias("cosine")), _BM_TOP + " SELECT a, b, round_even(cosine, 5) AS cosine FROM c2 WHERE cosine >= 0.6")
_add(
    "copy_reasons",
    _copy_reasons,
    _BM_TOP + _TITLES + " SELECT * FROM (SELECT q2.a, q2.b, CASE WHEN cosine >= 0.6 THEN 'text' WHEN cosine >= 0.3 AND x.source = y.source THEN 'agency' WHEN len(x.ws) > 0 AND len(y.ws) > 0 AND len(list_intersect(x.ws, y.ws)) / len(list_distinct(x.ws || y.ws)) >= 0.6 THEN 'title' END AS reason FROM q2 LEFT JOIN c2 ON c2.a = q2.a AND c2.b = q2.b JOIN w2 x ON x.id = q2.a JOIN w2 y ON y.id = q2.b) WHERE reason IS NOT NULL",
)


def _diverse(s: SparkSession, d: str) -> DataFrame:
    """Ten of each question's fifty best articles; an outlet is a source, a story a first line, one half of the languages German and French."""
    story = F.lower(F.regexp_extract("text", r"^[^.!?\n]*", 0))
    docs = read_table(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("outlet"), story.alias("story"), F.coalesce(F.col("lang").isin("de", "fr"), F.lit(False)).alias("bangla"))
    rows = _found(s, d, 50).join(docs, "doc_id")
    return inference.diverse(rows.select("item_id", F.col("doc_id").alias("id"), "rank", "story", "outlet", "bangla"), "item_id")


_add("diverse_pick", _diverse)


# What to check first, stances, and suggestions
def _incidents(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, "incidents").where("event_id % 5 < 3").selectExpr("CAST(event_id % 140 AS long) AS event_id", "status", "element_at(array('low', 'medium', 'high', 'critical'), cast(event_id % 4 AS int) + 1) AS priority", "element_at(array('unverified', 'verified', 'refuted', 'conflicting', 'insufficient_evidence'), cast(event_id % 5 AS int) + 1) AS assessment", "started").groupBy("event_id").agg(*[F.max_by(c, "started").alias(c) for c in ("status", "priority", "assessment")], F.max("started").alias("started"))


def _queue(s: SparkSession, d: str) -> DataFrame:
    requests = _incidents(s, d).where("event_id % 6 = 0").selectExpr("event_id", "event_id % 3 AS answers")
    return triage.review_queue(_incidents(s, d), bound(s, d, "votes"), bound(s, d, "outcomes"), requests).withColumn("reasons", F.array_join("reasons", "; "))


_PCT = "CASE WHEN {p} >= 0.995 THEN '>99%' WHEN {p} <= 0.005 THEN '<1%' ELSE round_even({p} * 100, 0)::INT || '%' END"
_P = "round_even(1 / (1 + exp(-greatest(-50, least(50, {z})))), 6)"
_QUEUE = (
    ", i AS (SELECT event_id % 140 AS event_id, arg_max(status, started) AS status, arg_max(['low', 'medium', 'high', 'critical'][event_id % 4 + 1], started) AS priority, arg_max(['unverified', 'verified', 'refuted', 'conflicting', 'insufficient_evidence'][event_id % 5 + 1], started) AS assessment, max(started) AS started FROM incidents WHERE event_id % 5 < 3 GROUP BY 1)"
    ", cv AS MATERIALIZED ({value}), lr AS MATERIALIZED ({label}), zs AS MATERIALIZED ({scores})"
    ", q AS (SELECT i.*, coalesce(lr.label, 'insufficient_evidence') AS suggested, coalesce(cv.changes, 1) AS changes, coalesce(cv.need, 1) AS need, z, r, CASE WHEN i.event_id % 6 = 0 THEN i.event_id % 3 END AS answers FROM i LEFT JOIN cv ON cv.item = i.event_id LEFT JOIN lr ON lr.item = i.event_id LEFT JOIN zs ON zs.item = i.event_id, ({rate}) WHERE status IN ('active', 'monitoring'))"
    ", t AS (SELECT *, round_even(list_position(['low', 'medium', 'high', 'critical'], priority) * need, 4) AS score, NOT (assessment IN ('unverified', 'insufficient_evidence') AND suggested IN ('unverified', 'insufficient_evidence')) AND assessment <> suggested AS differs FROM q)"
    ", o AS (SELECT *, row_number() OVER (ORDER BY score DESC, started DESC, event_id)::INT AS place FROM t)"
    " SELECT event_id, suggested, round_even(need, 4) AS need, score, differs, array_to_string(list_filter(['priority: ' || priority, CASE WHEN z IS NULL THEN 'no evidence yet' ELSE 'happened: ' || {p0} END, CASE WHEN z IS NOT NULL THEN 'after a report: ' || {p1} || ' or ' || {p2} END, CASE WHEN z IS NULL THEN NULL WHEN changes >= 0.995 THEN 'either answer changes the assessment' WHEN changes > 0 THEN 'changes the assessment: ' || {p3} ELSE 'one report changes nothing' END, CASE WHEN differs THEN 'team says ' || replace(assessment, '_', ' ') || ', evidence ' || replace(suggested, '_', ' ') END, 'answers so far: ' || answers], lambda x: x IS NOT NULL), '; ') AS reasons, place FROM o WHERE place <= 50"
)
_STEP = "ln(r / (1 - r))"
_add(
    "review_queue",
    _queue,
    _QUEUE.format(
        value=votes_sql["check_value"], label=votes_sql["label_rule"], scores=with_ctes(["votes", "outcomes"], _SCORES + " SELECT item, z FROM z"),
        rate=with_ctes(["votes", "outcomes"], _RATES + " SELECT coalesce(max(type_rate) FILTER (source_type = 'field'), 0.8) AS r FROM tr"),
        p0=_PCT.format(p=_P.format(z="z")), p1=_PCT.format(p=_P.format(z=f"z + {_STEP}")), p2=_PCT.format(p=_P.format(z=f"z - {_STEP}")), p3=_PCT.format(p="changes"),
    ),
    ("incidents",),
)
_PAIRED = ["event_id AS id", "(60 + event_id * 37 % 41) / 100e0 AS sim", "event_id * 13 % 11 / 10e0 AS entail", "event_id * 29 % 11 / 10e0 AS contra", "event_id % 5 AS correct", "event_id * 3 % 4 AS doubt", "CASE WHEN event_id * 37 % 41 < 20 THEN 'unrelated' WHEN event_id * 13 % 11 >= 5 THEN 'repeats' WHEN event_id * 29 % 11 >= 6 THEN 'corrects' ELSE 'mentions' END AS gold"]
_STANCE = "CASE WHEN sim < {sim} THEN 'unrelated' WHEN correct >= {strong} OR (contra >= {contra} AND correct >= {cues}) THEN 'corrects' WHEN doubt >= {cues} AND (contra >= {contra} / 2 OR entail >= {entail}) THEN 'questions' WHEN entail >= {entail} THEN 'repeats' WHEN contra >= {contra} THEN 'corrects' ELSE 'mentions' END"
_DEFAULT = {"sim": 0.8, "entail": 0.5, "contra": 0.5, "cues": 1, "strong": 1000000}
_add("stance_labels", lambda s, d: read_table(s, d, "events").selectExpr(*_PAIRED).select("id", triage.stance(*[F.col(c) for c in ("sim", "entail", "contra", "correct", "doubt")], {k: F.lit(v) for k, v in _DEFAULT.items()}).alias("stance")), f"SELECT id, {_STANCE.format(**_DEFAULT)} AS stance FROM (SELECT {', '.join(_PAIRED)} FROM events)")
_GRID_SQL = ", ".join(f"(SELECT unnest([{', '.join(f'{float(v)!r}::DOUBLE' for v in vs)}]) AS l_{k}, unnest(range({len(vs)})) AS k_{k})" for k, vs in triage.GRID.items())
_SIZES = [len(v) for v in triage.GRID.values()]
_PLACE = "(((k_sim * {1} + k_entail) * {2} + k_contra) * {3} + k_cues) * {4} + k_strong".format(*_SIZES)
_add(
    "stance_thresholds",
    lambda s, d: triage.tuned_stance(read_table(s, d, "events").selectExpr(*_PAIRED)),
    f"WITH g AS MATERIALIZED (SELECT *, ({_PLACE})::INT AS place FROM {_GRID_SQL}), c AS (SELECT sim, entail, contra, correct, doubt, gold, count(*) AS n FROM (SELECT {', '.join(_PAIRED)} FROM events) GROUP BY ALL), j AS (SELECT place, gold, said, sum(n) AS n FROM (SELECT place, gold, n, {_STANCE.format(sim='l_sim', entail='l_entail', contra='l_contra', cues='l_cues', strong='l_strong')} AS said FROM c, g) GROUP BY ALL), l AS (SELECT place, gold AS label, sum(n) AS g, coalesce(sum(n) FILTER (gold = said), 0) AS hit FROM j GROUP BY ALL), w AS (SELECT place, said AS label, sum(n) AS s FROM j GROUP BY ALL), f AS (SELECT l.place, round_even(avg(2 * hit / (l.g + coalesce(s, 0))), 6) AS macro_f1 FROM l LEFT JOIN w ON w.place = l.place AND w.label = l.label GROUP BY 1) SELECT place, l_sim AS sim, l_entail AS entail, l_contra AS contra, l_cues AS cues, l_strong AS strong, macro_f1 FROM f JOIN g USING (place) ORDER BY macro_f1 DESC, place LIMIT 1",
)


def _suggestions(s: SparkSession, d: str) -> DataFrame:
    """Stories suggested for each document: those of alike documents, scored by a model fitted on the gold stories."""
    items, vectors, gold = _stream(s, d)
    alike = similar.similar_pairs(vectors, 0.3)
    both = alike.select("a", "b").union(alike.select("b", "a"))
    asked = stored(both.join(gold.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "cluster").distinct(), "stories-asked")
    learned = _decided(items, gold, alike)
    features = clustering.cluster_features(items, vectors, gold, asked.union(learned.select("id", "cluster")).distinct())  # both in one go
    return triage.suggested(features.join(asked, ["id", "cluster"]), inference.line_of(_model(features, learned)))


_add("event_suggestions", _suggestions)


# Pairs of alike documents: their features, and their score by the rule
def _alike(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = _items(s, d).drop("text").withColumn("family", F.floor(F.col("type") / 2))
    return similar.similar_pairs(_vectors(s, d), 0.5), items


_ALIKE = "WITH " + _ITEMS + _VECTORS + ", p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM v a JOIN v b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.5), q AS (SELECT p.*, " + haversine_sql("x.lat", "x.lon", "y.lat", "y.lon") + " AS km, x.reach + y.reach AS reach, abs(x.t - y.t) / 3600 AS hours, x.type AS k, y.type AS m FROM p JOIN items x ON x.id = p.a JOIN items y ON y.id = p.b)"
_add(
    "pair_features",
    lambda s, d: learning.pair_features(*_alike(s, d)).select("a", "b", *[F.bround(c, 4).alias(c) for c in learning.PAIR_FEATURES]),
    _ALIKE + " SELECT a, b, round_even(cosine, 4) AS text_cos, (km IS NOT NULL)::INT::DOUBLE AS both_located, round_even(coalesce(ln(1 + km), 0), 4) AS log_km, round_even(coalesce(ln(1 + km / (1 + reach)), 0), 4) AS log_scaled_km, round_even(ln(1 + hours), 4) AS log_hours, coalesce(k = m, false)::INT::DOUBLE AS same_type, coalesce(k // 2 = m // 2, false)::INT::DOUBLE AS same_family, (k IS NULL OR m IS NULL)::INT::DOUBLE AS type_unknown FROM q",
)
_add(
    "rule_scorer",
    lambda s, d: learning.beside(*_alike(s, d)).select("a", "b", F.bround(learning.rule_score(F.col("cosine"), F.col("km"), F.col("reach_km"), F.col("hours")), 4).alias("score")),
    _ALIKE + " SELECT a, b, round_even(CASE WHEN hours > 48 OR coalesce(km, 0) > 5 + least(reach, 300) THEN 0 ELSE cosine END, 4) AS score FROM q",
)
