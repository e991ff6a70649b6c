"""Addresses of reports, what they are about and what they state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import links
from tessera.operators import assessment, claims, fusion
from tessera.plans.bindings import bound, with_ctes
from tessera.queries import fusion as _fusion
from tessera.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


_add(
    "page_links",
    lambda s, d: links.with_links(read_table(s, d, "pages").select("page_id", "url"), "url").select("page_id", "link.platform", "link.canonical", "link.opened", "link.domain", "link.external_id"),
    r"""WITH a AS (SELECT page_id, regexp_extract(url, '^https?', 0) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS place, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages), b AS (SELECT *, regexp_replace(lower(place), '^(www\.)?(m\.)?', '') AS domain, array_to_string(list_sort([x for x in string_split(query, '&') if contains(x, '=') and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|s|t|si|from|app)=')]), '&') AS kept FROM a), c AS (SELECT *, CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS q FROM b), e AS (SELECT *, 'https://' || domain || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END || q AS canonical FROM c) SELECT page_id, 'web' AS platform, canonical, scheme || '://' || place || path || q AS opened, domain, canonical AS external_id FROM e""",
)
#: The address of each event's post: by event_id % 10; {u} its user, {e} its number. Then what it says: platform, canonical form, post, account, video.
_POSTS = [
    ("https://m.facebook.com/story.php?story_fbid={e}&id={u}&mibextid=q", "facebook", "https://www.facebook.com/permalink.php?story_fbid={e}&id={u}", "{e}", "{u}", "false"),
    ("https://facebook.com/groups/g{u}/permalink/{e}/", "facebook", "https://www.facebook.com/groups/g{u}/posts/{e}", "{e}", "groups/g{u}", "false"),
    ("https://web.facebook.com/page{u}/videos/title/{e}?ref=x", "facebook", "https://www.facebook.com/page{u}/videos/{e}", "{e}", "page{u}", "true"),
    ("https://youtu.be/v{e}?si=q", "youtube", "https://www.youtube.com/watch?v=v{e}", "v{e}", None, "true"),
    ("https://www.youtube.com/shorts/v{e}", "youtube", "https://www.youtube.com/watch?v=v{e}", "v{e}", None, "true"),
    ("https://mobile.twitter.com/u{u}/status/{e}?s=20", "x", "https://x.com/u{u}/status/{e}", "{e}", "@u{u}", "false"),
    ("https://www.tiktok.com/@u{u}/video/{e}", "tiktok", "https://www.tiktok.com/@u{u}/video/{e}", "{e}", "@u{u}", "true"),
    ("https://instagram.com/reel/r{e}/?igsh=q", "instagram", "https://www.instagram.com/reel/r{e}", "r{e}", None, "true"),
    ("https://t.me/c{u}/{e}", "telegram", "https://t.me/c{u}/{e}", "c{u}/{e}", "c{u}", "false"),
    ("ftp://example.org/{e}", None, None, None, None, None),
]


def _filled(template: str | None, sql: bool) -> str:
    if template is None:
        return "NULL"
    text = "'" + template.replace("{u}", "' || user_id || '").replace("{e}", "' || event_id || '") + "'"
    return text if sql else text.replace("user_id", "CAST(user_id AS STRING)").replace("event_id", "CAST(event_id AS STRING)")


def _case(values: list[str], of: str = "event_id % 10") -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


_add(
    "post_links",
    lambda s, d: links.with_links(read_table(s, d, "events").select("event_id", F.expr(_case([_filled(p[0], False) for p in _POSTS])).alias("url")), "url").select("event_id", "link.platform", "link.canonical", "link.post_id", "link.account", "link.video"),
    "SELECT event_id, " + ", ".join(f"{_case([_filled(p[k], True) if c != 'video' else p[k] or 'NULL' for p in _POSTS])} AS {c}" for k, c in enumerate(("platform", "canonical", "post_id", "account", "video"), 1)) + " FROM events",
)

#: Headlines and texts of reports by event_id % 9, with {n} the event's number of people; then the kind of event, deaths, people affected, size, cause and state that they state.
_REPORTS = [
    ("Flash flood in the north", "At least {n} people were killed after heavy rain. Flood waters keep rising.", "flash_flood", "{n}", None, None, "heavy rain", "worsening"),
    ("Fire at the mill", "A massive fire after a short circuit; no casualties. It was brought under control.", "fire", "0", None, "large", "electrical short circuit", "resolved"),
    ("News of the day", "A flood came, then floods: {n} families were marooned in knee-deep water.", "flood", None, "{n}", "knee-deep", None, None),
    ("News of the day", "A flood was named once. Thousands went home.", None, None, None, None, None, None),
    ("Bus crash", "A head-on collision: {n} dead, {n} people stranded. Traffic still halted.", "road_accident", "{n}", "{n}", None, "vehicle collision", "ongoing"),
    ("সিলেটে বন্যায় ক্ষতি", "{n} জন নিহত, {n} পরিবার পানিবন্দি, কোমর পানি", "flood", "{n}", "{n}", "waist-deep", None, None),
    ("Earthquake felt", "The report is false, nobody was hurt.", "earthquake", "0", None, None, None, None),
    ("Market opens", "Trade was calm.", None, None, None, None, None, None),
    ("Hill torrents and a landslide", "{n} residents evacuated due to the torrential rain; water has receded", "flash_flood", None, "{n}", None, "heavy rain", "resolved"),
]


def _reports(s: SparkSession, d: str) -> DataFrame:
    """A report an event: event_id, headline, body."""
    n = F.expr("CAST(event_id % 900 + 1 AS STRING)")
    say = lambda k: F.replace(F.expr(_case(["'" + r[k].replace("'", "''") + "'" for r in _REPORTS], "event_id % 9")), F.lit("{n}"), n)
    return read_table(s, d, "events").select("event_id", say(0).alias("headline"), say(1).alias("body"))


def _sql_case(k: int) -> str:
    return _case(["NULL" if r[k] is None else "(event_id % 900 + 1)::VARCHAR" if r[k] == "{n}" else f"'{r[k]}'" for r in _REPORTS], "event_id % 9")


_add("event_kinds", lambda s, d: _reports(s, d).select("event_id", claims.event_kind(F.col("headline"), F.col("body")).alias("k")).select("event_id", "k.event_type", "k.in_headline"), f"SELECT event_id, {_sql_case(2)} AS event_type, CASE WHEN {_sql_case(2)} IS NOT NULL THEN event_id % 9 <> 2 END AS in_headline FROM events")
_ATTRIBUTES = ("casualty_count", "affected_count", "magnitude", "cause", "status")
_add(
    "claims",
    lambda s, d: claims.claim_rows(_reports(s, d), "event_id", "body").select("event_id", "attribute", "value"),
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT event_id, '{a}' AS attribute, {_sql_case(k)} AS value FROM events" for k, a in enumerate(_ATTRIBUTES, 3)) + " UNION ALL SELECT event_id, 'occurrence', 'false' FROM events WHERE event_id % 9 = 6) WHERE value IS NOT NULL",
)


# What is known of an item: its votes are its evidence
_PART = _fusion._SCORES + ", lr AS (" + _fusion.ORACLE_SQL["label_rule"] + ")"


def _voted(name: str, query: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda s, d: query(bound(s, d, "votes"), bound(s, d, "outcomes"))
    ORACLE_SQL[name] = with_ctes(["votes", "outcomes"], sql)


_voted(
    "assessments",
    assessment.assessments,
    _PART + ", n AS (SELECT item, count(*) FILTER (vote > 0) AS supporting, count(*) FILTER (vote < 0) AS denying, count(*) FILTER (vote > 0 AND rate >= 0.5) AS credible_supporting, count(*) FILTER (vote < 0 AND rate >= 0.5) AS credible_denying FROM rv GROUP BY item), c AS (SELECT item, count(*) FILTER (vote IS NOT NULL AND copy_of IS NOT NULL) AS counted_once FROM votes GROUP BY item) SELECT item, p, label, coalesce(supporting, 0) AS supporting, coalesce(denying, 0) AS denying, coalesce(credible_supporting, 0) AS credible_supporting, coalesce(credible_denying, 0) AS credible_denying, counted_once FROM lr JOIN c USING (item) LEFT JOIN n USING (item)",
)
_voted(
    "assessment_reasons",
    assessment.reasons,
    _fusion._SCORES + ", q AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY -round(abs(ln(rate / (1 - rate))), 9), vote_id) AS place FROM rv) SELECT item, place, source, source_type, vote, round_even(rate, 3) AS rate FROM q WHERE place <= 5",
)
#: Three details of votes that support: a count, a depth and a cause, some of which are unknown.
_SAID = [
    "CASE vote_id % 3 WHEN 0 THEN 'casualty_count' WHEN 1 THEN 'magnitude' ELSE 'cause' END AS attribute",
    "CASE vote_id % 3 WHEN 0 THEN CAST(CAST(floor(stated) AS BIGINT) AS STRING) WHEN 1 THEN CASE vote_id % 4 WHEN 0 THEN 'knee-deep' WHEN 1 THEN 'waist-deep' ELSE 'chest-deep' END ELSE CASE WHEN vote_id % 7 < 5 THEN 'unknown' ELSE 'heavy rain' END END AS value",
    "CASE WHEN vote_id % 3 = 0 THEN CAST(floor(stated) AS DOUBLE) END AS number",
]


def _said(v: DataFrame, o: DataFrame) -> DataFrame:
    rows = fusion.rated_votes(v, o).where("vote > 0").drop("stated").join(v.select("vote_id", "stated", "seen"), "vote_id")
    return rows.selectExpr("item", "vote_id AS id", "source", "rate", "seen AS at", *_SAID)


_voted(
    "detail_estimates",
    lambda v, o: assessment.detail_estimates(_said(v, o)),
    _fusion._SCORES
    + f", e AS (SELECT rv.item, rate, seen AS t, CAST(round(greatest(ln(rate / (1 - rate)), 0.01) * 1e6) AS BIGINT) AS w, {', '.join(_SAID)} FROM rv JOIN (SELECT vote_id, stated, seen FROM votes) USING (vote_id) WHERE vote > 0)"
    + ", f AS (SELECT item, attribute, count(*) AS n_statements, coalesce(max(t) FILTER (rate >= 0.5), max(t)) AS latest, bool_or(value <> 'unknown') AS known, count(DISTINCT value) FILTER (rate >= 0.5 AND value <> 'unknown') > 1 AS apart FROM e GROUP BY ALL)"
    + ", c AS (SELECT item, number, sum(w) AS w FROM e JOIN f USING (item, attribute) WHERE number IS NOT NULL AND t >= latest - 43200 GROUP BY ALL), cr AS (SELECT item, number, sum(w) OVER (PARTITION BY item ORDER BY number) AS up, sum(w) OVER (PARTITION BY item) AS al FROM c), cm AS (SELECT item, min(number)::BIGINT::VARCHAR AS estimate FROM cr WHERE 2 * up >= al GROUP BY item)"
    + ", m AS (SELECT item, attribute, value, sum(w) AS w, min(t) AS first FROM e JOIN f USING (item, attribute) WHERE number IS NULL AND (value <> 'unknown' OR NOT known) GROUP BY ALL), mm AS (SELECT item, attribute, arg_min(value, (-w, first, value)) AS estimate FROM m GROUP BY ALL)"
    + ", x AS (SELECT DISTINCT a.item FROM e a JOIN e b ON a.item = b.item AND abs(a.t - b.t) <= 43200 AND abs(a.number - b.number) > 0.2 * greatest(a.number, b.number) WHERE a.rate >= 0.5 AND b.rate >= 0.5)"
    + " SELECT item, attribute, estimate, n_statements, CASE WHEN attribute = 'casualty_count' THEN x.item IS NOT NULL ELSE apart END AS disputed FROM (SELECT item, 'casualty_count' AS attribute, estimate FROM cm UNION ALL FROM mm) JOIN f USING (item, attribute) LEFT JOIN x USING (item)",
)

_SINCE, _NOW = 1706572800, 1706659200  # the last day of the events


def _evidence(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = bound(s, d, "evidence").withColumnRenamed("seen", "at")
    return rows, rows.where("copy_of IS NULL AND relation < 2 AND attribute IS NOT NULL")


_MOVED = f", g AS (SELECT item, attribute, max(number) FILTER (seen <= {_SINCE}) AS before, max(number) FILTER (seen > {_SINCE}) AS after, arg_max(id, (number, -seen, -id)) FILTER (seen <= {_SINCE}) AS before_id, arg_max(id, (number, -seen, -id)) FILTER (seen > {_SINCE}) AS after_id, arg_max(source, (number, -seen, -id)) FILTER (seen > {_SINCE}) AS source FROM evidence WHERE copy_of IS NULL AND relation < 2 AND attribute IS NOT NULL AND seen <= {_NOW} GROUP BY ALL), mv AS (SELECT * FROM g WHERE after IS NOT NULL AND (before IS NULL OR after > before * 1.2e0))"
_add("moved_figures", lambda s, d: assessment.moved_figures(_evidence(s, d)[1], _SINCE, _NOW), with_ctes(["evidence"], _MOVED + " SELECT * FROM mv"))
_AT = "strftime(make_timestamp((floor({t})::BIGINT + 21600) * 1000000), '%d %b %Y, %H:%M')"
_KIND = "replace(event_type, '_', ' ')"
_BRIEFING = (
    _MOVED
    + f", f AS (SELECT item, count(DISTINCT source) FILTER (copy_of IS NULL AND relation < 2) AS nf, count(DISTINCT source) FILTER (copy_of IS NULL AND relation < 2 AND rate >= 0.5) AS nc, count(DISTINCT source) FILTER (copy_of IS NULL AND relation = 2) AS na, count(*) FILTER (copy_of IS NOT NULL) AS copies, count(*) FILTER (copy_of IS NULL) AS counted, count(*) FILTER (copy_of IS NULL AND seen > {_SINCE} AND seen <= {_NOW}) AS fresh"
    + "".join(f", count(*) FILTER (copy_of IS NULL AND seen > {_SINCE} AND seen <= {_NOW} AND {w}) AS {c}" for c, w in (("f1", "relation < 2"), ("f2", "relation = 2"), ("f3", "relation = 3")))
    + ", arg_max({'id': id, 'source': source, 'seen': seen}, (seen, -id)) FILTER (copy_of IS NULL) AS latest FROM evidence GROUP BY item)"
    + ", k AS (SELECT *, relation = 2 AS side, row_number() OVER (PARTITION BY item, relation = 2 ORDER BY seen, id) AS k FROM evidence WHERE copy_of IS NULL AND relation < 3), h AS (SELECT item, coalesce(list(id ORDER BY k) FILTER (NOT side), []) AS firsts, coalesce(list(id ORDER BY k) FILTER (side), []) AS denials FROM k WHERE k <= 3 GROUP BY item)"
    + ", r AS (SELECT *, coalesce(nf + na, 0) > 0 AS known FROM incident_facts LEFT JOIN f USING (item) LEFT JOIN h USING (item)), t AS ("
    + f"SELECT item, 'lead' AS kind, 1 AS place, upper({_KIND}[1]) || {_KIND}[2:] || coalesce(' at ' || place_name, '') || ', ' || CASE WHEN ended IS NULL THEN 'since ' || {_AT.format(t='started')} ELSE 'from ' || {_AT.format(t='started')} || ' to ' || {_AT.format(t='ended')} END || '.' || CASE WHEN known THEN '' ELSE ' No evidence is linked yet, so there is nothing to summarise.' END AS text, CASE WHEN len(firsts) > 0 THEN firsts ELSE coalesce(denials[1:1], []) END AS cites FROM r"
    + " UNION ALL SELECT item, 'balance', 1, nf || ' sources say it happened' || CASE WHEN nf > 0 THEN ' (' || nc || ' credible)' ELSE '' END || CASE WHEN na = 1 THEN '; 1 says it did not' WHEN na > 1 THEN '; ' || na || ' say it did not' ELSE '' END || '.', list_concat(firsts, denials)[1:3] FROM r WHERE known"
    + " UNION ALL SELECT item, 'denial', k, source || ' calls it false.', [id] FROM k JOIN incident_facts USING (item) WHERE side AND k <= 3"
    + " UNION ALL SELECT item, 'copies', 1, copies || CASE WHEN copies = 1 THEN ' item repeats an earlier one and is' ELSE ' items repeat an earlier one and are' END || ' counted once.', [] FROM r WHERE known AND copies > 0"
    + f" UNION ALL SELECT item, 'latest', 1, 'Latest: ' || latest.source || ', ' || {_AT.format(t='latest.seen')} || '.', [latest.id] FROM r WHERE known AND counted > 0"
    + " UNION ALL SELECT item, 'new', 1, fresh || CASE WHEN fresh = 1 THEN ' new item: ' ELSE ' new items: ' END || array_to_string([x for x in [CASE WHEN f1 > 0 THEN f1 || ' support it' END, CASE WHEN f2 > 0 THEN f2 || ' say it did not happen' END, CASE WHEN f3 > 0 THEN f3 || ' only comment' END] if x IS NOT NULL], ', ') || '.', [] FROM r WHERE fresh > 0"
    + " UNION ALL SELECT item, 'count', CASE attribute WHEN 'affected_count' THEN 1 ELSE 2 END, CASE attribute WHEN 'affected_count' THEN 'People affected: ' ELSE 'Casualties: ' END || CASE WHEN before IS NULL THEN 'first figure, ' || format('{:,}', after::BIGINT) || ' (' || source || ').' ELSE source || ' now says ' || format('{:,}', after::BIGINT) || ', up from ' || format('{:,}', before::BIGINT) || '.' END, [x for x in [after_id, CASE WHEN before IS NOT NULL THEN before_id END] if x IS NOT NULL] FROM mv JOIN incident_facts USING (item))"
    + f", u AS (SELECT * FROM t UNION ALL SELECT item, 'none', 1, 'Nothing new since ' || {_AT.format(t=str(_SINCE))} || '.', [] FROM incident_facts WHERE item NOT IN (SELECT item FROM t WHERE kind IN ('new', 'count'))) SELECT item, kind, place::INT AS place, text, array_to_string(cites, ',') AS cites FROM u"
)
_add("briefing", lambda s, d: assessment.briefing(bound(s, d, "incident_facts"), *_evidence(s, d), _SINCE, _NOW).withColumn("cites", F.array_join(F.col("cites").cast("array<string>"), ",")), with_ctes(["incident_facts", "evidence"], _BRIEFING))

_add(
    "evidence_requests",
    lambda s, d: assessment.requests_for_evidence(bound(s, d, "requests"), bound(s, d, "event_states"), bound(s, d, "responses")),
    with_ctes(["requests", "event_states", "responses"], ", n AS (SELECT request_id, count(*) AS n FROM responses GROUP BY 1), j AS (SELECT r.*, r.status = 'open' AND coalesce(e.status IN ('resolved', 'dismissed'), false) AS gone, changed, coalesce(n, 0) AS responses FROM requests r LEFT JOIN event_states e USING (event_id) LEFT JOIN n USING (request_id)) SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY created DESC, request_id DESC) AS place, request_id, CASE WHEN gone THEN 'cancelled' ELSE status END AS status, CASE WHEN gone THEN changed ELSE closed END AS closed, responses FROM j"),
)
_add("repeated_requests", lambda s, d: assessment.repeated_requests(bound(s, d, "requests")), with_ctes(["requests"], " SELECT event_id, count(*) AS n_open, arg_min(request_id, (created, request_id)) AS first_request FROM requests WHERE status = 'open' GROUP BY 1 HAVING count(*) > 1"))
_add(
    "visible_statements",
    lambda s, d: assessment.visible_statements(bound(s, d, "statements"), bound(s, d, "official_pages"), "official", 3),
    with_ctes(["statements", "official_pages"], ", c AS (SELECT supersedes AS statement_id, max(statement_id) AS superseded_by FROM statements WHERE supersedes IS NOT NULL GROUP BY 1) SELECT statement_id, page_id, superseded_by FROM statements LEFT JOIN official_pages USING (page_id) LEFT JOIN c USING (statement_id) WHERE status = 'verified' OR page_id = 3"),
)
