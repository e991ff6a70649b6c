"""Projections, similarity and retrieval of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as columns
from tessera.operators import extraction, similar, textual
from tessera.plans.bindings import bound, with_ctes
from tessera.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str, tables: tuple[str, ...] = ()) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, with_ctes(list(tables), sql) if tables else sql


def docs(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents")


def items(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "benchmark")


_add(
    "url_normalise",
    lambda s, d: read_table(s, d, "pages").select("page_id", columns.normal_url(F.col("url")).alias("url")),
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://', ''), '^(www|m)\.', '') AS u FROM pages), h AS (SELECT page_id, regexp_extract(u, '^[^/?]*', 0) AS host, u FROM a), r AS (SELECT page_id, lower(host) AS host, regexp_replace(substr(u, length(host) + 1), '([?&])(utm_[a-z]+|ref|fbclid)=[^&]*', '\1', 'g') AS rest FROM h) SELECT page_id, host || regexp_replace(regexp_replace(regexp_replace(rest, '&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '') AS url FROM r""",
)
_add(
    "redact",
    lambda s, d: docs(s, d).select("doc_id", F.sha2(columns.redacted(F.col("text")), 256).alias("text_sha256")),
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \t\r\n]+', '[LINK]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\+?[0-9][0-9 ()-]{7,}[0-9]', '[PHONE]', 'g'), '@[A-Za-z0-9_]{3,}', '[HANDLE]', 'g')) AS text_sha256 FROM documents""",
)
_add(
    "excerpt",
    lambda s, d: docs(s, d).select("doc_id", columns.excerpt(F.col("text")).alias("excerpt")),
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) = 0 THEN NULL WHEN length(t) <= 300 THEN t ELSE regexp_replace(substr(t, 1, 299), ' [^ ]*$', '') || '…' END AS excerpt FROM t""",
)
_add("fold_by_sha256", lambda s, d: read_table(s, d, "events").select("event_id", columns.fold(F.col("event_id")).alias("fold")), "SELECT event_id, (list_sum([instr('0123456789abcdef', c) - 1 for c in string_split(sha256(event_id::VARCHAR), '')]) % 5)::INT AS fold FROM events")
_add("account_reference", lambda s, d: read_table(s, d, "events").select("event_id", columns.account_ref(F.col("user_id"), "salt", "social").alias("account")), "SELECT event_id, 'social:' || substr(sha256('salt:' || user_id), 1, 16) AS account FROM events")
_add("local_time", lambda s, d: bound(s, d, "reports").select("report_id", columns.local_iso(F.col("t")).alias("at")), " SELECT report_id, strftime(make_timestamp((floor(t)::BIGINT + 21600) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+06:00' AS at FROM reports", ("reports",))
_add(
    "parse_date",
    lambda s, d: bound(s, d, "reports").withColumn("x", F.when(F.col("report_id") % 3 == 0, F.date_format(F.timestamp_seconds(F.floor("t")), "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("report_id") % 3 == 1, F.concat(F.date_format(F.timestamp_seconds(F.floor("t")), "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0600"))).otherwise("soon")).select("report_id", F.unix_timestamp(columns.parsed_time(F.col("x"))).alias("at")),
    " SELECT report_id, CASE report_id % 3 WHEN 0 THEN floor(t)::BIGINT WHEN 1 THEN floor(t)::BIGINT - 21600 END AS at FROM reports",
    ("reports",),
)
_add(
    "parse_answer",
    lambda s, d: read_table(s, d, "events").select("event_id", columns.answer(F.concat(F.lit('Well: {"p": '), (F.col("event_id") % 150 / 100).cast("string"), F.lit(', "label": "'), F.when(F.col("event_id") % 2 == 0, "verified").otherwise("sure"), F.lit('"} so.'))).alias("a")).select("event_id", "a.p", "a.label"),
    "SELECT event_id, least(greatest((event_id % 150) / 100, 0.01), 0.99)::DOUBLE AS p, CASE WHEN event_id % 2 = 0 THEN 'verified' ELSE 'unverified' END AS label FROM events",
)
_add("content_hash", lambda s, d: docs(s, d).groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1"), "SELECT sha256(text) AS content, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
_add(
    "record_hash",
    lambda s, d: bound(s, d, "reports").select("report_id", F.sha2(F.to_json(F.struct(F.format_string("%.6f", "lat").alias("lat"), F.format_string("%.6f", "lon").alias("lon"), F.col("reporter"))), 256).alias("content")),
    """ SELECT report_id, sha256(format('{{"lat":"{:.6f}","lon":"{:.6f}","reporter":{}}}', lat, lon, reporter)) AS content FROM reports""",
    ("reports",),
)
_add(
    "html_text",
    lambda s, d: read_table(s, d, "pages").select("page_id", F.sha2(textual.html_text(F.col("html")), 256).alias("text_sha256")),
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gsi'), '<style\b.*?</style>', ' ', 'gsi'), '<[^>]*>', ' ', 'gs') AS t FROM pages), b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a) SELECT page_id, sha256(trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text_sha256 FROM b""",
)
_add("host", lambda s, d: read_table(s, d, "pages").select("page_id", textual.host_of(F.col("url")).alias("host")), r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[a-z]+://)?([^/?#:]*)', 1)), '^(www\.|m\.)+', '') AS host FROM pages")
_HOSTS = r"WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[a-z]+://)?([^/?#:]*)', 1)), '^(www\.|m\.)+', '') AS host FROM pages), r AS (SELECT DISTINCT regexp_extract(host, '[^.]+\.[^.]+$', 0) AS domain FROM h WHERE page_id % 3 = 0)"
_add(
    "registered_domain",
    lambda s, d: textual.registered(read_table(s, d, "pages").select("page_id", textual.host_of(F.col("url")).alias("host")), read_table(s, d, "pages").where("page_id % 3 = 0").select(F.regexp_extract(textual.host_of(F.col("url")), r"[^.]+\.[^.]+$", 0).alias("domain")), "page_id", "host"),
    _HOSTS + " SELECT page_id, arg_min(domain, -length(domain)) AS domain FROM h JOIN r ON host = domain OR host LIKE '%.' || domain GROUP BY page_id",
)
_LISTS = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in (("b", textual.BANGLISH), ("e", textual.ENGLISH))}
_LANGUAGE = r"WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), '[a-z]+') AS ws FROM {t} WHERE text IS NOT NULL), c AS (SELECT doc_id, regexp_matches(text, '[\x{{0980}}-\x{{09FF}}]') AS script, len([x for x in ws if list_contains({b}, x)]) AS b, len([x for x in ws if list_contains({e}, x)]) AS e, len([x for x in ws if length(x) >= 4]) AS n FROM w) SELECT doc_id, CASE WHEN script THEN CASE WHEN e >= 2 OR b >= 2 OR n >= 3 THEN 'mixed' ELSE 'bn' END WHEN b < 2 THEN 'en' WHEN b >= e AND e < 3 THEN 'bn-Latn' ELSE 'mixed' END AS script FROM c"
_add("language_detect", lambda s, d: docs(s, d).where("text IS NOT NULL").select("doc_id", textual.language(F.col("text")).alias("script")), _LANGUAGE.replace("\\\\x", "\\x").format(t="documents", **_LISTS))
_CUES = ["false", "not true", "license", "an"]
_add("cue_count", lambda s, d: docs(s, d).select("doc_id", textual.cue_count(F.col("text"), _CUES).alias("cues")), "SELECT doc_id, (" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', ''))) // {len(c)}" for c in _CUES) + ")::INT AS cues FROM documents")
_add("attribution_flag", lambda s, d: docs(s, d).where(F.col("text").rlike(r"(?i)\b(license|according to|laut|selon)\b")).select("doc_id"), r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b(license|according to|laut|selon)\b')")
_add("sentence_count", lambda s, d: docs(s, d).where("text IS NOT NULL").select("doc_id", F.size(textual.sentences(F.col("text"))).alias("n")), r"SELECT doc_id, len([x for x in regexp_split_to_array(text, '[.!?।\n]+') if length(trim(x, ' ')) BETWEEN 25 AND 600])::INT AS n FROM documents WHERE text IS NOT NULL")
_add(
    "char_edit_rate",
    lambda s, d: items(s, d).selectExpr("item_id", "text AS a").join(items(s, d).selectExpr("item_id - 1 AS item_id", "text AS b"), "item_id").select("item_id", F.levenshtein(F.regexp_replace("a", "[^ -~]", ""), F.regexp_replace("b", "[^ -~]", "")).alias("edits"), F.bround(textual.edit_rate(F.regexp_replace("a", "[^ -~]", ""), F.regexp_replace("b", "[^ -~]", "")), 6).alias("rate")),
    "WITH t AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark) SELECT a.item_id, levenshtein(a.t, b.t)::INT AS edits, round_even(levenshtein(a.t, b.t) / greatest(length(a.t), 1), 6) AS rate FROM t a JOIN t b ON b.item_id = a.item_id + 1",
)
_PIECES = "CASE WHEN length({t}) >= 4 THEN list_distinct([substr({t}, k, 4) for k in range(1, length({t}) - 2)]) ELSE [] END"
_FLAT = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_add(
    "jaccard_4gram",
    lambda s, d: items(s, d).select("item_id", "text").join(items(s, d).selectExpr("item_id + 1 AS item_id", "text AS other"), "item_id").select("item_id", F.bround(textual.jaccard(textual.pieces(F.col("text")), textual.pieces(F.col("other"))), 6).alias("jaccard")),
    f"WITH p AS (SELECT item_id, {_FLAT.format(c='text')} AS t FROM benchmark), g AS (SELECT item_id, {_PIECES.format(t='t')} AS g FROM p) SELECT a.item_id, round_even(len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)), 6) AS jaccard FROM g a JOIN g b ON a.item_id = b.item_id + 1",
)
_add(
    "verbatim_test",
    lambda s, d: textual.verbatim_copies(docs(s, d), items(s, d), "doc_id", "item_id"),
    f"WITH a AS (SELECT doc_id, {_FLAT.format(c='text')} AS a FROM documents), b AS (SELECT item_id, {_FLAT.format(c='text')} AS b FROM benchmark) SELECT DISTINCT doc_id, item_id FROM a JOIN b ON b <> '' AND (a = b OR (length(b) >= 20 AND contains(a, b)))",
)
_WORDS = "regexp_extract_all(lower({c}), '[a-z0-9\\x{{0980}}-\\x{{09FF}}]+')"
_add(
    "title_jaccard",
    lambda s, d: items(s, d).select("item_id", textual.words_of(F.col("text")).alias("a")).join(items(s, d).select((F.col("item_id") + 2).alias("item_id"), textual.words_of(F.col("text")).alias("b")), "item_id").select("item_id", F.bround(textual.jaccard(F.array_distinct("a"), F.array_distinct("b")), 6).alias("jaccard")),
    f"WITH w AS (SELECT item_id, list_distinct({_WORDS.format(c='text')}) AS w FROM benchmark) SELECT a.item_id, round_even(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS jaccard FROM w a JOIN w b ON a.item_id = b.item_id + 2",
)
_GRAMS = r"WITH w AS (SELECT item_id, ' ' || unnest([x for x in regexp_split_to_array(lower(text), '[\s.,;:!?''" + '"' + r"()\[\]{}।/\\|–—-]+') if x <> '']) || ' ' AS p FROM benchmark), g AS (SELECT item_id, unnest([substr(p, k, n) for n in [2, 3, 4] for k in range(1, length(p) - n + 2)]) AS gram FROM w)"
_GRAMS = _GRAMS.replace("unnest([substr(p, k, n) for n in [2, 3, 4] for k in range(1, length(p) - n + 2)])", "unnest([substr(p, k, 2) for k in range(1, length(p))] || [substr(p, k, 3) for k in range(1, length(p) - 1)] || [substr(p, k, 4) for k in range(1, length(p) - 2)])")
_TFIDF = _GRAMS + ", c AS (SELECT item_id, gram, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark), i AS (SELECT gram, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM c, n GROUP BY gram), v AS (SELECT item_id, gram, (1 + ln(tf)) * idf AS w FROM c JOIN i USING (gram)), m AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1), x AS (SELECT v.item_id, gram, w / norm AS w FROM v JOIN m USING (item_id))"
_add("char_gram_tfidf", lambda s, d: textual.tfidf(items(s, d), "item_id", "text").select("item_id", "gram", F.bround("w", 6).alias("w")), _TFIDF + " SELECT item_id, gram, round_even(w, 6) AS w FROM x")
_add(
    "char_gram_tfidf_cosine",
    lambda s, d: textual.cosine_within(textual.tfidf(items(s, d), "item_id", "text"), items(s, d).selectExpr("item_id", "item_id % 5 AS topic"), "item_id", "topic", 0.2),
    _TFIDF + " SELECT a.item_id AS a, b.item_id AS b, round_even(sum(a.w * b.w), 5) AS cosine FROM x a JOIN x b ON a.gram = b.gram AND a.item_id % 5 = b.item_id % 5 AND a.item_id < b.item_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.2",
)
_BM = f"WITH t AS (SELECT doc_id, unnest({_WORDS.format(c='text')}) AS word FROM documents), f AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY ALL), z AS (SELECT doc_id, sum(tf) AS size FROM f GROUP BY 1), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(size) FROM z) AS total), e AS (SELECT word, count(*) AS df FROM f GROUP BY 1), q AS (SELECT item_id, unnest(list_distinct({_WORDS.format(c='text')})) AS word FROM benchmark), s AS (SELECT item_id, f.doc_id, round_even(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * size / (total / n)))), 5) AS score FROM q JOIN e USING (word) JOIN f USING (word) JOIN z USING (doc_id), n GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s)"


def _bm25(s: SparkSession, d: str, top: int) -> DataFrame:
    return textual.bm25(docs(s, d), items(s, d).selectExpr("item_id", "text AS q"), "doc_id", "text", "item_id", top=top)


_add("bm25_topk", lambda s, d: _bm25(s, d, 10).select("item_id", "doc_id", F.bround("score", 2).alias("score")), _BM + " SELECT item_id, doc_id, round_even(score, 2) AS score FROM r WHERE rank < 10")
def _fused(s: SparkSession, d: str) -> DataFrame:
    found = _bm25(s, d, 20)
    return textual.fused_ranks(found, found.selectExpr("item_id", "doc_id", "doc_id % 20 AS rank"), ["item_id", "doc_id"])


_add(
    "rrf",
    _fused,
    _BM + ", b AS (SELECT item_id, doc_id, rank FROM r WHERE rank < 20 UNION ALL SELECT item_id, doc_id, doc_id % 20 FROM r WHERE rank < 20) SELECT item_id, doc_id, round_even(sum(1 / (60 + rank)), 9) AS fused FROM b GROUP BY 1, 2",
)
_add("hamming_pairs", lambda s, d: textual.hamming_within(bound(s, d, "photos"), "photo_id", "hash16", 16, 1), " SELECT a.photo_id AS a, b.photo_id AS b, bit_count(xor(a.hash16, b.hash16))::INT AS bits FROM photos a JOIN photos b ON a.photo_id < b.photo_id WHERE bit_count(xor(a.hash16, b.hash16)) <= 1", ("photos",))
_add(
    "embedding_topk",
    lambda s, d: similar.nearest_by_dot(read_table(s, d, "embeddings").where("vec_id % 50 = 0").selectExpr("vec_id AS id", "embedding AS x"), read_table(s, d, "embeddings").selectExpr("vec_id AS id", "embedding AS x"), 5).selectExpr("q", "id AS vec_id", "place"),
    "WITH p AS (SELECT a.vec_id AS q, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT * FROM (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY dot DESC, vec_id) AS place FROM p) WHERE place <= 5",
)
_PADS = {pad: "".join(f"{b ^ pad:02x}" for b in b"a key".ljust(64, b"\0")) for pad in (0x36, 0x5C)}
_add("keyed_hmac", lambda s, d: read_table(s, d, "pages").select("page_id", columns.keyed_hash("a key", F.col("url")).alias("mark")), f"SELECT page_id, sha256(unhex('{_PADS[0x5C]}') || unhex(sha256(unhex('{_PADS[0x36]}') || encode(url)))) AS mark FROM pages")


# Places, times and numbers of whole documents; a document's number is its event's, whose time is the time of publication
def _gazetteer(s: SparkSession, d: str) -> DataFrame:
    """Every capitalised word of the benchmark as a place: its level and district follow from the item that it first stands in, and some are two places."""
    words = items(s, d).select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-zà-ÿ]{3,}"), F.lit(0))).alias("spelling")).groupBy("spelling").agg(F.min("item_id").alias("k"), F.max("item_id").alias("m"))
    of = lambda k: words.selectExpr("spelling", "spelling AS name", f"element_at(array('locality', 'upazila', 'district', 'division'), cast({k} % 4 AS int) + 1) AS level", f"concat('d', {k} % 7) AS district", f"20.5D + {k} % 50 / 10 AS lat", f"88D + {k} % 40 / 10 AS lon")
    return of("k").union(of("m"))


def _places(s: SparkSession, d: str) -> DataFrame:
    return extraction.place_mentions(docs(s, d), _gazetteer(s, d), "doc_id", "text")


def _said(s: SparkSession, d: str) -> DataFrame:
    """Reports of events that say when they were, in three ways, with a time of publication after it."""
    e = read_table(s, d, "events").withColumn("t", F.col("ts").cast("timestamp")).withColumn("local", F.expr("t + INTERVAL 6 HOURS"))
    clock, day = F.date_format("local", "h:mma"), F.date_format("local", "d MMMM")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("A "), "event_type", F.lit(" at "), clock, F.lit(" on "), day, F.lit("."))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("On "), day, F.lit(" a "), "event_type")).otherwise(F.concat(F.lit("yesterday at "), clock, F.lit(" it was a "), "event_type"))
    later = F.when(F.col("event_id") % 3 == 2, 24).otherwise(F.col("event_id") % 72)
    return e.select("event_id", text.alias("text"), (F.unix_timestamp("t") + later * 3600).alias("at"))


_add("place_mentions", lambda s, d: _places(s, d).selectExpr("id AS doc_id", "start", "end", "surface", "name", "level", "district"), "")
_add("best_place", lambda s, d: extraction.best_place(_places(s, d)).selectExpr("id AS doc_id", "name", "level", "district", "precision_m"), "")
_add(
    "time_mentions",
    lambda s, d: extraction.time_mentions(_said(s, d), "event_id", "text", "at").selectExpr("id AS event_id", "CAST(start AS long) AS start", "CAST(end AS long) AS end", "precision"),
    "WITH t AS (SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events) SELECT event_id, CASE WHEN event_id % 3 = 1 THEN (t + 21600) // 86400 * 86400 - 21600 ELSE t // 60 * 60 END AS start, CASE WHEN event_id % 3 = 1 THEN (t + 21600) // 86400 * 86400 - 21600 + 86400 ELSE t // 60 * 60 END AS \"end\", CASE WHEN event_id % 3 = 1 THEN 'day' ELSE 'minute' END AS precision FROM t",
)
_add("number_phrases", lambda s, d: docs(s, d).where("text IS NOT NULL").select("doc_id", F.explode(extraction.numbers()("text")).alias("n")).selectExpr("doc_id", "n.surface", "n.value"), "")
