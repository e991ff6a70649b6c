"""The registered queries of the operators, and their SQL where SQL can express them.

Each reads its whole table and leaves null, empty, long, repeated and clashing rows to its operator, whose docstring says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import read_table

from . import bpe, codes, decontam, iblt, langid, manifest, minhash, pii, quality, repeats, secrets, substrings, warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark, "archive")
    warc.write_archive(read_table(spark, sf_dir, "pages"), folder, "page_id", "url", "html")
    return warc.read_archive(spark, folder).selectExpr("record_id AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM p),
r AS (SELECT *, strlen(html) >= 1000 AND owner IS NOT NULL AND (page_id IS NULL OR page_id < owner) AS again FROM o)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN owner END AS refers_to
FROM r
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def surrogate_key(spark: SparkSession) -> str:
    """The session's secret for surrogates; a fixed one where none is set, fit for tests only."""
    return spark.conf.get("spark.tessera.surrogateKey", "not a secret")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(read_table(spark, sf_dir, "documents"), surrogate_key(spark)).select("doc_id", "text", "n_entities")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    predicted = langid.predict(docs, model)
    return predicted.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(read_table(spark, sf_dir, "documents"), 400)
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, cast(s.start AS string), cast(s.end AS string))), ',')"


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    base = "filter(spans, s -> s.kind IN ('assign', 'access', 'hex'))"
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint) AS n_{k}" for k in ("assign", "access", "hex")],
        f"sha2({_joined(base)}, 256) AS base_sha256",
        f"{_joined('spans')} AS spans",
    )


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), minhash.Params(words=2))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(read_table(spark, sf_dir, "embeddings"))


_DISTANCE = "list_sum([(x[i] - y[i]) * (x[i] - y[i]) for i in range(1, len(x) + 1)])"
_ASSIGN = "SELECT vec_id, label, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.vec_id, v.label, v.p, x, e, " + _DISTANCE + " AS d FROM v JOIN c{j} USING (p)) GROUP BY ALL"
_ROUND = (
    ", a{k} AS MATERIALIZED (" + _ASSIGN + ")"
    ", m{k} AS (SELECT p, e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS value FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM v) + 1)) AS i) GROUP BY p, e, i)"
    ", n{k} AS (SELECT p, e, list(value ORDER BY i) AS y FROM m{k} GROUP BY p, e)"
    ", c{k} AS MATERIALIZED (SELECT p, e, coalesce(n{k}.y, c{j}.y) AS y FROM c{j} LEFT JOIN n{k} USING (p, e))"
)
OP11_SQL = (
    "WITH k AS (SELECT vec_id, label, [floor(4096 * z::DOUBLE)::BIGINT for z in embedding] AS z FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0)"
    ", v AS MATERIALIZED (SELECT vec_id, label, p, z[p * len(z) // 8 + 1 : (p + 1) * len(z) // 8] AS x FROM k, (SELECT unnest(range(8)) AS p))"
    ", c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM v QUALIFY e < 16)"
    + "".join(_ROUND.format(k=k, j=k - 1) for k in range(1, 7))
    + ", a7 AS MATERIALIZED (" + _ASSIGN.format(j=6) + ")"
    ", r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a7 GROUP BY vec_id, label)"
    ", b AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6)"
    " SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r, b"
)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeated_passages(read_table(spark, sf_dir, "documents"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


OP12_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
b AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM g) WHERE doc_id > f),
c AS MATERIALIZED (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM b),
s AS (SELECT doc_id, count(*) AS n_spans FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.doc_id = c.doc_id AND x.i = c.i - 1) GROUP BY 1),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM e ANTI JOIN c USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::INT AS n_spans
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(read_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


_FIELD = "coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
OP13_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars + 1)")} AS other,
    xor(list_reduce([ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')], lambda c, b: list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), 4294967295), 4294967295) % 7 = 0 AS broken
  FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM l
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, level, pos // 2, n),
s AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 100 AS level, pos, h, n FROM s
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
r AS (SELECT h AS root FROM top WHERE n = 1),
steps AS MATERIALIZED (
  SELECT a.lang, a.level, a.pos, b.h FROM up a LEFT JOIN up b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
topsteps AS MATERIALIZED (SELECT a.level, a.pos, b.h FROM top a LEFT JOIN top b ON a.level = b.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
proofs AS (
  SELECT lang, pos, string_agg(h, '' ORDER BY level) AS siblings FROM (
    SELECT l.lang, l.pos, t.level, t.h FROM l JOIN steps t ON l.lang IS NOT DISTINCT FROM t.lang AND t.pos = l.pos >> t.level
    UNION ALL
    SELECT l.lang, l.pos, t.level, t.h FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN topsteps t ON t.pos = s.pos >> (t.level - 100)) GROUP BY lang, pos),
fold AS (
  SELECT lang, pos AS leaf_pos, pos, 0 AS level, CASE WHEN broken AND n_given THEN other ELSE leaf END AS h FROM (SELECT l.*, n_chars IS NOT NULL AS n_given FROM l JOIN documents USING (doc_id))
  UNION ALL
  SELECT f.lang, leaf_pos, f.pos // 2, f.level + 1, sha256(CASE WHEN t.h IS NULL THEN f.h WHEN f.pos % 2 = 1 THEN t.h || f.h ELSE f.h || t.h END)
  FROM fold f JOIN steps t ON f.lang IS NOT DISTINCT FROM t.lang AND f.level = t.level AND f.pos = t.pos),
topfold AS (
  SELECT f.lang, leaf_pos, s.pos, 100 AS level, f.h FROM fold f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang WHERE NOT EXISTS (SELECT 1 FROM steps t WHERE f.lang IS NOT DISTINCT FROM t.lang AND f.level = t.level)
  UNION ALL
  SELECT f.lang, leaf_pos, f.pos // 2, f.level + 1, sha256(CASE WHEN t.h IS NULL THEN f.h WHEN f.pos % 2 = 1 THEN t.h || f.h ELSE f.h || t.h END)
  FROM topfold f JOIN topsteps t ON f.level = t.level AND f.pos = t.pos),
ends AS (SELECT lang, leaf_pos, arg_max(h, level) AS folded_root FROM topfold GROUP BY 1, 2)
SELECT l.doc_id, l.leaf, s.h AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN ends ON l.lang IS NOT DISTINCT FROM ends.lang AND l.pos = leaf_pos
LEFT JOIN proofs p ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.pos, r
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_fingerprints": op3_fingerprints,
    "op4_pii": op4_pii,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_minhash": op9_minhash,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op11_vector_codes": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
