"""Similarity, retrieval and projections of texts. Joins of texts run on their grams or words, weighted by how rare those are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import discard, stored

# What separates words.
SPLIT = r"[\s.,;:!?'\"()\[\]{}।/\\|–—-]+"


def char_grams(text: Column, sizes: tuple[int, ...] = (2, 3, 4), split: str = SPLIT) -> Column:
    """All character grams inside the lower-cased words, each word with a space before and after."""
    words = F.filter(F.split(F.lower(text), split), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))

        def sized(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
            return F.when(F.length(padded) >= n, F.transform(starts, lambda k: F.substring(padded, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.concat(*map(sized, sizes))

    return F.flatten(F.transform(words, of))


def tfidf(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gram, w): (1 + ln tf)(ln((1 + n) / (1 + df)) + 1), normalised to length one."""
    counts = texts.select(id_col, F.explode(char_grams(F.col(text_col))).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("tf"))
    n = texts.agg(F.count("*").alias("n"))  # one row
    idf = counts.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = counts.join(idf, "gram").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norms = rows.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms, id_col).select(id_col, "gram", (F.col("w") / F.col("norm")).alias("w"))


def cosine_within(vectors: DataFrame, groups: DataFrame, id_col: str, group: str, least: float = 0.0) -> DataFrame:
    """Cosines of the pairs of one group that share a gram: a, b (a < b), cosine."""
    rows = vectors.join(groups.select(id_col, group), id_col)
    left = rows.select(F.col(group).alias("g"), "gram", F.col(id_col).alias("a"), F.col("w").alias("wa"))
    right = rows.select(F.col(group).alias("g"), "gram", F.col(id_col).alias("b"), F.col("w").alias("wb"))
    dots = left.join(right, ["g", "gram"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("c"))
    return dots.where(F.col("c") >= least).select("a", "b", F.bround("c", 5).alias("cosine"))


def grams_of(text: Column, n: int) -> Column:
    """All n-grams of a text, overlapping ones too, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def pieces(text: Column, n: int = 4) -> Column:
    """The distinct n-grams of a text in lower case whose other characters than letters and digits are single spaces."""
    return F.array_distinct(grams_of(plain_words(text), n))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9ঀ-৿]+"), F.lit(0))


def bm25(articles: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_col: str, k1: float = 1.4, b: float = 0.75, top: int = 10, block: int = 256, chunk: int = 1000) -> DataFrame:
    """The top articles of each query by BM25 over distinct query words: query, id, rank (from 0), score. An article and a query are a row each.

    Tasks count the queries' words (which all go to them, distinct) text by text, without a shuffle. Then chunks of articles meet blocks of queries, as
    matrices of words; only the top rows of each query and chunk leave a task.
    """
    asked = stored(queries.select(query_col, F.explode(F.array_distinct(words_of(F.col("q")))).alias("word")), "bm25-asked")
    spark, kinds = articles.sparkSession, {c: df.schema[c].dataType.simpleString() for df, c in ((articles, id_col), (queries, query_col))}
    words = [r[0] for r in asked.select("word").distinct().orderBy("word").collect()]
    known = spark.sparkContext.broadcast(words)

    def counted(batches):
        listed = pa.array(known.value, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                ids, ws = whole.slice(at, chunk).columns
                size = pc.fill_null(pc.list_value_length(ws), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                code = pc.fill_null(pc.index_in(pc.list_flatten(ws), value_set=listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(size)), size)[code >= 0]
                cells, tf = np.unique(owner * max(len(listed), 1) + code[code >= 0], return_counts=True)
                owner, code = np.divmod(cells, max(len(listed), 1))
                out = [ids, pa.array(size), pa.array(np.bincount(owner, minlength=len(size))), pa.array(code), pa.array(tf)]
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in out], names=["ids", "sizes", "m", "codes", "tf"])

    texts = articles.select(id_col, words_of(F.col(text_col)).alias("ws")).mapInArrow(counted, f"ids array<{kinds[id_col]}>, sizes array<long>, m array<long>, codes array<long>, tf array<long>")
    texts = stored(texts, "bm25-texts")
    whole = texts.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("all"))  # one row
    df = texts.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
    coded = spark.createDataFrame(list(enumerate(words)), "code long, word string")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = asked.join(coded, "word").join(df, "code").join(F.broadcast(whole)).groupBy(query_col).agg(F.collect_list(F.struct("code", idf.alias("idf"))).alias("ws"), F.first(F.col("all") / F.col("n")).alias("mean"))
    parts = queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).alias("parts"))  # one row
    packed = rows.join(F.broadcast(parts)).groupBy(F.pmod(F.xxhash64(query_col), F.col("parts")).alias("part")).agg(F.collect_list(F.struct(F.col(query_col).alias("q"), "ws")).alias("rows"), F.first("mean").alias("mean"))
    packed = packed.select("mean", F.col("rows.q").alias("qs"), F.transform("rows", lambda r: F.size(r["ws"])).alias("q_m"), F.flatten("rows.ws").alias("ws"))
    packed = stored(packed.select("mean", "qs", "q_m", F.col("ws.code").alias("q_codes"), F.col("ws.idf").alias("idf")), "bm25-queries")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, m, codes, tf, qs, q_m, q_codes, idf = (batch.column(c)[k].values for c in ("ids", "sizes", "m", "codes", "tf", "qs", "q_m", "q_codes", "idf"))
                terms, place = np.unique(q_codes.to_numpy(), return_inverse=True)
                asks = np.zeros((len(qs), len(terms)))
                asks[np.repeat(np.arange(len(qs)), q_m.to_numpy()), place] = idf.to_numpy()
                at = np.searchsorted(terms, codes.to_numpy())
                hit = at < len(terms)
                hit[hit] = terms[at[hit]] == codes.to_numpy()[hit]
                owner, f = np.repeat(np.arange(len(ids)), m.to_numpy())[hit], tf.to_numpy()[hit]
                gives = np.zeros((len(terms), len(ids)))
                gives[at[hit], owner] = f * (k1 + 1) / (f + k1 * (1 - b + b * sizes.to_numpy()[owner] / batch.column("mean")[k].as_py()))
                scores = np.round(asks @ gives, 5)
                order = np.empty(len(ids), int)
                order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                least = np.partition(scores, -top, axis=1)[:, -top] if len(ids) > top else np.zeros(len(qs))
                for i in range(len(qs)):
                    found = np.flatnonzero((scores[i] >= least[i]) & (scores[i] > 0))
                    found = found[np.lexsort((order[found], -scores[i, found]))[:top]]
                    if len(found):
                        yield pa.record_batch([qs.take(pa.array(np.full(len(found), i))), ids.take(pa.array(found)), pa.array(scores[i, found])], names=[query_col, id_col, "score"])

    order = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    scored = texts.join(F.broadcast(packed)).mapInArrow(run, f"`{query_col}` {kinds[query_col]}, `{id_col}` {kinds[id_col]}, score double")
    out = stored(scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top), "bm25-top")
    discard(asked, texts, packed)
    return out


def fused_ranks(a: DataFrame, b: DataFrame, keys: list[str], shift: float = 60.0) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (rank from 0)."""
    both = a.select(*keys, "rank").union(b.select(*keys, "rank"))
    return both.groupBy(*keys).agg(F.bround(F.sum(1 / (shift + F.col("rank"))), 9).alias("fused"))


def cue_count(text: Column, cues: list[str]) -> Column:
    """How often the cues occur in the lower-cased text, each counted without overlaps."""
    t = F.lower(text)
    return sum((((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) / len(c)).cast("int") for c in cues), F.lit(0))


def sentences(text: Column, least: int = 25, most: int = 600) -> Column:
    """The trimmed sentences of a text, of bounded length."""
    return F.filter(F.transform(F.split(text, r"[.!?।\n]+"), lambda s: F.trim(s)), lambda s: F.length(s).between(least, most))


def plain_words(text: Column) -> Column:
    """A text in lower case whose other characters than letters and digits are single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def verbatim(copy: Column, origin: Column, least: int = 20) -> Column:
    """Whether the origin's plain words, at least least characters, stand in the copy, perhaps with more around them, or both are equal. An origin without a word has no copies."""
    a, b = plain_words(copy), plain_words(origin)
    return (b != "") & ((a == b) | ((F.length(b) >= least) & a.contains(b)))


def verbatim_copies(copies: DataFrame, origins: DataFrame, copy_id: str, origin_id: str, words: int = 3) -> DataFrame:
    """All pairs of a copy and an origin that stands in it: both with text.

    What stands inside begins and ends anywhere in a word, so the origin's words after its first find the texts to look in; origins of
    fewer words than that needs are looked for in all texts.
    """
    flat = lambda df, key, name: df.select(key, plain_words(F.col("text")).alias(name)).where(F.col(name) != "")
    a, b = flat(copies, copy_id, "a"), flat(origins, origin_id, "b")
    every = rf"(?<!\S)(?=(\S+(?: \S+){{{words - 1}}}))"  # overlapping runs of words, found in one pass
    runs = F.transform(F.regexp_extract_all("a", F.lit(every), F.lit(1)), lambda r: F.xxhash64(r))
    b = b.withColumn("parts", F.split("b", " "))
    keyed = b.where(F.size("parts") >= words + 2).select(origin_id, "b", F.xxhash64(F.array_join(F.slice("parts", 2, words), " ")).alias("key"))
    found = a.select(copy_id, "a", F.explode(F.array_distinct(runs)).alias("key")).join(keyed, "key")
    short = a.crossJoin(F.broadcast(b.where(F.size("parts") < words + 2).select(origin_id, "b")))
    inside = lambda df: df.where((F.col("a") == F.col("b")) | ((F.length("b") >= 20) & F.col("a").contains(F.col("b")))).select(copy_id, origin_id)
    return inside(found).union(inside(short)).distinct()


# Common words of romanised Bangla and of English, as they are written in reports.
BANGLISH = """
ache achhe asche ase ashe amra amader apni apnara ar baro bari barite bhai bhoy bondho bondo bristi brishti dhoke dibe dilo dorkar
ekhane ekhono ekhon eto gese geche gelo hobe hocche hoise hoyeche hoye hoy hoyni jon jonno kaj kamon kemon keu kichu koto kore korche
korse korte kotha manush mara moddhe na nai nei niye onek pani para porjonto rasta sathe shob sob shokal shokale theke tader tara tobe
ufff upor agun jam jot dube dubay dubse dhoshe dhose bhenge venge nihoto ahoto khotigrosto gujob gujab mittha shotti sotti biddut
current kawran pashe kache samne pichone lagse lagche legeche boro choto beshi kom komche barche bariye jacche jasse karone karon mor
komor hatu gorali bhari tana nise nilo koyekjon e te er ke re o ki keno kintu okhane gari rastay rastai pore porche
""".split()
ENGLISH = """
the a an and or of in on at to from is are was were has have had been be will would after before near since still people water fire
road flood rain dead killed injured affected police said says reported report about over under this that with
""".split()


def language(text: Column) -> Column:
    """bn, bn-Latn, en or mixed: Bangla script with two common or three longer Latin words is mixed, without them bn; in Latin script two common words of
    romanised Bangla make bn-Latn, or mixed if English ones are more, or three. All else is en."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")), " "), lambda w: w != "")
    of = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    bangla, english, longer = of(BANGLISH), of(ENGLISH), F.size(F.filter(words, lambda w: F.length(w) >= 4))
    script = text.rlike("[\u0980-\u09ff]")
    latin = F.when(bangla < 2, "en").when((bangla >= english) & (english < 3), "bn-Latn").otherwise("mixed")
    return F.when(text.isNotNull(), F.when(~script, latin).when((english >= 2) | (bangla >= 2) | (longer >= 3), "mixed").otherwise("bn"))


def edit_rate(reference: Column, other: Column) -> Column:
    """Edits of characters that make the other text of the reference, over the reference's characters (one at least)."""
    return F.levenshtein(reference, other) / F.greatest(F.length(reference), F.lit(1))


def html_text(html: Column) -> Column:
    """Tags become spaces, entities their characters, runs of space one space."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def host_of(url: Column) -> Column:
    """The lower-cased host without www. and m. in front."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[a-z]+://)?([^/?#:]*)", 1)), r"^(www\.|m\.)+", "")


def suffixes(host: Column) -> Column:
    """A host and the domains it is under, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def registered(pages: DataFrame, table: DataFrame, key: str, host: str) -> DataFrame:
    """Each page's registered domain (column domain of table): the longest that its host is or is under."""
    rows = pages.select(key, F.posexplode(suffixes(F.col(host))).alias("pos", "domain"))
    return rows.join(table.select("domain").distinct(), "domain").groupBy(key).agg(F.min_by("domain", "pos").alias("domain"))


def hamming_within(hashes: DataFrame, id_col: str, hash_col: str, width: int, most: int, chunk: int = 1024) -> DataFrame:
    """Pairs (a < b) of hashes of width bits that differ in most bits or fewer, with the bits: all of them, so the result grows with the square of a hash's rows.

    Hashes are compared once, whatever their rows: near ones share one of most + 1 bands, and meet in the first shared one. Then the ids of both,
    in chunks, are paired in a task; only those pairs are made that are in the result.
    """
    size = -(-width // (most + 1))
    bands = F.array(*[F.shiftrightunsigned("h", k * size).bitwiseAND((1 << size) - 1) for k in range(most + 1)])
    rows = stored(hashes.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).where("id IS NOT NULL AND h IS NOT NULL"), "hamming-rows")
    counts = stored(rows.groupBy("h").agg(F.count("*").alias("n")), "hamming-hashes")
    parts = rows.join(counts, "h").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / chunk)))
    chunks = stored(parts.groupBy("h", "part").agg(F.collect_list("id").alias("ids")), "hamming-chunks")
    banded = counts.select("h", bands.alias("bands"), F.posexplode(bands).alias("band", "value"))
    first = F.expr("array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true) - 1 = band")
    apart = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h")))
    near = banded.alias("x").join(banded.alias("y"), ["band", "value"]).where((F.col("x.h") <= F.col("y.h")) & first & (apart <= most)).select(F.col("x.h").alias("h"), F.col("y.h").alias("other"), apart.alias("bits"))
    theirs = chunks.select(F.col("h").alias("other"), F.col("part").alias("other_part"), F.col("ids").alias("other_ids"))
    met = near.join(chunks, "h").join(theirs, "other").where("h <> other OR part <= other_part")
    slots = max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * hashes.sparkSession.sparkContext.defaultParallelism)
    spread = met.repartition(slots, "h", "part", "other", "other_part").withColumn("same", (F.col("h") == F.col("other")) & (F.col("part") == F.col("other_part")))
    pairs = spread.select("bits", "same", "other_ids", F.explode("ids").alias("x")).select("bits", "same", "x", F.explode("other_ids").alias("y"))
    return pairs.where("IF(same, x < y, x <> y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "bits")
