"""The dealt operators against brute force, round trips, held-out accuracy and awkward tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, iblt, langid, minhash, pii, quality, queries, secrets, substrings, suffixes, warc

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# 1: archive
def test_archive_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{SF01}/pages.parquet'")
    theirs = con.sql(queries.OP1_SQL)
    ours = queries.op1_warc(spark, SF01)
    assert Counter(map(str, plain(ours, *theirs.columns))) == Counter(map(str, theirs.fetchall()))


def test_archive_keeps_exact_bytes_and_payloads_once(spark):
    big = "p" * 1000
    pages = [(1, "u1", big), (5, "u5", big), (3, None, big), (2, "u\r\nX: y", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (5, "u5", big), (None, "u", big), (None, None, None), (9, "ü", "ä" * 500)]
    folder = warc.archive_folder(spark, "test")
    warc.write_archive(spark.createDataFrame([(*p, "clash", "x") for p in pages], "page_id long, url string, html string, digest string, id string"), folder, "page_id", "url", "html")
    assert spark.read.parquet(f"{folder}/payloads").count() == 4  # big, small, empty, umlauts
    got = Counter(plain(warc.read_archive(spark, folder), "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"))
    want = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        again = html == big and i != 5
        want[i, "revisit" if again else "response", 5 if again else None, len(data), hashlib.sha1(data).hexdigest()] += 1
    assert got == want
    for r in warc.reconstruct(spark, folder).collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4 and body.endswith(b"\r\n\r\n")
    empty = warc.archive_folder(spark, "test")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty, "page_id", "url", "html")
    assert warc.read_archive(spark, empty).count() == 0


# 2: decontamination
ITEMS = [(1, "If Anna buys 12 apples for 3.50 euros each and sells 5 of them to Bernd, how much money did Anna spend on the apples in total today?"), (2, "short item of five 7"), (3, None), (4, ""), (5, "12 13 14 15 16 17 18 19 20"), (1, "If Anna buys 12 apples for 3.50 euros each and sells 5 of them to Bernd, how much money did Anna spend on the apples in total today?")]


def found_items(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: list(r["items"]) for r in decontam.contaminated(docs, bench).collect()}


def test_reparameterised_questions_are_found(spark):
    again = "Intro words here. If Carla buys 40 apples for 7.25 euros each and sells 9 of them to David, how much money did Carla spend on the apples in total today? More."
    broken = "If Carla buys 40 apples for 40 euros each and sells 40 of them to Carla, how much money did David spend on the apples in total today?"
    clean = "The weather in the valley was mild and nobody bought anything at the market that day."
    got = found_items(spark, [ITEMS[0][1], again, broken, clean, None, "", "a short item of five 9 here", "1 2 3 4 5 6 7 8 9 10"])
    assert got == {0: [1], 1: [1], 6: [2]}


def test_names_that_begin_sentences_are_values(spark):
    item = "Anna has 12 apples. Anna gives 5 to Bernd. Anna buys 3 more. Anna eats 2 apples. How many are left?"
    again = item.replace("Anna", "Carla").replace("12", "14").replace("Bernd", "David")
    inside = "Suppose that " + again
    torn = "Carla has 14 apples. David gives 5 to Bernd. Emil buys 3 more. Frieda eats 2 apples. How many are left?"
    clean = "Carla had a good day. Nobody gave apples to David. Emil went home. How long is the way?"
    assert found_items(spark, [item, again, inside, torn, clean], [(1, item)]) == {0: [1], 1: [1], 2: [1]}


def test_items_without_windows_are_found_as_exact_copies(spark):
    thai, chinese = "แอนนามีแอปเปิ้ล 12 ลูก เหลือกี่ลูก", "小明有12个苹果，又买了3个苹果，请问他现在一共有几个苹果？"
    items = [(1, "What is 12 + 7?"), (2, "Solve 3 x 4"), (3, thai), (4, chinese), (5, "12 13 14 15 16 17 18 19 20 21"), (6, "几个")]
    texts = [
        "We ask: what is 12 + 7? Answer at once.",
        "What is 12 + 8?",
        "Please solve 3 x 4",
        "Solve 3 x 5 4",
        f"ก่อน {thai} หลัง",
        f"题目：{chinese}",
        "老师说：小明有15个苹果，又买了4个苹果，请问他现在一共有几个苹果？谢谢",
        "今天天气很好，我们去公园散步，然后回家吃饭。",
        "11 12 13 14 15 16 17 18 19 20 21 22",
        "12 13 14 15 16 17 18 19 20 22",
        "",
        None,
    ]
    assert found_items(spark, texts, items) == {0: [1], 2: [2], 4: [3], 5: [4, 6], 6: [4, 6], 8: [5]}


def test_values_that_became_equal_and_single_edits_are_found(spark):
    equal = ITEMS[0][1].replace("12", "4").replace("3.50", "4").replace("Anna", "Carla")
    item = "A farmer sells 12 eggs to Ms Weber, then packs the other 30 eggs into boxes of 6 and notes that 12 eggs are gone before he drives 7 km to the market where 12 people wait."
    place = item.replace("12", "14").replace("30", "40").replace("Weber", "Stein").replace("7 km", "9 km").replace("14 people", "15 people")
    gap = item.replace("12 eggs are gone before he drives", "15 geese were lost until she goes").replace("sells 12", "sells 14").replace("12 people", "14 people")
    torn = item.replace("sells 12", "sells 5").replace("12 eggs are", "6 eggs are").replace("12 people", "8 people").replace("30", "5").replace("of 6", "of 5").replace("7 km", "5 km")
    assert found_items(spark, [equal, place, gap, torn], [ITEMS[0], (2, item)]) == {0: [1], 1: [2], 2: [2]}


def test_whole_benchmark_passages_are_found_on_the_table(spark):
    docs, bench = (spark.read.parquet(f"{SF01}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    want = {d for d, t in zip(docs["doc_id"], docs["text"], strict=True) if t and any(i and i in t for i in bench["text"])}
    got = {r["doc_id"] for r in queries.op2_decontamination(spark, SF01).collect()}
    assert want and want <= got
    assert len(got - want) < 0.02 * len(docs)


def test_decontamination_of_awkward_tables(spark, awkward, clashing, nothing):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    none = bench.limit(0)
    assert decontam.contaminated(nothing, bench).count() == 0 and decontam.contaminated(awkward, none).count() == 0
    assert sorted(map(str, decontam.contaminated(awkward, bench).collect())) == sorted(map(str, decontam.contaminated(clashing, bench).collect()))


# 3: fingerprints
def edits(rows):
    rows = sorted(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1] or ""
        q = len(t or "") // 4
        yield i, t or "", (t or "")[: len(t or "") - q] + after[:q], after


def units(text):
    return set(re.findall(r"[^\s]+(?:[^\S\n]+[^\s]+){0,15}", text, re.ASCII))


def test_fingerprints(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    got = {r["doc_id"]: r for r in iblt.edited_fingerprints(small).collect()}
    prints = {}
    for i, text, edited, after in edits(rows):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited.encode()))
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = units(text), units(other)
            assert r[name] == pytest.approx(2 * len(a & b) / (len(a) + len(b)) if a or b else 1)
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"] and prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]


def test_fingerprints_of_awkward_tables(awkward, clashing, nothing):
    a, b = (sorted(map(str, iblt.edited_fingerprints(x).collect())) for x in (awkward, clashing))
    assert a == b and len(a) == awkward.count()
    # repeated and null ids too have a text that follows: every text but one per place is some row's next
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.select("doc_id", "text").collect()]
    nexts = iblt.with_next(awkward.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"]).collect()
    assert Counter(r["next_text"] for r in nexts) == Counter(t for _, t in rows) == Counter(r["text"] for r in nexts)
    once = {i: t for i, t in rows if sum(j == i for j, _ in rows) == 1 and i is not None}
    ids = sorted(once)
    after = {r["doc_id"]: r["next_text"] for r in nexts}
    assert all(after[i] == once[j] for i, j in zip(ids, ids[1:], strict=False) if j == i + 1)
    assert iblt.edited_fingerprints(nothing).count() == 0
    assert iblt.edited_fingerprints(awkward.where("doc_id = 12").limit(1)).select("near_next").first()[0] == 1.0


def test_sketches_are_subtracted_at_once_and_peel_to_the_difference(spark):
    rows = [(i, [(i * 7919 + k * 104729) % 1000003 for k in range(n)], [(i * 7919 + k * 104729) % 1000003 for k in range(n // 2, n // 2 + m)]) for i, (n, m) in enumerate([(0, 0), (0, 3), (5, 5), (9, 0), (30, 31), (200, 40), (400, 400)])]
    df = spark.createDataFrame(rows, "id int, a array<bigint>, b array<bigint>").withColumn("size", F.expr("(size(a) + size(b)) * 3 + 12"))
    a, b, size = F.col("a"), F.col("b"), F.col("size")
    apart, at_once = iblt.subtract(iblt.sketch(a, size, 2), iblt.sketch(b, size, 2)), iblt.subtracted(a, b, size, 2)
    got = df.select("a", "b", (apart == at_once).alias("same"), iblt.peel(at_once, size, 2).alias("d"), iblt.sketch(a, F.lit(24)).alias("f")).collect()
    for r in got:
        assert r["same"] and (set(r["d"]["plus"]), set(r["d"]["minus"])) == (set(r["a"]) - set(r["b"]), set(r["b"]) - set(r["a"]))
        assert sum(x["n"] for x in r["f"]) == 3 * len(r["a"]) and [x["c"] for x in r["f"]] == sorted({x["c"] for x in r["f"]})


# 4: surrogates
def test_surrogates(spark):
    texts = [
        "Mail Anna.Berg7@corp.com or anna.berg7@CORP.com, call (415) 555-0199 or 415-555-0199.",
        "SSN 123-45-6789, card 4111 1111 1111 1111, host 192.168.1.7, Mrs. Marta Stein met Mr Stein and Г-жа Иванова.",
        "Mrs. Marta Stein again; nothing else. Version 1.2.3 costs 12 euros.",
        None, "", "no data here", "anna.berg7@corp.com",
    ]
    df = spark.createDataFrame([(k, t, "en", 1) for k, t in enumerate(texts)] + [(0, texts[0], "en", 1)], "doc_id long, text string, lang string, seed int")
    out = [tuple(r) for r in pii.replace_entities(df, "k").orderBy("doc_id").select("doc_id", "text", "n_entities").collect()]
    by = {r[0]: r for r in out}
    assert len(out) == len(texts) + 1 and [r for r in out if r[0] == 0][0] == [r for r in out if r[0] == 0][1]
    mail = re.findall(r"\S+@[\w.]+\w", by[0][1])
    assert mail[0].rstrip(",") == mail[1].rstrip(",") == by[6][1] and "corp" not in by[0][1].lower()
    assert re.search(r"\(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}\.", by[0][1]) and len(set(re.sub(r"\D", "", x)[-10:] for x in re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", by[0][1]))) == 1
    for gone in ("123-45-6789", "4111 1111", "192.168.1.7", "Marta", "Иванова"):
        assert gone not in by[1][1]
    assert re.search(r"SSN \d{3}-\d{2}-\d{4}, card 4\d{3} \d{4} \d{4} \d{4}, host 10\.\d+\.\d+\.\d+, Mrs\. \w+ \w+ met Mr \w+ and Г-жа [А-Яа-я]+\.", by[1][1])
    assert by[2][1].split(" again")[0] in by[1][1] and by[2][1].endswith("Version 1.2.3 costs 12 euros.")
    assert [by[k][1:] for k in (3, 4, 5)] == [(None, 0), ("", 0), ("no data here", 0)]


def test_surrogates_keep_identities_apart_on_the_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, pii.replace_entities(docs, "k")))
    find = re.compile(pii.KINDS["email"])
    seen = {}
    for i, t in before.items():
        a, b = find.findall(t or ""), find.findall(after[i] or "")
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert seen.setdefault(x.lower(), y.lower()) == y.lower()
    assert seen and len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())


def test_surrogates_keep_people_together_and_apart(spark):
    texts = [
        "Mrs. Stein, Mrs Stein, Mrs. Marta Stein, Frau Stein and Frau Marta Stein; Mr. Stein is her son.",
        "Mrs. Olga Stein is someone else, and so is Mrs. Marta Weber.",
        "Ring +49 30 1234567 or +49-30-1234567, else +33 1 23 45 67 89 or (415) 555-0199. Order 12345678 is open.",
        "From 8.8.8.8 to 10.1.2.3 and 192.168.0.9.",
        "x" * 200_000 + " mail a@b.org",
        *[f"Herr {a}{b} Berg met Ms {a}{b}" for a in ("Ka", "Lo", "Mi", "Nu") for b in ("ro", "si", "ta", "vu", "we", "xo")],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r["text"] for r in pii.replace_entities(df, "k").orderBy("doc_id").collect()]
    stein = re.findall(r"(?:Mrs\.?|Frau|Mr\.) (?:([A-Z]\w+) )?([A-Z]\w+)", out[0])
    assert len({x[1] for x in stein}) == 1 and len({x[0] for x in stein} - {""}) == 1 and "Stein" not in out[0]
    (olga, stein2), (marta, weber) = re.findall(r"Mrs\. (\w+) (\w+)", out[1])
    assert stein2 == stein[0][1] != weber and olga != marta == stein[2][0]
    numbers = [re.sub(r"\D", "", x) for x in re.findall(r"\+\d\d[ \d-]+\d", out[2])]
    assert len(numbers) == 3 and numbers[0] == numbers[1] != numbers[2] and out[2].endswith("Order 12345678 is open.") and "1234567 " not in out[2]
    assert re.fullmatch(r"From 2[45]\d\.\d+\.\d+\.\d+ to 10\.\d+\.\d+\.\d+ and 10\.\d+\.\d+\.\d+\.", out[3])
    assert out[4].startswith("x" * 200_000 + " mail ") and "a@b.org" not in out[4]
    given = [re.search(r"Herr (\w+) \w+", x)[1] for x in out[5:]]
    assert len(set(given)) == len(given)  # distinct people keep distinct names


def test_surrogates_replace_entities_only(spark):
    """Against a plain version of the detection: what is between the entities stays, byte for byte."""
    import regex

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, pii.replace_entities(docs, "k")))
    anything = regex.compile("|".join(f"(?:{p})" for p in pii.KINDS.values()))
    of: dict[str, str] = {}
    changed = 0
    for i, t in before.items():
        found = [m.group() for m in anything.finditer(t or "")]
        between = regex.split("|".join(f"(?:{p})" for p in pii.KINDS.values()), t or "")
        if not found:
            assert after[i] == t
            continue
        changed += 1
        at = 0
        for k, piece in enumerate(between):
            assert after[i].startswith(piece, at), i
            at += len(piece)
            if k < len(found):
                new = anything.match(after[i], at).group()
                assert of.setdefault(found[k], new) == new != found[k]
                at += len(new)
        assert at == len(after[i])
    assert changed > 10


def test_surrogates_of_awkward_tables(awkward, nothing, clashing):
    assert pii.replace_entities(nothing, "k").count() == 0
    out = pii.replace_entities(clashing, "k")
    assert out.count() == clashing.count() and set(out.columns) == {*clashing.columns, "n_entities"}


# 5: language
def test_language_by_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = queries.op5_language_id(spark, SF01).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    some = [r for r in rows if len((r["text"] or "").split()) >= 5]
    assert some and sum(r["lang"] == r["lang_pred"] for r in some) >= 0.95 * len(some)
    assert sum(r["rejected"] for r in some) <= 0.02 * len(some)


# Texts in languages that the tables don't have.
FOREIGN = (
    "Wszystkie osoby są równe i wolne pod względem swej godności i swoich praw, powinny postępować wobec innych w duchu braterstwa oraz szacunku dla drugiego człowieka",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства",
)


def test_foreign_texts_are_rejected_and_known_ones_are_not(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    assert all(langid.judge([f"{t} {t}" for t in FOREIGN], model)[2])
    rows = langid.predict(docs.where(langid.held_out()), model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert not any(r["rejected"] for r in rows if len((r["text"] or "").split()) >= 40)
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() > 0.98 * docs.count()


def test_language_equals_a_plain_nearest_centroid(spark, small):
    model = langid.fit(small)
    for r in langid.predict(small, model).join(small.select("doc_id", "text"), "doc_id").collect():
        x = langid.counts(r["text"], 12)
        if x is None:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        x = np.log1p(x) * model.idf
        cosines = [float(x @ c / np.linalg.norm(x) / np.linalg.norm(c)) for c in model.centroids]
        assert r["lang_pred"] == model.langs[int(np.argmax(cosines))] and r["score"] == pytest.approx(max(cosines), abs=1e-5)


def test_letters_are_those_of_category_l():
    assert all(langid.counts(x, 12) is None for x in ("½ ² Ⅷ", "१२ 12", "", None, "_ -"))
    assert all(langid.counts(x, 12) is not None for x in ("ª", "x", "日", "ǅ"))


def test_language_of_awkward_tables(awkward, clashing, nothing):
    for model in (langid.fit(awkward), langid.fit(nothing)):
        a, b = (sorted(map(str, langid.predict(x, model).collect())) for x in (awkward, clashing))
        assert a == b and len(a) == awkward.count() and langid.predict(nothing, model).count() == 0
    und = langid.predict(awkward, langid.fit(awkward)).join(awkward.where("text IS NULL OR text RLIKE '^[ \\t\\n!0-9]*$'").select("doc_id"), "doc_id").collect()
    assert und and all(r["lang_pred"] == "und" and r["score"] == 0 for r in und)


# 6: repeated substrings
def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_repeats(request, table):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute_repeats([r["text"] for r in rows], 400), strict=True))
    assert Counter(plain(substrings.remove_repeats(df, 400), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


def test_repeats_of_a_very_frequent_anchor(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST", 5)
    core = "".join(f"{k * 7919 % 1000:03d}" for k in range(150))
    texts = [f"{'abcdefgh'[k % 8] * (k % 11)}{core}{'stuvwxyz'[k % 7] * (k % 13)}{hashlib.sha256(b'%d' % k).hexdigest() * 3}" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(k, *x) for k, x in enumerate(brute_repeats(texts, 400))}
    assert set(plain(substrings.remove_repeats(df, 400), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


@pytest.mark.parametrize("bucketwise", [0, 200, 10**9])
def test_suffix_arrays(monkeypatch, bucketwise):
    monkeypatch.setattr(suffixes, "BUCKETWISE", bucketwise)
    rng = np.random.default_rng(3)
    for k in range(60):
        text = [*rng.integers(1, rng.integers(2, 6), rng.integers(1, 50)).tolist(), *[1] * (k % 9), 0]
        order = suffixes.suffix_array(np.array(text), 6)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = suffixes.permuted_prefixes(np.array(text), order, -1)
        for a, b in zip(order, order[1:], strict=False):
            pair = text[a:], text[b:]
            assert common[b] == next(i for i, (x, y) in enumerate(zip(*pair, strict=False)) if x != y)


def test_planted_passages_go_and_others_stay(spark):
    """Passages of over 50 words in several documents: those of 400 bytes and more go, whole; no other byte does."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 11))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    passages = [prose(n) for n in (51, 60, 75, 90, 140)]
    texts = [prose(int(rng.integers(60, 200))) for _ in range(40)]
    for k in range(15):
        texts.append(f"{prose(30)} | {passages[k % 5]} | {prose(40)}")
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 400).collect()
    want = brute_repeats(texts, 400)
    for r in got:
        k = r["doc_id"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[k]
        if k < 40:
            assert r["n_removed"] == 0 and bytes(r["kept"]).decode() == texts[k]
        elif len(passages[(k - 40) % 5]) >= 400:
            assert passages[(k - 40) % 5] not in bytes(r["kept"]).decode() and r["n_removed"] >= len(passages[(k - 40) % 5])
    assert sum(len(p) >= 400 for p in passages) >= 3


def test_repeats_of_empty_and_clashing_tables(nothing, awkward, clashing):
    assert substrings.remove_repeats(nothing, 400).count() == 0
    a, b = (sorted(map(str, substrings.remove_repeats(x, 400).collect())) for x in (awkward, clashing))
    assert a == b


# 7: tokens
@pytest.fixture(scope="module")
def oracle():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("table", ["awkward", "small", "clashing"])
def test_tokens_equal_the_library(request, oracle, table):
    df = request.getfixturevalue(table)
    coded = bpe.encode_decode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], np.array(oracle.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes(), (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect())
    assert Counter((a, bytes(b), bytes(c)) for a, b, c in plain(coded, "doc_id", "ids", "decoded")) == want


def test_tokens_of_hard_texts(oracle):
    own = bpe.Encoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    for text in ("a" * 5000, "abcab" * 2000, "ß" * 999, "\n\n  \t x", "don't we'll I'M", "日本語" * 300, "\u0000﻿ é", "x" * 3 + "é" * 7, "12345678901234567890", "<|endoftext|>"):
        assert np.frombuffer(own.encode([text])[0], dtype="<u4").tolist() == oracle.encode_ordinary(text)


# 8: secrets
def brute_secrets(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    found.sort()
    return (*(sum(f[1] == k for f in found) for k in range(3)), ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found))


def test_secrets_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    total = 0
    for r in queries.op8_secret_scan(spark, SF01).collect():
        *counts, spans = brute_secrets(docs[r["doc_id"]])
        total += sum(counts)
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == [*counts, sha(spans.encode())]
        assert set(spans.split(",")) - {""} <= set(r["spans"].split(","))
    assert total > 0


def test_secrets_of_awkward_texts(spark, awkward, clashing, nothing):
    hard = ["PASSWORD = 'abc'", "paſſword=abcdef1", "api_key:\"x" + "y" * 9, "ToKeN==abcdef", "token=token=abcdef", "ü password: geheim123", "AKIA" + "A" * 15, "AKIA" + "B" * 16 + "z", "g" + "0" * 23 + "g" + "f" * 24, "secret\n=abcdef", "apiKey=abcdef", "a" * 30 + "A" + "b" * 24, "Bearer " + "q" * 25, "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + ".sig"]
    got = secrets.scan_texts(hard, secrets.BASE_RULES)
    for t, spans in zip(hard, got, strict=True):
        assert ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans) == brute_secrets(t)[-1], t
    assert [len(x) for x in secrets.scan_texts(hard[-3:], secrets.EXTRA_RULES)] == [1, 1, 1]
    a, b = (sorted(map(str, secrets.scan(x).collect())) for x in (awkward, clashing))
    assert a == b and len(a) == awkward.count() and secrets.scan(nothing).count() == 0


# 9: near copies
def brute_components(rows, words):
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[i].append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize(("table", "words"), [("awkward", 2), ("small", 2), ("small", 5), ("clashing", 5)])
def test_near_copies(request, table, words):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    component, sets = brute_components(rows, words)
    got = minhash.near_duplicates(df, minhash.Params(words=words)).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert r["n_shingles"] in {len(s) for s in sets[i]}
        assert (r["component_id"], r["kept"]) == ((None, True) if i is None else (component[i], component[i] == i))


def test_near_copies_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_copies_of_a_chain_in_one_bucket(spark):
    """Each text is near the next one only; every link is found."""
    words = [f"v{k}" for k in range(400)]
    texts = [" ".join(words[6 * k : 6 * k + 120]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(list(enumerate(texts)), 2)[0]
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, minhash.Params(words=2)).collect()} == want


# 10: quality
def test_quality_follows_the_labels(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = queries.op10_quality(spark, SF01).join(labels, "doc_id").where("quality IS NOT NULL").select("score", "kept", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.9, auc
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.9


def test_quality_of_awkward_tables(awkward, clashing, nothing):
    a, b = (sorted(map(str, quality.score(x).collect())) for x in (awkward, clashing))
    assert a == b and len(a) == awkward.count() and quality.score(nothing).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(5)
    truth, right = rng.random(20000) < 0.7, np.array([0.95, 0.85, 0.8, 0.75, 0.9])
    seen = np.where(rng.random((20000, 5)) < right, truth[:, None], ~truth[:, None])
    posterior, accuracy = quality.estimate(Counter("".join("+" if x else "-" for x in row) for row in seen))
    assert np.allclose(accuracy, right, atol=0.03) and posterior["+++++"] > 0.95 > 0.05 > posterior["-----"]


def test_surrogate_seeds_are_keyed_hashes(spark):
    import hmac

    for key in ("k", "x" * 100):
        got = spark.range(1).select(pii.keyed(key, F.lit("ä|b"), F.lit("2"))).first()[0]
        assert got == hmac.new(key.encode(), "ä|b|2".encode(), "sha256").hexdigest()


def test_private_data_of_long_texts_takes_time_in_proportion(spark):
    """Each of many addresses in one text gets its own surrogate, in place."""
    text = " ".join(f"user{k}@mail{k}.org" for k in range(3000)) + " user7@mail7.org"
    out = pii.replace_entities(spark.createDataFrame([(1, text, "kept")], "doc_id long, text string, __found string"), "k").first()
    mails = out["text"].split(" ")
    assert out["n_entities"] == 3001 and out["__found"] == "kept" and len(set(mails)) == 3000 and mails[7] == mails[-1] and not set(mails) & set(text.split(" "))


def test_encoding_of_nothing(nothing):
    assert bpe.encode_decode(nothing, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_nothing_to_search_and_nothing_to_find(spark, nothing, awkward):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(awkward, items).count() == 0
    assert decontam.contaminated(nothing, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert secrets.scan(nothing).count() == 0 and minhash.near_duplicates(nothing, minhash.Params(words=2)).count() == 0
