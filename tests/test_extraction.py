"""Numbers, times and places in texts: cases, and places against trying every name."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import extraction

PUBLISHED = datetime(2024, 3, 1, 3, 0)  # 9:00 in Bangladesh


@pytest.mark.parametrize(("phrase", "value"), [("1,250", 1250), ("১২৫০", 1250), ("12,50,000", 1250000), ("1.5 lakh", 150000), ("দেড় লাখ", 150000), ("tin hajar", 3000), ("two dozen", 24), ("তিন", 3), ("Seven", 7), ("1.2.3", None), ("hundreds", None), ("several", None), ("hajar", None), ("", None), ("rain", None), ("5", 5), ("3 crore", 3e7)])
def test_number_phrases(phrase, value):
    assert extraction.number_of(phrase) == value


def test_numbers_in_texts(spark):
    df = spark.createDataFrame([(1, "Some 1,200 people and তিনজন of two villages; 2.5 lakh taka lost, many more hurt"), (2, None), (3, "none")], "id long, text string")
    got = {r["id"]: r["n"] and [(x["surface"], x["value"]) for x in r["n"]] for r in df.select("id", extraction.numbers()("text").alias("n")).collect()}
    assert got == {1: [("1,200", 1200.0), ("তিন", 3.0), ("two", 2.0), ("2.5 lakh", 250000.0)], 2: None, 3: []}


def local(*ymdhm):
    return datetime(*ymdhm) - timedelta(hours=6)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Gotokal raat 10 tay agun lage", [("Gotokal raat 10 tay", local(2024, 2, 29, 22), local(2024, 2, 29, 22), "minute")]),
        ("আজ সকালে মিরপুরে হাঁটুসমান পানি", [("আজ সকালে", local(2024, 3, 1, 6), local(2024, 3, 1, 12), "part_of_day")]),
        ("The fire broke out at 9:50pm on 29 February", [("9:50pm on 29 February", local(2024, 2, 29, 21, 50), local(2024, 2, 29, 21, 50), "minute")]),
        ("It began last night and went on", [("last night", local(2024, 2, 29, 20), local(2024, 3, 1, 6), "part_of_day")]),
        ("yesterday the road was shut", [("yesterday", local(2024, 2, 29), local(2024, 3, 1), "day")]),
        ("seen the day before yesterday", [("day before yesterday", local(2024, 2, 28), local(2024, 2, 29), "day")]),
        ("since 21 November", [("21 November", local(2023, 11, 21), local(2023, 11, 22), "day")]),
        ("on 5 May 2022 at 10.30 am", [("5 May 2022 at 10.30 am", local(2022, 5, 5, 10, 30), local(2022, 5, 5, 10, 30), "minute")]),
        ("at 10pm the alarm rang", [("10pm", local(2024, 2, 29, 22), local(2024, 2, 29, 22), "minute")]),  # not this evening
        ("গতকাল রাত ১০টায় আগুন", [("গতকাল রাত ১০টায়", local(2024, 2, 29, 22), local(2024, 2, 29, 22), "minute")]),
        ("rat 1 tay", [("rat 1 tay", local(2024, 3, 1, 1), local(2024, 3, 1, 1), "minute")]),
        ("kal ashbe, in the evening, 31 February, 13pm, todayish", []),
        ("", []),
    ],
)
def test_times(text, want):
    assert extraction.times_in(text, PUBLISHED) == [(extraction.composed(s), a, b, p) for s, a, b, p in want]


def test_time_mentions_of_a_table(spark):
    at = (PUBLISHED - datetime(1970, 1, 1)).total_seconds()
    df = spark.createDataFrame([(1, "yesterday, and again on 28 February; next on 2 March 2024", at), (2, None, at), (3, "today", None)], "id long, text string, at double")
    found = extraction.time_mentions(df, "id", "text", "at")
    assert [r["precision"] for r in found.collect()] == ["day"] * 3
    assert [tuple(r) for r in extraction.observed_at(found, df, "id", "at").collect()] == [(1, (local(2024, 2, 28) - datetime(1970, 1, 1)).total_seconds())]


GAZETTEER = [
    ("Dhaka", "Dhaka", "division", None, 23.8, 90.4), ("Dhaka", "Dhaka", "district", "Dhaka", 23.7, 90.4), ("ঢাকা", "Dhaka", "district", "Dhaka", 23.7, 90.4), ("Mirpur", "Mirpur", "locality", "Dhaka", 23.8, 90.3), ("Mirpur", "Mirpur", "upazila", "Kushtia", 23.9, 89.0),
    ("Mirpur 10", "Mirpur 10", "locality", "Dhaka", 23.81, 90.37), ("Kushtia", "Kushtia", "district", "Kushtia", 23.9, 89.1), ("Feni", "Feni", "district", "Feni", 23.0, 91.4), ("মিরপুর", "Mirpur", "locality", "Dhaka", 23.8, 90.3), ("Cox's Bazar", "Cox's Bazar", "district", "Cox's Bazar", 21.4, 92.0),
]
G = "spelling string, name string, level string, district string, lat double, lon double"


def test_places_endings_and_ambiguity(spark):
    texts = {1: "Mirpure pani, Feni-te o", 2: "Mirpur, Kushtia: water", 3: "মিরপুরে আগুন, ঢাকায় নয়", 4: "Mirpur 10 and Dhaka's roads, Mirpur 10 again", 5: "Fenix, admirpur, O'Mirpur, Mirpurs", 6: None, 7: "COX'S BAZAR!", 8: ""}
    found = extraction.place_mentions(spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame(GAZETTEER, G), "id", "text")
    got = {}
    for r in found.orderBy("id", "start").collect():
        got.setdefault(r["id"], []).append((r["name"], r["level"], r["surface"]))
        assert texts[r["id"]][r["start"] : r["end"]] == r["surface"]
    assert got == {1: [("Mirpur", "locality", "Mirpure"), ("Feni", "district", "Feni-te")], 2: [("Mirpur", "upazila", "Mirpur"), ("Kushtia", "district", "Kushtia")], 3: [("Mirpur", "locality", "মিরপুর"), ("Dhaka", "district", "ঢাকা")], 4: [("Mirpur 10", "locality", "Mirpur 10"), ("Dhaka", "district", "Dhaka's")], 7: [("Cox's Bazar", "district", "COX'S BAZAR")]}
    best = {r["id"]: (r["name"], r["level"], r["precision_m"]) for r in extraction.best_place(found).collect()}
    assert best[3] == ("Mirpur", "locality", 2500) and best[4] == ("Mirpur 10", "locality", 2500) and best[2] == ("Mirpur", "upazila", 30000)
    assert best[1][:2] == ("Mirpur", "locality") and 100_000 < best[1][2] < 250_000  # Feni is named too


def test_names_equal_trying_each_at_each_place(spark):
    import ahocorasick

    names = ["an", "anan", "an an", "nan", "na", "anna", "য়না", "না"]
    automaton = ahocorasick.Automaton()
    for n in names:
        automaton.add_word(n, n)
    automaton.make_automaton()
    for text in ("an anan anna nan an an", "banana an-e anane, AN AN's nana", "নানা যনা না", "annae anna-te anter an'x", ""):
        want, at = [], 0
        while at < len(text):
            for n in sorted(names, key=len, reverse=True):
                tail = r"(?:-?(?:e|te|r|er|y|ye|re|tei|ei)|['’]s)?(?![\w'’])" if n.isascii() else ""
                guard = r"(?<![\w'’])" if n.isascii() else "(?<![ঀ-৿])"
                m = re.compile(guard + re.escape(n) + tail, re.I).match(text, at)
                if m:
                    want.append((at, m.end(), n))
                    break
            at = want[-1][1] if want and want[-1][0] == at else at + 1
        assert extraction.spellings_in(text, automaton) == want


def test_gazetteers_without_names_and_too_large(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Dhaka")], "id long, text string")
    assert extraction.place_mentions(texts, spark.createDataFrame([], G), "id", "text").count() == 0
    monkeypatch.setattr(extraction, "MOST_SPELLINGS", 2)
    with pytest.raises(ValueError, match="spellings"):
        extraction.place_mentions(texts, spark.createDataFrame(GAZETTEER, G), "id", "text")


def test_places_are_chosen_without_a_shuffle_of_mentions(spark):
    texts = spark.createDataFrame([(i, "Mirpur, Kushtia and Feni, " * (i % 4)) for i in range(40)], "id long, text string")
    found = extraction.place_mentions(texts, spark.createDataFrame(GAZETTEER, G), "id", "text")
    assert found.count() == 30 * 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_places_equal_joins_and_windows(spark):
    """Texts of many ambiguous names against the rule in SQL; levels, districts and ids may be null."""
    import duckdb

    rows = [(f"n{k % 9}", f"P{k % 5}", ["locality", "upazila", "district", "division", None, "other"][k % 6], None if k % 7 == 3 else f"d{k % 4}", float(k), 1.0) for k in range(40)]
    texts = [(i or None, " ".join(f"n{(i * 7 + j * j * (i % 5 + 1)) % 11}" for j in range(i % 13))) for i in range(60)]
    found = extraction.place_mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(rows, G), "id", "text")
    got = sorted([repr(tuple(r)) for r in found.select("id", "start", "end", "surface", "name", "level", "district", "precision_m").collect()])

    names = {r[0] for r in rows}
    mentions = [(i, m.start(), m.end(), m[0]) for i, t in texts for m in re.finditer(r"\S+", t) if m[0] in names]
    con = duckdb.connect()
    con.execute("CREATE TABLE g (spelling VARCHAR, name VARCHAR, level VARCHAR, district VARCHAR)")
    con.executemany("INSERT INTO g VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    con.execute("CREATE TABLE m (id BIGINT, s INT, e INT, surface VARCHAR)")
    con.executemany("INSERT INTO m VALUES (?, ?, ?, ?)", mentions)
    want = con.execute("""
        WITH f AS (SELECT DISTINCT m.*, g.*, CASE level WHEN 'locality' THEN 0 WHEN 'upazila' THEN 1 WHEN 'district' THEN 2 WHEN 'division' THEN 3 END AS rank FROM m JOIN g ON surface = spelling),
        d AS (SELECT DISTINCT id, district FROM f WHERE level = 'district' AND district IS NOT NULL),
        a AS (SELECT f.*, row_number() OVER (PARTITION BY f.id, s ORDER BY d.id IS NULL AND d.district IS NULL, rank NULLS FIRST, name, f.district NULLS FIRST, level) AS k FROM f LEFT JOIN d ON f.id IS NOT DISTINCT FROM d.id AND f.district = d.district),
        o AS (SELECT *, row_number() OVER (PARTITION BY id, level, name, district ORDER BY s) AS n FROM a WHERE k = 1)
        SELECT id, s, e, surface, name, level, district, CASE level WHEN 'locality' THEN 2500 WHEN 'upazila' THEN 30000 WHEN 'district' THEN 30000 WHEN 'division' THEN 90000 END FROM o WHERE n = 1""").fetchall()
    assert len(got) > 100 and got == sorted(map(repr, want))
