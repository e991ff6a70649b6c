"""Boundaries of the operators that the catalogue's tables don't reach."""

import math
import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from tessera import catalog, session
from tessera.functions.geo import haversine_km, with_cell, with_cells_around
from tessera.operators import checks, claims as claim_ops, extraction, fusion, inference, matching, similar, textual, triage
from tessera.plans.bindings import bound


def test_cells_hold_every_pair_within_reach(spark):
    """At all latitudes and across 180 degrees, for several reaches."""
    points = [(k, lat, lon) for k, (lat, lon) in enumerate((lat, lon) for lat in (-89.9, -60.0, -0.01, 0.02, 33.4, 70.0, 89.95) for lon in (-179.99, -90.0, 0.0, 0.03, 179.98))]
    points += [(100 + k, lat + dlat, lon + dlon) for k, (_, lat, lon) in enumerate(points) for dlat, dlon in [(0.03, 0.02)] if abs(lat + dlat) < 90]
    df = spark.createDataFrame([(i, a, (o + 180) % 360 - 180) for i, a, o in points], "id long, lat double, lon double")
    for km in (1.0, 5.0, 50.0, 305.0):
        left = with_cell(df, km).select("id", "lat", "lon", "band", "cell")
        right = with_cells_around(df.selectExpr("id AS other", "lat AS elat", "lon AS elon"), km, "elat", "elon")
        far = haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon"))
        found = [(r[0], r[1]) for r in left.join(right, ["band", "cell"]).where(far <= km).select("id", "other").collect()]
        all_ = df.crossJoin(df.selectExpr("id AS other", "lat AS elat", "lon AS elon")).where(far <= km).select("id", "other").collect()
        assert len(found) == len(set(found)) and set(found) == {(r[0], r[1]) for r in all_}


def test_burst_leaves_out_the_start_of_its_window(spark):
    minute = 60_000_000
    rows = [(k, 1, t) for k, t in enumerate([0, 10 * minute, 10 * minute, 20 * minute - 1])]
    got = matching.burst(spark.createDataFrame(rows, "report_id long, reporter long, received_us long"), 10.0, 1).collect()
    assert {r["report_id"]: r["n_before"] for r in got} == {1: 1, 2: 1, 3: 2}


def test_travel_looks_at_the_report_nearest_in_time(spark):
    rows = [(1, 7, 0.0, 0.0, 0.0), (2, 7, 3600.0, 0.0, 1.0), (3, 7, 3700.0, 0.0, 1.0), (4, 8, 0.0, 0.0, 0.0), (5, 9, 0.0, 0.0, 0.0), (6, 9, 0.0, 0.0, 0.02)]
    got = matching.impossible_travel(spark.createDataFrame(rows, "report_id long, reporter long, t double, lat double, lon double"))
    assert sorted(r["report_id"] for r in got.collect()) == [5, 6]
    got = matching.impossible_travel(spark.createDataFrame(rows, "report_id long, reporter long, t double, lat double, lon double"), 100.0)
    assert sorted(r["report_id"] for r in got.collect()) == [1, 5, 6]


def test_roots_of_chains_and_cycles(spark):
    up = {1: 2, 2: 3, 3: 4, 4: None, 5: 99, 10: 11, 11: 12, 12: 10, 13: 10, 14: 13, 20: 21, 21: 20, 30: 30}
    rows = spark.createDataFrame(list(up.items()), "node long, up long")
    got = {r["node"]: r["root"] for r in fusion.roots(rows, "node", "up").collect()}
    assert got == {1: 4, 2: 4, 3: 4, 4: 4, 5: 99, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 20: 20, 21: 20, 30: 30}
    assert {r["root"]: r["n_nodes"] for r in checks.cycles(rows, "node", "up").collect()} == {10: 5, 20: 2}
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(300)], "node long, up long")
    assert {r["root"] for r in fusion.roots(chain, "node", "up").collect()} == {0}


def test_cycles_are_found_when_steps_go_round(spark, monkeypatch):
    """The rounds follow from the longest chain or cycle, not from the number of rows."""
    tables = []
    monkeypatch.setattr(fusion, "stored", lambda df, name: tables.append(name) or session.stored(df, name))
    rows = spark.range(3000).selectExpr("id AS node", "IF(id % 10 < 4, id - id % 10 + (id + 1) % 4, id - 3) AS up")
    up = {n: u for n, u in rows.collect()}

    def root(n):
        seen = []
        while n not in seen:
            seen.append(n)
            n = up[n]
        return min(seen[seen.index(n) :])

    assert {r["node"]: r["root"] for r in fusion.roots(rows, "node", "up").collect()} == {n: root(n) for n in up}
    assert len(tables) <= 7



def test_labels_of_items(spark):
    schema = "vote_id long, item long, source long, seen double, vote int, source_type string, relation long, copy_of long, conflict string, stated double"
    rows = [(0, 100, 1, 0.0, 1, "field", 0, None, None, None)]
    two = lambda k, item, *more: [(k + j, item, j + 1, 0.0, vote, "field", relation, None, conflict, stated) for j, (vote, relation, conflict, stated) in enumerate(more)]
    rows += two(10, 1, (1, 0, None, 5.0), (1, 0, None, 5.5))
    rows += two(20, 2, (1, 1, "casualty_count", None), (1, 0, None, None))
    rows += two(30, 3, (-1, 2, None, None), (-1, 2, None, None))
    rows += two(40, 4, (1, 0, None, None), (-1, 2, None, None))
    rows += two(50, 7, (1, 1, "occurrence", None), (1, 1, None, None))  # only the occurrence is marked, or nothing
    rows += two(60, 8, (1, 0, None, 5.0), (1, 0, None, 50.0))  # counts said together that don't agree
    rows += [(70, 9, 1, 0.0, 1, "field", 0, None, None, 5.0), (71, 9, 2, 50000.0, 1, "field", 0, None, None, 50.0)]  # said half a day apart
    rows += [(80, 5, 3, 0.0, None, "news", 3, None, None, None), (90, 6, 9, 0.0, 1, "social", 0, None, None, None)]
    votes, outcomes = spark.createDataFrame(rows, schema), spark.createDataFrame([(100, 1)], "item long, happened long")
    got = {r["item"]: r["label"] for r in fusion.label_rule(votes, outcomes).collect()}
    assert got == {1: "verified", 2: "partially_verified", 3: "refuted", 4: "conflicting", 5: "insufficient_evidence", 6: "unverified", 7: "verified", 8: "partially_verified", 9: "verified", 100: "verified"}


def test_rising_counts(spark):
    day = 86400.0
    rows = [("a", 0.0, 10.0), ("a", 5 * day, 12.0), ("b", 0.0, 10.0), ("b", 5 * day, 12.1), ("c", 5 * day, 9.0), ("d", 0.0, 1.0), ("d", 7 * day, 9.0), ("e", 0.0, None), ("e", 5 * day, 3.0)]
    got = fusion.rising(spark.createDataFrame(rows, "item string, at double, count double"), 5.5 * day).collect()
    assert [tuple(r) for r in got] == [("b", 10.0, 12.1)]


def test_priorities(spark):
    fact = {"event_id": 1, "hazard": 3, "deaths": 0, "affected": 300, "affected_unit": "people", "depth": "knee-deep", "family": "weather", "n_recent": 0, "rising": False, "ended": None, "age_days": 0.5, "assessment": "unverified", "p": 0.9, "n_sources": 3, "status": "active"}
    changes = [{}, {"affected_unit": "households"}, {"depth": "waist-deep"}, {"rising": True}, {"deaths": 10, "n_recent": 3}, {"assessment": "refuted"}, {"status": "resolved"}, {"p": None, "n_sources": 1, "deaths": None}]
    rows = [tuple((fact | c | {"event_id": k}).values()) for k, c in enumerate(changes)]
    schema = "event_id long, hazard int, deaths int, affected long, affected_unit string, depth string, family string, n_recent int, rising boolean, ended double, age_days double, assessment string, p double, n_sources int, status string"
    got = {r["event_id"]: (r["points"], r["level"]) for r in checks.priority(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: (3, "medium"), 1: (4, "medium"), 2: (4, "medium"), 3: (4, "medium"), 4: (8, "critical"), 5: (-1, "low"), 6: (0, "low"), 7: (2, "low")}


def test_verbatim_looks_for_the_origin_in_the_copy(spark):
    origin = "Water rises in the old market, says Mayor"
    rows = [(1, f"Share this: {origin.upper()}!!! please"), (2, "Water rises in the old"), (3, "water rises - in the old market says mayor"), (4, None), (5, "xwater rises in the old market says mayory"), (6, "short one")]
    origins = [(1, origin), (2, "short one"), (3, "short"), (4, ""), (5, None), (6, "averylongsinglewordindeed")]
    copies, of = spark.createDataFrame(rows, "c long, text string"), spark.createDataFrame(origins, "o long, text string")
    assert {tuple(r) for r in textual.verbatim_copies(copies, of, "c", "o").collect()} == {(1, 1), (3, 1), (5, 1), (6, 2)}
    pairs = copies.withColumnRenamed("text", "a").crossJoin(of.withColumnRenamed("text", "b"))
    assert {(r["c"], r["o"]) for r in pairs.where(textual.verbatim(F.col("a"), F.col("b"))).collect()} == {(1, 1), (3, 1), (5, 1), (6, 2)}


def test_languages(spark):
    texts = {"mirpur e onek pani": "bn-Latn", "The road is under water": "en", "Fire": "en", "মিরপুরে পানি": "bn", "মিরপুরে পানি km": "bn", "মিরপুরে big water and fire": "mixed", "onek pani ekhono but the road is shut": "mixed", "বন্যা Water Development Board": "mixed", "": "en"}
    got = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", textual.language(F.col("t")).alias("k")).collect()}
    assert got == texts


def test_retrieval_equals_scoring_every_article(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    articles = [(k, None if k == 7 else " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.randint(0, 40)))) for k in range(300)]
    queries = [(k, " ".join(rng.sample(words, 6))) for k in range(20)] + [(20, "unknown"), (21, None)]
    n, sizes = len(articles), {k: len((t or "").split()) for k, t in articles}
    mean = sum(sizes.values()) / n
    df = Counter(w for _, t in articles for w in set((t or "").split()))
    want = {}
    for q, text in queries:
        scores = {}
        for k, t in articles:
            tf = Counter((t or "").split())
            s = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.4 / (tf[w] + 1.4 * (0.25 + 0.75 * sizes[k] / mean)) for w in set((text or "").split()) if tf[w]]
            if s:
                scores[k] = round(sum(s), 5)
        for rank, k in enumerate(sorted(scores, key=lambda k: (-scores[k], k))[:7]):
            want[q, rank] = k
    found = textual.bm25(spark.createDataFrame(articles, "id long, text string"), spark.createDataFrame(queries, "query long, q string"), "id", "text", "query", top=7)
    assert {(r["query"], r["rank"]): r["id"] for r in found.collect()} == want


def test_nearest_vectors_in_blocks(spark):
    rng = random.Random(3)
    rows = [(k, [round(rng.gauss(0, 1), 2) for _ in range(3)]) for k in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, x array<float>")
    got = {(r["q"], r["place"]): r["id"] for r in similar.nearest_by_dot(df.where("id % 7 = 0"), df, 4, block=3, chunk=8).collect()}
    want = {}
    for q, x in rows[:60:7]:
        order = sorted(((-round(sum(a * b for a, b in zip(x, y, strict=True)), 4), k) for k, y in rows[:60] if k != q))
        want |= {(q, place): k for place, (_, k) in enumerate(order[:4], 1)}
    assert got == want


def test_spans_near_each_other_equal_all_pairs(spark):
    """Reaches on both sides of the doubling widths, spans over slots' edges, places unknown."""
    rng = random.Random(4)
    items = [(k, t := rng.uniform(0, 4e6), t + rng.choice([0, 3e5]), rng.uniform(22, 25), rng.uniform(88, 92), rng.choice([5.0, 5.1, 9.0, 10.0, 33.0, 160.0, 305.0]), 1) for k in range(80)] + [(900, 0.0, 0.0, None, None, 5.0, 1)]
    incidents = [(k, t := rng.uniform(0, 4e6), t + rng.choice([0, 1e5, 9e5]), rng.uniform(22, 25), rng.uniform(88, 92)) for k in range(80)]
    left = spark.createDataFrame(items, "id long, start double, end double, lat double, lon double, reach double, type int")
    right = spark.createDataFrame(incidents, "event_id long, started double, until double, elat double, elon double")
    got = Counter((r["id"], r["event_id"]) for r in matching.near_spans(left, right, 305.0, 48.0).collect())
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon"))
    all_ = left.crossJoin(right).where((km <= F.col("reach")) & (F.col("started") <= F.col("end") + 172800) & (F.col("until") >= F.col("start") - 172800))
    assert got == Counter((r["id"], r["event_id"]) for r in all_.collect()) and len(got) > 50


def test_poisson_tail(spark):
    got = spark.range(1).select(*[checks.poisson_tail(F.lit(k), F.lit(2.0)).alias(str(k)) for k in (0, 1, 3)]).first()
    assert got[0] == 1.0 and abs(got[1] - 0.864665) < 1e-6 and abs(got[2] - 0.323324) < 1e-6


def test_review_queue_of_incidents_with_and_without_votes(spark):
    schema = "vote_id long, item long, source long, seen double, vote int, source_type string, relation long, copy_of long, conflict string, stated double"
    votes = spark.createDataFrame([(0, 100, 1, 0.0, 1, "field", 0, None, None, None), (1, 1, 1, 0.0, 1, "field", 0, None, None, None), (2, 1, 2, 0.0, 1, "field", 0, None, None, None), (3, 2, 7, 0.0, 1, "social", 0, None, None, None)], schema)
    outcomes = spark.createDataFrame([(100, 1)], "item long, happened long")
    rows = [(1, "active", "high", "unverified", 1.0), (2, "active", "high", "unverified", 2.0), (3, "monitoring", "medium", "insufficient_evidence", 3.0), (4, "resolved", "critical", "unverified", 4.0), (5, "active", "medium", "refuted", 5.0)]
    incidents = spark.createDataFrame(rows, "event_id long, status string, priority string, assessment string, started double")
    requests = spark.createDataFrame([(3, 2)], "event_id long, answers int")
    got = triage.review_queue(incidents, votes, outcomes, requests).orderBy("place").collect()
    assert [r["event_id"] for r in got] == [2, 5, 3, 1]
    by = {r["event_id"]: r for r in got}
    assert by[1]["suggested"] == "verified" and by[1]["differs"] and not by[2]["differs"] and not by[3]["differs"] and by[5]["differs"]
    assert by[3]["reasons"] == ["priority: medium", "no evidence yet", "answers so far: 2"] and by[3]["score"] == 2.0
    assert any(x.startswith("team says unverified, evidence verified") for x in by[1]["reasons"])
    assert [r["event_id"] for r in triage.review_queue(incidents, votes, outcomes, requests, 2).collect()] == [2, 5]


def test_stances_in_the_order_of_the_lines(spark):
    lines = {"sim": F.lit(0.8), "entail": F.lit(0.5), "contra": F.lit(0.5), "cues": F.lit(1), "strong": F.lit(5)}
    rows = [(0.7, 1.0, 1.0, 9, 9), (0.9, 0.9, 0.0, 5, 0), (0.9, 0.9, 0.6, 1, 0), (0.9, 0.1, 0.25, 0, 1), (0.9, 0.5, 0.0, 0, 0), (0.9, 0.1, 0.6, 0, 0), (0.9, 0.1, 0.1, 0, 3), (None, 0.1, 0.1, 0, 0)]
    df = spark.createDataFrame(rows, "sim double, entail double, contra double, correct int, doubt int")
    got = [r[0] for r in df.select(triage.stance(*[F.col(c) for c in df.columns], lines)).collect()]
    assert got == ["unrelated", "corrects", "corrects", "questions", "repeats", "corrects", "mentions", "mentions"]


def _crowd(spark, n):
    """Items and incidents by chance in a few places, many of them in one; some types and places are unknown."""
    rng = random.Random(5)
    place = lambda k: (23.0, 90.0) if k % 3 else (23.0 + rng.random(), 90.0 + rng.random())
    kind = lambda k: None if k % 41 == 7 else k % 3
    items = [(k, t, t + 3600.0 * (k % 5), *(place(k) if k % 29 else (None, None)), 5.0 + k % 7 * 20.0, kind(k), "new") for k, t in ((k, rng.random() * 40 * 86400) for k in range(n))]
    incidents = [(k, t, t + 3600.0 * (k % 90), *place(k), kind(k), "active") for k, t in ((k, rng.random() * 30 * 86400) for k in range(n))]
    return (
        spark.createDataFrame(items, "signal_id long, start double, end double, lat double, lon double, reach double, type int, item_status string"),
        spark.createDataFrame(incidents, "event_id long, started double, until double, elat double, elon double, etype int, status string"),
    )


def test_nearest_pairs_are_those_of_all_pairs_without_keeping_all(spark):
    """Dense places give pairs as the seekers want them, not all; the first of each seeker are those of all pairs."""
    items, incidents = _crowd(spark, 500)
    linked = items.selectExpr("signal_id", "signal_id % 50 AS event_id")
    every = matching.near_spans(items, incidents, 305.0, 48.0).cache()
    for seeker, other, side, limit in (("signal_id", "event_id", items, 4), ("event_id", "signal_id", incidents, 6)):
        wanted = matching._wanted(side, linked, seeker, limit)
        found = matching.nearest_spans(items, incidents, seeker, other, wanted, 305.0, 48.0).cache()
        want = matching.ranked(every.join(linked, [seeker, other], "left_anti"), seeker, other, limit)
        got = matching.ranked(found.join(linked, [seeker, other], "left_anti"), seeker, other, limit)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
        assert found.count() <= wanted.agg(F.sum("n")).collect()[0][0] < every.count()


def test_pairs_carry_only_what_ranks_them(spark, monkeypatch):
    """The tables of a search have the columns that rank pairs and, of a seeker, no more pairs than it wants."""
    made = []
    monkeypatch.setattr(matching, "stored", lambda df, name: made.append((name, session.stored(df, name))) or made[-1][1])
    items, incidents = _crowd(spark, 300)
    wanted = matching._wanted(items, items.selectExpr("signal_id", "1L AS event_id").where("signal_id % 7 = 0"), "signal_id", 3)
    found = matching.nearest_spans(items.withColumn("more", F.lit("x")), incidents, "signal_id", "event_id", wanted, 305.0, 48.0)
    assert set(found.columns) == {"signal_id", "event_id", "type", "etype", "km_apart", "hours_apart"}
    assert all({"more", "status", "item_status"}.isdisjoint(df.columns) for _, df in made)
    for name, df in made:
        if name == "near-pairs":
            assert df.where("k > n").count() == 0 and "started" not in df.columns
    assert found.count() > 300


def test_newest_incidents_in_windows_that_grow(spark):
    items, incidents = _crowd(spark, 400)
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon"))
    days = 14 * 86400.0
    pairs = items.crossJoin(incidents).where((far <= F.col("reach")) & (F.col("started") <= F.col("end") + days) & (F.col("until") >= F.col("start") - days)).select("signal_id", "started", "event_id").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-r["started"], r["event_id"])):
        want.setdefault(r["signal_id"], []).append(r["event_id"])
    for first in (64, 100000):
        got = matching.retrieved(items, incidents, "signal_id", 50.0, 14.0, 5, first).collect()
        assert sorted((r["signal_id"], r["place"], r["event_id"]) for r in got) == sorted((k, p + 1, e) for k, v in want.items() for p, e in enumerate(v[:5]))


def test_all_incidents_within_reach_come_without_a_limit(spark):
    items, incidents = _crowd(spark, 300)
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon"))
    days = 14 * 86400.0
    pairs = items.crossJoin(incidents).where((far <= F.col("reach")) & (F.col("started") <= F.col("end") + days) & (F.col("until") >= F.col("start") - days)).select("signal_id", "started", "event_id").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-r["started"], r["event_id"])):
        want.setdefault(r["signal_id"], []).append(r["event_id"])
    got = matching.retrieved(items, incidents, "signal_id", 50.0, 14.0, None).collect()
    assert sorted((r["signal_id"], r["place"], r["event_id"]) for r in got) == sorted((k, p + 1, e) for k, v in want.items() for p, e in enumerate(v))
    assert catalog.QUERIES["retrieve"](spark, "/root/testdata/sf0.01").agg(F.max("place")).first()[0] > 20


def test_hashes_are_compared_once_and_their_rows_paired_in_chunks(spark, monkeypatch):
    """Many rows of few hashes, nulls, and an id that comes twice: all pairs by brute force, while only the different hashes meet."""
    made = {}
    monkeypatch.setattr(textual, "stored", lambda df, name: made.setdefault(name, session.stored(df, name)))
    rows = [(k, (0, 1, 3, 257, 40000, None)[k * k % 7 % 6]) for k in range(120)] + [(5, 3), (None, 1)]
    got = Counter((r["a"], r["b"], r["bits"]) for r in textual.hamming_within(spark.createDataFrame(rows, "id long, h long"), "id", "h", 16, 1, chunk=4).collect())
    want = Counter((a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if None not in (a, b, x, y) and a < b and (x ^ y).bit_count() <= 1)
    assert got == want and sum(got.values()) > 1000
    assert made["hamming-hashes"].count() == len({h for i, h in rows if None not in (i, h)})
    assert made["hamming-chunks"].selectExpr("max(size(ids))").first()[0] < 16


def test_bm25_of_small_chunks_and_blocks_equals_a_loop(spark):
    """Articles in chunks of three and queries in blocks of two: equal scores across chunks go by id; null texts count, without words; ids may be strings."""
    rng = random.Random(5)
    texts = {f"a{k:02d}": None if k % 13 == 7 else " ".join(rng.choices(["x", "y", "z", "u", "v"], k=k % 6)) for k in range(40)}
    asked = {k: " ".join(ws) for k, ws in enumerate((["x"], ["y", "x", "y"], ["u", "none"], ["none"], ["v", "z", "u"]))}
    n, all_ = len(texts), sum(len((t or "").split()) for t in texts.values())
    count = {i: Counter((t or "").split()) for i, t in texts.items()}
    df = Counter(w for c in count.values() for w in c)
    want = []
    for q, ws in asked.items():
        part = lambda c, w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.4 / (c[w] + 1.4 * (0.25 + 0.75 * sum(c.values()) / (all_ / n)))
        scored = sorted((-round(sum(part(c, w) for w in set(ws.split()) if c[w]), 5), i) for i, c in count.items() if set(ws.split()) & set(c))
        want += [(q, i, place) for place, (_, i) in enumerate(scored[:7])]
    articles = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(2)
    found = textual.bm25(articles, spark.createDataFrame(list(asked.items()), "query long, q string"), "id", "text", "query", top=7, block=2, chunk=3)
    assert sorted((r["query"], r["id"], r["rank"]) for r in found.collect()) == sorted(want)


def test_rrf_finds_once(spark, monkeypatch):
    calls, plain = [], textual.bm25
    monkeypatch.setattr(textual, "bm25", lambda *a, **k: calls.append(1) or plain(*a, **k))
    catalog.QUERIES["rrf"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_equal_texts_are_read_once_a_batch(spark, monkeypatch):
    read, plain = [], claim_ops.claims_in
    monkeypatch.setattr(claim_ops, "claims_in", lambda t: read.append(t) or plain(t))
    texts = pd.Series(["Two people were killed", None, "Two people were killed", "Calm", "", None] * 3)
    claim_ops.claims.cache_clear()
    found = claim_ops.claims().func(texts)
    claim_ops.claims.cache_clear()
    assert [None if c is None else [(x["attribute"], x["value"]) for x in c] for c in found] == [None if t is None else [c[:2] for c in plain(t)] for t in texts]
    assert sorted(read) == ["", "Calm", "Two people were killed"]


def test_mentions_and_folds_are_computed_once(spark):
    """A row that is read again counts again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(k, k % 3, float(k * 7 % 11), int(k * 7 % 11 + k % 4 > 6)) for k in range(60)], "id long, fold int, x double, y int")
    assert inference.out_of_fold(rows.mapInPandas(counted, rows.schema), ["x"], "fold").count() == 60 and seen.value == 60
    seen.value = 0
    places = spark.createDataFrame([(1, 0, "A", "district", "d1", 20.0, 88.0, 5), (1, 9, "B", "upazila", "d1", 20.1, 88.0, 3), (2, 0, "C", "district", "d2", 21.0, 89.0, 5)], "id long, start int, name string, level string, district string, lat double, lon double, precision_m int")
    assert extraction.best_place(places.mapInPandas(counted, places.schema)).count() == 2 and seen.value == 3


def test_photo_hashes_of_large_ids(spark, tmp_path):
    """The square of an id over 15 million times the factor is no long any more."""
    ids = [0, 7, 65535, 5_999_999, 15_100_000, 35_999_996, 2**40 + 3]
    spark.createDataFrame([(k, "purchase") for k in ids], "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["photo_id"]: r["hash16"] for r in bound(spark, str(tmp_path), "photos").select("photo_id", "hash16").collect()} == {k: k * k * 40503 % 65536 for k in ids}
