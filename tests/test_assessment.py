"""Details, figures that moved and briefings against plain cases and loops."""

import random

from pyspark.sql import functions as F

from tessera.operators import assessment, fusion

H = 3600.0


def test_in_dispute_equals_all_pairs(spark):
    r = random.Random(3)
    rows = [(k, float(r.choice([0, 5, 100, 100, 110, 119, 121, -3])) if k % 3 else 100.0 + r.random() * 24, r.random() * 80 * H) for k in range(40) for _ in range(r.randint(0, 6))] + [(1, None, 0.0)]
    pairs = {a[0] for a in rows for b in rows if a[0] == b[0] and a[1] is not None and b[1] is not None and abs(a[2] - b[2]) <= 12 * H and abs(a[1] - b[1]) > 0.2 * max(abs(a[1]), abs(b[1]))}
    found = fusion.in_dispute(spark.createDataFrame(rows, "item int, n double, t double"), "item", "n", "t").collect()
    assert sorted(x[0] for x in found) == sorted(pairs) and pairs


SAID = "item int, attribute string, value string, number double, at double, rate double"


def test_detail_estimates(spark):
    rows = [
        (1, "casualty_count", "3", 3.0, 0.0, 0.9), (1, "casualty_count", "10", 10.0, 30 * H, 0.9), (1, "casualty_count", "11", 11.0, 31 * H, 0.6), (1, "casualty_count", "50", 50.0, 90 * H, 0.3),  # the last is not credible
        (2, "casualty_count", "3", 3.0, 0.0, 0.9), (2, "casualty_count", "9", 9.0, 1 * H, 0.8),
        (3, "cause", "unknown", None, 0.0, 0.9), (3, "cause", "heavy rain", None, 1.0, 0.6), (3, "cause", None, None, 1.0, 0.9),
        (4, "cause", "unknown", None, 0.0, 0.9),
        (5, "magnitude", "knee-deep", None, 5.0, 0.7), (5, "magnitude", "waist-deep", None, 1.0, 0.7), (5, "magnitude", "waist-deep", None, 1.0, None),
        (6, "affected_count", "2.5", 2.5, 0.0, 0.2),
    ]
    found = assessment.detail_estimates(spark.createDataFrame(rows, SAID))
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "casualty_count", "10", 4, False),
        (2, "casualty_count", "3", 2, True),
        (3, "cause", "heavy rain", 2, False),
        (4, "cause", "unknown", 1, False),
        (5, "magnitude", "waist-deep", 3, True),
        (6, "affected_count", "2.5", 1, False),
    ]
    assert assessment.detail_estimates(spark.createDataFrame([], SAID)).count() == 0


def test_moved_figures(spark):
    rows = [(1, 1, "a", 10.0, 1.0), (1, 2, "b", 12.0, 11.0), (2, 3, "a", 10.0, 1.0), (2, 4, "b", 10.0, 2.0), (2, 5, "c", 13.0, 11.0), (2, 6, "d", 13.0, 12.0), (3, 7, "a", 4.0, 12.0), (4, 8, "a", 4.0, 99.0), (5, 9, "a", 4.0, 1.0), (5, 10, "a", None, 12.0)]
    said = spark.createDataFrame(rows, "item int, id int, source string, number double, at double").withColumn("attribute", F.lit("casualty_count"))
    found = assessment.moved_figures(said, 10.0, 20.0).drop("attribute").collect()
    assert sorted(tuple(r) for r in found) == [(2, 10.0, 13.0, 3, 5, "c"), (3, None, 4.0, None, 7, "a")]


def test_briefing(spark):
    incidents = spark.createDataFrame([(1, "flash_flood", "Sylhet", 0.0, None), (2, "fire", None, 0.0, 7200.0), (3, "fire", "X", 0.0, None)], "item int, event_type string, place_name string, started double, ended double")
    evidence = [(11, 1, "Daily", 0.9, 10.0, 0, None), (12, 1, "Post", 0.4, 20.0, 1, None), (13, 1, "Page", 0.6, 30.0, 2, None), (14, 1, "Daily", 0.9, 40.0, 0, 11), (15, 1, "Post", 0.4, 50.0, 3, None), (21, 2, "Page", 0.6, 5.0, 2, None), (41, 4, "Page", 0.6, 5.0, 2, None)]
    evidence = spark.createDataFrame(evidence, "id int, item int, source string, rate double, at double, relation int, copy_of int")
    said = spark.createDataFrame([(1, 11, "Daily", "casualty_count", 3.0, 10.0), (1, 12, "Post", "casualty_count", 1200.0, 20.0)], "item int, id int, source string, attribute string, number double, at double")
    found = {(r["item"], r["kind"], r["place"]): (r["text"], r["cites"]) for r in assessment.briefing(incidents, evidence, said, 15.0, 60.0).collect()}
    assert found == {
        (1, "lead", 1): ("Flash flood at Sylhet, since 01 Jan 1970, 06:00.", [11, 12]),
        (1, "balance", 1): ("2 sources say it happened (1 credible); 1 says it did not.", [11, 12, 13]),
        (1, "denial", 1): ("Page calls it false.", [13]),
        (1, "copies", 1): ("1 item repeats an earlier one and is counted once.", []),
        (1, "latest", 1): ("Latest: Post, 01 Jan 1970, 06:00.", [15]),
        (1, "new", 1): ("3 new items: 1 support it, 1 say it did not happen, 1 only comment.", []),
        (1, "count", 2): ("Casualties: Post now says 1,200, up from 3.", [12, 11]),
        (2, "lead", 1): ("Fire, from 01 Jan 1970, 06:00 to 01 Jan 1970, 08:00.", [21]),
        (2, "balance", 1): ("0 sources say it happened; 1 says it did not.", [21]),
        (2, "denial", 1): ("Page calls it false.", [21]),
        (2, "latest", 1): ("Latest: Page, 01 Jan 1970, 06:00.", [21]),
        (2, "none", 1): ("Nothing new since 01 Jan 1970, 06:00.", []),
        (3, "lead", 1): ("Fire at X, since 01 Jan 1970, 06:00. No evidence is linked yet, so there is nothing to summarise.", []),
        (3, "none", 1): ("Nothing new since 01 Jan 1970, 06:00.", []),
    }


def test_requests(spark):
    requests = spark.createDataFrame([(1, 10, 1.0, "open", None), (2, 10, 2.0, "answered", 3.0), (3, 11, 1.0, "open", None), (4, 11, 1.0, "open", None), (5, 12, 1.0, "open", None)], "request_id int, event_id int, created double, status string, closed double")
    events = spark.createDataFrame([(10, "resolved", 9.0), (11, "active", 9.0)], "event_id int, status string, changed double")
    found = assessment.requests_for_evidence(requests, events, spark.createDataFrame([(2,), (2,)], "request_id int"))
    assert sorted(tuple(r) for r in found.collect()) == [(10, 1, 2, "answered", 3.0, 2), (10, 2, 1, "cancelled", 9.0, 0), (11, 1, 4, "open", None, 0), (11, 2, 3, "open", None, 0), (12, 1, 5, "open", None, 0)]
    assert [tuple(r) for r in assessment.repeated_requests(requests).collect()] == [(11, 2, 3)]


def test_visible_statements(spark):
    statements = spark.createDataFrame([(1, 1, None), (2, 1, 1), (3, 2, None), (4, 9, None), (5, None, None)], "statement_id int, page_id int, supersedes int")
    pages = spark.createDataFrame([(1, "verified"), (2, "pending")], "page_id int, status string")
    seen = lambda *who: sorted((tuple(r)[0], tuple(r)[2]) for r in assessment.visible_statements(statements, pages, *who).collect())
    assert seen("public") == [(1, 2), (2, None)]
    assert seen("official", 2) == [(1, 2), (2, None), (3, None)]
    assert seen("admin") == [(1, 2), (2, None), (3, None), (4, None), (5, None)]
