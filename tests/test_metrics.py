"""Metrics on tables that the catalogue's bindings don't give."""

import random

from tessera.operators import metrics


def test_auc_of_continuous_scores_runs_in_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.randint(0, 1)) for _ in range(1500)] + [(k / 10, k % 2) for k in range(10)] * 5
    ones, zeros = ([p for p, y in rows if y == side] for side in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    forecasts = spark.createDataFrame(rows, "p double, y int")
    assert abs(metrics.auc(forecasts).first()["auc"] - want) < 1e-6
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert abs(metrics.auc(forecasts).first()["auc"] - want) < 1e-6
        sizes = [r["count"] for r in metrics.score_ranges(forecasts).groupBy("range").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 0.5 * sum(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
