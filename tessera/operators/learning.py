"""Copies, scorers, calibration and thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.geo import haversine_km


def copies(cosines: DataFrame, items: DataFrame, least: float = 0.7, least_field: float = 0.9, least_chars: int = 40) -> DataFrame:
    """Of each item the earlier one it is a copy of: id, origin, cosine.

    cosines: a, b (earlier, later), cosine. items: id, text, source, kind, stance. A copy has another source and no opposed
    stance, both texts at least least_chars, and a cosine of least (field reports: least_field); the most similar counts, of equals the earliest.
    """
    side = lambda p: items.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "text", "source", "kind", "stance")])
    rows = cosines.join(side("o"), F.col("a") == F.col("o_id")).join(side("c"), F.col("b") == F.col("c_id"))
    needed = F.when(F.col("c_kind") == "field", least_field).otherwise(least)
    fits = (F.col("o_source") != F.col("c_source")) & (F.col("o_stance") * F.col("c_stance") >= 0) & (F.col("cosine") >= needed)
    rows = rows.where(fits & (F.length(F.trim("o_text")) >= least_chars) & (F.length(F.trim("c_text")) >= least_chars))
    return rows.groupBy(F.col("b").alias("id")).agg(F.min_by(F.struct("a", "cosine"), F.struct(-F.col("cosine"), "a")).alias("x")).select("id", F.col("x.a").alias("origin"), "x.cosine")


def decided(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Copies with analysts' decisions (id, decision, named): rejected ones go, named origins replace those found, confirmed ones stay."""
    rows = found.join(decisions, "id", "full").where("coalesce(decision, 'confirmed') <> 'rejected'")
    return rows.select("id", F.coalesce("named", "origin").alias("origin")).where("origin IS NOT NULL")


def copy_summary(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items, copies and their share by source."""
    rows = items.join(found.select("id", F.lit(1).alias("is_copy")), "id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("is_copy").alias("n_copies"), F.bround(F.count("is_copy") / F.count("*"), 6).alias("share"))


#: What a pair of items has.
PAIR_FEATURES = ["text_cos", "both_located", "log_km", "log_scaled_km", "log_hours", "same_type", "same_family", "type_unknown"]


def beside(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (a, b, cosine) with both items' columns, as a_... and b_..., and km (null where a place is unknown), reach_km and hours."""
    side = lambda p: items.select(*[F.col(c).alias(f"{p}_{c}") for c in items.columns])
    both = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    km = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    reach = F.coalesce("a_reach", F.lit(0.0)) + F.coalesce("b_reach", F.lit(0.0))
    return both.withColumns({"km": km, "reach_km": reach, "hours": F.abs(F.col("a_t") - F.col("b_t")) / 3600})


def pair_features(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The eight features of each pair of items: a, b, PAIR_FEATURES. items: id, t, lat, lon, reach (km), type, family; unknown places and types have neutral values and a flag."""
    known = F.col("a_type").isNotNull() & F.col("b_type").isNotNull()
    same = lambda c: F.coalesce(known & (F.col(f"a_{c}") == F.col(f"b_{c}")), F.lit(False)).cast("double")
    none = F.lit(0.0)
    values = [F.col("cosine"), F.col("km").isNotNull().cast("double"), F.coalesce(F.log1p("km"), none), F.coalesce(F.log1p(F.col("km") / (1 + F.col("reach_km"))), none), F.log1p("hours"), same("type"), same("family"), (~known).cast("double")]
    return beside(pairs, items).select("a", "b", *[v.alias(n) for v, n in zip(values, PAIR_FEATURES, strict=True)])


def rule_score(cosine: Column, km: Column, reach: Column, hours: Column, most_hours: float = 48.0, most_km: float = 5.0) -> Column:
    """The texts' similarity, but 0 too far apart in time or place (places unknown: not too far)."""
    return F.when((hours > most_hours) | (F.coalesce(km, F.lit(0.0)) > most_km + F.least(reach, F.lit(300.0))), 0.0).otherwise(cosine)


def platt(scores: DataFrame, l2: float = 0.01, rounds: int = 100, close: float = 1e-9) -> tuple[float, float]:
    """a and b of p = sigmoid(a score + b) by Newton's method, a drawn to 1: the driver gets five sums a round. scores: score, y."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(a) * F.col("score") + b))))
        w = p * (1 - p)
        s = scores.agg(F.sum((p - F.col("y")) * F.col("score")), F.sum(p - F.col("y")), F.sum(w * F.col("score") * F.col("score")), F.sum(w * F.col("score")), F.sum(w)).first()
        step = np.linalg.solve([[s[2] + l2 + 1e-9, s[3]], [s[3], s[4] + 1e-9]], [s[0] + l2 * (a - 1), s[1]])
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < close:
            break
    return a, b


def calibrated(scores: DataFrame, model: tuple[float, float]) -> DataFrame:
    z = F.lit(model[0]) * F.col("score") + model[1]
    return scores.withColumn("p", F.bround(1 / (1 + F.exp(-z)), 4))


def threshold_scores(forecasts: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of the forecasts at or over each threshold: counted per score first."""
    per = forecasts.groupBy("p").agg(F.sum("y").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    rows = per.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    over = F.col("p") >= F.col("threshold")
    t = rows.groupBy("threshold").agg(F.sum(F.when(over, F.col("pos")).otherwise(0.0)).alias("hit"), F.sum(F.when(over, F.col("n")).otherwise(0.0)).alias("said"), F.sum("pos").alias("gold"))
    ratio = lambda c: F.when(F.col(c) > 0, F.col("hit") / F.col(c)).otherwise(0.0)
    return t.select("threshold", F.bround(ratio("said"), 6).alias("precision"), F.bround(ratio("gold"), 6).alias("recall"), F.bround(2 * F.col("hit") / (F.col("said") + F.col("gold")), 6).alias("f1"))


def best_threshold(forecasts: DataFrame, thresholds: list[float]) -> DataFrame:
    """The threshold of best F1, of equals the lowest."""
    return threshold_scores(forecasts, thresholds).agg(F.min_by("threshold", F.struct(-F.col("f1"), "threshold")).alias("threshold"), F.max("f1").alias("f1"))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Weights n / (k n_c) that give each of the k classes the same sum."""
    n = rows.groupBy(label).agg(F.count("*").alias("n_c"))
    whole = n.agg(F.sum("n_c").alias("n"), F.count("*").alias("k"))  # one row
    return n.join(F.broadcast(whole)).select(label, F.bround(F.col("n") / (F.col("k") * F.col("n_c")), 6).alias("weight"))


def paired(runs: DataFrame, seed: str, method: str, value: str, a: str, b: str) -> DataFrame:
    """Two methods on the same seeds: wins of each, and the mean and standard deviation of the difference."""
    one = lambda m, c: runs.where(F.col(method) == m).groupBy(seed).agg(F.avg(value).alias(c))
    both = one(a, "va").join(one(b, "vb"), seed).withColumn("d", F.bround(F.col("va") - F.col("vb"), 9))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("wins_a"), F.count_if(F.col("d") < 0).alias("wins_b"), F.bround(F.avg("d"), 6).alias("mean"), F.bround(F.stddev_pop("d"), 6).alias("sd"))


def counts_agree(a: Column, b: Column, share: float = 0.2) -> Column:
    """Whether two counts are within share of the larger."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, a == b).otherwise(F.abs(a - b) <= share * top)
