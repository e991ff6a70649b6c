"""What needs a check first and why, stances from features, and events suggested for items."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from .checks import percent
from .fusion import check_value, label_rule, scores, sigmoid, starting_rate, type_rates

#: What a priority weighs, which incidents are open, and labels of what is not decided yet.
IMPACT = {"low": 1, "medium": 2, "high": 3, "critical": 4}
OPEN = ["active", "monitoring"]
UNDECIDED = ["unverified", "insufficient_evidence"]


def review_queue(incidents: DataFrame, votes: DataFrame, outcomes: DataFrame, requests: DataFrame, limit: int = 50) -> DataFrame:
    """The open incidents most in need of a check, with reasons: event_id, suggested, need, score, differs, reasons (array), place.

    incidents: event_id, status, priority, assessment, started. requests: event_id, answers (open ones). An incident's votes are those with its id as item;
    without one, any report would change the picture. Score is the priority's weight times the need; of equal scores the newest incident is first.
    """
    open_ = incidents.where(F.col("status").isin(OPEN))
    field = F.coalesce(F.max(F.when(F.col("source_type") == "field", F.col("type_rate"))), starting_rate(F.lit("field")))
    r = type_rates(votes, outcomes).agg(field.alias("r"))  # one row
    mine = votes.join(open_.select(F.col("event_id").alias("item")), "item", "left_semi")
    known = label_rule(votes, outcomes).join(mine.select("item").distinct(), "item", "left_semi").select(F.col("item").alias("event_id"), F.col("label").alias("suggested"))
    value = check_value(votes, outcomes).select(F.col("item").alias("event_id"), "changes", "need")
    z = scores(votes, outcomes).select(F.col("item").alias("event_id"), "z")
    rows = open_.join(known, "event_id", "left").join(value, "event_id", "left").join(z, "event_id", "left").join(requests.select("event_id", "answers"), "event_id", "left").join(F.broadcast(r))
    rows = rows.withColumns({"suggested": F.coalesce("suggested", F.lit("insufficient_evidence")), "changes": F.coalesce("changes", F.lit(1.0)), "need": F.coalesce("need", F.lit(1.0))})
    weight = F.coalesce(*[F.when(F.col("priority") == k, v) for k, v in IMPACT.items()])
    differs = ~(F.col("assessment").isin(UNDECIDED) & F.col("suggested").isin(UNDECIDED)) & (F.col("assessment") != F.col("suggested"))
    rows = rows.withColumn("score", F.bround(weight * F.col("need"), 4)).withColumn("differs", differs)
    order = Window.orderBy(F.desc("score"), F.desc("started"), "event_id")
    top = rows.orderBy(F.desc("score"), F.desc("started"), "event_id").limit(limit).withColumn("place", F.row_number().over(order))  # limit rows
    step = F.log(F.col("r") / (1 - F.col("r")))
    p = lambda z: percent(F.bround(sigmoid(z), 6))
    words = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    some = F.col("z").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("priority: "), "priority"),
            F.when(some, F.concat(F.lit("happened: "), p(F.col("z")))).otherwise("no evidence yet"),
            F.when(some, F.concat(F.lit("after a report: "), p(F.col("z") + step), F.lit(" or "), p(F.col("z") - step))),
            F.when(some & (F.col("changes") >= 0.995), "either answer changes the assessment").when(some & (F.col("changes") > 0), F.concat(F.lit("changes the assessment: "), percent(F.col("changes")))).when(some, "one report changes nothing"),
            F.when(F.col("differs"), F.concat(F.lit("team says "), words("assessment"), F.lit(", evidence "), words("suggested"))),
            F.when(F.col("answers").isNotNull(), F.concat(F.lit("answers so far: "), F.col("answers").cast("string"))),
        )
    )
    return top.select("event_id", "suggested", F.bround("need", 4).alias("need"), "score", "differs", reasons.alias("reasons"), "place")


def stance(sim: Column, entail: Column, contra: Column, correct: Column, doubt: Column, lines: dict[str, Column]) -> Column:
    """What an article does with a claim, by lines for the similarity, entailment, contradiction, cues and many cues: first of unrelated, corrects, questions, repeats, corrects, mentions."""
    return (
        F.when(sim < lines["sim"], "unrelated")
        .when((correct >= lines["strong"]) | ((contra >= lines["contra"]) & (correct >= lines["cues"])), "corrects")
        .when((doubt >= lines["cues"]) & ((contra >= lines["contra"] / 2) | (entail >= lines["entail"])), "questions")
        .when(entail >= lines["entail"], "repeats")
        .when(contra >= lines["contra"], "corrects")
        .otherwise("mentions")
    )


#: The lines that are tried.
GRID = {"sim": [0.70, 0.78, 0.80, 0.82, 0.85], "entail": [0.3, 0.5, 0.7], "contra": [0.3, 0.5, 0.7], "cues": [1, 2], "strong": [3, 1000000]}


def tuned_stance(rows: DataFrame, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """The lines of best macro-F1 over the gold labels (of equals the first of the grid), with it: place, sim, entail, contra, cues, strong, macro_f1. rows: sim, entail, contra, correct, doubt, gold.

    Equal rows are counted first; each distinct one is judged by every set of lines, whose tables of labels are then added up.
    """
    grid = grid or GRID
    sets = [(k, *map(float, v)) for k, v in enumerate(product(*grid.values()))]
    lines = rows.sparkSession.createDataFrame(sets, "place int, " + ", ".join(f"l_{n} double" for n in grid))
    counted = rows.groupBy("sim", "entail", "contra", "correct", "doubt", "gold").agg(F.count("*").alias("n"))
    said = stance(*[F.col(c) for c in ("sim", "entail", "contra", "correct", "doubt")], {n: F.col(f"l_{n}") for n in grid})
    judged = counted.crossJoin(F.broadcast(lines)).withColumn("said", said)  # the grid is fixed
    cells = judged.groupBy("place", "gold", "said").agg(F.sum("n").alias("n"))
    sides = cells.select("place", F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("s"), F.when(F.col("gold") == F.col("said"), F.col("n")).otherwise(0).alias("hit")).union(cells.select("place", "said", F.lit(0).cast("long"), "n", F.lit(0).cast("long")))
    labels = sides.groupBy("place", "label").agg(F.sum("g").alias("g"), F.sum("s").alias("s"), F.sum("hit").alias("hit")).where("g > 0")
    f1 = labels.groupBy("place").agg(F.bround(F.avg(2 * F.col("hit") / (F.col("g") + F.col("s"))), 6).alias("macro_f1"))
    best = f1.orderBy(F.desc("macro_f1"), "place").limit(1)
    return best.join(lines, "place").select("place", *[F.col(f"l_{n}").alias(n) for n in grid], "macro_f1")


def suggested(features: DataFrame, log_odds: Column, key: str = "id", other: str = "cluster", least: float = 0.05, limit: int = 10) -> DataFrame:
    """Of each item the events it most likely belongs to, those of probability least or more: key, other, p, place. features: a row for each retrieved pair."""
    scored = features.withColumn("p", sigmoid(log_odds)).where(F.col("p") >= least)
    order = Window.partitionBy(key).orderBy(F.desc("p"), other)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select(key, other, F.bround("p", 3).alias("p"), "place")
