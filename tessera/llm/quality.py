"""Quality by weak labels: heuristics vote, EM weighs the voters, a hashed linear scorer learns from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.session import stored

from .memory import bound_batches, tidy

BITS = 12


def votes(text: str | None) -> str:
    """One mark per heuristic labeller: + good, - bad, 0 no opinion."""
    t = text or ""
    words = t.split()
    n = len(words)
    letters = sum(map(str.isalpha, t))
    upper = sum(map(str.isupper, t)) if letters else 0
    marks = len(t) - letters - sum(map(str.isspace, t))
    lines = [x for x in t.split("\n") if x.strip()]
    ends = sum(w[-1] in ".!?" for w in words)
    bare = sum(len(w) < 3 and not any(map(str.isalnum, w)) for w in words)

    def say(bad: bool, good: bool) -> str:
        return "-" if bad else "+" if good else "0"

    return "".join(
        (
            say(letters > 0 and upper > 0.4 * letters, n >= 5 and upper < 0.15 * letters),
            say(n == 0 or marks > 0.18 * len(t), n >= 5 and marks < 0.08 * len(t)),
            say(n >= 20 and len(set(words)) < 0.35 * n, n >= 20 and len(set(words)) > 0.5 * n),
            say(n == 0 or n >= 20 and ends < 0.01 * n, n >= 20 and 0.02 * n < ends < 0.4 * n),
            say(len(lines) >= 5 and n < 4 * len(lines), n >= 20 and n > 6 * len(lines)),
            say(letters == 0 or bare > 0.15 * n, n >= 5 and bare < 0.02 * n),
        )
    )


def estimate(patterns: dict[str, int], rounds: int = 100, floor: float = 1e-3) -> tuple[dict[str, float], np.ndarray]:
    """The posterior of good for each vote pattern, and each labeller's accuracy, by EM.

    Labellers are independent given the class; a vote's chances given the class are smoothed, and
    no opinion says nothing. It starts from the guess that any objection is right. The input is the count of each pattern, at most
    3 ** labellers of them, whatever the number of documents.
    """
    if not patterns:
        return {}, np.zeros(0)
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], dtype=float)
    marks = np.array([["-0+".index(c) for c in p] for p in names])
    good = np.where((marks == 0).any(axis=1), 0.1, np.where((marks == 2).any(axis=1), 0.9, 0.5))
    right = np.zeros((2, marks.shape[1]))  # the chance of + given bad, and given good
    voted = marks != 1
    for _ in range(rounds):
        for c, part in enumerate((1 - good, good)):
            plus = ((weight * part)[:, None] * (marks == 2)).sum(axis=0) + 1
            right[c] = plus / (((weight * part)[:, None] * voted).sum(axis=0) + 2)
        prior = np.clip((weight * good).sum() / weight.sum(), floor, 1 - floor)
        logs = [np.log(p) + (np.where(marks == 2, np.log(right[c]), np.log(1 - right[c])) * voted).sum(axis=1) for c, p in enumerate((1 - prior, prior))]
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    accuracy = (1 - prior) * (1 - right[0]) + prior * right[1]
    return dict(zip(names, good.tolist(), strict=True)), accuracy


def features(text: str | None) -> np.ndarray:
    """Hashed byte 3-grams, log counts, normalised; the last place is the bias."""
    data = np.frombuffer((" " + (text or "") + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    x = np.zeros((1 << BITS) + 1, dtype=np.float32)
    if len(data) > 2:
        codes = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)
        x[:-1] = np.log1p(np.bincount(codes >> np.uint32(32 - BITS), minlength=1 << BITS))
        x /= np.linalg.norm(x)
    x[-1] = 1
    return x


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    posterior: dict[str, float]
    accuracy: np.ndarray


def train(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 20.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by gradient steps."""
    w = np.zeros(x.shape[1], dtype=np.float64)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (p - y) / len(x) + decay * w)
    return w


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1500, least: float = 0.5) -> DataFrame:
    """Per row: id_col, votes, posterior (of its vote pattern), score (of the linear scorer), kept (score >= least).

    Accuracies come from the vote patterns of all rows. The scorer is trained on the ``sample`` distinct
    texts of smallest hash (a documented bound) with their posteriors. Null texts count as empty; an
    empty table gives no rows; repeated rows repeat. Very long texts are read whole; a score equal to least is kept,
    and of equal hashes there are only equal texts; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "votes": [votes(t) for t in b["text"]]})

    marked = stored(rows.select(F.xxhash64("text").alias("h"), "text").mapInPandas(tidy(vote), "h long, votes string"), "quality-votes")
    posterior, accuracy = estimate({r["votes"]: r["count"] for r in marked.groupBy("votes").count().collect()})  # at most 3 ** 6 rows
    taken = spark.createDataFrame([(r["h"],) for r in marked.select("h").distinct().orderBy("h").limit(sample).collect()], "h long")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "y": [posterior[votes(t)] for t in b["text"]], "x": [features(t).tobytes() for t in b["text"]]})

    got = rows.select(F.xxhash64("text").alias("h"), "text").join(F.broadcast(taken), "h").mapInPandas(tidy(vectors), "h long, y double, x binary").dropDuplicates(["h"]).orderBy("h").toPandas()
    w = train(np.stack([np.frombuffer(x, dtype=np.float32) for x in got["x"]]), got["y"].to_numpy()) if len(got) else np.zeros((1 << BITS) + 1)
    shared = spark.sparkContext.broadcast(Scorer(w, posterior, accuracy))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            v = [votes(t) for t in b["text"]]
            s = [float(1 / (1 + np.exp(-np.clip(features(t) @ m.weights, -30, 30)))) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "votes": v, "posterior": [m.posterior[p] for p in v], "score": s, "kept": [x >= least for x in s]})

    return rows.mapInPandas(tidy(judge), f"id {kind}, votes string, posterior double, score double, kept boolean").withColumnRenamed("id", id_col)
