"""Scorers and calibrators fitted on whole tables, and the tests that compare methods. The driver gets sums, never rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import discard, stored

from .metrics import score_ranges


def fit_logistic(rows: DataFrame, names: list[str], label: str = "y", c: float = 1.0, rounds: int = 50, close: float = 1e-8) -> dict:
    """A logistic model on standardised features by Newton's method: classes weigh the same, an L2 penalty 1 / (2 c) on all but the intercept.

    A round is one scan: the gradient and the upper half of the Hessian are sums of one aggregation. A feature that never varies has weight 0 by its scale of 1.
    Null features count as 0; rows without a label don't count. A table with one class only has no model.
    """
    x = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names}
    kept = stored(rows.where(F.col(label).isNotNull()).select(*[x[n].alias(f"x{k}") for k, n in enumerate(names)], F.col(label).cast("double").alias("y")), "logistic-rows")
    d = len(names)
    s = kept.agg(F.count("*"), F.sum("y"), *[F.avg(f"x{k}") for k in range(d)], *[F.stddev_pop(f"x{k}") for k in range(d)]).first()
    n, pos = s[0], s[1] or 0.0
    if not 0 < pos < n:
        raise ValueError("training rows need both classes")
    mean, scale = list(s[2 : 2 + d]), [v if v > 1e-12 else 1.0 for v in s[2 + d :]]
    cols = [(F.col(f"x{k}") - mean[k]) / scale[k] for k in range(d)] + [F.lit(1.0)]
    z = stored(kept.select(*[v.alias(f"z{k}") for k, v in enumerate(cols)], "y", F.when(F.col("y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))).alias("w")), "logistic-rows")
    discard(kept)
    beta, penalty = np.zeros(d + 1), np.r_[np.full(d, 1.0 / c), 0.0]
    upper = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    for _ in range(rounds):
        line = sum((F.lit(float(b)) * F.col(f"z{k}") for k, b in enumerate(beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), line))))
        at = z.withColumn("p", p).withColumns({"g": F.col("w") * (F.col("p") - F.col("y")), "h": F.col("w") * F.col("p") * (1 - F.col("p"))})
        sums = at.agg(*[F.sum(F.col("g") * F.col(f"z{k}")) for k in range(d + 1)], *[F.sum(F.col("h") * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in upper]).first()
        hessian = np.diag(penalty + 1e-9)
        for (i, j), v in zip(upper, sums[d + 1 :], strict=True):
            hessian[i, j] += v
            if i != j:
                hessian[j, i] += v
        step = np.linalg.solve(hessian, np.array(sums[: d + 1]) + penalty * beta)
        beta = beta - step
        if np.abs(step).max() < close:
            break
    discard(z)
    return {"names": names, "mean": mean, "scale": scale, "coef": beta[:d].tolist(), "intercept": float(beta[d])}


def line_of(model: dict) -> Column:
    """The model's log odds of a row."""
    parts = [(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - m) / s * b for n, m, s, b in zip(model["names"], model["mean"], model["scale"], model["coef"], strict=True)]
    return sum(parts, F.lit(model["intercept"]))


def probability(model: dict) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), line_of(model)))))


def out_of_fold(rows: DataFrame, names: list[str], fold: str, label: str = "y", c: float = 1.0) -> DataFrame:
    """rows with the log odds (score) that a model fitted without the row's fold gives it: what a calibrator should be fitted on. rows are computed once and stored."""
    rows, parts = stored(rows, "folds"), []
    for (k,) in rows.select(fold).distinct().orderBy(fold).collect():  # a row a fold
        model = fit_logistic(rows.where(F.col(fold) != k), names, label, c)
        parts.append(rows.where(F.col(fold) == k).withColumn("score", line_of(model)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def temperature(scores: DataFrame, c: float = 100.0, rounds: int = 100, close: float = 1e-9) -> float:
    """a of p = sigmoid(a score), with a penalty a² / (2 c), by Newton's method. scores: score, y."""
    a = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(a) * F.col("score")))))
        g, h = scores.agg(F.sum((p - F.col("y")) * F.col("score")), F.sum(p * (1 - p) * F.col("score") * F.col("score"))).first()
        step = ((g or 0.0) + a / c) / ((h or 0.0) + 1 / c)
        a -= step
        if abs(step) < close:
            break
    return a


def _pooled(n: np.ndarray, total: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each block of pooled adjacent violators."""
    blocks: list[list[float]] = []
    for k in range(len(n)):
        blocks.append([k, k, n[k], total[k]])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            first, _, m, t = blocks.pop(-2)
            last = blocks[-1]
            blocks[-1] = [first, last[1], m + last[2], t + last[3]]
    return [(int(b[0]), int(b[1])) for b in blocks]


def _steps(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("low", ignore_index=True)
    n, total = rows["n"].to_numpy(), rows["total"].to_numpy()
    blocks = _pooled(n, total)
    return pd.DataFrame({"low": [rows["low"][a] for a, _ in blocks], "high": [rows["high"][b] for _, b in blocks], "n": [n[a : b + 1].sum() for a, b in blocks], "total": [total[a : b + 1].sum() for a, b in blocks]})


def isotonic(scores: DataFrame) -> DataFrame:
    """The steps of the isotonic regression of y on score: low, high, n, total (of y); their values total / n rise.

    Violators are pooled inside ranges of the sorted scores, each in its own task, then among what the ranges leave: blocks of rising means
    of whole numbers, the corners of a convex line on a grid, at most about the 2/3rd power of the number of rows, mostly far fewer.
    """
    per = score_ranges(scores.select(F.col("score").alias("p"), "y").where("p IS NOT NULL AND y IS NOT NULL"))
    rows = per.select("range", F.col("p").alias("low"), F.col("p").alias("high"), (F.col("pos") + F.col("neg")).alias("n"), F.col("pos").alias("total"))
    schema = "low double, high double, n double, total double"
    inside = rows.groupBy("range").applyInPandas(lambda rows: _steps(rows), schema)
    return stored(inside.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(lambda rows: _steps(rows), schema), "isotonic-steps")


def stepped(scores: DataFrame, steps: DataFrame) -> DataFrame:
    """scores with p: the value of the score's step, between two steps on the line between them, outside of all the nearest."""
    s = steps.orderBy("low").toPandas()  # the steps: see isotonic for their number
    if s.empty:
        return scores.withColumn("p", F.lit(None).cast("double"))
    x, y = np.stack([s["low"], s["high"]], axis=1).ravel(), np.repeat((s["total"] / s["n"]).to_numpy(), 2)
    at = scores.sparkSession.sparkContext.broadcast((x, y))

    @F.pandas_udf("double")
    def value(v: pd.Series) -> pd.Series:
        return pd.Series(np.where(v.isna(), np.nan, np.interp(v.fillna(0.0), *at.value)))

    return scores.withColumn("p", value("score"))


#: A prime below 2^31, and factors without a common structure, for draws that SQL can repeat.
_P, _A, _B, _C = 2147483647, 48271, 69621, 16807


def draw(row: Column, replicate: Column, seed: int) -> Column:
    """A number in [0, 1) that the row, the replicate and the seed decide."""
    h = F.pmod(F.pmod(row, F.lit(_P)) * _A + replicate * _B + F.lit(seed * _C), F.lit(_P))
    for k in range(2):
        h = F.pmod(h * h + replicate * (_A + k) + 12345, F.lit(_P))
        h = F.pmod(h * _B, F.lit(_P))
    return h / _P


#: Where the counts of a Poisson variable of mean 1 change: as often as that a row is drawn into a resample.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def paired_bootstrap(losses: DataFrame, resamples: int = 200, seed: int = 0) -> DataFrame:
    """Mean loss of b less that of a, its 95 % interval and two-sided p: n, diff, ci_low, ci_high, p_value. losses: id (long), a, b.

    A resample draws each row a Poisson number of times, which the row's id, the resample and the seed decide: the same rows in
    any partitioning. Each task adds up its rows for every resample; one row a resample and task is shuffled. Rows with a null don't count.
    """
    kept = losses.where("id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").select("id", (F.col("b") - F.col("a")).alias("d"))
    each = kept.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("u", draw(F.col("id"), F.col("r"), seed))
    times = sum((F.when(F.col("u") >= t, 1).otherwise(0) for t in POISSON), F.lit(0))
    means = each.groupBy("r").agg((F.sum(times * F.col("d")) / F.sum(times)).alias("m"))
    spread = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("under"), F.avg((F.col("m") >= 0).cast("double")).alias("over"))
    whole = kept.agg(F.count("*").alias("n"), F.avg("d").alias("diff"))
    return whole.join(spread).select("n", F.bround("diff", 5).alias("diff"), F.bround("low", 5).alias("ci_low"), F.bround("high", 5).alias("ci_high"), F.least(F.lit(1.0), 2 * F.least("under", "over")).alias("p_value"))  # one row each


def wilcoxon(pairs: DataFrame, key: str, diff: str) -> DataFrame:
    """The exact two-sided signed-rank test of each key's differences: key, n (not zero), w (rank sum of the positive), p. Equal sizes share their mean rank.

    Under the null each rank is added or not with probability 1/2: the distribution of the sum is folded rank by rank. For tests over a few dozen runs a key. A key without a difference has p 1.
    """
    from pyspark.sql import Window

    size = F.bround(F.abs(diff), 9)
    some = pairs.where(f"`{diff}` IS NOT NULL").withColumn("size", size)
    by_size = Window.partitionBy(key, "size")
    ranked = some.where("size > 0").withColumn("twice", 2 * F.rank().over(Window.partitionBy(key).orderBy("size")) + F.count("*").over(by_size) - 1)
    runs = ranked.groupBy(key).agg(F.collect_list("twice").alias("ranks"), F.sum(F.when(F.col(diff) > 0, F.col("twice")).otherwise(0)).alias("w"))
    total = F.aggregate("ranks", F.lit(0).cast("long"), lambda s, r: s + r)
    start = F.transform(F.sequence(F.lit(0), total), lambda v: F.when(v == 0, 1.0).otherwise(0.0))
    fold = lambda acc, r: F.transform(acc, lambda x, v: (x + F.coalesce(F.get(acc, (v - r).cast("int")), F.lit(0.0))) / 2)
    told = runs.withColumn("null", F.aggregate("ranks", start, fold)).withColumn("least", F.least(F.col("w"), total - F.col("w")))
    tail = F.aggregate(F.slice("null", F.lit(1), F.col("least").cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    tests = told.select(key, F.size("ranks").alias("n"), (F.col("w") / 2).alias("w"), F.least(F.lit(1.0), 2 * tail).alias("p"))
    return pairs.select(key).distinct().join(tests, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), F.bround(F.coalesce("p", F.lit(1.0)), 9).alias("p"))


def budgeted(votes: DataFrame, item: str, vote_id: str, budget: int, seed: int = 0) -> DataFrame:
    """At most budget votes of each item, drawn by a hash of seed and vote, the same in any partitioning; 0 keeps all.

    Tasks keep their own smallest hashes of each item first, so a hot item is cut before it is shuffled.
    """
    if budget <= 0:
        return votes
    from pyspark.sql import Window

    order = Window.partitionBy(item).orderBy(draw(F.col(vote_id), F.lit(1), seed), vote_id)
    return votes.withColumn("draw_place", F.row_number().over(order)).where(F.col("draw_place") <= budget).drop("draw_place")


def diverse(ranked: DataFrame, query: str, top: int = 10, per_outlet: int = 3) -> DataFrame:
    """Of each query's ranked articles (query, id, rank, story, outlet, bangla; a bounded list each) the first top ones such that a story is there once, an outlet at most
    per_outlet times, and each language at most half while the other has any; places left are filled from the rest, the outlets' bound kept: query, id, place."""
    half = {True: (top + 1) // 2, False: top // 2}

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "id"])
        rows = rows[~rows["story"].duplicated()]
        taken, outlets, languages, rest = [], {}, {True: 0, False: 0}, []
        for r in rows.itertuples():
            if len(taken) == top:
                break
            if outlets.get(r.outlet, 0) >= per_outlet:
                continue
            if languages[bool(r.bangla)] >= half[bool(r.bangla)]:
                rest.append(r)
                continue
            taken.append(r)
            outlets[r.outlet] = outlets.get(r.outlet, 0) + 1
            languages[bool(r.bangla)] += 1
        for r in rest:
            if len(taken) < top and outlets.get(r.outlet, 0) < per_outlet:
                taken.append(r)
                outlets[r.outlet] = outlets.get(r.outlet, 0) + 1
        taken.sort(key=lambda r: (r.rank, r.id))
        return pd.DataFrame({query: [getattr(r, query) for r in taken], "id": [r.id for r in taken], "place": range(1, len(taken) + 1)})

    kinds = ranked.schema
    return ranked.select(query, "id", "rank", "story", "outlet", "bangla").groupBy(query).applyInPandas(pick, f"{query} {kinds[query].dataType.simpleString()}, id {kinds['id'].dataType.simpleString()}, place int")
