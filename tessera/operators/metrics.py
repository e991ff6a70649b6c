"""Agreement, calibration, ranking and clustering measures as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import stored


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters, from the table of their pairs."""
    pairs = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    total = pairs.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("same"))
    left, right = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.sum(F.col("na") * F.col("nb")).alias("c"))
    out = total.join(chance)  # one row each
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return out.select(F.bround(po, 6).alias("observed"), F.bround(pe, 6).alias("expected"), F.bround((po - pe) / (1 - pe), 6).alias("kappa"))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def brier_and_log_loss(forecasts: DataFrame, clip: float = 1e-6) -> DataFrame:
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("p")))
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    return forecasts.agg(F.count("*").alias("n"), F.bround(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier"), F.bround(F.avg(loss), 6).alias("log_loss"))


def calibration_bins(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins: count, mean forecast, share that happened."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return forecasts.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.bround(F.avg("p"), 6).alias("mean_p"), F.bround(F.avg("y"), 6).alias("share"))


def ece(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    per = forecasts.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return per.agg(F.bround(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def score_ranges(forecasts: DataFrame) -> DataFrame:
    """Counts per distinct score p (pos, neg), with the number of the range of scores that each is in."""
    per = forecasts.groupBy("p").agg(F.sum(F.col("y").cast("double")).alias("pos"), F.sum(1.0 - F.col("y")).alias("neg"))
    return stored(per.repartitionByRange("p").withColumn("range", F.spark_partition_id()), "auc-ranges")


def auc(forecasts: DataFrame) -> DataFrame:
    """Area under the curve with ties at half, from counts per distinct score.

    The running count is taken inside ranges of scores; only the ranges' totals, one row each, come into one task.
    """
    per = score_ranges(forecasts)
    totals = per.groupBy("range").agg(F.sum("neg").alias("all"))
    before = totals.select("range", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    run = per.select("range", "pos", "neg", inside.alias("inside")).join(F.broadcast(before), "range").select("pos", "neg", (F.col("before") + F.col("inside")).alias("below"))
    return run.agg(F.bround(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def bcubed(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """B-cubed precision, recall and F1 of a clustering, from the counts of the overlaps."""
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("c")).agg(F.count("*").cast("double").alias("n"))
    sized = cells.select("n", F.sum("n").over(Window.partitionBy("g")).alias("ng"), F.sum("n").over(Window.partitionBy("c")).alias("nc"))
    sums = sized.agg(F.sum(F.col("n") * F.col("n") / F.col("nc")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("ng")).alias("r"), F.sum("n").alias("t"))
    p, r = F.col("p") / F.col("t"), F.col("r") / F.col("t")
    return sums.select(F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(2 * p * r / (p + r), 6).alias("f1"))


def pairwise_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Pairwise precision and recall from counts: no pair is ever made."""
    pairs = lambda *c: rows.groupBy(*c).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("x"))
    both, g, c = (pairs(*x).withColumnRenamed("x", n) for x, n in (((gold, predicted), "both"), ((gold,), "g"), ((predicted,), "c")))
    out = both.join(g).join(c)  # one row each
    return out.select(F.bround(F.col("both") / F.col("c"), 6).alias("precision"), F.bround(F.col("both") / F.col("g"), 6).alias("recall"))


def alpha(ratings: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal labels (unit, label): null without two ratings of a unit, 1 where nothing disagrees or could.

    From counts per unit and label; no pair of ratings is made.
    """
    cells = ratings.groupBy("unit", "label").agg(F.count("*").cast("double").alias("c"))
    units = cells.groupBy("unit").agg(F.sum("c").alias("m")).where("m >= 2")
    rows = cells.join(units, "unit").withColumn("same", F.col("c") * (F.col("c") - 1) / (F.col("m") - 1))
    labels = rows.groupBy("label").agg(F.sum("c").alias("n"), F.sum("same").alias("same"))
    t = labels.agg(F.sum("n").alias("n"), (F.sum("n") - F.sum("same")).alias("observed"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    expected = (F.col("n") * F.col("n") - F.col("squares")) / (F.col("n") - 1)
    value = F.when(F.col("n") <= 1, None).when(expected == 0, F.when(F.col("observed") == 0, 1.0)).otherwise(1 - F.col("observed") / expected)
    return t.select(F.bround(value, 6).alias("alpha"))


def label_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each label that occurs on either side; 0 where undefined."""
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    sides = cells.select(F.col("g").alias("label"), "n", F.lit(0.0).alias("m"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0.0).alias("hit")).union(cells.select("p", F.lit(0.0), "n", F.lit(0.0)))
    t = sides.groupBy("label").agg(F.sum("n").alias("gold"), F.sum("m").alias("said"), F.sum("hit").alias("hit"))
    f1 = 2 * F.col("hit") / (F.col("gold") + F.col("said"))
    ratio = lambda c: F.when(F.col(c) > 0, F.col("hit") / F.col(c)).otherwise(0.0)
    return t.select("label", F.bround(ratio("said"), 6).alias("precision"), F.bround(ratio("gold"), 6).alias("recall"), F.bround(f1, 6).alias("f1"), F.col("gold").cast("long").alias("n_gold"))


def macro_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """The mean F1 of the labels that occur among the gold ones, and the accuracy."""
    scores = label_scores(rows, gold, predicted).where("n_gold > 0").agg(F.bround(F.avg("f1"), 5).alias("macro_f1"))
    return scores.join(rows.agg(F.bround(F.avg((F.col(gold) == F.col(predicted)).cast("double")), 6).alias("accuracy")))  # one row each


def adjusted_rand(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """The adjusted Rand index of two clusterings, from counts."""
    pairs = lambda *c: rows.groupBy(*c).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("x"))
    parts = [pairs(*c).withColumnRenamed("x", n) for c, n in (((gold, predicted), "both"), ((gold,), "g"), ((predicted,), "c"))]
    parts.append(rows.agg((F.count("*") * (F.count("*").cast("double") - 1) / 2).alias("t")))
    out = parts[0].join(parts[1]).join(parts[2]).join(parts[3])  # one row each
    chance = F.col("g") * F.col("c") / F.col("t")
    return out.select(F.bround((F.col("both") - chance) / ((F.col("g") + F.col("c")) / 2 - chance), 6).alias("ari"))


def accuracy_and_bias(forecasts: DataFrame, line: float = 0.5) -> DataFrame:
    """The share on the right side of the line, and the mean forecast less the share that happened."""
    right = ((F.col("p") >= line).cast("int") == F.col("y")).cast("double")
    return forecasts.agg(F.bround(F.avg(right), 6).alias("accuracy"), F.bround(F.avg(F.col("p") - F.col("y")), 6).alias("bias"))


def ranked_rows(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their place (from 0) in the whole order and the number of rows: places inside ranges, plus the sizes of the ranges in front."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranked")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size"))
    before = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranged.withColumn("inside", place).join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("inside")).drop("range", "inside", "before")  # a row a range


def ece_equal_count(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal count in the order of p and id; the first bins get the rest."""
    rows = ranked_rows(forecasts, "p", "id")
    size, rest = F.floor(F.col("total") / bins), F.pmod(F.col("total"), F.lit(bins))
    wide = rest * (size + 1)
    b = F.when(F.col("place") < wide, F.floor(F.col("place") / (size + 1))).otherwise(rest + F.floor((F.col("place") - wide) / size))
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return per.agg(F.bround(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def selective_accuracy(forecasts: DataFrame, share: float = 0.8) -> DataFrame:
    """The accuracy on the share of forecasts farthest from one half (of equals the smaller ids)."""
    rows = ranked_rows(forecasts.withColumn("near", F.bround(-F.abs(F.col("p") - 0.5), 9)), "near", "id")
    return accuracy_and_bias(rows.where(F.col("place") < F.floor(share * F.col("total")))).select("accuracy")


def holm(tests: DataFrame, name: str = "name", p: str = "p") -> DataFrame:
    """Step-down adjusted p-values of one family of tests."""
    w = Window.orderBy(p, name)  # a family is a few tests
    rows = tests.withColumn("k", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy()))
    return rows.select(name, F.bround(F.least(F.lit(1.0), F.max(F.col(p) * (F.col("m") - F.col("k") + 1)).over(w)), 6).alias("adjusted"))


def spread(rows: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Mean and population standard deviation of each group."""
    return rows.groupBy(*keys).agg(F.bround(F.avg(value), 6).alias("mean"), F.bround(F.stddev_pop(value), 6).alias("sd"), F.count("*").alias("n"))
