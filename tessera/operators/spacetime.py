"""As-of joins and hour profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def asof_last(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the value of the latest right row of its key at or before its time (one shuffle, no range join)."""
    both = left.select(key, at, "id", F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v")).union(right.select(key, at, F.lit(None).cast("bigint"), F.lit(0), value))
    w = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("id", key, F.col("v").alias(value))


def rare_hours(reports: DataFrame, share: float = 0.02, offset_hours: int = 6) -> DataFrame:
    """The hours of the day, of all 24 in local time, that hold under a share of an account's reports: reporter, hour, n (0 for silent hours)."""
    local = F.pmod(F.floor(F.col("t") / 3600) + offset_hours, F.lit(24)).cast("int")
    counts = reports.groupBy("reporter", local.alias("hour")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("reporter").agg(F.sum("n").alias("total")).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    rows = totals.join(counts, ["reporter", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return rows.where(F.col("n") < share * F.col("total")).select("reporter", "hour", "n")
