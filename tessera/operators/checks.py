"""Report checks, account risk, priorities, rate limits and validation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.geo import haversine_km

from .fusion import roots
from .matching import burst, impossible_travel

#: Lines of the report checks, and weights of an account's parts.
FUTURE_S, OLD_S, POOR_M = 300.0, 86400.0, 1000.0
RECENT_S, HISTORY = 86400.0, 10
WEIGHTS = {"far": 0.9, "rate": 0.6, "hours": 0.5, "flagged": 0.9}


def ramp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def poisson_tail(k: Column, mean: Column, most: int = 1 << 20) -> Column:
    """P(X >= k) for a Poisson X, by adding up the terms below k."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"))
    terms = F.when(k > 1, F.sequence(F.lit(1), (F.least(k, F.lit(most)) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * mean / i
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.when(k <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.aggregate(terms, start, add)["sum"]))


def timing_flags(reports: DataFrame, now: float) -> DataFrame:
    """observed_in_future, old_observation and poor_location_accuracy of each report that has one; late rows are flagged, not dropped."""
    when = F.when(F.col("t") > now + FUTURE_S, "observed_in_future").when(F.lit(now) - F.col("t") > OLD_S, "old_observation")
    flags = F.array_compact(F.array(when, F.when(F.col("accuracy") > POOR_M, "poor_location_accuracy")))
    return reports.select("report_id", flags.alias("flags")).where(F.size("flags") > 0)


def flag_counts(reports: DataFrame, now: float, least_burst: int = 10) -> DataFrame:
    """Of each report the sorted codes of all checks that it fails."""
    parts = timing_flags(reports, now).select("report_id", F.explode("flags").alias("code"))
    parts = parts.union(impossible_travel(reports).select("report_id", F.lit("impossible_travel"))).union(burst(reports, least=least_burst).select("report_id", F.lit("submission_burst")))
    return parts.groupBy("report_id").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))


def account_risk(reports: DataFrame, flagged: DataFrame, now: float) -> DataFrame:
    """Each account's risk from its reports of the last day against those before: distance from home, rate, odd hours and flags, joined by noisy-or.

    Accounts with fewer than HISTORY earlier reports are judged by their flags alone; those without a report in the last day have risk 0.
    """
    rows = reports.where(F.col("received_us") <= now * 1e6).join(flagged.select("report_id").distinct().withColumn("flag", F.lit(1)), "report_id", "left")
    rows = rows.withColumn("recent", F.col("received_us") > (now - RECENT_S) * 1e6).withColumn("hour", F.pmod(F.floor(F.col("received_us") / 3.6e9) + 6, F.lit(24)))
    base = rows.where("NOT recent")
    home = base.groupBy("reporter").agg(F.median("lat").alias("hlat"), F.median("lon").alias("hlon"), F.count("*").alias("n_base"), (F.max("received_us") - F.min("received_us")).alias("us"))
    away = haversine_km(F.col("hlat"), F.col("hlon"), F.col("lat"), F.col("lon"))
    apart = rows.join(home, "reporter").withColumn("km", away)
    ordered = Window.partitionBy("reporter").orderBy("km")
    usual = apart.where("NOT recent").withColumn("k", F.row_number().over(ordered) - 1).where(F.col("k") == F.floor(0.9 * (F.col("n_base") - 1))).groupBy("reporter").agg(F.greatest(F.min("km"), F.lit(2.0)).alias("usual"))
    far = apart.where("recent").groupBy("reporter").agg(F.median("km").alias("away"))
    hours = base.groupBy("reporter", "hour").agg(F.count("*").alias("n_hour"))
    odd = rows.where("recent").join(hours, ["reporter", "hour"], "left").join(home, "reporter").where(F.coalesce("n_hour", F.lit(0)) / F.col("n_base") < 0.02).groupBy("reporter").agg(F.count("*").alias("n_odd"))
    recent = rows.groupBy("reporter").agg(F.count_if("recent").alias("n"), F.count_if(F.col("recent") & F.col("flag").isNotNull()).alias("n_flagged"))
    all_ = recent.join(home, "reporter", "left").join(usual, "reporter", "left").join(far, "reporter", "left").join(odd, "reporter", "left")
    known = F.coalesce(F.col("n_base") >= HISTORY, F.lit(False))
    per_day = F.col("n_base") / F.greatest(F.col("us") / 8.64e10, F.lit(1.0))
    parts = {
        "flagged": ramp(F.col("n_flagged") / F.col("n"), 0.1, 0.5),
        "far": F.when(known, ramp(F.col("away") / F.col("usual"), 3.0, 10.0)),
        "rate": F.when(known, ramp(-F.log10(F.greatest(poisson_tail(F.col("n"), per_day), F.lit(1e-12))), 2.0, 6.0)),
        "hours": F.when(known, ramp(F.coalesce("n_odd", F.lit(0)) / F.col("n"), 0.2, 0.6)),
    }
    keep = F.lit(1.0)
    for name, part in parts.items():
        keep = keep * (1 - WEIGHTS[name] * F.coalesce(part, F.lit(0.0)))
    return all_.select("reporter", "n", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.when(F.col("n") > 0, F.bround(1 - keep, 3)).otherwise(0.0).alias("risk"))


#: How directly a kind of event endangers life, depths that do, and people of a household.
HAZARD = {3: ["fire", "building_collapse", "explosion", "cyclone", "storm_surge", "flash_flood", "earthquake", "landslide"], 2: ["flood", "river_erosion", "building_hazard", "road_accident", "rail_accident", "bridge_damage"]}
SERIOUS_DEPTH, HOUSEHOLD = ["waist-deep", "chest-deep", "above-head"], 4


def hazard(event_type: Column) -> Column:
    """3 to 1; 1 for all other kinds."""
    return F.when(event_type.isin(HAZARD[3]), 3).when(event_type.isin(HAZARD[2]), 2).otherwise(1)


def priority(facts: DataFrame) -> DataFrame:
    """Points and level of an incident: hazard, deaths, people affected (a household is four), depth, disruption, growth, rising deaths, duration, doubt (over or dismissed: low).

    facts: event_id, hazard, deaths, affected, affected_unit, depth, family, n_recent, rising, ended, age_days, assessment, p, n_sources, status.
    """
    people = F.col("affected") * F.when(F.col("affected_unit").startswith("household"), HOUSEHOLD).otherwise(1)
    points = (
        F.col("hazard")
        + F.when(F.col("deaths") >= 10, 4).when(F.col("deaths") > 0, 2).otherwise(0)
        + F.when(people >= 100_000, 3).when(people >= 10_000, 2).when(people >= 1000, 1).otherwise(0)
        + F.when(F.col("depth").isin(SERIOUS_DEPTH), 1).otherwise(0)
        + F.when(F.col("family") == "road_infrastructure", 1).otherwise(0)
        + F.when(F.col("n_recent") >= 3, 1).otherwise(0)
        + F.when(F.col("rising"), 1).otherwise(0)
        + F.when(F.col("ended").isNull() & (F.col("age_days") >= 2), 1).otherwise(0)
        + F.when(F.col("assessment") == "refuted", -4).when(F.col("p") < 0.3, -3).when(F.col("n_sources") <= 1, -1).otherwise(0)
    )
    over = F.col("status").isin("resolved", "dismissed")
    score = F.when(over, 0).otherwise(points)
    level = F.when(over, "low").when(score >= 8, "critical").when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")
    return facts.select("event_id", score.cast("int").alias("points"), level.alias("level"))


def percent(p: Column) -> Column:
    """A probability as an integer percent, half to even; >99% and <1% at the ends."""
    return F.when(p >= 0.995, ">99%").when(p <= 0.005, "<1%").otherwise(F.concat(F.bround(p * 100, 0).cast("int").cast("string"), F.lit("%")))


def rate_limited(rows: DataFrame, key: str, us: str, most: int, minutes: float) -> DataFrame:
    """Attempts over the limit: most others of their key in the time before (its start excluded), and the seconds to wait."""
    span = int(minutes * 60_000_000)
    w = Window.partitionBy(key).orderBy(us).rangeBetween(-span + 1, 0)
    seen = rows.withColumn("n", F.count("*").over(w) - 1).withColumn("first", F.min(us).over(w))
    return seen.where(F.col("n") >= most).withColumn("retry_s", F.bround((F.col("first") + span - F.col(us)) / 1e6, 3))


def duplicates(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Rows that repeat a key, with the place of the first: key, place, first."""
    w = Window.partitionBy(key)
    return rows.withColumn("first", F.min(place).over(w)).where(F.col(place) > F.col("first")).select(key, place, "first")


def cycles(rows: DataFrame, node: str, up: str) -> DataFrame:
    """The roots of chains that never end: of each cycle of parents its smallest node, and how many nodes lead into it."""
    ends = roots(rows, node, up)
    above = rows.select(F.col(node).alias("root"), F.col(up).alias("above"))
    return ends.join(above, "root").where("above IS NOT NULL AND above <> root").groupBy("root").agg(F.count("*").alias("n_nodes"))
