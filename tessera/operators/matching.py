"""Joins of reports, signals and incidents by place and time.

Pairs come from equi-joins on grid cells and days, never from comparing all with all; the exact
distance and times decide. Times are seconds (double).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.geo import haversine_km, with_cell, with_cells_around
from tessera.session import discard, is_empty, stored

DAY, HOUR = 86400.0, 3600.0


def effective_end(start: Column, end: Column, latest: Column, now: float, open_days: float = 7.0) -> Column:
    """The end, or for an open incident open_days past its start or latest evidence, but not past now."""
    return F.coalesce(end, F.least(F.lit(now), F.greatest(start, F.coalesce(latest, start)) + open_days * DAY))


def hours_outside(moment: Column, start: Column, end: Column) -> Column:
    """0 inside a span, else the hours to its nearer edge."""
    return F.greatest(F.lit(0.0), start - moment, moment - end) / HOUR


def gap_hours(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """0 if two spans overlap, else the hours between them."""
    return F.greatest(F.lit(0.0), other_start - end, start - other_end) / HOUR


def _slots(first: Column, last: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))


def radii(km: float, least: float = 5.0) -> list[float]:
    """Doubling reaches up to km: each item goes to cells of the smallest that its own reach fits in."""
    out = [min(least, km)]
    while out[-1] < km:
        out.append(min(out[-1] * 2, km))
    return out


def _celled(left: DataFrame, right: DataFrame, sizes: list[float]) -> tuple[DataFrame, DataFrame]:
    """Items and incidents with the cells (size, band, cell) in which those within the items' reach meet, each pair in one."""
    if len(sizes) == 1:
        return with_cell(left, sizes[0]).withColumn("size", F.lit(0)), with_cells_around(right, sizes[0], "elat", "elon").withColumn("size", F.lit(0))
    lefts, rights = [], []
    for k, size in enumerate(sizes):
        over = F.col("reach") > sizes[k - 1] if k else F.lit(True)
        lefts.append(with_cells_around(left.where(over & (F.col("reach") <= size)), size).withColumn("size", F.lit(k)))
        rights.append(with_cell(right, size, "elat", "elon").withColumn("size", F.lit(k)))
    return functools.reduce(DataFrame.unionByName, lefts), functools.reduce(DataFrame.unionByName, rights)


def near_spans(items: DataFrame, incidents: DataFrame, km: float, hours: float) -> DataFrame:
    """Pairs of items (start, end, lat, lon, reach) and incidents (started, until, elat, elon) within the items' reach (km at most) and hours: with km_apart and hours_apart.

    Time is cut into slots as long as the hours reach both ways: items go to each slot of their span widened by the hours, incidents to each of theirs, and a pair
    counts on the later of their first slots. Place is cut into cells as wide as the reach, rounded up to a power of two times 5 km, so a precise item
    never meets a whole country. With several widths an incident has one cell of each and an item those around it; with one the incident has those around.
    """
    sizes, width = radii(km), max(2 * hours * HOUR, DAY)
    first, last = F.col("start") - hours * HOUR, F.col("end") + hours * HOUR
    left = items.withColumn("first_slot", F.floor(first / width)).withColumn("slot", _slots(first, last, width))
    right = incidents.withColumn("e_first_slot", F.floor(F.col("started") / width)).withColumn("slot", _slots(F.col("started"), F.col("until"), width))
    left, right = _celled(left, right, sizes)
    both = left.join(right, ["size", "band", "cell", "slot"]).where(F.col("slot") == F.greatest("first_slot", "e_first_slot"))
    both = both.where((F.col("started") <= F.col("end") + hours * HOUR) & (F.col("until") >= F.col("start") - hours * HOUR))
    both = both.withColumn("km_apart", haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon"))).where(F.col("km_apart") <= F.col("reach"))
    return both.withColumn("hours_apart", gap_hours(F.col("start"), F.col("end"), F.col("started"), F.col("until"))).drop("size", "band", "cell", "slot", "first_slot", "e_first_slot")


def ranked(pairs: DataFrame, key: str, other: str, limit: int, *first: Column) -> DataFrame:
    """Of each key the limit pairs that come first: by the given columns, then those of equal type, the nearest, the smallest id."""
    w = Window.partitionBy(key).orderBy(*first, (F.col("type") != F.col("etype")).cast("int"), F.round("km_apart", 2), other)
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(key, other, F.round("km_apart", 6).alias("km"), F.round("hours_apart", 6).alias("hours"), "place")


def _first_reach(incidents: DataFrame, km: float, wanted: int) -> float:
    """The least of km, km / 2, ... km / 64 whose cells, taken with the weight of what they hold, hold wanted incidents on average."""
    sizes = [min(km, 5.0) / 2**k for k in range(7)]
    cells = functools.reduce(DataFrame.unionByName, [with_cell(incidents.select("elat", "elon"), size, "elat", "elon").select(F.lit(k).alias("k"), "band", "cell") for k, size in enumerate(sizes)])
    held = cells.groupBy("k", "band", "cell").agg(F.count("*").cast("double").alias("n")).groupBy("k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).where(F.col("n") >= wanted).collect()  # a row a size
    return sizes[max((r["k"] for r in held), default=0)]


def nearest_spans(items: DataFrame, incidents: DataFrame, seeker: str, other: str, wanted: DataFrame, km: float, hours: float) -> DataFrame:
    """Of the pairs of near_spans those that come first of each seeker (an id of items or of incidents): as many as wanted (seeker, n; limit where missing) says, in the order of ranked, or more.

    Pairs are looked for within a short reach first, which is doubled for seekers that have found too few: where incidents are dense no seeker meets all of them.
    All pairs within a reach are known after its round, so a seeker is done when as many of the type that comes first are nearer than the reach.
    Only what ranks a pair is shuffled with it, and each task that joins keeps as many of a seeker as any wants. Returns both ids, type, etype, km_apart, hours_apart.
    """
    of_items = seeker in items.columns
    items = stored(items.select(seeker if of_items else other, "start", "end", "lat", "lon", "reach", "type"), "near-items")
    incidents = stored(incidents.select(other if of_items else seeker, "started", "until", "elat", "elon", "etype"), "near-incidents")
    side, kept = (items, incidents) if of_items else (incidents, items)
    left = stored(side.join(wanted, seeker), "near-seekers")
    odd = kept.agg(F.max(F.col("etype" if of_items else "type").isNull())).collect()[0][0]  # one row
    most = (left if of_items else kept).agg(F.max("reach")).collect()[0][0]
    most_wanted = left.agg(F.max("n")).collect()[0][0]
    columns = [seeker, other, "type", "etype", "km_apart", "hours_apart"]
    code = F.coalesce((F.col("type") != F.col("etype")).cast("int"), F.lit(-1))
    best = F.lit(-1) if odd else F.when(F.col("type" if of_items else "etype").isNull(), -1).otherwise(0)
    w = Window.partitionBy(seeker).orderBy(code, F.round("km_apart", 2), other)
    reach, parts = _first_reach(incidents, km, 40), []
    while most is not None:
        reach = min(reach, km)
        whole = reach >= min(most, km)
        mine, theirs = (left, incidents) if of_items else (items, left)
        pairs = near_spans(mine.withColumn("reach", F.least("reach", F.lit(reach))), theirs, reach, hours).select(*columns, "n")
        pairs = pairs.withColumn("k", F.row_number().over(w)).where((F.col("k") <= F.lit(most_wanted)) & (F.col("k") <= F.col("n")))
        pairs = stored(pairs, "near-pairs")
        parts.append(pairs)
        if whole:
            break
        sure = (code <= best) & (F.round("km_apart", 2) < round(reach, 2))
        done = pairs.where(sure).groupBy(seeker).agg(F.count("*").alias("found"))
        rest = left.join(done, seeker, "left").where(F.coalesce("found", F.lit(0)) < F.col("n"))
        if of_items:
            rest = rest.where(F.col("reach") > reach)
        left = stored(rest.select(left.columns), "near-seekers")
        parts[-1] = pairs.join(left.select(seeker), seeker, "left_anti")
        if is_empty(left):
            break
        reach *= 2
    if not parts:
        return near_spans(items, incidents.where(F.lit(False)), km, hours).select(columns)
    out = functools.reduce(DataFrame.unionByName, [p.select(columns) for p in parts])
    discard(items, incidents)
    return out


def _wanted(side: DataFrame, linked: DataFrame, seeker: str, limit: int) -> DataFrame:
    """How many pairs each seeker needs, so that limit are left when those that are linked already have gone."""
    n = linked.groupBy(seeker).agg(F.count("*").alias("n_linked"))
    return side.select(seeker).join(n, seeker, "left").select(seeker, (limit + F.coalesce("n_linked", F.lit(0))).alias("n"))


def candidates_of_items(items: DataFrame, incidents: DataFrame, linked: DataFrame, key: str, km: float, hours: float = 48, limit: int = 10) -> DataFrame:
    """For each item (a report or signal) the incidents it may belong to: not dismissed, not linked to it yet."""
    pairs = nearest_spans(items, incidents.where("status <> 'dismissed'"), key, "event_id", _wanted(items, linked, key, limit), km, hours)
    return ranked(pairs.join(linked, [key, "event_id"], "left_anti"), key, "event_id", limit)


def candidates_of_incidents(items: DataFrame, incidents: DataFrame, linked: DataFrame, key: str, km: float, hours: float = 48, limit: int = 25, answers: DataFrame | None = None) -> DataFrame:
    """For each incident the items that may be evidence; answers (key, event_id) to its requests count wherever they were made, and come first."""
    items = items.where("item_status <> 'dismissed'")
    pairs = nearest_spans(items, incidents, "event_id", key, _wanted(incidents, linked, "event_id", limit), km, hours)
    if answers is not None:
        asked = items.join(answers, key).join(incidents, "event_id").withColumn("km_apart", haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon")))
        asked = asked.withColumn("hours_apart", gap_hours(F.col("start"), F.col("end"), F.col("started"), F.col("until")))
        pairs = pairs.unionByName(asked.select(pairs.columns)).dropDuplicates([key, "event_id"])
        pairs = pairs.join(answers.withColumn("answer", F.lit(0)), [key, "event_id"], "left")
    else:
        pairs = pairs.withColumn("answer", F.lit(None).cast("int"))
    pairs = pairs.join(linked, [key, "event_id"], "left_anti")
    return ranked(pairs, "event_id", key, limit, F.coalesce("answer", F.lit(1)))


def retrieved(items: DataFrame, incidents: DataFrame, key: str, km: float = 50.0, days: float = 14.0, limit: int | None = 200, first: int = 512) -> DataFrame:
    """The newest incidents within km plus the item's precision and days of it (all of them without a limit): what a suggestion scores.

    Without a limit the result itself grows with the square of a place's items and incidents. With one, the newest that began before an item's last moment are looked for in a window of time that holds first incidents on average; it grows fourfold
    for items that have found too few. All within a window are known after its round, and what began before it is older than all of them.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("started"), "event_id")
    if limit is None:
        return near_spans(items, incidents.where("status <> 'dismissed'"), km + 300.0, days * 24).select(key, "event_id", F.row_number().over(newest).alias("place"))
    incidents = stored(incidents.where("status <> 'dismissed'"), "near-incidents")
    span = incidents.agg(F.count("started").alias("n"), F.min("started").alias("a"), F.max("started").alias("b")).collect()[0]  # one row
    left = stored(items.withColumn("last", F.when(F.col("end").isNotNull(), F.least(F.col("end") + days * DAY, F.lit(span["b"]).cast("double")))), "near-seekers")
    latest = left.agg(F.max("last")).collect()[0][0]
    width, parts = max((span["b"] - span["a"]) * first / span["n"], 1.0) if span["n"] else DAY, []
    while True:
        whole = latest is None or not span["n"] or latest - width < span["a"]
        width = max(latest - span["a"] + 1.0, width) if whole and latest is not None and span["n"] else width
        mine = left.withColumn("slot", _slots(F.col("last") - width, F.col("last"), width))
        mine, theirs = _celled(mine, incidents.withColumn("slot", F.floor(F.col("started") / width)), radii(km + 300.0))
        both = mine.join(theirs, ["size", "band", "cell", "slot"]).where((F.col("started") <= F.col("last")) & (F.col("started") > F.col("last") - width) & (F.col("until") >= F.col("start") - days * DAY))
        both = both.where(haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon")) <= F.col("reach"))
        found = stored(both.select(key, "event_id", "started").withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit).select(key, "event_id", "place"), "near-pairs")
        if whole:
            parts.append(found)
            break
        done = found.where(F.col("place") == limit).select(key)
        parts.append(found.join(done, key, "left_semi"))
        left = stored(left.join(done, key, "left_anti"), "near-seekers")
        if is_empty(left):
            break
        width *= 4
    discard(incidents)
    return functools.reduce(DataFrame.unionByName, parts)


def nearest_in_time(reports: DataFrame) -> DataFrame:
    """Each report with the one of its account nearest in time (the earlier of two as near): one window, no self join."""
    w = Window.partitionBy("reporter").orderBy("t", "report_id")
    cols = ["report_id", "t", "lat", "lon"]
    rows = reports.select("*", F.struct(*[F.lag(c).over(w).alias(c) for c in cols]).alias("back"), F.struct(*[F.lead(c).over(w).alias(c) for c in cols]).alias("ahead"))
    back_gap, ahead_gap = F.col("t") - F.col("back.t"), F.col("ahead.t") - F.col("t")
    pick = F.when(F.col("back.report_id").isNull() | (ahead_gap < back_gap), F.col("ahead")).otherwise(F.col("back"))
    return rows.withColumn("near", pick).drop("back", "ahead").where("near.report_id IS NOT NULL")


def impossible_travel(reports: DataFrame, most_kmh: float = 150.0, least_km: float = 2.0) -> DataFrame:
    """Reports farther than least_km from their account's report nearest in time, at more than most_kmh (at once: any distance)."""
    km = haversine_km(F.col("near.lat"), F.col("near.lon"), F.col("lat"), F.col("lon"))
    rows = nearest_in_time(reports).withColumn("km", km).withColumn("hours", F.abs(F.col("t") - F.col("near.t")) / HOUR)
    return rows.where((F.col("km") > least_km) & (F.col("km") > most_kmh * F.col("hours"))).select("report_id", "reporter", F.round("km", 4).alias("km"))


def burst(reports: DataFrame, minutes: float = 10.0, least: int = 10) -> DataFrame:
    """Reports after at least least others of their account in the minutes before, the start of that time excluded: report_id, reporter, n_before.

    Receipt times count, in microseconds, so that the frame can leave out its own start; reports received at the same moment count for each other.
    """
    span = int(minutes * 60_000_000)
    w = Window.partitionBy("reporter").orderBy("received_us").rangeBetween(-span + 1, 0)
    return reports.select("report_id", "reporter", (F.count("*").over(w) - 1).alias("n_before")).where(F.col("n_before") >= least)


def nearest_centre(points: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """The centre (name, clat, clon; a small reference table) nearest to each point, in degrees with longitude scaled by latitude."""
    scale = F.cos(F.radians("lat"))
    listed = centres.agg(F.collect_list(F.struct("name", "clat", "clon")).alias("centres"))  # one row
    rows = points.join(F.broadcast(listed))
    best = F.array_min(F.transform("centres", lambda c: F.struct((F.pow(c["clat"] - F.col("lat"), 2) + F.pow((c["clon"] - F.col("lon")) * scale, 2)).alias("d"), c["name"].alias("name"))))
    return rows.select(key, best["name"].alias("centre"))
