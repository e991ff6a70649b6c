"""Lists, counts and change feeds: filters with a page, counts that keep empty groups, upserts, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .metrics import ranked_rows


def contains_text(search: str, *columns: str) -> Column:
    """Whether a column contains the text, letter case aside; its wildcards count as themselves."""
    plain = search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{plain}%"), F.lit(False))
    return out


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a list in a total order, with the number of rows of the whole list."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def listed(rows: DataFrame, equal: dict[str, list] | None = None, since: tuple[str, float] | None = None, until: tuple[str, float] | None = None, present: dict[str, bool] | None = None, prefix: dict[str, str] | None = None) -> DataFrame:
    """Rows by equality with any of some values, a half-open span, presence, and prefixes (those that end in a dot) or whole values."""
    for column, values in (equal or {}).items():
        rows = rows.where(F.col(column).isin(values))
    if since:
        rows = rows.where(F.col(since[0]) >= since[1])
    if until:
        rows = rows.where(F.col(until[0]) < until[1])
    for column, there in (present or {}).items():
        rows = rows.where(F.col(column).isNotNull() if there else F.col(column).isNull())
    for column, value in (prefix or {}).items():
        rows = rows.where(F.col(column).startswith(value) if value.endswith(".") else F.col(column) == value)
    return rows


def counts_of(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The number of rows of each of the values, 0 too."""
    listed_values = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return listed_values.join(rows.groupBy(column).agg(F.count("*").alias("k")), column, "left").select(column, F.coalesce("k", F.lit(0)).alias("n"))


def latest_evidence(reports: DataFrame, signals: DataFrame) -> DataFrame:
    """The latest time of an event's evidence over both kinds (event_id, at)."""
    return reports.select("event_id", "at").unionByName(signals.select("event_id", "at")).groupBy("event_id").agg(F.max("at").alias("latest"))


def upserted(old: DataFrame, batch: DataFrame, keys: list[str], order: str, content: list[str], keep_order: bool = False) -> DataFrame:
    """The table after a batch: of rows of one key the last counts; new ones are inserted, those of other content updated, the rest stay. action tells which."""
    columns = [*content, *[order] * keep_order]
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = batch.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    both = old.alias("o").join(last.alias("b"), keys, "full")
    same = F.sha2(F.to_json(F.struct(*[F.col(f"o.{c}") for c in content])), 256) == F.sha2(F.to_json(F.struct(*[F.col(f"b.{c}") for c in content])), 256)
    there, comes = F.col(f"o.{order}").isNotNull(), F.col(f"b.{order}").isNotNull()
    action = F.when(~there, "created").when(~comes, "kept").when(same, "skipped").otherwise("updated")
    new = action.isin("created", "updated")
    return both.select(*keys, action.alias("action"), *[F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def submissions(rows: DataFrame, keys: list[str], at: list[str], content: str) -> DataFrame:
    """Repeated submissions under one key: the first is accepted, those of equal content are repeats of it, others conflict."""
    w = Window.partitionBy(*keys).orderBy(*at)
    first = F.first(content).over(w)
    return rows.withColumn("outcome", F.when(F.row_number().over(w) == 1, "accepted").when(first.eqNullSafe(F.col(content)), "repeat").otherwise("conflict"))


def checkpoint_views(votes: DataFrame, hours: tuple[int, ...] = (1, 6, 24, 168)) -> DataFrame:
    """Votes in view at each of some hours after an item's first: item, hours, n, score."""
    first = votes.groupBy("item").agg(F.min("seen").alias("first"))
    views = votes.join(first, "item").withColumn("hours", F.explode(F.array(*[F.lit(h) for h in hours]))).where(F.col("seen") <= F.col("first") + F.col("hours") * 3600)
    return views.groupBy("item", "hours").agg(F.count("*").alias("n"), F.sum(F.coalesce("vote", F.lit(0))).cast("long").alias("score"))


def change_log(states: DataFrame, key: str, at: list[str], columns: list[str]) -> DataFrame:
    """The changes between a key's successive states: column, old and new value; the first state changes nothing."""
    w = Window.partitionBy(key).orderBy(*at)
    pairs = states.select(key, *at, F.row_number().over(w).alias("k"), F.array(*[F.struct(F.lit(c).alias("field"), F.lag(c).over(w).cast("string").alias("old"), F.col(c).cast("string").alias("new")) for c in columns]).alias("diff"))
    return pairs.where("k > 1").select(key, *at, F.inline(F.filter("diff", lambda d: ~d["old"].eqNullSafe(d["new"]))))


def disagreements(rows: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """Items whose raters gave different labels."""
    return rows.groupBy(item).agg(F.countDistinct(rater).alias("raters"), F.countDistinct(label).alias("labels")).where("raters > 1 AND labels > 1")


def majority_label(rows: DataFrame, item: str, label: str, at: str, gold: DataFrame | None = None) -> DataFrame:
    """Gold where given, else the most frequent label; of equals the one that was given first."""
    counted = rows.groupBy(item, label).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    best = counted.groupBy(item).agg(F.min_by(label, F.struct(-F.col("n"), "first", label)).alias("majority"))
    if gold is None:
        return best.select(item, F.col("majority").alias("label"))
    return best.join(gold.select(item, F.col(label).alias("gold")), item, "left").select(item, F.coalesce("gold", "majority").alias("label"))


def unanimous(rows: DataFrame, group: str, label: str) -> DataFrame:
    """A group's label if all its members have one and the same, else null."""
    return rows.groupBy(group).agg(F.when(F.countDistinct(label) == 1, F.min(label)).alias("label"))


def frequent_keys(rows: DataFrame, group: str, item: str, key: str, share: float = 0.3, least: int = 10) -> DataFrame:
    """Keys in at least share of a group's items, for groups of at least least items: what a template puts there."""
    size = rows.groupBy(group).agg(F.countDistinct(item).alias("items")).where(F.col("items") >= least)
    return rows.groupBy(group, key).agg(F.countDistinct(item).alias("n")).join(size, group).where(F.col("n") >= share * F.col("items")).select(group, key, "n", "items")


def recurring(rows: DataFrame, key: str, item: str, least: int = 5, top: int = 40) -> DataFrame:
    """The top keys by distinct items, of those with at least least."""
    return rows.groupBy(key).agg(F.countDistinct(item).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), key).limit(top)


def numbered(rows: DataFrame, prefix: str, *order: str) -> DataFrame:
    """rows with a running id in their order, such as EVT-000001."""
    return ranked_rows(rows, *order).withColumn("id", F.format_string(f"{prefix}-%06d", F.col("place") + 1)).drop("place", "total")
