"""Feeds as entries: id, title, link, published, summary. Files of a feed are read by Spark's XML reader, an element a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.text import parsed_time
from tessera.operators.textual import html_text

SUMMARY_CHARS = 600


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").option("attributePrefix", "_").schema(schema).load(path)


def _text(*names: str) -> Column:
    """The first of the columns that isn't empty, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])


def rss(spark: SparkSession, path: str) -> DataFrame:
    rows = _xml(spark, path, "item", "guid string, title string, link string, pubDate string, date string, description string, encoded string")
    summary = F.substring(F.coalesce(F.nullif(html_text(F.col("description")), F.lit("")), html_text(F.col("encoded"))), 1, SUMMARY_CHARS)
    return rows.select(_text("guid", "link").alias("id"), html_text(F.col("title")).alias("title"), _text("link").alias("link"), parsed_time(_text("pubDate", "date")).alias("published"), summary.alias("summary"))


def atom(spark: SparkSession, path: str) -> DataFrame:
    rows = _xml(spark, path, "entry", "id string, title string, link array<struct<_href:string,_rel:string>>, published string, updated string, summary string, content string")
    link = F.coalesce(F.get(F.filter("link", lambda x: x["_rel"] == "alternate"), F.lit(0)), F.get("link", F.lit(0)))["_href"]
    summary = F.substring(F.coalesce(F.nullif(html_text(F.col("summary")), F.lit("")), html_text(F.col("content"))), 1, SUMMARY_CHARS)
    return rows.select(F.coalesce(_text("id"), link).alias("id"), html_text(F.col("title")).alias("title"), link.alias("link"), parsed_time(_text("published", "updated")).alias("published"), summary.alias("summary"))


def news_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """URLs with news; those of an ordinary sitemap, without a headline, are left out."""
    rows = _xml(spark, path, "url", "loc string, lastmod string, news struct<title:string,publication_date:string>").where("news IS NOT NULL")
    at = F.coalesce(F.nullif(F.trim("news.publication_date"), F.lit("")), F.col("lastmod"))
    return rows.select(F.trim("loc").alias("id"), html_text(F.col("news.title")).alias("title"), F.trim("loc").alias("link"), parsed_time(at).alias("published"), F.lit("").alias("summary"))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, modified) of every address of a sitemap."""
    return _xml(spark, path, "url", "loc string, lastmod string").select(F.trim("loc").alias("url"), parsed_time(F.col("lastmod")).alias("modified"))


def recent(entries: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Entries with a title and an id or link, not older than days; one without a date counts as of now."""
    rows = entries.withColumn("published", F.coalesce("published", now)).where("title <> '' AND coalesce(id, link) IS NOT NULL")
    return rows.where(F.col("published") >= now - F.expr(f"INTERVAL {days} DAYS")).withColumn("id", F.substring(F.coalesce("id", "link"), 1, 300))


def expanded(url: str, now_s: float, offset_hours: int = 6) -> str:
    """An address with {date} filled by the local date."""
    from datetime import UTC, datetime, timedelta

    return url.replace("{date}", (datetime.fromtimestamp(now_s, UTC) + timedelta(hours=offset_hours)).date().isoformat())


def addresses(spark: SparkSession, url: str, first: str, last: str) -> DataFrame:
    """An address with {date} for each day of a span: what a backfill reads."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return days.select("day", F.replace(F.lit(url), F.lit("{date}"), F.date_format("day", "yyyy-MM-dd")).alias("url"))
