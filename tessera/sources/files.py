"""Alerts, listings, imports and exports as files."""

from __future__ import annotations

from pyspark.sql import Window, Column, DataFrame, SparkSession, functions as F

from tessera.functions.text import excerpt, parsed_time
from tessera.operators.textual import html_text

# Kinds of alerts and their severities.
ALERT_TYPES = {"FL": "flood", "TC": "cyclone", "EQ": "earthquake", "DR": "drought", "WF": "wildfire"}
SEVERITY = {"green": "minor", "orange": "moderate", "red": "severe"}


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def alerts(spark: SparkSession, path: str, country: str = "Bangladesh", lat: tuple[float, float] = (18.0, 28.0), lon: tuple[float, float] = (86.0, 94.5)) -> DataFrame:
    """Alerts of GeoJSON files (features of a collection): those of known kind that name the country or lie near it."""
    schema = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<eventtype:string,eventid:string,name:string,description:string,alertlevel:string,fromdate:string,country:string,url:struct<report:string>>>>"
    rows = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.inline("features")).select("geometry.coordinates", "properties.*")
    x, y = F.get("coordinates", F.lit(0)), F.get("coordinates", F.lit(1))
    kind = F.upper("eventtype")
    near = F.coalesce(y.between(*lat) & x.between(*lon), F.lit(False)) | F.coalesce(F.col("country").contains(country), F.lit(False))
    out = rows.select(F.concat(kind, "eventid").alias("external_id"), _mapped(kind, ALERT_TYPES).alias("event_type"), html_text(F.coalesce("name", "description")).alias("title"), excerpt(F.col("description")).alias("text"), F.col("url.report").alias("url"), _mapped(F.lower("alertlevel"), SEVERITY).alias("severity"), y.alias("lat"), x.alias("lon"), parsed_time(F.col("fromdate")).alias("started"), near.alias("near"))
    return out.where("near AND event_type IS NOT NULL AND started IS NOT NULL").drop("near")


def reports_api(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a JSON service's pages (data: id, fields): id, title, text, kinds, published."""
    schema = "data array<struct<id:string,fields:struct<title:string,body:string,disaster_type:array<struct<name:string>>,date:struct<original:string,created:string>,url:string>>>"
    rows = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.inline("data")).select("id", "fields.*")
    at = F.coalesce(parsed_time(F.col("date.original")), parsed_time(F.col("date.created")))
    kinds = F.transform("disaster_type", lambda d: F.lower(d["name"]))
    return rows.select("id", html_text(F.col("title")).alias("title"), F.substring(html_text(F.col("body")), 1, 600).alias("text"), kinds.alias("kinds"), at.alias("published"), "url").where("title <> '' AND published IS NOT NULL")


def imported(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV table with a code in column message for each that can't be taken, null for those that can; empty rows go. Of equal addresses the first by date stays.

    Columns: title, url, published, publisher, language, severity.
    """
    rows = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    names = {c: c.strip().lower().removeprefix("﻿") for c in rows.columns}
    rows = rows.select([F.trim(F.col(f"`{c}`")).alias(n) for c, n in names.items()])
    missing = [c for c in ("title", "url", "published", "publisher") if c not in rows.columns]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    rows = rows.where(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in rows.columns]).isNotNull())
    language = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.when(F.col("title").rlike("[ঀ-৿]"), "bn").otherwise("en")) if "language" in rows.columns else F.when(F.col("title").rlike("[ঀ-৿]"), "bn").otherwise("en")
    severity = F.nullif(F.lower("severity"), F.lit("")) if "severity" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumns({"title": F.substring(html_text(F.col("title")), 1, 400), "language": language, "severity": severity, "published": parsed_time(F.col("published"))})
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    code = (
        F.when(~F.coalesce(F.col("url").rlike(r"(?i)^https?://\S+$"), F.lit(False)), "bad_url")
        .when(F.coalesce(F.length("title"), F.lit(0)) < 5, "short_title")
        .when(F.col("published").isNull(), "bad_date")
        .when(~has("publisher"), "no_publisher")
        .when(~F.col("language").isin("bn", "bn-Latn", "en", "mixed"), "bad_language")
        .when(~F.col("severity").isin("minor", "moderate", "severe"), "bad_severity")
        .when(F.row_number().over(Window.partitionBy("url").orderBy("published", "title")) > 1, "repeated_url")
    )
    return rows.withColumn("message", code)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The records of JSON lines, and the lines that aren't records of the schema."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    read = lines.select("value", F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("x"))
    bad = F.col("x.__bad").isNotNull() | F.col("x").isNull()
    return read.where(~bad).select("x.*").drop("__bad"), read.where(bad).select("value")


def mentions(spark: SparkSession, path: str) -> DataFrame:
    """(site, url) of the web articles of tab-separated mentions, each once."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(F.get(parts, F.lit(3)).alias("kind"), F.lower(F.get(parts, F.lit(4))).alias("site"), F.get(parts, F.lit(5)).alias("url"))
    return rows.where("kind = '1' AND url LIKE 'http%'").select("site", "url").distinct()


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The first capture of each address of an archive's listings (lines: timestamp and address)."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("stamp"), F.get(parts, F.lit(1)).alias("url")).where("stamp RLIKE '^[0-9]{14}$' AND url IS NOT NULL")
    return rows.groupBy(F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.)?", ""), r"[?#].*$|/+$", "").alias("url")).agg(F.min("stamp").alias("first"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text) of HTML files, each read whole."""
    rows = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), "value")
    title = html_text(F.regexp_extract("value", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return rows.select("path", title.alias("title"), html_text(F.regexp_replace("value", r"(?is)<head\b.*?</head>", " ")).alias("text"))


def export(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A data set as JSON lines; of tables divided by columns only the parts that rows has are replaced."""
    writer = rows.write.mode("overwrite")
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.json(path)
