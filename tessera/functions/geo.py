"""Distances, boxes and grid cells as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

EARTH_KM = 6371.0088
#: Kilometres of a degree of latitude, and of longitude at the equator.
LAT_KM, LON_KM = 110.574, 111.320


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null where a place is unknown; least() would skip the null


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * {EARTH_KM} * asin(sqrt(CASE WHEN {a} > 1 THEN 1 ELSE {a} END))"


def box(lat: Column, km: float) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that km reach at a latitude."""
    return F.lit(km / LAT_KM), F.lit(km) / (F.lit(LON_KM) * F.cos(F.radians(lat)))


def in_country(lat: Column, lon: Column) -> Column:
    return lat.between(20.5, 26.7) & lon.between(88.0, 92.7)


def _band(lat: Column, km: float) -> Column:
    return F.floor(lat / (1.01 * km / LAT_KM)).cast("int")


def _cells(band: Column, km: float) -> Column:
    """Cells of a latitude band, each at least km wide at the narrowest latitude of the band and its neighbours; one near the poles."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * (1.01 * km / LAT_KM))
    return F.greatest(F.lit(1), F.floor(2 * math.pi * EARTH_KM * F.cos(F.radians(edge)) / (1.05 * km))).cast("int")


def _cell(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * n), n).cast("int")


def with_cell(points: DataFrame, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with their grid cell (band, cell); cells follow from km and latitude and close at 180 degrees."""
    return points.withColumn("band", _band(F.col(lat), km)).withColumn("cell", _cell(F.col(lon), _cells(F.col("band"), km)))


def with_cells_around(points: DataFrame, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points once for each cell within km of them: theirs and those around, in each band's own width."""
    rows = points.withColumn("band", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: _band(F.col(lat), km) + k)))
    n = _cells(F.col("band"), km)
    around = F.array_distinct(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.pmod(_cell(F.col(lon), n) + k, n).cast("int")))
    return rows.withColumn("cell", F.explode(around))
