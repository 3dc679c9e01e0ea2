"""Scalar expressions over the model's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def number(name: str) -> Column:
    """A measure as double: money and quantities are stored as 4-byte floats."""
    return F.col(name).cast("double")


def has_status(column: str, statuses) -> Column:
    """True for rows in the given statuses; None means every status."""
    return F.lit(True) if statuses is None else F.col(column).isin(*statuses)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance between two points given in degrees."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    flat = half(lat1, lat2) * half(lat1, lat2)
    turn = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(flat + turn)))


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 3600.0


def seconds_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / 1000000.0


def local_time(df: DataFrame, utc_time: str, zone: str) -> DataFrame:
    """Add the time on the local clock, its hour and weekday (1 = Monday). Zone-less times are taken as UTC."""
    zoned = dict(df.dtypes)[utc_time] == "timestamp"
    source = F.current_timezone() if zoned else F.lit("UTC")
    clock = F.convert_timezone(source, F.col(zone), F.col(utc_time).cast("timestamp_ntz"))
    return df.withColumn("local_time", clock).withColumns(
        {"local_hour": F.hour("local_time"), "local_weekday": F.weekday("local_time") + 1}
    )


def truncated(df: DataFrame, column: str, unit: str) -> Column:
    """A time cut down to the unit, in the type of its column (date_trunc alone always gives a zoned time)."""
    return F.date_trunc(unit, column).cast(dict(df.dtypes)[column])


def month_of(column) -> Column:
    return F.trunc(F.to_date(column), "month")
