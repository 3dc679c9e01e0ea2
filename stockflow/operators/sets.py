"""Top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_delays(shipments: DataFrame, k: int) -> DataFrame:
    """The k shipments with the longest delay, ties by id."""
    return shipments.orderBy(F.desc("delay_hours"), "id").limit(k)


def location_usage(shipments: DataFrame) -> DataFrame:
    """Locations used as origin only, destination only, or both.

    Membership in both sets comes from one pass and one aggregation, where
    except and intersect would read the shipments once per operand.
    """
    ends = shipments.select(F.explode(F.array(
        F.struct(F.col("origin_location_id").alias("location_id"), F.lit(True).alias("origin")),
        F.struct(F.col("destination_location_id").alias("location_id"), F.lit(False).alias("origin")),
    )).alias("e"))
    sets = ends.groupBy("e.location_id").agg(F.bool_or("e.origin").alias("starts"), F.bool_or(~F.col("e.origin")).alias("ends"))
    usage = F.when(F.col("starts") & F.col("ends"), "both").when(F.col("starts"), "origin").otherwise("destination")
    return sets.select("location_id", usage.alias("usage"))
