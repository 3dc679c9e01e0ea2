"""Travel times, arrival estimates, and routes over observed lanes."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.exact import count_if, exact_sum, ratio
from stockflow.functions.measures import haversine_km, has_status, hours_between, number, seconds_between
from stockflow.functions.ranking import newest
from stockflow.session import cut

LANE = ["origin_location_id", "destination_location_id"]
SERVICE = [*LANE, "transport_mode", "carrier_id"]


def _travel_seconds(shipments: DataFrame, done_statuses):
    """Done shipments counted per service and time of travel: percentiles then keep one count per time."""
    seconds = seconds_between(F.col("actual_departure_at"), F.col("actual_arrival_at"))
    done = shipments.filter(has_status("status", done_statuses)).withColumn("seconds", seconds)
    return done.groupBy(*SERVICE, "seconds").agg(F.count(F.lit(1)).alias("n"))


def lane_times(shipments: DataFrame, least: int = 5, done_statuses=None) -> DataFrame:
    """p50 and p90 travel hours per lane, mode and carrier; with fewer than `least` trips those of the lane, then of the mode."""
    counted = _travel_seconds(shipments, done_statuses)

    def times(keys, name):
        return counted.groupBy(*keys).agg(
            F.sum("n").alias(f"{name}_n"),
            *[F.round(F.percentile("seconds", p, F.col("n")) / 3600, 6).alias(f"{name}_p{round(100 * p)}") for p in (0.5, 0.9)],
        )

    joined = times(SERVICE, "service").join(times(LANE, "lane"), LANE).join(times(["transport_mode"], "mode"), "transport_mode")
    basis = F.when(F.col("service_n") >= least, "service").when(F.col("lane_n") >= least, "lane").otherwise("mode")
    chosen = lambda p: F.when(F.col("basis") == "service", F.col(f"service_{p}")).when(
        F.col("basis") == "lane", F.col(f"lane_{p}")).otherwise(F.col(f"mode_{p}"))
    return joined.withColumn("basis", basis).select(
        *SERVICE, F.col("service_n").alias("trips"), "basis", chosen("p50").alias("p50_hours"), chosen("p90").alias("p90_hours")
    )


def eta_estimate(events: DataFrame, shipments: DataFrame, locations: DataFrame, done_statuses=None) -> DataFrame:
    """Arrival from the newest position: remaining km ÷ the speed of the lane (of the mode if the lane has none)."""
    hours = hours_between(F.col("actual_departure_at"), F.col("actual_arrival_at"))
    done = shipments.filter(has_status("status", done_statuses))

    def speed(keys, name):
        return done.groupBy(*keys).agg(ratio(exact_sum(number("distance_km")), exact_sum(hours, 6)).alias(name))

    places = locations.select(F.col("id").alias("destination_location_id"), F.col("latitude").alias("to_lat"), F.col("longitude").alias("to_lon"))
    at = newest(events.select("shipment_id", "id", "event_timestamp", "latitude", "longitude"), ["shipment_id"], ["event_timestamp", "id"])
    known = at.drop("id").join(
        shipments.select(F.col("id").alias("shipment_id"), *LANE, "transport_mode", "current_eta", "actual_arrival_at"), "shipment_id"
    ).join(places, "destination_location_id").join(speed(LANE, "lane_speed"), LANE, "left").join(
        speed(["transport_mode"], "mode_speed"), "transport_mode", "left"
    )
    left = haversine_km(F.col("latitude"), F.col("longitude"), F.col("to_lat"), F.col("to_lon"))
    seconds = F.round(F.try_divide(left, F.col("speed_kmh")) * 3600).cast("long")
    return known.withColumn("speed_kmh", F.coalesce("lane_speed", "mode_speed")).withColumns({
        "remaining_km": F.round(left, 6), "eta_at": F.timestamp_add("SECOND", seconds, F.col("event_timestamp")),
    }).select(
        "shipment_id", "event_timestamp", "remaining_km", "speed_kmh", "eta_at",
        hours_between(F.col("current_eta"), F.col("eta_at")).alias("hours_after_current_eta"),
        hours_between(F.col("actual_arrival_at"), F.col("eta_at")).alias("hours_after_actual"),
    )


TRAVEL_NUMBERS = ["distance_km", "total_weight_kg", "total_volume_m3", "planned_hours"]
TRAVEL_LABELS = ["transport_mode", "service_level", "shipment_type"]


def shipment_features(shipments: DataFrame, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """Features known at departure, the travel hours, and columns of extra feature tables ({join column: table})."""
    out = shipments.withColumns({
        **{c: number(c) for c in ("distance_km", "total_weight_kg", "total_volume_m3", "delay_hours")},
        "planned_hours": hours_between(F.col("planned_departure_at"), F.col("planned_arrival_at")),
        "travel_hours": hours_between(F.col("actual_departure_at"), F.col("actual_arrival_at")),
    })
    for column, table in (extra or {}).items():
        out = out.join(table, column, "left")
    return out


def feature_stages(numbers: list[str], labels: list[str]) -> list:
    indexed = [f"{c}_index" for c in labels]
    return [
        StringIndexer(inputCols=labels, outputCols=indexed, handleInvalid="keep"),
        VectorAssembler(inputCols=[*numbers, *indexed], outputCol="features", handleInvalid="keep"),
    ]


def arrived_by(features: DataFrame, day) -> DataFrame:
    """Shipments whose arrival, and so whose travel time and delay, is known at the end of the day."""
    return features.filter(F.to_date("actual_arrival_at") <= F.lit(day).cast("date"))


def bins_for(prepared: PipelineModel) -> int:
    """Bins that hold every label of the indexed columns, and the unknown one."""
    return max(64, *[len(labels) + 1 for labels in prepared.stages[0].labelsArray])


def eta_gbt(features: DataFrame, train_until, numbers=None, labels=None, seed: int = 7, rounds: int = 20) -> tuple[DataFrame, PipelineModel]:
    """Boosted regression of travel hours; trained on shipments that arrived by a day, scored on departures after it."""
    numbers, labels = numbers or TRAVEL_NUMBERS, labels or TRAVEL_LABELS
    early = F.to_date("actual_departure_at") <= F.lit(train_until).cast("date")
    known = cut(features)
    train, prepared = arrived_by(known, train_until), feature_stages(numbers, labels)
    prepared = Pipeline(stages=prepared).fit(train)
    learner = GBTRegressor(
        labelCol="travel_hours", predictionCol="predicted_hours", maxIter=rounds, maxDepth=4, maxBins=bins_for(prepared), seed=seed
    )
    model = PipelineModel([*prepared.stages, learner.fit(prepared.transform(train))])
    return model.transform(known.filter(~early)).select("id", "travel_hours", "predicted_hours"), model


def carrier_rank(shipments: DataFrame, k: int, done_statuses=None) -> DataFrame:
    """The k best carrier and mode pairs per lane by mean cost, then median travel time, then late share."""
    times = _travel_seconds(shipments, done_statuses).groupBy(*SERVICE).agg(
        F.round(F.percentile("seconds", 0.5, F.col("n")) / 3600, 6).alias("p50_hours")
    )
    costs = shipments.filter(has_status("status", done_statuses)).groupBy(*SERVICE).agg(
        F.count(F.lit(1)).alias("trips"), ratio(exact_sum(number("freight_cost_sek")), F.count(F.lit(1))).alias("mean_cost_sek"),
        ratio(count_if(number("delay_hours") > 0), F.count(F.lit(1))).alias("late_rate"),
    )
    best = Window.partitionBy(*LANE).orderBy("mean_cost_sek", "p50_hours", "late_rate", "carrier_id", "transport_mode")
    return costs.join(times, SERVICE).withColumn("carrier_rank", F.row_number().over(best)).filter(F.col("carrier_rank") <= k)


def lane_costs(shipments: DataFrame) -> DataFrame:
    """Mean freight cost of the cheapest carrier and mode per lane."""
    service = shipments.groupBy(*SERVICE).agg(ratio(exact_sum(number("freight_cost_sek")), F.count(F.lit(1))).alias("cost"))
    return service.groupBy(F.col("origin_location_id").alias("origin"), F.col("destination_location_id").alias("destination")).agg(
        F.min("cost").alias("cost")
    )


def two_leg_routes(shipments: DataFrame) -> DataFrame:
    """The cheapest direct or one-stop route per origin and destination over observed lanes.

    Legs are one row per lane before they meet, and each pair of ends keeps its
    cheapest route as it is formed.
    """
    costs = lane_costs(shipments).filter(F.col("origin") != F.col("destination"))
    first = costs.select("origin", F.col("destination").alias("stop"), F.col("cost").alias("c1"))
    second = costs.select(F.col("origin").alias("stop"), "destination", F.col("cost").alias("c2"))
    one_stop = first.join(second, "stop").filter(F.col("origin") != F.col("destination")).select(
        "origin", "destination", (F.col("c1") + F.col("c2")).alias("cost"), F.col("stop").alias("via")
    )
    routes = costs.withColumn("via", F.lit(None).cast("string")).unionByName(one_stop)
    order = F.struct("cost", F.col("via").isNotNull(), "via")
    return routes.groupBy("origin", "destination").agg(F.min("cost").alias("cost_sek"), F.min_by("via", order).alias("via_location_id"))
