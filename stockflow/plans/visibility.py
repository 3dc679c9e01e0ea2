"""What is where, and what is late."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.exact import exact_sum, ratio
from stockflow.functions.split_windows import running_sums
from stockflow.functions.measures import has_status, number, seconds_between, truncated
from stockflow.functions.ranking import newest


def shipment_position(events: DataFrame, locations: DataFrame) -> DataFrame:
    """The newest event of each shipment (by time, then number, then id) with its place."""
    places = locations.select(F.col("id").alias("location_id"), "location_code", F.col("name").alias("location_name"))
    last = newest(
        events.select("shipment_id", "id", "event_sequence", "event_type", "event_timestamp", "latitude", "longitude", "location_id"),
        ["shipment_id"], ["event_timestamp", "event_sequence", "id"],
    )
    return last.join(places, "location_id", "left")


def current_balances(balances: DataFrame) -> DataFrame:
    return newest(balances, ["product_id", "location_id"], ["as_of_timestamp", "id"])


def warehouse_inventory(balances: DataFrame) -> DataFrame:
    """Totals per location over the newest balance of each product."""
    measures = ["on_hand", "reserved", "available", "in_transit", "damaged"]
    return current_balances(balances).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("products"), *[exact_sum(number(f"{m}_quantity")).alias(f"{m}_quantity") for m in measures]
    )


def order_status(sales: DataFrame, purchases: DataFrame, transfers: DataFrame, production: DataFrame) -> DataFrame:
    """All orders in one list with kind, number, status and due date."""

    def part(df, kind, number_column, due):
        return df.select(
            F.lit(kind).alias("kind"), "id", F.col(number_column).alias("order_number"), "status", F.to_date(due).alias("due_date")
        )

    return (
        part(sales, "sales", "order_number", "promised_delivery_date")
        .unionByName(part(purchases, "purchase", "purchase_order_number", "confirmed_delivery_date"))
        .unionByName(part(transfers, "transfer", "transfer_number", "required_arrival_date"))
        .unionByName(part(production, "production", "production_order_number", "planned_end_at"))
    )


def order_status_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("orders"), F.min("due_date").alias("earliest_due"))


def fleet_status(shipments: DataFrame, open_statuses: list[str]) -> DataFrame:
    """Open shipments by carrier and mode, one count per status, with their load."""
    return shipments.filter(has_status("status", open_statuses)).groupBy("carrier_id", "transport_mode").agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(f"shipments_{s}") for s in open_statuses],
        exact_sum(number("total_weight_kg")).alias("weight_kg"), exact_sum(number("total_volume_m3")).alias("volume_m3"),
    )


def _stays(events: DataFrame) -> DataFrame:
    return events.groupBy("location_id", "shipment_id").agg(
        F.min("event_timestamp").alias("first_at"), F.max("event_timestamp").alias("last_at")
    )


def port_dwell(events: DataFrame) -> DataFrame:
    """Per location: shipments seen and mean hours from their first to last event there."""
    seconds = seconds_between(F.col("first_at"), F.col("last_at"))
    return _stays(events).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("shipments"), ratio(exact_sum(seconds, 6) / 3600.0, F.count(F.lit(1))).alias("mean_dwell_hours")
    )


def port_congestion(events: DataFrame) -> DataFrame:
    """Shipments present per location and hour.

    Arrivals and departures are netted per hour before they are added up, so a
    location brings at most one row per hour, however many shipments it sees.
    """
    stays = _stays(events)
    changes = stays.select("location_id", F.explode(F.array(
        F.struct(truncated(stays, "first_at", "hour").alias("hour"), F.lit(1).alias("change")),
        F.struct((truncated(stays, "last_at", "hour") + F.expr("interval 1 hour")).alias("hour"), F.lit(-1).alias("change")),
    )).alias("c")).groupBy("location_id", "c.hour").agg(F.sum("c.change").alias("change"))
    by_hour = Window.partitionBy("location_id").orderBy("hour")
    present = changes.withColumns({"present": F.sum("change").over(by_hour), "until": F.lead("hour").over(by_hour)})
    hours = F.explode(F.sequence(F.col("hour"), F.col("until") - F.expr("interval 1 hour"), F.expr("interval 1 hour")))
    return present.filter("present > 0").select("location_id", hours.alias("hour"), "present")


def port_peaks(events: DataFrame) -> DataFrame:
    """The highest number of shipments at a location at once, per hour with any.

    A sweep over arrivals and departures in order of time; a stay is closed, so arrivals of an instant count before its
    departures. The running number is summed per stretch of a location and carried on, so a busy location is many
    tasks. Hours without a change take over the number that the last one left.
    """
    stays = _stays(events)
    moves = stays.select("location_id", F.col("shipment_id").alias("_tie"), F.explode(F.array(
        F.struct(F.col("first_at").alias("at"), F.lit(0).alias("out")), F.struct(F.col("last_at").alias("at"), F.lit(1).alias("out")),
    )).alias("m")).select("location_id", "_tie", "m.at", "m.out")
    order = ["at", "out", "_tie"]
    summed = running_sums(moves, ["location_id"], order, {"present": 1 - 2 * F.col("out")}, scale=0)
    hourly = summed.groupBy("location_id", truncated(summed, "at", "hour").alias("hour")).agg(
        F.max("present").cast("long").alias("top"), F.max_by("present", F.struct(*order)).cast("long").alias("left"),
    )
    by_hour = Window.partitionBy("location_id").orderBy("hour")
    step = F.expr("interval 1 hour")
    known = hourly.withColumns({"carried": F.coalesce(F.lag("left").over(by_hour), F.lit(0)), "until": F.lead("hour").over(by_hour)})
    own = known.select("location_id", "hour", F.greatest("top", "carried").alias("at_once"))
    quiet = known.filter((F.col("left") > 0) & (F.col("until") > F.col("hour") + step)).select(
        "location_id", F.explode(F.sequence(F.col("hour") + step, F.col("until") - step, step)).alias("hour"), F.col("left").alias("at_once")
    )
    return own.unionByName(quiet).filter("at_once > 0")


def delayed_orders(orders: DataFrame, purchases: DataFrame, as_of) -> DataFrame:
    """Sales orders (order_delivery) past their promised date and purchases past their confirmed date, highest value first.

    A sales order is judged at its last arrival, or at the given day while a line is still to arrive.
    """
    sales = orders.select(
        F.lit("sales").alias("kind"), F.col("sales_order_id").alias("id"), F.col("promised_delivery_date").alias("due_date"),
        F.when(F.col("all_arrived"), F.to_date("arrived_at")).otherwise(F.lit(as_of).cast("date")).alias("seen_on"),
        F.col("total_value_sek").alias("value_sek"),
    )
    bought = purchases.select(
        F.lit("purchase").alias("kind"), "id", F.col("confirmed_delivery_date").alias("due_date"),
        F.col("actual_delivery_date").alias("seen_on"), number("total_value_sek").alias("value_sek"),
    )
    late = sales.unionByName(bought).withColumn("days_late", F.datediff("seen_on", "due_date"))
    return late.filter("days_late > 0").drop("seen_on").orderBy(F.desc("value_sek"), "kind", "id")
