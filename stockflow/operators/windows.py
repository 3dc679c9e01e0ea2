"""Ordered computations per key: gaps, running totals, changes, ranks, rolling demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.exact import decimal, exact_sum, ratio, sample_variance, square
from stockflow.functions.measures import number, seconds_between
from stockflow.functions.ranking import newest
from stockflow.functions.split_windows import previous_row, running_sums


def event_gaps(events: DataFrame) -> DataFrame:
    """Seconds since the event before of the same shipment (by time, then id)."""
    pairs = previous_row(
        events.select("id", "shipment_id", "event_timestamp"), ["shipment_id"], ["event_timestamp", "id"],
        {"previous_timestamp": "event_timestamp"},
    )
    return pairs.withColumn("gap_seconds", seconds_between(F.col("previous_timestamp"), F.col("event_timestamp")))


def longest_gaps(events: DataFrame) -> DataFrame:
    """Per shipment: events and the longest gap between two of them."""
    return event_gaps(events).groupBy("shipment_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("gap_seconds").alias("longest_gap_seconds")
    )


def running_stock(movements: DataFrame) -> DataFrame:
    """Cumulative signed movement per product and location (by time, then id)."""
    return running_sums(
        movements.select("id", "product_id", "location_id", "event_timestamp", "quantity"), ["product_id", "location_id"],
        ["event_timestamp", "id"], {"running_quantity": number("quantity")},
    )


def first_shortage(movements: DataFrame) -> DataFrame:
    """Per product and location: the first time the running stock is below zero, and the lowest point."""
    return running_stock(movements).groupBy("product_id", "location_id").agg(
        F.min(F.when(F.col("running_quantity") < 0, F.col("event_timestamp"))).alias("first_negative_at"),
        F.min("running_quantity").alias("lowest_quantity"),
    )


def snapshot_delta(snapshots: DataFrame) -> DataFrame:
    """Change of stock and value against the snapshot before."""
    pairs = previous_row(
        snapshots.select("id", "product_id", "location_id", "snapshot_date", "on_hand_quantity", "inventory_value_sek"),
        ["product_id", "location_id"], ["snapshot_date", "id"],
        {"previous_date": "snapshot_date", "_quantity": "on_hand_quantity", "_value": "inventory_value_sek"},
    )
    return pairs.withColumns({
        "quantity_change": number("on_hand_quantity") - number("_quantity"),
        "value_change_sek": number("inventory_value_sek") - number("_value"),
    }).drop("_quantity", "_value")


def supplier_rank(offers: DataFrame, k: int) -> DataFrame:
    """The k best offers per product: preferred first, then unit cost, lead time, id.

    The limit is cut per task before the shuffle.
    """
    best = Window.partitionBy("product_id").orderBy(F.desc("preferred"), "unit_cost_sek", "contracted_lead_time_days", "id")
    return offers.withColumn("supplier_rank", F.row_number().over(best)).filter(F.col("supplier_rank") <= k)


def daily_demand(lines: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered quantity per key and order date; keys are columns of the lines or the orders."""
    dated = orders.select(F.col("id").alias("sales_order_id"), "order_date", *[k for k in keys if k not in lines.columns])
    return lines.join(dated, "sales_order_id").groupBy(*keys, F.col("order_date").alias("day")).agg(
        exact_sum(number("ordered_quantity")).alias("demand")
    )


def rolling_demand(demand: DataFrame, keys: list[str], spans: list[int]) -> DataFrame:
    """Mean and deviation over the last n calendar days; days without a row count as zero.

    One row per key and day, so a window holds no more rows than the calendar has days.
    """
    numbered = demand.withColumn("_day", F.datediff("day", F.lit("1970-01-01").cast("date")))
    out = {}
    for span in spans:
        window = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-(span - 1), 0)
        total, squares = F.sum(decimal("demand")).over(window), F.sum(square("demand")).over(window)
        out[f"mean_{span}d"] = total.cast("double") / span
        out[f"deviation_{span}d"] = F.round(F.sqrt(sample_variance(F.lit(span), total, squares)), 6)
    return numbered.withColumns(out).drop("_day")


def latest_version(df: DataFrame) -> DataFrame:
    """The newest record of each external id."""
    return newest(df, ["external_id"], ["updated_at", "id"])


def expiry_risk(movements: DataFrame, as_of, days: int) -> DataFrame:
    """Lots with stock left that expire within the days, oldest first, and the share of stock they add up to."""
    keys = ["product_id", "location_id"]
    lots = movements.groupBy(*keys, "lot_number", "expiry_date").agg(exact_sum(number("quantity")).alias("lot_quantity"))
    held = lots.filter("lot_quantity > 0")
    stock = held.groupBy(*keys).agg(exact_sum("lot_quantity").alias("stock_quantity"))
    start = F.lit(as_of).cast("date")
    due = held.filter(F.col("expiry_date").between(start, F.date_add(start, days)))
    summed = running_sums(due, keys, ["expiry_date", "lot_number"], {"at_risk_quantity": F.col("lot_quantity")})
    return summed.join(stock, keys).withColumn("share_at_risk", ratio("at_risk_quantity", "stock_quantity"))
