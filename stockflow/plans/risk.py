"""Risk scores, anomalies, segments, causes of change, and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.exact import count_if, decimal, exact_sum, ratio
from stockflow.functions.measures import number
from stockflow.functions.ranking import exact_percentiles, with_tiles
from stockflow.plans.visibility import current_balances
from stockflow.session import cut


def risk_rules(
    suppliers: DataFrame, reliability: DataFrame, offers: DataFrame, balances: DataFrame, weights: dict[str, float], high_tiers
) -> DataFrame:
    """Risk points per supplier and their quintile (5 = riskiest).

    weights: late (share of late orders), rejected (share of goods), single
    (share of its products nobody else offers), tier (in the given high tiers),
    cover (share of its products under their reorder point somewhere).
    """
    pairs = offers.select("product_id", "supplier_id").distinct()
    sources = pairs.groupBy("product_id").agg(F.count(F.lit(1)).alias("sources"))
    short = current_balances(balances).groupBy("product_id").agg(
        F.max((number("available_quantity") + number("in_transit_quantity") < number("reorder_point_quantity")).cast("int")).alias("short")
    )
    facts = sources.join(short, "product_id", "left")
    exposure = pairs.join(facts, "product_id").groupBy("supplier_id").agg(
        ratio(count_if(F.col("sources") == 1), F.count(F.lit(1))).alias("single_rate"),
        ratio(count_if(F.col("short") == 1), F.count(F.lit(1))).alias("short_rate"),
    )
    scored = (
        suppliers.select(F.col("id").alias("supplier_id"), F.col("risk_tier").isin(*high_tiers).cast("double").alias("tier_flag"))
        .join(reliability.select("supplier_id", "on_time_rate", "rejected_rate"), "supplier_id", "left")
        .join(exposure, "supplier_id", "left").na.fill({"on_time_rate": 1.0, "rejected_rate": 0.0, "single_rate": 0.0, "short_rate": 0.0})
        .withColumn(
            "risk_points",
            weights["late"] * (1 - F.col("on_time_rate")) + weights["rejected"] * F.col("rejected_rate")
            + weights["single"] * F.col("single_rate") + weights["tier"] * F.col("tier_flag") + weights["cover"] * F.col("short_rate"),
        )
    )
    return with_tiles(cut(scored), {"risk_quintile": "risk_points"}, "supplier_id", 5)


def robust_anomalies(df: DataFrame, keys: list[str], value: str, cut_off: float) -> DataFrame:
    """Rows whose value lies more than cut_off × MAD from the median of their group.

    In a group whose MAD is zero every value off the median is an anomaly.
    """
    measured = df.filter(F.col(value).isNotNull())
    # one row per group, read three times below
    medians = cut(exact_percentiles(measured, keys, value, {"median": 0.5}))
    apart = measured.join(medians, keys).select(*keys, F.abs(number(value) - F.col("median")).alias("deviation"))
    spreads = exact_percentiles(apart, keys, "deviation", {"mad": 0.5})
    # one join of the rows with both measures, so a large group can still be split
    judged = measured.join(medians.join(spreads, keys), keys).withColumn("deviation", F.abs(number(value) - F.col("median")))
    return judged.filter(F.when(F.col("mad") == 0, F.col("deviation") > 0).otherwise(F.col("deviation") > cut_off * F.col("mad")))


def customer_facts(orders: DataFrame, as_of) -> DataFrame:
    """Recency (days since the last order), frequency and value per customer, over orders up to a day."""
    day = F.lit(as_of).cast("date")
    return orders.filter(F.col("order_date") <= day).groupBy("customer_id").agg(
        F.datediff(day, F.max("order_date")).alias("recency_days"), F.count(F.lit(1)).alias("orders"),
        exact_sum(number("total_value_sek")).alias("value_sek"),
    )


def customer_segments(orders: DataFrame, as_of) -> DataFrame:
    """Customer facts with quintiles; 5 is the most recent, most frequent, most valuable fifth."""
    facts = cut(customer_facts(orders, as_of)).withColumn("_recent", -F.col("recency_days"))
    tiles = {"recency_quintile": "_recent", "frequency_quintile": "orders", "value_quintile": "value_sek"}
    return with_tiles(facts, tiles, "customer_id", 5).drop("_recent")


def root_cause(
    facts: DataFrame, day: str, measure: str, dimensions: list[str], before: tuple[str, str], after: tuple[str, str], k: int
) -> DataFrame:
    """The change of a summed measure between two periods, split over the values of each dimension.

    One pass sums both periods at the finest grain; the k largest changes per dimension are kept, with their share.
    """
    inside = lambda period: F.col(day).between(*[F.lit(d).cast("date") for d in period])
    part = lambda period: F.sum(F.when(inside(period), decimal(measure)).otherwise(decimal(F.lit(0))))
    fine = facts.filter(inside(before) | inside(after)).groupBy(*dimensions).agg(part(before).alias("b"), part(after).alias("a"))
    split = fine.select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("p"),
        "a", "b",
    ).groupBy("p.dimension", "p.value").agg(F.sum("b").cast("double").alias("before"), F.sum("a").cast("double").alias("after"))
    changes = split.withColumn("change", F.col("after") - F.col("before"))
    totals = changes.groupBy("dimension").agg(exact_sum("change").alias("total_change"))
    largest = Window.partitionBy("dimension").orderBy(F.desc(F.abs("change")), "value")
    ranked = changes.withColumn("cause_rank", F.row_number().over(largest)).filter(F.col("cause_rank") <= k)
    return ranked.join(totals, "dimension").withColumn("share_of_change", ratio("change", "total_change")).drop("total_change")


def _alert(df: DataFrame, kind: str, key: Column, reason: Column, impact: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), key.alias("key"), reason.cast("double").alias("measure"), impact.cast("double").alias("impact_sek")
    )


def late_shipment_alerts(shipments: DataFrame, items: DataFrame, products: DataFrame, least_hours: float) -> DataFrame:
    """Late shipments; the impact is the sales value on board."""
    late = shipments.filter(number("delay_hours") > least_hours).select(F.col("id").alias("shipment_id"), "delay_hours")
    prices = products.select(F.col("id").alias("product_id"), number("selling_price_sek").alias("price"))
    loads = items.join(late, "shipment_id", "left_semi").select("shipment_id", "product_id", number("quantity").alias("q"))
    aboard = loads.join(prices, "product_id").groupBy("shipment_id").agg(
        exact_sum(F.col("q") * F.col("price")).alias("impact")
    ).join(late, "shipment_id")
    return _alert(aboard, "late shipment", F.col("shipment_id"), F.col("delay_hours"), F.col("impact"))


def low_stock_alerts(balances: DataFrame, products: DataFrame) -> DataFrame:
    """Places under their reorder point; the impact is the sales value of the shortage."""
    short = number("reorder_point_quantity") - number("available_quantity")
    prices = products.select(F.col("id").alias("product_id"), number("selling_price_sek").alias("price"))
    rows = current_balances(balances).withColumn("short", short).filter("short > 0").join(prices, "product_id")
    return _alert(rows, "low stock", F.concat_ws("@", "product_id", "location_id"), F.col("short"), F.col("short") * F.col("price"))


def expiry_alerts(expiring: DataFrame, products: DataFrame) -> DataFrame:
    """Lots about to expire (expiry_risk); the impact is their cost."""
    costs = products.select(F.col("id").alias("product_id"), number("unit_cost_sek").alias("cost"))
    return _alert(
        expiring.join(costs, "product_id"), "expiry", F.concat_ws("@", "product_id", "location_id", "lot_number", "expiry_date"),
        F.col("lot_quantity"), F.col("lot_quantity") * F.col("cost"),
    )


def cost_anomaly_alerts(anomalies: DataFrame) -> DataFrame:
    """Shipments of unusual freight cost (robust_anomalies); the impact is the distance from the median."""
    return _alert(anomalies, "freight anomaly", F.col("id"), number("freight_cost_sek"), F.round("deviation", 4))


def alerts(parts: list[DataFrame], k: int) -> DataFrame:
    """The k alerts of the highest impact."""
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("impact_sek"), "kind", "key").limit(k)
