"""Stock policies: safety stock, reorder points, order quantities, service levels, reorder and transfer lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.exact import count_if, decimal, exact_sum, ratio, sample_variance, square
from stockflow.functions.measures import number
from stockflow.operators.windows import supplier_rank
from stockflow.plans.kpi import fill_rate
from stockflow.plans.visibility import current_balances

PLACE = ["product_id", "location_id"]


def demand_stats(demand: DataFrame, keys: list[str], start, end) -> DataFrame:
    """Mean and variance of daily demand(keys, day, demand) in the closed period; days without a row count as zero."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = F.datediff(last, first) + 1
    inside = demand.filter(F.col("day").between(first, last))
    return inside.groupBy(*keys).agg(F.sum(decimal("demand")).alias("_s"), F.sum(square("demand")).alias("_q")).select(
        *keys, (F.col("_s").cast("double") / days).alias("demand_mean"), sample_variance(days, F.col("_s"), F.col("_q")).alias("demand_variance")
    )


def lead_time_stats(purchase_orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Mean and variance of actual purchase lead days per product. Days are whole, so the sums are exact."""
    days = F.datediff("actual_delivery_date", "order_date").cast("long")
    orders = purchase_orders.select(F.col("id").alias("purchase_order_id"), days.alias("days"))
    return lines.select("purchase_order_id", "product_id").join(orders, "purchase_order_id").groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("days").alias("s"), F.sum(F.col("days") * F.col("days")).alias("q")
    ).select(
        "product_id", ratio("s", "n").alias("lead_mean"),
        F.coalesce(sample_variance(F.col("n"), F.col("s"), F.col("q")), F.lit(0.0)).alias("lead_variance"),
    )


def _safety(z, lead, demand_variance, demand, lead_variance):
    return z * F.sqrt(lead * demand_variance + demand * demand * lead_variance)


def stock_policy(balances: DataFrame, demand: DataFrame, leads: DataFrame, z: float) -> DataFrame:
    """Safety stock z·√(L·σ²d + d²·σ²L) and reorder point d·L + safety stock, beside the stored values.

    demand is demand_stats per product and location. Places without demand need no stock.
    """
    current = current_balances(balances).select(
        *PLACE, number("available_quantity").alias("available_quantity"), number("in_transit_quantity").alias("in_transit_quantity"),
        number("safety_stock_quantity").alias("stored_safety_stock"), number("reorder_point_quantity").alias("stored_reorder_point"),
    )
    known = current.join(demand, PLACE, "left").join(leads, "product_id", "left").na.fill(
        0.0, ["demand_mean", "demand_variance", "lead_mean", "lead_variance"]
    )
    safety = _safety(z, F.col("lead_mean"), F.col("demand_variance"), F.col("demand_mean"), F.col("lead_variance"))
    return known.withColumn("safety_stock", F.round(safety, 6)).withColumn(
        "reorder_point", F.round(F.col("demand_mean") * F.col("lead_mean") + safety, 6)
    )


def what_if(policy: DataFrame, scenarios: list[tuple[str, float, float, float]]) -> DataFrame:
    """The policy under changed parameters: (name, demand factor, added lead days, z), one row per scenario.

    Scenarios ride along as a constant array, so no join is needed.
    """
    listed = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(float(f)).alias("factor"), F.lit(float(d)).alias("added"), F.lit(float(z)).alias("z"))
        for n, f, d, z in scenarios
    ])
    each = policy.select(*PLACE, "demand_mean", "demand_variance", "lead_mean", "lead_variance", F.explode(listed).alias("s"))
    demand, lead = F.col("demand_mean") * F.col("s.factor"), F.col("lead_mean") + F.col("s.added")
    variance = F.col("demand_variance") * F.col("s.factor") * F.col("s.factor")
    safety = _safety(F.col("s.z"), lead, variance, demand, F.col("lead_variance"))
    return each.select(
        F.col("s.scenario").alias("scenario"), *PLACE, F.round(safety, 6).alias("safety_stock"),
        F.round(demand * lead + safety, 6).alias("reorder_point"),
    )


def eoq(offers: DataFrame, demand: DataFrame, order_cost: float, holding_rate: float) -> DataFrame:
    """Order quantity √(2DS/H) per product from its best offer, at least the minimum order and at most what the
    supplier can make in its lead time. demand_mean is per day; H is the holding rate × unit cost."""
    best = supplier_rank(offers, 1).select(
        "product_id", "supplier_id", number("unit_cost_sek").alias("unit_cost_sek"),
        number("minimum_order_quantity").alias("minimum_order_quantity"),
        (number("supplier_capacity_per_day") * F.col("contracted_lead_time_days")).alias("supplier_limit"),
    )
    needed = best.join(demand, "product_id").withColumn("annual_demand", F.col("demand_mean") * 365)
    plain = F.sqrt(F.try_divide(2 * F.col("annual_demand") * order_cost, holding_rate * F.col("unit_cost_sek")))
    return needed.withColumn("eoq", F.round(plain, 6)).withColumn(
        "order_quantity", F.round(F.least(F.greatest(plain, "minimum_order_quantity"), "supplier_limit"), 6)
    ).select("product_id", "supplier_id", "annual_demand", "eoq", "minimum_order_quantity", "supplier_limit", "order_quantity")


def service_level(snapshots: DataFrame, lines: DataFrame) -> DataFrame:
    """Per product: share of product-days (per location) with stock available, and share of demand filled."""
    days = snapshots.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("stock_days"), count_if(number("available_quantity") > 0).alias("days_available")
    ).withColumn("availability", ratio("days_available", "stock_days"))
    filled = fill_rate(lines, ["product_id"]).select("product_id", "fill_rate")
    return days.join(filled, "product_id", "full_outer")


def reorder_list(balances: DataFrame, quantities: DataFrame) -> DataFrame:
    """Places whose available plus inbound stock is under the stored reorder point, with supplier and quantity (eoq)."""
    cover = number("available_quantity") + number("in_transit_quantity")
    short = current_balances(balances).withColumn("covered_quantity", cover).filter(
        F.col("covered_quantity") < number("reorder_point_quantity")
    )
    chosen = quantities.select("product_id", "supplier_id", "order_quantity")
    return short.join(chosen, "product_id", "left").select(
        "product_id", "location_id", "covered_quantity", number("reorder_point_quantity").alias("reorder_point_quantity"),
        "supplier_id", "order_quantity",
    )


def transfer_list(balances: DataFrame) -> DataFrame:
    """Move stock above the reorder point to places below it, largest surplus to largest deficit.

    Both sides lie end to end on one line per product. Every end on that line
    closes one move, so the work grows with the places of a product, not with
    their pairs: read from the far end, each window only ever gains rows.
    """
    spare = decimal("available_quantity") - decimal("reorder_point_quantity")
    places = current_balances(balances).select(*PLACE, spare.alias("spare"))

    def ends(side, amount):
        lined_up = Window.partitionBy("product_id").orderBy(F.desc("amount"), "location_id").rowsBetween(Window.unboundedPreceding, 0)
        rows = places.withColumn("amount", amount).filter("amount > 0")
        return rows.select("product_id", F.sum("amount").over(lined_up).alias("end"), F.col("location_id").alias(side))

    points = ends("from_location_id", F.col("spare")).unionByName(ends("to_location_id", -F.col("spare")), allowMissingColumns=True)
    ahead = Window.partitionBy("product_id").orderBy(F.desc("end")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    in_turn = Window.partitionBy("product_id").orderBy("end", F.col("from_location_id").isNull())
    moves = points.withColumns({
        "from_location": F.last("from_location_id", ignorenulls=True).over(ahead),
        "to_location": F.last("to_location_id", ignorenulls=True).over(ahead),
        "moved": F.col("end") - F.coalesce(F.lag("end").over(in_turn), F.lit(0)),
    })
    return moves.filter("moved > 0 and from_location is not null and to_location is not null").select(
        "product_id", F.col("from_location").alias("from_location_id"), F.col("to_location").alias("to_location_id"),
        F.col("moved").cast("double").alias("quantity"),
    )
