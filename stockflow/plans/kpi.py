"""Key performance indicators.

Facts are summed to the grain of the next join key before each join, and to
the finest wanted grain before a cube or rollup multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.exact import count_if, decimal, exact_sum, ratio, sample_variance
from stockflow.functions.measures import has_status, hours_between, month_of, number
from stockflow.functions.ranking import newest


def _line_arrivals(lines: DataFrame, items: DataFrame, shipments: DataFrame, done_statuses) -> DataFrame:
    """Sales lines with the last arrival and worst delay over their shipments."""
    arrived = shipments.filter(has_status("status", done_statuses)).select(
        F.col("id").alias("shipment_id"), "actual_arrival_at", number("delay_hours").alias("delay_hours")
    )
    last = (
        items.filter("sales_order_line_id is not null").select("shipment_id", F.col("sales_order_line_id").alias("line_id"))
        .join(arrived, "shipment_id").groupBy("line_id")
        .agg(F.max("actual_arrival_at").alias("arrived_at"), F.max("delay_hours").alias("worst_delay_hours"))
    )
    ordered, delivered = number("ordered_quantity"), number("delivered_quantity")
    return lines.select(
        F.col("id").alias("line_id"), "sales_order_id", "product_id", (delivered >= ordered).alias("in_full")
    ).join(last, "line_id", "left")


def line_delivery(
    lines: DataFrame, items: DataFrame, shipments: DataFrame, orders: DataFrame, done_statuses=None
) -> DataFrame:
    """Sales lines with their last arrival, worst delay, and on-time and in-full flags.

    On time: the last arrival is not after the promised date; a line that was
    not shipped is not on time. done_statuses names the shipments that have
    arrived (None: all).
    """
    headers = orders.select(F.col("id").alias("sales_order_id"), "customer_id", "order_date", "promised_delivery_date")
    on_time = F.coalesce(F.to_date("arrived_at") <= F.col("promised_delivery_date"), F.lit(False))
    return _line_arrivals(lines, items, shipments, done_statuses).join(headers, "sales_order_id").withColumn("on_time", on_time)


def order_delivery(
    lines: DataFrame, items: DataFrame, shipments: DataFrame, orders: DataFrame, done_statuses=None,
    movements: DataFrame | None = None, damage_reasons=(),
) -> DataFrame:
    """Orders with at least one line: all lines on time, all in full, last arrival, worst delay, any line damaged.

    Lines are merged per order before they meet the headers, so an order of
    very many lines is one row in that join.
    """
    facts = _line_arrivals(lines, items, shipments, done_statuses)
    if movements is None:
        facts = facts.withColumn("damaged", F.lit(False))
    else:
        broken = movements.filter(F.col("reason_code").isin(*damage_reasons) & F.col("sales_order_line_id").isNotNull())
        broken = broken.select(F.col("sales_order_line_id").alias("line_id")).distinct().withColumn("damaged", F.lit(True))
        facts = facts.join(broken, "line_id", "left")
    merged = facts.groupBy("sales_order_id").agg(
        F.min("in_full").alias("in_full"), F.max("arrived_at").alias("arrived_at"),
        (F.count("arrived_at") == F.count(F.lit(1))).alias("all_arrived"),
        F.max("worst_delay_hours").alias("worst_delay_hours"), F.coalesce(F.max("damaged"), F.lit(False)).alias("damaged"),
    )
    headers = orders.select(
        F.col("id").alias("sales_order_id"), "customer_id", "order_date", "promised_delivery_date", "priority",
        number("total_value_sek").alias("total_value_sek"),
    )
    in_time = F.coalesce(F.to_date("arrived_at") <= F.col("promised_delivery_date"), F.lit(False))
    return merged.join(headers, "sales_order_id").withColumn("on_time", F.col("all_arrived") & in_time)


def otif(orders: DataFrame) -> DataFrame:
    """Orders (order_delivery) on time and in full: in total, by customer, by month."""
    counted = orders.groupBy("customer_id", month_of("order_date").alias("order_month")).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("on_time")).alias("t"), count_if(F.col("in_full")).alias("f"),
        count_if(F.col("on_time") & F.col("in_full")).alias("b"),
    )
    return counted.groupingSets([[], ["customer_id"], ["order_month"]], "customer_id", "order_month").agg(
        F.grouping_id().cast("int").alias("grouping_level"),
        F.sum("n").alias("orders"), F.sum("t").alias("on_time_orders"), F.sum("f").alias("in_full_orders"),
        F.sum("b").alias("otif_orders"), ratio(F.sum("b"), F.sum("n")).alias("otif_rate"),
    )


def fill_rate(lines: DataFrame, by: list[str]) -> DataFrame:
    """Share of the ordered quantity that was delivered, and share of lines delivered in full."""
    ordered, delivered = number("ordered_quantity"), number("delivered_quantity")
    return lines.groupBy(*by).agg(
        exact_sum(ordered).alias("ordered_quantity"), exact_sum(F.least(delivered, ordered)).alias("filled_quantity"),
        F.count(F.lit(1)).alias("lines"), count_if(delivered >= ordered).alias("full_lines"),
    ).withColumns({
        "fill_rate": ratio("filled_quantity", "ordered_quantity"), "line_fill_rate": ratio("full_lines", "lines"),
    })


def _needed_percent(ordered: Column, delivered: Column) -> Column:
    """The least whole percentage of the delivered quantity that covers the ordered one; null where none does."""
    return F.when(ordered <= 0, F.lit(0)).otherwise(F.ceil(F.try_divide(decimal(ordered) * 100, decimal(delivered)))).cast("long")


def slack_histograms(
    deliveries: DataFrame, lines: DataFrame, orders: DataFrame, by: list[str]
) -> tuple[DataFrame, DataFrame]:
    """What any shift of arrivals or supply can be answered from, per group (columns of the orders).

    Orders by days of slack (promised less last arrival; null: not all arrived) and by the percentage of supply
    they need; ordered and delivered quantity of the lines by that percentage (null: none is enough). The rows are
    bounded by groups × days × percentages, not by orders.
    """
    needed = lines.select(
        F.col("id").alias("line_id"), "sales_order_id", number("ordered_quantity").alias("ordered"), number("delivered_quantity").alias("delivered"),
        _needed_percent(number("ordered_quantity"), number("delivered_quantity")).alias("needed"),
    )
    headers = orders.select(F.col("id").alias("sales_order_id"), "promised_delivery_date", *by)
    merged = deliveries.select("line_id", "sales_order_id", "arrived_at").join(needed.select("line_id", "needed"), "line_id").groupBy("sales_order_id").agg(
        F.when(F.count("arrived_at") == F.count(F.lit(1)), F.max(F.to_date("arrived_at"))).alias("arrived_on"),
        F.when(F.count("needed") == F.count(F.lit(1)), F.max("needed")).alias("needed"),
    )
    slack = merged.join(headers, "sales_order_id").groupBy(
        *by, F.datediff("promised_delivery_date", "arrived_on").alias("slack"), "needed"
    ).agg(F.count(F.lit(1)).alias("orders"))
    cover = needed.groupBy("sales_order_id", "needed").agg(F.sum(decimal("ordered")).alias("ordered"), F.sum(decimal("delivered")).alias("delivered"))
    supply = cover.join(headers, "sales_order_id").groupBy(*by, "needed").agg(
        F.sum(F.col("ordered")).alias("ordered"), F.sum(F.col("delivered")).alias("delivered")
    )
    return slack, supply


def kpi_scenarios(
    deliveries: DataFrame, lines: DataFrame, orders: DataFrame, by: list[str], scenarios: list[tuple[str, int, int]]
) -> DataFrame:
    """OTIF and fill rate per group under (name, days all arrivals shift by, percentage of supply), one row per scenario.

    deliveries are those of line_delivery. The facts are passed once, into histograms; every scenario is a sum over
    these. Scenarios ride along as a constant array.
    """
    slack, supply = slack_histograms(deliveries, lines, orders, by)
    listed = F.explode(F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(int(d)).alias("days"), F.lit(int(p)).alias("percent")) for n, d, p in scenarios
    ])).alias("s")
    met = (F.col("slack") >= F.col("s.days")) & (F.col("needed") <= F.col("s.percent"))
    counted = slack.select("*", listed).groupBy(F.col("s.scenario").alias("scenario"), *by).agg(
        F.sum("orders").alias("orders"), F.sum(F.when(met, F.col("orders")).otherwise(0)).alias("otif_orders"),
    )
    enough = F.coalesce(F.col("needed") <= F.col("s.percent"), F.lit(False))
    # all of the ordered quantity where that is enough, else the share of the delivered one
    filled = F.when(enough, F.col("ordered").cast("decimal(38,6)")).otherwise((F.col("delivered") * F.col("s.percent") / 100).cast("decimal(38,6)"))
    quantities = supply.select("*", listed).groupBy(F.col("s.scenario").alias("scenario"), *by).agg(
        F.sum("ordered").cast("double").alias("ordered_quantity"), F.sum(filled).cast("double").alias("filled_quantity")
    )
    return counted.join(quantities, ["scenario", *by]).select(
        "scenario", *by, "orders", "otif_orders", ratio("otif_orders", "orders").alias("otif_rate"),
        "ordered_quantity", "filled_quantity", ratio("filled_quantity", "ordered_quantity").alias("fill_rate"),
    )


def cost_of_goods(lines: DataFrame, orders: DataFrame, products: DataFrame, start, end) -> DataFrame:
    """Shipped quantity × unit cost per product, for orders dated in the closed period."""
    dated = orders.filter(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    shipped = (
        lines.join(dated.select(F.col("id").alias("sales_order_id")), "sales_order_id", "left_semi")
        .groupBy("product_id").agg(exact_sum(number("shipped_quantity")).alias("shipped_quantity"))
    )
    costs = products.select(F.col("id").alias("product_id"), number("unit_cost_sek").alias("unit_cost_sek"))
    return shipped.join(costs, "product_id").withColumn("cogs_sek", F.col("shipped_quantity") * F.col("unit_cost_sek"))


def mean_stock(snapshots: DataFrame, start, end) -> DataFrame:
    """Per product: mean over the days of the summed inventory value, and mean stored days of supply."""
    inside = snapshots.filter(F.col("snapshot_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    daily = inside.groupBy("product_id", "snapshot_date").agg(
        exact_sum(number("inventory_value_sek")).alias("v"), exact_sum(number("days_of_supply")).alias("s"),
        F.count(F.lit(1)).alias("n"),
    )
    return daily.groupBy("product_id").agg(
        (exact_sum("v") / F.count(F.lit(1))).alias("mean_value_sek"),
        ratio(exact_sum("s"), F.sum("n")).alias("stored_days_of_supply"),
    )


def inventory_turnover(cogs: DataFrame, stock: DataFrame) -> DataFrame:
    """Cost of goods ÷ mean inventory value per product held."""
    return stock.join(cogs.select("product_id", "cogs_sek"), "product_id", "left").withColumn(
        "cogs_sek", F.coalesce("cogs_sek", F.lit(0.0))
    ).withColumn("turnover", ratio("cogs_sek", "mean_value_sek"))


def days_of_inventory(cogs: DataFrame, stock: DataFrame, days: int) -> DataFrame:
    """Mean inventory value ÷ daily cost of goods, beside the stored days of supply."""
    return inventory_turnover(cogs, stock).withColumn(
        "days_of_inventory", ratio(F.col("mean_value_sek"), F.col("cogs_sek") / days)
    ).drop("turnover")


def order_cycle_time(orders: DataFrame, by: list[str]) -> DataFrame:
    """Days from order to last arrival (order_delivery). Days are whole, so an exact percentile keeps one count per day."""
    days = orders.filter("arrived_at is not null").withColumn("days", F.datediff(F.to_date("arrived_at"), "order_date"))
    counted = days.groupBy(*by, "days").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(
        F.sum("n").alias("orders"), ratio(F.sum(F.col("days") * F.col("n")), F.sum("n")).alias("mean_days"),
        F.round(F.percentile("days", 0.5, F.col("n")), 6).alias("median_days"),
        F.round(F.percentile("days", 0.9, F.col("n")), 6).alias("p90_days"),
    )


def forecast_accuracy(forecast: DataFrame, actual: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """WAPE, MAPE (over non-zero actuals), bias and RMSE of forecast(keys, forecast) against actual(keys, demand).

    The actual has one row per key. A period without one counts as zero demand, so rows of zero take no part in the
    join. It meets the forecast where that lies, if both are already dealt out by some of the keys.
    """
    actual.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    moved = actual.select(*keys, "demand").filter("demand != 0").hint("shuffle_hash")
    pairs = forecast.join(moved, keys, "left").withColumn("demand", F.coalesce("demand", F.lit(0.0)))
    error = F.col("forecast") - F.col("demand")
    # a zero needs no digits read
    total = lambda x: F.sum(F.when(x == 0, F.lit(0).cast("decimal(38,8)")).otherwise(decimal(x))).cast("double")
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), total(F.col("demand")).alias("d"), total(F.abs(error)).alias("a"),
        total(error).alias("e"), total(error * error).alias("q"),
        total(F.try_divide(F.abs(error), F.abs(F.col("demand")))).alias("p"),
        count_if(F.col("demand") != 0).alias("m"),
    ).select(
        *by, F.col("n").alias("points"), F.round(ratio("a", "d"), 6).alias("wape"), F.round(ratio("p", "m"), 6).alias("mape"),
        F.round(ratio("e", "d"), 6).alias("bias"), F.round(F.sqrt(ratio("q", "n")), 6).alias("rmse"),
    )


def transportation_cost(shipments: DataFrame, dimensions: list[str]) -> DataFrame:
    """Freight total, per kg, per km and per m³, rolled up over the dimensions."""
    measures = {"freight_sek": "freight_cost_sek", "weight_kg": "total_weight_kg", "distance_km": "distance_km", "volume_m3": "total_volume_m3"}
    fine = shipments.groupBy(*dimensions).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(decimal(c)).alias(n) for n, c in measures.items()]
    )
    rolled = fine.rollup(*dimensions).agg(
        F.grouping_id().cast("int").alias("grouping_level"), F.sum("n").alias("shipments"),
        *[F.sum(n).cast("double").alias(n) for n in measures],
    )
    return rolled.withColumns({
        f"sek_per_{unit}": ratio("freight_sek", column)
        for unit, column in (("kg", "weight_kg"), ("km", "distance_km"), ("m3", "volume_m3"))
    })


def warehouse_utilization(balances: DataFrame, products: DataFrame, locations: DataFrame, movements: DataFrame) -> DataFrame:
    """Per location: stored volume ÷ storage capacity, and daily handling ÷ handling capacity (mean and peak day)."""
    current = newest(balances.select("product_id", "location_id", "on_hand_quantity", "as_of_timestamp", "id"),
                     ["product_id", "location_id"], ["as_of_timestamp", "id"])
    sizes = products.select(F.col("id").alias("product_id"), number("volume_m3").alias("volume_m3"))
    stored = current.join(sizes, "product_id").groupBy(F.col("location_id").alias("id")).agg(
        exact_sum(number("on_hand_quantity") * F.col("volume_m3")).alias("stored_m3")
    )
    daily = movements.groupBy(F.col("location_id").alias("id"), F.to_date("event_timestamp").alias("day")).agg(
        exact_sum(F.abs(number("quantity"))).alias("handled")
    )
    handled = daily.groupBy("id").agg(
        (exact_sum("handled") / F.count(F.lit(1))).alias("mean_handled"), F.max("handled").alias("peak_handled")
    )
    return locations.join(stored, "id", "left").join(handled, "id", "left").select(
        F.col("id").alias("location_id"), F.coalesce("stored_m3", F.lit(0.0)).alias("stored_m3"),
        ratio(F.coalesce("stored_m3", F.lit(0.0)), number("storage_capacity")).alias("storage_utilization"),
        ratio("mean_handled", number("daily_handling_capacity")).alias("mean_handling_utilization"),
        ratio("peak_handled", number("daily_handling_capacity")).alias("peak_handling_utilization"),
    )


def carbon_emissions(shipments: DataFrame, factors: DataFrame) -> DataFrame:
    """Tonne-km × factor per mode and month; factors(transport_mode, kg_per_tonne_km). Modes without a factor stay, as null."""
    moved = shipments.groupBy("transport_mode", month_of("actual_departure_at").alias("month")).agg(
        F.count(F.lit(1)).alias("shipments"),
        exact_sum(number("total_weight_kg") / 1000.0 * number("distance_km"), 6).alias("tonne_km"),
    )
    return moved.join(factors, "transport_mode", "left").withColumn(
        "emissions_kg", F.col("tonne_km") * F.col("kg_per_tonne_km")
    ).drop("kg_per_tonne_km")


def supplier_reliability(orders: DataFrame, lines: DataFrame, weights: dict[str, float], done_statuses=None) -> DataFrame:
    """Per supplier: on-time share, received ÷ confirmed, rejected ÷ received, and a weighted score.

    weights: on_time, received, accepted. A supplier without a measure gets no score.
    """
    quantities = lines.groupBy(F.col("purchase_order_id").alias("id")).agg(
        *[F.sum(decimal(f"{c}_quantity")).alias(c) for c in ("confirmed", "received", "rejected")]
    )
    done = orders.filter(has_status("status", done_statuses)).select("id", "supplier_id", "actual_delivery_date", "confirmed_delivery_date")
    return done.join(quantities, "id", "left").groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("orders"),
        ratio(count_if(F.col("actual_delivery_date") <= F.col("confirmed_delivery_date")), F.count(F.lit(1))).alias("on_time_rate"),
        ratio(F.sum("received"), F.sum("confirmed")).alias("received_rate"),
        ratio(F.sum("rejected"), F.sum("received")).alias("rejected_rate"),
    ).withColumn(
        "score",
        weights["on_time"] * F.col("on_time_rate") + weights["received"] * F.least(F.col("received_rate"), F.lit(1.0))
        + weights["accepted"] * (1 - F.col("rejected_rate")),
    )


def perfect_order_rate(orders: DataFrame) -> DataFrame:
    """OTIF orders (order_delivery with movements) without delay or damage: in total and by month."""
    both = F.col("on_time") & F.col("in_full")
    undelayed = F.coalesce("worst_delay_hours", F.lit(0.0)) <= 0
    monthly = orders.groupBy(month_of("order_date").alias("order_month")).agg(
        F.count(F.lit(1)).alias("n"), count_if(both).alias("o"), count_if(both & undelayed & ~F.col("damaged")).alias("p"),
    )
    return monthly.rollup("order_month").agg(
        F.grouping_id().cast("int").alias("grouping_level"), F.sum("n").alias("orders"), F.sum("o").alias("otif_orders"),
        F.sum("p").alias("perfect_orders"), ratio(F.sum("p"), F.sum("n")).alias("perfect_order_rate"),
    )


def kpi_cube(facts: DataFrame, dimensions: list[str], numerator: str, denominator: str, approx_distinct: str | None = None) -> DataFrame:
    """Numerator, denominator and their ratio over every combination of the dimensions.

    With approx_distinct, also the estimated number of distinct values of that
    column, from sketches merged over the cube.
    """
    sketch = [F.hll_sketch_agg(approx_distinct).alias("_s")] if approx_distinct else []
    fine = facts.groupBy(*dimensions).agg(
        F.sum(decimal(numerator)).alias("_n"), F.sum(decimal(denominator)).alias("_d"), F.count(F.lit(1)).alias("_c"), *sketch
    )
    merged = [F.hll_sketch_estimate(F.hll_union_agg("_s")).alias(f"approx_{approx_distinct}")] if approx_distinct else []
    return fine.cube(*dimensions).agg(
        F.grouping_id().cast("int").alias("grouping_level"), F.sum("_c").alias("facts"),
        F.sum("_n").cast("double").alias("numerator"), F.sum("_d").cast("double").alias("denominator"), *merged,
    ).withColumn("kpi", ratio("numerator", "denominator"))


def production_yield(production_orders: DataFrame, done_statuses=None) -> DataFrame:
    """Per plant: produced ÷ planned, scrapped ÷ (produced + scrapped), mean slip of the end in hours."""
    slip = hours_between(F.col("planned_end_at"), F.col("actual_end_at"))
    return production_orders.filter(has_status("status", done_statuses)).groupBy("plant_location_id").agg(
        F.count(F.lit(1)).alias("orders"), exact_sum(number("planned_quantity")).alias("planned_quantity"),
        exact_sum(number("produced_quantity")).alias("produced_quantity"),
        exact_sum(number("scrapped_quantity")).alias("scrapped_quantity"), exact_sum(slip, 6).alias("_slip"),
    ).withColumns({
        "yield_rate": ratio("produced_quantity", "planned_quantity"),
        "scrap_rate": ratio(F.col("scrapped_quantity"), F.col("produced_quantity") + F.col("scrapped_quantity")),
        "mean_slip_hours": ratio("_slip", "orders"),
    }).drop("_slip")


def capacity_utilization(capacity: DataFrame, reasons: list[str]) -> DataFrame:
    """Per plant: actual ÷ planned units, and downtime minutes in total and per given reason."""
    minutes = number("downtime_minutes")
    return capacity.groupBy("plant_location_id").agg(
        F.count(F.lit(1)).alias("days"), exact_sum(number("actual_capacity_units")).alias("actual_units"),
        exact_sum(number("planned_capacity_units")).alias("planned_units"), exact_sum(minutes).alias("downtime_minutes"),
        *[F.coalesce(exact_sum(F.when(F.col("capacity_reason") == r, minutes)), F.lit(0.0)).alias(f"downtime_{r}") for r in reasons],
    ).withColumn("utilization", ratio("actual_units", "planned_units"))


def material_variance(consumption: DataFrame) -> DataFrame:
    """Actual minus planned consumption per production order and component."""
    return consumption.groupBy("production_order_id", "component_product_id").agg(
        exact_sum(number("planned_quantity")).alias("planned_quantity"), exact_sum(number("actual_quantity")).alias("actual_quantity"),
    ).withColumns({
        "variance": F.col("actual_quantity") - F.col("planned_quantity"),
        "variance_rate": ratio(F.col("actual_quantity") - F.col("planned_quantity"), F.col("planned_quantity")),
    })


def lead_time_variance(orders: DataFrame, lines: DataFrame, offers: DataFrame) -> DataFrame:
    """Actual purchase lead time minus contracted days per supplier and product: mean and spread.

    The contract is the offer valid on the order date; the days are whole numbers, so sums are exact.
    """
    bought = lines.select("purchase_order_id", "product_id").join(
        orders.select(F.col("id").alias("purchase_order_id"), "supplier_id", "order_date", "actual_delivery_date"), "purchase_order_id"
    )
    counted = bought.groupBy("supplier_id", "product_id", "order_date", "actual_delivery_date").agg(F.count(F.lit(1)).alias("n"))
    terms = offers.select("supplier_id", "product_id", "contracted_lead_time_days", "valid_from", "valid_to")
    priced = counted.join(terms, ["supplier_id", "product_id"]).filter(F.col("order_date").between(F.col("valid_from"), F.col("valid_to")))
    late = F.datediff("actual_delivery_date", "order_date") - F.col("contracted_lead_time_days")
    sums = priced.withColumn("late", late.cast("long")).groupBy("supplier_id", "product_id").agg(
        F.sum("n").alias("lines"), F.sum(F.col("late") * F.col("n")).alias("s"), F.sum(F.col("late") * F.col("late") * F.col("n")).alias("q"),
    )
    return sums.select(
        "supplier_id", "product_id", "lines", ratio("s", "lines").alias("mean_days_over"),
        F.round(F.sqrt(sample_variance(F.col("lines"), F.col("s"), F.col("q"))), 6).alias("spread_days"),
    )


def order_funnel(sales_lines: DataFrame, purchase_lines: DataFrame, transfer_lines: DataFrame) -> DataFrame:
    """Total quantity at each step of the three order kinds, and the drop from the step before."""
    parts = []
    for kind, df, steps in (
        ("sales", sales_lines, ["ordered", "allocated", "shipped", "delivered"]),
        ("purchase", purchase_lines, ["ordered", "confirmed", "received", "rejected"]),
        ("transfer", transfer_lines, ["requested", "shipped", "received"]),
    ):
        sums = df.agg(*[exact_sum(number(f"{s}_quantity")).alias(s) for s in steps])
        rows = [
            F.struct(
                F.lit(i + 1).alias("step_number"), F.lit(s).alias("step"), F.col(s).alias("quantity"),
                (F.col(steps[i - 1]) - F.col(s) if i else F.lit(0.0)).alias("drop_from_previous"),
            )
            for i, s in enumerate(steps)
        ]
        parts.append(sums.select(F.lit(kind).alias("kind"), F.inline(F.array(*rows))))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
