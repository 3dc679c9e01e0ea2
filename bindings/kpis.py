"""Queries for KPIs, visibility, windows, sorts and sets."""

from pyspark.sql import functions as F

from bindings.registry import query, shared
from stockflow.functions import measures
from stockflow.operators import sets, windows
from stockflow.plans import kpi, visibility


def xsum(expression: str, scale: int = 8) -> str:
    return f"cast(sum(cast({expression} as decimal(38,{scale}))) as double)"


shared("line_delivery", """
    select l.id line_id, l.sales_order_id, l.product_id, l.ordered_quantity, l.delivered_quantity, a.arrived_at,
      a.worst_delay_hours, o.customer_id, o.order_date, o.promised_delivery_date, o.priority, o.total_value_sek,
      o.assigned_warehouse_id, coalesce(cast(a.arrived_at as date) <= o.promised_delivery_date, false) on_time,
      l.delivered_quantity >= l.ordered_quantity in_full
    from sales_order_lines l join sales_orders o on o.id = l.sales_order_id
    left join (select i.sales_order_line_id line_id, max(s.actual_arrival_at) arrived_at, max(s.delay_hours) worst_delay_hours
               from shipment_items i join shipments s on s.id = i.shipment_id
               where i.sales_order_line_id is not null group by 1) a on a.line_id = l.id""")
shared("order_flags", """select sales_order_id, customer_id, order_date, priority, bool_and(on_time) on_time,
    bool_and(in_full) in_full, max(arrived_at) arrived_at, max(worst_delay_hours) worst_delay_hours
    from line_delivery group by all""")


def orders_of(t, done_statuses=None, **damage):
    return kpi.order_delivery(t.sales_order_lines, t.shipment_items, t.shipments, t.sales_orders, done_statuses, **damage)


@query("line_delivery", """select line_id, sales_order_id, arrived_at, worst_delay_hours, on_time, in_full from line_delivery""")
def _(t):
    lines = kpi.line_delivery(t.sales_order_lines, t.shipment_items, t.shipments, t.sales_orders)
    return lines.select("line_id", "sales_order_id", "arrived_at", "worst_delay_hours", "on_time", "in_full")


@query("otif", """select customer_id, order_month, cast(grouping(customer_id, order_month) as int) grouping_level,
    count(*) orders, count(*) filter (on_time) on_time_orders, count(*) filter (in_full) in_full_orders,
    count(*) filter (on_time and in_full) otif_orders, count(*) filter (on_time and in_full) / count(*) otif_rate
    from (select *, cast(date_trunc('month', order_date) as date) order_month from order_flags)
    group by grouping sets ((), (customer_id), (order_month))""")
def _(t):
    return kpi.otif(orders_of(t))


@query("fill_rate", f"""select product_id, {xsum('ordered_quantity')} ordered_quantity,
    {xsum('least(delivered_quantity, ordered_quantity)')} filled_quantity, count(*) lines,
    count(*) filter (delivered_quantity >= ordered_quantity) full_lines,
    {xsum('least(delivered_quantity, ordered_quantity)')} / {xsum('ordered_quantity')} fill_rate,
    count(*) filter (delivered_quantity >= ordered_quantity) / count(*) line_fill_rate
    from sales_order_lines group by product_id""")
def _(t):
    return kpi.fill_rate(t.sales_order_lines, ["product_id"])


KPI_SCENARIOS = [("as it was", 0, 100), ("a week later", 7, 100), ("five percent less", 0, 95), ("earlier and more", -3, 110)]


@query("kpi_scenarios", f"""with v(scenario, days, percent) as (values {', '.join(f"('{n}', {d}, {p})" for n, d, p in KPI_SCENARIOS)}),
    o as (select scenario, priority, sales_order_id,
        bool_and(coalesce(cast(arrived_at as date) + days <= promised_delivery_date, false)) on_time,
        bool_and(delivered_quantity * percent >= ordered_quantity * 100) in_full
      from line_delivery, v group by all),
    r as (select scenario, priority, count(*) orders, count(*) filter (on_time and in_full) otif_orders from o group by all),
    f as (select scenario, priority, {xsum('ordered_quantity')} ordered_quantity,
        {xsum('least(delivered_quantity * percent / 100, ordered_quantity)')} filled_quantity from line_delivery, v group by all)
    select scenario, priority, orders, otif_orders, otif_orders / orders otif_rate, ordered_quantity, filled_quantity,
      filled_quantity / ordered_quantity fill_rate from r join f using (scenario, priority)""")
def _(t):
    lines = kpi.line_delivery(t.sales_order_lines, t.shipment_items, t.shipments, t.sales_orders)
    return kpi.kpi_scenarios(lines, t.sales_order_lines, t.sales_orders, ["priority"], KPI_SCENARIOS)


shared("cogs_1996", f"""select product_id, q * unit_cost_sek cogs_sek from (
      select l.product_id, {xsum('shipped_quantity')} q from sales_order_lines l join sales_orders o on o.id = l.sales_order_id
      where order_date between date '1996-01-01' and date '1996-12-31' group by 1)
    join products p on p.id = product_id""")
shared("mean_stock", f"""select product_id, {xsum('v')} / count(*) mean_value_sek, {xsum('s')} / sum(n) stored_days_of_supply
    from (select product_id, snapshot_date, {xsum('inventory_value_sek')} v, {xsum('days_of_supply')} s, count(*) n
          from inventory_snapshots where snapshot_date between date '2024-01-01' and date '2024-01-31' group by 1, 2)
    group by 1""")


def _stock_and_cogs(t):
    cogs = kpi.cost_of_goods(t.sales_order_lines, t.sales_orders, t.products, "1996-01-01", "1996-12-31")
    return cogs, kpi.mean_stock(t.inventory_snapshots, "2024-01-01", "2024-01-31")


@query("inventory_turnover", """select m.product_id, mean_value_sek, stored_days_of_supply, coalesce(cogs_sek, 0) cogs_sek,
    coalesce(cogs_sek, 0) / nullif(mean_value_sek, 0) turnover from mean_stock m left join cogs_1996 using (product_id)""")
def _(t):
    return kpi.inventory_turnover(*_stock_and_cogs(t))


@query("days_of_inventory", """select m.product_id, mean_value_sek, stored_days_of_supply, coalesce(cogs_sek, 0) cogs_sek,
    mean_value_sek / nullif(coalesce(cogs_sek, 0) / 366, 0) days_of_inventory from mean_stock m left join cogs_1996 using (product_id)""")
def _(t):
    return kpi.days_of_inventory(*_stock_and_cogs(t), 366)


@query("order_cycle_time", """select priority, count(*) orders, sum(days) / count(*) mean_days,
    round(quantile_cont(days, 0.5), 6) median_days, round(quantile_cont(days, 0.9), 6) p90_days
    from (select priority, date_diff('day', order_date, cast(max(s.actual_arrival_at) as date)) as days
      from sales_orders o join sales_order_lines l on l.sales_order_id = o.id
      join shipment_items i on i.sales_order_line_id = l.id join shipments s on s.id = i.shipment_id
      where s.status in ('F', 'P') group by o.id, priority, order_date) group by priority""")
def _(t):
    return kpi.order_cycle_time(orders_of(t, ["F", "P"]), ["priority"])


_LANE = "origin_location_id, destination_location_id, carrier_id, transport_mode"


@query("transportation_cost", f"""select *, freight_sek / nullif(weight_kg, 0) sek_per_kg, freight_sek / nullif(distance_km, 0) sek_per_km,
    freight_sek / nullif(volume_m3, 0) sek_per_m3 from (select {_LANE}, cast(grouping({_LANE}) as int) grouping_level, count(*) shipments,
      {xsum('freight_cost_sek')} freight_sek, {xsum('total_weight_kg')} weight_kg, {xsum('distance_km')} distance_km,
      {xsum('total_volume_m3')} volume_m3 from shipments group by rollup ({_LANE}))""")
def _(t):
    return kpi.transportation_cost(t.shipments, _LANE.split(", "))


@query("warehouse_utilization", f"""
    with stored as (select location_id, {xsum('on_hand_quantity * volume_m3')} m3 from inventory_balances b join products p on p.id = b.product_id group by 1),
    handled as (select location_id, {xsum('h')} / count(*) m, max(h) p from (select location_id, cast(event_timestamp as date) d,
      {xsum('abs(quantity)')} h from inventory_movements group by 1, 2) group by 1)
    select l.id location_id, coalesce(m3, 0) stored_m3, coalesce(m3, 0) / storage_capacity storage_utilization,
      m / daily_handling_capacity mean_handling_utilization, p / daily_handling_capacity peak_handling_utilization
    from locations l left join stored s on s.location_id = l.id left join handled h on h.location_id = l.id""")
def _(t):
    return kpi.warehouse_utilization(t.inventory_balances, t.products, t.locations, t.inventory_movements)


@query("carbon_emissions", f"""select transport_mode, month, shipments, tonne_km, tonne_km * f emissions_kg from (
      select transport_mode, cast(date_trunc('month', actual_departure_at) as date) as month, count(*) shipments,
        {xsum('total_weight_kg / 1000 * distance_km', 6)} tonne_km from shipments group by 1, 2)
    left join (values ('road', 0.1), ('sea', 0.01), ('rail', 0.02)) v(m, f) on m = transport_mode""")
def _(t):
    factors = t.spark.createDataFrame([("road", 0.1), ("sea", 0.01), ("rail", 0.02)], "transport_mode string, kg_per_tonne_km double")
    return kpi.carbon_emissions(t.shipments, factors)


RELIABILITY_WEIGHTS = {"on_time": 0.5, "received": 0.25, "accepted": 0.25}
shared("supplier_scores", f"""select *, 0.5::double * on_time_rate + 0.25::double * least(received_rate, 1) + 0.25::double * (1 - rejected_rate) score from (
    select supplier_id, count(*) orders, count(*) filter (actual_delivery_date <= confirmed_delivery_date) / count(*) on_time_rate,
      {xsum('received')} / {xsum('confirmed')} received_rate, {xsum('rejected')} / {xsum('received')} rejected_rate
    from purchase_orders o left join (select purchase_order_id, {xsum('confirmed_quantity')} confirmed,
      {xsum('received_quantity')} received, {xsum('rejected_quantity')} rejected from purchase_order_lines group by 1) l
      on l.purchase_order_id = o.id group by supplier_id)""")


@query("supplier_reliability", "select * from supplier_scores")
def _(t):
    return kpi.supplier_reliability(t.purchase_orders, t.purchase_order_lines, RELIABILITY_WEIGHTS)


@query("perfect_order_rate", """
    with flags as (select d.sales_order_id, d.order_date, bool_and(on_time) and bool_and(in_full) otif,
      coalesce(max(worst_delay_hours), 0) <= 0 and bool_and(m.id is null) clean
      from line_delivery d left join (select distinct sales_order_line_id id from inventory_movements
        where reason_code in ('error', 'purchase') and sales_order_line_id is not null) m on m.id = d.line_id group by 1, 2)
    select cast(date_trunc('month', order_date) as date) order_month, cast(grouping(order_month) as int) grouping_level, count(*) orders,
      count(*) filter (otif) otif_orders, count(*) filter (otif and clean) perfect_orders,
      count(*) filter (otif and clean) / count(*) perfect_order_rate from flags group by rollup (order_month)""")
def _(t):
    return kpi.perfect_order_rate(orders_of(t, movements=t.inventory_movements, damage_reasons=["error", "purchase"]))


_CUBE = "region, product_family, transport_mode, month"


@query("kpi_cube", f"""select {_CUBE}, cast(grouping({_CUBE}) as int) grouping_level, count(*) facts, {xsum('on_time_quantity')} numerator,
    {xsum('quantity')} denominator, {xsum('on_time_quantity')} / nullif({xsum('quantity')}, 0) kpi from (
      select l.country_code region, p.product_family, s.transport_mode, cast(date_trunc('month', s.planned_arrival_at) as date) as month,
        i.quantity, case when s.delay_hours <= 0 then i.quantity else 0 end on_time_quantity
      from shipment_items i join shipments s on s.id = i.shipment_id join products p on p.id = i.product_id
      join locations l on l.id = s.destination_location_id) group by cube ({_CUBE})""")
def _(t):
    places = t.locations.selectExpr("id destination_location_id", "country_code region")
    sent = t.shipments.selectExpr(
        "id shipment_id", "destination_location_id", "transport_mode", "to_date(trunc(planned_arrival_at, 'month')) month", "delay_hours"
    ).join(places, "destination_location_id")
    families = t.products.selectExpr("id product_id", "product_family")
    facts = t.shipment_items.select("shipment_id", "product_id", "quantity").join(sent, "shipment_id").join(families, "product_id")
    on_time = F.when(F.col("delay_hours") <= 0, F.col("quantity")).otherwise(0.0)
    return kpi.kpi_cube(facts.withColumn("on_time_quantity", on_time), _CUBE.split(", "), "on_time_quantity", "quantity")


@query("production_yield", f"""select *, produced_quantity / planned_quantity yield_rate,
    scrapped_quantity / nullif(produced_quantity + scrapped_quantity, 0) scrap_rate from (
      select plant_location_id, count(*) orders, {xsum('planned_quantity')} planned_quantity, {xsum('produced_quantity')} produced_quantity,
        {xsum('scrapped_quantity')} scrapped_quantity,
        {xsum('epoch_us(actual_end_at - planned_end_at) / 1e6 / 3600', 6)} / count(*) mean_slip_hours
      from production_orders where status in ('F', 'P') group by 1)""")
def _(t):
    return kpi.production_yield(t.production_orders, ["F", "P"])


_REASONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("capacity_utilization", f"""select plant_location_id, count(*) as days, {xsum('actual_capacity_units')} actual_units,
    {xsum('planned_capacity_units')} planned_units, {xsum('downtime_minutes')} downtime_minutes,
    {', '.join(f'''coalesce({xsum(f"case when capacity_reason = '{r}' then downtime_minutes end")}, 0) "downtime_{r}"''' for r in _REASONS)},
    {xsum('actual_capacity_units')} / {xsum('planned_capacity_units')} utilization from production_capacity group by 1""")
def _(t):
    return kpi.capacity_utilization(t.production_capacity, _REASONS)


@query("material_variance", f"""select *, actual_quantity - planned_quantity variance,
    (actual_quantity - planned_quantity) / nullif(planned_quantity, 0) variance_rate from (
      select production_order_id, component_product_id, {xsum('planned_quantity')} planned_quantity,
        {xsum('actual_quantity')} actual_quantity from production_material_consumption group by 1, 2)""")
def _(t):
    return kpi.material_variance(t.production_material_consumption)





def spread(n: str, s: str, q: str) -> str:
    """Sample deviation from exact moments, as the library computes it."""
    n, s, q = (f"cast({x} as double)" for x in (n, s, q))
    return f"round(sqrt(case when {n} > 1 then greatest(0, ({n} * {q} - {s} * {s}) / ({n} * ({n} - 1))) end), 6)"


@query("lead_time_variance", """select supplier_id, product_id, count(*) lines, sum(late) / count(*) mean_days_over,
      round(stddev_samp(late), 6) spread_days from (
      select o.supplier_id, l.product_id, date_diff('day', o.order_date, o.actual_delivery_date) - s.contracted_lead_time_days late
      from purchase_order_lines l join purchase_orders o on o.id = l.purchase_order_id
      join product_suppliers s on s.product_id = l.product_id and s.supplier_id = o.supplier_id
        and o.order_date between s.valid_from and s.valid_to) group by 1, 2""")
def _(t):
    return kpi.lead_time_variance(t.purchase_orders, t.purchase_order_lines, t.product_suppliers)


def _funnel(kind, table, steps):
    return "\nunion all\n".join(
        f"""select '{kind}' kind, cast({i + 1} as int) step_number, '{s}' step, {xsum(s + '_quantity')} quantity,
            {xsum(steps[i - 1] + '_quantity') + ' - ' + xsum(s + '_quantity') if i else '0::double'} drop_from_previous from {table}"""
        for i, s in enumerate(steps)
    )


@query("order_funnel", "\nunion all\n".join([
    _funnel("sales", "sales_order_lines", ["ordered", "allocated", "shipped", "delivered"]),
    _funnel("purchase", "purchase_order_lines", ["ordered", "confirmed", "received", "rejected"]),
    _funnel("transfer", "transfer_order_lines", ["requested", "shipped", "received"]),
]))
def _(t):
    return kpi.order_funnel(t.sales_order_lines, t.purchase_order_lines, t.transfer_order_lines)


# --- visibility ----------------------------------------------------------

shared("last_events", """select * from (select *, row_number() over (partition by shipment_id
    order by event_timestamp desc, event_sequence desc, id desc) place from shipment_events) where place = 1""")


@query("shipment_position", """select e.shipment_id, e.id, event_sequence, event_type, event_timestamp, e.latitude, e.longitude,
    e.location_id, location_code, l.name location_name from last_events e left join locations l on l.id = e.location_id""")
def _(t):
    return visibility.shipment_position(t.shipment_events, t.locations)


@query("warehouse_inventory", f"""select location_id, count(*) products, {xsum('on_hand_quantity')} on_hand_quantity,
    {xsum('reserved_quantity')} reserved_quantity, {xsum('available_quantity')} available_quantity,
    {xsum('in_transit_quantity')} in_transit_quantity, {xsum('damaged_quantity')} damaged_quantity
    from (select *, row_number() over (partition by product_id, location_id order by as_of_timestamp desc, id desc) place
          from inventory_balances) where place = 1 group by 1""")
def _(t):
    return visibility.warehouse_inventory(t.inventory_balances)


shared("all_orders", """select 'sales' kind, id, order_number, status, promised_delivery_date due_date from sales_orders
    union all select 'purchase', id, purchase_order_number, status, confirmed_delivery_date from purchase_orders
    union all select 'transfer', id, transfer_number, status, required_arrival_date from transfer_orders
    union all select 'production', id, production_order_number, status, cast(planned_end_at as date) from production_orders""")


@query("order_status", "select * from all_orders")
def _(t):
    return visibility.order_status(t.sales_orders, t.purchase_orders, t.transfer_orders, t.production_orders)


@query("order_status_counts", "select kind, status, count(*) orders, min(due_date) earliest_due from all_orders group by 1, 2")
def _(t):
    return visibility.order_status_counts(
        visibility.order_status(t.sales_orders, t.purchase_orders, t.transfer_orders, t.production_orders)
    )


@query("fleet_status", f"""select carrier_id, transport_mode, count(*) filter (status = 'O') "shipments_O",
    count(*) filter (status = 'P') "shipments_P", {xsum('total_weight_kg')} weight_kg, {xsum('total_volume_m3')} volume_m3
    from shipments where status in ('O', 'P') group by 1, 2""")
def _(t):
    return visibility.fleet_status(t.shipments, ["O", "P"])


shared("stays", """select location_id, shipment_id, min(event_timestamp) first_at, max(event_timestamp) last_at
    from shipment_pings group by 1, 2""")


@query("port_congestion", """select location_id, hour, count(*) present from (
      select location_id, unnest(generate_series(date_trunc('hour', first_at), date_trunc('hour', last_at), interval 1 hour)) as hour
      from stays) group by 1, 2""")
def _(t):
    return visibility.port_congestion(t.shipment_pings)


@query("port_peaks", """with moments as (
      select location_id, date_trunc('hour', first_at) as hour, first_at as at from stays
      union select location_id, hour, hour from (select location_id,
        unnest(generate_series(date_trunc('hour', first_at) + interval 1 hour, date_trunc('hour', last_at), interval 1 hour)) as hour from stays))
    select location_id, hour, max(n) at_once from (
      select m.location_id, m.hour, m.at, count(*) n from moments m join stays s on s.location_id = m.location_id
        and m.at between s.first_at and s.last_at group by 1, 2, 3) group by 1, 2""")
def _(t):
    return visibility.port_peaks(t.shipment_pings)


@query("port_dwell", f"""select location_id, count(*) shipments, {xsum('epoch_us(last_at - first_at) / 1e6', 6)} / 3600 / count(*) mean_dwell_hours
    from stays group by 1""")
def _(t):
    return visibility.port_dwell(t.shipment_pings)


@query("delayed_orders", """select * from (
      select 'sales' kind, sales_order_id id, promised_delivery_date due_date, cast(date_diff('day', promised_delivery_date,
        case when count(arrived_at) = count(*) then cast(max(arrived_at) as date) else date '1999-06-01' end) as int) days_late, total_value_sek value_sek
      from line_delivery group by sales_order_id, promised_delivery_date, total_value_sek
      union all select 'purchase', id, confirmed_delivery_date, cast(date_diff('day', confirmed_delivery_date, actual_delivery_date) as int), total_value_sek
      from purchase_orders) where days_late > 0""")
def _(t):
    return visibility.delayed_orders(orders_of(t), t.purchase_orders, "1999-06-01")


# --- windows, sorts, sets, scalars ---------------------------------------

shared("gaps", """select id, shipment_id, event_timestamp, lag(event_timestamp) over w previous_timestamp,
    epoch_us(event_timestamp - lag(event_timestamp) over w) / 1e6 gap_seconds from shipment_pings
    window w as (partition by shipment_id order by event_timestamp, id)""")


@query("event_gaps", "select * from gaps")
def _(t):
    return windows.event_gaps(t.shipment_pings)


@query("longest_gaps", "select shipment_id, count(*) events, max(gap_seconds) longest_gap_seconds from gaps group by 1")
def _(t):
    return windows.longest_gaps(t.shipment_pings)


shared("running", """select id, product_id, location_id, event_timestamp, quantity,
    cast(sum(cast(quantity as decimal(38,8))) over (partition by product_id, location_id order by event_timestamp, id
      rows unbounded preceding) as double) running_quantity from inventory_movements""")


@query("running_stock", "select * from running")
def _(t):
    return windows.running_stock(t.inventory_movements)


@query("first_shortage", """select product_id, location_id, min(event_timestamp) filter (running_quantity < 0) first_negative_at,
    min(running_quantity) lowest_quantity from running group by 1, 2""")
def _(t):
    return windows.first_shortage(t.inventory_movements)


@query("snapshot_delta", """select id, product_id, location_id, snapshot_date, on_hand_quantity, inventory_value_sek,
    lag(snapshot_date) over w previous_date, on_hand_quantity - lag(on_hand_quantity) over w quantity_change,
    inventory_value_sek - lag(inventory_value_sek) over w value_change_sek from inventory_snapshots
    window w as (partition by product_id, location_id order by snapshot_date, id)""")
def _(t):
    return windows.snapshot_delta(t.inventory_snapshots)


@query("supplier_rank", """select product_id, supplier_id, unit_cost_sek, supplier_rank from (
    select *, cast(row_number() over (partition by product_id order by preferred desc, unit_cost_sek, contracted_lead_time_days, id) as int) supplier_rank
    from product_suppliers) where supplier_rank <= 3""")
def _(t):
    return windows.supplier_rank(t.product_suppliers, 3).select("product_id", "supplier_id", "unit_cost_sek", "supplier_rank")


shared("daily_demand", f"""select product_id, order_date as day, {xsum('ordered_quantity')} demand
    from sales_order_lines l join sales_orders o on o.id = l.sales_order_id group by 1, 2""")


def _rolling(n):
    frame = f"over (partition by product_id order by day range between interval {n - 1} day preceding and current row)"
    total = f"cast(sum(cast(demand as decimal(38,8))) {frame} as double)"
    squares = f"cast(sum(cast(demand * demand as decimal(38,8))) {frame} as double)"
    return f"{total} / {n} mean_{n}d, {spread(str(n), total, squares)} deviation_{n}d"


@query("rolling_demand", f"select product_id, day, demand, {_rolling(7)}, {_rolling(28)} from daily_demand")
def _(t):
    demand = windows.daily_demand(t.sales_order_lines, t.sales_orders, ["product_id"])
    return windows.rolling_demand(demand, ["product_id"], [7, 28])


@query("latest_version", """select external_id, selling_price_sek, updated_at from (select *, row_number() over
    (partition by external_id order by updated_at desc, id desc) place from (select * from products union all by name select * from product_feed)) where place = 1""")
def _(t):
    from bindings.integrity import _product_feed

    return windows.latest_version(t.products.unionByName(_product_feed(t))).select("external_id", "selling_price_sek", "updated_at")


@query("expiry_risk", f"""
    with lots as (select product_id, location_id, lot_number, expiry_date, {xsum('quantity')} lot_quantity from inventory_movements group by all),
    held as (select * from lots where lot_quantity > 0),
    stock as (select product_id, location_id, {xsum('lot_quantity')} stock_quantity from held group by all),
    due as (select *, cast(sum(cast(lot_quantity as decimal(38,8))) over (partition by product_id, location_id
        order by expiry_date, lot_number rows unbounded preceding) as double) at_risk_quantity
      from held where expiry_date between date '2024-02-01' and date '2024-03-02')
    select product_id, location_id, lot_number, expiry_date, lot_quantity, at_risk_quantity, stock_quantity,
      at_risk_quantity / stock_quantity share_at_risk from due join stock using (product_id, location_id)""")
def _(t):
    return windows.expiry_risk(t.inventory_movements, "2024-02-01", 30)


@query("top_delays", """select id, shipment_number, delay_hours, actual_arrival_at from shipments
    order by delay_hours desc, id limit 100""")
def _(t):
    return sets.top_delays(t.shipments, 100).select("id", "shipment_number", "delay_hours", "actual_arrival_at")


@query("location_usage", """select location_id, case when o and d then 'both' when o then 'origin' else 'destination' end usage from (
    select location_id, bool_or(origin) o, bool_or(not origin) d from (
      select origin_location_id location_id, true origin from shipments union all select destination_location_id, false from shipments) group by 1)""")
def _(t):
    return sets.location_usage(t.shipments)


@query("event_lateness", """select id, source, epoch_us(received_at - event_timestamp) / 1e6 lateness_seconds from shipment_pings""")
def _(t):
    late = measures.seconds_between(F.col("event_timestamp"), F.col("received_at"))
    return t.shipment_pings.select("id", "source", late.alias("lateness_seconds"))


@query("haversine_km", """select s.id, distance_km, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(d.latitude - o.latitude) / 2), 2)
    + cos(radians(o.latitude)) * cos(radians(d.latitude)) * pow(sin(radians(d.longitude - o.longitude) / 2), 2)))), 6) great_circle_km
    from shipments s join locations o on o.id = s.origin_location_id join locations d on d.id = s.destination_location_id""")
def _(t):
    ends = t.shipments.select("id", "distance_km", "origin_location_id", "destination_location_id")
    for end, short in (("origin", "o"), ("destination", "d")):
        ends = ends.join(t.locations.selectExpr(f"id {end}_location_id", f"latitude {short}_lat", f"longitude {short}_lon"), f"{end}_location_id")
    km = measures.haversine_km(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon"))
    return ends.select("id", "distance_km", F.round(km, 6).alias("great_circle_km"))


@query("local_time", """select e.id, event_timestamp local_time, cast(extract('hour' from event_timestamp) as int) local_hour,
    cast(extract('isodow' from event_timestamp) as int) local_weekday from shipment_pings e join locations l on l.id = e.location_id""")
def _(t):
    zones = t.locations.selectExpr("id location_id", "timezone")
    placed = t.shipment_pings.select("id", "location_id", "event_timestamp").join(zones, "location_id")
    return measures.local_time(placed, "event_timestamp", "timezone").select("id", "local_time", "local_hour", "local_weekday")
