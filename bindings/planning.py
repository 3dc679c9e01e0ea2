"""Queries for forecasts, stock policies, arrival times, routes, risk and alerts."""

from pyspark.sql import functions as F

from bindings.kpis import RELIABILITY_WEIGHTS, xsum
from bindings.registry import query, shared
from stockflow.functions.ranking import exact_percentiles
from stockflow.operators import windows
from stockflow.plans import eta, forecasting, inventory, kpi, risk

LAST_DAY = "2001-08-01"
PRODUCT = ["product_id"]

shared("product_days", f"""select c.product_id, c.day, coalesce(d.demand, 0) demand from (
      select product_id, cast(unnest(generate_series(min(day), date '{LAST_DAY}', interval 1 day)) as date) as day
      from daily_demand group by 1) c left join daily_demand d on d.product_id = c.product_id and d.day = c.day""")
shared("product_weekly", f"""select product_id, cast(date_trunc('week', day) as date) as day, {xsum('demand')} demand from daily_demand group by 1, 2""")


def product_demand(t):
    return windows.daily_demand(t.sales_order_lines, t.sales_orders, PRODUCT)


def product_series(t, unit="day"):
    return forecasting.demand_series(product_demand(t), PRODUCT, unit, LAST_DAY)


@query("demand_series", "select * from product_days")
def _(t):
    return product_series(t)


@query("demand_series_weekly", """select c.product_id, c.day, coalesce(d.demand, 0) demand from (
      select product_id, cast(unnest(generate_series(min(day), max(day), interval 7 day)) as date) as day
      from product_weekly group by 1) c left join product_weekly d on d.product_id = c.product_id and d.day = c.day""")
def _(t):
    return forecasting.demand_series(product_demand(t), ["product_id"], "week")


def _mean_before(n):
    frame = f"over (partition by product_id order by day rows between {n} preceding and 1 preceding)"
    return f"case when count(*) {frame} = {n} then cast(sum(cast(demand as decimal(38,8))) {frame} as double) / {n} end mean_{n}"


@query("demand_features", f"""select *, lag(demand, 1) over w lag_1, lag(demand, 7) over w lag_7, lag(demand, 28) over w lag_28,
    {_mean_before(7)}, {_mean_before(28)}, cast(extract('isodow' from day) as int) weekday
    from product_days window w as (partition by product_id order by day)""")
def _(t):
    return forecasting.demand_features(product_series(t), PRODUCT)


def _naive_sql(source, keys, season, window, horizon):
    return f"""
      select {keys}, cast(step as int) step, cast(last_day + cast(step as int) as date) as day,
        max(demand) filter (back = {season} - (step - 1) % {season}) seasonal_naive,
        cast(sum(cast(demand as decimal(38,8))) filter (back <= {window}) as double) / count(*) filter (back <= {window}) moving_average
      from (select *, max(day) over (partition by {keys}) last_day, row_number() over (partition by {keys} order by day desc) back from {source}) tail,
        (select unnest(range(1, {horizon} + 1)) step) steps
      where back <= {max(season, window)} group by {keys}, step, last_day"""


@query("naive_forecast", _naive_sql("product_days", "product_id", 7, 28, 28))
def _(t):
    return forecasting.naive_forecast(product_series(t), PRODUCT, season=7, window=28, horizon=28)


ORIGINS = ["2000-12-31", "2001-03-31", "2001-06-30"]


def _accuracy_sql(pairs, by):
    return f"""select {by}, count(*) points, round({xsum('abs(forecast - demand)', 8)} / nullif({xsum('demand')}, 0), 6) wape,
      round({xsum('abs(forecast - demand) / nullif(demand, 0)', 8)} / count(*) filter (demand <> 0), 6) mape,
      round({xsum('forecast - demand', 8)} / nullif({xsum('demand')}, 0), 6) bias,
      round(sqrt({xsum('(forecast - demand) * (forecast - demand)', 8)} / count(*)), 6) rmse from ({pairs}) group by {by}"""


shared("origin_days", f"""select f.*, origin from product_days f join (select unnest([{', '.join(f"date '{o}'" for o in ORIGINS)}]) origin) on day <= origin""")
shared("origin_naive", _naive_sql("origin_days", "product_id, origin", 7, 28, 28))
_PAIRS = """select n.product_id, n.origin, n.model, n.forecast, coalesce(d.demand, 0) demand from (
      select product_id, origin, day, 'seasonal_naive' model, seasonal_naive forecast from origin_naive
      union all select product_id, origin, day, 'moving_average', moving_average from origin_naive) n
    left join product_days d on d.product_id = n.product_id and d.day = n.day where n.forecast is not null"""


@query("backtest", _accuracy_sql(_PAIRS, "origin, model"))
def _(t):
    return forecasting.backtest(product_series(t), PRODUCT, ORIGINS, season=7, window=28, horizon=28)


@query("forecast_accuracy", _accuracy_sql(_PAIRS, "product_id, model"))
def _(t):
    series = product_series(t)
    known = forecasting.until_origins(series, ORIGINS, 28)
    forecast = forecasting.naive_forecast(known, [*PRODUCT, "origin"], season=7, window=28, horizon=28)
    rows = forecasting.long_forecast(forecast, [*PRODUCT, "origin"], ["seasonal_naive", "moving_average"])
    return kpi.forecast_accuracy(rows, series, [*PRODUCT, "day"], [*PRODUCT, "model"])


@query("holt_winters")
def _(t):
    weekly = forecasting.demand_series(product_demand(t), ["product_id"], "week", LAST_DAY)
    return forecasting.holt_winters(weekly, ["product_id"], season=4, horizon=8, step_days=7)


@query("gbt_forecast")
def _(t):
    return forecasting.gbt_forecast(product_series(t), PRODUCT, "2001-06-30", horizon=28, history_days=182)[0]


@query("backtest_learned")
def _(t):
    """The same origins and horizon as `backtest`, for the models without a SQL form."""
    return forecasting.backtest_fitted(product_series(t), PRODUCT, ORIGINS, {
        "holt_winters": lambda known, keys, origin: forecasting.holt_winters(known, keys, season=7, horizon=28),
        "gbt": lambda known, keys, origin: forecasting.gbt_forecast(known, keys, origin, horizon=28, rounds=10, history_days=182)[0],
    })


# --- inventory -----------------------------------------------------------

START, END, DAYS = "1995-01-01", "2001-08-01", 2405
shared("place_daily", f"""select product_id, assigned_warehouse_id location_id, order_date as day, {xsum('ordered_quantity')} demand
    from sales_order_lines l join sales_orders o on o.id = l.sales_order_id group by 1, 2, 3""")
_VARIANCE = f"greatest(0, ({DAYS}::double * q - s * s) / ({DAYS}::double * ({DAYS}::double - 1)))"
shared("place_stats", f"""select product_id, location_id, s / {DAYS} demand_mean, {_VARIANCE} demand_variance from (
    select product_id, location_id, {xsum('demand')} s, {xsum('demand * demand')} q from place_daily
    where day between date '{START}' and date '{END}' group by 1, 2)""")
shared("product_stats", f"""select product_id, s / {DAYS} demand_mean from (select product_id, {xsum('demand')} s from daily_demand
    where day between date '{START}' and date '{END}' group by 1)""")
shared("lead_stats", """select product_id, s / n lead_mean, case when n > 1 then greatest(0, (n * q - s * s) / (n * (n - 1))) else 0 end lead_variance
    from (select product_id, count(*)::double n, sum(d)::double s, sum(d * d)::double q from (
      select l.product_id, date_diff('day', order_date, actual_delivery_date) d
      from purchase_order_lines l join purchase_orders o on o.id = l.purchase_order_id) group by 1)""")
shared("policy_facts", """select b.product_id, b.location_id, available_quantity, in_transit_quantity, safety_stock_quantity stored_safety_stock,
    reorder_point_quantity stored_reorder_point, coalesce(demand_mean, 0) demand_mean, coalesce(demand_variance, 0) demand_variance,
    coalesce(lead_mean, 0) lead_mean, coalesce(lead_variance, 0) lead_variance
    from inventory_balances b left join place_stats d on d.product_id = b.product_id and d.location_id = b.location_id
    left join lead_stats l on l.product_id = b.product_id""")
_SAFETY = "sqrt(lead_mean * demand_variance + demand_mean * demand_mean * lead_variance)"


def policy(t):
    demand = windows.daily_demand(
        t.sales_order_lines, t.sales_orders.withColumnRenamed("assigned_warehouse_id", "location_id"), ["product_id", "location_id"]
    )
    stats = inventory.demand_stats(demand, ["product_id", "location_id"], START, END)
    leads = inventory.lead_time_stats(t.purchase_orders, t.purchase_order_lines)
    return inventory.stock_policy(t.inventory_balances, stats, leads, 1.65)


@query("safety_stock", f"""select product_id, location_id, demand_mean, lead_mean, round(1.65::double * {_SAFETY}, 6) safety_stock,
    stored_safety_stock, round(1.65::double * {_SAFETY}, 6) - stored_safety_stock above_stored from policy_facts""")
def _(t):
    return policy(t).select(
        "product_id", "location_id", "demand_mean", "lead_mean", "safety_stock", "stored_safety_stock",
        (F.col("safety_stock") - F.col("stored_safety_stock")).alias("above_stored"),
    )


@query("reorder_point", f"""select product_id, location_id, round(demand_mean * lead_mean + 1.65::double * {_SAFETY}, 6) reorder_point,
    stored_reorder_point, available_quantity from policy_facts""")
def _(t):
    return policy(t).select("product_id", "location_id", "reorder_point", "stored_reorder_point", "available_quantity")


SCENARIOS = [("base", 1.0, 0.0, 1.65), ("demand +20%", 1.2, 0.0, 1.65), ("slow supply", 1.0, 7.0, 1.65), ("high service", 1.0, 0.0, 2.33)]


@query("what_if", f"""select scenario, product_id, location_id, round(z * sqrt(lead * variance + mean * mean * lead_variance), 6) safety_stock,
    round(mean * lead + z * sqrt(lead * variance + mean * mean * lead_variance), 6) reorder_point from (
      select scenario, product_id, location_id, z, demand_mean * factor mean, lead_mean + added lead,
        demand_variance * factor * factor variance, lead_variance from policy_facts,
        (values {', '.join(f"('{n}', {f}::double, {a}::double, {z}::double)" for n, f, a, z in SCENARIOS)}) v(scenario, factor, added, z))""")
def _(t):
    return inventory.what_if(policy(t), SCENARIOS)


shared("best_offers", """select product_id, supplier_id, unit_cost_sek, minimum_order_quantity,
    supplier_capacity_per_day * contracted_lead_time_days supplier_limit from (select *, row_number() over
      (partition by product_id order by preferred desc, unit_cost_sek, contracted_lead_time_days, id) place from product_suppliers) where place = 1""")
shared("order_quantities", """select product_id, supplier_id, demand_mean * 365 annual_demand,
    round(sqrt(2 * (demand_mean * 365) * 500 / (0.2::double * unit_cost_sek)), 6) eoq, minimum_order_quantity, supplier_limit,
    round(least(greatest(sqrt(2 * (demand_mean * 365) * 500 / (0.2::double * unit_cost_sek)), minimum_order_quantity), supplier_limit), 6) order_quantity
    from best_offers join product_stats using (product_id)""")


def quantities(t):
    stats = inventory.demand_stats(product_demand(t), ["product_id"], START, END)
    return inventory.eoq(t.product_suppliers, stats, order_cost=500.0, holding_rate=0.2)


@query("eoq", "select * from order_quantities")
def _(t):
    return quantities(t)


@query("service_level", f"""select product_id, stock_days, days_available, availability, fill_rate from (
      select product_id, count(*) stock_days, count(*) filter (available_quantity > 0) days_available,
        count(*) filter (available_quantity > 0) / count(*) availability from inventory_snapshots group by 1) s
    full join (select product_id, {xsum('least(delivered_quantity, ordered_quantity)')} / {xsum('ordered_quantity')} fill_rate
      from sales_order_lines group by 1) f using (product_id)""")
def _(t):
    return inventory.service_level(t.inventory_snapshots, t.sales_order_lines)


@query("reorder_list", """select b.product_id, location_id, available_quantity + in_transit_quantity covered_quantity, reorder_point_quantity,
    supplier_id, order_quantity from inventory_balances b left join order_quantities q on q.product_id = b.product_id
    where available_quantity + in_transit_quantity < reorder_point_quantity""")
def _(t):
    return inventory.reorder_list(t.inventory_balances, quantities(t))


@query("transfer_list", """
    with spare as (select product_id, location_id, cast(available_quantity as decimal(38,8)) - cast(reorder_point_quantity as decimal(38,8)) a from inventory_balances),
    s as (select product_id, location_id, sum(a) over w - a lo, sum(a) over w hi from spare where a > 0
      window w as (partition by product_id order by a desc, location_id rows unbounded preceding)),
    d as (select product_id, location_id, sum(-a) over w + a lo, sum(-a) over w hi from spare where a < 0
      window w as (partition by product_id order by -a desc, location_id rows unbounded preceding))
    select s.product_id, s.location_id from_location_id, d.location_id to_location_id,
      cast(least(s.hi, d.hi) - greatest(s.lo, d.lo) as double) quantity
    from s join d on d.product_id = s.product_id and s.lo < d.hi and d.lo < s.hi""")
def _(t):
    return inventory.transfer_list(t.inventory_balances)


# --- arrival times and routes --------------------------------------------

_SERVICE = "origin_location_id, destination_location_id, transport_mode, carrier_id"
shared("trips", """select *, epoch_us(actual_arrival_at - actual_departure_at) / 1e6 as seconds from shipments""")


def _times(keys, name, trips="trips"):
    return f"""select {keys}, count(*) {name}_n, round(quantile_cont(seconds, 0.5) / 3600, 6) {name}_p50,
      round(quantile_cont(seconds, 0.9) / 3600, 6) {name}_p90 from {trips} group by {keys}"""


def _lane_times(least, trips="trips"):
    return f"""select {_SERVICE}, service_n trips, case when service_n >= {least} then 'service' when lane_n >= {least} then 'lane' else 'mode' end basis,
    case when service_n >= {least} then service_p50 when lane_n >= {least} then lane_p50 else mode_p50 end p50_hours,
    case when service_n >= {least} then service_p90 when lane_n >= {least} then lane_p90 else mode_p90 end p90_hours
    from ({_times(_SERVICE, 'service', trips)}) join ({_times('origin_location_id, destination_location_id', 'lane', trips)})
      using (origin_location_id, destination_location_id) join ({_times('transport_mode', 'mode', trips)}) using (transport_mode)"""


@query("lane_times", _lane_times(5))
def _(t):
    return eta.lane_times(t.shipments)


# every second shipment goes with a carrier of its own, so that services and lanes fall short of the least number of trips
_MIXED = "case when cast(substr(id, 2) as bigint) % 2 = 0 then 'C0' else concat('C', id) end"
shared("mixed_trips", f"select * replace ({_MIXED} as carrier_id) from trips")


@query("lane_times_mixed", _lane_times(20, "mixed_trips"))
def _(t):
    return eta.lane_times(t.shipments.withColumn("carrier_id", F.expr(_MIXED)), least=20)


def _speed(keys):
    return f"""select {keys}, {xsum('distance_km')} / {xsum('epoch_us(actual_arrival_at - actual_departure_at) / 1e6 / 3600', 6)} speed
      from shipments group by {keys}"""


@query("eta_estimate", f"""
    with position as (select * from (select *, row_number() over (partition by shipment_id order by event_timestamp desc, id desc) place from shipment_pings) where place = 1),
    known as (select e.shipment_id, e.event_timestamp, s.current_eta, s.actual_arrival_at, coalesce(ls.speed, ms.speed) speed_kmh,
        2 * 6371 * asin(least(1, sqrt(pow(sin(radians(l.latitude - e.latitude) / 2), 2)
          + cos(radians(e.latitude)) * cos(radians(l.latitude)) * pow(sin(radians(l.longitude - e.longitude) / 2), 2)))) km
      from position e join shipments s on s.id = e.shipment_id join locations l on l.id = s.destination_location_id
      left join ({_speed('origin_location_id, destination_location_id')}) ls using (origin_location_id, destination_location_id)
      left join ({_speed('transport_mode')}) ms using (transport_mode))
    select shipment_id, event_timestamp, round(km, 6) remaining_km, speed_kmh, eta_at,
      epoch_us(eta_at - current_eta) / 1e6 / 3600 hours_after_current_eta, epoch_us(eta_at - actual_arrival_at) / 1e6 / 3600 hours_after_actual
    from (select *, event_timestamp + cast(round(km / speed_kmh * 3600) as bigint) * interval '1' second eta_at from known)""")
def _(t):
    return eta.eta_estimate(t.shipment_pings, t.shipments, t.locations)


@query("eta_gbt")
def _(t):
    return eta.eta_gbt(eta.shipment_features(t.shipments), "1999-12-31")[0]


shared("service_costs", f"""select {_SERVICE}, count(*) trips, {xsum('freight_cost_sek')} / count(*) mean_cost_sek,
    count(*) filter (delay_hours > 0) / count(*) late_rate, round(quantile_cont(seconds, 0.5) / 3600, 6) p50_hours from trips group by {_SERVICE}""")


@query("carrier_rank", """select * from (select *, cast(row_number() over (partition by origin_location_id, destination_location_id
    order by mean_cost_sek, p50_hours, late_rate, carrier_id, transport_mode) as int) carrier_rank from service_costs) where carrier_rank <= 3""")
def _(t):
    return eta.carrier_rank(t.shipments, 3)


@query("two_leg_routes", """
    with legs as (select origin_location_id o, destination_location_id d, min(mean_cost_sek) c from service_costs where origin_location_id <> destination_location_id group by 1, 2),
    routes as (select o, d, c, null via from legs union all select a.o, b.d, a.c + b.c, a.d from legs a join legs b on b.o = a.d and a.o <> b.d)
    select o origin, d destination, c cost_sek, via via_location_id from (select *, row_number() over
      (partition by o, d order by c, via is not null, via) place from routes) where place = 1""")
def _(t):
    return eta.two_leg_routes(t.shipments)


# a third of the lanes cost ten times as much, so that two legs win on some
_DEAR = """freight_cost_sek * case when (ascii(right(origin_location_id, 1)) + ascii(right(destination_location_id, 1))) % 3 = 0
    then 10 else 1 end"""


@query("two_leg_routes_dear", f"""
    with costs as (select {_SERVICE}, {xsum(_DEAR)} / count(*) mean_cost_sek from shipments group by {_SERVICE}),
    legs as (select origin_location_id o, destination_location_id d, min(mean_cost_sek) c from costs where origin_location_id <> destination_location_id group by 1, 2),
    routes as (select o, d, c, null via from legs union all select a.o, b.d, a.c + b.c, a.d from legs a join legs b on b.o = a.d and a.o <> b.d)
    select o origin, d destination, c cost_sek, via via_location_id from (select *, row_number() over
      (partition by o, d order by c, via is not null, via) place from routes) where place = 1""")
def _(t):
    return eta.two_leg_routes(t.shipments.withColumn("freight_cost_sek", F.expr(_DEAR)))


# --- risk ----------------------------------------------------------------

RISK_WEIGHTS = {"late": 0.4, "rejected": 0.2, "single": 0.2, "tier": 0.1, "cover": 0.1}


@query("risk_rules", """
    with pairs as (select distinct product_id, supplier_id from product_suppliers),
    sources as (select product_id, count(*) n from pairs group by 1),
    short as (select product_id, bool_or(available_quantity + in_transit_quantity < reorder_point_quantity) short from inventory_balances group by 1),
    exposure as (select supplier_id, count(*) filter (n = 1) / count(*) single_rate, count(*) filter (short) / count(*) short_rate
      from pairs join sources using (product_id) left join short using (product_id) group by 1),
    scored as (select o.id supplier_id, case when risk_tier = 'high' then 1::double else 0::double end tier_flag, coalesce(on_time_rate, 1) on_time_rate,
        coalesce(rejected_rate, 0) rejected_rate, coalesce(single_rate, 0) single_rate, coalesce(short_rate, 0) short_rate
      from organizations o left join supplier_scores s on s.supplier_id = o.id left join exposure e on e.supplier_id = o.id
      where organization_type = 'supplier'),
    points as (select *, 0.4::double * (1 - on_time_rate) + 0.2::double * rejected_rate + 0.2::double * single_rate + 0.1::double * tier_flag
      + 0.1::double * short_rate risk_points from scored)
    select *, cast(ntile(5) over (order by risk_points, md5(supplier_id), supplier_id) as int) risk_quintile from points""")
def _(t):
    reliability = kpi.supplier_reliability(t.purchase_orders, t.purchase_order_lines, RELIABILITY_WEIGHTS)
    suppliers = t.organizations.filter("organization_type = 'supplier'")
    return risk.risk_rules(suppliers, reliability, t.product_suppliers, t.inventory_balances, RISK_WEIGHTS, ["high"])


_ANOMALIES = """select id, transport_mode, freight_cost_sek, median, mad, abs(freight_cost_sek - median) deviation from shipments
    join (select transport_mode, quantile_cont(freight_cost_sek, 0.5) median from shipments group by 1) using (transport_mode)
    join (select transport_mode, quantile_cont(abs(freight_cost_sek - median), 0.5) mad from shipments
          join (select transport_mode, quantile_cont(freight_cost_sek, 0.5) median from shipments group by 1) using (transport_mode) group by 1)
      using (transport_mode)"""
shared("freight_anomalies", f"select * from ({_ANOMALIES}) where deviation > 1.9::double * mad")


def freight_anomalies(t):
    return risk.robust_anomalies(t.shipments, ["transport_mode"], "freight_cost_sek", 1.9)


@query("robust_anomalies", """select id, transport_mode, freight_cost_sek, round(median, 6) median, round(mad, 6) mad,
    round(deviation, 6) deviation from freight_anomalies""")
def _(t):
    return freight_anomalies(t).select(
        "id", "transport_mode", "freight_cost_sek", *[F.round(c, 6).alias(c) for c in ("median", "mad", "deviation")]
    )


@query("exact_percentiles", """select transport_mode, carrier_id, round(quantile_cont(freight_cost_sek, 0.1), 6) p10,
    round(quantile_cont(freight_cost_sek, 0.5), 6) p50, round(quantile_cont(freight_cost_sek, 0.99), 6) p99 from shipments group by 1, 2""")
def _(t):
    found = exact_percentiles(t.shipments, ["transport_mode", "carrier_id"], "freight_cost_sek", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return found.select("transport_mode", "carrier_id", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")])


@query("customer_segments", f"""select *, cast(ntile(5) over (order by -recency_days, md5(customer_id), customer_id) as int) recency_quintile,
    cast(ntile(5) over (order by orders, md5(customer_id), customer_id) as int) frequency_quintile,
    cast(ntile(5) over (order by value_sek, md5(customer_id), customer_id) as int) value_quintile from (
      select customer_id, cast(date_diff('day', max(order_date), date '2001-08-01') as int) recency_days, count(*) orders,
        {xsum('total_value_sek')} value_sek from sales_orders where order_date <= date '2001-08-01' group by 1)""")
def _(t):
    return risk.customer_segments(t.sales_orders, "2001-08-01")


_CAUSES = ["transport_mode", "carrier_id", "origin_location_id", "destination_location_id"]


def _cause(d):
    return f"""select '{d}' dimension, {d} value,
      coalesce({xsum("case when year(actual_departure_at) = 1996 then freight_cost_sek end")}, 0) "before",
      coalesce({xsum("case when year(actual_departure_at) = 1997 then freight_cost_sek end")}, 0) "after"
      from shipments where year(actual_departure_at) in (1996, 1997) group by {d}"""


@query("root_cause", f"""
    with split as ({' union all '.join(_cause(d) for d in _CAUSES)}),
    changes as (select *, "after" - "before" change from split),
    totals as (select dimension, {xsum('change')} total from changes group by 1)
    select dimension, value, "before", "after", change, cause_rank, change / total share_of_change from (select *,
      cast(row_number() over (partition by dimension order by abs(change) desc, value) as int) cause_rank from changes)
    join totals using (dimension) where cause_rank <= 5""")
def _(t):
    facts = t.shipments.select("freight_cost_sek", F.to_date("actual_departure_at").alias("day"), *_CAUSES)
    return risk.root_cause(
        facts, "day", "freight_cost_sek", _CAUSES, ("1996-01-01", "1996-12-31"), ("1997-01-01", "1997-12-31"), 5
    )


@query("alerts", f"""
    with aboard as (select shipment_id, s.delay_hours, product_id, {xsum('quantity')} q from shipment_items i join shipments s on s.id = i.shipment_id
      where s.delay_hours > 48 group by 1, 2, 3),
    lots as (select product_id, location_id, lot_number, expiry_date, {xsum('quantity')} lot_quantity from inventory_movements group by all),
    all_alerts as (
      select 'late shipment' kind, shipment_id "key", delay_hours measure, {xsum('q * selling_price_sek')} impact_sek
        from aboard join products p on p.id = product_id group by shipment_id, delay_hours
      union all select 'low stock', concat(product_id, '@', location_id), reorder_point_quantity - available_quantity,
        (reorder_point_quantity - available_quantity) * selling_price_sek from inventory_balances b join products p on p.id = b.product_id
        where reorder_point_quantity > available_quantity
      union all select 'expiry', concat(product_id, '@', location_id, '@', lot_number, '@', expiry_date), lot_quantity, lot_quantity * unit_cost_sek
        from lots join products p on p.id = product_id where lot_quantity > 0 and expiry_date between date '2024-02-01' and date '2024-03-02'
      union all select 'freight anomaly', id, freight_cost_sek, round(deviation, 4) from freight_anomalies)
    select * from all_alerts order by impact_sek desc, kind, "key" limit 5000""")
def _(t):
    return risk.alerts([
        risk.late_shipment_alerts(t.shipments, t.shipment_items, t.products, 48.0),
        risk.low_stock_alerts(t.inventory_balances, t.products),
        risk.expiry_alerts(windows.expiry_risk(t.inventory_movements, "2024-02-01", 30), t.products),
        risk.cost_anomaly_alerts(freight_anomalies(t)),
    ], 5000)
