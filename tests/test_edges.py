"""The hand-made cases the given tables do not hold."""

import math
import statistics
from datetime import date, datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockflow import schema
from stockflow.functions.exact import decimal, sample_variance, square
from stockflow.functions.measures import haversine_km, local_time
from stockflow.operators import joins, projections, quality, windows
from stockflow.plans import eta, inventory, kpi, risk


def test_nulls_are_reported_only_for_required_columns(spark):
    df = spark.createDataFrame([(None,) * 12, ("a",) + (None,) * 11], ", ".join(f"{c} string" for c in schema.columns("shipment_items")))
    got = {r.column_name: r.null_count for r in quality.not_null_violations({"shipment_items": df}).collect()}
    assert got["id"] == 1 and got["quantity"] == 2
    assert "sales_order_line_id" not in got and len(got) == 9


def test_null_references_resolve_to_nothing(spark):
    df = spark.createDataFrame(
        [("m1", "l1", None), ("m2", None, "x"), ("m3", None, None), ("m4", "gone", None)],
        "id string, sales_order_line_id string, inventory_adjustment_id string",
    )
    lines = spark.createDataFrame([("l1", "o1")], "id string, header_id string")
    got = {
        r.id: (r.source_kind, r.source_id, r.header_id)
        for r in joins.with_source(df, {"sales": "sales_order_line_id", "adjustment": "inventory_adjustment_id"}, {"sales": lines}).collect()
    }
    assert got == {"m1": ("sales", "l1", "o1"), "m2": ("adjustment", "x", None), "m3": (None, None, None), "m4": ("sales", "gone", None)}


def test_sequence_gaps(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [("a", "s", 1, t(1)), ("b", "s", 2, t(3)), ("c", "s", 2, t(4)), ("d", "s", 5, t(2)), ("e", "s", 6, t(6)), ("f", "r", 9, t(1))]
    df = spark.createDataFrame(rows, "id string, shipment_id string, event_sequence int, event_timestamp timestamp")
    got = {r.id: (r.missing, r.repeated, r.time_reversed) for r in quality.sequence_gaps(df).collect()}
    assert got == {"c": (0, True, False), "d": (2, False, True)}


def test_validity_edges(spark):
    rows = [("in", date(2024, 1, 1), date(2024, 1, 31)), ("from", date(2024, 1, 15), date(2024, 2, 1)), ("to", date(2023, 1, 1), date(2024, 1, 15)),
            ("after", date(2024, 1, 16), date(2024, 2, 1)), ("before", date(2023, 1, 1), date(2024, 1, 14))]
    df = spark.createDataFrame(rows, "id string, valid_from date, valid_to date")
    got = {r.id for r in projections.valid_on(df, "2024-01-15", "valid_from", "valid_to").collect()}
    assert got == {"in", "from", "to"}
    left = spark.createDataFrame([("x", date(2024, 1, 15))], "k string, day date")
    pairs = joins.interval_join(left, df.withColumn("k", F.lit("x")), ["k"], "day", "valid_from", "valid_to")
    assert {r.id for r in pairs.collect()} == got


def _order_tables(spark):
    """o1 without lines, o2 not shipped, o3 half shipped, o4 with two shipments."""
    day = date(2024, 1, 1)
    orders = spark.createDataFrame(
        [(o, "c", day, date(2024, 1, 10), "p", 1.0) for o in ("o1", "o2", "o3", "o4")],
        "id string, customer_id string, order_date date, promised_delivery_date date, priority string, total_value_sek double",
    )
    lines = spark.createDataFrame(
        [("l2", "o2", "p", 5.0, 5.0), ("l3a", "o3", "p", 5.0, 5.0), ("l3b", "o3", "p", 5.0, 0.0), ("l4", "o4", "p", 5.0, 5.0)],
        "id string, sales_order_id string, product_id string, ordered_quantity double, delivered_quantity double",
    )
    items = spark.createDataFrame([("s1", "l3a"), ("s1", "l4"), ("s2", "l4"), ("s2", None)], "shipment_id string, sales_order_line_id string")
    shipments = spark.createDataFrame(
        [("s1", "done", datetime(2024, 1, 5), -1.0), ("s2", "open", datetime(2024, 1, 12), 4.0)],
        "id string, status string, actual_arrival_at timestamp, delay_hours double",
    )
    return lines, items, shipments, orders


def test_otif_of_partial_orders(spark):
    tables = _order_tables(spark)
    got = {r.sales_order_id: (r.on_time, r.in_full, r.all_arrived) for r in kpi.order_delivery(*tables).collect()}
    assert got == {"o2": (False, True, False), "o3": (False, False, False), "o4": (False, True, True)}
    done = {r.sales_order_id: r.on_time for r in kpi.order_delivery(*tables, done_statuses=["done"]).collect()}
    assert done["o4"] is True
    total = kpi.otif(kpi.order_delivery(*tables, done_statuses=["done"])).filter("grouping_level = 3").first()
    assert (total.orders, total.otif_orders) == (3, 1)
    lines = {r.line_id: r.on_time for r in kpi.line_delivery(*tables).collect()}
    assert lines == {"l2": False, "l3a": True, "l3b": False, "l4": False}


def test_damage_spoils_a_perfect_order(spark):
    tables = _order_tables(spark)
    movements = spark.createDataFrame([("broken", "l4"), ("broken", None)], "reason_code string, sales_order_line_id string")
    rate = lambda reasons: kpi.perfect_order_rate(
        kpi.order_delivery(*tables, done_statuses=["done"], movements=movements, damage_reasons=reasons)
    ).filter("grouping_level = 1").first().perfect_orders
    assert rate(["broken"]) == 0 and rate(["other"]) == 1


def test_unfulfilled(spark):
    lines, items, _, orders = _order_tables(spark)
    products = spark.createDataFrame([("p",), ("q",)], "id string")
    offers = spark.createDataFrame([("p",)], "product_id string")
    got = {(r.kind, r.id) for r in joins.unfulfilled(orders, lines, items, products, offers).collect()}
    assert got == {("order without lines", "o1"), ("line without shipment", "l2"), ("line without shipment", "l3b"), ("product without supplier", "q")}


def test_zero_denominators_give_null(spark):
    lines = spark.createDataFrame([("p", 0.0, 0.0)], "product_id string, ordered_quantity double, delivered_quantity double")
    row = kpi.fill_rate(lines, ["product_id"]).first()
    assert row.fill_rate is None and row.line_fill_rate == 1.0
    stock = spark.createDataFrame([("p", 0.0, None)], "product_id string, mean_value_sek double, stored_days_of_supply double")
    cogs = spark.createDataFrame([("p", 0.0)], "product_id string, cogs_sek double")
    assert kpi.inventory_turnover(cogs, stock).first().turnover is None
    assert kpi.days_of_inventory(cogs, stock, 365).first().days_of_inventory is None
    capacity = spark.createDataFrame(
        [("a", "x", 0.0, 0.0, 1.0)],
        "plant_location_id string, capacity_reason string, planned_capacity_units double, actual_capacity_units double, downtime_minutes double",
    )
    row = kpi.capacity_utilization(capacity, ["x", "y"]).first()
    assert row.utilization is None and row.downtime_x == 1.0 and row.downtime_y == 0.0


def test_approximate_distinct_counts_in_the_cube(spark):
    facts = spark.range(2000).selectExpr("id % 2 a", "id % 3 b", "id % 500 who", "1.0 n", "2.0 d")
    rows = kpi.kpi_cube(facts, ["a", "b"], "n", "d", approx_distinct="who").collect()
    total = [r for r in rows if r.grouping_level == 3][0]
    assert total.kpi == 0.5 and abs(total.approx_who - 500) < 25 and len(rows) == 6 + 2 + 3 + 1


def test_great_circle(spark):
    df = spark.createDataFrame([(0.0, 179.5, 0.0, -179.5), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert abs(got[0] - 111.195) < 0.01 and got[1] == 0.0 and abs(got[2] - math.pi * 6371) < 1e-6


def test_local_time_over_daylight_saving(spark):
    rows = [("a", "Europe/Stockholm", datetime(2024, 3, 31, 0, 30)), ("b", "Europe/Stockholm", datetime(2024, 3, 31, 1, 30))]
    df = spark.createDataFrame(rows, "id string, timezone string, t timestamp")
    zoneless = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    for frame in (df, zoneless):
        got = {r.id: (r.local_hour, r.local_weekday) for r in local_time(frame, "t", "timezone").collect()}
        assert got == {"a": (1, 7), "b": (3, 7)}


def test_anomaly_among_equal_values(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [5] * 9 + [500]] + [("h", float(v)) for v in [1, 2, 3, 4, 100]], "g string, v double")
    got = {(r.g, r.v) for r in risk.robust_anomalies(df, ["g"], "v", 5.0).collect()}
    assert got == {("g", 500.0), ("h", 100.0)}


def test_event_gaps_and_late_records(spark):
    t = lambda d, h: datetime(2024, 1, d, h)
    df = spark.createDataFrame([("c", "s", t(3, 0)), ("a", "s", t(1, 0)), ("b", "s", t(1, 6))], "id string, shipment_id string, event_timestamp timestamp")
    got = {r.id: r.gap_seconds for r in windows.event_gaps(df).collect()}
    assert got == {"a": None, "b": 6 * 3600.0, "c": 42 * 3600.0}
    assert windows.longest_gaps(df).first().longest_gap_seconds == 42 * 3600.0


def test_delete_plan_follows_cascades(spark):
    tables = {
        "sales_orders": spark.createDataFrame([("o1",), ("o2",)], "id string"),
        "sales_order_lines": spark.createDataFrame([("l1", "o1", "p"), ("l2", "o2", "p")], "id string, sales_order_id string, product_id string"),
        "shipment_items": spark.createDataFrame([("i1", "l1")], "id string, sales_order_line_id string"),
    }
    for name in ("shipment_items",):
        for key in schema.foreign_keys():
            if key.child == name and key.column not in tables[name].columns:
                tables[name] = tables[name].withColumn(key.column, F.lit(None).cast("string"))
    plan = {(r.level, r.table_name, r.action, r.id) for r in quality.delete_plan(tables, "sales_orders", tables["sales_orders"].filter("id = 'o1'")).collect()}
    assert plan == {(1, "sales_order_lines", "CASCADE", "l1"), (2, "shipment_items", "RESTRICT", "i1")}
    left = quality.apply_delete(tables, "sales_orders", tables["sales_orders"].filter("id = 'o2'"))
    assert [r.id for r in left["sales_orders"].collect()] == ["o1"]
    assert [r.id for r in left["sales_order_lines"].collect()] == ["l1"]


def test_rekey_keeps_rows_without_reference(spark):
    items = spark.createDataFrame([("i1", "s1", "l1"), ("i2", "s1", None)], "id string, shipment_id string, sales_order_line_id string")
    mapping = spark.createDataFrame([("l1", "L1")], "old_id string, new_id string")
    for key in schema.foreign_keys("sales_order_lines"):
        assert key.parent == "sales_order_lines"
    got = {r.id: r.sales_order_line_id for r in quality.rekey({"shipment_items": items}, "sales_order_lines", mapping)["shipment_items"].collect()}
    assert got == {"i1": "L1", "i2": None}


def _balances(spark, rows):
    return spark.createDataFrame(
        [(f"{p}{loc}", p, loc, float(a), float(r), datetime(2024, 1, 1)) for p, loc, a, r in rows],
        "id string, product_id string, location_id string, available_quantity double, reorder_point_quantity double, as_of_timestamp timestamp",
    )


def test_transfers_go_from_the_largest_surplus_to_the_largest_deficit(spark):
    rows = [("p", "a", 50, 10), ("p", "b", 12, 10), ("p", "c", 0, 30), ("p", "d", 5, 9), ("q", "a", 9, 1), ("p", "e", 7, 7)]
    got = {(r.from_location_id, r.to_location_id): r.quantity for r in inventory.transfer_list(_balances(spark, rows)).collect()}
    assert got == {("a", "c"): 30.0, ("a", "d"): 4.0}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.sampled_from("pq"), st.sampled_from("abcdef")), st.integers(-9, 9), min_size=1))
def test_transfers_never_exceed_either_side(spark, spare):
    df = _balances(spark, [(p, loc, 20 + s, 20) for (p, loc), s in spare.items()])
    sent, taken, moved = {}, {}, {"p": 0, "q": 0}
    for r in inventory.transfer_list(df).collect():
        sent[r.product_id, r.from_location_id] = sent.get((r.product_id, r.from_location_id), 0) + r.quantity
        taken[r.product_id, r.to_location_id] = taken.get((r.product_id, r.to_location_id), 0) + r.quantity
        moved[r.product_id] += r.quantity
    assert all(q <= spare[k] for k, q in sent.items()) and all(q <= -spare[k] for k, q in taken.items())
    for p in "pq":
        amounts = [s for (product, _), s in spare.items() if product == p]
        assert moved[p] == min(sum(s for s in amounts if s > 0), -sum(s for s in amounts if s < 0))


def test_cheapest_route(spark):
    rows = [("a", "b", 10.0), ("b", "c", 10.0), ("a", "c", 50.0), ("c", "d", 1.0), ("a", "a", 0.0)]
    df = spark.createDataFrame(
        [(o, d, "road", "k", c) for o, d, c in rows],
        "origin_location_id string, destination_location_id string, transport_mode string, carrier_id string, freight_cost_sek double",
    )
    got = {(r.origin, r.destination): (r.cost_sek, r.via_location_id) for r in eta.two_leg_routes(df).collect()}
    assert got["a", "c"] == (20.0, "b") and got["b", "d"] == (11.0, "c") and got["a", "b"] == (10.0, None)


def test_stock_as_of_takes_the_last_snapshot_at_or_before(spark):
    movements = spark.createDataFrame(
        [(f"m{d}", "p", "l", datetime(2024, 1, d, 12)) for d in (1, 2, 3, 9)] + [("other", "q", "l", datetime(2024, 1, 5))],
        "id string, product_id string, location_id string, event_timestamp timestamp",
    )
    snapshots = spark.createDataFrame(
        [("s2", "p", "l", date(2024, 1, 2), 5.0), ("s2b", "p", "l", date(2024, 1, 2), 6.0), ("s8", "p", "l", date(2024, 1, 8), 7.0)],
        "id string, product_id string, location_id string, snapshot_date date, on_hand_quantity double",
    )
    got = {r.id: r.on_hand_quantity for r in joins.stock_as_of(movements, snapshots).collect()}
    assert got == {"m1": None, "m2": 6.0, "m3": 6.0, "m9": 7.0, "other": None}


def test_variance_of_large_values_that_lie_close_together(spark):
    def variance(values):
        frame = spark.createDataFrame([(float(v),) for v in values], "x double")
        sums = frame.agg(F.count("x").alias("n"), F.sum(decimal("x")).alias("s"), F.sum(square("x")).alias("q"))
        return sums.select(sample_variance(F.col("n"), F.col("s"), F.col("q"))).first()[0]

    for middle in (0.0, 0.25, 1e8, -1e8, 3e10):
        values = [middle + (1 if i % 2 else -1) for i in range(2405)]
        assert math.isclose(variance(values), statistics.variance(v - middle for v in values), rel_tol=1e-9), middle
    assert variance([1e14, 3e14]) == 2e28 and variance([]) is None and variance([5]) is None and variance([7, 7]) == 0
