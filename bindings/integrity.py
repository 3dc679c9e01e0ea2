"""Queries for sources, projections, data quality and joins."""

from pyspark.sql import functions as F

from bindings.registry import query, shared
from stockflow import schema
from stockflow.operators import bom, joins, projections, quality
from stockflow.session import shared_folder
from stockflow.sources import tables

# --- sources -------------------------------------------------------------

_OFFER_COLUMNS = ",".join(schema.columns("product_suppliers"))


@query("list_product_suppliers", f"select {_OFFER_COLUMNS} from product_suppliers order by id")
def _(t):
    return tables.list_product_suppliers(t.product_suppliers)


@query("rows_as_json", f"select {_OFFER_COLUMNS}, '{_OFFER_COLUMNS}' json_keys from product_suppliers")
def _(t):
    # every value read back from the text
    rows = tables.rows_as_json(t.product_suppliers)
    return rows.select(F.from_json("row", t.product_suppliers.schema).alias("r"), F.array_join(F.json_object_keys("row"), ",").alias("json_keys")).select(
        "r.*", "json_keys"
    )


# the second batch brings the later days again, with twice the quantity
@query("lake_write", """select id, event_timestamp, case when event_timestamp >= date '2024-01-10' then quantity * 2 else quantity end quantity,
    cast(event_timestamp as date) event_date from inventory_movements""")
def _(t):
    folder = shared_folder(t.spark, "lake")
    moved = t.inventory_movements.select("id", "event_timestamp", "quantity")
    tables.lake_write(moved, folder, "event_timestamp")
    tables.lake_write(
        moved.filter("event_timestamp >= date '2024-01-10'").withColumn("quantity", F.col("quantity") * 2), folder, "event_timestamp"
    )
    return t.spark.read.schema("id string, event_timestamp timestamp_ntz, quantity double, event_date date").parquet(folder)


@query("load_tables", "\nunion all\n".join(
    f"select '{n}' table_name, count(*) row_count from {n}" for n in schema.table_names()
))
def _(t):
    return tables.table_counts(t.all())


# the feed: every product again, some records newer and some older, at twice the price
shared("product_feed", """select * replace (selling_price_sek*2 as selling_price_sek,
    updated_at + (cast(shelf_life_days as bigint)/10 - 25) * interval '1' day + interval '12' hour as updated_at) from products""")


def _product_feed(t):
    moved = F.expr("updated_at + (cast(shelf_life_days as bigint)/10 - 25) * interval '1' day + interval '12' hour")
    return t.products.withColumns({"selling_price_sek": F.col("selling_price_sek") * 2, "updated_at": moved})


@query("ingest_upsert", """select source_system, external_id, id, selling_price_sek, updated_at from (
    select *, row_number() over (partition by source_system, external_id order by updated_at desc, id desc) place
    from (select * from products union all by name select * from product_feed))
    where place = 1""")
def _(t):
    return tables.ingest_upsert(t.products, _product_feed(t)).select(
        "source_system", "external_id", "id", "selling_price_sek", "updated_at"
    )


# --- projections ---------------------------------------------------------


@query("active_only", "select id, sku, active from products where active = 1")
def _(t):
    return projections.active_only(t.products).select("id", "sku", "active")


@query("valid_on", """select id, product_id, supplier_id, valid_from, valid_to from product_suppliers
    where date '1998-01-01' between valid_from and valid_to""")
def _(t):
    return projections.valid_on(t.product_suppliers, "1998-01-01", "valid_from", "valid_to").select(
        "id", "product_id", "supplier_id", "valid_from", "valid_to"
    )


@query("role_view", "select id, name, risk_tier from organizations where organization_type = 'supplier'")
def _(t):
    return projections.role_view(t.organizations, "supplier").select("id", "name", "risk_tier")


@query("derived_measures", """select l.id, l.product_id, ordered_quantity * unit_price_sek line_value_sek,
    selling_price_sek - unit_cost_sek margin_sek
    from sales_order_lines l join products p on p.id = l.product_id""")
def _(t):
    margins = projections.with_margin(t.products).select(F.col("id").alias("product_id"), "margin_sek")
    return projections.with_line_value(t.sales_order_lines).join(margins, "product_id").select(
        "id", "product_id", "line_value_sek", "margin_sek"
    )


# --- data quality --------------------------------------------------------


def _null_counts(name):
    counts = ", ".join(f"cast(count(*) - count({c}) as bigint) {c}" for c in schema.required_columns(name))
    return f"select '{name}' table_name, * from (unpivot (select {counts} from {name}) on columns(*) into name column_name value null_count)"


@query("not_null_violations", "\nunion all\n".join(_null_counts(n) for n in schema.table_names()))
def _(t):
    return quality.not_null_violations(t.all())


# a feed whose rows lack a value here and there
_HOLES = {"sku": 7, "unit_cost_sek": 11, "updated_at": 13}
_HOLED = {c: f"case when cast(substr(id, 2) as bigint) % {n} = 0 then null else {c} end" for c, n in _HOLES.items()}
shared("products_with_holes", f"select * replace ({', '.join(f'{e} as {c}' for c, e in _HOLED.items())}) from products")


@query("not_null_violations_feed", _null_counts("products").replace("from products)", "from products_with_holes)"))
def _(t):
    return quality.not_null_violations({"products": t.products.withColumns({c: F.expr(e) for c, e in _HOLED.items()})})


def _duplicates(name, column, rule, source=None):
    return f"""select '{name}' table_name, '{rule}' rule, '{column}' column_name, {column} key, count(*) occurrences
        from {source or name} group by {column} having count(*) > 1 or {column} is null"""


@query("pk_duplicates", "\nunion all\n".join(
    [_duplicates(n, "id", "primary_key") for n in schema.table_names()]
    + [_duplicates("products_and_feed", "id", "primary_key",
                   "(select id from products union all select id from product_feed)")]
))
def _(t):
    return quality.pk_duplicates({**t.all(), "products_and_feed": t.products.unionByName(_product_feed(t))})


@query("unique_violations", "\nunion all\n".join(
    [_duplicates(n, c, "unique") for n in schema.table_names() for c in schema.unique_columns(n)]
    + ["""select 'sales_order_lines' table_name, 'line' rule, 'sales_order_id+line_number' column_name,
        concat(sales_order_id,'|',line_number) key, count(*) occurrences from sales_order_lines
        group by sales_order_id, line_number having count(*) > 1"""]
))
def _(t):
    lines = quality.key_duplicates([("sales_order_lines", t.sales_order_lines, ["sales_order_id", "line_number"])], "line")
    return quality.unique_violations(t.all()).unionByName(lines)


@query("fk_orphans", "\nunion all\n".join(
    f"""select '{k.parent}' parent_table, '{k.child}' table_name, '{k.column}' column_name, c.{k.column} key,
        count(*) orphan_rows from {k.child} c where c.{k.column} is not null
        and not exists (select 1 from {k.parent} p where p.id = c.{k.column}) group by c.{k.column}"""
    for k in schema.foreign_keys()
))
def _(t):
    return quality.fk_orphans(t.all())


@query("single_source_check", """select id, source_count from (select id,
    cast((sales_order_line_id is not null)::int + (purchase_order_line_id is not null)::int
       + (production_order_id is not null)::int + (transfer_order_line_id is not null)::int
       + (inventory_adjustment_id is not null)::int as int) source_count from inventory_movements) where source_count > 1""")
def _(t):
    return quality.single_source_check(t.inventory_movements)


@query("length_check", """select 'organizations' table_name, 'country_code' column_name, id "key", country_code "value"
      from organizations where length(country_code) > 3
    union all select 'organizations', 'default_currency', id, default_currency from organizations where length(default_currency) > 3
    union all select 'sales_orders', 'currency', id, currency from sales_orders where length(currency) > 3
    union all select 'purchase_orders', 'currency', id, currency from purchase_orders where length(currency) > 3
    union all select 'locations', 'country_code', id, city from locations where length(city) > 3""")
def _(t):
    feed = t.locations.withColumn("country_code", F.col("city"))  # a feed that sends names for codes
    return quality.length_check({
        "organizations": t.organizations, "locations": feed, "sales_orders": t.sales_orders,
        "purchase_orders": t.purchase_orders,
    })


_KNOWN_LABELS = [
    ("locations", "location_type", v) for v in ("warehouse", "plant", "port")
] + [("shipments", "transport_mode", v) for v in ("road", "sea", "air")] + [
    ("sales_orders", "status", v) for v in ("F", "O", "P")
]
_LABELS = ", ".join(f"('{a}','{b}','{c}')" for a, b, c in _KNOWN_LABELS)
_PROFILES = "\nunion all\n".join(
    f"select '{n}' table_name, '{c}' column_name, {c} value, count(*) row_count from {n} group by {c}"
    for n in schema.table_names() for c in schema.enum_columns(n)
)


@query("enum_profile", f"""select p.table_name, p.column_name, p.value, p.row_count, l.value is not null known
    from ({_PROFILES}) p left join (values {_LABELS}) l(table_name, column_name, value)
      on l.table_name = p.table_name and l.column_name = p.column_name and l.value = p.value""")
def _(t):
    labels = t.spark.createDataFrame(_KNOWN_LABELS, "table_name string, column_name string, value string")
    return quality.enum_profile(t.all(), labels)


@query("delete_plan", """with doomed as (select id from sales_orders where currency is null),
    doomed_lines as (select id from sales_order_lines where sales_order_id in (select id from doomed))
    select cast(1 as int) level, 'sales_order_lines' table_name, 'sales_order_id' column_name, 'CASCADE' action, id from doomed_lines
    union all select 2, 'shipment_items', 'sales_order_line_id', 'RESTRICT', id from shipment_items
      where sales_order_line_id in (select id from doomed_lines)
    union all select 2, 'inventory_movements', 'sales_order_line_id', 'RESTRICT', id from inventory_movements
      where sales_order_line_id in (select id from doomed_lines)""")
def _(t):
    return quality.delete_plan(t.all(), "sales_orders", t.sales_orders.filter("currency is null"))


@query("apply_delete", """select 'sales_orders' table_name, id from sales_orders where currency is not null
    union all select 'sales_order_lines', id from sales_order_lines
      where sales_order_id is null or sales_order_id not in (select id from sales_orders where currency is null)""")
def _(t):
    left = quality.apply_delete(t.all(), "sales_orders", t.sales_orders.filter("currency is null"))
    ids = lambda name: left[name].select(F.lit(name).alias("table_name"), "id")
    return ids("sales_orders").unionByName(ids("sales_order_lines"))


@query("rekey", """select s.id, coalesce(o.new_id, origin_location_id) origin_location_id,
    coalesce(d.new_id, destination_location_id) destination_location_id from shipments s
    left join (select id, concat('X', id) new_id from locations where location_type = 'port') o on o.id = origin_location_id
    left join (select id, concat('X', id) new_id from locations where location_type = 'port') d on d.id = destination_location_id""")
def _(t):
    ports = t.locations.filter("location_type = 'port'").selectExpr("id old_id", "concat('X', id) new_id")
    return quality.rekey({"shipments": t.shipments}, "locations", ports)["shipments"].select(
        "id", "origin_location_id", "destination_location_id"
    )


@query("derived_columns_check", """
    with order_sums as (select sales_order_id id,
        cast(sum(cast(ordered_quantity*unit_price_sek as decimal(38,8))) as double) s from sales_order_lines group by 1),
    purchase_sums as (select purchase_order_id id,
        cast(sum(cast(ordered_quantity*unit_cost_sek as decimal(38,8))) as double) s from purchase_order_lines group by 1),
    loads as (select shipment_id id, cast(sum(cast(quantity*weight_kg as decimal(38,8))) as double) w,
        cast(sum(cast(quantity*volume_m3 as decimal(38,8))) as double) v
        from shipment_items i join products p on p.id = i.product_id group by 1),
    pairs as (
      select 'inventory_balances' table_name, 'available = on hand - reserved' rule, id, available_quantity stored,
             on_hand_quantity - reserved_quantity computed from inventory_balances
      union all select 'shipments', 'delay = actual - planned arrival', id, delay_hours,
             epoch_us(actual_arrival_at - planned_arrival_at) / 1e6 / 3600 from shipments
      union all select 'production_capacity', 'utilization = actual / planned', id, utilization_rate,
             actual_capacity_units / planned_capacity_units from production_capacity where planned_capacity_units <> 0
      union all select 'sales_orders', 'total = sum of lines', o.id, total_value_sek, coalesce(s, 0)
             from sales_orders o left join order_sums using (id)
      union all select 'purchase_orders', 'total = sum of lines', o.id, total_value_sek, coalesce(s, 0)
             from purchase_orders o left join purchase_sums using (id)
      union all select 'shipments', 'weight = sum of items', o.id, total_weight_kg, coalesce(w, 0)
             from shipments o left join loads using (id)
      union all select 'shipments', 'volume = sum of items', o.id, total_volume_m3, coalesce(v, 0)
             from shipments o left join loads using (id))
    select * from pairs where abs(stored - computed) > 0.01""")
def _(t):
    return quality.derived_columns_check(t.all())


@query("sequence_gaps", """
    with feed as (select id, shipment_id, received_at event_timestamp,
        cast(event_sequence + case when event_type = 'error' then 1 else 0 end as int) event_sequence from shipment_events),
    pairs as (select *, lag(event_sequence) over w before_seq, lag(event_timestamp) over w before_ts from feed
        window w as (partition by shipment_id order by event_sequence, id))
    select shipment_id, id, event_sequence, greatest(event_sequence - before_seq - 1, 0) missing,
           event_sequence = before_seq repeated, event_timestamp < before_ts time_reversed
    from pairs where before_seq is not null
      and (event_sequence - before_seq > 1 or event_sequence = before_seq or event_timestamp < before_ts)""")
def _(t):
    skipped = F.col("event_sequence") + F.when(F.col("event_type") == "error", 1).otherwise(0)
    feed = t.shipment_events.withColumns({"event_sequence": skipped, "event_timestamp": F.col("received_at")})
    return quality.sequence_gaps(feed)


@query("range_order_check", "\nunion all\n".join(
    f"select '{n}' table_name, '{a} <= {b}' rule, id from {n} where {a} > {b}"
    for n, a, b in quality.ORDERED_PAIRS if n != "shipments"
) + """ union all select 'shipments', 'planned_departure_at <= planned_arrival_at', id from shipments
      where planned_departure_at > current_eta - interval '6' day
    union all select 'shipments', 'actual_departure_at <= actual_arrival_at', id from shipments
      where actual_departure_at > actual_arrival_at - interval '3' day""")
def _(t):
    feed = t.shipments.withColumns({  # a feed with shifted arrivals
        "planned_arrival_at": F.expr("current_eta - interval '6' day"),
        "actual_arrival_at": F.expr("actual_arrival_at - interval '3' day"),
    })
    return quality.range_order_check({**t.all(), "shipments": feed})


@query("item_source_check", """
    with feed as (select * replace (case when quantity > 40 then 'purchase_order' else source_document_type end as source_document_type) from shipment_items),
    judged as (select id, source_document_type, case
      when (sales_order_line_id is not null)::int + (purchase_order_line_id is not null)::int + (transfer_order_line_id is not null)::int > 1
        then 'several references'
      when sales_order_line_id is null and purchase_order_line_id is null and transfer_order_line_id is null then 'no reference'
      when (source_document_type = 'sales_order' and sales_order_line_id is not null)
        or (source_document_type = 'purchase_order' and purchase_order_line_id is not null)
        or (source_document_type = 'transfer_order' and transfer_order_line_id is not null) then null
      else 'reference does not fit type' end problem from feed)
    select * from judged where problem is not null""")
def _(t):
    mislabelled = F.when(F.col("quantity") > 40, "purchase_order").otherwise(F.col("source_document_type"))
    return quality.item_source_check(t.shipment_items.withColumn("source_document_type", mislabelled), {
        "sales_order": "sales_order_line_id", "purchase_order": "purchase_order_line_id",
        "transfer_order": "transfer_order_line_id",
    })


# --- joins ---------------------------------------------------------------


@query("order_lines", """select 'sales' kind, o.id order_id, l.id line_id, o.status order_status, product_id, ordered_quantity quantity
      from sales_orders o join sales_order_lines l on l.sales_order_id = o.id
    union all select 'purchase', o.id, l.id, o.status, product_id, ordered_quantity
      from purchase_orders o join purchase_order_lines l on l.purchase_order_id = o.id
    union all select 'transfer', o.id, l.id, o.status, product_id, requested_quantity
      from transfer_orders o join transfer_order_lines l on l.transfer_order_id = o.id""")
def _(t):
    parts = []
    for kind, headers, lines, quantity in (
        ("sales", t.sales_orders, t.sales_order_lines, "ordered_quantity"),
        ("purchase", t.purchase_orders, t.purchase_order_lines, "ordered_quantity"),
        ("transfer", t.transfer_orders, t.transfer_order_lines, "requested_quantity"),
    ):
        link = f"{kind}_order_id"
        parts.append(joins.order_lines(headers, lines, link, ["status"]).select(
            F.lit(kind).alias("kind"), F.col(link).alias("order_id"), F.col("id").alias("line_id"), "order_status",
            "product_id", F.col(quantity).alias("quantity"),
        ))
    return quality.union_all(parts)


@query("enrich_facts", """select b.id, p.sku product_sku, p.product_family, l.location_code location_location_code,
    g.name organization_name, b.on_hand_quantity from inventory_balances b
    left join products p on p.id = b.product_id left join locations l on l.id = b.location_id
    left join organizations g on g.id = l.organization_id""")
def _(t):
    places = joins.enrich_facts(t.locations, {"organization": (t.organizations, "organization_id", ["name"])})
    return joins.enrich_facts(t.inventory_balances, {
        "product": (t.products, "product_id", ["sku", "product_family"]),
        "location": (places, "location_id", ["location_code", "organization_name"]),
    }).select(
        "id", "product_sku", F.col("product_product_family").alias("product_family"), "location_location_code",
        F.col("location_organization_name").alias("organization_name"), "on_hand_quantity",
    )


@query("lanes", """select kind, m.id, o.location_code origin_code, d.location_code destination_code,
    o.country_code <> d.country_code crosses_border from (
      select 'shipment' kind, id, origin_location_id, destination_location_id from shipments
      union all select 'transfer', id, origin_location_id, destination_location_id from transfer_orders) m
    join locations o on o.id = m.origin_location_id join locations d on d.id = m.destination_location_id""")
def _(t):
    return joins.lanes(t.shipments, t.transfer_orders, t.locations).select(
        "kind", "id", "origin_code", "destination_code", "crosses_border"
    )


# goods issues and receipts booked straight from the lines, so every one has a header
@query("movement_source_known", """select concat('S', id) id, 'sales_order' source_kind, id source_id, sales_order_id header_id from sales_order_lines
    union all select concat('P', id), 'purchase_order', id, purchase_order_id from purchase_order_lines""")
def _(t):
    issued = t.sales_order_lines.selectExpr("concat('S', id) id", "id sales_order_line_id", "cast(null as string) purchase_order_line_id")
    received = t.purchase_order_lines.selectExpr("concat('P', id) id", "cast(null as string) sales_order_line_id", "id purchase_order_line_id")
    return joins.with_source(
        issued.unionByName(received), {"sales_order": "sales_order_line_id", "purchase_order": "purchase_order_line_id"},
        {
            "sales_order": t.sales_order_lines.selectExpr("id", "sales_order_id header_id"),
            "purchase_order": t.purchase_order_lines.selectExpr("id", "purchase_order_id header_id"),
        },
    ).select("id", "source_kind", "source_id", "header_id")


@query("movement_source", """
    with refs as (
      select 'item' owner, id, sales_order_line_id s, purchase_order_line_id p, transfer_order_line_id t,
             cast(null as varchar) w, cast(null as varchar) a from shipment_items
      union all select 'movement', id, sales_order_line_id, purchase_order_line_id, transfer_order_line_id,
             production_order_id, inventory_adjustment_id from inventory_movements)
    select owner, r.id, case when s is not null then 'sales_order' when p is not null then 'purchase_order'
        when w is not null then 'production_order' when t is not null then 'transfer_order'
        when a is not null then 'adjustment' end source_kind, coalesce(s, p, w, t, a) source_id,
      case when s is not null then sl.sales_order_id when p is not null then pl.purchase_order_id
        when w is not null then wo.id when t is not null then tl.transfer_order_id end header_id
    from refs r left join sales_order_lines sl on sl.id = r.s left join purchase_order_lines pl on pl.id = r.p
    left join production_orders wo on wo.id = r.w left join transfer_order_lines tl on tl.id = r.t""")
def _(t):
    parents = {
        "sales_order": t.sales_order_lines.selectExpr("id", "sales_order_id header_id"),
        "purchase_order": t.purchase_order_lines.selectExpr("id", "purchase_order_id header_id"),
        "production_order": t.production_orders.selectExpr("id", "id header_id"),
        "transfer_order": t.transfer_order_lines.selectExpr("id", "transfer_order_id header_id"),
    }
    both = t.shipment_items.select(
        F.lit("item").alias("owner"), "id", *sorted(schema.NULLABLE["shipment_items"])
    ).unionByName(t.inventory_movements.select(F.lit("movement").alias("owner"), "id", *schema.MOVEMENT_SOURCES), True)
    return joins.with_source(both, {
        "sales_order": "sales_order_line_id", "purchase_order": "purchase_order_line_id",
        "production_order": "production_order_id", "transfer_order": "transfer_order_line_id",
        "adjustment": "inventory_adjustment_id",
    }, parents).select("owner", "id", "source_kind", "source_id", "header_id")


@query("interval_join", """select l.id line_id, s.id offer_id, s.supplier_id, o.order_date, s.contracted_lead_time_days
    from purchase_order_lines l join purchase_orders o on o.id = l.purchase_order_id
    join product_suppliers s on s.product_id = l.product_id and s.supplier_id = o.supplier_id
      and o.order_date between s.valid_from and s.valid_to""")
def _(t):
    ordered = joins.order_lines(t.purchase_orders, t.purchase_order_lines, "purchase_order_id", ["supplier_id", "order_date"])
    bought = ordered.selectExpr("id line_id", "product_id", "order_supplier_id supplier_id", "order_order_date order_date")
    offers = t.product_suppliers.selectExpr(
        "id offer_id", "product_id", "supplier_id", "contracted_lead_time_days", "valid_from", "valid_to"
    )
    return joins.interval_join(bought, offers, ["product_id", "supplier_id"], "order_date", "valid_from", "valid_to").select(
        "line_id", "offer_id", "supplier_id", "order_date", "contracted_lead_time_days"
    )


@query("interval_join_bom", """select w.id order_id, b.id bom_id, b.component_product_id, b.bom_version
    from production_orders w join bill_of_materials b on b.finished_product_id = w.product_id
      and cast(w.planned_start_at as date) between b.effective_from and b.effective_to""")
def _(t):
    started = t.production_orders.selectExpr("id order_id", "product_id", "to_date(planned_start_at) start_date")
    recipes = t.bill_of_materials.selectExpr(
        "id bom_id", "finished_product_id product_id", "component_product_id", "bom_version", "effective_from", "effective_to"
    )
    return joins.interval_join(started, recipes, ["product_id"], "start_date", "effective_from", "effective_to").select(
        "order_id", "bom_id", "component_product_id", "bom_version"
    )


@query("stock_as_of", """
    with asked as (select id, product_id, location_id, cast(event_timestamp as date) moved_on from inventory_movements)
    select a.*, s.snapshot_date as_of_time, s.on_hand_quantity from asked a
    asof left join inventory_snapshots s on s.product_id = a.product_id and s.location_id = a.location_id
      and a.moved_on >= s.snapshot_date""")
def _(t):
    return joins.stock_as_of(t.inventory_movements, t.inventory_snapshots)  # plain windows: no key is large here


@query("unfulfilled", """select 'order without lines' kind, id from sales_orders where id not in (select sales_order_id from sales_order_lines)
    union all select 'line without shipment', id from sales_order_lines l
      where not exists (select 1 from shipment_items i where i.sales_order_line_id = l.id)
    union all select 'product without supplier', id from products where id not in (select product_id from product_suppliers)""")
def _(t):
    return joins.unfulfilled(t.sales_orders, t.sales_order_lines, t.shipment_items, t.products, t.product_suppliers)


@query("in_demand", """select 'product' kind, id from products where id in (select product_id from sales_order_lines)
    union all select 'supplier', id from organizations where id in (select supplier_id from product_suppliers
      where product_id in (select product_id from sales_order_lines))
    union all select 'location', id from locations where id in (select assigned_warehouse_id from sales_orders
      where id in (select sales_order_id from sales_order_lines))""")
def _(t):
    return joins.in_demand(
        t.products, t.organizations, t.locations, t.sales_orders, t.sales_order_lines, t.product_suppliers
    )


_EDGES = """select finished_product_id p, component_product_id c, cast(quantity_required as double)*(1+scrap_factor) f
    from bill_of_materials where date '1998-01-01' between effective_from and effective_to"""


@query("bom_explode", f"""with recursive bom_edges as ({_EDGES}),
    walk as (select p root, c product, 1 level, f quantity from bom_edges
      union all select w.root, e.c, w.level + 1, w.quantity * e.f from walk w join bom_edges e on e.p = w.product)
    select root product_id, product component_product_id, cast(level as int) level, sum(quantity) quantity
    from walk group by all""")
def _(t):
    return bom.bom_explode(t.bill_of_materials, "1998-01-01")


# The feed with faults: components held over a level as well (diamonds), and some that hold what they are part of (cycles).
shared("looped_edges", f"""with own as ({_EDGES}), far as (select a.p top, b.c low from own a join own b on a.c = b.p)
    select p, c, f from own
    union all select top, low, 1.0e0 from far where cast(substr(low, 2) as bigint) % 5 = 1
    union all select low, top, 2.0e0 from far where cast(substr(low, 2) as bigint) % 97 = 0""")
shared("mutual", """with recursive below(a, b) as (select p, c from looped_edges union select a, c from below join looped_edges on p = b)
    select x.a, x.b from below x join below y on x.a = y.b and x.b = y.a""")


def looped_bom(t):
    own = t.bill_of_materials
    number = lambda c: F.substring(c, 2, 20).cast("bigint")
    far = projections.valid_on(own, "1998-01-01", "effective_from", "effective_to").select(
        F.col("finished_product_id").alias("top"), F.col("component_product_id").alias("mid")
    ).join(projections.valid_on(own, "1998-01-01", "effective_from", "effective_to").select(
        F.col("finished_product_id").alias("mid"), F.col("component_product_id").alias("low")
    ), "mid")

    def edges(rows, product, component, quantity):
        return rows.select(
            F.col(product).alias("finished_product_id"), F.col(component).alias("component_product_id"),
            F.lit(quantity).cast("decimal(12,4)").alias("quantity_required"), F.lit(0.0).alias("scrap_factor"),
            F.lit("1995-01-01").cast("date").alias("effective_from"), F.lit("2001-12-31").cast("date").alias("effective_to"),
        )

    plain = own.select("finished_product_id", "component_product_id", "quantity_required", "scrap_factor", "effective_from", "effective_to")
    return plain.unionByName(edges(far.filter(number("low") % 5 == 1), "top", "low", 1)).unionByName(
        edges(far.filter(number("low") % 97 == 0), "low", "top", 2)
    )


@query("bom_cycles", """with sized as (select a, min(b) component, count(distinct b) products from mutual group by a)
    select distinct component, p product, c "next", products from looped_edges join mutual on a = p and b = c join sized on sized.a = p""")
def _(t):
    return bom.bom_cycles(looped_bom(t), "1998-01-01")


@query("bom_explode_looped", """with recursive open_edges as (
      select p, c, f from looped_edges where not exists (select 1 from mutual where a = p and b = c)),
    walk as (select p root, c product, 1 level, f quantity from open_edges
      union all select w.root, e.c, w.level + 1, w.quantity * e.f from walk w join open_edges e on e.p = w.product)
    select root product_id, product component_product_id, cast(level as int) level, sum(quantity) quantity
    from walk group by all""")
def _(t):
    """The explosion of the feed with faults: what lies behind a cycle is still found, the cycle itself is not followed."""
    return bom.bom_explode(looped_bom(t), "1998-01-01")


@query("bom_where_used", f"""with recursive bom_edges as ({_EDGES}),
    walk as (select c root, p product, 1 level, f quantity from bom_edges
      union all select w.root, e.p, w.level + 1, w.quantity * e.f from walk w join bom_edges e on e.c = w.product)
    select root component_product_id, product product_id, cast(level as int) level, sum(quantity) quantity
    from walk group by all""")
def _(t):
    return bom.bom_where_used(t.bill_of_materials, "1998-01-01")


@query("material_requirements", f"""with recursive bom_edges as ({_EDGES}),
    open_quantity as (select product_id, cast(sum(cast(greatest(planned_quantity-produced_quantity,0) as decimal(38,8))) as double) q
      from production_orders where status in ('O','P') group by 1),
    walk as (select c product, q*f quantity from open_quantity join bom_edges on p = product_id
      union all select e.c, w.quantity * e.f from walk w join bom_edges e on e.p = w.product),
    demand as (select product, sum(quantity) g from walk group by 1),
    stock as (select product_id, cast(sum(cast(available_quantity as decimal(38,8))) as double) a from inventory_balances group by 1)
    select product component_product_id, g gross_quantity, coalesce(a, 0) available_quantity,
      greatest(g - coalesce(a, 0), 0) net_quantity from demand left join stock on product_id = product""")
def _(t):
    return bom.material_requirements(
        t.production_orders, t.bill_of_materials, t.inventory_balances, "1998-01-01", ["O", "P"]
    )


@query("stock_reconcile", """
    with moved as (select product_id, location_id, cast(sum(cast(quantity as decimal(38,8))) as double) moved_quantity from inventory_movements group by all),
    held as (select product_id, location_id, cast(sum(cast(on_hand_quantity as decimal(38,8))) as double) on_hand_quantity from inventory_balances group by all)
    select product_id, location_id, moved_quantity, on_hand_quantity,
      coalesce(on_hand_quantity, 0) - coalesce(moved_quantity, 0) difference
    from moved full join held using (product_id, location_id)""")
def _(t):
    return joins.stock_reconcile(t.inventory_movements, t.inventory_balances)
