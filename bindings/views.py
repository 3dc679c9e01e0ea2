"""The 20 tables of the data model, built from the given parquet tables.

Each binding is one SQL text that Spark and DuckDB both read: Spark turns it
into a DataFrame, the oracle puts it in front of its query as a CTE. The only
difference is the name of the zone-less timestamp type.

Line ids number the copies of one (order, line, part, supplier), so a very
large order is spread over many window groups.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stockflow import schema

GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

_COPY = (
    "concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',row_number() over (partition by"
    " l_orderkey,l_linenumber,l_partkey,l_suppkey order by"
    " l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate))"
)

# name -> (select over the given tables, expression for created_at and updated_at)
_TEXT = {
    "organizations": (
        """select concat('C',c_custkey) id, c_name name, 'customer' organization_type,
                  concat('N',c_nationkey) country_code, 'SEK' default_currency, c_mktsegment risk_tier, 1 active
           from customer
           union all select concat('S',s_suppkey), s_name, 'supplier', concat('N',s_nationkey), 'SEK',
                  case when s_acctbal<0 then 'high' else 'low' end, 1 from supplier
           union all select concat('K',r_regionkey), concat('Carrier ',r_name), 'carrier',
                  concat('R',r_regionkey), 'SEK', 'low', 1 from region""",
        "date '1995-01-01'",
    ),
    "locations": (
        """select concat('L',n_nationkey) id, concat('K',n_regionkey) organization_id, n_name location_code,
                  n_name name, case n_nationkey % 4 when 0 then 'warehouse' when 1 then 'plant'
                  when 2 then 'port' else 'store' end location_type, concat('N',n_nationkey) country_code,
                  n_name city, cast(n_nationkey*5-60 as double) latitude,
                  cast(n_nationkey*14-170 as double) longitude, 'UTC' timezone,
                  cast(20000+n_nationkey*1000 as double) storage_capacity,
                  cast(500+n_nationkey*10 as double) daily_handling_capacity from nation""",
        "date '1995-01-01'",
    ),
    "products": (
        """select concat('P',p_partkey) id, concat('SKU-',p_partkey) sku, p_name name, p_type product_type,
                  p_brand product_family, 'EA' unit_of_measure, p_retailprice*0.5e0 unit_cost_sek,
                  p_retailprice selling_price_sek, p_size*0.25e0 weight_kg, p_size*0.01e0 volume_m3,
                  p_size*10 shelf_life_days, p_size % 14 + 1 lead_time_days,
                  case when p_size % 10 = 0 then 0 else 1 end active from part""",
        "date '1995-01-01'",
    ),
    "product_suppliers": (
        """select concat('P',l_partkey,'-S',l_suppkey) id, concat('P',l_partkey) product_id,
                  concat('S',l_suppkey) supplier_id, concat(l_suppkey,'/',l_partkey) supplier_product_code,
                  min(l_extendedprice/l_quantity) unit_cost_sek, min(l_quantity) minimum_order_quantity,
                  cast((l_partkey+l_suppkey) % 21 + 1 as int) contracted_lead_time_days,
                  max(l_quantity) supplier_capacity_per_day,
                  case when l_suppkey % 4 = 0 then 1 else 0 end preferred,
                  cast(min(l_shipdate) as date) valid_from, cast(max(l_shipdate) as date) valid_to
           from lineitem group by l_partkey, l_suppkey""",
        "valid_from",
    ),
    "bill_of_materials": (
        """select concat('F',c.p_partkey) id, concat('P',f.p_partkey) finished_product_id,
                  concat('P',c.p_partkey) component_product_id,
                  cast(c.p_size % 3 + 1 as decimal(12,4)) quantity_required,
                  date '1995-01-01' + cast(c.p_partkey % 30 as int) effective_from,
                  date '2001-12-31' effective_to,
                  case when c.p_partkey % 2 = 0 then 0.0e0 else 0.5e0 end scrap_factor, 'v1' bom_version
           from part f join part c on f.p_partkey = cast(floor((c.p_partkey-1)/2) as bigint)
           where c.p_partkey >= 1""",
        "effective_from",
    ),
    "sales_orders": (
        """select concat('O',o_orderkey) id, concat('SO-',o_orderkey) order_number,
                  concat('C',o_custkey) customer_id, cast(o_orderdate as date) order_date,
                  cast(o_orderdate as date)+4 requested_delivery_date,
                  cast(o_orderdate as date)+6 promised_delivery_date, o_orderpriority priority,
                  o_orderstatus status, case when o_orderkey % 50 = 0 then null else 'SEK' end currency,
                  o_totalprice total_value_sek, concat('L',c_nationkey) assigned_warehouse_id
           from orders join customer on c_custkey=o_custkey""",
        "order_date",
    ),
    "sales_order_lines": (
        f"""select concat('O',{_COPY}) id, concat('O',l_orderkey) sales_order_id, l_linenumber line_number,
                  concat('P',l_partkey) product_id, l_quantity ordered_quantity, l_quantity allocated_quantity,
                  case when l_linestatus='F' then l_quantity else l_quantity-1 end shipped_quantity,
                  case when l_linestatus='F' and l_returnflag<>'R' then l_quantity
                       when l_linestatus='F' then l_quantity*0.5e0 else 0e0 end delivered_quantity,
                  l_extendedprice/l_quantity unit_price_sek,
                  cast(o_orderdate as date)+4 requested_delivery_date, l_linestatus status
           from lineitem join orders on o_orderkey=l_orderkey""",
        "requested_delivery_date",
    ),
    "purchase_orders": (
        """select concat('O',l_orderkey,'-S',l_suppkey) id,
                  concat('PO-',l_orderkey,'-',l_suppkey) purchase_order_number,
                  concat('S',l_suppkey) supplier_id, concat('L',min(s_nationkey)) destination_location_id,
                  cast(min(o_orderdate) as date) order_date,
                  cast(min(o_orderdate) as date)+14 requested_delivery_date,
                  cast(min(o_orderdate) as date)+cast((min(l_partkey)+l_suppkey) % 28 + 1 as int)
                  actual_delivery_date, cast(min(o_orderdate) as date)+16 confirmed_delivery_date,
                  min(o_orderstatus) status, 'SEK' currency,
                  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) total_value_sek
           from lineitem join orders on o_orderkey=l_orderkey join supplier on s_suppkey=l_suppkey
           group by l_orderkey,l_suppkey""",
        "order_date",
    ),
    "purchase_order_lines": (
        f"""select concat('O',{_COPY}) id, concat('O',l_orderkey,'-S',l_suppkey) purchase_order_id,
                  l_linenumber line_number, concat('P',l_partkey) product_id, l_quantity ordered_quantity,
                  l_quantity confirmed_quantity,
                  case when l_linestatus='F' then l_quantity else l_quantity-1 end received_quantity,
                  case when l_returnflag='R' then 1e0 else 0e0 end rejected_quantity,
                  l_extendedprice/l_quantity unit_cost_sek, l_linestatus status from lineitem""",
        "date '1995-01-01'",
    ),
    "transfer_orders": (
        """select concat('T',o_orderkey) id, concat('TO-',o_orderkey) transfer_number,
                  concat('L',o_orderkey % 25) origin_location_id,
                  concat('L',c_nationkey) destination_location_id, o_orderdate requested_at,
                  cast(o_orderdate as date)+7 required_arrival_date, o_orderstatus status,
                  o_orderpriority reason, cast(null as string) recommendation_id
           from orders join customer on c_custkey=o_custkey where o_orderkey % 3 = 0""",
        "requested_at",
    ),
    "transfer_order_lines": (
        f"""select concat('T',{_COPY}) id, concat('T',l_orderkey) transfer_order_id, l_linenumber line_number,
                  concat('P',l_partkey) product_id, l_quantity requested_quantity,
                  case when l_linestatus='F' then l_quantity else l_quantity-1 end shipped_quantity,
                  case when l_returnflag='R' then 0e0 else l_quantity-1 end received_quantity
           from lineitem where l_orderkey % 3 = 0""",
        "date '1995-01-01'",
    ),
    "shipments": (
        """select concat('H',o_orderkey) id, concat('SH-',o_orderkey) shipment_number,
                  case when o_orderkey % 3 = 0 then 'transfer' else 'outbound' end shipment_type,
                  concat('L',o_orderkey % 20) origin_location_id,
                  concat('L',c_nationkey) destination_location_id, concat('K',o_orderkey % 5) carrier_id,
                  case o_orderkey % 4 when 0 then 'road' when 1 then 'sea' when 2 then 'air' else 'rail' end
                  transport_mode, o_orderpriority service_level, o_orderdate planned_departure_at,
                  o_orderdate + interval '6' hour actual_departure_at,
                  o_orderdate + interval '5' day planned_arrival_at,
                  o_orderdate + interval '5' day + interval '12' hour current_eta,
                  o_orderdate + (o_orderkey % 9 + 1) * interval '1' day actual_arrival_at,
                  o_orderstatus status, o_totalprice*0.01e0 freight_cost_sek,
                  cast(o_orderkey % 2000 + 50 as double) distance_km,
                  cast(o_orderkey % 500 + 1 as double) total_weight_kg,
                  cast(o_orderkey % 40 + 1 as double) total_volume_m3,
                  cast((o_orderkey % 9 + 1 - 5)*24 as double) delay_hours
           from orders join customer on c_custkey=o_custkey""",
        "planned_departure_at",
    ),
    "shipment_items": (
        f"""select concat('I',copy_id) id, concat('H',l_orderkey) shipment_id, concat('P',l_partkey) product_id,
                  l_quantity quantity,
                  case when l_orderkey % 3 <> 0 then concat('O',copy_id) end sales_order_line_id,
                  cast(null as string) purchase_order_line_id,
                  case when l_orderkey % 3 = 0 then concat('T',copy_id) end transfer_order_line_id,
                  case when l_orderkey % 3 = 0 then 'transfer_order' else 'sales_order' end source_document_type
           from (select l_orderkey, l_partkey, l_quantity, {_COPY} copy_id from lineitem) numbered""",
        "date '1995-01-01'",
    ),
    "shipment_events": (
        """select concat('E',event_id) id, concat('H',user_id) shipment_id,
                  cast(place + coalesce(before_day, 0) as int) event_sequence, event_type, ts event_timestamp,
                  ts + (event_id % 180) * interval '1' minute received_at, concat('L',user_id % 25) location_id,
                  cast(event_id % 120 as double)-60 latitude, cast(event_id % 340 as double)-170 longitude,
                  event_type status_code, 'gps' source
           from (select *, cast(ts as date) ts_day, row_number() over
                   (partition by user_id, cast(ts as date) order by ts, event_id) place from events) e
           left join (select user_id before_user, before_date, sum(day_rows) over (partition by user_id
                   order by before_date rows between unbounded preceding and 1 preceding) before_day
                 from (select user_id, cast(ts as date) before_date, count(*) day_rows from events
                       group by user_id, cast(ts as date)) d) b
             on before_user = user_id and before_date = ts_day""",
        "event_timestamp",
    ),
    # the same rows for operators that never read event_sequence
    "shipment_pings": (
        """select concat('E',event_id) id, concat('H',user_id) shipment_id, event_type, ts event_timestamp,
                  ts + (event_id % 180) * interval '1' minute received_at, concat('L',user_id % 25) location_id,
                  cast(event_id % 120 as double)-60 latitude, cast(event_id % 340 as double)-170 longitude,
                  event_type status_code, 'gps' source from events""",
        "event_timestamp",
    ),
    "inventory_balances": (
        """select concat('B',p_partkey,'-',place) id, concat('P',p_partkey) product_id,
                  concat('L',place) location_id, cast(p_size*2 + place*3 as double) on_hand_quantity,
                  cast(p_partkey % 20 as double) reserved_quantity,
                  cast(p_size*2 + place*3 - p_partkey % 20 as double) available_quantity,
                  cast(p_partkey % 7 as double) in_transit_quantity,
                  cast(p_partkey % 3 as double) damaged_quantity,
                  cast(p_partkey % 30 as double) safety_stock_quantity,
                  cast(p_partkey % 60 as double) reorder_point_quantity,
                  cast(date '2024-01-31' as TIMESTAMP_NTZ) as_of_timestamp
           from (select p_partkey, p_size, p_partkey % 25 place from part
                 union all select p_partkey, p_size, (p_partkey+7) % 25 from part
                 union all select p_partkey, p_size, (p_partkey+13) % 25 from part) placed""",
        "as_of_timestamp",
    ),
    "inventory_movements": (
        """select concat('M',event_id) id, concat('P',user_id % 20) product_id,
                  concat('L',user_id % 25) location_id, event_type movement_type,
                  case when event_type in ('purchase','error') then -value else value end quantity,
                  ts event_timestamp, event_type reference_type,
                  case when event_type='purchase' then concat('O',event_id) end sales_order_line_id,
                  event_type reason_code, concat('LOT',user_id % 10) lot_number,
                  cast(ts as date)+cast(event_id % 90 as int) expiry_date,
                  case when event_type='click' then concat('O',event_id) end purchase_order_line_id,
                  cast(null as string) production_order_id,
                  case when event_type='view' or event_id % 500 = 0 then concat('T',event_id) end
                  transfer_order_line_id,
                  case when event_type='error' then concat('A',event_id) end inventory_adjustment_id
           from events""",
        "event_timestamp",
    ),
    "inventory_snapshots": (
        """select concat(cast(ts as date),'-',user_id % 20,'-',user_id % 25) id, cast(ts as date) snapshot_date,
                  concat('P',user_id % 20) product_id, concat('L',user_id % 25) location_id,
                  cast(sum(cast(value as decimal(18,2))) as double) on_hand_quantity,
                  cast(sum(cast(value as decimal(18,2))) as double)*0.9e0 available_quantity,
                  cast(sum(cast(value as decimal(18,2))) as double)*0.1e0 reserved_quantity,
                  cast(count(*) as double) days_of_supply,
                  cast(sum(cast(value as decimal(18,2))) as double)*10e0 inventory_value_sek,
                  50e0 safety_stock_quantity, 100e0 reorder_point_quantity
           from events group by cast(ts as date), user_id % 20, user_id % 25""",
        "snapshot_date",
    ),
    "production_orders": (
        """select concat('W',o_orderkey) id, concat('MO-',o_orderkey) production_order_number,
                  concat('L',(o_orderkey % 6)*4+1) plant_location_id, concat('P',o_orderkey % 200) product_id,
                  cast(o_orderkey % 100 + 10 as double) planned_quantity,
                  cast(o_orderkey % 100 + 10 - o_orderkey % 7 as double) produced_quantity,
                  cast(o_orderkey % 5 as double) scrapped_quantity, o_orderdate planned_start_at,
                  o_orderdate + interval '2' day planned_end_at,
                  o_orderdate + interval '3' hour actual_start_at,
                  o_orderdate + (o_orderkey % 4 + 1) * interval '1' day actual_end_at,
                  o_orderstatus status, o_orderpriority priority from orders where o_orderkey % 4 = 0""",
        "planned_start_at",
    ),
    "production_material_consumption": (
        f"""select concat('U',{_COPY}) id, concat('W',l_orderkey) production_order_id,
                  concat('P',l_partkey) component_product_id, l_quantity planned_quantity,
                  case when l_returnflag='R' then l_quantity+1 else l_quantity end actual_quantity,
                  'EA' unit_of_measure, l_shipdate event_timestamp from lineitem where l_orderkey % 4 = 0""",
        "event_timestamp",
    ),
    "production_capacity": (
        """select concat('L',(o_orderkey % 6)*4+1,'-',cast(o_orderdate as date)) id,
                  concat('L',(o_orderkey % 6)*4+1) plant_location_id, cast(o_orderdate as date) capacity_date,
                  16e0 available_hours, 500e0 planned_capacity_units,
                  cast(sum(o_orderkey % 100) as double) actual_capacity_units,
                  cast(sum(o_orderkey % 60) as double) downtime_minutes, min(o_orderpriority) capacity_reason,
                  cast(sum(o_orderkey % 100) as double)/500e0 utilization_rate
           from orders group by (o_orderkey % 6)*4+1, cast(o_orderdate as date)""",
        "capacity_date",
    ),
}


def _text(name: str) -> str:
    body, changed = _TEXT[name]
    kind = "date" if name == "sales_order_lines" else "TIMESTAMP_NTZ"
    stamp = f"cast({changed} as {kind})"
    return (
        f"select bound.*, {stamp} created_at, {stamp} updated_at, 'testdata' source_system, id external_id"
        f" from ({body}) bound"
    )


def cte(name: str) -> str:
    return _text(name).replace("TIMESTAMP_NTZ", "timestamp")


def names() -> list[str]:
    return list(_TEXT)


class Tables:
    """The bound tables of one data folder as attributes, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder, self._built = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _TEXT:
            raise AttributeError(name)
        if name not in self._built:
            text = _text(name)
            for given in GIVEN:
                if re.search(rf"\b(from|join) {given}\b", text):
                    self.spark.read.parquet(f"{self.folder}/{given}.parquet").createOrReplaceTempView(given)
            frame = self.spark.sql(text)
            if name in schema.table_names():
                frame = frame.select(*schema.columns(name))
            self._built[name] = frame
        return self._built[name]

    def all(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in schema.table_names()}
