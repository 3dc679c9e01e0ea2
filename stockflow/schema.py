"""The supply-chain data model: 20 tables, their types, keys and references.

Only column names are listed. Types, references and the audit columns follow
from naming rules, so a table reads as one line per group of columns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

AUDIT_COLUMNS = ["created_at", "updated_at", "source_system", "external_id"]

# Table and column names of the data model. A table without its
# own audit columns ends with AUDIT_COLUMNS.
_TABLES = {
    "organizations": "id name organization_type country_code default_currency risk_tier active",
    "locations": "id organization_id location_code name location_type country_code city latitude longitude"
    " timezone storage_capacity daily_handling_capacity",
    "products": "id sku name product_type product_family unit_of_measure unit_cost_sek selling_price_sek"
    " weight_kg volume_m3 shelf_life_days lead_time_days active",
    "product_suppliers": "id product_id supplier_id supplier_product_code unit_cost_sek minimum_order_quantity"
    " contracted_lead_time_days supplier_capacity_per_day preferred valid_from valid_to",
    "bill_of_materials": "id finished_product_id component_product_id quantity_required effective_from"
    " effective_to scrap_factor bom_version",
    "sales_orders": "id order_number customer_id order_date requested_delivery_date promised_delivery_date"
    " priority status currency total_value_sek assigned_warehouse_id",
    "sales_order_lines": "id sales_order_id line_number product_id ordered_quantity allocated_quantity"
    " shipped_quantity delivered_quantity unit_price_sek requested_delivery_date status",
    "purchase_orders": "id purchase_order_number supplier_id destination_location_id order_date"
    " requested_delivery_date actual_delivery_date status currency total_value_sek created_at updated_at"
    " source_system confirmed_delivery_date external_id",
    "purchase_order_lines": "id purchase_order_id line_number product_id ordered_quantity confirmed_quantity"
    " received_quantity rejected_quantity unit_cost_sek status",
    "transfer_orders": "id transfer_number origin_location_id destination_location_id requested_at"
    " required_arrival_date status reason recommendation_id",
    "transfer_order_lines": "id transfer_order_id line_number product_id requested_quantity shipped_quantity"
    " received_quantity",
    "shipments": "id shipment_number shipment_type origin_location_id destination_location_id carrier_id"
    " transport_mode service_level planned_departure_at actual_departure_at planned_arrival_at current_eta"
    " actual_arrival_at status freight_cost_sek distance_km total_weight_kg total_volume_m3 delay_hours",
    "shipment_items": "id shipment_id product_id quantity sales_order_line_id purchase_order_line_id"
    " transfer_order_line_id source_document_type",
    "shipment_events": "id shipment_id event_sequence event_type event_timestamp received_at location_id"
    " latitude longitude status_code source",
    "inventory_balances": "id product_id location_id on_hand_quantity reserved_quantity available_quantity"
    " in_transit_quantity damaged_quantity safety_stock_quantity reorder_point_quantity as_of_timestamp",
    "inventory_movements": "id product_id location_id movement_type quantity event_timestamp reference_type"
    " sales_order_line_id reason_code lot_number expiry_date created_at updated_at source_system external_id"
    " purchase_order_line_id production_order_id transfer_order_line_id inventory_adjustment_id",
    "inventory_snapshots": "id snapshot_date product_id location_id on_hand_quantity available_quantity"
    " reserved_quantity days_of_supply inventory_value_sek safety_stock_quantity reorder_point_quantity",
    "production_orders": "id production_order_number plant_location_id product_id planned_quantity"
    " produced_quantity scrapped_quantity planned_start_at planned_end_at actual_start_at actual_end_at"
    " status priority",
    "production_material_consumption": "id production_order_id component_product_id planned_quantity"
    " actual_quantity unit_of_measure event_timestamp",
    "production_capacity": "id plant_location_id capacity_date available_hours planned_capacity_units"
    " actual_capacity_units downtime_minutes capacity_reason utilization_rate",
}

# The nullable columns; every other column is NOT NULL.
NULLABLE = {
    "sales_orders": {"currency"},
    "transfer_orders": {"recommendation_id"},
    "shipment_items": {"sales_order_line_id", "purchase_order_line_id", "transfer_order_line_id"},
    "inventory_movements": {
        "sales_order_line_id", "purchase_order_line_id", "production_order_id",
        "transfer_order_line_id", "inventory_adjustment_id",
    },
}

# Natural keys that are unique beside id and external_id.
NATURAL_KEYS = {
    "locations": "location_code",
    "products": "sku",
    "sales_orders": "order_number",
    "purchase_orders": "purchase_order_number",
    "transfer_orders": "transfer_number",
    "production_orders": "production_order_number",
    "shipments": "shipment_number",
}

# Columns holding an enumerated label (the labels are the caller's).
ENUM_NAMES = {
    "organization_type", "location_type", "product_type", "priority", "status", "reason", "shipment_type",
    "transport_mode", "service_level", "source_document_type", "event_type", "status_code", "movement_type",
    "reason_code", "capacity_reason",
}

# Columns of at most three characters.
CODE_LENGTH = 3
_CODE_NAMES = {"country_code", "default_currency", "currency"}

# References whose rows go with the parent; all others block its deletion.
_CASCADES = {
    ("bill_of_materials", "finished_product_id"),
    ("bill_of_materials", "component_product_id"),
    ("sales_order_lines", "sales_order_id"),
    ("purchase_order_lines", "purchase_order_id"),
    ("transfer_order_lines", "transfer_order_id"),
    ("shipment_items", "shipment_id"),
    ("shipment_events", "shipment_id"),
    ("production_material_consumption", "production_order_id"),
    ("production_material_consumption", "component_product_id"),
}

# The five references of a movement, of which at most one is set.
MOVEMENT_SOURCES = [
    "sales_order_line_id", "purchase_order_line_id", "production_order_id",
    "transfer_order_line_id", "inventory_adjustment_id",
]

_FLOAT_SUFFIXES = (
    "quantity", "_sek", "_kg", "_m3", "_km", "_capacity", "_per_day", "_hours", "_units", "_minutes", "_rate",
    "days_of_supply", "scrap_factor",
)


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str
    on_delete: str


def table_names() -> list[str]:
    return list(_TABLES)


def columns(table: str) -> list[str]:
    names = _TABLES[table].split()
    return names if "created_at" in names else names + AUDIT_COLUMNS


def data_type(table: str, column: str) -> T.DataType:
    if column == "quantity_required":
        return T.DecimalType(12, 4)
    if column in ("latitude", "longitude"):
        return T.DoubleType()
    if column in ("active", "preferred", "line_number", "event_sequence") or column.endswith("_days"):
        return T.IntegerType()
    if column in ("created_at", "updated_at"):
        return T.DateType() if table == "sales_order_lines" else T.TimestampType()
    if column.endswith("_date") or column in ("valid_from", "valid_to", "effective_from", "effective_to"):
        return T.DateType()
    if column.endswith(("_at", "_timestamp")) or column == "current_eta":
        return T.TimestampType()
    if column.endswith(_FLOAT_SUFFIXES):
        return T.FloatType()
    return T.StringType()


def struct_type(table: str) -> T.StructType:
    optional = NULLABLE.get(table, set())
    return T.StructType([T.StructField(c, data_type(table, c), c in optional) for c in columns(table)])


def required_columns(table: str) -> list[str]:
    optional = NULLABLE.get(table, set())
    return [c for c in columns(table) if c not in optional]


def unique_columns(table: str) -> list[str]:
    natural = NATURAL_KEYS.get(table)
    return ["external_id"] + ([natural] if natural else [])


def enum_columns(table: str) -> list[str]:
    return [c for c in columns(table) if c in ENUM_NAMES]


def code_columns(table: str) -> list[str]:
    return [c for c in columns(table) if c in _CODE_NAMES]


def _parent_of(column: str) -> str | None:
    if not column.endswith("_id"):
        return None
    stem = column[: -len("_id")]
    if stem + "s" in _TABLES:
        return stem + "s"
    if stem in ("customer", "supplier", "carrier"):
        return "organizations"
    if stem.endswith("_product"):
        return "products"
    if stem.endswith(("_location", "_warehouse")):
        return "locations"
    return None


def foreign_keys(parent: str | None = None) -> list[ForeignKey]:
    """All references, or those to one parent table."""
    keys = []
    for table in _TABLES:
        for column in columns(table):
            target = _parent_of(column)
            if target and parent in (None, target):
                rule = "CASCADE" if (table, column) in _CASCADES else "RESTRICT"
                keys.append(ForeignKey(table, column, target, rule))
    return keys
