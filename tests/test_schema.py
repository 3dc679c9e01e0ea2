from pyspark.sql import types as T

from stockflow import schema


def test_counts():
    tables = schema.table_names()
    assert len(tables) == 20
    assert sum(len(schema.columns(t)) for t in tables) == 294
    assert sum(len(schema.required_columns(t)) for t in tables) == 284
    assert sum(len(schema.enum_columns(t)) for t in tables) == 22
    assert sum(len(schema.code_columns(t)) for t in tables) == 5
    assert sum(len(schema.unique_columns(t)) for t in tables) == 27


def test_references():
    keys = schema.foreign_keys()
    assert len(keys) == 42
    assert sum(k.on_delete == "CASCADE" for k in keys) == 9
    assert ("inventory_movements", "recommendation_id") not in {(k.child, k.column) for k in keys}
    parents = {(k.child, k.column): k.parent for k in keys}
    assert parents["sales_orders", "assigned_warehouse_id"] == "locations"
    assert parents["shipments", "carrier_id"] == "organizations"
    assert parents["bill_of_materials", "component_product_id"] == "products"


def test_types():
    kinds = [schema.data_type(t, c) for t in schema.table_names() for c in schema.columns(t)]
    assert kinds.count(T.FloatType()) == 56
    assert kinds.count(T.TimestampType()) == 53
    assert kinds.count(T.DateType()) == 18
    assert kinds.count(T.IntegerType()) == 10
    assert kinds.count(T.DoubleType()) == 4
    assert kinds.count(T.DecimalType(12, 4)) == 1
    assert schema.data_type("sales_order_lines", "created_at") == T.DateType()
