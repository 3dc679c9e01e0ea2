import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stockflow import schema
from stockflow.sources import jdbc, tables
from stockflow.streaming import streams

INI = """[postgresql]
user = reader
password = pw
host = db.example
port = 5433
database = chain
sslmode = require
empty =
"""


def test_jdbc_options(tmp_path):
    ini = tmp_path / "database.ini"
    ini.write_text(INI)
    options = jdbc.jdbc_options("product_suppliers", ini)
    assert options["url"] == "jdbc:postgresql://db.example:5433/chain?sslmode=require"
    assert options["user"] == "reader" and '"supplier_id"' in options["dbtable"]
    settings = jdbc.connection_settings(ini)
    assert sorted(settings) == sorted(jdbc.REQUIRED) and settings["dbname"] == "chain"


def test_jdbc_dbname_wins(tmp_path):
    ini = tmp_path / "database.ini"
    ini.write_text(INI + "dbname = other\n")
    assert jdbc.connection_settings(ini)["dbname"] == "other"
    ini.write_text(INI + "dbname =\n")
    assert jdbc.connection_settings(ini)["dbname"] == "chain"


def test_jdbc_errors(tmp_path):
    with pytest.raises(FileNotFoundError):
        jdbc.connection_settings(tmp_path / "none.ini")
    ini = tmp_path / "database.ini"
    ini.write_text("[other]\nuser = x\n")
    with pytest.raises(KeyError):
        jdbc.connection_settings(ini)
    ini.write_text(INI.replace("sslmode = require", "sslmode ="))
    with pytest.raises(KeyError, match="sslmode"):
        jdbc.connection_settings(ini)
    ini.write_text(INI.replace("5433", "many"))
    with pytest.raises(ValueError):
        jdbc.jdbc_options("products", ini)


def test_created_ranges_cover_everything():
    edges = [datetime(2024, 2, 1), datetime(2024, 1, 1)]
    parts = jdbc.created_ranges(edges)
    assert len(parts) == 3
    assert parts[0].startswith("created_at < timestamptz '2024-01-01")
    assert parts[2].startswith("created_at >= timestamptz '2024-02-01")
    assert jdbc.created_ranges([]) == ["created_at is not null"]


def test_created_edges_follow_the_rows():
    first, last = datetime(2024, 1, 1), datetime(2024, 1, 11)
    assert "count(*)" in jdbc.range_query("products") and '"products"' in jdbc.range_query("products")
    edges = jdbc.created_edges(first, last, 5_000_001, 500_000)
    assert len(edges) == 10 and first < edges[0] and edges == sorted(edges) and edges[-1] < last
    assert len(jdbc.created_ranges(edges)) == 11
    assert jdbc.created_edges(first, last, 500_000, 500_000) == []
    assert jdbc.created_edges(None, None, 0, 10) == [] and jdbc.created_edges(first, first, 100, 10) == []


def test_json_keeps_nulls_and_every_column(spark):
    df = spark.createDataFrame([("a", None, 1.5)], "id string, currency string, total_value_sek double")
    row = json.loads(tables.rows_as_json(df).first()[0])
    assert row == {"id": "a", "currency": None, "total_value_sek": 1.5}


def test_float_columns_are_four_bytes(spark):
    df = spark.createDataFrame([(0.1, 16777217.0)], "a double, b double").select(F.col("a").cast("float"), F.col("b").cast("float"))
    wide = df.select(F.col("a").cast("double"), F.col("b").cast("double")).first()
    assert wide[0] != 0.1 and abs(wide[0] - 0.1) < 1e-8 and wide[1] == 16777216.0


def _products(spark, rows):
    stamp = datetime(2024, 1, 1)
    base = {
        "name": "n", "product_type": "t", "product_family": "f", "unit_of_measure": "EA", "unit_cost_sek": 1.0,
        "selling_price_sek": 2.0, "weight_kg": 1.0, "volume_m3": 1.0, "shelf_life_days": 1, "lead_time_days": 1, "active": 1,
        "created_at": stamp, "updated_at": stamp, "source_system": "s",
    }
    full = [{**base, "id": r["external_id"], "sku": r["external_id"], **r} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in schema.columns("products")) for r in full], schema.struct_type("products"))


def test_upsert_takes_the_newest_then_the_higher_id(spark):
    base = _products(spark, [{"external_id": "a"}, {"external_id": "b", "updated_at": datetime(2024, 3, 1)}])
    feed = _products(spark, [
        {"external_id": "a", "id": "z", "active": 0}, {"external_id": "b", "active": 0}, {"external_id": "c"},
    ])
    got = {r.external_id: (r.id, r.active) for r in tables.ingest_upsert(base, feed).collect()}
    assert got == {"a": ("z", 0), "b": ("b", 1), "c": ("c", 1)}


def test_tables_round_trip(spark, tmp_path):
    for name in schema.table_names():
        spark.createDataFrame([], schema.struct_type(name)).write.parquet(f"{tmp_path}/{name}")
    loaded = tables.load_tables(spark, str(tmp_path))
    assert list(loaded) == schema.table_names()
    assert spark.table("bill_of_materials").schema["quantity_required"].dataType.simpleString() == "decimal(12,4)"
    assert {r.row_count for r in tables.table_counts(loaded).collect()} == {0}


def test_lake_write_replaces_only_its_dates(spark, tmp_path):
    path = str(tmp_path / "lake")
    rows = [("a", datetime(2024, 1, 1, 5)), ("b", datetime(2024, 1, 2, 5))]
    tables.lake_write(spark.createDataFrame(rows, "id string, event_timestamp timestamp"), path, "event_timestamp")
    tables.lake_write(spark.createDataFrame([("c", datetime(2024, 1, 2, 7))], "id string, event_timestamp timestamp"), path, "event_timestamp")
    got = {(r.id, r.event_date) for r in spark.read.parquet(path).collect()}
    assert got == {("a", date(2024, 1, 1)), ("c", date(2024, 1, 2))}


def test_feed_stream_reads_files_with_the_declared_schema(spark, tmp_path):
    _products(spark, [{"external_id": "a"}, {"external_id": "b"}]).write.json(f"{tmp_path}/feed")
    stream = streams.feed_stream(spark, "products", f"{tmp_path}/feed", "json")
    assert stream.isStreaming and stream.columns == schema.columns("products")
    streams.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
