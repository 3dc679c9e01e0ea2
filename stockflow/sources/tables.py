"""Load the tables with their declared schemas; list, serialise, merge and write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow import schema


def load_tables(spark: SparkSession, folder: str, register_views: bool = True) -> dict[str, DataFrame]:
    """The 20 tables from parquet folders, each with its declared schema and a view of its name."""
    tables = {}
    for name in schema.table_names():
        tables[name] = spark.read.schema(schema.struct_type(name)).parquet(f"{folder}/{name}")
        if register_views:
            tables[name].createOrReplaceTempView(name)
    return tables


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def list_product_suppliers(product_suppliers: DataFrame) -> DataFrame:
    """Every offer with all its columns, by id: a range-partitioned sort, never collected."""
    return product_suppliers.select(*schema.columns("product_suppliers")).orderBy("id")


def rows_as_json(df: DataFrame, out: str = "row") -> DataFrame:
    """Each row as one JSON object with every column, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def ingest_upsert(base: DataFrame, feed: DataFrame) -> DataFrame:
    """Merge a feed into a table: per source record the newest updated_at wins, then the higher id."""
    both = base.unionByName(feed)
    newest_first = Window.partitionBy("source_system", "external_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return both.withColumn("_place", F.row_number().over(newest_first)).filter("_place = 1").drop("_place")


def lake_write(df: DataFrame, path: str, event_time: str) -> None:
    """Write facts by event date, replacing only the dates in the batch.

    The rebalance hint gathers a date into few files, and splits a date that
    holds very many rows.
    """
    (
        df.withColumn("event_date", F.to_date(event_time)).hint("rebalance", "event_date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    )
