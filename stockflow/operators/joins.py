"""Joins over keys, validity ranges and as-of times.

No join is forced to broadcast: Spark broadcasts a side when its measured size
is under the session's threshold, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.exact import exact_sum
from stockflow.functions.measures import number
from stockflow.functions.split_windows import last_known


def prefixed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def order_lines(headers: DataFrame, lines: DataFrame, link: str, header_columns: list[str]) -> DataFrame:
    """Lines with columns of their order (prefixed order_)."""
    side = prefixed(headers, "order_", ["id", *header_columns]).withColumnRenamed("order_id", link)
    return lines.join(side, link)


def enrich_facts(facts: DataFrame, dimensions: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Left-join dimensions: {prefix: (dimension, fact column, dimension columns)}.

    Facts without a reference are spread by a hash of their other columns, so they do not gather in one task.
    """
    out = facts
    for prefix, (dimension, column, wanted) in dimensions.items():
        others = [c for c in facts.columns if c != column][:3] or [column]
        spread = F.when(F.col(column).isNull(), F.pmod(F.xxhash64(*others), F.lit(1000))).otherwise(F.lit(-1))
        side = dimension.select(
            F.col("id").alias("_id"), F.when(F.col("id").isNull(), F.lit(-2)).otherwise(F.lit(-1)).cast("long").alias("_other"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in wanted],
        )
        out = out.withColumn("_spread", spread.cast("long"))
        out = out.join(side, (F.col(column) == F.col("_id")) & (F.col("_spread") == F.col("_other")), "left")
        out = out.drop("_id", "_other", "_spread")
    return out


def lanes(shipments: DataFrame, transfers: DataFrame, locations: DataFrame) -> DataFrame:
    """Shipments and transfers with the codes of both ends."""
    moves = shipments.select(F.lit("shipment").alias("kind"), "id", "origin_location_id", "destination_location_id").unionByName(
        transfers.select(F.lit("transfer").alias("kind"), "id", "origin_location_id", "destination_location_id")
    )
    out = moves
    for end in ("origin", "destination"):
        side = locations.select(
            F.col("id").alias(f"{end}_location_id"), F.col("location_code").alias(f"{end}_code"),
            F.col("country_code").alias(f"{end}_country"),
        )
        out = out.join(side, f"{end}_location_id")
    return out.withColumn("crosses_border", F.col("origin_country") != F.col("destination_country"))


def with_source(df: DataFrame, references: dict[str, str], parents: dict[str, DataFrame]) -> DataFrame:
    """Resolve the one set reference of a row to (source_kind, source_id, header_id).

    references maps a kind to its column, parents a kind to (id, header_id).
    Rows without a reference join on their own id, which matches nothing, so
    they do not gather in one task.
    """
    kind = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in references.items()])
    known = reduce(
        DataFrame.unionByName,
        [p.select(F.lit(k).alias("source_kind"), F.col("id").alias("_join"), "header_id") for k, p in parents.items()],
    )
    rows = df.withColumns({"source_kind": kind, "source_id": F.coalesce(*references.values())})
    return rows.withColumn("_join", F.coalesce("source_id", "id")).join(known, ["source_kind", "_join"], "left").drop("_join")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], day: str, valid_from: str, valid_to: str) -> DataFrame:
    """Rows of both sides with equal keys where the day lies in the closed range: an equi join with a residual."""
    pairs = reduce(lambda a, b: a & b, [left[k] == right[k] for k in keys])
    inside = left[day].between(right[valid_from], right[valid_to])
    return left.join(right, pairs & inside).drop(*[right[k] for k in keys])


def as_of(
    requests: DataFrame, facts: DataFrame, keys: list[str], request_time: str, fact_time: str,
    fact_id: str, values: list[str],
) -> DataFrame:
    """Each request with the values of the newest fact at or before its time (the higher id at equal times)."""
    asked = requests.select(
        *keys, F.col(request_time).alias("_time"), F.lit(1).alias("_side"), F.col("id").cast("string").alias("_tie"),
        F.struct(*requests.columns).alias("_request"),
    )
    facts_ = facts.select(
        *keys, F.col(fact_time).alias("_time"), F.lit(0).alias("_side"), F.col(fact_id).cast("string").alias("_tie"),
        F.struct(F.col(fact_time).alias("as_of_time"), *values).alias("_fact"),
    )
    both = asked.unionByName(facts_, allowMissingColumns=True)
    known = last_known(both, keys, ["_time", "_side", "_tie"], "_fact", "_found")
    return known.filter("_side = 1").select("_request.*", "_found.*")


def stock_as_of(movements: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Stock on hand by the last snapshot at or before the day of each movement."""
    requests = movements.select("id", "product_id", "location_id", F.to_date("event_timestamp").alias("moved_on"))
    return as_of(requests, snapshots, ["product_id", "location_id"], "moved_on", "snapshot_date", "id", ["on_hand_quantity"])


def unfulfilled(
    sales_orders: DataFrame, sales_lines: DataFrame, items: DataFrame, products: DataFrame, offers: DataFrame
) -> DataFrame:
    """Orders without lines, lines without shipment, products without supplier."""

    def without(df, kind, other, column):
        keys = other.select(F.col(column).alias("id")).filter("id is not null").distinct()
        return df.select("id").join(keys, "id", "left_anti").select(F.lit(kind).alias("kind"), "id")

    return (
        without(sales_orders, "order without lines", sales_lines, "sales_order_id")
        .unionByName(without(sales_lines, "line without shipment", items, "sales_order_line_id"))
        .unionByName(without(products, "product without supplier", offers, "product_id"))
    )


def in_demand(
    products: DataFrame, organizations: DataFrame, locations: DataFrame,
    sales_orders: DataFrame, sales_lines: DataFrame, offers: DataFrame,
) -> DataFrame:
    """Products with an order line, suppliers offering one of them, warehouses with an ordered line."""
    sold = sales_lines.select("product_id").distinct()
    suppliers = offers.join(sold, "product_id", "left_semi").select(F.col("supplier_id").alias("id")).distinct()
    ordered = sales_lines.select(F.col("sales_order_id").alias("id")).distinct()
    places = sales_orders.join(ordered, "id", "left_semi").select(F.col("assigned_warehouse_id").alias("id")).distinct()

    def used(df, kind, keys):
        return df.select("id").join(keys, "id", "left_semi").select(F.lit(kind).alias("kind"), "id")

    return (
        used(products, "product", sold.withColumnRenamed("product_id", "id"))
        .unionByName(used(organizations, "supplier", suppliers))
        .unionByName(used(locations, "location", places))
    )


def stock_reconcile(movements: DataFrame, balances: DataFrame) -> DataFrame:
    """Σ movements against Σ balances per product and location; both sides are kept."""
    keys = ["product_id", "location_id"]
    moved = movements.groupBy(*keys).agg(exact_sum(number("quantity")).alias("moved_quantity"))
    held = balances.groupBy(*keys).agg(exact_sum(number("on_hand_quantity")).alias("on_hand_quantity"))
    difference = F.coalesce("on_hand_quantity", F.lit(0.0)) - F.coalesce("moved_quantity", F.lit(0.0))
    return moved.join(held, keys, "full_outer").withColumn("difference", difference)
