"""Constraints as data-quality reports, and key changes that keep references whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow import schema
from stockflow.functions.exact import exact_sum
from stockflow.functions.measures import hours_between, number
from stockflow.functions.split_windows import previous_row


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def not_null_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Null count of every required column, one pass per table."""
    reports = []
    for name, df in tables.items():
        required = schema.required_columns(name)
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        reports.append(
            counts.unpivot([], required, "column_name", "null_count").withColumn("table_name", F.lit(name))
        )
    return union_all(reports)


def _named(numbered: DataFrame, names: list[dict[str, str]]) -> DataFrame:
    """Replace the number column `_ref` by the names it stands for: rows are counted by number, not by long names."""
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in names])
    return numbered.withColumn("_names", listed[F.col("_ref")]).select("_names.*", *[c for c in numbered.columns if c != "_ref"])


def key_duplicates(keys: list[tuple[str, DataFrame, list[str]]], rule: str) -> DataFrame:
    """Values of keys (table name, rows, one or more columns) that are null or occur more than once.

    All keys are counted by one aggregation, part by part: the joined form is only shown.
    """
    tagged = [
        df.select(F.lit(i).alias("_ref"), F.array(*[F.col(c).cast("string") for c in key]).alias("_parts"))
        for i, (_, df, key) in enumerate(keys)
    ]
    counted = union_all(tagged).groupBy("_ref", "_parts").agg(F.count(F.lit(1)).alias("occurrences"))
    unknown = F.exists("_parts", lambda part: part.isNull())
    shown = F.when(F.size("_parts") > 1, F.concat_ws("|", "_parts")).otherwise(F.col("_parts")[0])
    counted = counted.filter(unknown | (F.col("occurrences") > 1)).select("_ref", shown.alias("key"), "occurrences")
    names = [{"table_name": name, "rule": rule, "column_name": "+".join(key)} for name, _, key in keys]
    return _named(counted, names)


def pk_duplicates(tables: dict[str, DataFrame]) -> DataFrame:
    return key_duplicates([(name, df, ["id"]) for name, df in tables.items()], "primary_key")


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Repeated external ids and natural keys."""
    return key_duplicates(
        [(name, df, [c]) for name, df in tables.items() for c in schema.unique_columns(name)], "unique"
    )


def fk_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """References with no parent, with the rows that hold them.

    The references of all 42 kinds and the ids of the parents are counted together by one aggregation and one shuffle:
    two kinds that refer to the same parent have a block, in which a value has a count for each, and a mark if the parent
    has it. A value held by very many rows is one row per task in the shuffle. Nulls are counted by nobody; no filter
    on them parts the plans of tables that are made of the same rows.
    """
    keys = [k for k in schema.foreign_keys() if k.child in tables and k.parent in tables]
    parents = list(dict.fromkeys(k.parent for k in keys))
    blocks = [(p, kinds[n : n + 2]) for p in parents for kinds in [[i for i, k in enumerate(keys) if k.parent == p]] for n in range(0, len(kinds), 2)]
    place = {i: (n, slot) for n, (_, kinds) in enumerate(blocks) for slot, i in enumerate(kinds)}
    used = []
    for child in dict.fromkeys(k.child for k in keys):
        refs = [
            F.struct(F.lit(place[i][0]).alias("_block"), F.col(k.column).alias("key"), F.lit(place[i][1]).alias("_slot"))
            for i, k in enumerate(keys) if k.child == child
        ]
        used.append(tables[child].select(F.inline(F.array(*refs))))
    for parent in parents:
        marks = [F.struct(F.lit(n).alias("_block"), F.col("id").alias("key"), F.lit(-1).alias("_slot")) for n, (p, _) in enumerate(blocks) if p == parent]
        used.append(tables[parent].select(F.inline(F.array(*marks))))
    counts = [F.count(F.when(F.col("_slot") == slot, F.col("key"))).alias(f"_n{slot}") for slot in (0, 1)]
    counted = union_all(used).groupBy("_block", "key").agg(F.max(F.col("_slot") < 0).alias("_known"), *counts)
    numbers = F.array(*[F.array(*[F.lit(i) for i in kinds]) for _, kinds in blocks])[F.col("_block")]
    found = F.array(*[F.struct(F.get(numbers, F.lit(slot)).alias("_ref"), F.col(f"_n{slot}").alias("orphan_rows")) for slot in (0, 1)])
    held = counted.filter("not _known").select("key", F.inline(F.filter(found, lambda x: x.orphan_rows > 0)))
    names = [{"parent_table": k.parent, "table_name": k.child, "column_name": k.column} for k in keys]
    return _named(held, names)


def _set_count(columns: list[str]) -> Column:
    return reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in columns])


def single_source_check(movements: DataFrame) -> DataFrame:
    """Movements with more than one source reference."""
    return (
        movements.withColumn("source_count", _set_count(schema.MOVEMENT_SOURCES)).filter("source_count > 1")
        .select("id", "source_count")
    )


def length_check(tables: dict[str, DataFrame], longest: int = schema.CODE_LENGTH) -> DataFrame:
    """Values of the code columns that are longer than allowed."""
    reports = [
        df.filter(F.char_length(column) > longest).select(
            F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.col("id").alias("key"),
            F.col(column).alias("value"),
        )
        for name, df in tables.items()
        for column in schema.code_columns(name)
    ]
    return union_all(reports)


def enum_profile(tables: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """Values and counts of every enum column; known tells whether labels(table_name, column_name, value) has it."""
    reports = []
    for name, df in tables.items():
        names = schema.enum_columns(name)
        if names:
            pairs = df.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in names
            ])).alias("p"))
            counted = pairs.groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("row_count"))
            reports.append(counted.withColumn("table_name", F.lit(name)))
    listed = labels.dropDuplicates(["table_name", "column_name", "value"]).withColumn("known", F.lit(True))
    return (
        union_all(reports).join(listed, ["table_name", "column_name", "value"], "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
    )


def delete_plan(tables: dict[str, DataFrame], parent: str, ids: DataFrame) -> DataFrame:
    """What deleting the given ids would do: rows that go with them (CASCADE, followed on) and rows that block."""
    reports, frontier, level = [], {parent: ids.select("id")}, 1
    while frontier:
        reached: dict[str, list[DataFrame]] = {}
        for table, gone in frontier.items():
            for key in schema.foreign_keys(table):
                if key.child not in tables:
                    continue
                hit = tables[key.child].join(gone.select(F.col("id").alias(key.column)).distinct(), key.column, "left_semi")
                reports.append(
                    hit.select(
                        F.lit(level).alias("level"), F.lit(key.child).alias("table_name"),
                        F.lit(key.column).alias("column_name"), F.lit(key.on_delete).alias("action"), "id",
                    )
                )
                if key.on_delete == "CASCADE":
                    reached.setdefault(key.child, []).append(hit.select("id"))
        frontier, level = {t: union_all(parts).distinct() for t, parts in reached.items()}, level + 1
    return union_all(reports)


def apply_delete(tables: dict[str, DataFrame], parent: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the given rows and those that go with them. Check delete_plan for blocking rows first."""
    plan = delete_plan(tables, parent, ids).filter("action = 'CASCADE'")
    left = dict(tables)
    left[parent] = tables[parent].join(ids.select("id").distinct(), "id", "left_anti")
    for name in {k.child for k in schema.foreign_keys() if k.on_delete == "CASCADE" and k.child in tables}:
        gone = plan.filter(F.col("table_name") == name).select("id").distinct()
        left[name] = left[name].join(gone, "id", "left_anti")
    return left


def rekey(tables: dict[str, DataFrame], parent: str, mapping: DataFrame) -> dict[str, DataFrame]:
    """Rewrite ids of a parent table, and every reference to them, from mapping(old_id, new_id).

    Rows without the reference join on their own id, which maps to nothing, so
    they do not gather in one task.
    """
    pairs = mapping.select(F.col("old_id").alias("_key"), F.col("new_id").alias("_new"))

    def rewrite(df: DataFrame, column: str) -> DataFrame:
        key = F.coalesce(F.col(column), F.concat(F.lit("none:"), F.col("id")))
        joined = df.withColumn("_key", key).join(pairs, "_key", "left")
        return joined.withColumn(column, F.coalesce("_new", column)).select(*df.columns)

    out = dict(tables)
    if parent in out:
        out[parent] = rewrite(out[parent], "id")
    for key in schema.foreign_keys(parent):
        if key.child in out:
            out[key.child] = rewrite(out[key.child], key.column)
    return out


def _differences(df: DataFrame, table: str, rules: dict[str, tuple[Column, Column]], tolerance: float) -> DataFrame:
    """Rows whose stored value is not the computed one ({rule: (stored, computed)}); all rules read a row once."""
    checks = F.array(*[
        F.struct(F.lit(rule).alias("rule"), stored.cast("double").alias("stored"), computed.cast("double").alias("computed"))
        for rule, (stored, computed) in rules.items()
    ])
    return df.select(F.lit(table).alias("table_name"), "id", F.inline(checks)).select(
        "table_name", "rule", "id", "stored", "computed"
    ).filter(F.col("computed").isNull() | (F.abs(F.col("stored") - F.col("computed")) > tolerance))


def derived_columns_check(tables: dict[str, DataFrame], tolerance: float = 0.01) -> DataFrame:
    """Stored columns that differ from what the other columns give. A total with no parts counts as zero."""
    balances, shipments = tables["inventory_balances"], tables["shipments"]
    capacity, products = tables["production_capacity"], tables["products"]
    reports = [
        _differences(balances, "inventory_balances", {"available = on hand - reserved": (
            number("available_quantity"), number("on_hand_quantity") - number("reserved_quantity"),
        )}, tolerance),
        _differences(capacity.filter(number("planned_capacity_units") != 0), "production_capacity", {"utilization = actual / planned": (
            number("utilization_rate"), F.try_divide(number("actual_capacity_units"), number("planned_capacity_units")),
        )}, tolerance),
    ]
    for header, line, price, quantity in (
        ("sales_orders", "sales_order_lines", "unit_price_sek", "ordered_quantity"),
        ("purchase_orders", "purchase_order_lines", "unit_cost_sek", "ordered_quantity"),
    ):
        link = header[:-1] + "_id"
        sums = tables[line].groupBy(F.col(link).alias("id")).agg(
            exact_sum(number(quantity) * number(price)).alias("_sum")
        )
        totals = tables[header].select("id", "total_value_sek").join(sums, "id", "left")
        reports.append(_differences(totals, header, {
            "total = sum of lines": (number("total_value_sek"), F.coalesce("_sum", F.lit(0.0)))
        }, tolerance))
    sizes = products.select(F.col("id").alias("product_id"), number("weight_kg").alias("_w"), number("volume_m3").alias("_v"))
    loads = tables["shipment_items"].join(sizes, "product_id").groupBy(F.col("shipment_id").alias("id")).agg(
        exact_sum(number("quantity") * F.col("_w")).alias("_weight"), exact_sum(number("quantity") * F.col("_v")).alias("_volume"),
    )
    reports.append(_differences(shipments.join(loads, "id", "left"), "shipments", {
        "delay = actual - planned arrival": (number("delay_hours"), hours_between(F.col("planned_arrival_at"), F.col("actual_arrival_at"))),
        "weight = sum of items": (number("total_weight_kg"), F.coalesce("_weight", F.lit(0.0))),
        "volume = sum of items": (number("total_volume_m3"), F.coalesce("_volume", F.lit(0.0))),
    }, tolerance))
    return union_all(reports)


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Events whose number skips, repeats, or goes back in time against the event before (by number, then id)."""
    pairs = previous_row(
        events.select("id", "shipment_id", "event_sequence", "event_timestamp"), ["shipment_id"],
        ["event_sequence", "id"],
        {"previous_sequence": "event_sequence", "previous_timestamp": "event_timestamp"},
    )
    step = F.col("event_sequence") - F.col("previous_sequence")
    return (
        pairs.withColumns({
            "missing": F.greatest(step - 1, F.lit(0)),
            "repeated": step == 0,
            "time_reversed": F.col("event_timestamp") < F.col("previous_timestamp"),
        })
        .filter("missing > 0 or repeated or time_reversed")
        .select("shipment_id", "id", "event_sequence", "missing", "repeated", "time_reversed")
    )


# Pairs of columns of which the first must not be after the second.
ORDERED_PAIRS = [
    ("product_suppliers", "valid_from", "valid_to"),
    ("bill_of_materials", "effective_from", "effective_to"),
    ("production_orders", "planned_start_at", "planned_end_at"),
    ("production_orders", "actual_start_at", "actual_end_at"),
    ("shipments", "planned_departure_at", "planned_arrival_at"),
    ("shipments", "actual_departure_at", "actual_arrival_at"),
    ("shipment_events", "event_timestamp", "received_at"),
]


def range_order_check(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows with a range whose end is before its start."""
    reports = [
        tables[name].filter(F.col(start) > F.col(end)).select(
            F.lit(name).alias("table_name"), F.lit(f"{start} <= {end}").alias("rule"), "id"
        )
        for name, start, end in ORDERED_PAIRS
        if name in tables
    ]
    return union_all(reports)


def item_source_check(items: DataFrame, reference_of: dict[str, str]) -> DataFrame:
    """Shipment items with several references, none, or one that does not fit their document type."""
    references = sorted(schema.NULLABLE["shipment_items"])
    fits = reduce(
        lambda chain, pair: chain.when(F.col("source_document_type") == pair[0], F.col(pair[1]).isNotNull()),
        reference_of.items(), F.when(F.lit(False), F.lit(False)),
    )
    problem = (
        F.when(_set_count(references) > 1, "several references")
        .when(_set_count(references) == 0, "no reference")
        .when(~F.coalesce(fits, F.lit(False)), "reference does not fit type")
    )
    return items.withColumn("problem", problem).filter("problem is not null").select("id", "source_document_type", "problem")
