"""Ordered helpers against plain windows, with one key holding most rows."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockflow.functions.exact import exact_sum
from stockflow.functions.ranking import exact_percentiles, global_row_number, newest, tile
from stockflow.functions.split_windows import Stretches, last_known, previous_row, row_numbers, running_sums
from stockflow.operators import quality


def _hot(spark, n=3000):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 11 != 0, key).alias("k"), F.pmod(F.xxhash64("id"), F.lit(700)).cast("int").alias("t"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2000)) / 100.0 - 10).alias("v"),
    )


# from no cut at all to more cuts than one group of them; the hot key has a third of the rows
PARTS = [1, 7, 60]


def test_a_hot_key_is_cut_and_its_rows_are_shuffled_once(spark):
    cut = Stretches(_hot(spark), ["k"], ["t", "id"], 60)
    sizes = cut.rows.groupBy("k", "_part").count().collect()
    assert max(r["count"] for r in sizes) < 200 and sum(r.k == "hot" for r in sizes) > 16
    assert {r.k for r in cut.hot.select("k").distinct().collect()} <= {r.k for r in sizes if r._part}
    frame = running_sums(_hot(spark), ["k"], ["t", "id"], {"s": F.col("v")}, parts=60)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "_part" in line and "k#" in line]
    assert len(rows) == 2  # the rows, and the totals of the stretches


def test_row_numbers(spark):
    df = _hot(spark)
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("long") - 1)
    for parts in PARTS:
        _same(row_numbers(df, ["k"], ["t", "id"], "n", parts), expected, ["id", "n"])
    assert row_numbers(df.limit(0), ["k"], ["t", "id"], "n").count() == 0


def test_no_job_runs_while_a_plan_is_made(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    running_sums(_hot(spark), ["k"], ["t", "id"], {"s": F.col("v")})
    last_known(_hot(spark), ["k"], ["t", "id"], "v", "l")
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")


def _same(a, b, columns):
    left = sorted(map(tuple, a.select(*columns).collect()), key=str)
    right = sorted(map(tuple, b.select(*columns).collect()), key=str)
    assert left == right


def test_running_sum(spark):
    df = _hot(spark)
    plain = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumn("s", F.sum(F.col("v").cast("decimal(18,4)")).over(plain).cast("double"))
    for parts in PARTS:
        _same(running_sums(df, ["k"], ["t", "id"], {"s": F.col("v")}, parts=parts), expected, ["id", "s"])


def test_previous_row(spark):
    df = _hot(spark)
    expected = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("t", "id")))
    for parts in PARTS:
        _same(previous_row(df, ["k"], ["t", "id"], {"p": "v"}, parts), expected, ["id", "p"])


def test_last_known(spark):
    df = _hot(spark).withColumn("v", F.when(F.col("id") % 7 == 0, F.col("v")))
    plain = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumn("l", F.last("v", ignorenulls=True).over(plain))
    for parts in PARTS:
        _same(last_known(df, ["k"], ["t", "id"], "v", "l", parts), expected, ["id", "l"])


def test_sums_keep_small_values_and_hold_large_ones(spark):
    small = spark.range(1000).select(F.lit(3e-5).alias("v"))
    assert small.agg(exact_sum("v").alias("s")).first().s == 0.03
    large = spark.range(100).select(F.lit("k").alias("k"), F.col("id"), F.lit(1e9).alias("v"))
    assert large.agg(exact_sum(F.col("v") * F.col("v")).alias("s")).first().s == 1e20
    summed = running_sums(large, ["k"], ["id"], {"s": F.col("v") * F.col("v")}, parts=1)
    assert summed.agg(F.max("s")).first()[0] == 1e20


def test_newest(spark):
    df = _hot(spark).filter("k is not null")
    got = {r.k: r.id for r in newest(df, ["k"], ["t", "id"]).collect()}
    rows = df.toPandas().sort_values(["t", "id"]).groupby("k").last()
    assert got == rows["id"].to_dict()


def test_global_rank_and_tile_with_one_value_on_most_rows(spark):
    df = _hot(spark).withColumn("v", F.when(F.col("k") == "hot", F.lit(1.0)).otherwise(F.col("v")))
    expected = df.withColumn("n", F.row_number().over(Window.orderBy("v", F.md5(F.col("id").cast("string")), "id")).cast("long"))
    got = global_row_number(df, "v", "id", "n", bins=20)
    _same(got, expected, ["id", "n"])
    tiles = expected.withColumn("q", F.ntile(7).over(Window.orderBy("n")))
    _same(got.withColumn("q", tile(F.col("n"), F.lit(3000), 7)), tiles, ["id", "q"])


def test_tile_of_few_rows(spark):
    df = spark.range(1, 4).withColumn("q", F.ntile(5).over(Window.orderBy("id")))
    assert all(r.q == r.t for r in df.withColumn("t", tile(F.col("id"), F.lit(3), 5)).collect())


def test_percentiles_are_exact(spark):
    df = _hot(spark, 6000)
    probabilities = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    pdf = df.toPandas()
    for accuracy in (10000, 20):  # a coarse sketch must not change the result
        for r in exact_percentiles(df, ["k"], "v", probabilities, accuracy).collect():
            values = pdf.loc[pdf["k"] == r.k, "v"].to_numpy()
            for name, p in probabilities.items():
                assert abs(r[name] - np.quantile(values, p)) < 1e-9, (r.k, name)


def test_global_rank_puts_nulls_first(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("c", 1.0)], "id string, v double")
    assert {r.id: r.n for r in global_row_number(df, "v", "id", "n").collect()} == {"a": 1, "c": 2, "b": 3}


def test_references_and_parents_meet_in_one_shuffle(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {
        "products": make([("p1",), ("p2",), (None,)], "id string"),
        "organizations": make([("s1",)], "id string"),
        "product_suppliers": make([("a", "p1", "s1"), ("b", "p9", "s1"), ("c", "p9", "s2"), ("d", None, "p1"), ("e", "s1", None)], "id string, product_id string, supplier_id string"),
    }
    found = quality.fk_orphans(tables)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert sorted((r.parent_table, r.column_name, r.key, r.orphan_rows) for r in found.collect()) == [
        ("organizations", "supplier_id", "p1", 1), ("organizations", "supplier_id", "s2", 1),
        ("products", "product_id", "p9", 2), ("products", "product_id", "s1", 1),
    ]
