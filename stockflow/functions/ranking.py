"""Newest rows, global ranks and exact percentiles without one-task sorts."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the given order.

    A row-number filter of one is cut per task before the shuffle, so a large
    key sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_place")


def _edges(value: str, bins: int) -> Column:
    return F.percentile_approx(F.col(value).cast("double"), [i / bins for i in range(1, bins)], 10 * bins)


def global_row_number(
    df: DataFrame, value: str, key: str, out: str, bins: int = 200, edges: list[float] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add the 1-based place of each row over the whole table, by (value, md5(key), key).

    A sketch gives bin edges, which only balance the work. Values equal to an
    edge get bins of their own, cut further by the hash, so one value held by
    many rows is also spread. Rows are numbered inside a bin and shifted by the
    counts of the bins before it. `counted` gives the same rows by a shorter way,
    for those counts.
    """
    edges = (df.select(_edges(value, bins)).first()[0] if edges is None else edges) or []
    edges = sorted({e for e in edges if math.isfinite(e)} or {0.0})
    # the number of edges at or below the value, found by binary search
    bucket = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_number", outputCol="_bucket", handleInvalid="keep")
    points = F.array(*[F.lit(float(e)) for e in edges])

    def binned(rows: DataFrame) -> DataFrame:
        numbered = rows.withColumn("_number", F.col(value).cast("double")).withColumn("_hash", F.md5(F.col(key).cast("string")))
        upto = F.coalesce(F.col("_bucket").cast("int"), F.lit(0))  # nulls come first
        on_edge = F.coalesce(F.get(points, upto - 1) == F.col("_number"), F.lit(False))
        return bucket.transform(numbered).withColumns({
            "_bin": 2 * upto - on_edge.cast("int"), "_slice": F.when(on_edge, F.substring("_hash", 1, 2)).otherwise(""),
        }).drop("_number", "_bucket")

    source = df if counted is None else counted
    sizes = binned(source.select(key, value)).groupBy("_bin", "_slice").agg(F.count(F.lit(1)).alias("_size"))
    # at most 2·bins + 256 slices per edge value: a bounded table, whatever the data
    before = Window.orderBy("_bin", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bin", "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bin", "_slice").orderBy(value, "_hash", key)
    placed = binned(df).withColumn("_place", F.row_number().over(inside)).join(offsets, ["_bin", "_slice"])
    return placed.withColumn(out, (F.col("_place") + F.col("_offset")).cast("long")).select(*df.columns, out)


def tile(place: Column, total: Column, tiles: int) -> Column:
    """The ntile of a 1-based place among total rows: the first (total mod tiles) tiles hold one row more."""
    size = F.floor(total / tiles)
    extra = total % tiles
    long_part = extra * (size + 1)
    return (
        F.when(place <= long_part, F.floor((place - 1) / (size + 1)) + 1)
        .otherwise(extra + F.floor((place - 1 - long_part) / F.greatest(size, F.lit(1))) + 1)
        .cast("int")
    )


def with_tiles(df: DataFrame, tiles: dict[str, str], key: str, count: int, bins: int = 200) -> DataFrame:
    """Add ntiles over the whole table ({new name: value}), each by (value, md5(key), key)."""
    facts = df.agg(F.count(F.lit(1)).alias("n"), *[_edges(v, bins).alias(out) for out, v in tiles.items()]).first()
    plain = df
    for out, value in tiles.items():
        placed = global_row_number(df, value, key, "_row", bins, facts[out], plain)
        df = placed.withColumn(out, tile(F.col("_row"), F.lit(facts["n"]), count)).drop("_row")
    return df


_SALTS = 16


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(_SALTS)).cast("int"))


def _every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])))


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], accuracy: int = 10000
) -> DataFrame:
    """Interpolated percentiles per key, exact, for keys of any size.

    Equal values are counted first. A sketch brackets the two ranks each
    percentile lies between; values below the bracket are only counted, those
    inside it are ordered. Should a rank fall outside its bracket, the whole
    range is ordered instead. The values of a key are spread over salts where
    they meet the key's sketch.
    """
    names = list(probabilities)
    slack = 4.0 / accuracy
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    values = _salted(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))

    def bracket(sign):
        points = [min(1.0, max(0.0, p + sign * slack)) for p in probabilities.values()]
        return F.percentile_approx("_v", points, accuracy)

    facts = ["_n", "_lo", "_hi", "_min", "_max"]
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"), bracket(-1).alias("_lo"), bracket(1).alias("_hi"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    )
    upto = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("_c"))), F.lit(0))
    counted = values.join(_every_salt(sketch), [*keys, "_salt"]).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in facts],
        *[upto(F.col("_v") < F.col("_lo")[i]).alias(f"_under{i}") for i in range(len(names))],
        *[upto(F.col("_v") <= F.col("_hi")[i]).alias(f"_upto{i}") for i in range(len(names))],
    )

    def target(i, p):
        exact = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(exact), F.ceil(exact)
        held = (F.col(f"_under{i}") <= low) & (high < F.col(f"_upto{i}"))
        return F.struct(
            F.lit(i).alias("i"), low.alias("low"), high.alias("high"), (exact - low).alias("part"),
            F.when(held, F.col("_lo")[i]).otherwise(F.col("_min")).alias("from"),
            F.when(held, F.col("_hi")[i]).otherwise(F.col("_max")).alias("to"),
            F.when(held, F.col(f"_under{i}")).otherwise(F.lit(0)).alias("under"),
        )

    targets = counted.select(*keys, F.array(*[target(i, p) for i, p in enumerate(probabilities.values())]).alias("_t"))
    inside = values.join(_every_salt(targets), [*keys, "_salt"]).select(
        *keys, "_v", "_c", F.explode(F.expr("filter(_t, t -> _v >= t.from and _v <= t.to)")).alias("_t")
    )
    running = Window.partitionBy(*keys, "_t.i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_end", F.col("_t.under") + F.sum("_c").over(running))
    holds = lambda rank: (F.col("_end") > F.col(rank)) & (F.col("_end") - F.col("_c") <= F.col(rank))

    def result(i, name):
        mine = F.col("_t.i") == i
        low = F.max(F.when(mine & holds("_t.low"), F.col("_v")))
        high = F.max(F.when(mine & holds("_t.high"), F.col("_v")))
        part = F.max(F.when(mine, F.col("_t.part")))
        return (low + (high - low) * part).alias(name)

    return ranked.groupBy(*keys).agg(*[result(i, n) for i, n in enumerate(names)])
