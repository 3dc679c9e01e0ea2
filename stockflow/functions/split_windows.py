"""Ordered windows that survive a very large key.

A plain window sorts all rows of a key in one task. Here a key with more than its share of the rows is cut into
stretches of its order, about as many rows each as one of `parts` equal parts of the table: the window runs inside
(key, stretch), and one small row per stretch carries the state on to the next ones. All other keys have one stretch.
The cuts come from a sample by hash, about SAMPLE * parts rows, so they follow from the rows alone: a task that runs
again finds the same ones. There are about `parts` of them at most, whatever the table, so they and the carried rows are
broadcast; the rows themselves are shuffled once, by the window. Results equal those of the plain window, nulls
included. Nothing is run while the plan is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stockflow.functions.exact import SCALE, decimal

#: rows of the sample in one part
SAMPLE = 50
#: cuts are looked up in groups of this many
GROUP = 16


def _upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join in which nulls are equal, to a side of at most as many rows as parts; it brings only its other columns."""
    right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(F.broadcast(right), same, how).drop(*[f"_on_{c}" for c in on])


def _added(a: Column, b: Column, scale: int) -> Column:
    """a + b as decimals; one digit less before the point, so that the sum keeps its scale."""
    return a.cast(f"decimal(37,{scale})") + b.cast(f"decimal(37,{scale})")


def _either(own: Column, carried: Column, scale: int) -> Column:
    return F.when(own.isNull(), carried).when(carried.isNull(), own).otherwise(_added(own, carried, scale))


class Stretches:
    """The rows with `_part`, the number of their stretch of the key; `hot` are those of keys with several."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], parts: int | None = None):
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order = keys, order
        placed = df.select(*keys, F.struct(*order).alias("_at"))
        share = SAMPLE * parts / F.greatest(placed.agg(F.count(F.lit(1))).scalar(), F.lit(1))
        sample = placed.filter(F.pmod(F.xxhash64(*keys, "_at"), F.lit(1 << 40)) < share * (1 << 40))
        # rows that repeat are one, so they cannot swell the sample
        listed = sample.groupBy(*keys).agg(F.sort_array(F.collect_set("_at")).alias("_all"))
        cuts = listed.select(*keys, F.filter("_all", lambda c, i: i % SAMPLE == SAMPLE - 1).alias("_cuts")).filter(F.size("_cuts") > 0)
        self.cuts = cuts.withColumn("_groups", F.filter("_cuts", lambda c, i: i % GROUP == GROUP - 1))
        self.rows, self.hot = self._numbered(df, "left"), self._numbered(df, "inner")
        self.inside = Window.partitionBy(*keys, "_part").orderBy(*order)
        self.before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def _numbered(self, df: DataFrame, how: str) -> DataFrame:
        at = F.struct(*self.order)
        passed = lambda cuts: F.size(F.filter(cuts, lambda c: c <= at))
        rows = _meet(df, self.cuts, self.keys, how).withColumn("_above", F.when(F.col("_cuts").isNotNull(), GROUP * passed("_groups")))
        part = F.col("_above") + passed(F.slice("_cuts", F.col("_above") + 1, GROUP))
        return rows.withColumn("_part", F.coalesce(part, F.lit(0))).drop("_cuts", "_groups", "_above")

    def carry(self, local: DataFrame, states: dict[str, tuple[Column, callable]]) -> DataFrame:
        """The rows with, per name, what all stretches before theirs come to; {name: (aggregate, its sum or last)}."""
        totals = self.hot.groupBy(*self.keys, "_part").agg(*[total.alias(n) for n, (total, _) in states.items()])
        carried = totals.select(*self.keys, "_part", *[then(n).over(self.before).alias(n) for n, (_, then) in states.items()])
        return _meet(local, carried, [*self.keys, "_part"])


def _last(name: str) -> Column:
    return F.last(name, ignorenulls=True)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Add the number of the row, from 0, per key in the given order."""
    cut = Stretches(df, keys, order, parts)
    local = cut.rows.withColumn("_local", F.row_number().over(cut.inside))
    joined = cut.carry(local, {"_count": (F.count(F.lit(1)), F.sum)})
    return joined.select(*df.columns, (F.col("_local") - 1 + F.coalesce("_count", F.lit(0))).cast("long").alias(out))


def running_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], scale: int = SCALE, parts: int | None = None
) -> DataFrame:
    """Add, per key in the given order, the sum of each column up to and including the row."""
    cut = Stretches(df, keys, order, parts)
    amounts = {n: decimal(c, scale) for n, c in sums.items()}
    local = cut.rows.withColumns({f"_l_{n}": F.sum(a).over(_upto(cut.inside)) for n, a in amounts.items()})
    joined = cut.carry(local, {f"_c_{n}": (F.sum(a), F.sum) for n, a in amounts.items()})
    total = lambda n: _either(F.col(f"_l_{n}"), F.col(f"_c_{n}"), scale).cast("double").alias(n)
    return joined.select(*df.columns, *map(total, sums))


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], previous: dict[str, str], parts: int | None = None
) -> DataFrame:
    """Add the named columns of the row before, per key in the given order ({new name: column})."""
    held = df.withColumn("_row", F.struct(*[F.col(c).alias(n) for n, c in previous.items()]))
    cut = Stretches(held, keys, order, parts)
    local = cut.rows.withColumn("_before", F.lag("_row").over(cut.inside))
    joined = cut.carry(local, {"_end": (F.max_by("_row", F.struct(*order)), _last)})
    joined = joined.withColumn("_before", F.coalesce("_before", "_end"))
    return joined.select(*df.columns, *[F.col(f"_before.{n}").alias(n) for n in previous])


def last_known(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, parts: int | None = None
) -> DataFrame:
    """Add the newest non-null value at or before the row, per key in the given order."""
    cut = Stretches(df, keys, order, parts)
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    local = cut.rows.withColumn("_local", F.last(value, ignorenulls=True).over(_upto(cut.inside)))
    joined = cut.carry(local, {"_end": (F.max_by(value, known), _last)})
    return joined.select(*df.columns, F.coalesce("_local", "_end").alias(out))
