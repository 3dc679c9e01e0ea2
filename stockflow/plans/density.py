"""Density clustering (DBSCAN) of up to three features on an eps grid.

Cells are so small that all points of one lie within eps of each other. Then
- a cell holding min_points is all core, without comparing its points;
- any other cell holds fewer than min_points, so comparing its points with
  those of the cells around it costs a constant per point;
- two full cells touch or not by comparing ever smaller boxes inside them.
Clusters are the connected cells.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.session import cut


def scaled(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns divided by their standard deviation (a constant column becomes zero)."""
    spread = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return df.select(key, *[
        (F.col(c).cast("double") / spread[c] if spread[c] else F.lit(0.0)).alias(c) for c in columns
    ])


def _offsets(dimensions: int) -> list[tuple[int, ...]]:
    """Cells that can hold a point within eps, as steps from a cell; the cell itself is left out."""
    reach = math.ceil(math.sqrt(dimensions))
    steps = itertools.product(range(-reach, reach + 1), repeat=dimensions)
    return [s for s in steps if any(s) and sum(max(abs(x) - 1, 0) ** 2 for x in s) <= dimensions]


def _with_cells_around(df: DataFrame, dimensions: int) -> DataFrame:
    """Each row once per neighbour cell2 of its cell."""
    steps = F.expr("array(" + ", ".join(f"array({', '.join(map(str, s))})" for s in _offsets(dimensions)) + ")")
    moved = F.array(*[F.col("cell")[i] + F.col("_step")[i] for i in range(dimensions)])
    return df.withColumn("_step", F.explode(steps)).withColumn("cell2", moved).drop("_step")


def _distance_squared(a: Column, b: Column, dimensions: int) -> Column:
    return reduce(Column.__add__, [(a[i] - b[i]) * (a[i] - b[i]) for i in range(dimensions)])


def _box_gap_squared(dimensions: int) -> Column:
    """Squared distance between the boxes (low, high) and (low2, high2)."""
    gaps = [
        F.greatest(F.lit(0.0), F.col("low")[i] - F.col("high2")[i], F.col("low2")[i] - F.col("high")[i]) for i in range(dimensions)
    ]
    return reduce(Column.__add__, [g * g for g in gaps])


def _boxes(points: DataFrame, width: float, dimensions: int) -> DataFrame:
    """Non-empty boxes of a width inside each cell: their extent, one of their points, how many they hold."""
    return points.groupBy("cell", F.array(*[F.floor(F.col("x")[i] / width) for i in range(dimensions)]).alias("box")).agg(
        F.array(*[F.min(F.col("x")[i]) for i in range(dimensions)]).alias("low"),
        F.array(*[F.max(F.col("x")[i]) for i in range(dimensions)]).alias("high"),
        F.min("x").alias("some"), F.count(F.lit(1)).alias("size"),
    )


def _side(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in names.items()])


def _full_cell_edges(full: DataFrame, eps: float, dimensions: int, levels: int = 8) -> DataFrame:
    """Pairs of full cells (cell, cell2) that hold points within eps of each other.

    Boxes are compared by one of their points (near enough: the cells touch)
    and by their extent (too far: they do not). Undecided pairs go on with
    boxes a quarter as wide; the few left at the end compare their points.
    """
    square = eps * eps
    cells = full.select("cell").distinct()
    open_ = cut(
        _with_cells_around(cells, dimensions).filter(F.col("cell") < F.col("cell2"))
        .join(_side(cells, {"cell": "cell2"}), "cell2", "left_semi").select("cell", "cell2")
    )
    touching, parents, width = [], None, eps / math.sqrt(dimensions)
    for level in range(levels):
        if open_.isEmpty():
            break
        boxes = _boxes(full, width, dimensions)
        other = {"cell": "cell2", "box": "box2", "low": "low2", "high": "high2", "some": "some2", "size": "size2"}
        if parents is None:
            pairs = open_.join(boxes, "cell").join(_side(boxes, other), "cell2")
        else:
            inside = F.array(*[F.floor(F.col("box")[i] / 4) for i in range(dimensions)])
            small = boxes.withColumn("parent", inside)
            pairs = parents.join(open_, ["cell", "cell2"], "left_semi").join(small, ["cell", "parent"]).join(
                _side(small, {**other, "parent": "parent2"}), ["cell2", "parent2"]
            )
        judged = cut(
            pairs.filter(_box_gap_squared(dimensions) <= square)
            .withColumn("near", _distance_squared(F.col("some"), F.col("some2"), dimensions) <= square)
            .select("cell", "cell2", "box", "box2", "near", "size", "size2")
        )
        touching.append(judged.filter("near").select("cell", "cell2").distinct())
        # boxes of one point each are decided
        undecided = judged.filter("not near and (size > 1 or size2 > 1)")
        open_ = cut(undecided.select("cell", "cell2").distinct().join(touching[-1], ["cell", "cell2"], "left_anti"))
        parents = undecided.select("cell", "cell2", F.col("box").alias("parent"), F.col("box2").alias("parent2"))
        width /= 4
    else:
        if not open_.isEmpty():
            boxed = full.withColumn("parent", F.array(*[F.floor(F.col("x")[i] / (width * 4)) for i in range(dimensions)]))
            pairs = parents.join(open_, ["cell", "cell2"], "left_semi").join(boxed, ["cell", "parent"]).join(
                _side(boxed, {"cell": "cell2", "parent": "parent2", "x": "x2"}), ["cell2", "parent2"]
            )
            touching.append(
                pairs.filter(_distance_squared(F.col("x"), F.col("x2"), dimensions) <= square).select("cell", "cell2").distinct()
            )
    return reduce(DataFrame.unionByName, touching) if touching else open_


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each can reach. edges(a, b) may be in one direction.

    Each round takes the smallest label around a node, then the label of that
    label, so the distance covered doubles; it ends when nothing changes.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_least"))
        lower = labels.join(around, "node", "left").select("node", F.col("component").alias("_old"), F.least("component", "_least").alias("_new"))
        jump = lower.select(F.col("node").alias("_new"), F.col("_new").alias("_next"))
        following = cut(lower.join(jump, "_new").select("node", "_old", F.least("_new", "_next").alias("component")))
        labels = following.select("node", "component")
        if following.filter("component < _old").isEmpty():
            return labels


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, min_points: int) -> DataFrame:
    """(key, cluster, is_core): the cluster is named by its smallest core key, null for noise.

    A border point joins the cluster of the smallest core key within eps. Rows
    at one place are handled as one point with a weight.
    """
    dimensions = len(columns)
    if not 1 <= dimensions <= 3:
        raise ValueError("one to three features")
    square, width = eps * eps, eps / math.sqrt(dimensions)
    placed = df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    points = placed.groupBy("x").agg(F.min(key).alias("point"), F.count(F.lit(1)).alias("weight")).withColumn(
        "cell", F.array(*[F.floor(F.col("x")[i] / width) for i in range(dimensions)])
    )
    points = cut(points)
    cells = points.groupBy("cell").agg(F.sum("weight").alias("cell_weight"))
    points = points.join(cells, "cell")
    full = points.filter(F.col("cell_weight") >= min_points)
    thin = points.filter(F.col("cell_weight") < min_points)

    # thin points with everything within eps outside their cell; the cell itself is all within eps
    other = {"cell": "cell2", "x": "x2", "point": "point2", "weight": "weight2", "cell_weight": "cell_weight2"}
    near = cut(
        _with_cells_around(thin, dimensions).join(_side(points, other), "cell2")
        .filter(_distance_squared(F.col("x"), F.col("x2"), dimensions) <= square)
        .select("point", "cell", "cell_weight", "point2", "cell2", "weight2", "cell_weight2")
    )
    around = near.groupBy("point").agg(F.sum("weight2").alias("_around"))
    thin_core = cut(
        thin.join(around, "point", "left").filter(F.col("cell_weight") + F.coalesce("_around", F.lit(0)) >= min_points)
        .select("point", "cell")
    )
    core = thin_core.unionByName(full.select("point", "cell"))

    # cells that hold a core point are the nodes
    core2 = thin_core.select(F.col("point").alias("point2"), F.lit(True).alias("_core2"))
    to_core = near.join(core2, "point2", "left").filter((F.col("cell_weight2") >= min_points) | F.col("_core2"))
    thin_edges = to_core.join(thin_core.select("point"), "point", "left_semi").select(F.col("cell").alias("a"), F.col("cell2").alias("b"))
    full_edges = _full_cell_edges(full.select("cell", "x"), eps, dimensions).select(F.col("cell").alias("a"), F.col("cell2").alias("b"))
    nodes = core.select(F.col("cell").alias("node")).distinct()
    components = connected_components(nodes, thin_edges.unionByName(full_edges)).withColumnRenamed("node", "cell")

    core_labels = core.join(components, "cell")
    names = core_labels.groupBy("component").agg(F.min("point").alias("cluster"))
    named = cut(core_labels.join(names, "component").select("point", "cell", "cluster"))

    # border points: the smallest core key within eps, in the own cell or around it
    own = thin.join(thin_core, "point", "left_anti").select("point", "cell")
    in_cell = own.join(_side(named, {"cell": "cell", "point": "point2", "cluster": "cluster"}), "cell").select("point", "point2", "cluster")
    outside = to_core.join(own.select("point"), "point", "left_semi").join(
        _side(named, {"point": "point2", "cluster": "cluster"}), "point2"
    ).select("point", "point2", "cluster")
    border = in_cell.unionByName(outside).groupBy("point").agg(F.min_by("cluster", "point2").alias("cluster"))
    labels = named.select("point", "cluster", F.lit(True).alias("is_core")).unionByName(
        border.withColumn("is_core", F.lit(False))
    )
    where = points.select("x", "point").join(labels, "point", "left")
    return placed.join(where, "x").select(key, "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))
