import random

import pytest

from stockflow.plans.density import connected_components, dbscan, scaled


def _brute(points, eps, least):
    near = {a: [b for b in points if sum((x - y) ** 2 for x, y in zip(points[a], points[b])) <= eps * eps] for a in points}
    core = {a for a in points if len(near[a]) >= least}
    label = {}
    for start in sorted(core):
        if start not in label:
            stack = [start]
            while stack:
                a = stack.pop()
                if a not in label:
                    label[a] = start
                    stack += [b for b in near[a] if b in core]
    for a in points:
        if a not in core:
            cores = [b for b in near[a] if b in core]
            label[a] = label[min(cores)] if cores else None
    return {a: (label[a], a in core) for a in points}


def _points(kind, dimensions):
    rng = random.Random(f"{kind}{dimensions}")
    if kind == "blobs":
        centres = [[rng.uniform(0, 6) for _ in range(dimensions)] for _ in range(4)]
        rows = [[c + rng.gauss(0, 0.35) for c in rng.choice(centres)] for _ in range(160)]
    elif kind == "hot":  # a third of the rows in one place, two dense neighbours
        rows = [[1.0] * dimensions] * 50 + [[1.0 + rng.uniform(0, 0.2) for _ in range(dimensions)] for _ in range(60)]
        rows += [[1.75 + rng.uniform(0, 0.1)] + [1.0] * (dimensions - 1) for _ in range(40)]
    else:
        rows = [[rng.uniform(0, 4) for _ in range(dimensions)] for _ in range(150)]
    return {f"p{i:03d}": tuple(r) for i, r in enumerate(rows)}


@pytest.mark.parametrize("kind,dimensions,eps,least", [
    ("blobs", 2, 0.4, 5), ("hot", 2, 0.6, 8), ("hot", 3, 0.5, 6), ("even", 1, 0.05, 4), ("even", 2, 0.35, 4),
])
def test_dbscan_equals_brute_force(spark, kind, dimensions, eps, least):
    points = _points(kind, dimensions)
    columns = [f"x{i}" for i in range(dimensions)]
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "id string, " + ", ".join(f"{c} double" for c in columns))
    got = {r.id: (r.cluster, r.is_core) for r in dbscan(df, "id", columns, eps, least).collect()}
    assert got == _brute(points, eps, least)


def test_long_chain_is_one_component(spark):
    n = 70
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = spark.range(n - 1).selectExpr("id + 1 a", "id b").filter("a <> 40")
    got = {r.node: r.component for r in connected_components(nodes, edges).collect()}
    assert got == {i: 0 if i < 40 else 40 for i in range(n)}


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "id string, x double, y double")
    assert [tuple(r) for r in scaled(df, "id", ["x", "y"]).orderBy("id").collect()] == [("a", 1.0, 0.0), ("b", 3.0, 0.0)]
