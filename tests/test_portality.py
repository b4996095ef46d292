"""Contours, portality maps and vessels on small shapes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from zonata.operators import catalog as L
from zonata.operators import components as C
from zonata.operators import portality as P
from zonata.operators import spatial as S


def traced(spark, pixels):
    df = spark.createDataFrame([(0, y, x, 1) for y, x in pixels], "image int, y int, x int, label int")
    return P.contours(df, ["image"]).collect()


def test_contours_of_small_regions(spark):
    assert [(r["kind"], len(r["ring"])) for r in traced(spark, [(2, 3)])] == [("Point", 1)]
    assert [(r["kind"], len(r["ring"])) for r in traced(spark, [(2, 3), (2, 4)])] == [("Line", 2)]
    ring = traced(spark, [(y, x) for y in range(3) for x in range(3)])[0]["ring"]
    assert [(p["y"], p["x"]) for p in ring] == [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    assert traced(spark, [(0, 0), (1, 1), (1, 2)])[0]["kind"] == "Polygon"
    empty = spark.createDataFrame([], "image int, y int, x int, label int")
    assert P.contours(empty, ["image"]).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_contour_is_the_border_that_the_outside_touches(seed):
    """Against flooding the outside with four neighbours: the ring visits exactly the pixels next to it."""
    rng = random.Random(seed)
    region, at = {(0, 0)}, (0, 0)
    for _ in range(60):
        at = at[0] + rng.choice((-1, 0, 1)), at[1] + rng.choice((-1, 0, 1))
        region.add(at)
    lo = min(min(p) for p in region) - 1
    hi = max(max(p) for p in region) + 1
    out, todo = set(), [(lo, lo)]
    while todo:
        y, x = todo.pop()
        if (y, x) in out or (y, x) in region or not (lo <= y <= hi and lo <= x <= hi):
            continue
        out.add((y, x))
        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    want = {(y, x) for y, x in region if {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & out}
    assert set(P._trace(region)) == want


def test_portality_runs_from_portal_to_central(spark):
    kinds = {0: "portal", 10: "central"}
    rows = [(0, 0, x, 5, kinds.get(x, "tissue")) for x in range(11)] + [(1, 0, x, 5, "tissue") for x in range(3)]
    got = P.portality_map(spark.createDataFrame(rows, "image int, y int, x int, v int, kind string"), ["image"], scale=2.0).collect()
    assert {(r["image"], r["x"]): (r["d_portal"], r["d_central"]) for r in got} == {(0, x): (2.0 * x, 20.0 - 2 * x) for x in range(1, 10)}
    assert all(r["portality"] == pytest.approx(r["x"] / 10) for r in got)


def test_split_vessels(spark):
    box = lambda a, b: [{"x": x, "y": y} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    ring = "array<struct<x: double, y: double>>"
    faces = spark.createDataFrame([(1, box(1.0, 9.0)), (2, box(-1.0, 11.0)), (3, box(-3.0, 5.0)), (4, box(40.0, 50.0))], f"geom_id int, ring {ring}")
    vessels = spark.createDataFrame([(7, box(0.0, 10.0))], f"vessel_id int, ring {ring}")
    got = S.split_vessels(faces, vessels, [], 8.0)
    assert {r["geom_id"]: r["is_vessel"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: False}
    assert {r["is_vessel"] for r in S.split_vessels(faces, vessels.limit(0), [], 8.0).select(F.col("is_vessel")).collect()} == {False}


def test_shapes_are_matched_as_one_by_one(spark):
    """Against taking the cheapest pair of all, again and again; turned, grown and shifted shapes cost nothing."""
    C.shared(spark)
    rng = random.Random(3)

    def star(n):
        return [(rng.uniform(2, 6) * math.cos(2 * math.pi * k / n), rng.uniform(2, 6) * math.sin(2 * math.pi * k / n)) for k in range(n)]

    shapes = {i: star(9) for i in range(12)}
    turned = {100: [(-2 * y + 1, 2 * x - 1) for x, y in shapes[4]]}
    table = lambda d, c: spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in d.items()], f"{c} int, ring array<struct<x: double, y: double>>")
    left = table({i: r for i, r in shapes.items() if i < 6}, "geom_id")
    right = table({i: r for i, r in shapes.items() if i >= 6} | turned, "other_id")
    pairs = S.shape_pairs(left, right, [], 5.0)
    costs = {(r["geom_id"], r["other_id"]): r["cost"] for r in pairs.collect()}
    assert len(costs) == 6 * 7 and costs[4, 100] < 1e-9
    want = {}
    while costs:
        best = min(costs, key=lambda k: (costs[k], k))
        want[best] = costs[best]
        costs = {k: v for k, v in costs.items() if k[0] != best[0] and k[1] != best[1]}
    assert {(r["geom_id"], r["other_id"]) for r in L.greedy_assignment(pairs, "geom_id", "other_id", "cost").collect()} == set(want)
