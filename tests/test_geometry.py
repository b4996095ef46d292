import math

from pyspark.sql import functions as F

from zonata.operators import geometry as G


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_rectangle_and_concave_ring(spark):
    rows = [(1, ring((0, 0), (4, 0), (4, 2), (0, 2))), (2, ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4)))]
    df = spark.createDataFrame(rows, "id int, ring array<struct<x: double, y: double>>")
    r, h = F.col("ring"), G.hull_measures("ring")
    one, two = df.select(
        "id", G.area(r).alias("a"), G.perimeter(r).alias("p"), h["hull_area"].alias("ha"), h["bounding_radius"].alias("br"), h["elongation_true"].alias("e"),
        G.centroid(r).alias("c"), G.bend_ratio(r).alias("b"), G.contains_point(r, F.lit(2.0), F.lit(1.5)).alias("in"), F.size(G.simplify(5.0)(r)).alias("s"),
    ).orderBy("id").collect()
    assert (one["a"], one["p"], one["ha"]) == (8, 12, 8) and math.isclose(one["br"], math.sqrt(5)) and one["e"] == 0.5
    assert (one["c"]["x"], one["c"]["y"], one["b"], one["in"]) == (2, 1, 1, True)
    assert two["a"] == 10 and two["ha"] == 16 and not two["in"] and math.isclose(two["br"], math.sqrt(8))
