"""Labelled regions, rasters, samples and file round trips on small tables."""

import pytest
from pyspark.sql import functions as F

from zonata.operators import regions as G
from zonata.sources import files as S


@pytest.fixture(scope="module")
def square(spark):
    """A square of three by three and a single pixel."""
    rows = [(0, y, x, 1) for y in range(3) for x in range(3)] + [(0, 9, 9, 2)]
    return spark.createDataFrame(rows, "image int, y int, x int, label int")


def test_adjacency(square):
    got = {r["label"]: r for r in G.adjacency(square, ["image"]).collect()}
    assert got[1]["pixels"] == 9 and got[2]["adjacency"] == [1.0] + [0.0] * 8
    want = [0.0] * 9
    want[3], want[5], want[8] = 4 / 9, 4 / 9, 1 / 9
    assert got[1]["adjacency"] == pytest.approx(want)
    assert G.adjacency(square.limit(0), ["image"]).count() == 0


def test_rim_and_mix(square, spark):
    assert {r["label"]: r["count"] for r in G.rim(square, ["image"]).groupBy("label").count().collect()} == {1: 16, 2: 8}
    clusters = spark.createDataFrame([(0, -1, 0, 0), (0, -1, 1, 1), (0, 1, 1, 1), (0, 3, 3, None)], "image int, y int, x int, cluster int")
    assert [tuple(r) for r in G.rim_mix(square, clusters, ["image"], 2).collect()] == [(0, 1, 2, 0.5, 0.5)]


def test_raster_is_null_where_nothing_is_known(spark, square):
    got = G.raster(spark.createDataFrame([(0,), (1,)], "image int"), square.withColumn("d", F.lit(2.0)), ["image"], F.lit(4), F.lit(5), "d").collect()
    assert len(got) == 40 and sum(r["d"] is not None for r in got) == 9


def test_samples_hold_smaller_ones(spark):
    d = spark.range(20000)
    n = {r["rate"]: r["count"] for r in G.sampled_at(d, [0.01, 0.1, 1.0], "id").groupBy("rate").count().collect()}
    assert n[1.0] == 20000 and abs(n[0.1] - 2000) < 250 and abs(n[0.01] - 200) < 80
    small, large = ({r["id"] for r in G.sample(d, s, "id").collect()} for s in (0.01, 0.1))
    assert small < large and len(small) == n[0.01]


def test_files_of_a_tree(spark, tmp_path):
    lobules = spark.createDataFrame([("S1", 0, 7, [0, 5]), ("S1", 0, 8, None)], "subject string, roi int, slide int, vessel_index array<int>")
    vessels = spark.createDataFrame([("S1", 0, 7, 0, 2.5)], "subject string, roi int, slide int, i int, size double")
    S.write_slide_tree(lobules, vessels, f"file://{tmp_path}/t")
    (tmp_path / "t" / "lobules" / ".hidden").mkdir()
    got = S.with_vessels(*S.read_slide_tree(spark, f"file://{tmp_path}/t"), F.col("size")).collect()
    assert sorted((r["slide"], r["i"] if r["i"] is not None else -1, r["value"] or 0.0) for r in got) == [(7, 0, 2.5), (7, 5, 0.0), (8, -1, 0.0)]


def test_cached_is_made_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [S.cached(spark, f"file://{tmp_path}/c", make).count() for _ in range(2)] == [3, 3] and len(made) == 1
