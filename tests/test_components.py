import random

import pytest

from zonata.operators import components as C


def flood(pixels, connectivity):
    left, out = set(pixels), {}
    for p in sorted(pixels):
        if p in left:
            stack = [p]
            left.discard(p)
            while stack:
                y, x = stack.pop()
                out[y, x] = p
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (connectivity == 8 or 0 in (dy, dx)) and (y + dy, x + dx) in left:
                            left.discard((y + dy, x + dx))
                            stack.append((y + dy, x + dx))
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels(spark, connectivity):
    rng = random.Random(connectivity)
    pixels = [(y, x) for y in range(25) for x in range(30) if rng.random() < 0.45]
    df = spark.createDataFrame([(1, y, x) for y, x in pixels], "k int, y int, x int").repartition(3)
    got = {(r["y"], r["x"]): (r["label"]["y"], r["label"]["x0"]) for r in C.label(spark, df, ["k"], connectivity).collect()}
    want = flood(pixels, connectivity)
    groups = lambda m: {frozenset(p for p in m if m[p] == v) for v in set(m.values())}
    assert groups(got) == groups(want)


def test_distance(spark):
    rng = random.Random(3)
    m = {(y, x): int(rng.random() < 0.9) for y in range(12) for x in range(15)}
    df = spark.createDataFrame([(1, y, x, v) for (y, x), v in m.items()], "k int, y int, x int, m int")
    zeros = [p for p, v in m.items() if not v]
    for r in C.distance(df, ["k"]).collect():
        assert abs(r["d"] - min(((r["y"] - a) ** 2 + (r["x"] - b) ** 2) ** 0.5 for a, b in zeros)) < 1e-9


def test_thinning_keeps_components_and_loops_stay(spark):
    pixels = [(y, x) for y in range(20) for x in range(20) if 36 <= (y - 10) ** 2 + (x - 10) ** 2 <= 81] + [(y, x) for y in range(3) for x in range(25, 40)]
    df = spark.createDataFrame([(1, y, x) for y, x in pixels], "k int, y int, x int")
    thin = {(r["y"], r["x"]) for r in C.thin(spark, df, ["k"]).collect()}
    assert thin < set(pixels) and len(set(flood(thin, 8).values())) == 2
    skeleton = spark.createDataFrame([(1, y, x) for y, x in thin], "k int, y int, x int")
    grid = spark.createDataFrame([(1, y, x) for y in range(-1, 22) for x in range(-1, 42)], "k int, y int, x int")
    assert C.faces(spark, skeleton, grid, ["k"]).select("label").distinct().count() == 1


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="share"):
        C.shared(Session())
