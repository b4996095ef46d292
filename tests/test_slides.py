import heapq
import math
import random

import numpy as np
import pytest

from zonata.operators import clahe, components, overlay, raster, tiling, watershed
from zonata.sources import tiles

PIXEL = "image_id long, y int, x int, v double"


def queue_flood(height, marker):
    """The whole raster by one priority queue, written apart from the operator."""
    h, w = height.shape
    heap, out = [], np.zeros((h, w), np.int64)
    for y in range(h):
        for x in range(w):
            if marker[y, x] and not math.isnan(height[y, x]):
                heapq.heappush(heap, ((height[y, x], 0, marker[y, x]), y, x))
    while heap:
        (level, steps, label), y, x = heapq.heappop(heap)
        if out[y, x]:
            continue
        out[y, x] = label
        for i, j in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= i < h and 0 <= j < w and not out[i, j] and not math.isnan(height[i, j]):
                heapq.heappush(heap, ((height[i, j], 0, label) if height[i, j] > level else (level, steps + 1, label), i, j))
    return out


@pytest.mark.parametrize("tile", [4, 64])
def test_watershed_against_one_queue(spark, tile):
    rng = np.random.default_rng(4)
    rows, seeds, want = [], [], {}
    for image in range(6):
        height = rng.integers(0, 4 if image % 2 else 50, (13, 11)).astype(float)
        height[rng.random((13, 11)) < 0.15 * (image % 3)] = np.nan
        marker = np.where(rng.random((13, 11)) < 0.06, rng.integers(1, 99, (13, 11)), 0)
        rows += [(image, y, x, float(height[y, x])) for y in range(13) for x in range(11) if not np.isnan(height[y, x])]
        seeds += [(image, y, x, int(marker[y, x])) for y in range(13) for x in range(11) if marker[y, x]]
        found = queue_flood(height, marker)
        want |= {(image, y, x): int(found[y, x]) for y in range(13) for x in range(11) if found[y, x]}
    got = watershed.watershed(spark, spark.createDataFrame(rows, PIXEL), spark.createDataFrame(seeds, "image_id long, y int, x int, label long"), ["image_id"], tile=tile)
    assert {(r["image_id"], r["y"], r["x"]): r["label"] for r in got.collect()} == want


def test_watershed_edges(spark):
    none = spark.createDataFrame([], PIXEL)
    seed = spark.createDataFrame([(1, 0, 0, 7), (1, 0, 0, 3), (1, 5, 5, 9)], "image_id long, y int, x int, label long")
    assert watershed.watershed(spark, none, seed, ["image_id"]).count() == 0
    line = spark.createDataFrame([(1, 0, x, 1.0) for x in (0, 1, 2, 4)], PIXEL)
    assert sorted((r["x"], r["label"]) for r in watershed.watershed(spark, line, seed, ["image_id"], tile=2).collect()) == [(0, 3), (1, 3), (2, 3)]


def plain_clahe(img, clip, rows, columns):
    h, w = img.shape
    if h % rows or w % columns:
        img = np.pad(img, ((0, rows - h % rows), (0, columns - w % columns)), mode="reflect")
    ch, cw = img.shape[0] // rows, img.shape[1] // columns
    limit = max(1, int(clip * ch * cw / 256))
    lut = np.zeros((rows, columns, 256))
    for i in range(rows):
        for j in range(columns):
            hist = np.bincount(img[i * ch : (i + 1) * ch, j * cw : (j + 1) * cw].ravel(), minlength=256)
            over = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + over // 256
            left, step = over % 256, max(1, 256 // (over % 256)) if over % 256 else 1
            for k in range(0, 256, step):
                if not left:
                    break
                hist[k] += 1
                left -= 1
            lut[i, j] = np.minimum(255, np.round(np.cumsum(hist) * (255 / (ch * cw))))
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            fy, fx = y / ch - 0.5, x / cw - 0.5
            i, j = math.floor(fy), math.floor(fx)
            a, b, c, d = max(i, 0), min(i + 1, rows - 1), max(j, 0), min(j + 1, columns - 1)
            v = img[y, x]
            top = lut[a, c, v] * (1 - (fx - j)) + lut[a, d, v] * (fx - j)
            low = lut[b, c, v] * (1 - (fx - j)) + lut[b, d, v] * (fx - j)
            out[y, x] = round(top * (1 - (fy - i)) + low * (fy - i))
    return np.where(out < 10, 0, out)


def test_clahe_against_loops(spark):
    rng = np.random.default_rng(9)
    images = {0: rng.integers(0, 256, (32, 32)), 1: np.clip(rng.normal(90, 12, (32, 32)), 0, 255).astype(int), 2: rng.integers(0, 40, (27, 30)), 3: np.full((32, 24), 77)}
    df = spark.createDataFrame([(k, y, x, int(m[y, x])) for k, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1])], "image_id long, y int, x int, v int")
    got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in clahe.clahe(df, ["image_id"], 3.0, 4, 4).collect()}
    want = {(k, y, x): int(v) for k, m in images.items() for (y, x), v in np.ndenumerate(plain_clahe(m, 3.0, 4, 4))}
    assert got.keys() == want.keys()
    # sums of weights that are no powers of two may fall to either side of a half
    assert max(abs(got[p] - want[p]) for p in want) <= 1 and sum(got[p] != want[p] for p in want) < 5


def star(rng, n):
    a = np.sort(rng.random(n)) * 2 * math.pi
    r = rng.uniform(2, 14, n)
    return [{"x": float(20 + r[i] * math.cos(a[i])), "y": float(17 + r[i] * math.sin(a[i]))} for i in range(n)]


def test_tiles_cut_a_polygon_without_loss(spark):
    from pyspark.sql import functions as F

    from zonata.operators.geometry import RING, area

    rng = np.random.default_rng(1)
    rows = [(k, star(rng, 3 + k)) for k in range(25)] + [(90, [{"x": 0.0, "y": 0.0}, {"x": 8.0, "y": 0.0}, {"x": 8.0, "y": 8.0}, {"x": 0.0, "y": 8.0}]), (91, [{"x": 1.0, "y": 1.0}]), (92, [])]
    df = spark.createDataFrame(rows, f"id long, ring {RING.simpleString()}")
    for tile in (4, 100):
        cut = overlay.cut_by_tiles(df, tile)
        total = {r["id"]: r["a"] for r in cut.groupBy("id").agg(F.sum(area(F.col("part"))).alias("a")).collect()}
        want = {r["id"]: r["a"] for r in df.where(F.size("ring") >= 3).select("id", area(F.col("ring")).alias("a")).collect()}
        assert total.keys() == want.keys() and all(abs(total[k] - want[k]) < 1e-9 for k in want)
        inside = F.forall("part", lambda p: p["x"].between(F.col("tile_c") * tile - 1e-9, (F.col("tile_c") + 1) * tile + 1e-9) & p["y"].between(F.col("tile_r") * tile - 1e-9, (F.col("tile_r") + 1) * tile + 1e-9))
        assert cut.where(~inside).count() == 0


def images(spark, n=3, h=21, w=18):
    rng = random.Random(8)
    return spark.createDataFrame([(k, y, x, float(rng.randrange(256))) for k in range(n) for y in range(h) for x in range(w)], PIXEL)


def same(a, b, places=9):
    one = lambda df: {(r["image_id"], r["y"], r["x"]): round(r["v"], places) for r in df.collect()}
    a, b = one(a), one(b)
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_assembled_tiles_equal_the_whole_image(spark):
    df, k = images(spark), ["image_id"]
    for step, halo in ((lambda d, q: raster.gaussian(d, q, 2.0, 2), 2), (lambda d, q: raster.bilateral(d, q, 3, 50.0, 75.0), 1), (lambda d, q: raster.median_blur(d, q, 5), 2)):
        same(tiling.by_tiles(df, k, 6, halo, step), step(df, k))
    near = lambda d, q: components.distance(d.selectExpr(*q, "y", "x", "int(v > 60) as m"), q).withColumnRenamed("d", "v").fillna(99.0)
    whole = near(df, k)
    assert whole.agg({"v": "max"}).first()[0] <= 8
    same(tiling.by_tiles(df, k, 6, 6, near), whole)


def test_empty_tiles_are_skipped(spark):
    df = images(spark, 1, 12, 12).selectExpr("image_id", "y", "x", "if(y < 5 and x < 5, v + 1, 0d) as v")
    out = tiling.by_tiles(df, ["image_id"], 4, 1, lambda d, q: d, skip_empty=True)
    assert out.count() == 4 * 16 and out.where("v > 0").count() == df.where("v > 0").count()


def test_store_reads_few_files(spark, tmp_path):
    from pyspark.sql import functions as F

    seen = []
    for n, h in ((2, 40), (6, 130)):
        path = str(tmp_path / f"store-{n}")
        pixels = images(spark, n, h, 30).withColumn("level", F.lit(0))
        tiles.write_tiles(tiles.tiles_of(pixels, 8), path, parts=64, band=2)
        region = tiles.read_region(spark, path, 1, 0, 9, 3, 12, 14, 8, parts=64, band=2)
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        run = region._jdf.queryExecution()
        plan = run.toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        run.toRdd().count()
        assert "PushedFilters: [IsNotNull(image_id)" in plan and "GreaterThanOrEqual(tile_r" in plan and "PartitionFilters: [isnotnull(level" in plan
        same(region.drop("level"), pixels.where("image_id = 1 and y between 9 and 20 and x between 3 and 16").drop("level"))
        seen.append(run.executedPlan().collectLeaves().head().metrics().apply("numFiles").value())
        wanted = spark.createDataFrame([(7, 1, 0, 9, 3, 12, 14), (8, 0, 0, 0, 0, 1, 1)], "region long, image_id long, level int, y int, x int, h int, w int")
        got = tiles.read_regions(spark, path, wanted, 8, parts=64, band=2)
        assert got.where("region = 8").count() == 1 and got.where("region = 7").count() == 12 * 14
    assert seen[0] == seen[1] == 2
    edge = tiles.tiles_of(images(spark, 1, 10, 9).withColumn("level", F.lit(2)).where("not (y = 9 and x = 8)"), 8)
    assert sorted((r["tile_r"], r["tile_c"], r["h"], r["w"], r["data"].count(None)) for r in edge.collect()) == [(0, 0, 8, 8, 0), (0, 1, 8, 1, 0), (1, 0, 2, 8, 0), (1, 1, 2, 1, 1)]


def test_masked_tiles(spark):
    from zonata.operators.geometry import RING
    from pyspark.sql import functions as F

    pixels = images(spark, 1, 24, 24).withColumn("level", F.lit(0))
    ring = [{"x": 3.2, "y": 2.1}, {"x": 20.7, "y": 4.0}, {"x": 11.0, "y": 9.0}, {"x": 4.0, "y": 21.5}]
    rois = spark.createDataFrame([(0, 0, 1, ring)], f"image_id long, level int, roi long, ring {RING.simpleString()}")
    got = tiles.masked_tiles(tiles.tiles_of(pixels, 8), rois, 8).collect()
    value = {(r["y"], r["x"]): int(r["v"]) for r in pixels.collect()}

    def inside(y, x):
        hit = False
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            if (p["y"] > y) != (q["y"] > y) and x < p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"]):
                hit = not hit
        return hit

    seen = {}
    for r in got:
        for k, v in enumerate(r["data"]):
            seen[r["row0"] + k // r["w"], r["col0"] + k % r["w"]] = v
    assert all(v == (value[p] if inside(p[0] + 0.5, p[1] + 0.5) else 255) for p, v in seen.items())
    assert {p for p in value if inside(p[0] + 0.5, p[1] + 0.5)} <= seen.keys() and (2, 2) not in {(r["tile_r"], r["tile_c"]) for r in got}


def test_tiles_of_a_box():
    made = lambda *box: list(tiles.TilesOfBox().eval(*box, 16))
    assert made(0, 0, 15, 16) == [(0, 0), (0, 1)] and made(31, 5, 32, 5) == [(1, 0), (2, 0)]
    assert made(40, 0, 15, 16) == [] and made(None, 0, 1, 1) == []


def test_report_reads_chosen_sheets(spark, tmp_path):
    from zonata.sources import files

    rows = [("a", 1.5, "x_one"), ("b", None, "x_one"), ("c", 2.0, "y_two")]
    files.write_sheets(spark.createDataFrame(rows, "attr string, mean double, sheet string"), str(tmp_path / "report"))
    got = files.read_sheets(spark, str(tmp_path / "report"), "attr string, mean double", "^x_")
    assert sorted(map(tuple, got.collect())) == [("a", 1.5, "x_one"), ("b", None, "x_one")]
    assert "PartitionFilters: [isnotnull(sheet" in got._jdf.queryExecution().toString()
    tagged = files.tagged(got, "^x_(.*)$", "tag", {"mean": "m"}, ("attr",))
    assert tagged.columns == ["m", "tag"] and {r["tag"] for r in tagged.collect()} == {"one"}
