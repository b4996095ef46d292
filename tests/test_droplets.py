import numpy as np
import pytest

from zonata.operators import components, droplets, raster, stack

PIXEL = "image_id long, y int, x int, v int"
CENTRES = {0: [(14, 14, 8), (14, 27, 8), (40, 20, 11), (31, 44, 9)], 1: [(32, 32, 10)]}


def table(spark, images):
    return spark.createDataFrame([(k, y, x, int(m[y, x])) for k, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1])], PIXEL)


def disc_image(discs, side=60):
    y, x = np.mgrid[:side, :side]
    out = np.full((side, side), 100)
    for cy, cx, r in discs:
        out[(y - cy) ** 2 + (x - cx) ** 2 < r * r] = 230
    out[50:52, 5:25] = 230  # a thread that the opening takes away
    return out


@pytest.fixture(scope="module")
def gray(spark):
    return components.stored(table(spark, {k: disc_image(d) for k, d in CENTRES.items()}))


def found(df):
    rows = df.collect()
    ring = lambda r: [(p["y"], p["x"]) for p in r["ring"]]
    return sorted((r["image_id"], *np.mean(ring(r), axis=0).round().astype(int).tolist(), len(r["ring"])) for r in rows)


def test_touching_discs_come_apart(spark, gray):
    got = found(droplets.detect(spark, gray, ["image_id"], apart=5))
    assert [g[0] for g in got] == [0, 0, 0, 0, 1]
    for (k, cy, cx, _), (y, x, _) in zip(got, sorted(CENTRES[0]) + CENTRES[1], strict=True):
        assert abs(cy - y) <= 1 and abs(cx - x) <= 1
    rows = droplets.detect(spark, gray, ["image_id"], apart=5).collect()
    assert all(r["solidity"] > 0.9 for r in rows)
    largest = max(r["area"] for r in rows)
    assert abs(largest - np.pi * 10**2) < 2 * np.pi * 11  # the outline is drawn through the border pixels' centres


def test_tiles_count_a_droplet_once(spark, gray):
    got = droplets.detect_by_tiles(spark, gray, ["image_id"], 30, 28, apart=5)
    assert found(got) == found(droplets.detect(spark, gray, ["image_id"], apart=5))


def test_features_and_classes(spark, gray):
    bright = gray.where("v > 200").select("image_id", "y", "x")
    got = droplets.droplet_features(spark, bright, ["image_id"], least=150).collect()
    # the two touching discs are one outline here, the thread is too small
    assert sorted(r["image_id"] for r in got) == [0, 0, 0, 1]
    assert {len(r["features"]) for r in got} == {17} and all(abs(sum(r["features"][:9]) - 1) < 1e-9 for r in got)
    two = next(r for r in got if r["area"] > 350)
    assert two["features"][15] < max(r["features"][15] for r in got)
    one = spark.createDataFrame([(r["image_id"], r["label"], r["ring"], r["area"], [float(v) for v in r["features"]]) for r in got for _ in range(1)], droplets.droplet_features(spark, bright, ["image_id"]).schema)
    kept = [droplets.classify(one, ["image_id"], 2, c, 0).collect() for c in (0, 1)]
    assert sorted(r["label"] for k in kept for r in k) == sorted(r["label"] for r in got)
    assert droplets.classify(one, ["image_id"], 2, 0, 10**6).count() == 0
    assert droplets.classify(one.limit(0), ["image_id"]).count() == 0


def test_no_droplets(spark):
    dark = table(spark, {3: np.full((12, 12), 50)})
    assert droplets.detect(spark, dark, ["image_id"]).count() == 0


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_over_bands(spark, monkeypatch, connectivity):
    monkeypatch.setattr(components, "BAND", 5)
    snake = {(y, x) for y in range(40) for x in range(40) if y % 2 == 0 or x == (39 if y % 4 == 1 else 0)}
    rng = np.random.default_rng(1)
    noise = {(int(y), int(x)) for y, x in zip(*np.nonzero(rng.random((33, 29)) < 0.45), strict=True)}
    got = components.label(spark, spark.createDataFrame([(k, y, x) for k, m in ((0, snake), (1, noise)) for y, x in m], "image_id long, y int, x int"), ["image_id"], connectivity)
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * (connectivity == 8)
    want = {}
    for k, m in ((0, snake), (1, noise)):
        left = set(m)
        for start in sorted(m):
            if start in left:
                todo = [start]
                left.remove(start)
                while todo:
                    y, x = todo.pop()
                    want[k, y, x] = start
                    for dy, dx in near:
                        if (y + dy, x + dx) in left:
                            left.remove((y + dy, x + dx))
                            todo.append((y + dy, x + dx))
    assert {(r["image_id"], r["y"], r["x"]): (r["label"]["y"], r["label"]["x0"]) for r in got.collect()} == want


def test_envelope_against_all_places():
    rng = np.random.default_rng(0)
    for t in range(400):
        n = rng.integers(1, 30)
        x, h = np.sort(rng.choice(60, n, replace=False)).astype(float), rng.integers(0, 12, n).astype(float) ** 2
        h[rng.random(n) < 0.4] = np.nan
        h[~np.isnan(h)] *= t % 2
        got = components.envelope(x, h)
        if np.isnan(h).all():
            assert np.isnan(got).all()
        else:
            assert np.array_equal(got, np.nanmin((x[:, None] - x[None, :]) ** 2 + h[None, :], axis=1))


def plain_median(m, k, every):
    p = np.pad(m, k // 2, mode="edge")
    return np.array([[np.sort(p[y : y + k, x : x + k].ravel())[k * k // 2] for x in range(0, m.shape[1], every)] for y in range(0, m.shape[0], every)])


@pytest.mark.parametrize(("k", "every"), [(3, 1), (7, 2), (5, 3)])
def test_median_against_loops(spark, k, every):
    rng = np.random.default_rng(k)
    images = {0: rng.integers(0, 256, (13, 9)), 1: rng.integers(0, 3, (4, 20)), 2: np.array([[5]])}
    got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in stack.median(table(spark, images), ["image_id"], k, every).collect()}
    assert got == {(i, y, x): int(v) for i, m in images.items() for (y, x), v in np.ndenumerate(plain_median(m, k, every))}


def test_prepared_stack(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 256, (2, 64, 64))
    a[:9, :9] = 255  # nothing there in one channel
    rows = [("s", c, y, x, int(m[y, x])) for c, m in (("A", a), ("B", b)) for y in range(64) for x in range(64)]
    df = spark.createDataFrame(rows, "roi string, channel string, y int, x int, v int")
    gone = stack.zero_if_missing(df.selectExpr("roi", "channel", "y", "x", "255 - v as v"), ["roi"])
    assert gone.where("y < 9 and x < 9 and v <> 0").count() == 0
    for kind in ("control", "steatosis"):
        out = stack.prepare(df, ["roi"], kind=kind)
        assert {tuple(r) for r in out.groupBy("channel").agg({"y": "max", "x": "max"}).collect()} == {("A", 15, 15), ("B", 15, 15)}
        assert out.where("v < 0 or v > 255").count() == 0
    with pytest.raises(ValueError):
        stack.prepare(df, ["roi"], kind="other")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_pixels_are_not_broadcast(spark, gray):
    """Files of pixels are small, so the optimiser would send the pixels themselves through the driver."""
    bright = components.hysteresis(spark, gray, ["image_id"], 170, 200)
    assert "Broadcast" not in plan_of(bright)
    opened = components.stored(gray.selectExpr("image_id", "y", "x", "cast(v > 200 as int) as m"))
    assert "Broadcast" not in plan_of(droplets.basins(spark, opened, ["image_id"], 5))
    assert "Broadcast" not in plan_of(droplets.droplet_features(spark, bright, ["image_id"], least=150))


def sparse_images():
    rng, rows = np.random.default_rng(0), []
    for k, (y0, x0, h, w, share) in enumerate([(0, 0, 20, 9, 1), (16, 48, 12, 10, 1), (0, 0, 14, 14, 0.6), (5, 3, 9, 9, 0.3), (0, 0, 1, 1, 1)]):
        rows += [(k, y0 + y, x0 + x, int(rng.integers(0, 256))) for y in range(h) for x in range(w) if rng.random() < share]
    return rows


@pytest.mark.parametrize("d", [3, 5])
def test_bilateral_against_loops(spark, d):
    """Also over ends of bands and with pixels missing; pixels are not multiplied by their neighbours on the way."""
    rows, r = sparse_images(), d // 2
    values, size, want = {row[:3]: row[3] for row in rows}, {}, {}
    for k, y, x, _ in rows:
        h, w = size.get(k, (0, 0))
        size[k] = max(h, y), max(w, x)
    for (k, y, x), v in values.items():
        met = []
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                o = values.get((k, min(max(y + dy, 0), size[k][0]), min(max(x + dx, 0), size[k][1])))
                if o is not None and dy * dy + dx * dx <= r * r:
                    met.append((np.exp((o - v) ** 2 / (-2 * 50.0**2) + (dy * dy + dx * dx) / (-2 * 75.0**2)), o))
        want[k, y, x] = sum(g * o for g, o in met) / sum(g for g, _ in met)
    out = raster.bilateral(components.stored(spark.createDataFrame(rows, PIXEL)), ["image_id"], d, 50.0, 75.0, band=4)
    got = {(p["image_id"], p["y"], p["x"]): p["v"] for p in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert "__y" not in plan_of(out)  # no join of pixels with their neighbours'
