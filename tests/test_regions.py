"""Contents of regions, polygons of labels, fits of known spots, shapes: against brute force."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fluorite.operators import fitting, polygons, sampling
from fluorite.operators import spots as sp


def voxels(spark, values, image=0):
    at = np.indices(values.shape).reshape(3, -1).tolist()
    return spark.createDataFrame([(image, *p, float(v)) for *p, v in zip(*at, values.ravel(), strict=True)], "image_id long, z long, y long, x long, v double")


@pytest.mark.parametrize("size", [(2, 3, 4), (1, 1, 1), (5, 7, 6)])
def test_contents_of_boxes(spark, size):
    rng = np.random.default_rng(1)
    images = [rng.random((5, 7, 6)), rng.random((4, 5, 9))]
    boxes = [(i, k, *(int(c) for c in rng.integers(-3, 8, 3))) for i in (0, 1) for k in range(12)] + [(0, 50, 0, 0, 0), (0, 51, 0, 0, 0), (9, 0, 0, 0, 0)]
    table = spark.createDataFrame(boxes, "image_id long, k long, z0 long, y0 long, x0 long").withColumn("v", F.lit("clash"))
    img = voxels(spark, images[0]).unionByName(voxels(spark, images[1], 1))
    got = sampling.contents(img, table, dict(zip("zyx", size, strict=True)), ["image_id"])
    want = set()
    for i, k, *corner in boxes:
        for place in np.ndindex(size):
            z, y, x = (c + p for c, p in zip(corner, place, strict=True))
            if i < 2 and all(0 <= c < n for c, n in zip((z, y, x), images[i].shape, strict=True)):
                want.add((i, k, *place, float(images[i][z, y, x])))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert sampling.contents(img.limit(0), table, {"z": 1, "y": 1, "x": 1}, ["image_id"]).count() == 0


def test_regions_that_do_not_fit(spark):
    images = spark.createDataFrame([(1, 20, 30, 30), (2, 20, 5, 30)], "image long, nz long, ny long, nx long")
    assert {r.image for r in sampling.random_volumes(images, 10, 10, 10).collect()} == {1}
    for strict in (sampling.random_volumes(images, 10, 10, 10, strict=True), sampling.random_regions(images, 10, 10, strict=True)):
        with pytest.raises(PySparkException, match="smaller than the region: image 2"):
            strict.collect()
    assert sampling.random_volumes(images.where("image = 1"), 10, 10, 10, strict=True).count() == 1


def inside(ring, y, x):
    """How often a ring of corners goes around a pixel's middle, by crossings of a ray along x."""
    turns = 0
    for (ya, xa), (yb, xb) in zip(ring, ring[1:] + ring[:1], strict=True):
        if xa == xb and xa > x + 0.5 and min(ya, yb) <= y + 0.5 < max(ya, yb):
            turns += 1 if yb > ya else -1
    return turns


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_polygons_hold_their_pixels(spark, seed):
    rng = np.random.default_rng(seed)
    # Few labels on a small plane touch at corners, have holes and consist of parts; blocks end at 64.
    plane = rng.integers(0, 3, (9, 70))
    plane[:, 58:68] = 1
    plane[3:6, 60:66] = 2 * (seed % 2)
    at = np.argwhere(plane > 0).tolist()
    px = spark.createDataFrame([(0, y, x, int(plane[y, x])) for y, x in at], "plane long, y long, x long, label long")
    corners = polygons.polygons(px)
    found: dict = {}
    for r in sorted(corners.collect(), key=lambda r: (r.label, r.ring, r.pos)):
        found.setdefault(r.label, {}).setdefault(r.ring, []).append((r.y, r.x))
    for label in (1, 2):
        for ring in found[label].values():
            steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
            # Sides alternate between upright and level, and none is empty.
            assert all((dy == 0) != (dx == 0) for dy, dx in steps)
            assert all((a[0] == 0) != (b[0] == 0) for a, b in zip(steps, steps[1:] + steps[:1], strict=True))
        for y, x in np.ndindex(plane.shape):
            assert sum(inside(ring, y, x) for ring in found[label].values()) == (plane[y, x] == label)
    areas = {(r.label, r.ring): r for r in polygons.ring_areas(corners).collect()}
    for label in (1, 2):
        assert sum(r.area for (k, _), r in areas.items() if k == label) == (plane == label).sum()
    assert polygons.polygons(px.limit(0)).count() == 0


def test_a_long_ring(spark):
    """A spiral's border: one ring of some thousand edges."""
    side = 60
    plane = np.zeros((side, side), int)
    y, x, d, turns = 0, 0, 0, [(0, 1), (1, 0), (0, -1), (-1, 0)]
    for length in [n for k in range(side - 1, 2, -2) for n in (k, k)]:
        for _ in range(length):
            plane[y, x] = 1
            y, x = y + turns[d][0], x + turns[d][1]
        d = (d + 1) % 4
    px = spark.createDataFrame([(0, int(y), int(x), 7) for y, x in np.argwhere(plane)], "plane long, y long, x long, label long")
    rows = polygons.ring_areas(polygons.polygons(px)).collect()
    padded = np.pad(plane, 1)
    edges = sum(int((padded != np.roll(padded, 1, a)).sum()) for a in (0, 1))
    assert sum(r.area for r in rows) == plane.sum() and sum(r.perimeter for r in rows) == edges


def test_fits_of_known_spots(spark):
    truth = [(6, 6, 6, 50.0, 1.0, 1.4, 1.2), (6, 6, 22, 80.0, 1.3, 1.1, 1.6), (6, 20, 14, 20.0, 0.9, 1.5, 1.5)]
    z, y, x = np.indices((13, 28, 30)).astype(float)
    values = np.random.default_rng(0).normal(0, 0.05, z.shape)
    for cz, cy, cx, a, sz, sy, sx in truth:
        values += a * np.exp(-(((z - cz) / sz) ** 2 + ((y - cy) / sy) ** 2 + ((x - cx) / sx) ** 2) / 2)
    seeds = [(k, 0, *t[:3]) for k, t in enumerate(truth)] + [(9, 0, 2, 25, 3)]
    spots = spark.createDataFrame(seeds, "spot_id long, image_id long, z long, y long, x long")
    got = {r.spot_id: r for r in fitting.gaussian_fit(voxels(spark, values), spots, radius=3, min_r2=0.8).collect()}
    # The place without a spot is noise, which no fit explains.
    assert set(got) == {0, 1, 2}
    for k, (*_, a, sz, sy, sx) in enumerate(truth):
        r = got[k]
        assert r.r2 > 0.99 and (r.amplitude, r.sigma_z, r.sigma_y, r.sigma_x) == pytest.approx((a, sz, sy, sx), rel=0.03)


def test_shapes_match(spark):
    img = voxels(spark, np.ones((2, 3, 4))).unionByName(voxels(spark, np.ones((1, 1, 1)), 1)).unionByName(voxels(spark, np.ones((1, 2, 1)), 2))
    mask = voxels(spark, np.ones((2, 3, 4))).unionByName(voxels(spark, np.ones((1, 1, 2)), 1)).unionByName(voxels(spark, np.ones((1, 1, 1)), 3))
    got = {r.image_id: r.equal for r in sp.shapes_match(img, mask).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}
    assert sp.shapes_match(img.drop("image_id"), img.drop("image_id")).collect()[0].equal
