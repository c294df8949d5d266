"""Dense filters in blocks against plain loops, over borders of blocks, holes, narrow images and several stacks."""

import itertools
import math

import numpy as np
import pytest

from fluorite.operators import blocks, raster


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", {"z": 2, "y": 4, "x": 4})


def stack(spark, shape, images, share=1.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, *p, float(rng.normal())) for i in images for p in itertools.product(*map(range, shape)) if rng.random() < share]
    return rows, spark.createDataFrame(rows, "image_id string, z long, y long, x long, v double").repartition(3)


def test_gaussian_counts_missing_voxels_as_zero(spark, small):
    rows, df = stack(spark, (3, 9, 11), ["a", None], 0.8)
    sigma = {"z": 0.5, "y": 1.2, "x": 0.9}
    at = {r[:4]: r[4] for r in rows}
    for axis, a in enumerate("zyx", 1):
        k = raster.gaussian_weights(sigma[a])
        at = {p: sum(w * at.get((*p[:axis], p[axis] + d, *p[axis + 1 :]), 0.0) for d, w in k) for p in at}
    got = {(r.image_id, r.z, r.y, r.x): r.v for r in raster.gaussian(df, sigma).collect()}
    assert got.keys() == at.keys() and max(abs(got[p] - at[p]) for p in at) < 1e-12


def test_log_filter_mirrors_narrow_images(spark, small):
    shape, sigma = (2, 7, 10), {"z": 1.0, "y": 1.5, "x": 1.1}
    rows, df = stack(spark, shape, ["a"])
    v = np.array([r[4] for r in rows]).reshape(shape)

    def one(values, axis, s, second):
        r = int(4 * s + 0.5)
        d = np.arange(-r, r + 1)
        w = np.exp(-0.5 * (d / s) ** 2)
        w = w / w.sum() * ((d * d / s**2 - 1) / s**2 if second else 1)
        padded = np.pad(values, [(r, r) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
        return sum(w[k] * np.take(padded, np.arange(k, k + values.shape[axis]), axis) for k in range(2 * r + 1))

    want = np.zeros(shape)
    for second in range(3):
        part = v
        for axis, a in enumerate("zyx"):
            part = one(part, axis, sigma[a], axis == second)
        want -= part
    got = np.zeros(shape)
    for r in raster.log_filter(df, sigma, {a: (0, n - 1) for a, n in zip("zyx", shape, strict=True)}).collect():
        got[r.z, r.y, r.x] = r.v
    assert np.abs(got - np.maximum(want, 0)).max() < 1e-12


@pytest.mark.parametrize("distance", [0, 1, 3.5, 9])
def test_labels_reach_over_blocks(spark, small, distance):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(2)), int(rng.integers(2)), int(rng.integers(15)), int(rng.integers(13)), int(rng.integers(1, 2**40))) for _ in range(14)]
    rows += [(0, 0, 3, 3, 5), (0, 0, 3, 3, 4), (0, 0, 3, 5, 2)]
    df = spark.createDataFrame(rows, "image_id int, plane long, y long, x long, label long")
    want = {}
    for i, p, y, x in itertools.product(range(2), range(2), range(15), range(13)):
        near = [((y - b) ** 2 + (x - c) ** 2, lab) for j, q, b, c, lab in rows if (j, q) == (i, p)]
        near = [n for n in near if n[0] <= distance * distance]
        if near:
            want[i, p, y, x] = min(near)
    got = {(r.image_id, r.plane, r.y, r.x): (r.d2, r.label) for r in raster.expand_labels(df, distance, (15, 13)).collect()}
    assert got == want


def test_borders_move_once_for_each_neighbour(spark):
    """The shuffle has a row for each piece, not one for each voxel and tap of the kernel."""
    _, df = stack(spark, (4, 40, 40), ["a"])
    plan = raster.gaussian(df, {"z": 1.0, "y": 2.0, "x": 2.0})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_no_voxels(spark):
    df = spark.createDataFrame([], "z long, y long, x long, v double")
    assert raster.log_response(df, {"z": 1.0, "y": 1.0, "x": 1.0}).count() == 0
    assert math.isclose(sum(w for _, w in raster.gaussian_weights(1.7)), 1)
