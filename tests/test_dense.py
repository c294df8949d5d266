"""Dense regions, automatic thresholds and whole runs against planted spots and plain loops."""

import itertools
import math

import numpy as np
import pytest

from fluorite.functions.config import Settings, from_text
from fluorite.operators import dense
from fluorite.operators import spots as sp
from fluorite.plans import pipelines

SPOT = {"z": 1.2, "y": 1.6, "x": 1.6}


def planted(shape, places, seed=0, noise=0.3, base=20.0, amplitude=100.0):
    """A stack with a sloping background and a Gaussian at each place."""
    z, y, x = np.indices(shape)
    v = base + 0.2 * y + np.random.default_rng(seed).normal(scale=noise, size=shape)
    for a, b, c in places:
        v += amplitude * np.exp(-((z - a) ** 2) / (2 * SPOT["z"] ** 2) - ((y - b) ** 2 + (x - c) ** 2) / (2 * SPOT["y"] ** 2))
    return v


def frame(spark, stacks):
    rows = [(i, *p, float(v)) for i, s in enumerate(stacks) for p, v in np.ndenumerate(s)]
    return spark.createDataFrame(rows, "image_id long, z long, y long, x long, v double")


ALONE = [(5, 8, 8), (5, 8, 30), (5, 30, 8), (6, 30, 30), (5, 19, 8)]


def test_two_spots_that_overlap_come_back(spark):
    """Each pair is two voxels apart, where their sum is brightest between them; a triple and a region of one spot too."""
    pairs = [[(5, 19, 30), (5, 19, 32)], [(5, 19, 30), (5, 21, 30)], [(4, 18, 30), (4, 18, 33), (5, 20, 31)]]
    shape = (11, 40, 40)
    stacks = [planted(shape, [*ALONE, *p], seed=k) for k, p in enumerate(pairs)]
    seen = [(k, *p) for k, own in enumerate(pairs) for p in [*ALONE, own[0]]]
    spots = spark.createDataFrame([(n, *s) for n, s in enumerate(seen)], "spot_id long, image_id long, z long, y long, x long")
    out, regions, reference = dense.decompose(frame(spark, stacks), spots, SPOT, (0.5, 1.1, 5))
    rows = out.collect()
    for k, own in enumerate(pairs):
        made = [(r.z, r.y, r.x) for r in rows if r.image_id == k and r.region is not None and r.y > 12 and r.x > 25 and r.y < 26]
        assert len(made) == len(own)
        assert min(max(max(abs(a - b) for a, b in zip(p, q, strict=True)) for p, q in zip(order, own, strict=True)) for order in itertools.permutations(made)) <= 1
        kept = [(r.z, r.y, r.x) for r in rows if r.image_id == k and r.region is None]
        assert set(kept) <= set(ALONE) and all(r.spot_id is not None for r in rows if r.region is None)
    assert all(r.n_spots >= 1 and r.n_voxels >= 2 for r in regions.collect())
    for r in reference.collect():
        assert abs(r.sigma_z - SPOT["z"]) < 0.25 and abs(r.sigma_yx - SPOT["y"]) < 0.25 and 70 < r.amplitude < 110


def test_large_regions_are_fitted_in_boxes(spark, monkeypatch):
    monkeypatch.setattr(dense, "REGION_VOXELS", 100)
    monkeypatch.setattr(dense, "REGION_BOX", {"z": 12, "y": 12, "x": 12})
    line = [(5, 20, c) for c in range(8, 34, 3)]
    lone = [(5, 7, 8), (5, 7, 30), (5, 33, 8), (5, 33, 30), (5, 7, 19), (5, 33, 19)]
    img = frame(spark, [planted((11, 40, 40), [*line, *lone])]).drop("image_id")
    spots = spark.createDataFrame([(n, *s) for n, s in enumerate(lone)], "spot_id long, z long, y long, x long")
    out, regions, _ = dense.decompose(img, spots, SPOT, (0.5, 0.9, 0))
    made = [(r.z, r.y, r.x) for r in out.collect() if r.region is not None and 15 < r.y < 25]
    assert len(line) - 2 <= len(made) <= len(line) + 3  # a spot on the border of two boxes may count for both
    assert all(min(abs(p[2] - c) for p in made) <= 2 for _, _, c in line)
    assert max(r.n_voxels for r in regions.collect()) > 100


def test_mixture_against_all_placements():
    """The greedy fit with moves finds as small an error as the best of all pairs of places."""
    rng = np.random.default_rng(2)
    cells = np.array(list(itertools.product(range(1), range(9), range(9))))
    for a, b in [((0, 3, 3), (0, 3, 5)), ((0, 2, 2), (0, 6, 6)), ((0, 4, 3), (0, 5, 5))]:
        bell = lambda c: 10 * np.exp(-((cells - np.array(c)) ** 2).sum(1) / (2 * 1.3**2))
        values = bell(a) + bell(b) + 2 + rng.normal(scale=0.05, size=len(cells))
        got = dense.fit_mixture(cells, values, 1.3, 1.3, 10.0, 2.0)
        assert sorted(map(tuple, got)) == sorted([a, b])
        errors = [((values - 2 - bell(p) - bell(q)) ** 2).sum() for p, q in itertools.combinations_with_replacement(cells, 2)]
        assert ((values - 2 - sum(bell(c) for c in got)) ** 2).sum() == pytest.approx(min(errors))
    assert len(dense.fit_mixture(cells[:1], np.array([3.0]), 1.0, 1.0, 10.0, 0.0)) == 1
    assert len(dense.fit_mixture(cells, np.zeros(len(cells)), 1.0, 1.0, 0.0, 0.0)) == 1


def test_no_spots_and_no_voxels(spark):
    img = frame(spark, [planted((3, 6, 6), [])])
    none = spark.createDataFrame([], "spot_id long, image_id long, z long, y long, x long")
    for i, s in ((img, none), (img.limit(0), none), (img, spark.createDataFrame([(1, 0, 0, 0, 0)], none.schema))):
        out, regions, reference = dense.decompose(i, s, SPOT)
        assert [r.spot_id for r in out.collect()] == [r.spot_id for r in s.collect()] and regions.count() == 0 == reference.count()


def knee_by_hand(values, n=100):
    values = [v for v in values if v > 0]
    top = max(values)
    y = [math.log(sum(min(math.floor(v / top * n), n - 1) >= k for v in values)) for k in range(n)]
    x = np.arange(n)

    above = [round(y[k] - y[0] - (y[-1] - y[0]) * k / (n - 1), 9) for k in range(n)]
    end = max(range(n), key=lambda k: (above[k], -k))
    end = end if end >= 3 else n - 1

    def error(lo, hi):
        a, b = np.polyfit(x[lo:hi], y[lo:hi], 1)
        return float(((np.array(y[lo:hi]) - a * x[lo:hi] - b) ** 2).sum())

    return top * min(range(2, end), key=lambda b: (round(error(0, b) + error(b, end + 1), 9), b)) / n


def test_knee_against_every_break(spark):
    rng = np.random.default_rng(6)
    noise = [[*rng.exponential(2.0, 3000), *rng.normal(60, 8, 150)], [*rng.exponential(5.0, 800), *rng.normal(90, 5, 40), -3.0, 0.0]]
    df = spark.createDataFrame([(i, float(v)) for i, vs in enumerate(noise) for v in vs] + [(2, -1.0)], "image_id long, v double").repartition(4)
    got = {r.image_id: r.threshold for r in sp.knee_threshold(df).collect()}
    assert set(got) == {0, 1}
    for i, vs in enumerate(noise):
        assert got[i] == pytest.approx(knee_by_hand(vs))
        assert 3 * (2.0, 5.0)[i] < got[i] < 45  # between noise (mean 2 and 5) and spots
    one = sp.knee_threshold(df.where("image_id = 0").drop("image_id")).collect()
    assert [r.threshold for r in one] == [got[0]]
    assert sp.knee_threshold(df.limit(0)).count() == 0


def test_whole_run(spark):
    places = [*ALONE, (5, 20, 28), (5, 20, 31), (5, 23, 29)]
    img = frame(spark, [planted((11, 40, 40), places)])
    control = frame(spark, [planted((11, 40, 40), ALONE, amplitude=30.0)])
    settings = Settings(kernel_size=(1.0, 1.3, 1.3), minimal_distance=(1, 1, 1), voxel_size=(100.0, 100.0, 100.0), spot_size=(120.0, 160.0, 160.0), max_levels=10, radius_for_spots=420.0, min_spots_for_clusters=3, decomposition=(0.5, 1.05, 5.0))
    run = pipelines.analyse(img, settings, control=control)
    spots = [(r.z, r.y, r.x) for r in run.spots.collect()]
    assert all(min(max(abs(a - b) for a, b in zip(p, q, strict=True)) for q in spots) <= 1 for p in places)
    stages = {r.stage: r for r in run.stages.collect()}
    assert stages["raw"].n <= stages["decomposed"].n and stages["background_removed"].n == len(spots) <= stages["decomposed"].n
    assert {r.place_type for r in stages.values()} == {"bigint"} and len({r.threshold for r in stages.values()}) == 1
    clusters = run.clusters.collect()
    assert len(clusters) == 1 and clusters[0].n_spots == stages["clustered"].n >= 3 and 19 <= clusters[0].y <= 23 and 27 <= clusters[0].x <= 32
    plain = pipelines.analyse(img, Settings(**{**settings.__dict__, "decomposition": None}), manual=20.0)
    counts = {r.stage: r.n for r in plain.stages.collect()}
    assert counts["raw"] == counts["decomposed"] == counts["background_removed"] and plain.regions.count() == 0


def test_settings_of_decomposition():
    got = from_text("decomposition_thresh: [0.7, 1, 5]\ncontrol_voxel_size: [361, 75, 75]\nspotsRadiusDetection: true\nspot_size: [600, 300, 300]\nvoxel_size: [300, 75, 100]")
    assert got.decomposition == (0.7, 1, 5) and got.control_voxel_size == (361, 75, 75) and got.spot_radii is True and not got.unknown
    assert got.spot_voxels == {"z": 2.0, "y": 4.0, "x": 3.0}
    for wrong in ("decomposition_thresh: [0.7, 1]", "decomposition_thresh: [1.7, 1, 5]", "control_voxel_size: [1, 2]"):
        with pytest.raises(ValueError):
            from_text(wrong)
