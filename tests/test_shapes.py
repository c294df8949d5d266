"""Exact probabilities, the older flood rule, outlines and cells against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorite.functions import special
from fluorite.operators import cohort, raster, sampling
from fluorite.operators.shapes import extract_cells, star_outlines, star_reconstruct
from fluorite.sources import arrays


def orders(n1, n2):
    """Every way to lay the first sample's values among all, as places."""
    return itertools.combinations(range(n1 + n2), n1)


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (3, 5), (4, 4), (2, 7), (6, 3)])
def test_exact_probabilities_against_all_orders(n1, n2):
    gaps, us = [], []
    for own in orders(n1, n2):
        i = np.cumsum([k in own for k in range(n1 + n2)])
        gaps.append(np.abs(i / n1 - (np.arange(1, n1 + n2 + 1) - i) / n2).max())
        us.append(sum(own) - n1 * (n1 - 1) / 2)
    for d in set(np.round(gaps, 9)):
        assert special.kolmogorov_exact(d, n1, n2) == pytest.approx(np.mean(np.array(gaps) >= d - 1e-9))
    for u in range(n1 * n2 + 1):
        assert special.u_at_most(u, n1, n2) == pytest.approx(np.mean(np.array(us) <= u))
    assert special.u_at_most(-1, n1, n2) == 0 and special.kolmogorov_exact(0.0, n1, n2) == 1


def test_exact_probabilities_near_the_asymptotic_ones():
    for d in (0.02, 0.05, 0.1):
        assert special.kolmogorov_exact(d, 3000, 2000) == pytest.approx(special.kolmogorov_tail(d, 3000, 2000), rel=0.1, abs=1e-12)
    n1, n2 = 8, 400
    u = 1000.0
    z = (n1 * n2 / 2 - u - 0.5) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    assert special.u_at_most(u, n1, n2) == pytest.approx(special.normal_tail(z), rel=0.05)


def test_tests_of_small_samples(spark):
    cells = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (4.0, 5.0, 6.0)] + [("c", v) for v in (1.0, 1.0, 2.0)], "g string, v double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    less = {r.comparison: r.p_value for r in cohort.mwu_p(cohort.mann_whitney(cells, pairs, "g", "v"), "less").collect()}
    both = {r.comparison: r.p_value for r in cohort.mwu_p(cohort.mann_whitney(cells, pairs, "g", "v")).collect()}
    assert less["a vs b"] == pytest.approx(1 / 20) and both["a vs b"] == pytest.approx(2 / 20)
    assert 0 < both["a vs c"] <= 1
    ks = {r.comparison: r.p_value for r in cohort.ks_p(cohort.kolmogorov_smirnov(cells, pairs, "g", "v")).collect()}
    assert ks["a vs b"] == pytest.approx(2 / 20)


def early_stop(stack, seed, levels):
    """A search with lists: it ends for good where nothing is new after the first voxel of a level."""
    front, seen = [seed], {seed: 0}
    for level in range(1, levels + 1):
        fresh = []
        for place in front:
            for step in raster.LOOK_ORDER:
                q = tuple(a + b for a, b in zip(place, step))
                if all(0 <= a < n for a, n in zip(q, stack.shape)) and q not in seen and 0 < stack[q] <= stack[place]:
                    fresh.append(q)
                    seen[q] = level
            if not fresh:
                return seen
        front = fresh
    return seen


def test_early_stop_against_lists(spark):
    rng = np.random.default_rng(8)
    stack = rng.integers(0, 9, (4, 9, 9)).astype(float)
    img = spark.createDataFrame([(*map(int, p), float(v)) for p, v in np.ndenumerate(stack) for p in [p]], "z long, y long, x long, v double")
    places = [tuple(map(int, p)) for p in np.argwhere(stack == 8)]
    seeds = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "spot_id long, z long, y long, x long")
    got = {}
    for r in raster.flood_fill_compat(img, seeds, 5).collect():
        got.setdefault(r.spot_id, {})[r.z, r.y, r.x] = r.level
    assert got == {k: early_stop(stack, p, 5) for k, p in enumerate(places)}
    full = {r.spot_id: r.n for r in raster.flood_fill(img, seeds, 5).groupBy("spot_id").agg(F.count("*").alias("n")).collect()}
    assert any(full[k] > len(v) for k, v in got.items())


def test_outlines_of_a_square(spark):
    px = [(0, y, x, 1) for y in range(5, 12) for x in range(5, 12)] + [(0, 30, 30, 2)]
    labels = spark.createDataFrame(px, "plane long, y long, x long, label long")
    d = {(r.label, r.k): r.d for r in star_outlines(labels, [4]).collect()}
    assert d == {(1, k): 3.5 for k in range(4)} | {(2, k): 0.5 for k in range(4)}
    got = {}
    for r in star_reconstruct(labels, [4, 64]).collect():
        got.setdefault((r.n_rays, r.label), set()).add((r.y, r.x))
    assert got[4, 1] == {(8 + a, 8 + b) for a in range(-3, 4) for b in range(-3, 4) if abs(a) + abs(b) <= 3}
    assert got[4, 2] == got[64, 2] == {(30, 30)}
    assert got[4, 1] < got[64, 1] == {(y, x) for _, y, x, k in px if k == 1}


def test_cells_with_nuclei(spark):
    cells = spark.createDataFrame([(0, 0, x, 1) for x in range(4)] + [(0, 5, 5, 2), (1, 0, 0, 1)], "plane long, y long, x long, label long")
    nuclei = spark.createDataFrame([(0, 0, 1, 7), (0, 0, 2, 8), (0, 9, 9, 9)], "plane long, y long, x long, label long")
    spots = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (0, 0, 3), (0, 9, 9), (1, 0, 0)], "plane long, y long, x long")
    got = {(r.plane, r.label): (r.cell_area, r.nucleus_area, r.n_nuclei, r.x0, r.x1, r.n_spots, r.n_nuclear) for r in extract_cells(cells, nuclei, spots).collect()}
    assert got == {(0, 1): (4, 2, 2, 0, 3, 3, 2), (0, 2): (1, 0, 0, 5, 5, 0, 0), (1, 1): (1, 0, 0, 0, 0, 1, 0)}


def test_volumes_and_noise(spark):
    sizes = spark.createDataFrame([(1, 20, 30, 40), (2, 4, 30, 40)], "image long, nz long, ny long, nx long")
    got = sampling.random_volumes(sizes, 5, 10, 10, 4).collect()
    assert len(got) == 4 and all(r.image == 1 and 0 <= r.z0 < r.z1 == r.z0 + 5 <= 20 and r.y1 <= 30 and r.x1 <= 40 for r in got)
    img = spark.range(50).select(F.col("id").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("p")).select("z", F.floor(F.col("p") / 16).alias("y"), (F.col("p") % 16).alias("x"), F.lit(1.0).alias("v"))
    r = sampling.noise(img, 16, 0.5).agg(F.avg("v").alias("m"), F.stddev("v").alias("s")).first()
    assert r.m == pytest.approx(1, abs=0.02) and 0.2 < r.s < 0.4


def test_broken_files_count_as_missing(spark):
    good = arrays.npy_bytes(np.arange(3.0))
    df = spark.createDataFrame([(1, good), (2, good[:30]), (3, b""), (4, None), (5, b"text"), (6, good[:-4])], "k long, content binary")
    assert [r.k for r in arrays.readable(df).collect()] == [1]
