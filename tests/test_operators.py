"""Hand-computed cases of the spot operators."""

import math

import numpy as np
import pytest

from fluorite.functions import special
from fluorite.functions.ranking import numbered, running_sums
from fluorite.operators import cohort, raster
from fluorite.operators import spots as sp
from fluorite.sources import arrays, files


def image(spark, stack):
    rows = [(z, y, x, float(v)) for z, p in enumerate(stack) for y, r in enumerate(p) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, "z long, y long, x long, v double")


def keys(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_flood_fill_stops_at_brighter_voxels(spark):
    seed = spark.createDataFrame([(1, 0, 0, 2)], "spot_id long, z long, y long, x long")
    got = raster.flood_fill(image(spark, [[[1, 3, 5, 4, 6]]]), seed)
    assert keys(got, "x") == [(0,), (1,), (2,), (3,)]
    seed = spark.createDataFrame([(1, 0, 0, 0)], "spot_id long, z long, y long, x long")
    got = raster.flood_fill(image(spark, [[[5, 4, 3, 2, 1]]]), seed, 2)
    assert keys(got, "x", "level") == [(0, 0), (1, 1), (2, 2)]


def test_outer_shell_of_one_voxel(spark):
    v = spark.createDataFrame([(1, 5, 5, 5)], "spot_id long, z long, y long, x long")
    got = raster.outer_shell(v, {a: (0, 9) for a in "zyx"})
    assert keys(got, "z", "y", "x") == sorted((5 + a, 5 + b, 5 + c) for a, b, c in raster.SIX)


def test_diamond_sizes(spark):
    p = spark.createDataFrame([(1, 0, 10, 10)], "spot_id long, z long, y long, x long")
    assert raster.diamond(p, 4, (64, 64)).count() == 16
    assert raster.diamond(p, 4, (64, 64), filled=True).count() == 41


def test_projections(spark):
    img = image(spark, [[[k]] for k in range(5)])
    assert keys(raster.project_full(img, 2), "plane", "v") == [(0, 1.0), (1, 3.0)]
    assert keys(raster.project_grouped(img, 2), "plane", "v") == [(0, 1.0), (1, 3.0), (2, 4.0)]
    assert keys(raster.project_grouped(img, 2, True), "plane", "v") == [(0, 0.0), (1, 2.0), (2, 4.0)]


def test_minmax_of_a_constant_image(spark):
    assert {r.v for r in raster.minmax_normalise(image(spark, [[[3, 3], [3, 3]]])).collect()} == {0.0}


def test_tiles(spark):
    got = raster.tile_grid(spark.createDataFrame([(1, 1000, 100)], "image int, ny int, nx int"), 512, 64)
    assert keys(got, "y0", "y1") == [(0, 512), (448, 960), (896, 1000)]


def test_extrema_keep_plateaus(spark):
    got = raster.extrema(image(spark, [[[1, 5, 5, 1, 0, 2]]]), 0, 0, 1)
    assert keys(got, "x") == [(1,), (2,), (5,)]


def test_expansion_keeps_labels_and_breaks_ties(spark):
    lab = spark.createDataFrame([(0, 5, 5, 2), (0, 5, 9, 1)], "plane long, y long, x long, label long")
    got = {(r.y, r.x): r.label for r in raster.expand_labels(lab, 3, (20, 20)).collect()}
    assert got[5, 5] == 2 and got[5, 9] == 1 and got[5, 7] == 1 and (5, 13) not in got


def test_thresholds(spark):
    s = spark.createDataFrame([(1, 10.0, 1.0), (2, 40.0, 4.0), (3, 20.0, 2.0), (4, 30.0, 3.0)], "spot_id long, t double, p double")
    assert sp.threshold_rank(s, "t", "p", 0.5).first().peak == 3.0
    ten = spark.createDataFrame([(float(k),) for k in range(10)], "v double")
    assert sp.threshold_percentile(ten, "v").first()[0] == pytest.approx(8.91)
    assert sp.threshold_percentile(ten.where("v > 99"), "v").first()[0] == 0.0


def test_assignment_conserves_spots(spark):
    lab = spark.createDataFrame([(0, y, x, 1 + x // 4) for y in range(4) for x in range(8)], "plane long, y long, x long, label long")
    s = spark.createDataFrame([(k, 0, k % 5, k % 9, 1.0) for k in range(50)], "spot_id long, plane long, y long, x long, intensity double")
    a = sp.assign(s, lab)
    inside = sum(r.n for r in sp.cell_counts(a, lab).collect())
    assert inside + sum(r.background for r in sp.background_counts(a).collect()) == 50


def test_relabel(spark):
    c = spark.createDataFrame([(0, k + 1, n) for k, n in enumerate((0, 2, 0, 5))], "plane long, label long, n long")
    assert keys(sp.positive_relabel(c), "label", "new_label") == [(1, 0), (2, 1), (3, 0), (4, 2)]


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [(int(k), int(z), int(y), int(x)) for k, (z, y, x) in enumerate(rng.integers(0, 14, (150, 3)))]
    got = {r.spot_id: (r.is_core, r.cluster) for r in sp.clusters(spark.createDataFrame(pts, "spot_id long, z long, y long, x long"), (100.0, 100.0, 100.0), 180.0, 4).collect()}
    near = {a[0]: [b[0] for b in pts if sum((p - q) ** 2 for p, q in zip(a[1:], b[1:])) <= 3.24] for a in pts}
    core = {k for k, v in near.items() if len(v) >= 4}
    label = {k: k for k in core}
    for _ in core:
        label = {k: min(label[j] for j in near[k] if j in core) for k in core}
    for k in near:
        around = [label[j] for j in near[k] if j in core]
        assert got[k] == (k in core, min(around) if around else None)


def test_two_sample_tests(spark):
    cells = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 6.0), ("c", 1.0), ("c", 2.0), ("d", 3.0), ("d", 4.0)], "g string, v double")
    pairs = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "a"), ("a", "none")], "a string, b string")
    w = {r.comparison: r for r in cohort.welch_p(cohort.welch(cells, pairs, "g", "v")).collect()}
    assert w["a vs b"].t_stat == pytest.approx(-2 / math.sqrt(5 / 3)) and w["a vs b"].df == pytest.approx(50 / 17)
    assert w["a vs b"].p_value == pytest.approx(0.2209, abs=2e-3) and "a vs none" not in w
    k = {r.comparison: r for r in cohort.ks_p(cohort.kolmogorov_smirnov(cells, pairs.where("a <> b"), "g", "v")).collect()}
    assert k["c vs d"].ks_stat == 1.0
    u = {r.comparison: r for r in cohort.mwu_p(cohort.mann_whitney(cells, pairs.where("a <> b"), "g", "v")).collect()}
    assert u["c vs d"].u_stat == 0.0


def test_special_functions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert special.beta_tail(2, 3, 0.5) == pytest.approx(0.6875)


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).selectExpr("id % 7 as g", "id * 7919 % 1009 as v")
    got = running_sums(df.repartition(3), ["v"], {"s": df.v}, ["g"]).collect()
    for g in range(7):
        own = sorted((r.v, r.s) for r in got if r.g == g)
        assert [s for _, s in own] == list(np.cumsum([v for v, _ in own]))
    assert sorted(r.rn for r in numbered(df, ["v", "g"]).collect()) == list(range(1000))


def test_array_files(spark, tmp_path):
    stack = np.arange(24, dtype="<u2").reshape(2, 3, 4)
    assert (arrays.tiff_stack(arrays.tiff_bytes(stack)) == stack).all()
    assert (arrays.npy_array(arrays.npy_bytes(stack)) == stack).all()
    np.save(tmp_path / "a.npy", stack[0])
    np.savez(tmp_path / "b.npz", p=stack[0, 0], q=stack[1])
    got = arrays.read_arrays(spark, f"file://{tmp_path}")
    assert got.where("member = ''").count() == 12 and got.where("member = 'p'").count() == 4 and got.where("member = 'q'").count() == 12


def test_manifest_and_sidecars(spark, tmp_path):
    df = spark.createDataFrame([("/e/l001.tif",), ("/e/stacked_001.tif",), ("/e/max_projection_001.tif",), ("/e/x01.tif",)], "path string")
    assert keys(files.label_images(df), "path") == [("/e/l001.tif",)]
    lines = spark.createDataFrame([("shape: 1",), ("threshold: 7.5",), ("threshold:  8",)], "value string")
    assert keys(files.thresholds(lines), "threshold") == [(7.5,), (8.0,)]
    (tmp_path / ".hid").mkdir()
    (tmp_path / ".hid" / "a565.tif").write_bytes(b"x")
    (tmp_path / "b565.tif").write_bytes(b"x")
    assert files.find(spark, f"file://{tmp_path}", "*565.tif").count() == 1
