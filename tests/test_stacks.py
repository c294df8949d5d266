"""Several stacks in one table, exact percentiles, awkward group keys, and the parts of the analyses that read or write files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorite.functions import config
from fluorite.functions.components import connected_components
from fluorite.functions.ranking import numbered, percentiles
from fluorite.functions.scratch import stage
from fluorite.operators import cohort, dense, raster
from fluorite.operators import spots as sp
from fluorite.operators.fitting import gaussian_fit
from fluorite.plans import pipelines
from fluorite.sources import arrays, files, sinks


@pytest.fixture(scope="module")
def two(spark):
    """Two stacks in one table, and each alone."""
    rng = np.random.default_rng(3)
    stacks = [np.round(rng.normal(size=(4, 7, 6)), 3), np.round(rng.normal(size=(3, 7, 6)), 3)]
    rows = [(i, z, y, x, float(v)) for i, s in enumerate(stacks) for (z, y, x), v in np.ndenumerate(s)]
    df = spark.createDataFrame(rows, "image_id long, z long, y long, x long, v double")
    return df, [df.where(F.col("image_id") == i).drop("image_id") for i in range(2)]


def rows(df, image=None):
    cols = [c for c in df.columns if c != "image_id"]
    if image is not None:
        df = df.where(F.col("image_id") == image)
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize(
    "operator",
    [
        lambda i: raster.project_grouped(i, 2),
        lambda i: raster.project_grouped(i, 2, compat_drop_last=True),
        lambda i: raster.minmax_normalise(i),
        lambda i: raster.percentile_normalise(i),
        lambda i: raster.extrema(i, 1, 1, 1),
        lambda i: raster.gaussian(i, {"z": 0.7, "y": 1.0}),
        lambda i: raster.log_filter(i, {"y": 0.8}, {"y": (0, 6)}),
        lambda i: dense.bright_regions(i, 0.5).groupBy(*raster.image_of(i), "region").agg(F.count("*").alias("n"), F.min("v").alias("v")).drop("region"),
    ],
)
def test_stacks_do_not_mix(two, operator):
    both, alone = two
    got = stage(operator(both))
    for i in range(2):
        assert rows(got, i) == rows(operator(alone[i])) != []


def test_spots_of_stacks_do_not_mix(spark, two):
    both, alone = two
    seeds = stage(raster.extrema(both, 0, 1, 1).withColumn("spot_id", F.col("image_id") * 10_000 + F.col("z") * 100 + F.col("y") * 10 + F.col("x")))
    flood = stage(raster.flood_fill(both, seeds, 3))
    total = stage(sp.integrate(flood, both))
    fits = stage(gaussian_fit(both, seeds, 1, min_r2=-9.0).select("spot_id", "total"))
    for i in range(2):
        own = seeds.where(F.col("image_id") == i).drop("image_id")
        one = raster.flood_fill(alone[i], own, 3)
        mine = F.floor(F.col("spot_id") / 10_000) == i
        assert rows(flood, i) == rows(one) and rows(total.where(mine)) == rows(sp.integrate(one, alone[i]))
        assert rows(fits.where(mine)) == rows(gaussian_fit(alone[i], own, 1, min_r2=-9.0).select("spot_id", "total"))
    settings = config.Settings(kernel_size=(0.0, 1.0, 1.0), minimal_distance=(1, 1, 1), max_levels=3)
    found = stage(pipelines.detect(both, settings, manual=0.0).drop("spot_id"))
    for i in range(2):
        assert rows(found, i) == rows(pipelines.detect(alone[i], settings, manual=0.0).drop("spot_id")) != []
    kept = pipelines.detect(both, settings, manual=0.0, control=alone[0])
    mean = pipelines.control_intensities(alone[0], settings).agg(F.avg("total")).first()[0]
    assert sorted(r.total for r in kept.collect()) == pytest.approx(sorted(r.total for r in found.collect() if r.total >= mean))


def test_expansion_against_brute_force(spark):
    rng = np.random.default_rng(4)
    lab = {(i, int(p), int(y) + dy, int(x) + dx): k for k, (i, p, y, x) in enumerate(rng.integers(0, (2, 2, 15, 15), (8, 4)), 1) for dy in range(4) for dx in range(3)}
    df = spark.createDataFrame([(int(i), p, y, x, k) for (i, p, y, x), k in lab.items()], "image_id long, plane long, y long, x long, label long")
    got = {(r.image_id, r.plane, r.y, r.x): (r.d2, r.label) for r in raster.expand_labels(df, 4, (20, 20)).collect()}
    want = {}
    for i in range(2):
        for p in range(2):
            own = [(y, x, k) for (a, b, y, x), k in lab.items() if (a, b) == (i, p)]
            for y in range(20):
                for x in range(20):
                    best = min((((y - b) ** 2 + (x - c) ** 2, k) for b, c, k in own), default=(99, 0))
                    if best[0] <= 16:
                        want[i, p, y, x] = best
    assert got == want


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("a", 4)], "g string, v long")
    assert sorted((r.g or "", r.v, r.rn) for r in numbered(df, ["v"], by=["g"]).collect()) == [("", 2, 0), ("", 3, 1), ("a", 1, 0), ("a", 4, 1)]
    assert sorted((r.g or "", r.q) for r in percentiles(df, "v", [0.5], ["g"]).collect()) == [("", [2.5]), ("a", [2.5])]


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(5)
    values = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), np.round(rng.normal(size=500), 1))] + [(0, None), (7, None), (8, 4.0)]
    df = spark.createDataFrame(values, "g long, v double").repartition(5)
    shares = [0.0, 0.013, 0.5, 0.998, 1.0]
    got = {r.g: r.q for r in percentiles(df, "v", shares, ["g"]).collect()}
    assert set(got) == {0, 1, 2, 8} and got[8] == [4.0] * 5
    for g in range(3):
        assert got[g] == pytest.approx(np.quantile([v for h, v in values if h == g and v is not None], shares).tolist())
    assert percentiles(df.where("g = 7"), "v", [0.5]).count() == 0 or percentiles(df.where("g = 7"), "v", [0.5]).first().q in (None, [None])


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1002), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_conditions_match_by_prefix(spark):
    df = spark.createDataFrame([("Incision_0h_1", 1.0), ("Incision_0h_2", 2.0), ("Amputation_0h_1", 3.0), (None, 4.0), ("other", 5.0)], "c string, v double")
    assert sorted((r.c, r.v) for r in cohort.by_prefix(df, ["Incision_0h", "Amputation_0h"], "c").collect()) == [("Amputation_0h", 3.0), ("Incision_0h", 1.0), ("Incision_0h", 2.0)]


def test_assignment_with_widened_labels(spark):
    labels = spark.createDataFrame([(i, 0, 5, 5, 1 + i) for i in range(2)], "image_id long, plane long, y long, x long, label long")
    spots = spark.createDataFrame([(1, 0, 3, 5, 7, 2.0), (2, 1, 3, 5, 9, 3.0), (3, 1, 0, 5, 5, 4.0)], "spot_id long, image_id long, z long, y long, x long, intensity double")
    counts, background = pipelines.assign_to_cells(spots, labels, 7, 2, (20, 20))
    assert sorted((r.image_id, r.label, r.n, r.intensity) for r in counts.collect()) == [(0, 1, 1, 2.0), (1, 2, 1, 4.0)]
    assert sorted((r.image_id, r.background, r.assigned) for r in background.collect()) == [(0, 0, 1), (1, 1, 1)]
    assert sorted(r.pct for r in sp.percent_of_max(spots).collect()) == [75.0, 100.0, 100.0]


def test_array_files_in_parts(spark):
    spots = spark.createDataFrame([(k, "a" if k % 3 else None, k, k + 1, k + 2) for k in range(50)], "spot_id long, c string, z long, y long, x long")
    written = stage(arrays.spots_npy(spots, "c", rows_per_file=8))
    assert written.count() == 5 + 3 and max(len(arrays.npy_array(bytes(r.content))) for r in written.collect()) == 8
    got = arrays.array_rows(written).join(written.select("path", "first_row"), "path").where("col = 0 AND path LIKE 'a/%'")
    assert [r.value for r in got.withColumn("at", F.col("row") + F.col("first_row")).orderBy("at").collect()] == [float(k) for k in range(50) if k % 3]


def test_settings_of_a_file(tmp_path):
    text = "controlImage: false\ncontrolPath: null\nminimal_distance: [1, 2, 2]\nkernel_size: [1, 1.7, 1.7]\nvoxel_size: [361, 75, 75]\nvoxel_size: [500, 75, 75]\nexperimentThreshold: 12.5\nuse_gpu: true\nresults_folder: out\n"
    got = config.from_text(text)
    assert got.minimal_distance == (1, 2, 2) and got.voxel_size == (500, 75, 75) and got.experiment_threshold == 12.5 and got.control_threshold is None
    assert got.anisotropy == 500 / 75 and got.results_folder == "out" and got.unknown == {"use_gpu": True}
    assert config.from_text("").max_levels == 20
    for wrong in ("controlImage: true", "kernel_size: [1, 2]"):
        with pytest.raises(ValueError):
            config.from_text(wrong)


def test_tables_and_manifests_on_disk(spark, tmp_path):
    long = spark.createDataFrame([("a_1", 1.0), ("a_1", 2.0), ("b_1", 3.0)], "c string, v double")
    out = f"file://{tmp_path}/wide"
    for _ in range(2):  # results replace what is there
        sinks.write_wide_csv(long, out, "c", "v", ["v"], ["a_1", "b_1"])
    back = {(r.a_1, r.b_1) for r in sinks.read_wide_csv(spark, out, ["a_1", "b_1"]).collect()}
    assert back == {(1.0, 3.0), (2.0, None)}
    sinks.write_tests_csv(spark.createDataFrame([("x vs y", 0.5), ("y vs z", 0.01)], "comparison string, p_value double"), f"file://{tmp_path}/tests")
    assert [r.comparison for r in spark.read.csv(f"file://{tmp_path}/tests", header=True).collect()] == ["y vs z", "x vs y"]
    sinks.write_table(long, f"file://{tmp_path}/table", ["c"])
    assert spark.read.parquet(f"file://{tmp_path}/table").count() == 3
    place = tmp_path / "exp" / "12hr_Incision" / "Image3" / "565" / "results"
    place.mkdir(parents=True)
    for name in ("p2.tif", "p10.tif", "p1.tif"):
        (place / name).write_bytes(b"x")
    found = files.find(spark, f"file://{tmp_path}/exp", "*.tif")
    cols = found.select("path", *[c.alias(k) for k, c in files.path_columns(F.col("path")).items()])
    assert {(r.hours, r.injury, r.image, r.channel) for r in cols.collect()} == {(12, "Incision", 3, "565")}
    named = files.planes(found.withColumn("folder", F.lit(1)), "folder", "path")
    assert [r.path.rsplit("/", 1)[1] for r in named.orderBy("plane").collect()] == ["p1.tif", "p10.tif", "p2.tif"]
