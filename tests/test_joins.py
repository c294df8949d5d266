"""Tables that are larger than Spark expects aren't broadcast."""

import numpy as np
from pyspark.sql import functions as F

from fluorite.functions import components
from fluorite.functions.config import Settings
from fluorite.functions.scratch import stage
from fluorite.operators import dense, fitting, raster, shapes
from fluorite.operators import spots as sp
from fluorite.operators.fitting import gaussian_fit
from fluorite.plans.pipelines import detect_minima


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def volume(spark, shape=(4, 8, 8), seed=3):
    stack = np.random.default_rng(seed).integers(0, 9, shape)
    return spark.createDataFrame([(*map(int, p), float(v)) for p, v in np.ndenumerate(stack)], "z long, y long, x long, v double")


def points(spark):
    """Points in a file, so that Spark knows how small it is."""
    return stage(spark.createDataFrame([(1, 1, 4, 4), (2, 0, 0, 7)], "spot_id long, z long, y long, x long"))


def test_crops_are_shuffled(spark):
    out = raster.centre_crop(volume(spark), points(spark), 1, 2, 2)
    assert "Broadcast" not in plan(out) and "SortMergeJoin" in plan(out)
    assert out.count() == 25 + 3 * 3


def test_patches_are_shuffled(spark):
    out = gaussian_fit(volume(spark), points(spark), 1, min_r2=-np.inf)
    assert "Broadcast" not in plan(out) and out.count() == 2
    out = detect_minima(stage(volume(spark)), Settings(kernel_size=(0.0, 1.0, 1.0), minimal_distance=(1, 2, 2)), threshold=0.0, min_r2=-np.inf)
    assert "Broadcast" not in plan(out)


def test_patches_in_slices(spark, monkeypatch):
    fit = lambda: sorted(map(tuple, gaussian_fit(volume(spark), points(spark).coalesce(1), 1, min_r2=-np.inf).collect()))
    whole = fit()
    monkeypatch.setattr(fitting, "AT_ONCE", 1)
    assert fit() == whole


def blobs(spark, seed, labels=6):
    """Labels of random pixels, some in pieces, in two planes."""
    rng = np.random.default_rng(seed)
    rows = [(int(n % 2), int(y), int(x), int(n)) for n in range(labels) for y, x in rng.integers(0, 14, 2) + rng.integers(-4, 5, (25, 2))]
    return stage(spark.createDataFrame(rows, "plane long, y long, x long, label long").distinct())


def test_outlines_and_overlaps_are_shuffled(spark):
    truth = blobs(spark, 1)
    found = stage(shapes.star_reconstruct(truth, [4, 16]))
    assert "Broadcast" not in plan(shapes.star_reconstruct(truth, [4, 16]))
    own = stage(truth.withColumn("n_rays", F.explode(F.array(F.lit(4), F.lit(16)))))
    assert "Broadcast" not in plan(sp.best_overlap(own, found, ("n_rays", "plane", "y", "x")))


def test_matches_are_shuffled(spark):
    truth = blobs(spark, 1)
    assert "Broadcast" not in plan(sp.match_labels(truth, blobs(spark, 2)))


def test_outlines_sector_by_sector(spark, monkeypatch):
    """Large outlines go line by line of a sector, with the same pixels."""
    made = lambda: sorted(map(tuple, shapes.star_reconstruct(blobs(spark, 4), [1, 2, 3, 4, 32]).collect()))
    whole = made()
    monkeypatch.setattr(shapes, "AT_ONCE", 7)
    assert made() == whole and len({r[0] for r in whole}) == 5


def test_labels_of_spots_are_shuffled(spark):
    labels, own = blobs(spark, 5), stage(points(spark).select("spot_id", (F.col("z") % 2).alias("plane"), "y", "x", F.lit(1.0).alias("intensity")))
    assigned = sp.assign(own, labels)
    assert "Broadcast" not in plan(assigned) and assigned.count() >= 2
    assert "Broadcast" not in plan(sp.cell_counts(stage(assigned), labels))


def test_every_label_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sp, "PART", 3)
    labels = spark.createDataFrame([(0, 0, 0, 8), (0, 0, 1, 2), (1, 0, 0, 3), (2, 0, 0, 0)], "plane long, y long, x long, label long")
    counts = stage(spark.createDataFrame([(0, 2, 5), (0, 8, 1), (0, 9, 7), (1, 1, 4), (2, 0, 3)], "plane long, label long, n long"))
    out = sp.outer_counts(counts, labels)
    assert "Broadcast" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(0, k, {2: 5, 8: 1}.get(k, 0)) for k in range(1, 9)] + [(1, k, 4 * (k == 1)) for k in range(1, 4)]


def test_voxels_of_spots_are_shuffled(spark, monkeypatch):
    """Each table that a fill, a sum, a decomposition and its components write is made without a broadcast of spots' voxels."""
    img, own = volume(spark), points(spark)
    assert "Broadcast" not in plan(sp.integrate(own, img)) and "Broadcast" not in plan(sp.gather(own, img))
    seen, write = [], raster.stage
    for module in (raster, dense, components):
        monkeypatch.setattr(module, "stage", lambda df: seen.append(plan(df)) or write(df))
    raster.flood_fill(stage(img), own, 2)
    assert len(seen) >= 2 and not any("Broadcast" in p for p in seen)
    seen.clear()
    regions = dense.bright_regions(stage(img.withColumn("image_id", F.lit(0))), stage(spark.createDataFrame([(0, 5.0)], "image_id int, level double")))
    patch = dense.reference_spot(stage(img), own, {"z": 0.5, "y": 0.5, "x": 0.5}, 0.5)
    assert regions.count() == img.where("v > 5").count() and patch.count() == 27
    joined = [p for p in seen if "Join" in p and "level" not in p and "_before" not in p]  # sums before each range are a few rows
    assert joined and not any("Broadcast" in p for p in joined)
