"""Whole analyses as one lazy plan: detection, assignment, counterstain positives, cohort statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorite.functions.config import Settings
from fluorite.functions.joins import shuffled
from fluorite.functions.ranking import numbered, percentiles
from fluorite.functions.scratch import stage
from fluorite.operators import cohort, raster
from fluorite.operators import spots as sp
from fluorite.operators.dense import decompose
from fluorite.operators.fitting import gaussian_fit
from fluorite.operators.raster import image_of


def _response(img: DataFrame, settings: Settings, digits: int) -> DataFrame:
    return raster.log_response(img, dict(zip("zyx", settings.kernel_size, strict=True))).withColumn("v", F.round("v", digits))


def _named(peaks: DataFrame) -> DataFrame:
    """Maxima as spots, numbered in order of image and place over the whole table."""
    return stage(numbered(peaks.withColumnRenamed("v", "peak"), [*image_of(peaks), "z", "y", "x"], "spot_id"))


def control_spots(control: DataFrame, settings: Settings, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """All candidates of a control stack, the maxima of its filter response above 0: spot_id, z, y, x and peak. And the response."""
    response = stage(_response(control, settings, digits))
    return _named(raster.extrema(response, *settings.minimal_distance)), response


def control_peaks(control: DataFrame, settings: Settings, digits: int = 9) -> DataFrame:
    """spot_id and peak of a control's candidates: the response at their places."""
    found, response = control_spots(control, settings, digits)
    return sp.gather(found.drop("peak"), response).select("spot_id", "peak")


def control_intensities(control: DataFrame, settings: Settings, digits: int = 9, max_levels: int = 10) -> DataFrame:
    """A control's candidates with what the response sums to over the voxels that flow from them: spot_id, place, peak, total."""
    found, response = control_spots(control, settings, digits)
    total = sp.integrate(raster.flood_fill(response, found, max_levels), response)
    return found.join(shuffled(total), "spot_id").select("spot_id", *image_of(found), "z", "y", "x", "peak", "total", "n_voxels")


def _levels(response: DataFrame, share: float, name: str) -> DataFrame:
    """One row, or one for each image: the percentile of ``v``."""
    by = image_of(response)
    return percentiles(response, "v", [share], by).select(*by, F.get("q", F.lit(0)).alias(name))


def _with_level(peaks: DataFrame, level: DataFrame) -> DataFrame:
    by = image_of(peaks)
    return peaks.join(level, by) if by else peaks.join(F.broadcast(level))


def _measured(found: DataFrame, response: DataFrame, img: DataFrame, max_levels: int) -> DataFrame:
    """``found`` with what the image sums to over each spot's flood-filled voxels, their number and span along each axis."""
    voxels = stage(raster.flood_fill(response, found, max_levels))
    out = found.join(shuffled(sp.integrate(voxels, img)), "spot_id").join(shuffled(sp.spans(voxels)), "spot_id")
    return out.select(*found.columns, "total", "n_voxels", *[f"span_{a}" for a in "zyx"])


def _found(img: DataFrame, settings: Settings, manual: float | None, control: DataFrame | None, digits: int, automatic: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spots with the level used, the filter response, and the level of each image. ``control``: its candidates."""
    # The threshold, the maxima and each level of the fill read the response: it is computed once and written.
    response = stage(_response(img, settings, digits))
    peaks = stage(raster.extrema(response, *settings.minimal_distance))
    level = sp.knee_threshold(peaks).withColumnRenamed("threshold", "auto") if automatic == "knee" else _levels(response.where("v > 0"), 0.999, "auto")
    level = level.withColumn("control", F.lit(None).cast("double"))
    if control is not None:
        level = level.drop("control").join(F.broadcast(sp.threshold_percentile(control, "peak").withColumnRenamed("threshold", "control")))
    lit = lambda x: F.lit(x).cast("double")
    chosen = sp.threshold_precedence(lit(manual), F.col("control"), lit(settings.experiment_threshold), F.col("auto"))
    level = stage(level.select(*image_of(level), chosen.alias("level")))
    return _named(_with_level(peaks, level).where("v >= level").drop("level")), response, level


def detect(img: DataFrame, settings: Settings, manual: float | None = None, control: DataFrame | None = None, digits: int = 9, automatic: str = "knee") -> DataFrame:
    """Spots of each stack: spot_id, z, y, x, peak, total, n_voxels and the span of each axis.

    Filter response, threshold (given, of the control, of the settings, or automatic), local maxima at least as bright, what the
    image sums to over each one's flood-filled voxels, and, with a control, without the spots below its mean sum.
    ``automatic``: ``knee`` of the image's curve of spot counts, or the 0.999 ``quantile`` of its positive response. ``digits``:
    the response is rounded, so plateaus don't depend on the order of sums.
    """
    dim = None if control is None else stage(control_intensities(control, settings, digits))
    found, response, _ = _found(img, settings, manual, dim, digits, automatic)
    out = _measured(found, response, img, settings.max_levels)
    if dim is not None:
        out = sp.background_filter(out, dim.select("total"), "total").drop("control_mean")
    return out.select("spot_id", *image_of(found), "z", "y", "x", "peak", "total", "n_voxels", *[f"span_{a}" for a in "zyx"])


@dataclass(frozen=True)
class Analysis:
    """What a whole detection run leaves: spots of the last stage, clusters, dense regions, and a row for each stage."""

    spots: DataFrame
    clusters: DataFrame
    regions: DataFrame
    stages: DataFrame


def analyse(img: DataFrame, settings: Settings, manual: float | None = None, control: DataFrame | None = None, digits: int = 9, automatic: str = "knee") -> Analysis:
    """Detection, decomposition of dense regions, background removal and clustering, with what each stage leaves.

    ``spots``: spot_id, z, y, x, region (of spots of the mixture), total, n_voxels, spans and cluster. ``clusters``: cluster,
    n_spots and centroid. ``stages``: for each image and stage (raw, decomposed, background_removed, clustered) how many
    spots there are, their mean sum, the threshold used and the type of their places. Without ``settings.decomposition``, or
    without a control, that stage leaves all spots as they are.
    """
    by = image_of(img)
    place = [*by, "z", "y", "x"]
    dim = None if control is None else stage(control_intensities(control, settings, digits))
    found, response, level = _found(img, settings, manual, dim, digits, automatic)
    raw = stage(_measured(found, response, img, settings.max_levels))
    if settings.decomposition is None:
        apart, regions = raw.withColumn("region", F.lit(None).cast("long")), raw.sparkSession.createDataFrame([], "region long, n_voxels long, n_before long, n_spots long")
    else:
        split, regions, _ = decompose(img, raw, settings.spot_voxels, settings.decomposition)
        split = stage(numbered(split.withColumnRenamed("spot_id", "was"), [*place, "region", "was"], "spot_id"))
        apart = _measured(split.drop("was"), response, img, settings.max_levels)
    apart = stage(apart)
    bright = apart if dim is None else stage(sp.background_filter(apart, dim.select("total"), "total").drop("control_mean"))
    clustered = stage(sp.clusters(bright, settings.voxel_size, settings.radius_for_spots, settings.min_spots_for_clusters))
    spots = bright.join(shuffled(clustered.select("spot_id", "cluster")), "spot_id").select("spot_id", *place, "region", "total", "n_voxels", *[f"span_{a}" for a in "zyx"], "cluster")
    spots = stage(spots)

    kind = dict(img.dtypes)["z"]
    rows = [df.select(*by, "total", F.lit(name).alias("stage"), F.lit(k).alias("step")) for k, (name, df) in enumerate((("raw", raw), ("decomposed", apart), ("background_removed", bright), ("clustered", spots.where("cluster IS NOT NULL"))))]
    sums = reduce(DataFrame.unionByName, rows).groupBy(*by, "stage", "step").agg(F.count("*").alias("n"), F.avg("total").alias("mean_total"))
    every = level.crossJoin(F.broadcast(img.sparkSession.createDataFrame([("raw",), ("decomposed",), ("background_removed",), ("clustered",)], "stage string")))
    stages = every.join(sums.drop("step"), [*by, "stage"], "left").select(*by, "stage", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_total", F.col("level").alias("threshold"), F.lit(kind).alias("place_type"))
    return Analysis(spots, sp.cluster_table(spots, spots), regions, stages)


def threshold_survey(img: DataFrame, cohorts: DataFrame, settings: Settings, digits: int = 9) -> DataFrame:
    """Automatic thresholds of all images, summed up for each cohort: cohort, n_images, mean, median, least and most.

    ``cohorts``: image_id and cohort (control, experiment, counterstain, its control). Images without a maximum have none.
    """
    peaks = raster.extrema(stage(_response(img, settings, digits)), *settings.minimal_distance)
    each = stage(sp.knee_threshold(peaks).join(cohorts.select("image_id", "cohort"), "image_id"))
    middle = percentiles(each, "threshold", [0.5], ["cohort"]).select("cohort", F.get("q", F.lit(0)).alias("median_threshold"))
    out = each.groupBy("cohort").agg(F.count("*").alias("n_images"), F.avg("threshold").alias("mean_threshold"), F.min("threshold").alias("least"), F.max("threshold").alias("most"))
    return out.join(middle, "cohort").select("cohort", "n_images", "mean_threshold", "median_threshold", "least", "most")


def detect_minima(img: DataFrame, settings: Settings, threshold: float | None = None, share: float = 0.999, fit_radius: int | None = 2, min_r2: float = 0.8, digits: int = 9) -> DataFrame:
    """The second detector: minima of the negated response at most as high as a threshold, each with a Gaussian fit of its patch.

    Without a threshold it is the ``share`` quantile of the image's negative values; values above it count as 0. ``fit_radius``:
    None leaves out the fit. Returns spot_id, z, y, x, peak and, with the fit, total, the sigmas and r2.
    """
    response = stage(_response(img, settings, digits).withColumn("v", -F.col("v")))
    by = image_of(response)
    level = _levels(response.where("v < 0"), share, "level") if threshold is None else None
    cut = _with_level(response, level) if level is not None else response.withColumn("level", F.lit(float(threshold)))
    cut = cut.select(*by, "z", "y", "x", F.when(F.col("v") <= F.col("level"), F.col("v")).otherwise(0.0).alias("v"))
    found = _named(raster.extrema(cut, *settings.minimal_distance, kind="min"))
    place = found.select("spot_id", *by, "z", "y", "x", "peak")
    return place if fit_radius is None else shuffled(place).join(gaussian_fit(img, found, fit_radius, settings.kernel_size, min_r2), "spot_id")


def assign_to_cells(spots: DataFrame, labels: DataFrame, k: int, distance: int = 0, bounds: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of each cell and of each plane's background; labels are widened first if ``distance`` is given."""
    if distance and bounds:
        labels = raster.expand_labels(labels, distance, bounds).drop("d2")
    assigned = sp.assign(spots.withColumn("plane", raster.plane_of(F.col("z"), k)), labels)
    return sp.cell_counts(assigned, labels), sp.background_counts(assigned)


def counterstain(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """Pixels of the cells that have spots, with labels that follow each other."""
    new = sp.positive_relabel(counts).where("new_label > 0").select(*image_of(counts), "plane", "label", "new_label", "n")
    return sp.zonal_map(labels, new).select(*image_of(labels), "plane", "y", "x", F.col("new_label").alias("label"), "n")


def cohort_tests(cells: DataFrame, pairs: DataFrame, group: str, value: str) -> DataFrame:
    """All three tests of each pair as rows (test, comparison, statistic, p_value, label), by p."""
    w = cohort.welch_p(cohort.welch(cells, pairs, group, value)).select(F.lit("welch").alias("test"), "comparison", F.col("t_stat").alias("statistic"), "p_value")
    k = cohort.ks_p(cohort.kolmogorov_smirnov(cells, pairs, group, value)).select(F.lit("ks").alias("test"), "comparison", F.col("ks_stat").alias("statistic"), "p_value")
    u = cohort.mwu_p(cohort.mann_whitney(cells, pairs, group, value)).select(F.lit("mwu").alias("test"), "comparison", F.col("u_stat").alias("statistic"), "p_value")
    every = w.unionByName(k).unionByName(u)
    return every.withColumn("label", cohort.significance(F.col("p_value"))).orderBy("p_value", "test", "comparison")
