"""Spot tables (spot_id, z, y, x, intensity): thresholds, intensities, filters, clusters and assignment to cells.

As in ``raster``, a column ``image_id`` tells the stacks of a table apart; spot ids differ over all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fluorite.functions.components import connected_components
from fluorite.functions.joins import shuffled
from fluorite.functions.ranking import numbered, percentiles
from fluorite.functions.scratch import stage
from fluorite.operators.raster import image_of


def threshold_percentile(peaks: DataFrame, value: str, p: float = 0.99) -> DataFrame:
    """The percentile of ``value`` with linear interpolation; 0 without rows."""
    return percentiles(peaks, value, [p]).agg(F.coalesce(F.max(F.get("q", F.lit(0))), F.lit(0.0)).alias("threshold"))


def threshold_rank(spots: DataFrame, total: str, peak: str, p: float = 0.99) -> DataFrame:
    """Of spots in order of ``total``, the one at index int(n * p): its spot_id, total and peak. Ties go by spot_id."""
    ranked = numbered(spots.select("spot_id", F.col(total).alias("total"), F.col(peak).alias("peak")), ["total", "spot_id"])
    index = ranked.agg(F.least(F.floor(F.count("*") * p), F.count("*") - 1).alias("rn"))
    return ranked.join(F.broadcast(index), "rn").select("spot_id", "total", "peak")


def threshold_precedence(manual: Column, control: Column, experiment: Column, automatic: Column) -> Column:
    return F.coalesce(manual, control, experiment, automatic)


def elbow(peaks: DataFrame, value: str, lo: float, step: float, n: int) -> DataFrame:
    """How many values reach each threshold lo, lo + step, ...: a value is counted in its own bin, then bins are summed."""
    spark = peaks.sparkSession
    bins = peaks.where(F.col(value) >= lo).groupBy(F.least(F.floor((F.col(value) - lo) / step), F.lit(n - 1)).cast("long").alias("k")).agg(F.count("*").alias("c"))
    grid = spark.range(n).select(F.col("id").alias("k"))
    later = W.orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, 0)
    return grid.join(bins, "k", "left").select("k", (F.col("k") * step + lo).alias("threshold"), F.coalesce(F.sum("c").over(later), F.lit(0)).alias("n_spots"))


def knee_threshold(peaks: DataFrame, value: str = "v", n: int = 100) -> DataFrame:
    """``threshold``, where the curve of spot counts breaks; one row, or one for each image.

    The logarithm of how many of ``value`` reach each of ``n`` equal steps up to the largest is a steep line (noise), a flat one
    (spots), and an end that falls off where the brightest spots run out. The end is what comes after the point farthest above
    the line from first to last step, if that is the fourth step or a later one. Of all breaks of the rest, that with the
    smallest squared error of two lines is taken, the first of equal ones. Running sums give each break's error, so an image
    costs ``n`` rows. Values of 0 or less don't count; without others there is no row.
    """
    by = image_of(peaks)
    peaks = peaks.where(F.col(value) > 0)
    top = peaks.groupBy(*by).agg(F.max(value).alias("_top")).where("_top IS NOT NULL")
    binned = (peaks.join(top, by) if by else peaks.join(F.broadcast(top))).groupBy(*by, F.least(F.floor(F.col(value) / F.col("_top") * n), F.lit(n - 1)).cast("long").alias("k")).agg(F.count("*").alias("c"))
    grid = top.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    up, down = W.partitionBy(*by).orderBy("k"), W.partitionBy(*by).orderBy(F.desc("k"))
    curve = grid.join(binned, [*by, "k"], "left").withColumn("y", F.log(F.sum(F.coalesce("c", F.lit(0))).over(down.rowsBetween(W.unboundedPreceding, 0)).cast("double")))
    x, y, whole = F.col("k").cast("double"), F.col("y"), W.partitionBy(*by)
    straight = F.max_by("y", -x).over(whole) + (F.max_by("y", x).over(whole) - F.max_by("y", -x).over(whole)) * x / (n - 1)
    curve = curve.withColumn("_above", F.round(y - straight, 9)).withColumn("_end", -F.max(F.struct("_above", (-F.col("k")).alias("k"))).over(whole)["k"])
    curve = curve.withColumn("_end", F.when(F.col("_end") >= 3, F.col("_end")).otherwise(n - 1)).where(F.col("k") <= F.col("_end"))
    sums = {"m": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}

    def error(side: str):
        m, sx, sy, sxx, sxy, syy = (F.col(f"{side}_{c}") for c in sums)
        return syy - sy * sy / m - (sxy - sx * sy / m) * (sxy - sx * sy / m) / (sxx - sx * sx / m)

    before, rest = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing)
    curve = curve.withColumns({f"l_{c}": F.sum(e).over(before) for c, e in sums.items()} | {f"r_{c}": F.sum(e).over(rest) for c, e in sums.items()})
    breaks = curve.where((F.col("k") >= 2) & (F.col("k") < F.col("_end"))).withColumn("_e", F.round(error("l") + error("r"), 9))
    best = breaks.groupBy(*by).agg(F.min(F.struct("_e", "k", "_top")).alias("b"))
    return best.where("b IS NOT NULL").select(*by, (F.col("b._top") * F.col("b.k") / n).alias("threshold"))


def background_filter(spots: DataFrame, control: DataFrame, value: str = "intensity") -> DataFrame:
    """Spots at least as bright as the mean of ``control``; all of them if it has no rows."""
    mean = control.agg(F.avg(value).alias("control_mean"))
    return spots.join(F.broadcast(mean)).where(F.col("control_mean").isNull() | (F.col(value) >= F.col("control_mean")))


def integrate(voxels: DataFrame, img: DataFrame) -> DataFrame:
    """Sum of the image over each spot's voxels: spot_id, total, n_voxels."""
    place = [*image_of(img), "z", "y", "x"]
    return shuffled(voxels.select("spot_id", *place)).join(img, place).groupBy("spot_id").agg(F.sum("v").alias("total"), F.count("*").alias("n_voxels"))


def gather(points: DataFrame, img: DataFrame, name: str = "peak") -> DataFrame:
    """``points`` with the image's value at their place; those outside the image drop out."""
    place = [*image_of(img), "z", "y", "x"]
    return shuffled(points).join(img.select(*place, F.col("v").alias(name)), place)


def spans(voxels: DataFrame) -> DataFrame:
    """Per axis max - min + 1 (span) and (max - min) / 2 (radius)."""
    aggs = [x for a in "zyx" for x in ((F.max(a) - F.min(a) + 1).cast("long").alias(f"span_{a}"), ((F.max(a) - F.min(a)) / 2).alias(f"radius_{a}"))]
    return voxels.groupBy("spot_id").agg(*aggs)


def close_pairs(points: DataFrame, voxel: tuple[float, float, float], radius: float) -> DataFrame:
    """Ordered pairs of positions (with their weights) at most ``radius`` apart, each position with itself too.

    ``points``: z, y, x, n. Positions fall into grid cells as wide as the radius; each is sent to the 27 cells around its
    own, so pairs meet by an equi-join on the cell.
    """
    by = image_of(points)
    cell = [F.floor(F.col(a) * s / radius).cast("long").alias(f"c{a}") for a, s in zip("zyx", voxel, strict=True)]
    right = points.select(*by, F.col("z").alias("z2"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("n").alias("n2"), *cell)
    around = F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    left = points.select("*", *cell).withColumn("_s", F.explode(around))
    left = left.withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"_s.{a}") for a in "zyx"}).drop("_s")
    d2 = sum(F.pow((F.col(a) - F.col(f"{a}2")) * s, 2) for a, s in zip("zyx", voxel, strict=True))
    return shuffled(left).join(right, [*by, "cz", "cy", "cx"]).where(d2 <= radius * radius).select(*by, "z", "y", "x", "n", "z2", "y2", "x2", "n2")


def cluster_cores(spots: DataFrame, voxel: tuple[float, float, float], radius: float, min_spots: int) -> DataFrame:
    """spot_id, n_near (spots within the radius, itself included) and is_core.

    Spots of one voxel share their neighbourhood, so pairs are of voxels, however many spots fall on one.
    """
    place = [*image_of(spots), "z", "y", "x"]
    points = spots.groupBy(*place).agg(F.count("*").alias("n"))
    near = close_pairs(points, voxel, radius).groupBy(*place).agg(F.sum("n2").alias("n_near"))
    return spots.join(shuffled(near), place).select("spot_id", *place, "n_near", (F.col("n_near") >= min_spots).alias("is_core"))


def clusters(spots: DataFrame, voxel: tuple[float, float, float], radius: float, min_spots: int) -> DataFrame:
    """spot_id and cluster (smallest spot_id of its cores) by density: cores within the radius share a cluster, other spots
    take the smallest cluster of a core within it, and null without one."""
    by = image_of(spots)
    place = [*by, "z", "y", "x"]
    flagged = stage(cluster_cores(spots, voxel, radius, min_spots))
    points = stage(flagged.groupBy(*place).agg(F.lit(1).alias("n"), F.min(F.when(F.col("is_core"), F.col("spot_id"))).alias("core")))
    at = points.where("core IS NOT NULL").select(*place, "core")
    near = close_pairs(points.select(*place, "n"), voxel, radius)
    to = at.select(*by, F.col("z").alias("z2"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("core").alias("core2"))
    linked = stage(near.join(shuffled(to), [*by, "z2", "y2", "x2"]).join(shuffled(points.select(*place, "core")), place).select(*place, "core", "core2"))
    groups = shuffled(connected_components(linked.where("core < core2").select(F.col("core").alias("a"), F.col("core2").alias("b")), shuffled))
    # A core without another is its own cluster.
    own = linked.join(groups, linked.core2 == groups.node, "left").groupBy(*place).agg(F.min(F.coalesce("component", "core2")).alias("cluster"))
    return flagged.join(shuffled(own), place, "left").select("spot_id", "is_core", "cluster")


def cluster_table(spots: DataFrame, clustered: DataFrame) -> DataFrame:
    """Each cluster with its number of spots and their centroid: cluster, n_spots, z, y, x. ``clustered``: spot_id and cluster."""
    by = image_of(spots)
    own = spots.select("spot_id", *by, "z", "y", "x").join(clustered.where("cluster IS NOT NULL").select("spot_id", "cluster"), "spot_id")
    return own.groupBy(*by, "cluster").agg(F.count("*").alias("n_spots"), *[F.avg(a).alias(a) for a in "zyx"])


def assign(spots: DataFrame, labels: DataFrame) -> DataFrame:
    """Each spot (spot_id, plane, y, x, intensity) with the label of its pixel, 0 where there is none."""
    place = [*image_of(labels), "plane", "y", "x"]
    return spots.join(shuffled(labels.select(*place, "label")), place, "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("long"))


def cell_counts(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """plane, label, n and intensity for every label there is, zero without spots; background is left out first."""
    cell = [*image_of(labels), "plane", "label"]
    found = assigned.where("label > 0").groupBy(*cell).agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity"))
    every = labels.select(*cell[:-1], F.col("label").cast("long").alias("label")).distinct()
    return every.join(shuffled(found), cell, "left").select(*cell, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("intensity", F.lit(0.0)).alias("intensity"))


def percent_of_max(spots: DataFrame, value: str = "intensity", name: str = "pct") -> DataFrame:
    """``spots`` with ``value`` as percent of its largest in the image."""
    by = image_of(spots)
    top = spots.groupBy(*by).agg(F.max(value).alias("_top"))
    joined = spots.join(top, by) if by else spots.join(F.broadcast(top))
    return joined.withColumn(name, F.try_divide(F.col(value), F.col("_top")) * 100).drop("_top")


def background_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy(*image_of(assigned), "plane").agg(F.count_if(F.col("label") == 0).alias("background"), F.count_if(F.col("label") > 0).alias("assigned"))


def zonal_map(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """The count and intensity of each pixel's label."""
    cell = [*image_of(labels), "plane", "label"]
    return labels.select(*cell[:-1], "y", "x", F.col("label").cast("long").alias("label")).join(counts, cell)


def positive_relabel(counts: DataFrame, by: Sequence[str] = ("plane",)) -> DataFrame:
    """New labels 1, 2, ... in label order for labels with spots; 0 for the others."""
    order = W.partitionBy(*image_of(counts), *by, F.col("n") > 0).orderBy("label")
    return counts.withColumn("new_label", F.when(F.col("n") > 0, F.row_number().over(order)).otherwise(0).cast("long"))


def best_overlap(truth: DataFrame, found: DataFrame, keys: Sequence[str] = ("plane", "y", "x")) -> DataFrame:
    """For each label of ``truth`` the largest intersection over union with a label of ``found`` in its plane."""
    keys = [*image_of(truth), *keys]
    t = truth.select(*keys, F.col("label").alias("t"))
    f = found.select(*keys, F.col("label").alias("f"))
    plane = [k for k in keys if k not in ("y", "x")]
    common = t.join(shuffled(f), keys).groupBy(*plane, "t", "f").agg(F.count("*").alias("c"))
    sizes_t, sizes_f = t.groupBy(*plane, "t").agg(F.count("*").alias("nt")), f.groupBy(*plane, "f").agg(F.count("*").alias("nf"))
    iou = common.join(shuffled(sizes_t), [*plane, "t"]).join(shuffled(sizes_f), [*plane, "f"]).groupBy(*plane, "t").agg(F.max(F.col("c") / (F.col("nt") + F.col("nf") - F.col("c"))).alias("iou"))
    return sizes_t.join(shuffled(iou), [*plane, "t"], "left").select(*plane, F.col("t").alias("label"), F.coalesce("iou", F.lit(0.0)).alias("iou"))


def _assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of the one-to-one choice with the largest sum of ``gain`` (none below 0), by shortest augmenting paths."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    rows, cols = cost.shape
    u, v, owner = np.zeros(rows + 1), np.zeros(cols + 1), np.zeros(cols + 1, int)
    for r in range(1, rows + 1):
        owner[0], at = r, 0
        least, back, done = np.full(cols + 1, np.inf), np.zeros(cols + 1, int), np.zeros(cols + 1, bool)
        while True:
            done[at] = True
            i = owner[at]
            free = np.flatnonzero(~done[1:]) + 1
            reduced = cost[i - 1, free - 1] - u[i] - v[free]
            better = reduced < least[free]
            least[free[better]], back[free[better]] = reduced[better], at
            to = free[np.argmin(least[free])]
            step = least[to]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = to
            if not owner[at]:
                break
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    pairs = [(int(owner[c]) - 1, c - 1) for c in range(1, cols + 1) if owner[c]]
    return [(b, a) if flip else (a, b) for a, b in pairs]


def match_labels(truth: DataFrame, found: DataFrame, keys: Sequence[str] = ("plane", "y", "x"), least: float = 0.0) -> DataFrame:
    """Labels of ``truth`` and ``found`` matched one to one so that the sum of their intersections over union is largest.

    A row for each label of ``truth``: label, matched (null without) and iou (0 without). Pairs with an intersection over union
    of ``least`` or less don't match. Labels that overlap form small graphs; each of their components is solved by itself, so a
    task holds one group of labels that touch each other.
    """
    keys = [*image_of(truth), *keys]
    plane = [k for k in keys if k not in ("y", "x")]
    t, f = truth.select(*keys, F.col("label").alias("t")), found.select(*keys, F.col("label").alias("f"))
    sizes_t, sizes_f = t.groupBy(*plane, "t").agg(F.count("*").alias("nt")), f.groupBy(*plane, "f").agg(F.count("*").alias("nf"))
    common = t.join(shuffled(f), keys).groupBy(*plane, "t", "f").agg(F.count("*").alias("c"))
    iou = F.col("c") / (F.col("nt") + F.col("nf") - F.col("c"))
    pairs = common.join(shuffled(sizes_t), [*plane, "t"]).join(shuffled(sizes_f), [*plane, "f"]).select(*plane, "t", "f", iou.alias("iou")).where(F.col("iou") > least)
    pairs = stage(pairs)  # nodes of either side and edges read it
    # Labels of both sides are numbered as nodes of one graph.
    nodes = pairs.select(*plane, F.lit(0).alias("side"), F.col("t").alias("label")).unionByName(pairs.select(*plane, F.lit(1).alias("side"), F.col("f").alias("label"))).distinct()
    nodes = stage(numbered(nodes, [*plane, "side", "label"], "node"))
    a = nodes.where("side = 0").select(*plane, F.col("label").alias("t"), F.col("node").alias("a"))
    b = nodes.where("side = 1").select(*plane, F.col("label").alias("f"), F.col("node").alias("b"))
    edges = stage(pairs.join(shuffled(a), [*plane, "t"]).join(shuffled(b), [*plane, "f"]))
    groups = connected_components(edges.select("a", "b"), shuffled)

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by([("a", "ascending"), ("b", "ascending")])
        left, i = np.unique(group["a"].to_numpy(), return_inverse=True)
        right, j = np.unique(group["b"].to_numpy(), return_inverse=True)
        gain = np.zeros((len(left), len(right)))
        gain[i, j] = group["iou"].to_numpy()
        chosen = [(x, y) for x, y in _assignment(gain) if gain[x, y] > 0]
        return pa.table({"a": pa.array([int(left[x]) for x, _ in chosen], pa.int64()), "b": pa.array([int(right[y]) for _, y in chosen], pa.int64())})

    joined = edges.join(shuffled(groups.withColumnRenamed("node", "a")), "a").select("component", "a", "b", "iou")
    chosen = joined.groupBy("component").applyInArrow(solve, "a long, b long")
    matched = edges.join(shuffled(chosen), ["a", "b"]).select(*plane, "t", F.col("f").alias("matched"), "iou")
    out = sizes_t.drop("nt").join(shuffled(matched), [*plane, "t"], "left")
    return out.select(*plane, F.col("t").alias("label"), "matched", F.coalesce("iou", F.lit(0.0)).alias("iou"))


#: Numbers of labels that ``outer_counts`` lists from one row.
PART = 4096
#: Such rows in a task.
PARTS_AT_ONCE = 256


def outer_counts(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """plane, label, n for every number from 1 to the plane's largest label, 0 for those without spots or pixels.

    The numbers go in parts, which meet their counts before they are listed, so a join moves parts and not numbers.
    """
    by = [*image_of(labels), "plane"]
    most = labels.groupBy(*by).agg(F.max("label").cast("long").alias("_m")).where("_m >= 1")
    parts = most.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / PART))))
    item = F.struct(F.col("label").cast("long").alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    own = counts.where("label >= 1").groupBy(*by, F.floor((F.col("label") - 1) / PART).alias("_part")).agg(F.collect_list(item).alias("_own"))
    both = stage(parts.join(shuffled(own), [*by, "_part"], "left"))
    both = both.repartition(math.ceil(both.count() / PARTS_AT_ONCE) or 1)  # by their few bytes they would all go to one task
    own = F.filter(F.coalesce("_own", F.array().cast("array<struct<label:bigint,n:bigint>>")), lambda x: x["label"] <= F.col("_m"))
    every = F.sequence(F.col("_part") * PART + 1, F.least("_m", (F.col("_part") + 1) * PART))
    rest = F.transform(F.array_except(every, F.transform(own, lambda x: x["label"])), lambda x: F.struct(x.alias("label"), F.lit(0).cast("long").alias("n")))
    return both.select(*by, F.explode(F.concat(own, rest)).alias("_s")).select(*by, "_s.label", "_s.n")


def label_extents(labels: DataFrame) -> DataFrame:
    """Median height and width of the labels' boxes in each plane."""
    by = [*image_of(labels), "plane"]
    box = labels.groupBy(*by, "label").agg((F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"))
    return box.groupBy(*by).agg(F.median("h").alias("median_h"), F.median("w").alias("median_w"), F.count("*").alias("n_labels"))


def shapes_match(img: DataFrame, mask: DataFrame) -> DataFrame:
    """For each image the extents of its voxels (nz, ny, nx) and of its mask's (mz, my, mx), and whether they are equal.

    An image or a mask without the other has nulls there and isn't equal.
    """
    by = image_of(img)
    extent = lambda df, k: df.groupBy(*by).agg(*[(F.max(a) + 1).alias(f"{k}{a}") for a in "zyx"])
    same = (F.col("nz") == F.col("mz")) & (F.col("ny") == F.col("my")) & (F.col("nx") == F.col("mx"))
    both = extent(img, "n").join(extent(mask, "m"), by, "full") if by else extent(img, "n").join(extent(mask, "m"))
    return both.select(*by, "nz", "ny", "nx", "mz", "my", "mx", F.coalesce(same, F.lit(False)).alias("equal"))
