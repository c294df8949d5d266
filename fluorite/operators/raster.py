"""Image stacks as voxel rows (z, y, x, v): projections, normalisation, extrema, filters, tiles and shapes.

A table of several stacks names them in a column ``image_id``; where it is, every operator works on each stack by itself and
returns it. Spots then have it too; their ids differ over all stacks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fluorite.functions.joins import shuffled
from fluorite.functions.ranking import percentiles
from fluorite.functions.scratch import stage
from fluorite.operators.blocks import along, band, in_blocks


def image_of(df: DataFrame) -> list[str]:
    """The image key of a table, if it has one."""
    return ["image_id"] if "image_id" in df.columns else []


def plane_of(z: Column, k: int) -> Column:
    """Projected plane of a slice."""
    return F.floor(z / k).cast("long")


def project_full(img: DataFrame, k: int) -> DataFrame:
    """Maximum over windows of ``k`` slices; a last window with fewer is dropped. Returns plane, y, x, v."""
    out = img.groupBy(*image_of(img), plane_of(F.col("z"), k).alias("plane"), "y", "x").agg(F.max("v").alias("v"), F.count("*").alias("n"))
    return out.where(F.col("n") == k).drop("n")


def project_grouped(img: DataFrame, k: int, compat_drop_last: bool = False) -> DataFrame:
    """Maximum over groups of ``k`` slices, the last may have fewer.

    ``compat_drop_last`` leaves out the last slice of each group, unless it is its only one.
    """
    rows, by = img.withColumn("plane", plane_of(F.col("z"), k)), image_of(img)
    if compat_drop_last:
        ends = img.groupBy(*by, plane_of(F.col("z"), k).alias("plane")).agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
        rows = rows.join(ends, [*by, "plane"]).where((F.col("z") < F.col("z1")) | (F.col("z0") == F.col("z1")))
    return rows.groupBy(*by, "plane", "y", "x").agg(F.max("v").alias("v"))


def project_stack(img: DataFrame) -> DataFrame:
    return img.groupBy(*image_of(img), "y", "x").agg(F.max("v").alias("v"), F.count("*").alias("n_planes"))


def minmax_normalise(img: DataFrame, by: Sequence[str] = ("z",)) -> DataFrame:
    """(v - min) / (max - min) of each plane (``by``: of what else); zeros where it is constant."""
    by = [*image_of(img), *by]
    span = img.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return img.join(span, by).select(*image_of(img), "z", "y", "x", scaled.alias("v"))


def percentile_normalise(img: DataFrame, lo: float = 1, hi: float = 99.8, by: Sequence[str] = ("z",)) -> DataFrame:
    """(v - p_lo) / (p_hi - p_lo) of each plane (``by``: of what else); a bound of 0 means the default bounds."""
    by, (lo, hi) = [*image_of(img), *by], (1, 99.8) if lo == 0 or hi == 0 else (lo, hi)
    q = percentiles(img, "v", [lo / 100, hi / 100], by)
    return img.join(q, by).select(*image_of(img), "z", "y", "x", F.try_divide(F.col("v") - F.get("q", F.lit(0)), F.get("q", F.lit(1)) - F.get("q", F.lit(0))).alias("v"))


def extrema(img: DataFrame, dz: int, dy: int, dx: int, kind: str = "max", beyond: float = 0.0) -> DataFrame:
    """Voxels that equal the extremum of their box and lie beyond a level; all voxels of a plateau count.

    A box extremum is that of extrema along each axis: three windows, each partitioned by the two other axes.
    """
    best = F.max if kind == "max" else F.min
    out = img.withColumn("m", F.col("v"))
    for axis, d, rest in (("x", dx, ("z", "y")), ("y", dy, ("z", "x")), ("z", dz, ("y", "x"))):
        if d:
            out = out.withColumn("m", best("m").over(W.partitionBy(*image_of(img), *rest).orderBy(axis).rangeBetween(-d, d)))
    return out.where((F.col("v") == F.col("m")) & ((F.col("v") > beyond) if kind == "max" else (F.col("v") < beyond))).drop("m")


def centre_crop(img: DataFrame, points: DataFrame, dz: int, dy: int, dx: int) -> DataFrame:
    """Voxels around each point (spot_id, z, y, x), with dy and dx relative to it, and their maximum over z.

    The image's bounds clip a crop, as voxels outside don't exist.
    """
    by, box = image_of(img), lambda a, d: F.explode(F.sequence(F.col(f"p{a}") - d, F.col(f"p{a}") + d))
    p = points.select("spot_id", *by, *[F.col(a).alias(f"p{a}") for a in "zyx"])
    for a, d in zip("zyx", (dz, dy, dx), strict=True):
        p = p.withColumn(a, box(a, d))
    near = img.join(shuffled(p), [*by, "z", "y", "x"])
    return near.groupBy("spot_id", *by, (F.col("y") - F.col("py")).alias("dy"), (F.col("x") - F.col("px")).alias("dx")).agg(F.max("v").alias("v"))


def gaussian_weights(sigma: float) -> list[tuple[int, float]]:
    """Normalised kernel of radius max(1, int(3 sigma))."""
    r = max(1, int(3 * sigma))
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [(d, w / sum(raw)) for d, w in zip(range(-r, r + 1), raw, strict=True)]


def gaussian_kernel(spark, sigma: float) -> DataFrame:
    """(d, w) of the kernel as a table."""
    r = max(1, int(3 * sigma))
    raw = spark.range(-r, r + 1).select(F.col("id").alias("d"), F.exp(-0.5 * F.pow(F.col("id") / sigma, 2)).alias("e"))
    return raw.withColumn("w", F.col("e") / F.sum("e").over(W.partitionBy())).drop("e")


def gaussian(img: DataFrame, sigma: dict[str, float], bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """One pass for each axis, in blocks; a missing or zero sigma leaves the axis alone.

    Voxels outside count as zero; with ``bounds`` the image is mirrored there.
    """
    kernels = {a: gaussian_weights(sigma[a]) for a in "zyx" if sigma.get(a)}

    def work(values, there, start):
        for axis, a in enumerate("zyx"):
            if a in kernels:
                values = along(values, axis, band(values.shape[axis], kernels[a], start[axis], bounds and bounds[a])) * there
        return there, values

    return in_blocks(img, image_of(img), "zyx", "v", {a: k[-1][0] for a, k in kernels.items()}, work, "v double")


def log_response(img: DataFrame, sigma: dict[str, float]) -> DataFrame:
    """Smoothed image, in-plane 8-neighbour Laplacian, times the sum of the squared sigmas; all passes in one block."""
    kernels = {a: gaussian_weights(sigma[a]) for a in "zyx" if sigma.get(a)}
    reach = {a: kernels[a][-1][0] if a in kernels else 0 for a in "zyx"}
    reach, ones, scale = {a: r + (a != "z") for a, r in reach.items()}, [(-1, 1.0), (0, 1.0), (1, 1.0)], sum(s * s for s in sigma.values())

    def work(values, there, start):
        for axis, a in enumerate("zyx"):
            if a in kernels:
                values = along(values, axis, band(values.shape[axis], kernels[a])) * there
        box = along(along(values, 1, band(values.shape[1], ones)), 2, band(values.shape[2], ones))
        return there, (9 * values - box) * scale

    return in_blocks(img, image_of(img), "zyx", "v", reach, work, "v double")


def tile_grid(sizes: DataFrame, tile: int, overlap: int) -> DataFrame:
    """``sizes``: image, ny, nx. Tiles start every tile - overlap, ends are clipped."""
    starts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(tile - overlap)))
    out = sizes.withColumn("y0", starts("ny")).withColumn("x0", starts("nx"))
    return out.select("image", "y0", F.least(F.col("y0") + tile, F.col("ny")).alias("y1"), "x0", F.least(F.col("x0") + tile, F.col("nx")).alias("x1"))


def tile_offsets(tiles: DataFrame) -> DataFrame:
    """``tiles``: image, tile, max_label. Adds the sum of the maxima of the image's earlier tiles."""
    before = W.partitionBy("image").orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    return tiles.withColumn("label_offset", F.coalesce(F.sum("max_label").over(before), F.lit(0)))


def tile_merge(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*image_of(labels), "plane", "y", "x").agg(F.max("label").alias("label"))


SIX = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def neighbours(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    steps = F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip("zyx", s, strict=True)]) for s in SIX])
    return df.withColumn("_s", F.explode(steps)).select(*keep, *[(F.col(a) + F.col(f"_s.{a}")).alias(a) for a in "zyx"])


def flood_fill(img: DataFrame, seeds: DataFrame, max_levels: int = 10) -> DataFrame:
    """Voxels reached from each seed (spot_id, z, y, x) over face neighbours: spot_id, z, y, x, v, level.

    A step goes from a voxel to a positive one that is no brighter, up to ``max_levels`` steps. Each level is one equi-join of
    the frontier with the image; levels are written, so the plan doesn't grow.
    """
    by = image_of(img)
    own = ["spot_id", *by, "z", "y", "x"]
    bright = img.where("v > 0")
    frontier = stage(img.join(shuffled(seeds.select(*own)), own[1:]).select(*own, "v"))
    seen = frontier.withColumn("level", F.lit(0))
    for level in range(1, max_levels + 1):
        moved = neighbours(frontier.withColumnRenamed("v", "from_v"), ["spot_id", *by, "from_v"])
        step = shuffled(moved).join(bright, own[1:]).where("from_v >= v").select(*own, "v").distinct()
        frontier = stage(step.join(shuffled(seen.select(*own)), own, "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("level", F.lit(level)))
    return seen


#: The order in which ``flood_fill_compat`` looks at a voxel's neighbours (z, y, x).
LOOK_ORDER = [(0, 0, -1), (0, 0, 1), (0, -1, 0), (0, 1, 0), (-1, 0, 0), (1, 0, 0)]


def flood_fill_compat(img: DataFrame, seeds: DataFrame, max_levels: int = 10) -> DataFrame:
    """``flood_fill`` with the early stop of older runs: a search ends where the first voxel of a level adds none.

    Voxels of a level are in order of discovery, by their finder's place in its level and the neighbour looked at.
    """
    by = image_of(img)
    own = ["spot_id", *by, "z", "y", "x"]
    bright = img.where("v > 0")
    frontier = stage(img.join(seeds.select(*own), own[1:]).select(*own, "v", F.lit(0).alias("turn")))
    seen = frontier.drop("turn").withColumn("level", F.lit(0))
    steps = F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip("zyx", s, strict=True)]) for s in LOOK_ORDER])
    search = W.partitionBy("spot_id")
    for level in range(1, max_levels + 1):
        moved = frontier.select("spot_id", *by, "z", "y", "x", F.col("v").alias("from_v"), "turn", F.posexplode(steps).alias("k", "s"))
        moved = moved.select("spot_id", *by, "from_v", F.struct("turn", "k").alias("found"), *[(F.col(a) + F.col(f"s.{a}")).alias(a) for a in "zyx"])
        step = moved.join(bright, own[1:]).where("from_v >= v").groupBy(*own, "v").agg(F.min("found").alias("found"))
        step = step.join(seen.select(*own), own, "left_anti").withColumn("first", F.min("found.turn").over(search)).where("first = 0")
        frontier = stage(step.select(*own, "v", (F.row_number().over(search.orderBy("found")) - 1).alias("turn")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.drop("turn").withColumn("level", F.lit(level)))
    return seen


def outer_shell(voxels: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Face neighbours outside each spot's set (spot_id, z, y, x), and its own voxels on the image's border."""
    own = ["spot_id", *image_of(voxels), "z", "y", "x"]
    inside = [F.col(a).between(*bounds[a]) for a in "zyx"]
    out = neighbours(voxels, own[:-3]).where(inside[0] & inside[1] & inside[2]).distinct()
    out = out.join(voxels.select(*own), own, "left_anti")
    border = [F.col(a).isin(*bounds[a]) for a in "zyx"]
    return out.unionByName(voxels.where(border[0] | border[1] | border[2]).select(*own).distinct())


def diamond(points: DataFrame, r: int, bounds: tuple[int, int], filled: bool = False) -> DataFrame:
    """Pixels at city-block distance ``r`` (``filled``: up to it) of each point, clipped to the image: spot_id, z, y, x."""
    steps = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if abs(a) + abs(b) == r or filled and abs(a) + abs(b) < r]
    array = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a, b in steps])
    out = points.withColumn("_s", F.explode(array)).select("spot_id", *image_of(points), "z", (F.col("y") + F.col("_s.y")).alias("y"), (F.col("x") + F.col("_s.x")).alias("x"))
    return out.where(F.col("y").between(0, bounds[0] - 1) & F.col("x").between(0, bounds[1] - 1))


def rasterise(pixels: DataFrame) -> DataFrame:
    """One spot for each pixel: the largest spot_id where shapes overlap."""
    return pixels.groupBy(*image_of(pixels), "z", "y", "x").agg(F.max("spot_id").alias("spot_id"))


def expand_labels(labels: DataFrame, distance: float, bounds: tuple[int, int]) -> DataFrame:
    """Give each pixel within ``distance`` of a label the nearest one, the smaller label at ties: plane, y, x, label, d2.

    In blocks, by two passes: along y the nearest label of each column, then along x the nearest of the columns. Both take the
    smaller label at equal distances, so the order of passes doesn't show.
    """
    r, limit = int(distance), distance * distance
    far = np.int64(2 * r * r + 1)

    def nearest(d2, label, axis):
        best_d, best = d2.copy(), label.copy()
        for step in range(1, r + 1):
            for to, of in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
                to, of = (tuple(x if k == axis else slice(None) for k in range(2)) for x in (to, of))
                d, l = d2[of] + step * step, label[of]
                better = (d < best_d[to]) | ((d == best_d[to]) & (l < best[to]))
                best_d[to][better], best[to][better] = d[better], l[better]
        return best_d, best

    def work(values, there, start):
        d2, label = nearest(np.where(there, 0, far), values, 0)
        d2, label = nearest(d2, label, 1)
        y, x = start[0] + np.arange(d2.shape[0])[:, None], start[1] + np.arange(d2.shape[1])[None, :]
        inside = (y >= 0) & (y < bounds[0]) & (x >= 0) & (x < bounds[1])
        return (d2 < far) & (d2 <= limit) & inside, label, d2

    # Of pixels with several labels the smallest counts.
    place = [*image_of(labels), "plane", "y", "x"]
    single = labels.groupBy(*place).agg(F.min("label").cast("long").alias("label"))
    return in_blocks(single, place[:-2], "yx", "label", {"y": r, "x": r}, work, "label long, d2 long")


def log_filter(img: DataFrame, sigma: dict[str, float], bounds: dict[str, tuple[int, int]], truncate: float = 4.0) -> DataFrame:
    """Negated Laplacian of Gaussian, clipped at 0, so that bright spots are positive and 0 means no signal.

    Sum over the axes of the second derivative of a Gaussian along one axis and the Gaussian along the others; outside
    ``bounds`` the image is mirrored (edge voxels count twice). In blocks.
    """

    def kernel(s: float, second: bool) -> list[tuple[int, float]]:
        r = int(truncate * s + 0.5)
        base = [math.exp(-0.5 * (d / s) ** 2) for d in range(-r, r + 1)]
        return [(d, w / sum(base) * ((d * d / s**2 - 1) / s**2 if second else 1)) for d, w in zip(range(-r, r + 1), base, strict=True)]

    axes = [a for a in "zyx" if sigma.get(a)]

    def work(values, there, start):
        out = np.zeros_like(values)
        for second in axes:
            one = values
            for a in axes:
                axis = "zyx".index(a)
                one = along(one, axis, band(values.shape[axis], kernel(sigma[a], a == second), start[axis], bounds[a]))
            out -= one
        return there, np.maximum(out, 0.0)

    return in_blocks(img, image_of(img), "zyx", "v", {a: int(truncate * sigma[a] + 0.5) for a in axes}, work, "v double")
