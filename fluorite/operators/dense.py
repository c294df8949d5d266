"""Decomposition of over-bright regions into several spots, by a mixture of the image's reference spot.

The steps of the published method: the background (a wide Gaussian of ``gamma`` spot radii) is taken off; the reference spot is
the ``alpha`` quantile, voxel by voxel, of the patches around spots; voxels above ``beta`` times its peak form dense regions;
each region is explained by copies of the Gaussian that fits the reference spot, added as long as the squared error falls. After
each addition the copies nearby move voxel by voxel while the error falls, so two spots that overlap end where they are and not
where their sum is brightest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fluorite.functions.components import connected_components
from fluorite.functions.joins import shuffled
from fluorite.functions.ranking import numbered, percentiles
from fluorite.functions.scratch import stage
from fluorite.operators.raster import gaussian, image_of

#: Spots of an image, those with the smallest hash, whose patches make its reference spot.
REFERENCE_SPOTS = 2000
#: Voxels of a region that a task fits at once; a larger region is cut into boxes of so many voxels along each axis.
REGION_VOXELS = 30_000
REGION_BOX = {"z": 16, "y": 40, "x": 40}


def remove_background(img: DataFrame, spot: dict[str, float], gamma: float) -> DataFrame:
    """``img`` less its Gaussian of ``gamma`` times the spot's radii (in voxels), at least 0; mirrored at the edges. 0: as it is."""
    if not gamma:
        return img.select(*image_of(img), "z", "y", "x", F.col("v").cast("double").alias("v"))
    ends = img.agg(*[f(a).alias(f"{n}_{a}") for a in "zyx" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    place = [*image_of(img), "z", "y", "x"]
    if ends.lo_z is None:
        return img.select(*place, F.col("v").cast("double").alias("v"))
    base = gaussian(img, {a: gamma * s for a, s in spot.items()}, {a: (ends[f"lo_{a}"], ends[f"hi_{a}"]) for a in "zyx"})
    return img.join(shuffled(base.withColumnRenamed("v", "base")), place).select(*place, F.greatest(F.col("v") - F.col("base"), F.lit(0.0)).alias("v"))


def reference_spot(img: DataFrame, spots: DataFrame, spot: dict[str, float], alpha: float) -> DataFrame:
    """dz, dy, dx, v: the ``alpha`` quantile of each voxel around spots, for each image; patches that leave the image don't count."""
    by, reach = image_of(img), {a: math.ceil(spot[a]) for a in "zyx"}
    order = W.partitionBy(*[F.col(c) for c in by]).orderBy(F.xxhash64("spot_id"), "spot_id")
    few = spots.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= REFERENCE_SPOTS)
    p = few.select("spot_id", *by, *[F.col(a).alias(f"p{a}") for a in "zyx"])
    for a in "zyx":
        p = p.withColumn(f"d{a}", F.explode(F.sequence(F.lit(-reach[a]), F.lit(reach[a])))).withColumn(a, F.col(f"p{a}") + F.col(f"d{a}"))
    cells = stage(img.join(shuffled(p), [*by, "z", "y", "x"]).select(*by, "spot_id", "dz", "dy", "dx", "v"))
    full = cells.groupBy("spot_id").agg(F.count("*").alias("_n")).where(F.col("_n") == math.prod(2 * r + 1 for r in reach.values()))
    q = percentiles(cells.join(shuffled(full.select("spot_id")), "spot_id", "left_semi"), "v", [alpha], [*by, "dz", "dy", "dx"])
    return q.select(*by, "dz", "dy", "dx", F.get("q", F.lit(0)).alias("v"))


def fit_reference(cells: np.ndarray, values: np.ndarray, spot: tuple[float, float, float]) -> tuple[float, float, float, float]:
    """sigma_z, sigma_yx, amplitude and background of the Gaussian at the centre that fits a reference spot best.

    The widths are searched on a grid around the spot's radii that is made finer three times; for given widths the other two
    follow by least squares.
    """
    z2, r2 = cells[:, 0] ** 2.0, cells[:, 1] ** 2.0 + cells[:, 2] ** 2.0
    best, width, centre = None, 1.0, (max(spot[0], 0.3), max((spot[1] + spot[2]) / 2, 0.3))
    for _ in range(4):
        for sz in centre[0] * np.exp(np.linspace(-width, width, 9)):
            for syx in centre[1] * np.exp(np.linspace(-width, width, 9)):
                g = np.exp(-z2 / (2 * sz * sz) - r2 / (2 * syx * syx))
                spread = ((g - g.mean()) ** 2).sum()
                a = float(((g - g.mean()) * (values - values.mean())).sum() / spread) if spread > 1e-12 else 0.0
                error = float(((values - values.mean() - a * (g - g.mean())) ** 2).sum())
                if best is None or error < best[0] - 1e-12:
                    best = (error, float(sz), float(syx), a, float(values.mean() - a * g.mean()))
        centre, width = best[1:3], width / 4
    return best[1], best[2], best[3], best[4]


def fit_mixture(cells: np.ndarray, values: np.ndarray, sigma_z: float, sigma_yx: float, amplitude: float, background: float) -> np.ndarray:
    """Centres (n x 3) of copies of one Gaussian whose sum explains ``values`` at ``cells``: one at least.

    A copy goes where most is unexplained, then copies near it move by one voxel while the squared error falls; when neither an
    addition with its moves lowers the error, it is taken back and that is all.
    """
    cells = cells.astype(np.float64)

    def bell(c):
        d = cells - c
        return amplitude * np.exp(-d[:, 0] ** 2 / (2 * sigma_z**2) - (d[:, 1] ** 2 + d[:, 2] ** 2) / (2 * sigma_yx**2))

    moves = [m for m in ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))]
    inside = {tuple(c) for c in cells.astype(int)}
    rest, centres, bells = values - background, [], []
    error, limit = math.inf, max(1, len(cells))
    while len(centres) < limit:
        c = tuple(cells[int(np.argmax(rest))].astype(int))
        b = bell(c)
        now, own, sums = rest - b, [*centres, c], [*bells, b]
        least = float(now @ now)
        near = [k for k, x in enumerate(own) if abs(x[0] - c[0]) <= 3 * sigma_z + 1 and max(abs(x[1] - c[1]), abs(x[2] - c[2])) <= 3 * sigma_yx + 1]
        moved = True
        while moved:
            moved = False
            for k in near:
                for m in moves:
                    to = tuple(int(x + y) for x, y in zip(own[k], m, strict=True))
                    if to not in inside:
                        continue
                    b = bell(to)
                    tried = now + sums[k] - b
                    if (e := float(tried @ tried)) < least - 1e-9 * max(1.0, least):
                        now, least, moved, own[k], sums[k] = tried, e, True, to, b
        if centres and least >= error:
            break
        rest, centres, bells, error = now, own, sums, least
        if amplitude <= 0:
            break
    return np.array(centres, np.int64)


def bright_regions(img: DataFrame, levels: DataFrame | float) -> DataFrame:
    """Voxels above a level, or above their image's ``level``, with their face-connected region, named by the smallest number of its voxels in order of place."""
    by = image_of(img)
    place = [*by, "z", "y", "x"]
    if not isinstance(levels, DataFrame):
        levels = img.select(*by).distinct().withColumn("level", F.lit(float(levels))) if by else img.sparkSession.createDataFrame([(float(levels),)], "level double")
    over = (img.join(levels, by) if by else img.join(F.broadcast(levels))).where(F.col("v") > F.col("level"))
    bright = stage(numbered(over.select(*place, "v"), place, "node"))
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("zyx", s, strict=True)]) for s in ((1, 0, 0), (0, 1, 0), (0, 0, 1))])
    ahead = bright.select(*place, F.col("node").alias("a"), F.explode(steps).alias("s"))
    ahead = ahead.select(*place[:-3], "a", *[(F.col(c) + F.col(f"s.{c}")).alias(c) for c in "zyx"])
    groups = connected_components(ahead.join(shuffled(bright.select(*place, F.col("node").alias("b"))), place).select("a", "b"), shuffled)
    return bright.join(shuffled(groups), "node", "left").select(*place, "v", F.coalesce("component", "node").alias("region"))


def decompose(img: DataFrame, spots: DataFrame, spot: dict[str, float], thresholds: tuple[float, float, float] = (0.7, 1, 5), min_voxels: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spots with those in dense regions replaced, the regions, and the reference spots with their Gaussians.

    ``spots``: spot_id, z, y, x. ``spot``: radius of a spot along each axis in voxels. ``thresholds``: alpha, beta and gamma. The
    first table has image_id (where ``img`` has it), z, y, x, spot_id (null for spots of the mixture) and region (null for others);
    the second region, n_voxels, n_before and n_spots; the third one row for each image: sigma_z, sigma_yx, amplitude,
    background and level. Regions of fewer than ``min_voxels`` voxels keep their spots; an image without spots whose patch
    lies within it has no reference and keeps all of its spots. Regions of more than REGION_VOXELS voxels are fitted in boxes.
    """
    alpha, beta, gamma = thresholds
    by = image_of(img)
    place = [*by, "z", "y", "x"]
    clean = stage(remove_background(img, spot, gamma))
    patch = reference_spot(clean, spots.select("spot_id", *place), spot, alpha)
    kinds = "".join(f"`{c}` {img.schema[c].dataType.simpleString()}, " for c in by)
    radii = tuple(spot[a] for a in "zyx")

    def fit(group: pa.Table) -> pa.Table:
        cells = np.stack([group[f"d{a}"].to_numpy() for a in "zyx"], 1)
        values = group["v"].to_numpy()
        got = fit_reference(cells, values, radii)
        made = {c: group[c].slice(0, 1) for c in by} | {k: pa.array([x]) for k, x in zip(("sigma_z", "sigma_yx", "amplitude", "background", "level"), (*got, float(beta * values.max())), strict=True)}
        return pa.table(made)

    # A patch has a fixed number of cells.
    reference = stage(patch.groupBy(*[F.col(c) for c in by]).applyInArrow(fit, f"{kinds}sigma_z double, sigma_yx double, amplitude double, background double, level double"))
    regions = stage(bright_regions(clean, reference.select(*by, "level")))
    size = regions.groupBy("region").agg(F.count("*").alias("n_voxels")).where(F.col("n_voxels") >= min_voxels)
    inside = stage(regions.join(shuffled(size), "region"))
    box = [F.when(F.col("n_voxels") > REGION_VOXELS, F.floor(F.col(a) / REGION_BOX[a])).otherwise(0).alias(f"b{a}") for a in "zyx"]
    cells = inside.select("region", *place, "v", *box)
    cells = cells.join(reference.drop("level"), by) if by else cells.join(F.broadcast(reference.drop("level")))

    def mixture(group: pa.Table) -> pa.Table:
        # The order of rows decides between equal residuals.
        group = group.sort_by([(a, "ascending") for a in "zyx"])
        at = np.stack([group[a].to_numpy() for a in "zyx"], 1)
        found = fit_mixture(at, group["v"].to_numpy(), *[group[c][0].as_py() for c in ("sigma_z", "sigma_yx", "amplitude", "background")])
        made = {c: pa.chunked_array([group[c].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(found), np.int64)))]) for c in (*by, "region")}
        return pa.table(made | {a: pa.array(found[:, k]) for k, a in enumerate("zyx")})

    fitted = stage(cells.groupBy("region", "bz", "by", "bx").applyInArrow(mixture, f"{kinds}region long, z long, y long, x long"))
    at = inside.select(*place, "region")
    marked = stage(spots.select("spot_id", *place).join(shuffled(at), place, "left"))
    out = marked.where("region IS NULL").unionByName(fitted.select(F.lit(None).cast(dict(marked.dtypes)["spot_id"]).alias("spot_id"), *place, "region"))
    before = marked.where("region IS NOT NULL").groupBy("region").agg(F.count("*").alias("n_before"))
    after = fitted.groupBy("region").agg(F.count("*").alias("n_spots"))
    table = size.join(shuffled(before), "region", "left").join(shuffled(after), "region").select("region", "n_voxels", F.coalesce("n_before", F.lit(0)).cast("long").alias("n_before"), "n_spots")
    return out.select("spot_id", *place, "region"), table, reference
