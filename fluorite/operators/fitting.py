"""Gaussian fits of spots' patches, batched over spots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorite.functions.joins import shuffled
from fluorite.operators.raster import image_of

#: Spots that are fitted at once: their Jacobians take 125 x 7 doubles each, and several tables as large.
AT_ONCE = 256
FIT = "spot_id long, total double, amplitude double, sigma_z double, sigma_y double, sigma_x double, r2 double"


def fit_gaussians(offsets: np.ndarray, values: np.ndarray, known: np.ndarray, sigma: tuple[float, float, float], rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares of amplitude, centre and three sigmas for all patches at once.

    ``offsets``: (voxels, 3); ``values`` and ``known``: (spots, voxels). Returns parameters (spots, 7) and R squared.
    """
    n = len(values)
    p = np.concatenate([values.max(1, keepdims=True, initial=0), np.zeros((n, 3)), np.tile(sigma, (n, 1))], 1)
    damp = np.full(n, 1e-2)

    def model(p):
        d = offsets[None] - p[:, None, 1:4]
        s = p[:, None, 4:7]
        e = np.exp(-0.5 * ((d / s) ** 2).sum(2))
        return e, d, s

    def cost(p):
        return (known * (values - p[:, :1] * model(p)[0]) ** 2).sum(1)

    best = cost(p)
    for _ in range(rounds):
        e, d, s = model(p)
        f = p[:, :1] * e
        jac = np.concatenate([e[:, :, None], f[:, :, None] * d / s**2, f[:, :, None] * d**2 / s**3], 2) * known[:, :, None]
        normal = np.einsum("nvi,nvj->nij", jac, jac)
        right = np.einsum("nvi,nv->ni", jac, known * (values - f))
        diagonal = np.einsum("nii->ni", normal)
        normal[:, range(7), range(7)] += damp[:, None] * diagonal + 1e-12
        new = p + np.linalg.solve(normal, right[:, :, None])[:, :, 0]
        new[:, 1:4] = np.clip(new[:, 1:4], -3, 3)
        new[:, 4:7] = np.clip(np.abs(new[:, 4:7]), 0.2, 10)
        c = cost(new)
        better = c < best
        p[better], best[better] = new[better], c[better]
        damp = np.where(better, damp / 3, damp * 5)
    mean = (known * values).sum(1) / np.maximum(1, known.sum(1))
    spread = (known * (values - mean[:, None]) ** 2).sum(1)
    return p, 1 - best / np.where(spread > 0, spread, np.inf)


def gaussian_fit(img: DataFrame, spots: DataFrame, radius: int = 2, sigma: tuple[float, float, float] = (1.0, 1.5, 1.5), min_r2: float = 0.8) -> DataFrame:
    """Fit each spot's patch; spots with a poorer fit than ``min_r2`` drop out. total is the patch's sum.

    A spot asks for its voxels by an equi-join; those outside the image don't exist and don't count.
    """
    side = range(-radius, radius + 1)
    steps = [(a, b, c) for a in side for b in side for c in side]
    array = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(x) for x, v in zip("zyx", s, strict=True)]) for k, s in enumerate(steps)])
    by = image_of(img)
    asked = spots.select("spot_id", *by, "z", "y", "x", F.explode(array).alias("s"))
    asked = asked.select("spot_id", *by, F.col("s.k").alias("k"), *[(F.col(a) + F.col(f"s.{a}")).alias(a) for a in "zyx"])
    patches = shuffled(asked).join(img, [*by, "z", "y", "x"]).groupBy("spot_id").agg(F.collect_list(F.struct("k", "v")).alias("patch"), F.sum("v").alias("total"))
    offsets, sigma = np.array(steps, float), tuple(max(0.2, s) for s in sigma)

    def fit(batches):
        for b in batches:
            if not (n := b.num_rows):
                continue
            lists = b.column("patch")
            owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            k, v = flat.field("k").to_numpy(), flat.field("v").to_numpy()
            values, known = np.zeros((n, len(offsets))), np.zeros((n, len(offsets)))
            values[owner, k], known[owner, k] = v, 1
            parts = [fit_gaussians(offsets, values[i : i + AT_ONCE], known[i : i + AT_ONCE], sigma) for i in range(0, n, AT_ONCE)]
            p, r2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            ok = r2 >= min_r2
            cols = {"spot_id": b.column("spot_id").to_numpy(), "total": b.column("total").to_numpy(), "amplitude": p[:, 0], "sigma_z": p[:, 4], "sigma_y": p[:, 5], "sigma_x": p[:, 6], "r2": r2}
            yield pa.RecordBatch.from_pydict({c: pa.array(x[ok]) for c, x in cols.items()})

    return patches.select("spot_id", "total", "patch").mapInArrow(fit, FIT)
