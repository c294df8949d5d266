"""Shapes of labels: star-convex outlines, and what a cell holds."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorite.operators.raster import image_of

#: Distances are compared with this tolerance, and directions are rounded to 12 digits, so engines agree on pixels on an edge.
EDGE = 1e-9
#: Pixels of sectors that are looked at at once.
AT_ONCE = 1 << 18


def _directions(n_rays: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_rays, k, dy and dx of every ray."""
    rays = [(n, k, 2 * math.pi * k / n) for n in n_rays for k in range(n)]
    return *(np.array([r[c] for r in rays], np.int32) for c in (0, 1)), *(np.array([round(f(r[2]), 12) + 0.0 for r in rays]) for f in (math.sin, math.cos))


def _lengths(y: np.ndarray, x: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The centre of a label's pixels and the length of its ray in each direction."""
    cy, cx = math.floor(y.sum() / len(y) + 0.5), math.floor(x.sum() / len(x) + 0.5)
    y0, y1, x0, x1 = int(y.min()), int(y.max()), int(x.min()), int(x.max())
    own = np.unique((y - y0) * (x1 - x0 + 1) + x - x0)
    s = np.arange(y1 - y0 + x1 - x0 + 3)
    py, px = (np.floor(c + s * d[:, None] + 0.5).astype(np.int64) for c, d in ((cy, dy), (cx, dx)))
    code = (py - y0) * (x1 - x0 + 1) + px - x0
    inside = (py >= y0) & (py <= y1) & (px >= x0) & (px <= x1) & (own[np.minimum(np.searchsorted(own, code), len(own) - 1)] == code)
    # A ray leaves the label's box at its last step, so each has a step outside.
    return cy, cx, np.maximum(np.argmin(inside, 1) - 1 + 0.5 / np.maximum(np.abs(dy), np.abs(dx)), 0.0)


def _in_sectors(py: np.ndarray, px: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which pixels (relative to the centre) lie in which sectors: sectors x pixels. ``a``, ``b``: y and x of the rays' ends.

    A sector is the triangle of the centre and two ends: a pixel is in it if it is on the inner side of all three edges,
    and no farther from the centre than the longer ray, which matters where a ray has no length.
    """
    (ay, ax), (by, bx), far = a[:, :, None], b[:, :, None], far[:, None]
    out = (py * py + px * px <= far * far + EDGE) & (ax * py - ay * px >= -EDGE) & (px * by - py * bx >= -EDGE) & ((bx - ax) * (py - ay) - (by - ay) * (px - ax) >= -EDGE)
    for p, u, v in ((py, ay, by), (px, ax, bx)):
        out &= (p >= np.floor(np.minimum(0.0, np.minimum(u, v)))) & (p <= np.ceil(np.maximum(0.0, np.maximum(u, v))))
    return out


def _filled(n: np.ndarray, dy: np.ndarray, dx: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """py, px of the pixels of the outlines, and which of the numbers of rays have them: numbers x pixels."""
    first = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
    after = np.arange(1, len(n) + 1)
    after[np.append(first[1:], len(n)) - 1] = first
    a = np.stack([d * dy, d * dx])
    b, far, r = a[:, after], np.maximum(d, d[after]), math.ceil(d.max())
    if len(n) * (2 * r + 1) ** 2 <= AT_ONCE:
        py, px = (c.ravel().astype(np.float64) for c in np.mgrid[-r : r + 1, -r : r + 1])
        hit = np.logical_or.reduceat(_in_sectors(py, px, a, b, far), first, 0)
    else:  # sector by sector, some lines of it at a time
        hit = np.zeros((len(first), 2 * r + 1, 2 * r + 1), bool)
        for k, group in enumerate(np.searchsorted(first, np.arange(len(n)), "right") - 1):
            (y0, x0), (y1, x1) = (np.floor(np.minimum(0, np.minimum(a[:, k], b[:, k]))).astype(int), np.ceil(np.maximum(0, np.maximum(a[:, k], b[:, k]))).astype(int))
            step = max(1, AT_ONCE // (x1 - x0 + 1))
            for lo in range(y0, y1 + 1, step):
                hi = min(lo + step, y1 + 1)
                py, px = (c.ravel().astype(np.float64) for c in np.mgrid[lo:hi, x0 : x1 + 1])
                hit[group, lo + r : hi + r, x0 + r : x1 + 1 + r] |= _in_sectors(py, px, a[:, k : k + 1], b[:, k : k + 1], far[k : k + 1]).reshape(hi - lo, -1)
        hit, (py, px) = hit.reshape(len(first), -1), (c.ravel() for c in np.mgrid[-r : r + 1, -r : r + 1])
    some = hit.any(0)
    return py[some].astype(np.int64), px[some].astype(np.int64), hit[:, some]


def _by_label(labels: DataFrame, work: Callable, columns: str) -> DataFrame:
    """``work(y, x)`` of each label's pixels in a plane: a dict of columns. A task holds one label at a time."""
    cell = [*image_of(labels), "plane", "label"]
    rows = labels.select(*cell, *[F.col(a).cast("long").alias(a) for a in "yx"]).dropna()
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in cell)

    def one(group: pa.Table) -> pa.Table:
        made = work(group["y"].to_numpy(), group["x"].to_numpy())
        same = pa.array(np.zeros(len(next(iter(made.values()))), np.int64))
        return pa.table({c: group[c].slice(0, 1).combine_chunks().take(same) for c in cell} | made)

    return rows.groupBy(*cell).applyInArrow(one, kinds + columns)


def star_outlines(labels: DataFrame, n_rays: Sequence[int]) -> DataFrame:
    """n_rays, plane, label, cy, cx and, for ray ``k`` from the centre, its length ``d``.

    The centre is the label's mean place, rounded; a ray goes half a pixel, along its longer axis, beyond the last step
    before its first one outside the label; 0 if the centre is outside.
    """
    n, k, dy, dx = _directions([*dict.fromkeys(n_rays)])

    def work(y, x):
        cy, cx, d = _lengths(y, x, dy, dx)
        return {"cy": np.full(len(n), cy), "cx": np.full(len(n), cx), "n_rays": n, "k": k, "dy": dy, "dx": dx, "d": d}

    return _by_label(labels, work, "cy long, cx long, n_rays int, k int, dy double, dx double, d double")


def star_reconstruct(labels: DataFrame, n_rays: Sequence[int]) -> DataFrame:
    """n_rays, plane, y, x, label: the pixels of each label's star-convex outline, the larger label where outlines overlap.

    A pixel of a label is one row for all numbers of rays, until the largest label of each is known.
    """
    place, numbers = [*image_of(labels), "plane", "y", "x"], [*dict.fromkeys(n_rays)]
    n, _, dy, dx = _directions(numbers)

    def work(y, x):
        cy, cx, d = _lengths(y, x, dy, dx)
        py, px, hit = _filled(n, dy, dx, d)
        return {"y": cy + py, "x": cx + px} | {f"r{k}": h for k, h in enumerate(hit)}

    px = _by_label(labels, work, ", ".join(["y long, x long", *[f"r{k} boolean" for k in range(len(numbers))]]))
    most = px.groupBy(*place).agg(*[F.max(F.when(F.col(f"r{k}"), F.col("label"))).alias(f"r{k}") for k in range(len(numbers))])
    each = most.select(*place, F.explode(F.array(*[F.struct(F.lit(m).alias("n_rays"), F.col(f"r{k}").alias("label")) for k, m in enumerate(numbers)])).alias("s"))
    return each.where("s.label IS NOT NULL").select("s.n_rays", *place, "s.label")


def extract_cells(cells: DataFrame, nuclei: DataFrame, spots: DataFrame) -> DataFrame:
    """For each cell its area and box, how much of which nuclei it covers, and its spots, in all and inside nuclei.

    ``cells``, ``nuclei``: plane, y, x, label. ``spots``: plane, y, x. One row for each label and plane.
    """
    cell, place = [*image_of(cells), "plane", "label"], [*image_of(cells), "plane", "y", "x"]
    both = cells.select(*place, "label").join(nuclei.select(*place, F.col("label").alias("nucleus")), place, "left")
    box = [f(a).alias(f"{a}{k}") for a in "yx" for k, f in enumerate((F.min, F.max))]
    area = both.groupBy(*cell).agg(F.count("*").alias("cell_area"), F.count("nucleus").alias("nucleus_area"), F.count_distinct("nucleus").alias("n_nuclei"), *box)
    found = spots.groupBy(*place).agg(F.count("*").alias("n")).join(both, place).groupBy(*cell)
    found = found.agg(F.sum("n").alias("n_spots"), F.sum(F.when(F.col("nucleus").isNotNull(), F.col("n")).otherwise(0)).alias("n_nuclear"))
    return area.join(found, cell, "left").fillna(0, ["n_spots", "n_nuclear"])
