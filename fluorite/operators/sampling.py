"""Seeded random regions and augmentations by arithmetic hashes, equal on every engine and run."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME, MIX, SHIFT = 1_000_003, 7_919, 104_729


def draw(key: Column, salt: int) -> Column:
    """A number from 0 to PRIME - 1 for a key."""
    return F.pmod(F.pmod(key, F.lit(PRIME)) * (MIX + 2 * salt) + SHIFT * (salt + 1), F.lit(PRIME))


def _fitting(images: DataFrame, key: str, sizes: dict[str, int], strict: bool) -> DataFrame:
    fits = functools.reduce(Column.__and__, [F.col(c) >= n for c, n in sizes.items()])
    small = F.raise_error(F.concat(F.lit("smaller than the region: image "), F.col(key).cast("string"))).cast("boolean")
    return images.where(F.when(fits, F.lit(True)).otherwise(small if strict else F.lit(False)))


def random_regions(images: DataFrame, height: int, width: int, n: int = 1, key: str = "image", strict: bool = False) -> DataFrame:
    """``n`` regions inside each image (key, ny, nx); images smaller than the region have none, or raise an error if ``strict``."""
    fit = _fitting(images, key, {"ny": height, "nx": width}, strict).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    each = F.col(key) * n + F.col("k")
    y0, x0 = F.pmod(draw(each, 1), F.col("ny") - height + 1), F.pmod(draw(each, 2), F.col("nx") - width + 1)
    return fit.select(key, F.col("k").cast("long").alias("k"), y0.cast("long").alias("y0"), x0.cast("long").alias("x0"), (y0 + height).cast("long").alias("y1"), (x0 + width).cast("long").alias("x1"))


def random_volumes(images: DataFrame, depth: int, height: int, width: int, n: int = 1, key: str = "image", strict: bool = False) -> DataFrame:
    """``n`` regions of ``depth`` slices inside each stack (key, nz, ny, nx); smaller stacks have none, or raise an error if ``strict``."""
    flat = random_regions(_fitting(images, key, {"nz": depth}, strict), height, width, n, key, strict)
    z0 = F.pmod(draw(F.col(key) * n + F.col("k"), 8), F.col("nz") - depth + 1).cast("long")
    return flat.join(images.select(key, "nz"), key).select(key, "k", z0.alias("z0"), (z0 + depth).alias("z1"), "y0", "x0", "y1", "x1")


def contents(img: DataFrame, boxes: DataFrame, size: dict[str, int], keys: Sequence[str] = ("image",), name: Sequence[str] = ("k",)) -> DataFrame:
    """``keys``, ``name``, the axes and v: the voxels of each box, placed from the box's first corner on.

    ``boxes``: ``keys`` (the image), ``name`` (which box of it) and a first corner z0, y0, x0 for each axis of ``size``. Space is cut in
    cells of a box's size, of which a box meets at most two along an axis: boxes and voxels meet by equality of image and cell,
    and their exact places decide. Boxes may overlap and reach beyond the image; they hold what voxels there are.
    """
    cells = [f"_c{a}" for a in size]
    for a, n in size.items():
        first = F.floor(F.col(f"{a}0") / n)
        boxes = boxes.withColumn(f"_c{a}", F.explode(F.sequence(first, F.floor((F.col(f"{a}0") + n - 1) / n))))
    boxes = boxes.select(*keys, *name, *cells, *[f"{a}0" for a in size])
    voxels = img.withColumns({f"_c{a}": F.floor(F.col(a) / n) for a, n in size.items()}).select(*keys, *cells, *size, "v")
    inside = functools.reduce(Column.__and__, [(F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}0") + n) for a, n in size.items()])
    return voxels.join(boxes, [*keys, *cells]).where(inside).select(*keys, *name, *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in size], "v")


def noise(img: DataFrame, side: int, amount: float = 0.02, image: str = "z") -> DataFrame:
    """Adds normal noise (by Box and Muller) whose deviation is 0 to ``amount``, drawn for each image."""
    pixel = F.pmod(F.col(image), F.lit(PRIME)) * side * side + F.col("y") * side + F.col("x")
    unit = lambda k, s: (draw(k, s) + 0.5) / float(PRIME)
    # Draws are linear in their key: the second takes the square, or the two would move together.
    pixel = F.pmod(pixel, F.lit(PRIME))
    normal = F.sqrt(-2 * F.log(unit(pixel, 9))) * F.cos(2 * math.pi * unit(pixel * pixel, 10))
    return img.withColumn("v", F.col("v") + amount * unit(F.col(image), 11) * normal)


def augment(img: DataFrame, side: int, image: str = "z") -> DataFrame:
    """Flip and transpose square images at random, and scale and shift their values by 0.6 to 2 and -0.2 to 0.2."""
    bit = lambda s: draw(F.col(image), s) % 2 == 1
    unit = lambda s: draw(F.col(image), s) / F.lit(float(PRIME))
    y = F.when(bit(3), side - 1 - F.col("y")).otherwise(F.col("y"))
    x = F.when(bit(4), side - 1 - F.col("x")).otherwise(F.col("x"))
    v = F.col("v") * (0.6 + 1.4 * unit(6)) + (-0.2 + 0.4 * unit(7))
    return img.select("z", F.when(bit(5), x).otherwise(y).alias("y"), F.when(bit(5), y).otherwise(x).alias("x"), v.alias("v"))
