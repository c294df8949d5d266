"""Segmentation of large planes tile by tile: each tile is labelled with its border, and labels that meet there are one.

A segmenter is a function from a tile's pixels (and where it has some) to its labels, 0 for background: a model, or
``threshold_segmenter``. Tiles overlap by the border's width. A pixel that two tiles label tells that their labels are parts of
one object; these pairs form a graph whose components are the plane's labels, whatever the number of tiles an object spans.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorite.functions.components import connected_components
from fluorite.functions.ranking import running_sums
from fluorite.functions.scratch import stage
from fluorite.operators.blocks import in_blocks
from fluorite.operators.raster import image_of

#: From values and where there are any to labels, 0 for background.
Segmenter = Callable[[np.ndarray, np.ndarray], np.ndarray]


def connected_labels(mask: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of the face-connected parts of a plane, by joining runs of neighbouring rows."""
    starts = mask & ~np.pad(mask, ((0, 0), (1, 0)))[:, :-1]
    run = np.cumsum(starts.ravel()).reshape(mask.shape) * mask
    up = list(range(int(run.max(initial=0)) + 1))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    both = mask[1:] & mask[:-1]
    for a, b in np.unique(np.stack([run[:-1][both], run[1:][both]], 1), axis=0).tolist():
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    roots = np.array([root(k) for k in range(len(up))])
    return np.unique(roots, return_inverse=True)[1].reshape(-1)[run] if len(up) > 1 else run


def threshold_segmenter(level: float) -> Segmenter:
    return lambda values, there: connected_labels(there & (values >= level))


def label_tiles(planes: DataFrame, segment: Segmenter, tile: int = 512, overlap: int = 16, min_pixels: int = 1) -> DataFrame:
    """plane, y, x, label of the pixels in an object; ``planes``: plane, y, x, v. Labels follow each other over all planes' tiles.

    Each tile's labels are moved by the sum of the largest ones of the tiles before it, then those that share at least
    ``min_pixels`` pixels get the smallest of their numbers. An overlap of 1 is enough for a segmenter that decides pixel by pixel.
    """
    if not 1 <= overlap <= tile // 2:
        raise ValueError("tiles overlap by at least a pixel and at most half a tile")
    by = [*image_of(planes), "plane"]

    def work(values, there, start):
        labels = segment(values, there).astype(np.int64)
        return labels > 0, labels

    size = {"y": tile, "x": tile}
    rows = stage(in_blocks(planes, by, "yx", "v", {"y": overlap, "x": overlap}, work, "own long", size, borders=True))
    tiles = rows.groupBy(*by, "ty", "tx").agg(F.max("own").alias("_most"))
    moved = stage(running_sums(tiles, [*by, "ty", "tx"], {"_upto": F.col("_most")}))
    rows = rows.join(moved, [*by, "ty", "tx"]).withColumn("label", F.col("own") + F.col("_upto") - F.col("_most"))
    rows = stage(rows.select(*by, "y", "x", "label", "inner"))
    inner = rows.where("inner").select(*by, "y", "x", "label")
    seam = rows.where("NOT inner").select(*by, "y", "x", F.col("label").alias("other"))
    pairs = inner.join(seam, [*by, "y", "x"]).groupBy(F.col("label").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pixels)
    to = connected_components(pairs.select("a", "b"))
    return inner.join(to.withColumnRenamed("node", "label"), "label", "left").select(*by, "y", "x", F.coalesce("component", "label").alias("label"))
