"""Borders of labels as polygons: pixel edges, each pointing at the next, ordered by pointer doubling.

A pixel's side with another label (or nothing) beyond it is an edge, walked with the label on its right, so outer rings run
clockwise (y grows downwards) and holes against it. Which edge is next follows from the pixel's neighbours alone. Where two pixels of a
label touch at a corner only, the ring stays with its pixel: parts are face-connected, as in ``tiles``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluorite.functions.scratch import stage
from fluorite.operators.blocks import in_blocks
from fluorite.operators.raster import image_of

#: Steps (y, x) of the walk along the top, right, bottom and left side of a pixel.
WALK = [(0, 1), (1, 0), (0, -1), (-1, 0)]


def _edge(y: Column, x: Column, side: int | Column) -> Column:
    """A number for a side of a pixel; places are below 2^29."""
    return F.shiftleft(y, 32) + F.shiftleft(x, 2) + side


def border_edges(labels: DataFrame) -> DataFrame:
    """plane, label, edge, next, y, x (the corner where the edge ends) and turns, whether it is a corner of the polygon.

    ``labels``: plane, y, x, label (positive), a label for each pixel. One shuffle of blocks with a border of a pixel.
    """
    by = [*image_of(labels), "plane"]
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]

    def work(values, there, start):
        padded, known = np.pad(values, 1), np.pad(there, 1)
        h, w = values.shape
        alike = [known[1 + a : 1 + a + h, 1 + b : 1 + b + w] & (padded[1 + a : 1 + a + h, 1 + b : 1 + b + w] == values) for a, b in around]
        inside = np.logical_and.reduce([m for m, (a, b) in zip(alike, around, strict=True) if not (a and b)])
        return there & (values > 0) & ~inside, values, sum(m.astype(np.int64) << k for k, m in enumerate(alike))

    px = in_blocks(labels, by, "yx", "label", {"y": 1, "x": 1}, work, "label long, mask long")
    has = lambda a, b: F.col("mask").bitwiseAND(F.lit(1 << around.index((a, b)))) != 0
    sides = []
    for side, (a, b) in enumerate(WALK):
        out = WALK[side - 1]
        ahead, aside = has(a, b), has(a + out[0], b + out[1])
        y, x = F.col("y"), F.col("x")
        straight, left = _edge(y + a, x + b, side), _edge(y + a + out[0], x + b + out[1], (side + 3) % 4)
        follows = F.when(~ahead, _edge(y, x, (side + 1) % 4)).when(aside, left).otherwise(straight)
        # The top side ends at the pixel's upper right corner, the right one below it, and so on around.
        ends = (y + int(side in (1, 2)), x + int(side in (0, 1)))
        sides.append(F.struct((~has(*out)).alias("open"), _edge(y, x, side).alias("edge"), follows.alias("next"), ends[0].alias("y"), ends[1].alias("x"), (~ahead | aside).alias("turns")))
    edges = px.select(*by, "label", F.explode(F.array(*sides)).alias("s")).where("s.open")
    return edges.select(*by, "label", "s.edge", "s.next", "s.y", "s.x", "s.turns")


def rings(edges: DataFrame) -> DataFrame:
    """Adds ring (its smallest edge) and pos, the edge's place in it from 0 on, to ``border_edges``.

    Each round joins the edges with those that they point at, and then points twice as far: as many rounds as the logarithm of
    the longest ring. Edges are dealt by label and number, so a long ring spreads; rounds are written, so the plan doesn't grow.
    """
    key = [*image_of(edges), "plane", "label"]
    state = stage(edges.select(*key, "edge", F.col("next").alias("to"), F.col("edge").alias("least"), F.lit(0).cast("long").alias("hops")))
    far = 1
    while True:
        other = state.select(*key, F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("hops").alias("hops2"))
        nearer = F.col("least2") < F.col("least")
        hops = F.when(nearer, F.col("hops2") + far).otherwise(F.col("hops"))
        state = stage(state.join(other, [*key, "to"]).select(*key, "edge", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), hops.alias("hops"), nearer.alias("changed")))
        # Where no window of this many edges has a smaller one behind it, each has its ring's smallest.
        if state.where("changed").isEmpty():
            break
        far *= 2
    size = state.groupBy(*key, F.col("least").alias("ring")).agg(F.count("*").alias("n"))
    placed = state.select(*key, "edge", F.col("least").alias("ring"), "hops").join(size, [*key, "ring"])
    return edges.join(placed.select(*key, "edge", "ring", F.pmod(F.col("n") - F.col("hops"), F.col("n")).alias("pos")), [*key, "edge"])


def polygons(labels: DataFrame) -> DataFrame:
    """plane, label, ring, pos, y, x: the corners of each label's rings, in order along the ring by ``pos``.

    The first corner isn't repeated at the end. An empty table has no corners.
    """
    found = rings(stage(border_edges(labels)))
    return found.where("turns").select(*image_of(labels), "plane", "label", "ring", "pos", "y", "x")


def ring_areas(corners: DataFrame) -> DataFrame:
    """plane, label, ring, n_corners, perimeter and area of ``polygons`` by the shoelace formula; holes have negative areas.

    A ring's corners go through one sorted window: its size is one border's.
    """
    key = [*image_of(corners), "plane", "label", "ring"]
    ring = W.partitionBy(*key)
    onwards = lambda c: F.coalesce(F.lead(c).over(ring.orderBy("pos")), F.first(c).over(ring.orderBy("pos"))).alias(f"{c}2")
    pairs = corners.select(*key, "y", "x", onwards("y"), onwards("x"))
    twice, length = F.col("x") * F.col("y2") - F.col("x2") * F.col("y"), F.abs(F.col("y2") - F.col("y")) + F.abs(F.col("x2") - F.col("x"))
    return pairs.groupBy(*key).agg(F.count("*").alias("n_corners"), F.sum(length).alias("perimeter"), (F.sum(twice) / 2).cast("long").alias("area"))
