"""Domain tables over the given ones: images from embeddings, spots from events, cell labels from suppliers, cells from lines.

Every row of a table is used. Each adapter has a twin in ``SQL``, the WITH clauses that the oracle's queries begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluorite.operators import raster

SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def img(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice for each vector: 64 values as 8 by 8 pixels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return e.select(F.col("vec_id").alias("z"), F.floor(F.col("p") / 8).cast("long").alias("y"), (F.col("p") % 8).cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("spot_id"), (F.col("event_id") % 40).alias("z"), (F.col("event_id") * 7 % SIDE).alias("y"), (F.col("user_id") % SIDE).alias("x"), F.col("value").alias("intensity"), F.col("event_type").alias("channel"))


def stacks(spark: SparkSession, sf_dir: str, planes: int = 100) -> DataFrame:
    """The slices of ``img`` as stacks of ``planes`` each, with an image key."""
    i = img(spark, sf_dir)
    return i.select(F.floor(F.col("z") / planes).cast("long").alias("image_id"), (F.col("z") % planes).alias("z"), "y", "x", "v")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each 64 suppliers, in which each has a pixel of its own."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.floor(k / 64).cast("long").alias("image_id"), (k + 1).alias("label"), (F.col("s_nationkey") % 6).cast("long").alias("plane"), (k * 13 % SIDE).alias("y"), (k * 29 % SIDE).alias("x"))


def cell_px(spark: SparkSession, sf_dir: str, distance: int = 5) -> DataFrame:
    return raster.expand_labels(seeds(spark, sf_dir), distance, (SIDE, SIDE))


def nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nuclei with numbers of their own, one around each seed."""
    px = raster.expand_labels(seeds(spark, sf_dir), 2, (SIDE, SIDE))
    return px.select("image_id", "plane", "y", "x", (F.col("label") + 100_000).alias("label"))


def placed_spots(spark: SparkSession, sf_dir: str, k: int = 7) -> DataFrame:
    """Spots with the image and the projected plane that they lie in: an image for each 6,400 events."""
    s = spots(spark, sf_dir).withColumn("plane", raster.plane_of(F.col("z"), k))
    return s.withColumn("image_id", F.floor(F.col("spot_id") / 6400).cast("long"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    injury = F.when(F.col("l_linestatus") == "F", "Incision").otherwise("Amputation")
    grp = F.concat(injury, F.lit("_"), (F.col("l_linenumber") % 3 * 6).cast("string"), F.lit("h"))
    return line.select(grp.alias("grp"), (1 + F.col("l_suppkey") % 3).alias("rep"), F.col("l_quantity").cast("double").alias("n"), F.col("l_extendedprice").cast("double").alias("inten"))


SQL = {
    "img": """img AS (SELECT vec_id AS z, (p - 1) // 8 AS y, (p - 1) % 8 AS x, embedding[p]::DOUBLE AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))""",
    "spots": """spots AS (SELECT event_id AS spot_id, event_id % 40 AS z, event_id * 7 % 64 AS y, user_id % 64 AS x, value AS intensity, event_type AS channel,
  event_id % 40 // 7 AS plane, event_id // 6400 AS image_id FROM events)""",
    "stacks": """stacks AS (SELECT z // 100 AS image_id, z % 100 AS z, y, x, v FROM img)""",
    "seeds": """seeds AS (SELECT s_suppkey // 64 AS image_id, s_suppkey + 1 AS label, (s_nationkey % 6)::BIGINT AS plane, s_suppkey * 13 % 64 AS y, s_suppkey * 29 % 64 AS x FROM supplier)""",
    "cell_px": """disc AS (SELECT a, b, a * a + b * b AS d2 FROM range(-5, 6) ta(a), range(-5, 6) tb(b) WHERE a * a + b * b <= 25),
cell_px AS (SELECT image_id, plane, y, x, label, d2 FROM (SELECT image_id, plane, y + a AS y, x + b AS x, label, d2,
  row_number() OVER (PARTITION BY image_id, plane, y + a, x + b ORDER BY d2, label) AS r FROM seeds, disc) WHERE r = 1 AND y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63)""",
    "nuclei": """nuclei AS (SELECT image_id, plane, y, x, label + 100000 AS label FROM (SELECT image_id, plane, y + a AS y, x + b AS x, label,
  row_number() OVER (PARTITION BY image_id, plane, y + a, x + b ORDER BY a * a + b * b, label) AS r FROM seeds, range(-2, 3) ta(a), range(-2, 3) tb(b) WHERE a * a + b * b <= 4) WHERE r = 1 AND y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63)""",
    "cells": """cells AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'Incision' ELSE 'Amputation' END || '_' || (l_linenumber % 3 * 6)::VARCHAR || 'h' AS grp,
  1 + l_suppkey % 3 AS rep, l_quantity::DOUBLE AS n, l_extendedprice::DOUBLE AS inten FROM lineitem)""",
    "assigned": """assigned AS (SELECT s.*, coalesce(c.label, 0) AS label FROM spots s LEFT JOIN cell_px c USING (image_id, plane, y, x))""",
    "counts": """counts AS (SELECT l.image_id, l.plane, l.label, coalesce(n, 0) AS n, coalesce(intensity, 0) AS intensity FROM (SELECT DISTINCT image_id, plane, label FROM cell_px) l
  LEFT JOIN (SELECT image_id, plane, label, count(*) AS n, sum(intensity) AS intensity FROM assigned WHERE label > 0 GROUP BY ALL) USING (image_id, plane, label))""",
}
NEEDS = {"stacks": ["img"], "cell_px": ["seeds"], "nuclei": ["seeds"], "assigned": ["spots", "cell_px"], "counts": ["assigned"]}


def with_tables(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines these tables and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in order)
