"""File manifests and text sidecars: what the pipelines look for on disk, as filters over paths and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def find(spark: SparkSession, root: str, glob: str, hidden: bool = False) -> DataFrame:
    """path and length of files below ``root`` whose name matches; names and folders with a leading dot only if ``hidden``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    return found if hidden else found.where(~F.col("path").rlike(r"/\."))


def label_images(files: DataFrame) -> DataFrame:
    """Label images end in three digits; stacked images and projections don't count."""
    name = F.substring_index("path", "/", -1)
    return files.where(name.rlike(r"[0-9]{3}\.tif$") & ~name.startswith("stacked_") & ~name.startswith("max_projection_"))


def path_columns(path: Column) -> dict[str, Column]:
    """hours, injury, image and channel of ``<exp>/<t>hr_<Injury>/Image<k>/<channel>/results/<file>``."""
    part = lambda k: F.regexp_extract(path, r"/([0-9]+)hr_([^/]+)/Image([0-9]+)/([^/]+)/results/", k)
    return {"hours": part(1).cast("int"), "injury": part(2), "image": part(3).cast("int"), "channel": part(4)}


def thresholds(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` that state a threshold, with it as a double; a file may have several."""
    found = F.regexp_extract(value, r"threshold:\s*([\d.]+)", 1)
    return lines.where(found != "").withColumn("threshold", found.cast("double")).drop(value)


def first_available(files: DataFrame, image: str, order: Sequence[str]) -> DataFrame:
    """For each image the file that comes first in ``order``; a minimum, so it aggregates partially."""
    rest = [c for c in files.columns if c != image and c not in order]
    best = files.groupBy(image).agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(image, *[F.col(f"b.{c}").alias(c) for c in [*order, *rest]])


def planes(files: DataFrame, folder: str, path: str) -> DataFrame:
    """Plane numbers from 0 by order of path in each folder."""
    return files.withColumn("plane", F.row_number().over(W.partitionBy(folder).orderBy(path)) - 1)
