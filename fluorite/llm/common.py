"""What the corpus operators share: joins with hot keys, inputs and folds; scratch tables are the library's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluorite.functions.scratch import scratch_dir, stage

__all__ = ["attach", "fold", "map_batches", "scratch_dir", "stage", "table"]


#: Keys with more than this part of all rows, so at most as many as this, are attached by broadcast.
HOT_KEYS = 100_000


def attach(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """Join ("inner" or "left") on ``keys``, of which ``right`` has one row each with ``n``, the rows of ``left`` that have it.

    A key with more than 1 / HOT_KEYS of all rows (and more than 1,000) is hot: there are at most HOT_KEYS of them whatever the
    data, so they are broadcast and their rows don't move; the others are dealt by key. Null keys don't meet.
    """
    right = stage(right)
    most = max(1000, (right.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS)
    hot = right.where(F.col(n) > most)
    if hot.isEmpty():
        return left.join(right, keys, how)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(n) <= most), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def map_batches(df: DataFrame, schema: str, make: Callable) -> DataFrame:
    """``mapInArrow`` with one object for each task: ``make()`` gives a function from record batch to record batch."""

    def run(batches):
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)
