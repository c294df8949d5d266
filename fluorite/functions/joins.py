"""Joins whose sides must not be gathered in the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, of which a join is by a shuffle of both sides, whatever size Spark expects.

    The expected size counts neither the rows that explode or Python adds nor what a file's coding takes off, so a table of
    gigabytes may look small enough to be broadcast, which gathers it in the driver first.
    """
    return df.hint("merge")
