"""Row numbers and running sums over a whole table without a single-task window.

Rows are dealt by ranges of the order columns, numbered inside each range, and shifted by the sums of the ranges before;
only one row for each range is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fluorite.functions.scratch import stage


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum over all rows of the same ``by`` up to and including this one.

    ``order`` must make rows distinct within ``by``; else rows that tie get their sums in any order. Nulls in ``by`` are one
    more value.
    """
    keys = [*by, *order]
    raw = {f"_s{k}": c for k, c in enumerate(sums.values())}
    dealt = df.withColumns(raw).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    dealt = stage(dealt)
    own = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = dealt.groupBy("_part", *by).agg(*[F.sum(c).alias(c) for c in raw])
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select("_part", *by, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in raw])
    out = dealt.withColumns({f"{c}_own": F.sum(c).over(own) for c in raw})
    # A range meets few values of `by`: as many rows as ranges and values of `by` together.
    shift = shift.withColumnsRenamed({c: f"_by{k}" for k, c in enumerate(["_part", *by])})
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(["_part", *by])]
    out = out.join(shift, reduce(lambda a, b: a & b, same))
    return out.select(*df.columns, *[(F.col(f"{c}_own") + F.col(f"{c}_before")).alias(name) for c, name in zip(raw, sums, strict=True)])


def numbered(df: DataFrame, order: Sequence[str], name: str = "rn", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with a row number from 0 in ``order``."""
    out = running_sums(df, order, {name: F.lit(1).cast("long")}, by)
    return out.withColumn(name, F.col(name) - 1)


def percentiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """``by`` and ``name``, an array: the exact percentiles of ``value`` with linear interpolation, null values left out.

    Equal values are counted first, running counts give each distinct value its ranks, and only the two values around each
    percentile are gathered, so no task holds a group's values. Groups without values give no row.
    """
    tied = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    tied = stage(tied)
    ranked = running_sums(tied, ["_v"], {"_upto": F.col("_c")}, by)
    sizes = tied.groupBy(*by).agg(F.sum("_c").alias("_n")).withColumnsRenamed({c: f"_of{k}" for k, c in enumerate(by)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{k}")) for k, c in enumerate(by)], F.lit(True))
    rows = ranked.join(F.broadcast(sizes) if not by else sizes, same)
    picked = []
    for k, share in enumerate(shares):
        at = (F.col("_n") - 1) * F.lit(float(share))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picked.append(F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c")), F.col("_v"))).alias(f"{side}{k}"))
    found = rows.groupBy(*by).agg(F.first("_n").alias("_n"), *picked)
    at = lambda share: (F.col("_n") - 1) * F.lit(float(share))
    mixed = [F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (at(s) - F.floor(at(s))) for k, s in enumerate(shares)]
    return found.select(*by, F.array(*mixed).alias(name))
