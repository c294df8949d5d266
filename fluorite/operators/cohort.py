"""Per-condition tables and statistics: summaries, densities, two-sample tests, length normalisation, reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fluorite.functions.ranking import numbered, percentiles, running_sums
from fluorite.functions.scratch import stage
from fluorite.functions.special import p_ks, p_u, p_upper, p_welch


def summary(cells: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean and sum of the positive values of each group."""
    return cells.where(F.col(value) > 0).groupBy(*by).agg(F.count("*").alias("n_cells"), F.avg(value).alias("mean_value"), F.sum(value).alias("sum_value"))


def five_numbers(cells: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum, and the ends of whiskers at 1.5 interquartile ranges."""
    q = percentiles(cells, value, [0.0, 0.25, 0.5, 0.75, 1.0], by)
    q = q.select(*by, *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("v_min", "v_q1", "v_median", "v_q3", "v_max"))])
    reach = 1.5 * (F.col("v_q3") - F.col("v_q1"))
    inside = cells.join(q, list(by)).where(F.col(value).between(F.col("v_q1") - reach, F.col("v_q3") + reach))
    ends = inside.groupBy(*by).agg(F.min(value).alias("whisker_lo"), F.max(value).alias("whisker_hi"))
    return q.join(ends, list(by))


def histogram(cells: DataFrame, by: Sequence[str], value: str, lo: float, width: float, bins: int) -> DataFrame:
    """Counts in equal bins; values outside go to the end bins."""
    k = F.greatest(F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)), F.lit(0)).cast("long")
    return cells.groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n")).withColumn("bin_start", F.col("bin") * width + lo)


def density(cells: DataFrame, by: Sequence[str], value: str, points: int = 16) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on a grid over each group's range.

    Equal values are counted first; then each distinct value meets the grid's fixed number of points.
    """
    stats = cells.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    stats = stats.where("sd > 0").withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
    tied = cells.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    grid = tied.join(stats, list(by)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1)
    part = F.col("c") * F.exp(-0.5 * F.pow((at - F.col("value")) / F.col("h"), 2))
    out = grid.groupBy(*by, F.col("k").cast("long").alias("k")).agg(F.min(at).alias("pos"), (F.sum(part) / F.first(F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))
    return out


def moments(cells: DataFrame, group: str, value: str) -> DataFrame:
    return cells.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def welch(cells: DataFrame, pairs: DataFrame, group: str, value: str) -> DataFrame:
    """t and degrees of freedom of each pair (a, b); pairs with an empty group drop out."""
    m = moments(cells, group, value)
    one = m.select(F.col("g").alias("a"), F.col("n").alias("n1"), F.col("m").alias("m1"), F.col("v").alias("v1"))
    two = m.select(F.col("g").alias("b"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("v").alias("v2"))
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(s1 + s2))
    df = F.try_divide(F.pow(s1 + s2, F.lit(2)), F.try_divide(s1 * s1, F.col("n1") - 1) + F.try_divide(s2 * s2, F.col("n2") - 1))
    return pairs.join(one, "a").join(two, "b").select(label(), "n1", "n2", t.alias("t_stat"), df.alias("df"))


def label() -> Column:
    return F.concat("a", F.lit(" vs "), "b").alias("comparison")


def by_prefix(cells: DataFrame, conditions: Sequence[str], group: str) -> DataFrame:
    """``cells`` of groups that begin with one of ``conditions``, as that condition: ``Incision_0h`` takes ``Incision_0h_1``.

    A group that several conditions begin counts for each; a null group for none.
    """
    own = F.filter(F.array(*[F.lit(c) for c in conditions]), lambda c: F.coalesce(F.startswith(F.col(group), c), F.lit(False)))
    return cells.withColumn(group, F.explode(own))


def _pooled(cells: DataFrame, pairs: DataFrame, group: str, value: str) -> DataFrame:
    """comparison, value, c1, c2: how often each value occurs on either side of each pair."""
    tied = cells.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("c"))
    sides = pairs.select(label(), F.explode(F.array(F.struct(F.col("a").alias("g"), F.lit(1).alias("side")), F.struct(F.col("b").alias("g"), F.lit(2).alias("side")))).alias("s")).select("comparison", "s.g", "s.side")
    on = lambda k: F.sum(F.when(F.col("side") == k, F.col("c")).otherwise(0)).alias(f"c{k}")
    return tied.join(sides, "g").groupBy("comparison", "value").agg(on(1), on(2))


def _sizes(pooled: DataFrame) -> DataFrame:
    return pooled.groupBy("comparison").agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2")).where("n1 > 0 AND n2 > 0")


def kolmogorov_smirnov(cells: DataFrame, pairs: DataFrame, group: str, value: str) -> DataFrame:
    """The largest distance of the two distribution functions of each pair."""
    pooled = stage(_pooled(cells, pairs, group, value))
    run = running_sums(pooled, ["value"], {"f1": F.col("c1"), "f2": F.col("c2")}, ["comparison"])
    gap = F.abs(F.col("f1") / F.col("n1") - F.col("f2") / F.col("n2"))
    return run.join(_sizes(pooled), "comparison").groupBy("comparison").agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(gap).alias("ks_stat"))


def mann_whitney(cells: DataFrame, pairs: DataFrame, group: str, value: str) -> DataFrame:
    """U of the first group by mid-ranks, the tie- and continuity-corrected z of each alternative, and the sum of t^3 - t over ties."""
    pooled = stage(_pooled(cells, pairs, group, value).withColumn("t", F.col("c1") + F.col("c2")))
    run = running_sums(pooled, ["value"], {"upto": F.col("t")}, ["comparison"])
    mid = F.col("upto") - F.col("t") + (F.col("t") + 1) / 2
    r = run.groupBy("comparison").agg(F.sum(mid * F.col("c1")).alias("r1"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    out = r.join(_sizes(pooled), "comparison").withColumn("u_stat", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    gap = F.col("u_stat") - F.col("n1") * F.col("n2") / 2
    z = lambda g: F.try_divide(g - 0.5, F.sqrt(var))
    return out.select("comparison", "n1", "n2", "u_stat", z(-gap).alias("z_less"), z(F.abs(gap)).alias("z_two_sided"), "ties")


def welch_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", p_welch("t_stat", "df"))


def ks_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", p_ks("ks_stat", F.col("n1").cast("double"), F.col("n2").cast("double")))


def mwu_p(tests: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """Adds p_value: exact for small samples without ties, by the normal approximation otherwise."""
    less, both = alternative == "less", F.col("n1") * F.col("n2")
    u = F.col("u_stat") if less else F.least("u_stat", both - F.col("u_stat"))
    exact = p_u(u, F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("ties").cast("double"))
    exact, normal = (exact, p_upper("z_less")) if less else (2 * exact, 2 * p_upper("z_two_sided"))
    return tests.withColumn("p_value", F.least(F.lit(1.0), F.coalesce(exact, normal))).drop("ties")


def significance(p: Column, level: float = 0.05) -> Column:
    return F.when(p < level, "significant").otherwise("not significant")


def per_length(cells: DataFrame, lengths: DataFrame, group: str, value: str) -> DataFrame:
    """Spots and expressing cells of each condition over its length, and the lengths over these; null without a length."""
    totals = cells.where(F.col(value) > 0).groupBy(F.col(group).alias("condition")).agg(F.sum(value).alias("total"), F.count("*").alias("n_cells"))
    known = F.col("length").isNotNull()
    ratio = lambda a, b: F.when(known, F.try_divide(F.col(a), F.col(b)))
    return totals.join(lengths.select("condition", "length"), "condition", "left").select(
        "condition", "total", "n_cells", ratio("total", "length").alias("spots_per_length"), ratio("n_cells", "length").alias("cells_per_length"), ratio("length", "total").alias("length_per_spot"), ratio("length", "n_cells").alias("length_per_cell")
    )


def wide_ragged(long: DataFrame, column: str, value: str, order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """A column for each of ``names``, its values in order from row 0 on, null below its end."""
    rows = numbered(long.where(F.col(column).isin(*names)), order, "row_idx", [column])
    return rows.groupBy("row_idx").pivot(column, list(names)).agg(F.first(value))


def long_from_wide(wide: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(ids), list(names), "condition", "value").where(F.col("value").isNotNull())


def replicate_numbers(files: DataFrame, by: Sequence[str], path: str) -> DataFrame:
    """Replicates 1..n of each condition in order of path."""
    return files.withColumn("replicate", F.row_number().over(W.partitionBy(*by).orderBy(path)))
