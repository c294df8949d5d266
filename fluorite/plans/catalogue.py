"""Queries over the given tables, each an operator applied to a whole table, and the same in SQL for DuckDB.

Sums and means of doubles are rounded on both sides, as their order of addition differs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluorite.functions.joins import shuffled
from fluorite.functions.ranking import numbered, percentiles
from fluorite.functions.scratch import scratch_dir, stage
from fluorite.operators import cohort, raster
from fluorite.operators import spots as sp
from fluorite.plans import adapters as ad
from fluorite.plans.adapters import with_tables as w

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VOXEL, RADIUS, MIN_SPOTS = (361.0, 75.0, 75.0), 250.0, 4
#: Pairs of conditions that the tests compare.
PAIRS = [("Incision_0h", "Amputation_0h"), ("Incision_6h", "Amputation_6h"), ("Incision_12h", "Amputation_12h"), ("Incision_0h", "Incision_6h"), ("Amputation_0h", "Amputation_12h")]
#: Injury lengths of the first image of each condition.
LENGTHS = {"Amputation_0h": 575.145, "Incision_0h": 366.728, "Amputation_6h": 739.554, "Incision_6h": 382.210, "Amputation_12h": 926.973, "Incision_12h": 308.338}
GROUPS = sorted(LENGTHS)
#: Names of conditions in figures.
RENAMED = {"Incision_0h": "Incision 0 hpa", "Incision_6h": "Incision 6 hpa", "Amputation_0h": "Amputation 0 hpa", "Amputation_6h": "Amputation 6 hpa"}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def pairs_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "a string, b string")


def lengths_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LENGTHS.items()), "condition string, length double")


PAIRS_SQL = "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") t(a, b))"
LENGTHS_SQL = "lengths AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE)" for a, b in LENGTHS.items()) + ") t(condition, length))"


# ---- tables of cells: summaries -------------------------------------------------------------------------------------


@query(w("cells") + " SELECT grp, rep, count(*) AS n_cells, round(avg(n), 6) AS mean_value, sum(n) AS sum_value FROM cells WHERE n > 0 GROUP BY ALL")
def cohort_summary(spark, d):
    return rounded(cohort.summary(ad.cells(spark, d), ["grp", "rep"], "n"), "mean_value")


@query(
    w("cells")
    + """, q AS (SELECT grp, quantile_cont(inten, 0.0) AS v_min, quantile_cont(inten, 0.25) AS v_q1, quantile_cont(inten, 0.5) AS v_median, quantile_cont(inten, 0.75) AS v_q3, quantile_cont(inten, 1.0) AS v_max FROM cells GROUP BY grp),
e AS (SELECT grp, min(inten) AS whisker_lo, max(inten) AS whisker_hi FROM cells JOIN q USING (grp) WHERE inten BETWEEN v_q1 - 1.5 * (v_q3 - v_q1) AND v_q3 + 1.5 * (v_q3 - v_q1) GROUP BY grp)
SELECT grp, round(v_min, 6) AS v_min, round(v_q1, 6) AS v_q1, round(v_median, 6) AS v_median, round(v_q3, 6) AS v_q3, round(v_max, 6) AS v_max, whisker_lo, whisker_hi FROM q JOIN e USING (grp)"""
)
def cohort_boxplot(spark, d):
    return rounded(cohort.five_numbers(ad.cells(spark, d), ["grp"], "inten"), "v_min", "v_q1", "v_median", "v_q3", "v_max")


@query(w("cells") + " SELECT grp, rep, round(avg(ln(1 + inten)), 6) AS mean_log1p, count(*) AS n_cells FROM cells GROUP BY ALL")
def cohort_log1p_mean(spark, d):
    return ad.cells(spark, d).groupBy("grp", "rep").agg(r6(F.avg(F.log1p("inten"))).alias("mean_log1p"), F.count("*").alias("n_cells"))


@query(w("cells") + " SELECT grp, greatest(least(floor((inten - 0.0) / 5000), 19), 0)::BIGINT AS bin, count(*) AS n, greatest(least(floor((inten - 0.0) / 5000), 19), 0) * 5000.0::DOUBLE AS bin_start FROM cells GROUP BY ALL")
def cohort_histogram(spark, d):
    return cohort.histogram(ad.cells(spark, d), ["grp"], "inten", 0.0, 5000.0, 20)


@query(
    w("cells")
    + """, s AS (SELECT grp, count(*) AS c, stddev_samp(n) * count(*) ^ (-0.2) AS h, min(n) AS lo, max(n) AS hi FROM cells GROUP BY grp),
g AS (SELECT s.*, k, lo + (hi - lo) * k / 15 AS pos FROM s, range(16) t(k)),
t AS (SELECT grp, n, count(*) AS m FROM cells GROUP BY ALL)
SELECT grp, k, round(any_value(pos), 6) AS pos, round(sum(m * exp(-0.5 * ((pos - n) / h) ^ 2)) / any_value(c * h * 2.5066282746310002), 6) AS density FROM g JOIN t USING (grp) GROUP BY grp, k"""
)
def cohort_kde(spark, d):
    return rounded(cohort.density(ad.cells(spark, d), ["grp"], "n"), "pos", "density")


@query(w("cells") + " SELECT max(inten) AS overall_max, round(avg(m), 6) AS mean_of_means FROM (SELECT grp, rep, max(inten) AS inten, avg(n) AS m FROM cells GROUP BY ALL)")
def overall_max(spark, d):
    g = ad.cells(spark, d).groupBy("grp", "rep").agg(F.max("inten").alias("inten"), F.avg("n").alias("m"))
    return g.agg(F.max("inten").alias("overall_max"), r6(F.avg("m")).alias("mean_of_means"))


@query(w("cells") + " SELECT rep, round(avg(n), 6) AS mean_nonzero FROM cells WHERE n <> 0 GROUP BY rep")
def nonzero_means(spark, d):
    return ad.cells(spark, d).where("n <> 0").groupBy("rep").agg(r6(F.avg("n")).alias("mean_nonzero"))


# ---- tables of cells: reshaping -------------------------------------------------------------------------------------


@query(
    w("cells")
    + ", wide AS (SELECT rep, " + ", ".join(f"sum(n) FILTER (grp = '{g}') AS {g}" for g in GROUPS) + " FROM cells GROUP BY rep) "
    + " UNION ALL ".join(f"SELECT rep, '{g}' AS condition, {g} AS value FROM wide WHERE {g} IS NOT NULL" for g in GROUPS)
)
def melt_long(spark, d):
    wide = ad.cells(spark, d).groupBy("rep").pivot("grp", GROUPS).agg(F.sum("n"))
    return cohort.long_from_wide(wide, ["rep"], GROUPS)


@query(
    w("cells")
    + ", r AS (SELECT grp, inten, row_number() OVER (PARTITION BY grp ORDER BY inten, n, rep) - 1 AS row_idx FROM cells) SELECT row_idx, "
    + ", ".join(f"max(inten) FILTER (grp = '{g}') AS {g}" for g in GROUPS) + " FROM r GROUP BY row_idx"
)
def wide_ragged(spark, d):
    return cohort.wide_ragged(ad.cells(spark, d), "grp", "inten", ["inten", "n", "rep"], GROUPS)


@query(w("cells") + " SELECT regexp_extract(grp || '_' || rep, '([A-Za-z]+_[0-9]+h)', 1) AS grp, regexp_extract(grp, '_([0-9]+)h', 1)::BIGINT AS hours, count(*) AS n FROM cells GROUP BY ALL")
def group_extract(spark, d):
    name = F.concat_ws("_", "grp", "rep")
    return ad.cells(spark, d).groupBy(F.regexp_extract(name, "([A-Za-z]+_[0-9]+h)", 1).alias("grp"), F.regexp_extract(name, "_([0-9]+)h", 1).cast("long").alias("hours")).agg(F.count("*").alias("n"))


@query(w("cells") + " SELECT CASE grp " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMED.items()) + " END AS shown, count(*) AS n FROM cells GROUP BY ALL")
def condition_rename(spark, d):
    names = F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])
    return ad.cells(spark, d).groupBy(F.try_element_at(names, F.col("grp")).alias("shown")).agg(F.count("*").alias("n"))


FILES_SQL = "files AS (SELECT DISTINCT grp, '/exp/' || grp || '/Image' || rep || '/565/results/spots.npy' AS path FROM cells)"


@query(w("cells") + f", {FILES_SQL} SELECT grp, path, row_number() OVER (PARTITION BY grp ORDER BY path) AS replicate, grp || '_' || row_number() OVER (PARTITION BY grp ORDER BY path) AS col_name FROM files")
def replicate_number(spark, d):
    files = ad.cells(spark, d).select("grp", F.concat(F.lit("/exp/"), "grp", F.lit("/Image"), "rep", F.lit("/565/results/spots.npy")).alias("path")).distinct()
    return cohort.replicate_numbers(files, ["grp"], "path").withColumn("col_name", F.concat_ws("_", "grp", "replicate"))


@query(
    w("cells")
    + """, f AS (SELECT DISTINCT '/exp/' || grp || '/Image' || rep || '/565/' || p || lpad((rep * 7)::VARCHAR, 3, '0') || '.tif' AS path FROM cells, (VALUES ('label_'), ('stacked_'), ('max_projection_')) t(p))
SELECT path, regexp_extract(path, '/([^/]+)/Image', 1) AS condition, regexp_extract(path, 'Image([0-9]+)', 1) AS image FROM f
WHERE regexp_matches(path, '[0-9]{3}\\.tif$') AND NOT regexp_matches(path, '/(stacked_|max_projection_)[^/]*$')"""
)
def manifest_scan(spark, d):
    from fluorite.sources import files

    made = ad.cells(spark, d).select("grp", "rep").distinct().withColumn("p", F.explode(F.array(F.lit("label_"), F.lit("stacked_"), F.lit("max_projection_"))))
    path = F.concat(F.lit("/exp/"), "grp", F.lit("/Image"), "rep", F.lit("/565/"), "p", F.lpad((F.col("rep") * 7).cast("string"), 3, "0"), F.lit(".tif"))
    kept = files.label_images(made.select(path.alias("path")))
    return kept.select("path", F.regexp_extract("path", "/([^/]+)/Image", 1).alias("condition"), F.regexp_extract("path", "Image([0-9]+)", 1).alias("image"))


@query("SELECT c_custkey AS image, round(c_acctbal, 2) AS threshold FROM customer WHERE c_acctbal >= 0")
def sidecar_thresholds(spark, d):
    from fluorite.sources import files

    c = ad.table(spark, d, "customer")
    text = F.concat(F.lit("shape: (30, 64, 64)\ndtype: uint16\nthreshold: "), F.col("c_acctbal").cast("decimal(20,2)").cast("string"), F.lit("\n"))
    lines = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("image"), F.explode(F.split(text, "\n")).alias("value"))
    return files.thresholds(lines).select("image", F.round("threshold", 2).alias("threshold"))


@query("SELECT o_custkey AS image, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) * 1000000000000 + o_orderkey) AS chosen FROM orders GROUP BY o_custkey")
def read_with_fallback(spark, d):
    from fluorite.sources import files

    o = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("file"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("priority"))
    return files.first_available(o, "image", ["priority", "file"]).select("image", F.col("file").alias("chosen"))


# ---- two-sample tests -----------------------------------------------------------------------------------------------

MOMENTS = "m AS (SELECT grp AS g, count(*) AS n, avg(n) AS m, var_samp(n) AS v FROM cells GROUP BY grp)"


@query(
    w("cells") + f", {PAIRS_SQL}, {MOMENTS}" + """ SELECT p.a || ' vs ' || p.b AS comparison, x.n AS n1, y.n AS n2, round((x.m - y.m) / sqrt(x.v / x.n + y.v / y.n), 6) AS t_stat,
round((x.v / x.n + y.v / y.n) ^ 2 / ((x.v / x.n) ^ 2 / (x.n - 1) + (y.v / y.n) ^ 2 / (y.n - 1)), 4) AS df FROM pairs p JOIN m x ON x.g = p.a JOIN m y ON y.g = p.b"""
)
def welch_stat(spark, d):
    return rounded(cohort.welch(ad.cells(spark, d), pairs_table(spark), "grp", "n"), "t_stat").withColumn("df", F.round("df", 4))


POOLED = """sides AS (SELECT a || ' vs ' || b AS comparison, a AS g, 1 AS side FROM pairs UNION ALL SELECT a || ' vs ' || b, b, 2 FROM pairs),
pool AS (SELECT comparison, {v} AS value, count(*) FILTER (side = 1) AS c1, count(*) FILTER (side = 2) AS c2 FROM cells JOIN sides ON grp = g GROUP BY ALL),
size AS (SELECT comparison, sum(c1) AS n1, sum(c2) AS n2 FROM pool GROUP BY comparison HAVING sum(c1) > 0 AND sum(c2) > 0)"""


@query(
    w("cells") + f", {PAIRS_SQL}, {POOLED.format(v='inten')}, " + """run AS (SELECT comparison, sum(c1) OVER o AS f1, sum(c2) OVER o AS f2 FROM pool WINDOW o AS (PARTITION BY comparison ORDER BY value))
SELECT comparison, any_value(n1)::BIGINT AS n1, any_value(n2)::BIGINT AS n2, round(max(abs(f1 / n1 - f2 / n2)), 9) AS ks_stat FROM run JOIN size USING (comparison) GROUP BY comparison"""
)
def ks_stat(spark, d):
    return cohort.kolmogorov_smirnov(ad.cells(spark, d), pairs_table(spark), "grp", "inten").withColumn("ks_stat", F.round("ks_stat", 9))


@query(
    w("cells") + f", {PAIRS_SQL}, {POOLED.format(v='n')}, " + """run AS (SELECT *, sum(c1 + c2) OVER (PARTITION BY comparison ORDER BY value) - (c1 + c2) + (c1 + c2 + 1) / 2 AS mid FROM pool)
SELECT comparison, any_value(n1)::BIGINT AS n1, any_value(n2)::BIGINT AS n2, round(sum(mid * c1) - any_value(n1 * (n1 + 1) / 2), 6) AS u_stat FROM run JOIN size USING (comparison) GROUP BY comparison"""
)
def mwu_stat(spark, d):
    return rounded(cohort.mann_whitney(ad.cells(spark, d), pairs_table(spark), "grp", "n"), "u_stat").select("comparison", "n1", "n2", "u_stat")


@query()
def welch_p(spark, d):
    return cohort.welch_p(cohort.welch(ad.cells(spark, d), pairs_table(spark), "grp", "n"))


@query()
def ks_p(spark, d):
    return cohort.ks_p(cohort.kolmogorov_smirnov(ad.cells(spark, d), pairs_table(spark), "grp", "n"))


@query()
def mwu_p(spark, d):
    return cohort.mwu_p(cohort.mann_whitney(ad.cells(spark, d), pairs_table(spark), "grp", "n"), "less")


@query()
def sorted_results(spark, d):
    tests = cohort.mwu_p(cohort.mann_whitney(ad.cells(spark, d), pairs_table(spark), "grp", "inten"))
    return tests.withColumn("label", cohort.significance(F.col("p_value"))).orderBy("p_value", "comparison")


@query(w("cells") + f", {LENGTHS_SQL}, t AS (SELECT grp AS condition, sum(n) AS total, count(*) AS n_cells FROM cells WHERE n > 0 GROUP BY grp) SELECT condition, total, n_cells, round(total / length, 6) AS spots_per_length, round(n_cells / length, 6) AS cells_per_length FROM t LEFT JOIN lengths USING (condition)")
def length_normalised(spark, d):
    out = cohort.per_length(ad.cells(spark, d), lengths_table(spark), "grp", "n")
    return rounded(out, "spots_per_length", "cells_per_length").drop("length_per_spot", "length_per_cell")


@query(w("cells") + f", {LENGTHS_SQL}, t AS (SELECT grp AS condition, sum(n) AS total, count(*) AS n_cells FROM cells WHERE n > 0 AND rep = 1 GROUP BY grp) SELECT condition, round(length / total, 9) AS length_per_spot, round(length / n_cells, 9) AS length_per_cell FROM t LEFT JOIN lengths USING (condition)")
def inverse_length(spark, d):
    out = cohort.per_length(ad.cells(spark, d).where("rep = 1"), lengths_table(spark), "grp", "n")
    return out.select("condition", *[F.round(c, 9).alias(c) for c in ("length_per_spot", "length_per_cell")])


# ---- spots: thresholds, filters, counts -----------------------------------------------------------------------------


@query("SELECT coalesce(quantile_cont(value, 0.99), 0) AS threshold FROM events")
def control_threshold_percentile(spark, d):
    return sp.threshold_percentile(ad.spots(spark, d), "intensity", 0.99)


@query("SELECT spot_id, total, peak FROM (SELECT event_id AS spot_id, value AS total, user_id AS peak, row_number() OVER (ORDER BY value, event_id) - 1 AS rn, count(*) OVER () AS n FROM events) WHERE rn = least(floor(n * 0.99), n - 1)")
def control_threshold_rank(spark, d):
    e = ad.table(spark, d, "events").select(F.col("event_id").alias("spot_id"), F.col("value").alias("total"), F.col("user_id").alias("peak"))
    return sp.threshold_rank(e, "total", "peak", 0.99)


@query("SELECT event_type AS channel, coalesce(CASE WHEN event_type = 'purchase' THEN 50.0 END, CASE WHEN count(*) FILTER (user_id % 2 = 0) > 0 THEN quantile_cont(value, 0.99) FILTER (user_id % 2 = 0) END, 10.0, max(value)) AS threshold FROM events GROUP BY event_type")
def threshold_precedence(spark, d):
    s = ad.table(spark, d, "events").groupBy(F.col("event_type").alias("channel")).agg(F.max("value").alias("auto"))
    even = ad.table(spark, d, "events").where("user_id % 2 = 0").select(F.col("event_type").alias("channel"), "value")
    s = s.join(percentiles(even, "value", [0.99], ["channel"]).select("channel", F.get("q", F.lit(0)).alias("control")), "channel", "left")
    manual = F.when(F.col("channel") == "purchase", F.lit(50.0))
    return s.select("channel", sp.threshold_precedence(manual, F.col("control"), F.lit(10.0), F.col("auto")).alias("threshold"))


@query(w("img") + " SELECT round(quantile_cont(v, 0.999), 9) AS threshold, count(*) AS n FROM img WHERE v < 0")
def auto_threshold_quantile(spark, d):
    i = ad.img(spark, d).where("v < 0")
    return percentiles(i, "v", [0.999]).select(F.round(F.get("q", F.lit(0)), 9).alias("threshold")).join(F.broadcast(i.agg(F.count("*").alias("n"))))


@query("SELECT k, (k * 10)::DOUBLE AS threshold, (SELECT count(*) FROM events WHERE value >= k * 10) AS n_spots FROM range(40) t(k)")
def elbow_curve(spark, d):
    return sp.elbow(ad.spots(spark, d), "intensity", 0.0, 10.0, 40)


CONTROL = "c AS (SELECT avg(intensity) AS m FROM spots WHERE channel = 'view')"


@query(w("spots") + f", {CONTROL} SELECT channel, count(*) AS n, round(min(intensity), 6) AS dimmest FROM spots, c WHERE channel <> 'view' AND (m IS NULL OR intensity >= m) GROUP BY channel")
def background_filter(spark, d):
    s = ad.spots(spark, d)
    kept = sp.background_filter(s.where("channel <> 'view'"), s.where("channel = 'view'"))
    return kept.groupBy("channel").agg(F.count("*").alias("n"), r6(F.min("intensity")).alias("dimmest"))


@query(w("spots") + " SELECT spot_id, intensity FROM spots WHERE intensity < 150")
def intensity_clip(spark, d):
    return ad.spots(spark, d).where("intensity < 150").select("spot_id", "intensity")


NEAR_SQL = """p AS (SELECT z, y, x, count(*) AS n FROM {of} GROUP BY ALL),
near AS (SELECT a.z, a.y, a.x, b.z AS z2, b.y AS y2, b.x AS x2, b.n AS n2 FROM p a JOIN p b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 4 AND a.y + 4 AND b.x BETWEEN a.x - 4 AND a.x + 4
  AND ((a.z - b.z) * 361) ^ 2 + ((a.y - b.y) * 75) ^ 2 + ((a.x - b.x) * 75) ^ 2 <= 62500),
core AS (SELECT z, y, x, sum(n2) AS n_near FROM near GROUP BY ALL)"""


@query(w("spots") + f", {CONTROL}, kept AS (SELECT spots.* FROM spots, c WHERE (m IS NULL OR intensity >= m) AND intensity < 150), {NEAR_SQL.format(of='kept')}" + """ SELECT 'raw' AS stage, count(*) AS n, round(avg(intensity), 6) AS mean_intensity FROM spots
UNION ALL SELECT 'background_removed', count(*), round(avg(intensity), 6) FROM spots, c WHERE m IS NULL OR intensity >= m
UNION ALL SELECT 'clipped', count(*), round(avg(intensity), 6) FROM kept UNION ALL SELECT 'clustered', count(*), round(avg(intensity), 6) FROM kept k WHERE EXISTS (FROM near n JOIN core c ON c.z = n.z2 AND c.y = n.y2 AND c.x = n.x2 WHERE c.n_near >= 4 AND n.z = k.z AND n.y = k.y AND n.x = k.x)""")
def stage_counts(spark, d):
    s = ad.spots(spark, d)
    kept = sp.background_filter(s, s.where("channel = 'view'"))
    count = lambda name, df: df.agg(F.lit(name).alias("stage"), F.count("*").alias("n"), r6(F.avg("intensity")).alias("mean_intensity"))
    clipped = stage(kept.where("intensity < 150"))
    clustered = sp.clusters(clipped, VOXEL, RADIUS, MIN_SPOTS).where("cluster IS NOT NULL").join(clipped, "spot_id")
    return count("raw", s).unionByName(count("background_removed", kept)).unionByName(count("clipped", clipped)).unionByName(count("clustered", clustered))


@query(w("spots") + " SELECT DISTINCT z, y, x FROM spots")
def distinct_voxels(spark, d):
    return ad.spots(spark, d).select("z", "y", "x").distinct()


@query(w("spots") + " SELECT spot_id, z, y, x, intensity FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY intensity DESC, spot_id) AS r FROM spots) WHERE r = 1")
def brightest_of_channel(spark, d):
    best = ad.spots(spark, d).groupBy("channel").agg(F.max(F.struct("intensity", (-F.col("spot_id")).alias("k"), "z", "y", "x")).alias("b"))
    return best.select((-F.col("b.k")).alias("spot_id"), "b.z", "b.y", "b.x", "b.intensity")


# ---- spots: clusters ------------------------------------------------------------------------------------------------

@query(w("spots") + f", {NEAR_SQL.format(of='spots')} SELECT spot_id, n_near::BIGINT AS n_near, n_near >= 4 AS is_core FROM spots JOIN core USING (z, y, x)")
def cluster_core(spark, d):
    return sp.cluster_cores(ad.spots(spark, d), VOXEL, RADIUS, MIN_SPOTS).select("spot_id", "n_near", "is_core")


@query(
    w("spots", recursive=True) + f", {NEAR_SQL.format(of='spots')}" + """, flag AS (SELECT spot_id, z, y, x, n_near >= 4 AS is_core FROM spots JOIN core USING (z, y, x)),
c AS (SELECT z, y, x, min(spot_id) AS node FROM flag WHERE is_core GROUP BY ALL),
l AS (SELECT a.node AS a, b.node AS b FROM near n JOIN c a ON a.z = n.z AND a.y = n.y AND a.x = n.x JOIN c b ON b.z = n.z2 AND b.y = n.y2 AND b.x = n.x2),
r AS (SELECT node AS a, node AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
comp AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a),
own AS (SELECT n.z, n.y, n.x, min(component) AS "cluster" FROM near n JOIN c ON c.z = n.z2 AND c.y = n.y2 AND c.x = n.x2 JOIN comp USING (node) GROUP BY ALL)
SELECT spot_id, is_core, "cluster" FROM flag LEFT JOIN own USING (z, y, x)"""
)
def cluster_components(spark, d):
    return sp.clusters(ad.spots(spark, d), VOXEL, RADIUS, MIN_SPOTS)


# ---- images ---------------------------------------------------------------------------------------------------------


@query(w("img") + " SELECT z // 7 AS plane, y, x, max(v) AS v FROM img GROUP BY ALL HAVING count(*) = 7")
def project_max_full(spark, d):
    return raster.project_full(ad.img(spark, d), 7)


@query(w("img") + " SELECT z // 10 AS plane, y, x, max(v) AS v FROM img GROUP BY ALL")
def project_max_grouped(spark, d):
    return raster.project_grouped(ad.img(spark, d), 10)


@query(w("img") + ", e AS (SELECT z // 10 AS plane, min(z) AS z0, max(z) AS z1 FROM img GROUP BY ALL) SELECT plane, y, x, max(v) AS v FROM img JOIN e ON e.plane = z // 10 WHERE z < z1 OR z0 = z1 GROUP BY ALL")
def project_max_compat(spark, d):
    return raster.project_grouped(ad.img(spark, d), 10, compat_drop_last=True)


@query(w("img") + " SELECT y, x, max(v) AS v, count(*) AS n_planes FROM img GROUP BY ALL")
def project_max_stack(spark, d):
    return raster.project_stack(ad.img(spark, d))


@query(w("img") + ", s AS (SELECT z, min(v) AS lo, max(v) AS hi FROM img GROUP BY z) SELECT z, y, x, round(CASE WHEN hi = lo THEN 0 ELSE (v - lo) / (hi - lo) END, 9) AS v FROM img JOIN s USING (z)")
def minmax_norm(spark, d):
    return raster.minmax_normalise(ad.img(spark, d)).withColumn("v", F.round("v", 9))


@query(w("img") + ", s AS (SELECT z, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.998) AS hi FROM img GROUP BY z) SELECT z, y, x, round((v - lo) / (hi - lo), 6) AS v FROM img JOIN s USING (z)")
def percentile_norm(spark, d):
    return rounded(raster.percentile_normalise(ad.img(spark, d)), "v")


@query(w("spots") + " SELECT spot_id, round(intensity / (SELECT max(intensity) FROM spots) * 100, 6) AS pct FROM spots")
def pct_of_max(spark, d):
    s = ad.spots(spark, d)
    return s.join(F.broadcast(s.agg(F.max("intensity").alias("top")))).select("spot_id", r6(F.col("intensity") / F.col("top") * 100).alias("pct"))


def _extrema_sql(f: str, test: str) -> str:
    src, col = "img", "v"
    for k, (axis, rest, reach) in enumerate((("x", "z, y", 2), ("y", "z, x", 2), ("z", "y, x", 1)), 1):
        src = f"(SELECT *, {f}({col}) OVER (PARTITION BY {rest} ORDER BY {axis} RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS m{k} FROM {src})"
        col = f"m{k}"
    return f" SELECT z, y, x, v FROM {src} WHERE v = m3 AND {test}"


@query(w("img") + _extrema_sql("max", "v > 0"))
def local_maxima(spark, d):
    return raster.extrema(ad.img(spark, d), 1, 2, 2)


@query(w("img") + _extrema_sql("min", "v < 0"))
def local_minima(spark, d):
    return raster.extrema(ad.img(spark, d), 1, 2, 2, "min")


@query(w("img") + ", q AS (SELECT l.z, l.y, l.x, s_suppkey AS spot_id FROM supplier JOIN img l ON l.z = s_suppkey AND l.y = s_suppkey % 8 AND l.x = s_nationkey % 8) SELECT spot_id, i.y - q.y AS dy, i.x - q.x AS dx, max(v) AS v FROM q JOIN img i ON i.z BETWEEN q.z - 2 AND q.z + 2 AND i.y BETWEEN q.y - 3 AND q.y + 3 AND i.x BETWEEN q.x - 3 AND q.x + 3 GROUP BY ALL")
def centre_crop_mip(spark, d):
    s = ad.table(spark, d, "supplier")
    points = s.select(F.col("s_suppkey").alias("spot_id"), F.col("s_suppkey").alias("z"), (F.col("s_suppkey") % 8).alias("y"), (F.col("s_nationkey") % 8).cast("long").alias("x"))
    i = ad.img(spark, d)
    return raster.centre_crop(i, points.join(shuffled(i.select("z", "y", "x")), ["z", "y", "x"], "left_semi"), 2, 3, 3)


@query(w("img") + " SELECT z, y, x, v FROM img WHERE z = (SELECT (max(z) + 1) // 2 FROM img)")
def central_slice(spark, d):
    i = ad.img(spark, d)
    mid = i.agg(F.floor((F.max("z") + 1) / 2).cast("long").alias("z"))
    return i.join(F.broadcast(mid), "z").select("z", "y", "x", "v")


KERNEL = "k AS (SELECT d, exp(-0.5 * d ^ 2) / sum(exp(-0.5 * d ^ 2)) OVER () AS w FROM range(-3, 4) t(d))"


@query(w("img") + f", {KERNEL} SELECT z, round(sum(v * w), 9) AS edge_response FROM img JOIN k ON k.d = x - 3 GROUP BY z")
def gaussian_kernel(spark, d):
    k = raster.gaussian_kernel(spark, 1.0)
    i = ad.img(spark, d).withColumn("d", F.col("x") - 3)
    return i.join(F.broadcast(k), "d").groupBy("z").agg(F.round(F.sum(F.col("v") * F.col("w")), 9).alias("edge_response"))


SMOOTH = KERNEL + """,
gy AS (SELECT z, y + d AS y, x, sum(v * w) AS v FROM img, k WHERE y + d BETWEEN 0 AND 7 GROUP BY ALL),
gx AS (SELECT z, y, x + d AS x, sum(v * w) AS v FROM gy, k WHERE x + d BETWEEN 0 AND 7 GROUP BY ALL)"""


@query(w("img") + f", {SMOOTH} SELECT z, y, x, round(v, 9) AS v FROM gx")
def gaussian_smooth(spark, d):
    return raster.gaussian(ad.img(spark, d), {"y": 1.0, "x": 1.0}).withColumn("v", F.round("v", 9))


@query(w("img") + f", {SMOOTH}" + """ SELECT z, y, x, round(v, 8) AS v FROM (SELECT c.z, c.y, c.x, 2 * (9 * any_value(c.v) - sum(n.v)) AS v
FROM gx c JOIN gx n ON n.z = c.z AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY ALL)""")
def log_response(spark, d):
    return raster.log_response(ad.img(spark, d), {"y": 1.0, "x": 1.0}).withColumn("v", F.round("v", 8))


FLOOD = w("img", recursive=True) + f", s AS ({_extrema_sql('max', 'v > 0')})" + """, seed AS (SELECT z * 64 + y * 8 + x AS spot_id, z, y, x, v FROM s),
step AS (SELECT * FROM (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) t(dz, dy, dx)),
f AS (SELECT spot_id, z, y, x, v, 0 AS level FROM seed UNION SELECT f.spot_id, i.z, i.y, i.x, i.v, f.level + 1 FROM f, step JOIN img i ON i.z = f.z + dz AND i.y = f.y + dy AND i.x = f.x + dx WHERE f.level < 4 AND i.v > 0 AND f.v >= i.v),
flood AS (SELECT spot_id, z, y, x, any_value(v) AS v, min(level) AS level FROM f GROUP BY spot_id, z, y, x)"""
FLOOD_LEVELS = 4


def _flood(spark, d):
    i = ad.img(spark, d)
    seeds = raster.extrema(i, 1, 2, 2).withColumn("spot_id", F.col("z") * 64 + F.col("y") * 8 + F.col("x"))
    return i, raster.flood_fill(i, seeds, FLOOD_LEVELS)


@query(FLOOD + " SELECT spot_id, z, y, x FROM flood")
def flood_fill(spark, d):
    return _flood(spark, d)[1].select("spot_id", "z", "y", "x")


@query(FLOOD + " SELECT spot_id, level::BIGINT AS level, count(*) AS n, round(sum(v), 9) AS total FROM flood GROUP BY ALL")
def flood_levels(spark, d):
    return _flood(spark, d)[1].groupBy("spot_id", F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 9).alias("total"))


@query(FLOOD + " SELECT spot_id, round(sum(v), 9) AS total, count(*) AS n_voxels FROM flood GROUP BY spot_id")
def spot_intensity(spark, d):
    i, f = _flood(spark, d)
    return sp.integrate(f, i).withColumn("total", F.round("total", 9))


@query(FLOOD + " SELECT spot_id, " + ", ".join(f"max({a}) - min({a}) + 1 AS span_{a}, (max({a}) - min({a})) / 2 AS radius_{a}" for a in "zyx") + " FROM flood GROUP BY spot_id")
def spot_span(spark, d):
    return sp.spans(_flood(spark, d)[1])


@query(FLOOD + """, n AS (SELECT DISTINCT spot_id, z + dz AS z, y + dy AS y, x + dx AS x FROM flood, step),
b AS (SELECT min(z) AS z0, max(z) AS z1 FROM img)
SELECT spot_id, z, y, x FROM (SELECT n.* FROM n ANTI JOIN flood USING (spot_id, z, y, x)), b WHERE z BETWEEN z0 AND z1 AND y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7
UNION ALL SELECT spot_id, z, y, x FROM flood, b WHERE z IN (z0, z1) OR y IN (0, 7) OR x IN (0, 7)""")
def outer_shell(spark, d):
    i, f = _flood(spark, d)
    z0, z1 = i.agg(F.min("z"), F.max("z")).first()
    return raster.outer_shell(f, {"z": (z0 or 0, z1 or 0), "y": (0, 7), "x": (0, 7)})


RING = "ring AS (SELECT a, b FROM range(-4, 5) ta(a), range(-4, 5) tb(b) WHERE abs(a) + abs(b) {op} 4)"


@query(w("spots") + ", " + RING.format(op="=") + " SELECT spot_id, z, y + a AS y, x + b AS x FROM spots, ring WHERE y + a BETWEEN 0 AND 63 AND x + b BETWEEN 0 AND 63")
def diamond_ring(spark, d):
    return raster.diamond(ad.spots(spark, d), 4, (64, 64))


@query(w("spots") + ", " + RING.format(op="<=") + " SELECT z, y + a AS y, x + b AS x, max(spot_id) AS spot_id FROM spots, ring WHERE y + a BETWEEN 0 AND 63 AND x + b BETWEEN 0 AND 63 GROUP BY 1, 2, 3")
def spot_raster(spark, d):
    return raster.rasterise(raster.diamond(ad.spots(spark, d), 4, (64, 64), filled=True))


# ---- cells ----------------------------------------------------------------------------------------------------------


@query(w("cell_px") + " SELECT image_id, plane, y, x, label, d2 FROM cell_px")
def expand_labels(spark, d):
    return ad.cell_px(spark, d).withColumn("d2", F.col("d2").cast("long"))


def _assigned(spark, d):
    px = ad.cell_px(spark, d)
    return px, sp.assign(ad.placed_spots(spark, d), px)


@query(w("assigned") + " SELECT spot_id, image_id, plane, label FROM assigned")
def assign_spots(spark, d):
    return _assigned(spark, d)[1].select("spot_id", "image_id", "plane", "label")


@query(w("counts") + " SELECT image_id, plane, label, n, round(intensity, 6) AS intensity FROM counts")
def cell_counts(spark, d):
    px, a = _assigned(spark, d)
    return rounded(sp.cell_counts(a, px), "intensity")


@query(w("counts") + " SELECT g.image_id, g.plane, g.l AS label, coalesce(c.n, 0) AS n FROM (SELECT image_id, plane, unnest(range(1, m + 1)) AS l FROM (SELECT image_id, plane, max(label) AS m FROM cell_px GROUP BY ALL)) g LEFT JOIN counts c ON c.image_id = g.image_id AND c.plane = g.plane AND c.label = g.l")
def label_outer_counts(spark, d):
    px, a = _assigned(spark, d)
    return sp.outer_counts(sp.cell_counts(a, px), px)


@query(w("assigned") + ", p AS (SELECT *, 100 * intensity / max(intensity) OVER (PARTITION BY image_id) AS pct FROM assigned) SELECT l.image_id, l.plane, l.label, round(coalesce(pct, 0), 6) AS intensity FROM (SELECT DISTINCT image_id, plane, label FROM cell_px) l LEFT JOIN (SELECT image_id, plane, label, sum(pct) AS pct FROM p WHERE label > 0 GROUP BY ALL) USING (image_id, plane, label)")
def normalised_per_label(spark, d):
    px, a = _assigned(spark, d)
    pct = sp.percent_of_max(a).drop("intensity").withColumnRenamed("pct", "intensity")
    return rounded(sp.cell_counts(pct, px).drop("n"), "intensity")


@query(w("assigned") + " SELECT image_id, plane, count(*) FILTER (label = 0) AS background, count(*) FILTER (label > 0) AS assigned FROM assigned GROUP BY ALL")
def background_counts(spark, d):
    return sp.background_counts(_assigned(spark, d)[1])


@query(w("counts") + " SELECT p.image_id, p.plane, p.y, p.x, p.label, c.n, round(c.intensity, 6) AS intensity FROM cell_px p JOIN counts c USING (image_id, plane, label)")
def zonal_map(spark, d):
    px, a = _assigned(spark, d)
    return rounded(sp.zonal_map(px, sp.cell_counts(a, px)).select("image_id", "plane", "y", "x", "label", "n", "intensity"), "intensity")


@query(w("counts") + " SELECT image_id, plane, label, n, CASE WHEN n > 0 THEN sum((n > 0)::INT) OVER (PARTITION BY image_id, plane ORDER BY label) ELSE 0 END::BIGINT AS new_label FROM counts")
def positive_relabel(spark, d):
    px, a = _assigned(spark, d)
    return sp.positive_relabel(sp.cell_counts(a, px)).select("image_id", "plane", "label", "n", "new_label")


@query(w("cell_px") + """, t AS (SELECT image_id, plane, y, x, label FROM cell_px WHERE d2 <= 16), nt AS (SELECT image_id, plane, label, count(*) AS n FROM t GROUP BY ALL),
nf AS (SELECT image_id, plane, label, count(*) AS n FROM cell_px GROUP BY ALL), c AS (SELECT image_id, plane, t.label AS a, f.label AS b, count(*) AS c FROM t JOIN cell_px f USING (image_id, plane, y, x) GROUP BY ALL)
SELECT nt.image_id, nt.plane, nt.label, round(coalesce(max(c / (nt.n + nf.n - c)), 0), 9) AS iou FROM nt LEFT JOIN c ON c.image_id = nt.image_id AND c.plane = nt.plane AND c.a = nt.label
LEFT JOIN nf ON nf.image_id = c.image_id AND nf.plane = c.plane AND nf.label = c.b GROUP BY 1, 2, 3""")
def label_iou(spark, d):
    px = ad.cell_px(spark, d)
    return sp.best_overlap(px.where("d2 <= 16"), px).withColumn("iou", F.round("iou", 9))


@query(w("cell_px") + ", b AS (SELECT image_id, plane, label, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM cell_px GROUP BY ALL) SELECT image_id, plane, median(h) AS median_h, median(w) AS median_w, count(*) AS n_labels FROM b GROUP BY ALL")
def label_extents(spark, d):
    return sp.label_extents(ad.cell_px(spark, d))


@query(w("spots", "cell_px") + " SELECT p.image_id, p.plane, s.plane IS NOT NULL AS has_spots, p.n, coalesce(t.top >= p.plane, false) AS inside FROM (SELECT image_id, plane, count(DISTINCT label) AS n FROM cell_px GROUP BY ALL) p LEFT JOIN (SELECT DISTINCT image_id, plane FROM spots) s USING (image_id, plane) LEFT JOIN (SELECT image_id, max(plane) AS top FROM spots GROUP BY image_id) t ON t.image_id = p.image_id")
def shape_check(spark, d):
    px = ad.cell_px(spark, d).groupBy("image_id", "plane").agg(F.count_distinct("label").alias("n"))
    placed = ad.placed_spots(spark, d)
    s = placed.select("image_id", "plane").distinct().withColumn("here", F.lit(True))
    top = placed.groupBy("image_id").agg(F.max("plane").alias("top"))
    out = px.join(s, ["image_id", "plane"], "left").join(top, "image_id", "left")
    return out.select("image_id", "plane", F.coalesce("here", F.lit(False)).alias("has_spots"), "n", F.coalesce(F.col("top") >= F.col("plane"), F.lit(False)).alias("inside"))


@query(w("cell_px") + " SELECT image_id, plane, count(DISTINCT label) + 1 AS n_with_background, max(label) AS max_label FROM cell_px GROUP BY ALL")
def distinct_labels(spark, d):
    return ad.cell_px(spark, d).groupBy("image_id", "plane").agg((F.count_distinct("label") + 1).alias("n_with_background"), F.max("label").alias("max_label"))


# ---- tiles ----------------------------------------------------------------------------------------------------------

SIZES = "z AS (SELECT s_suppkey AS image, 600 + s_suppkey % 5 * 200 AS ny, 700 + s_nationkey * 40 AS nx FROM supplier)"
TILES = f"{SIZES}, t AS (SELECT image, y0, least(y0 + 512, ny) AS y1, x0, least(x0 + 512, nx) AS x1 FROM (SELECT image, ny, nx, y0, unnest(range(0, nx, 448)) AS x0 FROM (SELECT *, unnest(range(0, ny, 448)) AS y0 FROM z)))"


def _tiles(spark, d):
    s = ad.table(spark, d, "supplier")
    sizes = s.select(F.col("s_suppkey").alias("image"), (600 + F.col("s_suppkey") % 5 * 200).cast("int").alias("ny"), (700 + F.col("s_nationkey") * 40).cast("int").alias("nx"))
    return raster.tile_grid(sizes, 512, 64)


@query(f"WITH {TILES} SELECT * FROM t")
def tile_grid(spark, d):
    return _tiles(spark, d)


@query(f"WITH {TILES}, m AS (SELECT image, y0 * 10000 + x0 AS tile, (y1 - y0 + x1 - x0) % 97 AS max_label FROM t) SELECT *, coalesce(sum(max_label) OVER (PARTITION BY image ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS label_offset FROM m")
def tile_offset(spark, d):
    t = _tiles(spark, d).select("image", (F.col("y0") * 10000 + F.col("x0")).alias("tile"), ((F.col("y1") - F.col("y0") + F.col("x1") - F.col("x0")) % 97).alias("max_label"))
    return raster.tile_offsets(t)


@query(w("cell_px") + ", o AS (SELECT image_id, plane, y, x, label FROM cell_px UNION ALL SELECT image_id, plane, y, x, label + 10 FROM cell_px WHERE x % 448 < 8) SELECT image_id, plane, y, x, max(label) AS label FROM o GROUP BY ALL")
def tile_merge(spark, d):
    px = ad.cell_px(spark, d).select("image_id", "plane", "y", "x", "label")
    return raster.tile_merge(px.unionByName(px.where("x % 448 < 8").withColumn("label", F.col("label") + 10)))


# ---- samples and positions ------------------------------------------------------------------------------------------

HASH = "(event_id * 7919 + 104729) % 1000003"


@query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {HASH}, event_id) - 1 AS rn, count(*) OVER () AS n FROM events) WHERE rn < ceil(n * 0.1)")
def sample_planes(spark, d):
    rows = numbered(ad.table(spark, d, "events").select("event_id", F.expr(HASH).alias("h")), ["h", "event_id"])
    return rows.join(F.broadcast(rows.agg(F.ceil(F.count("*") * 0.1).alias("m")))).where("rn < m").select("event_id")


@query(f"SELECT event_id, rn < greatest(1, round(0.15 * n)) AS validation FROM (SELECT event_id, row_number() OVER (ORDER BY {HASH}, event_id) - 1 AS rn, count(*) OVER () AS n FROM events)")
def train_val_split(spark, d):
    rows = numbered(ad.table(spark, d, "events").select("event_id", F.expr(HASH).alias("h")), ["h", "event_id"])
    size = F.broadcast(rows.agg(F.greatest(F.lit(1.0), F.round(F.count("*") * 0.15)).alias("m")))
    return rows.join(size).select("event_id", (F.col("rn") < F.col("m")).alias("validation"))


@query(f"SELECT event_id FROM events WHERE {HASH} % 1000000 < 50000")
def qc_sample(spark, d):
    return ad.table(spark, d, "events").where(F.expr(HASH) % 1000000 < 50000).select("event_id")


@query("SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) WHERE rn > 3")
def slice_skip(spark, d):
    return numbered(ad.table(spark, d, "events").select("event_id", "value", "ts"), ["ts", "event_id"]).where("rn >= 3").select("event_id", "value")


# ---- array files ----------------------------------------------------------------------------------------------------


@query("SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row, unnest([0, 1, 2])::BIGINT AS col, unnest([event_id % 40, event_id * 7 % 64, user_id % 64])::DOUBLE AS value FROM events")
def npy_round_trip(spark, d):
    from fluorite.sources import arrays

    written = stage(arrays.spots_npy(ad.spots(spark, d), "channel", rows_per_file=10_000))
    rows = arrays.array_rows(written).join(written.select("path", "first_row"), "path")
    return rows.select(F.substring_index("path", "/", 1).alias("channel"), (F.col("row") + F.col("first_row")).alias("row"), "col", "value")


@query(w("img") + " SELECT (z // 50)::VARCHAR AS path, z - min(z) OVER (PARTITION BY z // 50) AS z, y, x, v FROM img")
def tiff_round_trip(spark, d):
    from fluorite.sources import arrays

    i = ad.img(spark, d).withColumn("stack", F.floor(F.col("z") / 50).cast("long"))
    return arrays.tiff_rows(arrays.stack_tiff(i, "stack"))


# ---- fits, samples and whole analyses -------------------------------------------------------------------------------


@query()
def gaussian_fit(spark, d):
    from fluorite.operators.fitting import gaussian_fit as fit

    i = ad.img(spark, d)
    seeds = raster.extrema(i, 1, 2, 2).withColumn("spot_id", F.col("z") * 64 + F.col("y") * 8 + F.col("x"))
    return fit(i, seeds, min_r2=0.2)


@query(f"WITH {SIZES}, e AS (SELECT image, ny, nx, k, (image * 3 + k) % 1000003 AS h FROM z, range(3) t(k) WHERE ny >= 700 AND nx >= 900), p AS (SELECT image, k, (h * 7921 + 209458) % 1000003 % (ny - 699) AS y0, (h * 7923 + 314187) % 1000003 % (nx - 899) AS x0 FROM e) SELECT image, k, y0, x0, y0 + 700 AS y1, x0 + 900 AS x1 FROM p")
def random_crops(spark, d):
    from fluorite.operators.sampling import random_regions

    s = ad.table(spark, d, "supplier")
    sizes = s.select(F.col("s_suppkey").alias("image"), (600 + F.col("s_suppkey") % 5 * 200).alias("ny"), (700 + F.col("s_nationkey") * 40).alias("nx"))
    return random_regions(sizes, 700, 900, 3)


def _draw_sql(s: int) -> str:
    return f"((z % 1000003) * {7919 + 2 * s} + {104729 * (s + 1)}) % 1000003"


@query(
    w("img")
    + f""", a AS (SELECT z, v, CASE WHEN {_draw_sql(3)} % 2 = 1 THEN 7 - y ELSE y END AS y, CASE WHEN {_draw_sql(4)} % 2 = 1 THEN 7 - x ELSE x END AS x FROM img)
SELECT z, CASE WHEN {_draw_sql(5)} % 2 = 1 THEN x ELSE y END AS y, CASE WHEN {_draw_sql(5)} % 2 = 1 THEN y ELSE x END AS x,
round(v * (0.6 + 1.4 * ({_draw_sql(6)} / 1000003.0::DOUBLE)) + (-0.2 + 0.4 * ({_draw_sql(7)} / 1000003.0::DOUBLE)), 9) AS v FROM a"""
)
def augment_images(spark, d):
    from fluorite.operators.sampling import augment

    return augment(ad.img(spark, d), 8).withColumn("v", F.round("v", 9))


@query("SELECT s_suppkey AS image, round((300 + s_suppkey % 200)::DOUBLE / ((75 + s_nationkey + 75) / 2.0), 9) AS anisotropy FROM supplier")
def anisotropy(spark, d):
    s = ad.table(spark, d, "supplier")
    ratio = (300 + F.col("s_suppkey") % 200) / ((75 + F.col("s_nationkey") + 75) / F.lit(2.0))
    return s.select(F.col("s_suppkey").alias("image"), F.round(ratio, 9).alias("anisotropy"))


@query(w("cells") + " SELECT grp, printf('%s: n=%d, mean=%.2f', grp, count(*), round(avg(n), 2)) AS shown, printf('%.4f, %.4e, %.5f', round(avg(n), 3), round(avg(n), 3), round(avg(n), 3)) AS digits, lpad(count(*)::VARCHAR, 8, '0') AS padded FROM cells GROUP BY grp")
def formatted_summary(spark, d):
    g = ad.cells(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("n"), 2).alias("m"), F.round(F.avg("n"), 3).alias("m3"))
    return g.select("grp", F.format_string("%s: n=%d, mean=%.2f", "grp", "n", "m").alias("shown"), F.format_string("%.4f, %.4e, %.5f", "m3", "m3", "m3").alias("digits"), F.lpad(F.col("n").cast("string"), 8, "0").alias("padded"))


LOG_SQL = w("img") + f", {SMOOTH}" + """, lg AS (SELECT z, y, x, round(v, 8) AS v FROM (SELECT c.z, c.y, c.x, 2 * (9 * any_value(c.v) - sum(n.v)) AS v
FROM gx c JOIN gx n ON n.z = c.z AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY ALL)),
pk AS (""" + _extrema_sql("max", "v > 0").replace("FROM img)", "FROM lg)") + """),
lv AS (SELECT quantile_cont(v, 0.999) AS level FROM lg WHERE v > 0)"""


@query(LOG_SQL + " SELECT z, y, x, v AS peak FROM pk, lv WHERE v >= level")
def detect_spots(spark, d):
    from fluorite.functions.config import Settings
    from fluorite.plans.pipelines import detect

    settings = Settings(kernel_size=(0.0, 1.0, 1.0), minimal_distance=(1, 2, 2), max_levels=4)
    return detect(ad.img(spark, d), settings, digits=8, automatic="quantile").select("z", "y", "x", "peak")


@query(w("counts") + ", r AS (SELECT image_id, plane, label, n, row_number() OVER (PARTITION BY image_id, plane ORDER BY label) AS new_label FROM counts WHERE n > 0) SELECT p.image_id, p.plane, p.y, p.x, r.new_label AS label, r.n FROM cell_px p JOIN r USING (image_id, plane, label)")
def counterstain_positive(spark, d):
    from fluorite.plans.pipelines import counterstain

    px, a = _assigned(spark, d)
    return counterstain(px, sp.cell_counts(a, px))


@query()
def cohort_tests(spark, d):
    from fluorite.plans.pipelines import cohort_tests as tests

    return tests(ad.cells(spark, d), pairs_table(spark), "grp", "inten")


@query(
    w("img")
    + """, g AS (SELECT d, e / sum(e) OVER () AS w, e / sum(e) OVER () * (d * d - 1) AS w2 FROM (SELECT d, exp(-0.5 * d ^ 2) AS e FROM range(-4, 5) t(d))),
m AS (SELECT o, d, CASE WHEN k < 8 THEN k ELSE 15 - k END AS i, w, w2 FROM (SELECT o, d, w, w2, (o + d + 16) % 16 AS k FROM range(8) t(o), g)),
p AS (SELECT i.z, y.o AS y, x.o AS x, sum(v * (y.w2 * x.w + y.w * x.w2)) AS v FROM img i JOIN m y ON y.i = i.y JOIN m x ON x.i = i.x GROUP BY ALL)
SELECT z, y, x, round(greatest(-v, 0), 8) + 0.0 AS v FROM p"""
)
def log_filter(spark, d):
    out = raster.log_filter(ad.img(spark, d), {"y": 1.0, "x": 1.0}, {"y": (0, 7), "x": (0, 7)})
    return out.withColumn("v", F.round("v", 8) + F.lit(0.0))


@query()
def decompose_dense(spark, d):
    from fluorite.operators.dense import decompose

    i = stage(ad.stacks(spark, d))
    seeds = stage(numbered(raster.extrema(i, 1, 2, 2), ["image_id", "z", "y", "x"], "spot_id"))
    return decompose(i, seeds, {"z": 0.8, "y": 1.0, "x": 1.0})[0]


@query(w("cell_px", "nuclei", "spots") + """, b AS (SELECT p.image_id, p.plane, p.y, p.x, p.label, n.label AS nucleus FROM cell_px p LEFT JOIN nuclei n USING (image_id, plane, y, x)),
s AS (SELECT b.image_id, b.plane, b.label, count(*) AS n_spots, count(*) FILTER (nucleus IS NOT NULL) AS n_nuclear FROM spots JOIN b USING (image_id, plane, y, x) GROUP BY ALL),
a AS (SELECT image_id, plane, label, count(*) AS cell_area, count(nucleus) AS nucleus_area, count(DISTINCT nucleus) AS n_nuclei, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM b GROUP BY ALL)
SELECT a.*, coalesce(n_spots, 0) AS n_spots, coalesce(n_nuclear, 0) AS n_nuclear FROM a LEFT JOIN s USING (image_id, plane, label)""")
def extract_cells(spark, d):
    from fluorite.operators.shapes import extract_cells as extract

    return extract(ad.cell_px(spark, d), ad.nuclei(spark, d), ad.placed_spots(spark, d))


@query(w("spots") + """, t AS (SELECT channel, z, quantile_cont(intensity, 0.999) AS threshold FROM spots GROUP BY ALL)
SELECT channel, count(*) AS n_images, round(avg(threshold), 6) AS mean_threshold, round(quantile_cont(threshold, 0.5), 6) AS median_threshold FROM t GROUP BY channel""")
def threshold_survey(spark, d):
    t = percentiles(ad.spots(spark, d), "intensity", [0.999], ["channel", "z"]).select("channel", "z", F.get("q", F.lit(0)).alias("threshold"))
    middle = percentiles(t, "threshold", [0.5], ["channel"]).select("channel", r6(F.get("q", F.lit(0))).alias("median_threshold"))
    return t.groupBy("channel").agg(F.count("*").alias("n_images"), r6(F.avg("threshold")).alias("mean_threshold")).join(middle, "channel")


@query("SELECT p.part, p.p_partkey AS image, q.s_suppkey AS mask FROM (SELECT p_partkey % 10 AS part, p_partkey, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_name, p_partkey) AS r FROM part) p JOIN (SELECT s_suppkey % 10 AS part, s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_name) AS r FROM supplier) q ON p.part = q.part AND p.r = q.r")
def paired_by_order(spark, d):
    images = ad.table(spark, d, "part").select((F.col("p_partkey") % 10).alias("part"), F.col("p_partkey").alias("image"), F.col("p_name").alias("k"))
    masks = ad.table(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("part"), F.col("s_suppkey").alias("mask"), F.col("s_name").alias("k"))
    a, b = numbered(images, ["k", "image"], "r", ["part"]), numbered(masks, ["k", "mask"], "r", ["part"])
    return a.select("part", "image", "r").join(b.select("part", "mask", "r"), ["part", "r"]).select("part", "image", "mask")


# ---- several stacks, controls and the second detector --------------------------------------------------------------


STACK_MAXIMA = _extrema_sql("max", "v > 0").replace("FROM img)", "FROM stacks)").replace("PARTITION BY ", "PARTITION BY image_id, ").replace("SELECT z, y", "SELECT image_id, z, y")


@query(w("stacks") + STACK_MAXIMA)
def stack_maxima(spark, d):
    return raster.extrema(ad.stacks(spark, d), 1, 2, 2)


@query(w("stacks") + " SELECT image_id, z // 10 AS plane, y, x, max(v) AS v FROM stacks GROUP BY ALL")
def stack_projection(spark, d):
    return raster.project_grouped(ad.stacks(spark, d), 10)


STACK_RESPONSE = w("stacks", recursive=True) + """, k AS (SELECT d, exp(-0.5 * d ^ 2) / sum(exp(-0.5 * d ^ 2)) OVER () AS w FROM range(-3, 4) t(d)),
gy AS (SELECT image_id, z, y + d AS y, x, sum(v * w) AS v FROM stacks, k WHERE y + d BETWEEN 0 AND 7 GROUP BY ALL),
gx AS (SELECT image_id, z, y, x + d AS x, sum(v * w) AS v FROM gy, k WHERE x + d BETWEEN 0 AND 7 GROUP BY ALL),
lg AS (SELECT image_id, z, y, x, round(v, 8) AS v FROM (SELECT c.image_id, c.z, c.y, c.x, 2 * (9 * any_value(c.v) - sum(n.v)) AS v
  FROM gx c JOIN gx n ON n.image_id = c.image_id AND n.z = c.z AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY ALL))"""
RESPONSE_MAXIMA = STACK_MAXIMA.replace("FROM stacks)", "FROM lg)")
STACK_SETTINGS = {"kernel_size": (0.0, 1.0, 1.0), "minimal_distance": (1, 2, 2), "max_levels": 4}


def _settings():
    from fluorite.functions.config import Settings

    return Settings(**STACK_SETTINGS)


@query(STACK_RESPONSE + f", pk AS ({RESPONSE_MAXIMA}), lv AS (SELECT image_id, quantile_cont(v, 0.999) AS level FROM lg WHERE v > 0 GROUP BY image_id) SELECT image_id, z, y, x, v AS peak FROM pk JOIN lv USING (image_id) WHERE v >= level")
def stack_detect(spark, d):
    from fluorite.plans.pipelines import detect

    return detect(ad.stacks(spark, d), _settings(), digits=8, automatic="quantile").select("image_id", "z", "y", "x", "peak")


@query(STACK_RESPONSE + f", pk AS ({RESPONSE_MAXIMA}) SELECT image_id, z, y, x, v AS peak, row_number() OVER (ORDER BY image_id, z, y, x) - 1 AS spot_id FROM pk")
def control_spots(spark, d):
    from fluorite.plans.pipelines import control_spots as found

    return found(ad.stacks(spark, d), _settings(), 8)[0].select("image_id", "z", "y", "x", "peak", "spot_id")


@query(STACK_RESPONSE + f", pk AS ({RESPONSE_MAXIMA}) SELECT row_number() OVER (ORDER BY image_id, z, y, x) - 1 AS spot_id, v AS peak FROM pk")
def control_peaks(spark, d):
    from fluorite.plans.pipelines import control_peaks as peaks

    return peaks(ad.stacks(spark, d), _settings(), 8)


@query(
    STACK_RESPONSE + f", pk AS ({RESPONSE_MAXIMA})" + """, seed AS (SELECT row_number() OVER (ORDER BY image_id, z, y, x) - 1 AS spot_id, * FROM pk),
step AS (SELECT * FROM (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) t(dz, dy, dx)),
f AS (SELECT spot_id, image_id, z, y, x, v, 0 AS level FROM seed UNION SELECT f.spot_id, i.image_id, i.z, i.y, i.x, i.v, f.level + 1 FROM f, step JOIN lg i ON i.image_id = f.image_id AND i.z = f.z + dz AND i.y = f.y + dy AND i.x = f.x + dx WHERE f.level < 4 AND i.v > 0 AND f.v >= i.v),
t AS (SELECT spot_id, count(*) AS n_voxels, sum(v) AS total FROM (SELECT spot_id, z, y, x, any_value(v) AS v FROM f GROUP BY ALL) GROUP BY spot_id)
SELECT s.spot_id, s.image_id, s.z, s.y, s.x, s.v AS peak, round(t.total, 8) AS total, t.n_voxels FROM seed s JOIN t USING (spot_id)"""
)
def control_intensities(spark, d):
    from fluorite.plans.pipelines import control_intensities as found

    return found(ad.stacks(spark, d), _settings(), 8, max_levels=4).withColumn("total", F.round("total", 8))


MINIMA = _extrema_sql("min", "v < 0").replace("FROM img)", "FROM cut)").replace("PARTITION BY ", "PARTITION BY image_id, ").replace("SELECT z, y", "SELECT image_id, z, y")


@query(STACK_RESPONSE + f""", ng AS (SELECT image_id, z, y, x, -v AS v FROM lg), lv AS (SELECT image_id, quantile_cont(v, 0.6) AS level FROM ng WHERE v < 0 GROUP BY image_id),
cut AS (SELECT image_id, z, y, x, CASE WHEN v <= level THEN v ELSE 0 END AS v FROM ng JOIN lv USING (image_id)) SELECT image_id, z, y, x, v AS peak FROM ({MINIMA})""")
def minima_detect(spark, d):
    from fluorite.plans.pipelines import detect_minima

    return detect_minima(ad.stacks(spark, d), _settings(), share=0.6, fit_radius=None, digits=8).select("image_id", "z", "y", "x", "peak")


@query()
def minima_fit(spark, d):
    from fluorite.plans.pipelines import detect_minima

    return detect_minima(ad.stacks(spark, d), _settings(), min_r2=0.2).select("image_id", "spot_id", "z", "y", "x", "peak", "total", "r2")


@query(
    w("cells") + f", {PAIRS_SQL}, c AS (SELECT grp || '_' || rep AS name, n FROM cells), " + """m AS (SELECT g, count(*) AS n, avg(n) AS m, var_samp(n) AS v FROM (SELECT DISTINCT a AS g FROM pairs UNION SELECT b FROM pairs) JOIN c ON starts_with(name, g) GROUP BY g)
SELECT p.a || ' vs ' || p.b AS comparison, x.n AS n1, y.n AS n2, round((x.m - y.m) / sqrt(x.v / x.n + y.v / y.n), 6) AS t_stat FROM pairs p JOIN m x ON x.g = p.a JOIN m y ON y.g = p.b"""
)
def prefix_welch(spark, d):
    named = ad.cells(spark, d).withColumn("name", F.concat_ws("_", "grp", "rep"))
    conditions = sorted({c for pair in PAIRS for c in pair})
    return rounded(cohort.welch(cohort.by_prefix(named, conditions, "name"), pairs_table(spark), "name", "n"), "t_stat").drop("df")


# ---- outlines, volumes, noise and the older flood rule ----------------------------------------------------------------

RAY_COUNTS = (4, 8, 16, 32, 64, 128)


@query(
    w("cell_px") + """, ray AS (SELECT n, k, round(sin(2 * pi() * k / n), 12) AS dy, round(cos(2 * pi() * k / n), 12) AS dx FROM (SELECT n, unnest(range(n)) AS k FROM (SELECT unnest([4, 8, 16, 32, 64, 128]) AS n))),
ctr AS (SELECT image_id, plane, label, floor(avg(y) + 0.5)::BIGINT AS cy, floor(avg(x) + 0.5)::BIGINT AS cx, max(y) - min(y) + max(x) - min(x) + 2 AS reach FROM cell_px GROUP BY ALL),
walk AS (SELECT image_id, plane, label, cy, cx, n, k, dy, dx, unnest(range(reach + 1)) AS s FROM ctr, ray),
len AS (SELECT w.image_id, w.plane, w.label, w.cy, w.cx, w.n, w.k, w.dy, w.dx, greatest(min(s) FILTER (p.label IS NULL) - 1 + 0.5 / any_value(greatest(abs(dy), abs(dx))), 0) AS d FROM walk w LEFT JOIN cell_px p
  ON p.image_id = w.image_id AND p.plane = w.plane AND p.label = w.label AND p.y = floor(cy + s * dy + 0.5)::BIGINT AND p.x = floor(cx + s * dx + 0.5)::BIGINT GROUP BY ALL),
tri AS (SELECT a.image_id, a.plane, a.label, a.cy, a.cx, a.n, greatest(a.d, b.d) AS far, a.d * a.dy AS y1, a.d * a.dx AS x1, b.d * b.dy AS y2, b.d * b.dx AS x2 FROM len a JOIN len b USING (image_id, plane, label, n) WHERE b.k = (a.k + 1) % a.n),
box AS (SELECT *, unnest(range(floor(least(0, x1, x2))::BIGINT, ceil(greatest(0, x1, x2))::BIGINT + 1)) AS px FROM (SELECT *, unnest(range(floor(least(0, y1, y2))::BIGINT, ceil(greatest(0, y1, y2))::BIGINT + 1)) AS py FROM tri)),
rec AS (SELECT n, image_id, plane, cy + py AS y, cx + px AS x, max(label) AS label FROM box WHERE py * py + px * px <= far * far + 1e-9 AND x1 * py - y1 * px >= -1e-9 AND px * y2 - py * x2 >= -1e-9
  AND (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) >= -1e-9 GROUP BY ALL),
nt AS (SELECT image_id, plane, label, count(*) AS c FROM cell_px GROUP BY ALL), nf AS (SELECT n, image_id, plane, label, count(*) AS c FROM rec GROUP BY ALL),
hit AS (SELECT r.n, r.image_id, r.plane, p.label AS a, r.label AS b, count(*) AS c FROM rec r JOIN cell_px p USING (image_id, plane, y, x) GROUP BY ALL),
best AS (SELECT hit.n, hit.image_id, hit.plane, a, max(hit.c / (nt.c + nf.c - hit.c)) AS iou FROM hit JOIN nt ON nt.image_id = hit.image_id AND nt.plane = hit.plane AND nt.label = a
  JOIN nf ON nf.n = hit.n AND nf.image_id = hit.image_id AND nf.plane = hit.plane AND nf.label = b GROUP BY ALL)
SELECT t.n AS n_rays, count(*) AS n_labels, round(avg(coalesce(iou, 0)), 9) AS mean_iou FROM (SELECT nt.*, unnest([4, 8, 16, 32, 64, 128]) AS n FROM nt) t LEFT JOIN best ON best.n = t.n AND best.image_id = t.image_id AND best.plane = t.plane AND best.a = t.label GROUP BY ALL"""
)
def star_iou(spark, d):
    from fluorite.operators.shapes import star_reconstruct

    px = stage(ad.cell_px(spark, d).select("image_id", "plane", "y", "x", "label"))
    found = stage(star_reconstruct(px, RAY_COUNTS))
    truth = px.withColumn("n_rays", F.explode(F.array(*[F.lit(n) for n in RAY_COUNTS])))
    iou = sp.best_overlap(truth, found, ("n_rays", "plane", "y", "x"))
    return iou.groupBy(F.col("n_rays").cast("long").alias("n_rays")).agg(F.count("*").alias("n_labels"), F.round(F.avg("iou"), 9).alias("mean_iou"))


@query("""WITH s AS (SELECT s_suppkey AS image, 10 + s_suppkey % 20 AS nz, 400 + s_suppkey % 5 * 100 AS ny, 500 + s_nationkey * 10 AS nx FROM supplier),
e AS (SELECT image, k, nz, ny, nx, (image * 3 + k) % 1000003 AS h FROM s, range(3) t(k) WHERE nz >= 15 AND ny >= 500 AND nx >= 500),
p AS (SELECT image, k, (h * 7935 + 942561) % 1000003 % (nz - 14) AS z0, (h * 7921 + 209458) % 1000003 % (ny - 499) AS y0, (h * 7923 + 314187) % 1000003 % (nx - 499) AS x0 FROM e)
SELECT image, k, z0, z0 + 15 AS z1, y0, x0, y0 + 500 AS y1, x0 + 500 AS x1 FROM p""")
def random_volumes(spark, d):
    from fluorite.operators.sampling import random_volumes as volumes

    k = F.col("s_suppkey")
    sizes = ad.table(spark, d, "supplier").select(k.alias("image"), (10 + k % 20).alias("nz"), (400 + k % 5 * 100).alias("ny"), (500 + F.col("s_nationkey") * 10).alias("nx"))
    return volumes(sizes, 15, 500, 500, 3)


@query(w("img") + """ SELECT z, y, x, round(v + 0.02 * ((((z % 1000003) * 7941 + 1256748) % 1000003 + 0.5::DOUBLE) / 1000003) * sqrt(-2 * ln(((q * 7937 + 1047290) % 1000003 + 0.5::DOUBLE) / 1000003))
* cos(2 * pi() * (((q * q % 1000003 * 7939 + 1152019) % 1000003 + 0.5::DOUBLE) / 1000003)), 9) AS v FROM (SELECT *, ((z % 1000003) * 64 + y * 8 + x) % 1000003 AS q FROM img)""")
def noisy_images(spark, d):
    from fluorite.operators.sampling import noise

    return noise(ad.img(spark, d), 8).withColumn("v", F.round("v", 9))


@query()
def flood_fill_compat(spark, d):
    i = ad.img(spark, d)
    seeds = raster.extrema(i, 1, 2, 2).withColumn("spot_id", F.col("z") * 64 + F.col("y") * 8 + F.col("x"))
    return raster.flood_fill_compat(i, seeds, FLOOD_LEVELS).select("spot_id", "z", "y", "x", "level")


@query(w("counts") + " SELECT image_id, plane, label, n, round(intensity, 6) AS intensity FROM counts")
def assign_to_cells(spark, d):
    from fluorite.plans.pipelines import assign_to_cells as assign

    spots = ad.placed_spots(spark, d).drop("plane")
    return rounded(assign(spots, ad.seeds(spark, d), 7, 5, (ad.SIDE, ad.SIDE))[0], "intensity")


# ---- tables and files written and read again --------------------------------------------------------------------------


@query(
    w("cells")
    + ", r AS (SELECT grp, inten, row_number() OVER (PARTITION BY grp ORDER BY inten, n, rep) - 1 AS row_idx FROM cells) SELECT "
    + ", ".join(f"max(inten) FILTER (grp = '{g}') AS {g}" for g in GROUPS) + " FROM r GROUP BY row_idx"
)
def wide_csv(spark, d):
    from fluorite.sources import sinks

    path = scratch_dir(spark)
    sinks.write_wide_csv(ad.cells(spark, d), path, "grp", "inten", ["inten", "n", "rep"], GROUPS)
    return sinks.read_wide_csv(spark, path, GROUPS)


@query(w("counts") + " SELECT image_id, plane, label, n FROM counts")
def plane_tables(spark, d):
    from fluorite.sources import sinks

    px, a = _assigned(spark, d)
    path, counts = scratch_dir(spark), stage(sp.cell_counts(a, px).select("image_id", "plane", "label", "n"))
    for _ in range(2):  # results replace what is there
        sinks.write_table(counts, path, ["plane"])
    return spark.read.schema(counts.schema).parquet(path)


@query(w("spots") + " SELECT image_id::VARCHAR AS image, 'plane_' || plane AS member, row_number() OVER (PARTITION BY image_id, plane ORDER BY spot_id) - 1 AS row, intensity AS value FROM spots")
def npz_round_trip(spark, d):
    from fluorite.sources import arrays

    s = ad.placed_spots(spark, d).withColumn("member", F.concat(F.lit("plane_"), F.col("plane").cast("long")))
    return arrays.array_rows(arrays.ragged_npz(s, "image_id", "member", "spot_id", "intensity")).select(F.col("path").alias("image"), "member", "row", "value")


@query("SELECT o_custkey AS image, min(o_orderkey) AS chosen, round(arg_min(o_totalprice, o_orderkey), 2)::DOUBLE AS value FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def read_skipping_broken(spark, d):
    from fluorite.sources import arrays, files

    def write(batches):
        for b in batches:
            raw = [arrays.npy_bytes(np.array([v])) for v in b.column("v").to_pylist()]
            cut = [r[:40] if broken else r for r, broken in zip(raw, b.column("broken").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("image"), b.column("priority"), pa.array(cut, pa.binary())], ["image", "priority", "content"])

    o = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("priority"), F.col("o_totalprice").cast("double").alias("v"), (F.col("o_orderstatus") == "F").alias("broken"))
    made = o.mapInArrow(write, "image long, priority long, content binary")
    best = files.first_available(arrays.readable(made), "image", ["priority"])
    rows = arrays.array_rows(best, "image")
    return best.select("image", F.col("priority").alias("chosen")).join(rows.select(F.col("path").cast("long").alias("image"), F.round("value", 2).alias("value")), "image")


@query("SELECT c_nationkey::BIGINT AS image, row_number() OVER (ORDER BY c_nationkey::VARCHAR) - 1 AS position, count(*) AS n_thresholds, round(avg(round(c_acctbal, 2)), 6)::DOUBLE AS mean_threshold FROM customer WHERE c_acctbal >= 0 GROUP BY c_nationkey")
def scan_sidecars(spark, d):
    from fluorite.sources import files

    root = scratch_dir(spark)
    c = ad.table(spark, d, "customer").where("c_acctbal >= 0")
    text = F.concat(F.lit("dtype: uint16\nthreshold: "), F.col("c_acctbal").cast("decimal(20,2)").cast("string"))
    c.select(F.col("c_nationkey").alias("image"), text.alias("value")).repartition("image").write.partitionBy("image").text(root)
    found = files.find(spark, root, "*.txt").select(F.lit(0).alias("folder"), F.substring_index("path", "/image=", -1).alias("path"))
    image = F.regexp_extract("path", "^([0-9]+)/", 1).cast("long").alias("image")
    listed = files.planes(found, "folder", "path").select(image, F.col("plane").cast("long").alias("position"))
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select(F.substring_index("_metadata.file_path", "/image=", -1).alias("path"), "value")
    held = files.thresholds(lines).groupBy(image).agg(F.count("*").alias("n_thresholds"), r6(F.avg("threshold")).alias("mean_threshold"))
    return listed.join(held, "image")


@query(
    w("cells") + """, p AS (SELECT DISTINCT rep, regexp_extract(grp, '_([0-9]+)h', 1) AS h, regexp_extract(grp, '^([A-Za-z]+)_', 1) AS injury FROM cells),
f AS (SELECT h::INT AS hours, injury, rep::INT AS image, k, '/exp/' || h || 'hr_' || injury || '/Image' || rep || '/565/results/' || l || '/' AS folder, 'label_' || lpad(k::VARCHAR, 3, '0') || '.tif' AS name FROM p, range(3) t(k), (VALUES ('nuclei'), ('cells'), ('counterstain')) u(l))
SELECT folder || name AS path, hours, injury, image, '565' AS channel, row_number() OVER (PARTITION BY folder ORDER BY name) - 1 AS plane FROM f"""
)
def label_planes(spark, d):
    from fluorite.sources import files

    h, injury = F.regexp_extract("grp", "_([0-9]+)h", 1), F.regexp_extract("grp", "^([A-Za-z]+)_", 1)
    made = ad.cells(spark, d).select("rep", h.alias("h"), injury.alias("injury")).distinct()
    folders = F.explode(F.array(*[F.lit(x) for x in ("nuclei", "cells", "counterstain")]))
    names = F.explode(F.array(*[F.lit(f"{a}_{k:03}.tif") for k in range(3) for a in ("label", "stacked", "max_projection")]))
    made = made.withColumn("l", folders).withColumn("name", names)
    path = F.concat(F.lit("/exp/"), "h", F.lit("hr_"), "injury", F.lit("/Image"), "rep", F.lit("/565/results/"), "l", F.lit("/"), "name")
    kept = files.label_images(made.select(path.alias("path"))).withColumns(files.path_columns(F.col("path")))
    planes = files.planes(kept.withColumn("folder", F.regexp_replace("path", "[^/]+$", "")), "folder", "path")
    return planes.drop("folder").withColumn("plane", F.col("plane").cast("long"))


@query("SELECT s_suppkey AS image, 300.0::DOUBLE + s_suppkey % 200 AS voxel_z, round((300 + s_suppkey % 200) / 75.0::DOUBLE, 9) AS anisotropy, CASE WHEN s_nationkey % 2 = 0 THEN round(s_acctbal, 2)::DOUBLE END AS threshold, 1::BIGINT AS n_unknown FROM supplier")
def settings_of_files(spark, d):
    from fluorite.functions.config import from_text

    def parse(batches):
        for b in batches:
            own = [from_text(t) for t in b.column("text").to_pylist()]
            cols = [[float(s.voxel_size[0]) for s in own], [s.anisotropy for s in own], [s.experiment_threshold for s in own], [len(s.unknown) for s in own]]
            kinds = [pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("image"), *map(pa.array, cols, kinds)], ["image", "voxel_z", "anisotropy", "threshold", "n_unknown"])

    given = F.when(F.col("s_nationkey") % 2 == 0, F.col("s_acctbal").cast("decimal(20,2)").cast("string")).otherwise("null")
    text = F.concat(F.lit("voxel_size: [1, 75, 75]\nuse_gpu: false\nvoxel_size: ["), 300 + F.col("s_suppkey") % 200, F.lit(", 75, 75]\nexperimentThreshold: "), given)
    rows = ad.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("image"), text.alias("text"))
    return rounded(rows.mapInArrow(parse, "image long, voxel_z double, anisotropy double, threshold double, n_unknown long").withColumn("anisotropy", F.round("anisotropy", 9)), "threshold")


# ---- automatic thresholds, controls, and all stages of a run ---------------------------------------------------------

KNEE_SQL = """top AS (SELECT image_id, max(v) AS t FROM pk WHERE v > 0 GROUP BY image_id),
bin AS (SELECT image_id, least(floor(v / t * 100), 99)::BIGINT AS k, count(*) AS c FROM pk JOIN top USING (image_id) WHERE v > 0 GROUP BY ALL),
curve AS (SELECT image_id, t, k, ln(sum(coalesce(c, 0)) OVER (PARTITION BY image_id ORDER BY k DESC)) AS y FROM (SELECT image_id, t, unnest(range(100)) AS k FROM top) LEFT JOIN bin USING (image_id, k)),
above AS (SELECT image_id, k, round(y - (first + (last - first) * k / 99), 9) AS d FROM curve JOIN (SELECT image_id, arg_min(y, k) AS first, arg_max(y, k) AS last FROM curve GROUP BY image_id) USING (image_id)),
shoulder AS (SELECT image_id, CASE WHEN e >= 3 THEN e ELSE 99 END AS e FROM (SELECT image_id, arg_max(k, (d, -k)) AS e FROM above GROUP BY image_id)),
cut AS (SELECT curve.*, e FROM curve JOIN shoulder USING (image_id) WHERE k <= e),
tried AS (SELECT image_id, b, t, round(sum(err), 9) AS e FROM (SELECT image_id, t, b, regr_syy(y, k) - regr_sxy(y, k) ^ 2 / regr_sxx(y, k) AS err FROM cut, range(2, 99) r(b) WHERE b < e GROUP BY image_id, t, b, k < b) GROUP BY ALL),
knee AS (SELECT image_id, arg_min(t * b / 100, (e, b)) AS threshold FROM tried GROUP BY image_id)"""


@query(STACK_RESPONSE + f", pk AS ({RESPONSE_MAXIMA}), {KNEE_SQL} SELECT image_id, round(threshold, 9) AS threshold FROM knee")
def knee_threshold(spark, d):
    from fluorite.plans.pipelines import _response

    response = stage(_response(ad.stacks(spark, d), _settings(), 8))
    return sp.knee_threshold(raster.extrema(response, 1, 2, 2)).withColumn("threshold", F.round("threshold", 9))


@query(STACK_RESPONSE + f", pk AS ({RESPONSE_MAXIMA}), {KNEE_SQL} SELECT image_id, z, y, x, v AS peak FROM pk JOIN knee USING (image_id) WHERE v >= threshold")
def knee_detect(spark, d):
    from fluorite.plans.pipelines import detect

    return detect(ad.stacks(spark, d), _settings(), digits=8).select("image_id", "z", "y", "x", "peak")


COHORTS = ("control", "experiment", "counterstain", "counterstain_control")


@query(STACK_RESPONSE + f", pk AS ({RESPONSE_MAXIMA}), {KNEE_SQL} SELECT {list(COHORTS)}[image_id % 4 + 1] AS cohort, count(*) AS n_images, round(avg(threshold), 9) AS mean_threshold, round(quantile_cont(threshold, 0.5), 9) AS median_threshold, round(min(threshold), 9) AS least, round(max(threshold), 9) AS most FROM knee GROUP BY ALL")
def cohort_threshold_survey(spark, d):
    from fluorite.plans.pipelines import threshold_survey as survey

    images = ad.stacks(spark, d)
    cohorts = images.select("image_id").distinct().withColumn("cohort", F.element_at(F.array(*map(F.lit, COHORTS)), (F.col("image_id") % 4 + 1).cast("int")))
    out = survey(images, cohorts, _settings(), 8)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_threshold", "median_threshold", "least", "most")})


#: The control is the same stacks at half the brightness, with image numbers below 0 in SQL.
CONTROL_RUN = (STACK_RESPONSE.replace("), k AS (SELECT d", "), bothstacks AS (SELECT * FROM stacks UNION ALL SELECT -1 - image_id, z, y, x, v / 2 FROM stacks), k AS (SELECT d", 1).replace("FROM stacks, k", "FROM bothstacks, k")
    + f", pk AS ({RESPONSE_MAXIMA}), lv AS (SELECT quantile_cont(v, 0.99) AS level FROM pk WHERE image_id < 0), seed AS (SELECT * FROM pk, lv WHERE image_id < 0 OR v >= level)," + """
step AS (SELECT * FROM (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) t(dz, dy, dx)),
f AS (SELECT image_id AS i, z AS sz, y AS sy, x AS sx, z, y, x, v, 0 AS level FROM seed UNION SELECT f.i, f.sz, f.sy, f.sx, p.z, p.y, p.x, p.v, f.level + 1 FROM f, step JOIN lg p ON p.image_id = f.i AND p.z = f.z + dz AND p.y = f.y + dy AND p.x = f.x + dx WHERE f.level < CASE WHEN f.i < 0 THEN 10 ELSE 4 END AND p.v > 0 AND f.v >= p.v),
own AS (SELECT DISTINCT i, sz, sy, sx, z, y, x, v FROM f),
dim AS (SELECT avg(total) AS m FROM (SELECT sum(v) AS total FROM own WHERE i < 0 GROUP BY i, sz, sy, sx)),
spot AS (SELECT i AS image_id, sz AS z, sy AS y, sx AS x, sum(s.v) AS total, count(*) AS n_voxels, max(own.z) - min(own.z) + 1 AS span_z, max(own.y) - min(own.y) + 1 AS span_y, max(own.x) - min(own.x) + 1 AS span_x
  FROM own JOIN stacks s ON s.image_id = own.i AND s.z = own.z AND s.y = own.y AND s.x = own.x WHERE i >= 0 GROUP BY ALL)""")


@query(CONTROL_RUN + " SELECT image_id, z, y, x, v AS peak, round(total, 8) AS total, n_voxels, span_z, span_y, span_x FROM spot JOIN pk USING (image_id, z, y, x), dim WHERE total >= m")
def controlled_detect(spark, d):
    from fluorite.plans.pipelines import detect

    images = ad.stacks(spark, d)
    out = detect(images, _settings(), control=images.withColumn("v", F.col("v") / 2), digits=8)
    return out.drop("spot_id").withColumn("total", F.round("total", 8))


def _analysis(spark, d, **more):
    from fluorite.functions.config import Settings
    from fluorite.plans.pipelines import analyse

    images = stage(ad.stacks(spark, d))
    return analyse(images, Settings(**STACK_SETTINGS, radius_for_spots=800.0, min_spots_for_clusters=3, **more), control=images.withColumn("v", F.col("v") / 2), digits=8)


ANALYSIS_RUN = CONTROL_RUN + ", bright AS (SELECT spot.* FROM spot, dim WHERE total >= m), " + """pair AS (SELECT a.image_id, a.z, a.y, a.x, b.z AS z2, b.y AS y2, b.x AS x2 FROM bright a JOIN bright b ON a.image_id = b.image_id
  AND ((a.z - b.z) * 361) ^ 2 + ((a.y - b.y) * 75) ^ 2 + ((a.x - b.x) * 75) ^ 2 <= 640000),
core AS (SELECT image_id, z, y, x FROM pair GROUP BY ALL HAVING count(*) >= 3),
reach AS (SELECT image_id, z AS cz, y AS cy, x AS cx, z, y, x FROM core UNION SELECT r.image_id, r.cz, r.cy, r.cx, p.z2, p.y2, p.x2 FROM reach r JOIN pair p ON p.image_id = r.image_id AND p.z = r.z AND p.y = r.y AND p.x = r.x
  JOIN core c ON c.image_id = p.image_id AND c.z = p.z2 AND c.y = p.y2 AND c.x = p.x2),
named AS (SELECT image_id, z, y, x, min((cz, cy, cx)) AS name FROM reach GROUP BY ALL),
clus AS (SELECT p.image_id, p.z, p.y, p.x, min(n.name) AS name FROM pair p JOIN named n ON n.image_id = p.image_id AND n.z = p.z2 AND n.y = p.y2 AND n.x = p.x2 GROUP BY ALL)"""


@query(ANALYSIS_RUN + """, st AS (SELECT 'raw' AS stage, image_id, total FROM spot UNION ALL SELECT 'decomposed', image_id, total FROM spot UNION ALL SELECT 'background_removed', image_id, total FROM bright
  UNION ALL SELECT 'clustered', image_id, total FROM bright JOIN clus USING (image_id, z, y, x))
SELECT i.image_id, s.stage, count(total) AS n, round(avg(total), 6) AS mean_total, round(any_value(level), 8) AS threshold, 'bigint' AS place_type
FROM (SELECT DISTINCT image_id FROM pk WHERE image_id >= 0) i CROSS JOIN (VALUES ('raw'), ('decomposed'), ('background_removed'), ('clustered')) s(stage) CROSS JOIN lv LEFT JOIN st ON st.image_id = i.image_id AND st.stage = s.stage GROUP BY ALL""".replace("round(any_value(level), 8)", "round(level, 8)"))
def run_stages(spark, d):
    return _analysis(spark, d, decomposition=None).stages.withColumns({"mean_total": r6("mean_total"), "threshold": F.round("threshold", 8)})


@query(ANALYSIS_RUN + " SELECT image_id, count(*) AS n_spots, round(avg(z), 6) AS z, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM clus GROUP BY image_id, name")
def run_clusters(spark, d):
    return rounded(_analysis(spark, d, decomposition=None).clusters.drop("cluster"), *"zyx")


@query()
def run_decomposed(spark, d):
    """All stages with decomposition, whose mixtures SQL can't express; the tests plant spots."""
    return _analysis(spark, d, decomposition=(0.7, 1.0, 5.0), spot_size=(300.0, 75.0, 75.0)).stages


# ---- files read in parts --------------------------------------------------------------------------------------------


@query(w("stacks") + " SELECT image_id, z - min(z) OVER (PARTITION BY image_id) AS z, y, x, v FROM stacks")
def tiff_pages(spark, d):
    from fluorite.sources import tiff

    tiff.register(spark)
    root = scratch_dir(spark)
    codecs = F.array(*[F.lit(c) for c in sorted(tiff.COMPRESSIONS)])
    images = ad.stacks(spark, d).withColumn("codec", F.element_at(codecs, (F.col("image_id") % 4 + 1).cast("int")))
    tiff.write_files(tiff.stack_files(images, "image_id", "codec"), root)
    rows = spark.read.format("fluorite_tiff").option("partitionBytes", 1 << 14).load(f"{root}/*.tif")
    return rows.select(F.regexp_extract("path", r"([0-9]+)\.tif$", 1).cast("long").alias("image_id"), "z", "y", "x", "v")


@query("SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row, unnest([0, 1, 2])::BIGINT AS col, unnest([event_id % 40, event_id * 7 % 64, user_id % 64])::DOUBLE AS value FROM events")
def npy_ranges(spark, d):
    from fluorite.sources import arrays, tiff

    tiff.register(spark)
    root = scratch_dir(spark)
    written = stage(arrays.spots_npy(ad.spots(spark, d), "channel"))
    tiff.write_files(written.select("path", "content"), root)
    rows = spark.read.format("fluorite_npy").option("partitionBytes", 1 << 13).load(root)
    found = written.select(F.col("path").alias("of"), "first_row")
    rows = rows.withColumn("of", F.regexp_replace("path", "^.*/([^/]+/[^/]+)$", "$1")).join(found, "of")
    return rows.select(F.split("of", "/")[0].alias("channel"), (F.col("row") + F.col("first_row")).alias("row"), "col", "value")


# ---- labels: tiles with seams, one-to-one matching --------------------------------------------------------------------


@query(w("cell_px", recursive=True) + """, px AS (SELECT image_id, plane, y, x, y * 64 + x AS p FROM cell_px),
near AS (SELECT a.image_id, a.plane, a.p, b.p AS q FROM px a JOIN px b ON a.image_id = b.image_id AND a.plane = b.plane AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach AS (SELECT image_id, plane, p, p AS q FROM px UNION SELECT r.image_id, r.plane, r.p, n.q FROM reach r JOIN near n ON n.image_id = r.image_id AND n.plane = r.plane AND n.p = r.q)
SELECT image_id, plane, p // 64 AS y, p % 64 AS x, min(q) AS name FROM reach GROUP BY ALL""")
def tile_labels(spark, d):
    from fluorite.operators.tiles import label_tiles, threshold_segmenter

    px = ad.cell_px(spark, d).select("image_id", "plane", "y", "x", F.lit(1.0).alias("v"))
    labels = stage(label_tiles(px, threshold_segmenter(1.0), tile=16, overlap=2))
    names = labels.groupBy("image_id", "plane", "label").agg(F.min(F.col("y") * 64 + F.col("x")).alias("name"))
    return labels.join(names, ["image_id", "plane", "label"]).select("image_id", "plane", "y", "x", "name")


@query()
def star_matches(spark, d):
    """One-to-one matches of star-convex outlines; the tests try every assignment of small planes."""
    from fluorite.operators.shapes import star_reconstruct

    px = stage(ad.cell_px(spark, d).select("image_id", "plane", "y", "x", "label"))
    truth = px.withColumn("n_rays", F.explode(F.array(*[F.lit(n) for n in RAY_COUNTS])))
    m = sp.match_labels(truth, stage(star_reconstruct(px, RAY_COUNTS)), ("n_rays", "plane", "y", "x"))
    return m.groupBy(F.col("n_rays").cast("long").alias("n_rays")).agg(F.count("*").alias("n_labels"), F.count("matched").alias("n_matched"), F.round(F.avg("iou"), 9).alias("mean_iou"))


# ---- contents of regions, polygons, order of tests ------------------------------------------------------------------


STACK_SIZES = "sizes AS (SELECT image_id, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM stacks GROUP BY image_id)"


def _stack_sizes(stacks: DataFrame) -> DataFrame:
    return stacks.groupBy("image_id").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "zyx"])


@query(
    w("stacks") + f""", {STACK_SIZES}, e AS (SELECT *, (image_id * 3 + k) % 1000003 AS h FROM sizes, range(3) t(k) WHERE nz >= 15 AND ny >= 5 AND nx >= 6),
b AS (SELECT image_id, k, (h * 7935 + 942561) % 1000003 % (nz - 14) AS z0, (h * 7921 + 209458) % 1000003 % (ny - 4) AS y0, (h * 7923 + 314187) % 1000003 % (nx - 5) AS x0 FROM e)
SELECT image_id, k, z - z0 AS z, y - y0 AS y, x - x0 AS x, v FROM stacks JOIN b USING (image_id) WHERE z BETWEEN z0 AND z0 + 14 AND y BETWEEN y0 AND y0 + 4 AND x BETWEEN x0 AND x0 + 5"""
)
def volume_contents(spark, d):
    from fluorite.operators.sampling import contents
    from fluorite.operators.sampling import random_volumes as volumes

    i = ad.stacks(spark, d)
    return contents(i, volumes(_stack_sizes(i), 15, 5, 6, 3, "image_id"), {"z": 15, "y": 5, "x": 6}, ["image_id"])


@query(
    w("img") + """, sizes AS (SELECT z, max(y) + 1 AS ny, max(x) + 1 AS nx FROM img GROUP BY z), e AS (SELECT *, (z * 2 + k) % 1000003 AS h FROM sizes, range(2) t(k) WHERE ny >= 4 AND nx >= 4),
b AS (SELECT z, k, (h * 7921 + 209458) % 1000003 % (ny - 3) AS y0, (h * 7923 + 314187) % 1000003 % (nx - 3) AS x0 FROM e)
SELECT z, k, y - y0 AS y, x - x0 AS x, v FROM img JOIN b USING (z) WHERE y BETWEEN y0 AND y0 + 3 AND x BETWEEN x0 AND x0 + 3"""
)
def crop_contents(spark, d):
    from fluorite.operators.sampling import contents, random_regions

    i = ad.img(spark, d)
    sizes = i.groupBy("z").agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))
    return contents(i, random_regions(sizes, 4, 4, 2, "z"), {"y": 4, "x": 4}, ["z"])


QC_HASH = "(image_id * 1000003 + z * 7919 + y * 104729 + x * 31) % 1000"


@query(
    w("stacks") + f""", chosen AS (SELECT image_id, z * 64 + y * 8 + x AS spot, z, y, x FROM stacks WHERE v > 0.2 AND {QC_HASH} < 50)
SELECT a.image_id, a.spot, s.z - a.z + 2 AS z, s.y - a.y + 2 AS y, s.x - a.x + 2 AS x, s.v FROM chosen a JOIN stacks s ON s.image_id = a.image_id
AND s.z BETWEEN a.z - 2 AND a.z + 2 AND s.y BETWEEN a.y - 2 AND a.y + 2 AND s.x BETWEEN a.x - 2 AND a.x + 2"""
)
def qc_volumes(spark, d):
    """The surroundings of a twentieth of the bright voxels, for checking by eye."""
    from fluorite.operators.sampling import contents

    i = ad.stacks(spark, d)
    at = i.where("v > 0.2").where(F.expr(QC_HASH) < 50)
    boxes = at.select("image_id", (F.col("z") * 64 + F.col("y") * 8 + F.col("x")).alias("spot"), *[(F.col(a) - 2).alias(f"{a}0") for a in "zyx"])
    return contents(i, boxes, {"z": 5, "y": 5, "x": 5}, ["image_id"], ["spot"])


@query(
    w("cell_px") + """, sides AS (SELECT p.image_id, p.plane, p.label, count(*) AS perimeter FROM cell_px p, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(a, b)
WHERE NOT EXISTS (SELECT 1 FROM cell_px q WHERE q.image_id = p.image_id AND q.plane = p.plane AND q.label = p.label AND q.y = p.y + a AND q.x = p.x + b) GROUP BY ALL),
quads AS (SELECT image_id, plane, label, y + a AS y, x + b AS x, count(*) AS n, min(a) <> max(a) AND min(b) <> max(b) AS slanted FROM cell_px, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(a, b) GROUP BY ALL),
corners AS (SELECT image_id, plane, label, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND slanted THEN 2 ELSE 0 END)::BIGINT AS n_corners,
(sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND slanted THEN 2 ELSE 0 END) / 4)::BIGINT AS parts_less_holes FROM quads GROUP BY ALL)
SELECT image_id, plane, label, n_corners, perimeter, count(*) AS area, parts_less_holes FROM cell_px JOIN sides USING (image_id, plane, label) JOIN corners USING (image_id, plane, label) GROUP BY ALL"""
)
def label_polygons(spark, d):
    from fluorite.operators.polygons import polygons, ring_areas

    found = ring_areas(polygons(ad.cell_px(spark, d).select("image_id", "plane", "y", "x", "label")))
    total = {c: F.sum(c).alias(c) for c in ("n_corners", "perimeter", "area")}
    return found.groupBy("image_id", "plane", "label").agg(*total.values(), F.sum(F.signum("area")).cast("long").alias("parts_less_holes"))


ORDERED_SQL = w("cells") + f", {PAIRS_SQL}, {POOLED.format(v='n')}, " + """run AS (SELECT *, sum(c1 + c2) OVER (PARTITION BY comparison ORDER BY value) - (c1 + c2) + (c1 + c2 + 1) / 2 AS mid FROM pool),
u AS (SELECT comparison, any_value(n1)::DOUBLE AS n1, any_value(n2)::DOUBLE AS n2, sum(mid * c1) - any_value(n1 * (n1 + 1) / 2) AS u, sum(pow(c1 + c2, 3) - (c1 + c2)) AS ties FROM run JOIN size USING (comparison) GROUP BY comparison),
z AS (SELECT comparison, u - n1 * n2 / 2 AS gap, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM u)
"""


@query(ORDERED_SQL + "SELECT comparison, round((-gap - 0.5) / sd, 6) AS z_less, round((abs(gap) - 0.5) / sd, 6) AS z_two_sided FROM z")
def mwu_z(spark, d):
    return rounded(cohort.mann_whitney(ad.cells(spark, d), pairs_table(spark), "grp", "n"), "z_less", "z_two_sided").select("comparison", "z_less", "z_two_sided")


# Fixed value: the normal quantile of 0.975, beyond which two-sided p is below 0.05.
@query(ORDERED_SQL + "SELECT comparison, row_number() OVER (ORDER BY greatest((abs(gap) - 0.5) / sd, 0) DESC, comparison) AS place, CASE WHEN (abs(gap) - 0.5) / sd > 1.959963984540054 THEN 'significant' ELSE 'not significant' END AS label FROM z")
def ordered_tests(spark, d):
    """Comparisons by probability, the smallest first, with their label; SQL has both from z."""
    tests = cohort.mwu_p(cohort.mann_whitney(ad.cells(spark, d), pairs_table(spark), "grp", "n"))
    rows = numbered(tests.withColumn("label", cohort.significance(F.col("p_value"))), ["p_value", "comparison"])
    return rows.select("comparison", (F.col("rn") + 1).alias("place"), "label")


@query(
    w("stacks") + f""", {STACK_SIZES}, masks AS (SELECT image_id, max(z) + 1 AS mz, max(y) + 1 AS my, max(x) + 1 AS mx FROM stacks WHERE v > 0.25 GROUP BY image_id)
SELECT image_id, nz, ny, nx, mz, my, mx, coalesce(nz = mz AND ny = my AND nx = mx, false) AS equal FROM sizes FULL JOIN masks USING (image_id)"""
)
def shape_equality(spark, d):
    i = ad.stacks(spark, d)
    return sp.shapes_match(i, i.where("v > 0.25"))
