"""Centroid clustering on integers with dot products that are kept from round to round.

Each vector's row holds its integer components, its squared length and its exact dot product with every centroid. A round
doesn't multiply anew: where a centroid's component has changed, the products change by the vector's component times that
change, so a round costs what the centroids moved; components that stay cost nothing. Distances follow as
|x|^2 - 2 x.c + |c|^2 in integers, ties go to the smaller number, and no result depends on the order of any sum. Only the
sums of each cluster's components, a row for each cluster, reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorite.llm.common import stage

STATE = "vec_id long, q array<int>, norm long, dots array<long>, cluster int, distance long"


def quantised(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """vec_id and q, the components as floor(scale * x); rows with other counts of components, null or non-finite ones are left out."""
    x = F.col(vector)
    bound = int((2**60 / dims) ** 0.5) // 2
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    ok = vectors.where(F.coalesce((F.size(x) == dims) & finite, F.lit(False)))
    q = F.transform(x, lambda v: F.when(F.abs(v.cast("double") * scale) <= bound, F.floor(v.cast("double") * scale)).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {bound}: distances need more than 64 bits"))).cast("int"))
    return ok.select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("q"))


def _moved(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """``state`` with products, cluster and distance for centroids ``new``; its products are those of ``old``."""
    change = new - old
    parts = [(c, np.flatnonzero(change[c])) for c in range(len(new))]
    length = (new * new).sum(1)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column("q").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int64)
            dots = b.column("dots").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).copy()
            for c, where in parts:
                if len(where):
                    dots[:, c] += q[:, where] @ change[c, where]
            far = b.column("norm").to_numpy()[:, None] - 2 * dots + length
            cluster = far.argmin(1)
            kept = pa.ListArray.from_arrays(pa.array(np.arange(len(dots) + 1, dtype=np.int32) * dots.shape[1]), pa.array(dots.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("q"), b.column("norm"), kept, pa.array(cluster.astype(np.int32)), pa.array(far[np.arange(len(far)), cluster])],
                names=["vec_id", "q", "norm", "dots", "cluster", "distance"],
            )

    return state.select("vec_id", "q", "norm", "dots").mapInArrow(run, STATE)


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, clusters: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each row of ``vectors`` that is a whole vector.

    The first centroids are the vectors whose id has the smallest sha256 behind ``salt``; rows that share an id follow by
    components, and a null id counts as the text ``null``. Repeated rows are vectors each. With fewer vectors than clusters
    there are as many centroids as vectors; an empty table gives no rows. Components whose squared distances might leave 64
    bits raise an error. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = stage(quantised(vectors, vec_id, vector, dims, scale))
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    now = np.array([r.q for r in rows.orderBy(named, "q").limit(clusters).select("q").collect()], np.int64).reshape(-1, dims)
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v.cast("long"))
    state = rows.select("vec_id", "q", norm.alias("norm"), F.array_repeat(F.lit(0).cast("long"), len(now)).alias("dots"))
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(now):
        return spark.createDataFrame([], schema)
    old = np.zeros_like(now)
    for _ in range(rounds):
        state = stage(_moved(state, old, now))
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("q")[i].cast("long")).alias(f"s{i}") for i in range(dims)]).collect()
        old, now = now, now.copy()
        for r in sums:
            now[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    last = stage(_moved(state, old, now).select("vec_id", "cluster", "distance"))
    inertia = {r.cluster: r.d for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    # A row for each cluster.
    of = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(of), "cluster").select(*[c.split()[0] for c in schema.split(", ")])
