"""Tables written to the cluster's shared folder, to cut lineage or to number rows once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary folder takes its place; a cluster's executors share
    none, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/fluorite"
    return f"{base.rstrip('/')}/fluorite-{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``scratch_root``."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it again.

    It cuts the lineage: what is read back doesn't depend on any executor's memory or disk, so a lost executor costs a
    re-read and not a recomputation. Ids and media hardly shrink without an entropy coder, so zstd it is.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> bool:
    """Delete all tables staged by this application. Results that aren't written yet may still read them: call it after that."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
