"""Result tables as files: Parquet for what is read again, CSV for people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from fluorite.operators.cohort import wide_ragged


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, replacing what is there; ``by`` makes folders, such as one for each plane."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_wide_csv(long: DataFrame, path: str, column: str, value: str, order: Sequence[str], names: Sequence[str]) -> None:
    """One column for each name, blanks below a column's end, in row order."""
    wide = wide_ragged(long, column, value, order, names).orderBy("row_idx").drop("row_idx")
    wide.write.mode("overwrite").option("header", True).csv(path)


def write_tests_csv(tests: DataFrame, path: str) -> None:
    tests.orderBy("p_value", "comparison").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_wide_csv(spark, path: str, names: Sequence[str]) -> DataFrame:
    """Header row, doubles, blanks as nulls."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{n}` double" for n in names))
