"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task takes at most, where keys are many.
ROWS_EACH = 250_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key into tasks that do not grow with it; aggregates and windows by this and further columns need no other shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS_EACH + 1), key)
