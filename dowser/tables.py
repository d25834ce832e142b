"""Reading the index tables; every key counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each key, of the columns named only, so that nothing else is shuffled.

    Copies of a key agree in these columns, so any of them will do.
    """
    return df.select(key, *columns).dropDuplicates([key])
