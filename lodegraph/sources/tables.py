"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *keys: str, arrived: str = "ingested_at") -> DataFrame:
    """One row per key, the first that arrived. Rows with a null key are kept as one group.

    A record may be delivered twice with the same content, so this only drops repeats.
    """
    order = [F.col(arrived).asc_nulls_last()] if arrived in df.columns else [F.col(keys[0])]
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")
