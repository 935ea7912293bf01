"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table, for work that costs more than moving the rows.

    A file of one row group is one task however many cores there are; only where a scan has fewer tasks
    than that are its rows dealt out.  Larger tables stay as they are.
    """
    df = table(spark, folder, name)
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
