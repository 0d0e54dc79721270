"""Tables of a folder of Parquet files as signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """One channel: user_id, ts, value."""
    return table(spark, folder, "events").select("user_id", "ts", "value")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Four channels per l_suppkey, in the order of all eight columns (no shorter one is unique)."""
    return table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
