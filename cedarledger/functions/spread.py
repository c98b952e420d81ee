"""Rows dealt out before work that costs much more than their bytes say."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows in as many partitions as a shuffle has, or as there are cores if those are more; by: columns of which equal values stay together.

    A small file is one partition, and adaptive execution joins partitions by their bytes; either leaves costly rows to one task.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)
