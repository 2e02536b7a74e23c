"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of at most so many splits is dealt out; each split is at most `spark.sql.files.maxPartitionBytes`.
FEW_SPLITS = 4


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with long texts, which are costly to work on.

    A table of very few splits is spread over the cores.  What moves is bounded by these splits and does
    not depend on the cluster; any larger table is read in place, without a shuffle.
    """
    table = spark.read.parquet(path)
    if table.rdd.getNumPartitions() > FEW_SPLITS:
        return table
    return table.repartition(spark.sparkContext.defaultParallelism)
