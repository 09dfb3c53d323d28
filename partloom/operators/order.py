"""Numbers in a global order without a single task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partloom.session import written


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with 1, 2, 3 … in the order: ranges are sorted on their own, then shifted by the sizes of those before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count()  # a row for each partition
    before = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, local).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def shards(df: DataFrame, order: list[Column], size: int = 300) -> DataFrame:
    """df with the number of its shard of `size` consecutive rows."""
    return numbered(df, order, "_row").withColumn("shard", F.floor((F.col("_row") - 1) / size)).drop("_row")


def first_page(df: DataFrame, order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first rows in an order with their rank: a top-k, so only `limit` rows meet in one task."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def session_ids(spark: SparkSession, ids: list, kind: str) -> DataFrame:
    """A short list of ids with their positions."""
    return spark.createDataFrame(list(enumerate(ids, 1)), f"pos int, id {kind}")
