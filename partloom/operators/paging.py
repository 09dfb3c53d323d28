"""Pages of a result: stored in order with a table of sizes, so that any page and what remains need no sort; or by key.

`publish` sorts a result once into range shards and keeps how many rows stand before each. A page reads only the shards
that hold its ranks. `following` needs nothing stored: the rows after the last one that was seen, by its keys.

Defined results: a page past the end is empty; pages of a stored result never overlap and leave nothing out; ties in the
order must be broken by its last key.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partloom.session import shared_dir

#: Rows of the first page, and of each that follows.
FIRST, MORE = 120, 200


class Published(NamedTuple):
    """Rows by shard with their place in it, and of each shard how many rows stand before it."""

    rows: DataFrame
    sizes: DataFrame
    total: int


def publish(df: DataFrame, order: list[Column]) -> Published:
    """Store df in an order: ranges that are sorted on their own, in a folder each, and the table of their sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_shard", F.spark_partition_id())
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_shard").orderBy(*order)))
    placed.write.partitionBy("_shard").parquet(f"{path}/rows")
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    counted = rows.groupBy("_shard").count()  # a row for each range
    before = F.coalesce(F.sum("count").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted.select("_shard", F.col("count").alias("_n"), before.alias("_before")).write.parquet(f"{path}/sizes")
    sizes = spark.read.schema("_shard int, _n bigint, _before bigint").parquet(f"{path}/sizes")
    return Published(rows, sizes, sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])


def page(held: Published, start: int, size: int, rank: str = "rank", remaining: str = "remaining") -> DataFrame:
    """Rows start + 1 .. start + size of a stored result with their rank, and how many follow the page."""
    met = held.sizes.filter((F.col("_before") < start + size) & (F.col("_before") + F.col("_n") > start))
    at = (F.col("_before") + F.col("_at")).cast("bigint")
    rows = held.rows.join(F.broadcast(met), "_shard").withColumn(rank, at).filter((at > start) & (at <= start + size))
    return rows.drop("_shard", "_at", "_n", "_before").withColumn(remaining, F.lit(max(0, held.total - start - size)).cast("bigint"))


def bounds_of(number: int) -> tuple[int, int]:
    """(start, size) of page 1, 2, …: the first page, and those that `more` brings."""
    return (0, FIRST) if number == 1 else (FIRST + MORE * (number - 2), MORE)


def following(df: DataFrame, order: list[tuple[Column, bool]], last: list, size: int) -> DataFrame:
    """The next rows after the one whose keys are `last`, in an order of (key, descending): a top-k of what follows.

    Keys that may be null are to be made otherwise by the caller.
    """
    after = F.lit(False)
    for (key, down), value in reversed(list(zip(order, last))):
        beyond = key < F.lit(value) if down else key > F.lit(value)
        after = beyond | ((key == F.lit(value)) & after)
    return df.filter(after).orderBy(*[k.desc() if down else k.asc() for k, down in order]).limit(size)
