"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.session import ship, written  # noqa: F401  written is for the operators

#: Rows and bytes of one Arrow batch handed to a Python task, so that a batch of long texts stays small.
ARROW_ROWS, ARROW_BYTES = 2000, "4m"


_emptied: dict[str, Callable[[], None]] = {}
_using = ""
#: Of the C library where it has it: else what is freed stays with the process.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def keeps(owner: str, empty: Callable[[], None]) -> None:
    """Name what an operator keeps in a Python worker beyond a task, and how it is emptied."""
    _emptied[owner] = empty


def alone(owner: str) -> None:
    """Called in a task before an operator works: workers are used again by later stages, so what others keep is dropped and handed back to the system."""
    global _using
    if owner != _using:
        for name, empty in _emptied.items():
            if name != owner:
                empty()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim(0)
        _using = owner


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python tasks receive, and send them this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names the operator is about to add."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


#: Tables are broadcast up to so many rows and bytes (of their JSON text), after both are counted; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: Rows from which a key counts as hot, and hot keys at most: the most frequent ones.
HOT_ROWS, HOT_KEYS = 100_000, 1_000


def is_small(df: DataFrame) -> bool:
    """Whether a table may be broadcast."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    rows, held = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 32) -> DataFrame:
    """Join a big table with a table of unique keys: broadcast behind a check of its size, else by a shuffle in which hot keys alone are salted."""
    if is_small(small):
        return big.join(F.broadcast(small), keys, how)
    hashed = F.xxhash64(*keys)
    top = big.groupBy(hashed.alias("h")).count().filter(F.col("count") >= HOT_ROWS).orderBy(F.desc("count"), "h").limit(HOT_KEYS)
    hot = [r.h for r in top.select("h").collect()]  # at most HOT_KEYS
    if not hot:
        return big.join(small, keys, how)
    salt = free_name(big, "salt")
    wide = small.withColumn(salt, F.explode(F.when(hashed.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    spread = big.withColumn(salt, F.when(hashed.isin(hot), (F.monotonically_increasing_id() % salts).cast("int")).otherwise(0))
    return spread.join(wide, [*keys, salt], how).drop(salt)
