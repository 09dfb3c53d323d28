"""Refreshing a catalog from files that land in a folder: a stream whose batches replace the rows of their sources.

A batch writes the rows of its own sources only, in a folder of their own, and then a manifest: a small table that says
for each source which batch holds its rows. The manifest is written aside and moved to its place in one rename, so a
version is there as a whole or not at all, and a driver that dies before it leaves the one before in force. Cost follows
the batch and the number of sources, not the catalog. Folders that no kept manifest names are removed by `vacuum`.

Defined results: a batch that is run again after its commit changes nothing, one that is run again before it writes its
folder anew; a source's value may be anything, null and blank are sources like any other; an empty batch commits nothing.
The rename must be atomic in the file system of `target` (local disks and HDFS are; object stores need one that is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

_KEPT = "_key string, _batch bigint"


def _system(spark: SparkSession, path: str):
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), held


def _listed(spark: SparkSession, path: str, prefix: str) -> list[tuple[str, str]]:
    """(value, path) of the folders `prefix=value` under a path; none where it is missing."""
    system, held = _system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(held)] if system.exists(held) else []
    return sorted((n[len(prefix) + 1 :], f"{path}/{n}") for n in names if n.startswith(f"{prefix}="))


def _versions(spark: SparkSession, target: str) -> list[int]:
    return sorted(int(n) for n, _ in _listed(spark, f"{target}/manifest", "version"))


def _manifest(spark: SparkSession, target: str, version: int) -> DataFrame:
    return spark.read.schema(_KEPT).parquet(f"{target}/manifest/version={version}")


def _key(source: str) -> Column:
    """A name for any value of a source that is safe in a path."""
    return F.when(F.col(source).isNull(), "none").otherwise(F.concat(F.lit("s"), F.sha2(F.col(source).cast("string"), 256)))


def latest(spark: SparkSession, target: str, schema: str) -> DataFrame | None:
    """The table of the newest version, or None if there is none yet: rows whose batch its manifest names for their source."""
    if not (versions := _versions(spark, target)):
        return None
    fields = StructType.fromDDL(schema)
    names = fields.names
    rows = spark.read.schema(StructType([*fields.fields, *StructType.fromDDL(_KEPT).fields])).option("basePath", f"{target}/data").parquet(f"{target}/data")
    # the folders are pruned by the manifest, a row for each source
    return rows.join(_manifest(spark, target, versions[-1]), ["_batch", "_key"], "left_semi").select(*names)


def commit(spark: SparkSession, made: str, place: str) -> None:
    """Move a finished manifest to its place, in one step."""
    system, there = _system(spark, place)
    system.mkdirs(there.getParent())
    if not system.rename(_system(spark, made)[1], there):
        raise OSError(f"{place} could not be committed")


def replace_sources(batch: DataFrame, target: str, source: str, number: int) -> None:
    """Write a batch's rows as the rows of the sources that it holds, and commit version `number`."""
    spark = batch.sparkSession
    versions = _versions(spark, target)
    if number in versions:  # run again after its commit
        return
    before = [v for v in versions if v < number]
    path = f"{target}/data/_batch={number}"
    batch.withColumn("_key", _key(source)).repartition("_key", F.pmod(F.xxhash64(*batch.columns), F.lit(16))).write.mode("overwrite").partitionBy("_key").parquet(path)
    held = [k for k, _ in _listed(spark, path, "_key")]  # names of folders, one for each source of the batch
    if not held:
        return
    new = spark.createDataFrame([(k, number) for k in held], _KEPT)
    kept = _manifest(spark, target, before[-1]).join(new.select("_key"), "_key", "left_anti").select("_key", "_batch").unionByName(new) if before else new
    made = f"{target}/making/version={number}"
    kept.coalesce(1).write.mode("overwrite").parquet(made)
    commit(spark, made, f"{target}/manifest/version={number}")


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> int:
    """Remove manifests but the newest `keep`, and the folders that none of these names: the number of folders removed.

    Not to be run while a batch is being written.
    """
    versions = _versions(spark, target)
    if not versions:
        return 0
    used = None
    for v in versions[-keep:]:
        m = _manifest(spark, target, v)
        used = m if used is None else used.unionByName(m)
    used = {(str(r._batch), r._key) for r in used.distinct().toLocalIterator()}  # a row for each source and kept version
    gone = [f"{target}/manifest/version={v}" for v in versions[:-keep]]
    for batch, path in _listed(spark, f"{target}/data", "_batch"):
        folders = _listed(spark, path, "_key")
        mine = [p for k, p in folders if (batch, k) not in used]
        gone += [path] if len(mine) == len(folders) else mine
    for path in gone:
        system, held = _system(spark, path)
        system.delete(held, True)
    return len(gone)


def refresh(spark: SparkSession, landing: str, schema: str, target: str, source: str, checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Start the stream over headed CSV files in `landing`; it ends when all files that are there have been read.

    A batch's rows replace all rows of the sources that it holds.
    """
    stream = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", max_files).csv(landing)
    return stream.writeStream.foreachBatch(lambda batch, number: replace_sources(batch, target, source, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
