"""Getting this package to the executors, and tables to a folder that they share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for each application: their Python may not have it on its path."""
    if (app := spark.sparkContext.applicationId) not in _shipped:
        here = Path(__file__).resolve().parent
        if here.parent.is_dir():  # else it came as an archive already
            made = tempfile.mkdtemp(prefix="spark-partloom-")
            copy = Path(made, "source", here.name)
            shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
            spark.sparkContext.addPyFile(shutil.make_archive(f"{made}/{here.name}", "zip", copy.parent))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset on a local master (tests)."""
    sc = spark.sparkContext
    if (named := sc.getConf().get("spark.checkpoint.dir")) is not None:
        return named
    if (held := sc.getCheckpointDir()) is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-partloom-", dir="/tmp"))
        held = sc.getCheckpointDir()
    return held


_written: dict[str, list[str]] = {}


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/partloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> int:
    """Remove what `written` wrote for this application, once the results that read it are stored: the number of tables."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        held = jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)
    return len(paths)
