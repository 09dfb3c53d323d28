"""CSV and JSON in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, missing_ok: bool = True, spans_lines: bool = True) -> DataFrame:
    """A headed CSV file, all strings, blanks kept as blanks; a missing file is an empty table if its columns are named.

    spans_lines: quoted cells may hold line ends. Then a file is read by one task; without, large files are split.
    """
    try:
        return spark.read.csv(path, header=True, multiLine=spans_lines, escape='"', nullValue="\0", emptyValue="").na.fill("")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND" or not missing_ok or columns is None:
            raise
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def write_csv(df: DataFrame, path: str, columns: list[str], bom: bool = True) -> None:
    """The columns in order, others dropped, missing ones and nulls blank; the first header cell carries the byte-order mark."""
    held = df.select(*[(F.col(c) if c in df.columns else F.lit("")).cast("string").alias(c) for c in columns]).na.fill("")
    if bom:
        held = held.withColumnRenamed(columns[0], "﻿" + columns[0])
    held.write.csv(path, header=True, escape='"', emptyValue="", mode="overwrite")


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=True)


def wrapped_json(text: Column, prefix: str, suffix: str, schema: str) -> Column:
    """The value in `prefix JSON suffix`; an error for a text of another shape."""
    fits = F.startswith(F.trim(text), F.lit(prefix)) & F.endswith(F.trim(text), F.lit(suffix))
    inner = F.substring(F.trim(text), F.lit(len(prefix) + 1), F.length(F.trim(text)) - len(prefix) - len(suffix))
    return F.when(fits, F.from_json(inner, schema)).otherwise(F.raise_error(F.lit("unexpected wrapper")).cast(schema))


def sparse(df: DataFrame, columns: dict[str, Column], out: str) -> DataFrame:
    """df with a JSON object of the values that are not null, blank or an empty array; zero stays."""

    def kept(name: str, c: Column) -> Column:
        kind = df.select(c.alias("c")).schema["c"].dataType
        there = c != "" if isinstance(kind, T.StringType) else F.size(c) > 0 if isinstance(kind, T.ArrayType) else c.isNotNull()
        return F.when(there, c).alias(name)

    return df.withColumn(out, F.to_json(F.struct(*[kept(k, c) for k, c in columns.items()])))


def write_json_report(df: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file, nulls left out."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """A folder for each shard under data, and an index of their rows beside; shards of an earlier run go."""
    named = df.withColumn(shard, F.format_string("%03d", F.col(shard).cast("bigint")))
    named.repartition(shard).write.partitionBy(shard).mode("overwrite").json(f"{path}/data")
    write_json_report(named.groupBy(shard).agg(F.count("*").alias("rows")), f"{path}/index")


def read_shards(spark: SparkSession, path: str, schema: str, shard: str = "shard") -> DataFrame:
    """What write_shards wrote; an error if the shards do not hold the rows that their index names."""
    rows = spark.read.schema(f"{schema}, {shard} string").json(f"{path}/data")
    index = spark.read.schema(f"{shard} string, rows long").json(f"{path}/index")
    stated, held = index.agg(F.sum("rows")).first()[0] or 0, rows.count()
    if stated != held:
        raise ValueError(f"{held} rows in shards, {stated} in their index")
    return rows


def loaded(df: DataFrame, expected: int) -> DataFrame:
    """A published catalog, whose load fails if it is not complete."""
    if (n := df.count()) != expected:
        raise ValueError(f"{n} rows, {expected} expected")
    return df
