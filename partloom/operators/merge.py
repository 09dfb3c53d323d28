"""Merging overlapping sources: precedence with collisions, first and last wins, lineage, upserts with a conflict log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_unique(rows: DataFrame, key: str, source: str, position: str, value: str) -> DataFrame:
    """(key, value, origin, collisions) for rows of several sources, source 0 being the base.

    In order of source and position: a first or an identical row sets value and origin; a differing row replaces one
    whose origin is the base, and is a collision otherwise. Blank keys are skipped. Equal rows of a source are counted
    first (the base's last and another source's first place is what matters), so that the fold over a key has a row for
    each source and value, however often a key is repeated.
    """
    given = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    counted = given.groupBy(key, source, value).agg(F.count("*").alias("_n"), F.min(position).alias("_first"), F.max(position).alias("_last"))
    at = F.when(F.col(source) == 0, F.col("_last")).otherwise(F.col("_first"))
    held = counted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(source).alias("s"), at.alias("p"), F.col(value).alias("v"), F.col("_n").alias("n")))).alias("rows"))
    kind = rows.schema[value].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("v"), F.lit(-1).alias("o"), F.lit(0).cast("bigint").alias("c"))

    def step(a: Column, r: Column) -> Column:
        take = (a["o"] == -1) | a["v"].eqNullSafe(r["v"]) | (a["o"] == 0)
        return F.struct(F.when(take, r["v"]).otherwise(a["v"]).alias("v"), F.when(take, r["s"].cast("int")).otherwise(a["o"]).alias("o"), F.when(take, a["c"]).otherwise(a["c"] + r["n"]).alias("c"))

    out = held.select(key, F.aggregate("rows", start, step).alias("m"))
    return out.select(key, F.col("m.v").alias(value), F.col("m.o").alias("origin"), F.col("m.c").cast("int").alias("collisions"))


def first_wins(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """rows with `kept` (the first of its key) and `copies`."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("kept", F.row_number().over(w.orderBy(*order)) == 1).withColumn("copies", F.count("*").over(w))


def lineage(rows: DataFrame, key: list[str], order: str, source: str, attributes: list[str]) -> DataFrame:
    """The first row's attributes, and every distinct source in order of first appearance, joined by ;"""
    seen = rows.groupBy(*key, source).agg(F.min(order).alias("_first"))
    sources = seen.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", source))), lambda x: x[source]), ";").alias("sources"))
    first = rows.groupBy(*key).agg(*[F.min_by(a, order).alias(a) for a in attributes])
    return first.join(sources, key)


def conflicts(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Of each key: rows equal to the first, and rows that differ from it (errors, which are left out)."""
    each = rows.groupBy(*key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))  # a hot key is counted before it meets
    same = F.min_by("_n", "_first")
    return each.groupBy(*key).agg(same.alias("same"), (F.sum("_n") - same).alias("errors"))


def upsert_values(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Long form (key, field, old, new, value, conflict): a blank never overwrites; a differing old value is logged, the new one wins."""
    long = lambda df, name: df.select(key, F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", name))
    both = long(old, "old").join(long(new, "new"), [key, "field"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return both.withColumn("value", F.when(blank("new"), F.col("old")).otherwise(F.col("new"))).withColumn("conflict", ~blank("new") & ~blank("old") & (F.col("new") != F.col("old")))


def replace_source(rows: DataFrame, source: str, name: str, new: DataFrame) -> DataFrame:
    """Rows of one source replaced by its new ones: idempotent."""
    return rows.filter(~F.col(source).eqNullSafe(name)).unionByName(new)
