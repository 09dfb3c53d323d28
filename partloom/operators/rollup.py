"""Rollups of the hierarchy: lines, coverage, counts by a fixed list of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_rollup(rows: DataFrame, line: list[str], order: str, first: list[str], item: Column) -> DataFrame:
    """Of each line: attributes of its first row, number of rows, distinct items in order joined by ;"""
    return rows.groupBy(*line).agg(*[F.min_by(c, order).alias(f"first_{c}") for c in first], F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(item)), ";").alias("items"))


def zero_filled(rows: DataFrame, group: str, kind: str, instance: str, kinds: list[str]) -> DataFrame:
    """Distinct instances of each of a fixed list of kinds for every group, zero where there are none."""
    counts = [F.countDistinct(F.when(F.col(kind) == k, F.col(instance))).alias(f"n_{k.lower()}") for k in kinds]
    return rows.groupBy(group).agg(*counts)


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are not blank and occur more than once."""
    return rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).count().filter("count > 1")


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Groups with the position at which each was first seen."""
    return rows.groupBy(key).agg(F.min(position).alias("first_seen"), F.count("*").alias("n"))
