"""The selection queries: search, drill-down, detail and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partloom.functions.exprs import natural_key


def search_text(*columns: str) -> Column:
    """Everything a free-text query is looked for in."""
    return F.lower(F.concat_ws(" ", *columns))


def search(df: DataFrame, text: Column, query: str = "", equal: dict[str, str] | None = None, at_least: tuple[Column, float] | None = None) -> DataFrame:
    """Rows with the query as one substring, equal fields, and a count of at least n; blank or non-positive means no filter."""
    if q := query.strip().lower():
        df = df.filter(F.contains(text, F.lit(q)))
    for c, v in (equal or {}).items():
        if v:
            df = df.filter(F.col(c) == v)
    if at_least is not None and at_least[1] > 0:
        df = df.filter(F.coalesce(at_least[0], F.lit(0)) >= at_least[1])
    return df


def ranked(score: Column, name: Column, tie: Column) -> list[Column]:
    """By score (unknown last), then name in natural order, then the tie-break."""
    return [F.coalesce(score, F.lit(-1)).desc(), natural_key(name).asc(), tie.asc()]


def compare(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(metric, key, value, best): best is the largest of at least two known values that are not all equal."""
    long = df.select(key, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    w = Window.partitionBy("metric")
    best = (F.count("value").over(w) >= 2) & (F.max("value").over(w) != F.min("value").over(w)) & (F.col("value") == F.max("value").over(w))
    return long.withColumn("best", F.coalesce(best, F.lit(False)))
