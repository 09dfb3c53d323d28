"""Substring search by trigrams: a stored table of which rows hold which three characters, so that a query reads a few of them.

A row that holds the query holds all of its trigrams. The rarest of them are looked up (by a table of their counts), rows
that have them all are candidates, and the text decides. Postings are stored in the order of their trigram, so a lookup
reads the files that hold it; a trigram of any number of rows is split over files, as rows of one (gram, id) each.

Defined results: the query is trimmed and lower-cased and is one substring; a blank query finds every row; one of fewer
than three characters is looked for in every text; rows without a text are found by a blank query alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.session import written

#: Trigrams of a query that are looked up: the rarest ones.
LOOKED_UP = 4


class Postings(NamedTuple):
    """The rows (id, text, ...), the postings (gram, id), and the counts (gram, n)."""

    rows: DataFrame
    id: str
    text: str
    grams: DataFrame
    counts: DataFrame


def index(rows: DataFrame, id: str, text: str) -> Postings:
    """Store the postings of a column of lower-cased texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))
    grams = rows.filter(F.length(t) >= 3).select(F.explode(F.array_distinct(each)).alias("gram"), F.col(id).alias("id"))
    held = written(grams.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id"))
    return Postings(rows, id, text, held, written(held.groupBy("gram").agg(F.count("*").alias("n"))))


def candidates(held: Postings, query: str) -> DataFrame | None:
    """(id) of the rows that have the query's rarest trigrams; None for a query that has none."""
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    if not grams:
        return None
    known = {r.gram: r.n for r in held.counts.filter(F.col("gram").isin(grams)).collect()}  # a row for each of the query's trigrams
    rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:LOOKED_UP]
    if known.get(rarest[0], 0) == 0:
        return held.grams.select("id").limit(0)
    found = held.grams.filter(F.col("gram").isin(rarest)).groupBy("id").count()
    return found.filter(F.col("count") == len(rarest)).select("id")


def find(held: Postings, query: str) -> DataFrame:
    """The rows whose text holds the query."""
    q = query.strip().lower()
    if not q:
        return held.rows
    met = candidates(held, q)
    rows = held.rows if met is None else held.rows.join(met, F.col(held.id) == F.col("id"), "left_semi")
    return rows.filter(F.contains(held.text, F.lit(q)))
