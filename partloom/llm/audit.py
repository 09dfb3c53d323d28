"""Filter interaction audit: what each filter removes alone, after others, and in every order.

1. Each document gets a mask of the filters that it fails.
2. For each part and label, one aggregation adds up the 32 signed parities (-1)^|u & mask| of all documents, u = 0..31:
   the Walsh-Hadamard transform of the counts by mask. It is linear, so partial sums meet in any order.
3. The transform is its own inverse up to the factor 32, so the counts of all 32 masks are regained exactly.
4. All orders are read from these cells: a step keeps what fails neither its filter nor an earlier one. The Shapley value
   needs no orders: of a document's m failed filters each comes first in n!/m of all orders.

Defined results: a null text is empty; a null part is the empty string; a document is good or toxic if any label row of
its id says so; rows of one id are documents each; a row without an id is labelled by none and is no copy; without
documents there are no rows; other columns than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import lookup_join, prepare, written

LETTERS = "ABCDE"
#: Least words; least share of distinct words in percent; most capitals in percent; characters that a text must not hold.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
UPPER, CONTINUED = bytes(range(65, 91)), bytes(range(128, 192))


def text_failures(text: bytes) -> int:
    """The bits of the filters A to D that a text (UTF-8) fails; bytes.split cuts at the same six characters as the filters' words."""
    words = text.split()
    n, without = len(words), lambda gone: len(text.translate(None, gone))
    fails = (n < WORDS, 100 * len(set(words)) < DISTINCT * n, 100 * (len(text) - without(UPPER)) > CAPITALS * without(CONTINUED), without(MARKS) < len(text))
    return sum(f << i for i, f in enumerate(fails))


def read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, bits, same) of (doc_id, part, text): the filters failed, and a digest that equal texts share."""
    for b in batches:
        texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
        bits = pa.array([text_failures(t) for t in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), bits, pa.array([sha256(t).digest() for t in texts], pa.binary())], names=["doc_id", "part", "bits", "same"])


def masks(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """(part, good, toxic, mask) of each document of (doc_id, text); labels: (doc_id, quality, toxic)."""
    prepare(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), "text")
    read = written(texts.mapInArrow(read_texts, StructType([*texts.schema.fields[:2], StructField("bits", IntegerType()), StructField("same", BinaryType())])))
    copied = read.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    seen = lookup_join(lookup_join(read, written(copied), ["same"]), written(said), ["doc_id"])
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    held = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return seen.select("part", held("good"), held("toxic"), (F.col("bits") + F.when(later, 16).otherwise(0)).alias("mask"))


def sign(both: Column) -> Column:
    """1 for an even number of bits, else -1."""
    return 1 - 2 * (F.bit_count(both) % 2)


def parities(marked: DataFrame, n: int = len(LETTERS)) -> DataFrame:
    """(part, good, toxic, s0..): the signed parity sums of the masks of each part and label."""
    sums = [F.sum(sign(F.col("mask").bitwiseAND(F.lit(u))).cast("long")).alias(f"s{u}") for u in range(2**n)]
    return marked.groupBy("part", "good", "toxic").agg(*sums)


def cells(sums: DataFrame, n: int = len(LETTERS)) -> DataFrame:
    """(part, every, good, toxic): counts of the masks 0.. of all, good and toxic documents, by the inverse transform."""
    which = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    added = sums.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(w, F.col(f"s{u}"))), F.lit(0)) for u in range(2**n)]).alias(k) for k, w in which.items()])
    numbers = F.sequence(F.lit(0), F.lit(2**n - 1))

    def inverted(name: str) -> Column:
        at = lambda m: F.aggregate(numbers, F.lit(0).cast("long"), lambda held, u: held + sign(m.bitwiseAND(u)) * F.get(F.col(name), u))
        return F.transform(numbers, lambda m: F.shiftright(at(m), n)).alias(name)

    return added.select("part", *map(inverted, which))


def steps(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order and step, read from the counts of the masks."""
    n = len(letters)
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    each = counted.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    at = lambda letter: F.instr(F.col("filter_order"), letter)
    bits = lambda met: sum((F.when(met(at(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    each = each.select("*", bits(lambda p: p == F.col("step")).alias("bit"), bits(lambda p: p < F.col("step")).alias("earlier"))
    numbers, bit, earlier = F.sequence(F.lit(0), F.lit(2**n - 1)), F.col("bit"), F.col("earlier")

    def total(name: str, met, times=lambda m: F.lit(1)) -> Column:
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda held, m: held + F.when(met(m), F.get(F.col(name), m) * times(m)).otherwise(0))

    fails = lambda m: m.bitwiseAND(bit) != 0
    before = lambda m: m.bitwiseAND(earlier) != 0
    removed = lambda m: fails(m) & ~before(m)
    share = lambda m: (F.lit(factorial(n)) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")  # noqa: E731  whole for up to five filters
    return each.select(
        "part", "filter_order", "step",
        total("every", lambda m: ~fails(m) & ~before(m)).alias("kept"),
        total("every", removed).alias("removed"),
        total("every", lambda m: fails(m) & before(m)).alias("redundant"),
        total("every", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("every", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """The audit of the five filters over all documents."""
    return steps(cells(parities(masks(docs, labels, part))))
