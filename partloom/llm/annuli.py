"""Hard negatives by one-dimensional distance keys.

1. Rows get one more coordinate, sqrt(M - |x|^2) with M the largest squared norm, queries a zero: then the squared distance
   of query and row is |q|^2 + M - 2 q.x, and larger inner products are nearer rows.
2. Each row belongs to its nearest pivot and has its distance to it as key. The rows are stored sorted by (pivot, key), in
   blocks that know the range of their keys.
3. A row within distance R of a query has a key in [a - R, a + R] of each pivot, a the query's distance to the pivot, and
   one at least D away has a key of D - a at least: an annulus of each pivot. The nearest annulus is scanned first; what it
   finds is a bound R that the final result reaches. Then the interval is widened to R at once, and its blocks are scanned
   in the order of their least possible distance until that exceeds every query's current bound: the result is certified.
4. Positives are the top rows of the same label. Each positive's score s gives a range [s / 2, 0.95 s] of scores; the top
   rows of other labels within each range are its hard negatives, by the same search: one more scan for all ranges.

Where no bound can prune (directions spread evenly over many dimensions) all blocks meet all query blocks.

Components are whole numbers; scores are exact as long as sums stay under 2^63.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; an anchor's own
rows are the rows of its id; a repeated anchor id counts once, with its smallest vector and then label; repeated rows are
candidates each; vectors of different lengths meet as if the shorter went on with zeros; ties go to the smaller id; other
columns than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks
from .common import prepare, written

#: Pivots at most, blocks of data for each, and vectors for each that they are chosen from.
PIVOTS, BLOCKS_EACH, SAMPLE = 256, 4, 16
#: A positive's negatives score between these percentages of its score.
LEAST, MOST = 50, 95


class Index:
    """The stored blocks of (id, label, vec), the pivots with their last coordinate, and what queries need to know of both."""

    def __init__(self, rows: DataFrame):
        self.spark = prepare(rows.sparkSession)
        square = F.aggregate("vec", F.lit(0.0), lambda held, x: held + x.cast("double") * x.cast("double"))
        of = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))), F.lit(0.0)), F.coalesce(F.max(square), F.lit(0.0))).first()
        self.n, self.width, most, self.norm2 = of[0], max(of[1], 1), of[2], of[3]
        self.kind = "int16" if most < 2**15 else "int32" if most < 2**31 else "int64"
        if not self.n:
            return
        self.cores = self.spark.sparkContext.defaultParallelism
        size = blocks.data_rows(self.n, self.cores)
        n_pivots = min(PIVOTS, max(4, -(-self.n // (BLOCKS_EACH * size))))
        sample = rows.orderBy(F.xxhash64("id"), "id").select("vec").limit(SAMPLE * n_pivots).toArrow()  # bounded
        self.pivots = pivots = blocks.spread(_lifted(blocks.matrix(sample["vec"], self.width, np.int64).astype(np.float64), self.norm2), n_pivots)
        shared, norm2 = self.spark.sparkContext.broadcast(pivots), self.norm2

        def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(x):
                return np.zeros(0), np.zeros(0)
            away = _away(_lifted(x, norm2), shared.value)
            part = away.argmin(1)
            return part, away[np.arange(len(x)), part]

        none = F.lit(None).cast("array<long>")
        self.rows = blocks.packed(blocks.placed(rows.select("id", "label", none.alias("lows"), none.alias("highs"), "vec"), place, self.width, self.kind), size)
        self.n_blocks = self.rows.count()


def _lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm2 - (x**2).sum(1), 0))])


def _away(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))


def _read(block: list[bytes], kind: str, windows: int) -> tuple[np.ndarray, ...]:
    ids, labels = np.frombuffer(block[0], np.int64), np.frombuffer(block[1], np.int64)
    lows, highs = (np.frombuffer(x, np.int64).reshape(len(ids), windows).copy() for x in block[2:4])
    return ids, labels, lows, highs, np.frombuffer(block[4], kind).reshape(len(ids), -1)


def _distance(squares: np.ndarray, norm2: float, score: np.ndarray) -> np.ndarray:
    """The distance at which a row has a score."""
    return np.sqrt(np.maximum(squares + norm2 - 2.0 * score, 0))


def intervals(queries: DataFrame, index: Index, windows: int) -> DataFrame:
    """(query_block, part, key_from, key_to, nearest, farthest): for each block of queries and pivot, the keys that may serve, and the block's distances to the pivot."""
    shared, norm2, kind = index.spark.sparkContext.broadcast(index.pivots), index.norm2, index.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, *block in zip(*[b.column(c).to_pylist() for c in ["block", "ids", "labels", "lows", "highs", "vecs"]]):
                _, _, lows, highs, x = _read(block, kind, windows)
                x = x.astype(np.float64)
                squares, pivots = (x**2).sum(1), shared.value
                away = _away(np.column_stack([x, np.zeros(len(x))]), pivots)
                slack = 1e-6 * (np.sqrt(squares + norm2) + 1)
                asked = lows <= highs
                reach = np.where(asked, np.where(lows == blocks.NO_SCORE, np.inf, _distance(squares[:, None], norm2, lows)), -np.inf).max(1) + slack
                near = np.where(asked, np.where(highs == 2**63 - 1, 0, _distance(squares[:, None], norm2, highs)), np.inf).min(1) - slack
                least, most = np.maximum(away - reach[:, None], near[:, None] - away), away + reach[:, None]
                some = asked.any(1)
                if some.any():
                    n = len(pivots)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at)), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(v) for v in (least[some].min(0), most[some].max(0), (away - slack[:, None])[some].min(0), (away + slack[:, None])[some].max(0)))], names=["query_block", "part", "key_from", "key_to", "nearest", "farthest"])

    return queries.mapInArrow(run, "query_block long, part int, key_from double, key_to double, nearest double, farthest double")


def routes(queries: DataFrame, index: Index, windows: int) -> DataFrame:
    """(query_block, block, ring): the stored blocks whose keys lie in a query block's intervals, and their least distance."""
    keys = index.rows.select("block", "part", "low", "high")
    met = intervals(queries, index, windows).join(keys, "part").filter((F.col("low") <= F.col("key_to")) & (F.col("high") >= F.col("key_from")))
    return met.select("query_block", "block", F.greatest(F.lit(0.0), F.col("nearest") - F.col("high"), F.col("low") - F.col("farthest")).alias("ring"))


class Scan:
    """The k best rows of the same label, or of others, for each query of a block and each of its ranges of scores."""

    def __init__(self, number: int, block: list[bytes], index: tuple, windows: int, k: int, same: bool):
        self.number, (self.kind, self.norm2) = number, index
        self.windows, self.k, self.same = windows, k, same
        self.ids, self.labels, self.lows, self.highs, x = _read(block, self.kind, windows)
        self.x, self.squares = x, (x.astype(np.float64) ** 2).sum(1)
        self.best = blocks.Best(len(self.ids) * windows, k, np.int64)
        self.reach = self._reach()

    def least(self) -> np.ndarray:
        """The score that a row must reach now, by query and range."""
        return np.maximum(self.lows, self.best.last().reshape(-1, self.windows))

    def _reach(self) -> float:
        least, asked = self.least(), self.lows <= self.highs
        far = np.where(asked, np.where(least == blocks.NO_SCORE, np.inf, _distance(self.squares[:, None], self.norm2, least)), -np.inf)
        return float(far.max(initial=-np.inf) + 1e-6 * (np.sqrt(self.squares.max(initial=0) + self.norm2) + 1))

    def meet(self, ring: float, block: list[bytes]) -> None:
        if ring > self.reach:  # neither this annulus nor a later one can hold a better row
            return
        ids, labels, _, _, y = _read(block, self.kind, 0)
        most = np.sqrt(self.squares.max(initial=0)) * np.sqrt((y.astype(np.float64) ** 2).sum(1).max(initial=0))
        number = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        other, step = np.ascontiguousarray(y.T.astype(number)), 128
        for i in range(0, len(self.ids), step):
            part = slice(i, i + step)
            scores = (self.x[part].astype(number) @ other).astype(np.int64)
            fits = ((labels == self.labels[part, None]) == self.same) & (ids != self.ids[part, None])
            for w in range(self.windows):
                low, high = self.lows[part, w], self.highs[part, w]
                if not (low <= high).any():
                    continue
                least = np.maximum(low, self.best.last().reshape(-1, self.windows)[part, w])
                counted = np.where(fits & (scores <= high[:, None]) & (scores >= least[:, None]), scores, blocks.NO_SCORE)
                row, at = blocks.promising(counted, np.maximum(least, blocks.NO_SCORE + 1), self.k)
                self.best.offer((row + i) * self.windows + w, ids[at], counted[row, at])
        self.reach = self._reach()

    def found(self) -> pa.RecordBatch:
        row, ids, score = self.best.found()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row // self.windows]), pa.array((row % self.windows).astype(np.int32)), pa.array(ids), pa.array(score)], names=["query_id", "window", "vec_id", "score"])


class Bounds(Scan):
    """The lower ends of all ranges, raised to what a first scan has found."""

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.number]), pa.array([self.least().tobytes()])], names=["block", "raised"])


def search(queries: DataFrame, index: Index, windows: int, k: int, same: bool) -> DataFrame:
    """(query_id, window, rank, vec_id, score): for each query (id, label, lows, highs, vec) and range, its k best rows of the same label or of others."""

    def home(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(x):
            return np.zeros(0), np.zeros(0)
        away = _away(np.column_stack([x, np.zeros(len(x))]), shared.value)
        part = away.argmin(1)
        return part, away[np.arange(len(x)), part]

    shared = index.spark.sparkContext.broadcast(index.pivots)
    held = blocks.packed(blocks.placed(queries, home, index.width, index.kind), blocks.QUERY_ROWS, windows, 4 * index.cores)
    n_query_blocks, about = held.count(), (index.kind, index.norm2)
    first = routes(held, index, windows).groupBy("query_block").agg(F.min(F.struct("ring", "block")).alias("m")).select("query_block", "m.block", "m.ring")
    raised = blocks.scanned(held, index.rows, first, 1, lambda at, b: Bounds(at, b, about, windows, k, same), "block long, raised binary")
    sure = written(held.join(raised, "block", "left").withColumn("lows", F.coalesce("raised", "lows")).select(*held.columns))
    n_shards = blocks.shards(index.n_blocks, n_query_blocks, index.cores)
    found = blocks.scanned(sure, index.rows, routes(sure, index, windows), n_shards, lambda at, b: Scan(at, b, about, windows, k, same), "query_id long, window int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "window", "rank", "vec_id", "score")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, vec) of whole numbers; anchors are those where `anchor` holds."""
    spark = prepare(rows.sparkSession)
    rows = rows.filter("id is not null and label is not null and vec is not null").select("id", F.col("label").cast("long").alias("label"), "vec")
    index = Index(rows)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.n:
        return spark.createDataFrame([], empty)
    anchors = rows.filter(anchor).groupBy("id").agg(F.min(F.struct("vec", "label")).alias("a")).select("id", "a.vec", "a.label")
    anchors = written(anchors)
    every = lambda x: F.array(F.lit(x).cast("long"))
    top = search(anchors.select("*", every(blocks.NO_SCORE).alias("lows"), every(2**63 - 1).alias("highs")), index, 1, positives, True)
    top = written(top.select("query_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    ranges = F.transform(F.array_sort(F.collect_list(F.struct("window", "positive_score"))), lambda p: F.when(p["positive_score"] >= 0, p["positive_score"]))  # up to `positives` for each anchor
    asked = anchors.join(top.groupBy(F.col("query_id").alias("id")).agg(ranges.alias("of")), "id")
    low = F.transform("of", lambda s: F.coalesce(_whole_share(s, LEAST, 99), F.lit(1).cast("long")))
    high = F.transform("of", lambda s: F.coalesce(_whole_share(s, MOST, 0), F.lit(0).cast("long")))  # no range for scores under 0
    found = search(asked.select("id", "label", "vec", low.alias("lows"), high.alias("highs")), index, positives, negatives, False)
    both = found.join(top, ["query_id", "window"])
    return both.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _whole_share(score: Column, percent: int, up: int) -> Column:
    """percent / 100 of a score of 0 or more, rounded down after `up` hundredths are added, in whole numbers."""
    by = F.lit(100).cast("long")
    return F.call_function("div", score, by) * percent + F.call_function("div", score % by * percent + up, by)
