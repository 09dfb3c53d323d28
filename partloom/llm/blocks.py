"""Vectors packed into blocks, and a scan of data blocks for blocks of queries that keeps the best of each query.

A block is one row: its part, the range of its keys, and its ids, labels and vectors as bytes. Blocks are cut from rows
sorted by (part, key, id), so a part of any size, or one vector of any number of copies, is dealt out over many of them.
A scan sorts what meets by query block; a task holds one block of queries with its best so far and one block of data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a block of data and of queries, at most; blocks of data that one task scans for one block of queries.
DATA_ROWS, QUERY_ROWS, RUN = 2048, 8192, 32
#: Placeholder of a score that is not there yet; real scores are larger.
NO_SCORE = -(2**63) + 1
_BLOCK = "part int, low double, high double, n int, ids binary, labels binary, lows binary, highs binary, vecs binary"


def matrix(rows: pa.Array | pa.ChunkedArray, width: int, kind: type | str) -> np.ndarray:
    """Lists as rows of a matrix, the shorter ones filled with zeros."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    n = np.array([len(x) for x in rows], np.int64)
    out = np.zeros((len(n), width), kind)
    of = np.repeat(np.arange(len(n)), n)
    out[of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(rows.flatten(), kind)
    return out


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n of a sample's vectors, each the one farthest from those before."""
    near, chosen = ((sample - sample[0]) ** 2).sum(1), [0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def placed(rows: DataFrame, place: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, kind: str) -> DataFrame:
    """(part, far, id, label, lows, highs, vec) of (id, label, lows, highs, vec): the part and the key that `place` gives, vectors as bytes."""
    real = np.dtype(kind).kind == "f"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = matrix(b.column("vec"), width, np.float64 if real else np.int64)
            part, far = place(whole.astype(np.float64))
            vec = pa.array([v.tobytes() for v in whole.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(far.astype(np.float64)), b.column("id"), b.column("label"), b.column("lows"), b.column("highs"), vec], names=["part", "far", "id", "label", "lows", "highs", "vec"])

    return rows.select("id", "label", "lows", "highs", "vec").mapInArrow(run, "part int, far double, id long, label long, lows array<long>, highs array<long>, vec binary")


def packed(rows: DataFrame, size: int, windows: int = 0, partitions: int | None = None) -> DataFrame:
    """Blocks of up to `size` rows of one part in the order of their keys, each with a number of its own; kept in a table.

    windows: how many (low, high) ranges of scores each row has; missing ones are empty ranges.
    """

    def bytes_of(column: pa.ChunkedArray) -> np.ndarray:
        return matrix(column, windows, np.int64)

    def block(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held)
        far = np.asarray(t["far"])
        lows = highs = np.zeros((t.num_rows, 0), np.int64)
        if windows:
            there = np.arange(windows) < np.array([len(x) for x in t["lows"]])[:, None]
            lows, highs = np.where(there, bytes_of(t["lows"]), 1), np.where(there, bytes_of(t["highs"]), 0)
        values = [t["part"][0].as_py(), far[0], far[-1], t.num_rows, np.asarray(t["id"]).tobytes(), np.asarray(t["label"]).tobytes(), lows.tobytes(), highs.tobytes(), b"".join(t["vec"].to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 5])], names=["part", "low", "high", "n", "ids", "labels", "lows", "highs", "vecs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n, at = 0, None
        for b in batches:
            t, part = pa.Table.from_batches([b]), np.asarray(b.column("part"))
            start = 0
            while start < len(part):
                if part[start] != at or n == size:
                    if held:
                        yield block(held)
                    held, n, at = [], 0, part[start]
                other = np.flatnonzero(part[start : start + size - n] != at)
                stop = start + (int(other[0]) if len(other) else min(size - n, len(part) - start))
                held.append(t.slice(start, stop - start))
                n, start = n + stop - start, stop
        if held:
            yield block(held)

    by = ["part", "far", "id"]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return written(dealt.sortWithinPartitions(*by).mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id()))


def data_rows(n: int, cores: int) -> int:
    """Rows of a block of data: fewer where there are few rows, so that all cores work."""
    return min(DATA_ROWS, max(128, -(-n // (8 * cores))))


class Best:
    """The k best (score, id) of each of a number of rows, ties to the smaller id."""

    def __init__(self, rows: int, k: int, kind: type):
        self.k, self.none = k, NO_SCORE if kind is np.int64 else -np.inf
        self.score, self.id, self.there = np.full((rows, k), self.none, kind), np.full((rows, k), 2**63 - 1, np.int64), np.zeros((rows, k), bool)

    def last(self) -> np.ndarray:
        """The k-th best score of each row; `none` where there are fewer."""
        return np.where(self.there[:, -1], self.score[:, -1], self.none)

    def offer(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.unique(row)
        rows = np.concatenate([np.repeat(touched, self.k), row])
        all_there = np.concatenate([self.there[touched].ravel(), np.ones(len(row), bool)])
        scores, all_ids = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((all_ids, -scores, ~all_there, rows))
        first = np.searchsorted(rows[order], touched)
        kept = order[(first[:, None] + np.arange(self.k)).ravel()].reshape(len(touched), self.k)
        self.score[touched], self.id[touched], self.there[touched] = scores[kept], all_ids[kept], all_there[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at = np.nonzero(self.there)
        return row, self.id[row, at], self.score[row, at]


def promising(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores that may be among the k best of their row and reach its least; scores that do not count are NaN or the lowest."""
    open_ = scores >= least[:, None]
    if scores.shape[1] > k and open_.sum() > 8 * k * len(scores):
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        open_ &= scores >= kth[:, None]
    return np.nonzero(open_)


def shards(n_blocks: int, n_query_blocks: int, cores: int) -> int:
    """Tasks that share the data blocks of one block of queries."""
    return max(1, -(-n_blocks // RUN), min(n_blocks, -(-4 * cores // max(1, n_query_blocks))))


def scanned(queries: DataFrame, data: DataFrame, routes: DataFrame, n_shards: int, start: Callable, out: str) -> DataFrame:
    """What `start(query_block, block)` finds over the data blocks that (query_block, block, ring) sends to it, nearest ring first.

    start gives an object with meet(ring, block) and found(), an Arrow batch of the columns `out`.
    """
    body = ["ids", "labels", "lows", "highs", "vecs"]
    asked = queries.select(F.col("block").alias("query_block"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(-1.0).alias("ring"), *body)
    sent = routes.join(data, "block").select("query_block", F.pmod(F.xxhash64("block"), F.lit(n_shards)).cast("int").alias("shard"), "ring", *body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for at, ring, *block in zip(*[b.column(c).to_pylist() for c in ["query_block", "ring", *body]]):
                if ring < 0:
                    if held is not None:
                        yield held.found()
                    held = start(at, block)
                else:
                    held.meet(ring, block)
        if held is not None:
            yield held.found()

    met = asked.unionByName(sent).repartition("query_block", "shard").sortWithinPartitions("query_block", "shard", "ring")
    return met.mapInArrow(run, out)
