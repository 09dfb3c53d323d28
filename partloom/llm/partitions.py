"""Approximate nearest neighbours by learned partitions.

1. Of a bounded sample (SAMPLE rows, or EACH for each partition) the neighbour graph is found, exactly, in tasks.
2. The graph is cut into partitions of about equal size: halves along the longest direction of each part, then moves of
   single nodes to where more of their neighbours are, as far as sizes stay within a tenth of the mean.
3. A small network is trained to tell the partitions of a node and its neighbours from the node's vector.
4. Every row is put into its most probable partition. The rows of a partition are stored in blocks of bounded size.
5. A query is routed to partitions in the order of their probability, until the probability before the next one reaches a
   bound and enough rows are met. The bound is the one at which held-out nodes of the sample meet RECALL of their
   neighbours: a few partitions on clustered data, half of them where directions are spread evenly.
6. What is met is ranked by exact Euclidean distance on the original vectors.

Defined results: null and zero vectors, vectors with null or non-finite components, and rows without an id take no part;
a query's own rows are the rows of its id; a repeated query id counts once, with its smallest vector; repeated rows are
candidates each; vectors of different lengths meet as if the shorter went on with zeros; ties go to the smaller id; where
the partitions met hold fewer than k rows of other ids, those are returned; other columns than id and vec are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks
from .common import prepare

#: Rows that the model is fitted on: at least SAMPLE, and EACH for each partition; partitions at least and at most.
SAMPLE, EACH, FEWEST, MOST = 8192, 64, 4, 256
#: Neighbours in the graph, share of the neighbours that routing is set to meet, rows that a query meets at least for each neighbour asked for.
NEIGHBOURS, RECALL, ENOUGH = 10, 0.95, 4
#: Units of the network's inner layer, passes over the sample, rows of a step, and one node of so many is held out.
HIDDEN, EPOCHS, STEP, HELD_OUT = 128, 30, 256, 5


class Scan:
    """The k nearest rows of each query of a block."""

    def __init__(self, number: int, block: list[bytes], kind: str, k: int):
        self.kind, self.k = kind, k
        self.ids = np.frombuffer(block[0], np.int64)
        self.x = np.frombuffer(block[4], kind).reshape(len(self.ids), -1).astype(np.float64)
        self.best = blocks.Best(len(self.ids), k, np.float64)

    def meet(self, ring: float, block: list[bytes]) -> None:
        ids = np.frombuffer(block[0], np.int64)
        y = np.frombuffer(block[4], self.kind).reshape(len(ids), -1).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):  # squares beyond double: the distance is infinite
            squares = (y**2).sum(1)
            for i in range(0, len(self.ids), 128):
                q = self.x[i : i + 128]
                own = (q**2).sum(1)[:, None]
                near = -np.nan_to_num(own + squares - 2 * q @ y.T, nan=0.0, posinf=np.inf, neginf=0.0)
                slack = 1e-12 * (own[:, 0] + squares.max(initial=0)) + 1e-300
                last = self.best.last()[i : i + 128]
                counted = np.where(ids != self.ids[i : i + 128, None], near, -np.inf)
                kth = np.full(len(q), -np.inf)
                if len(ids) > self.k:
                    kth = np.partition(counted, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                least = np.maximum(kth, -(last**2)) - np.nan_to_num(slack, posinf=1e308)
                row, at = np.nonzero((counted >= least[:, None]) & (ids != self.ids[i : i + 128, None]))
                for s in range(0, len(row), 65536):  # the exact measure, in pieces of bounded size
                    r, c = row[s : s + 65536], at[s : s + 65536]
                    self.best.offer(r + i, ids[c], -np.sqrt(((q[r] - y[c]) ** 2).sum(1)))

    def found(self) -> pa.RecordBatch:
        row, ids, score = self.best.found()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(ids), pa.array(-score)], names=["query_id", "vec_id", "score"])


_FOUND = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(rows: DataFrame, place, width: int, kind: str, size: int, partitions: int | None = None) -> DataFrame:
    none = F.lit(None).cast("array<long>")
    return blocks.packed(blocks.placed(rows.select("id", F.lit(0).cast("long").alias("label"), none.alias("lows"), none.alias("highs"), "vec"), place, width, kind), size, partitions=partitions)


def _one_part(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(len(x)), np.zeros(len(x))


def graph(sample: DataFrame, n: int, width: int, kind: str, k: int) -> np.ndarray:
    """The k nearest of each of n sampled rows, whose ids are 0..n-1; -1 where there are fewer. n is bounded."""
    cores = sample.sparkSession.sparkContext.defaultParallelism
    held = _packed(sample, _one_part, width, kind, blocks.data_rows(n, cores))
    pairs = held.select(F.col("block").alias("query_block"), "part").join(held.select("block", "part"), "part").select("query_block", "block", F.lit(0.0).alias("ring"))
    found = _best(blocks.scanned(held, held, pairs, 1, lambda at, b: Scan(at, b, kind, k), _FOUND), k).toArrow()
    out = np.full((n, k), -1, np.int64)
    out[np.asarray(found["query_id"]), np.asarray(found["rank"]) - 1] = np.asarray(found["vec_id"])
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 6) -> np.ndarray:
    """The partition of each node: halves along the longest direction, then moves towards the neighbours within a tenth of the mean size."""
    part, n = np.zeros(len(x), np.int64), len(x)
    for _ in range(int(np.log2(parts))):
        new = np.empty_like(part)
        for p in range(part.max() + 1):
            at = np.flatnonzero(part == p)
            if not len(at):
                continue
            centred = x[at] - x[at].mean(0)
            line = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
            new[at[np.lexsort((at, line))]] = 2 * p + (np.arange(len(at)) >= len(at) // 2)
        part = new
    a, b = np.nonzero(near >= 0)
    ends = np.concatenate([np.column_stack([a, near[a, b]]), np.column_stack([near[a, b], a])])
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    starts = np.searchsorted(ends[:, 0], np.arange(n + 1))
    met = np.zeros((n, parts), np.int64)
    np.add.at(met, (ends[:, 0], part[ends[:, 1]]), 1)
    size = np.bincount(part, minlength=parts)
    least, most = int(0.9 * n / parts), int(np.ceil(1.1 * n / parts))
    for _ in range(rounds):
        moved = 0
        gain = met.max(1) - met[np.arange(n), part]
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            old = part[i]
            to = int(np.where(size < most, met[i], -1).argmax())
            if size[old] > least and met[i, to] > met[i, old] and size[to] < most:
                part[i], moved = to, moved + 1
                size[old], size[to] = size[old] - 1, size[to] + 1
                others = ends[starts[i] : starts[i + 1], 1]
                np.add.at(met, (others, np.full(len(others), old)), -1)
                np.add.at(met, (others, np.full(len(others), to)), 1)
        if not moved:
            break
    return part


class Router:
    """One inner layer over standardised components; gives the probability of each partition."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.unit = np.abs(x).max(initial=0) or 1.0  # first, so that no square overflows
        self.mean, self.scale = (x / self.unit).mean(0), np.maximum((x / self.unit).std(0), 1e-9)
        sizes = (x.shape[1], HIDDEN, target.shape[1])
        self.w = [rng.normal(0, (2 / a) ** 0.5, (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        z, held = self._scaled(x), [*self.w, *self.b]
        m, v, t = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
        steps = EPOCHS * -(-len(x) // STEP)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), STEP):
                at = order[i : i + STEP]
                inner = np.maximum(z[at] @ self.w[0] + self.b[0], 0)
                wrong = (self._softmax(inner @ self.w[1] + self.b[1]) - target[at]) / len(at)
                back = (wrong @ self.w[1].T) * (inner > 0)
                grads, t = [z[at].T @ back, inner.T @ wrong, back.sum(0), wrong.sum(0)], t + 1
                rate = 3e-3 * (1 - (t - 1) / steps)
                for j, (p, g) in enumerate(zip(held, grads)):
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                    p -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x / self.unit - self.mean) / self.scale, -30, 30)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(self._scaled(x) @ self.w[0] + self.b[0], 0) @ self.w[1] + self.b[1])


def before(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, before): partitions by falling probability, and the probability of those ahead of each place in that order."""
    order = np.argsort(-p, axis=1, kind="stable")
    held = np.take_along_axis(p, order, 1)
    return order, np.cumsum(held, 1) - held


def fitted(x: np.ndarray, near: np.ndarray, parts: int) -> tuple[Router, float]:
    """The router of a sample and its graph, and the probability up to which a query's partitions are met."""
    part = balanced(x / (np.abs(x).max(initial=0) or 1.0), near, parts)
    target = np.zeros((len(x), parts))
    a, b = np.nonzero(near >= 0)
    np.add.at(target, (a, part[near[a, b]]), 1.0)
    target[np.arange(len(x)), part] += 1.0
    target /= target.sum(1, keepdims=True)
    held_out = np.arange(len(x)) % HELD_OUT == 0 if len(x) > 10 * HELD_OUT else np.ones(len(x), bool)
    learnt = ~held_out if len(x) > 10 * HELD_OUT else held_out
    router = Router(x[learnt], target[learnt])
    p = router(x)
    home = p.argmax(1)  # where rows are stored
    order, ahead = before(p)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(x), 0), 1)
    a, b = np.nonzero((near >= 0) & held_out[:, None])
    if not len(a):
        return router, 1.0
    needed = np.sort(ahead[a, rank[a, home[near[a, b]]]])
    return router, float(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1e-9


def neighbours(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query; both sides hold (id, vec) of numbers."""
    spark = prepare(rows.sparkSession)
    rows = rows.filter("id is not null").select("id", "vec")
    kind = "float32" if dict(rows.dtypes)["vec"] == "array<float>" else "float64"
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    queries = queries.filter("id is not null").groupBy("id").agg(F.min("vec").alias("vec"))
    if not n or not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cores = spark.sparkContext.defaultParallelism
    parts = 2 ** round(np.log2(min(MOST, max(FEWEST, n**0.5 / 4))))
    taken = rows.orderBy(F.xxhash64("id"), "id").select("vec").limit(max(SAMPLE, EACH * parts)).toArrow()["vec"]  # bounded
    x = blocks.matrix(taken, width, np.float64)
    sample = spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(x))), "vec": taken}))
    router, mass = fitted(x, graph(sample, len(x), width, kind, NEIGHBOURS), parts)
    shared = spark.sparkContext.broadcast(router)  # some HIDDEN * (width + parts) numbers

    def place(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (shared.value(v).argmax(1) if len(v) else np.zeros(0)), np.zeros(len(v))

    stored = _packed(rows, place, width, kind, blocks.data_rows(n, cores))
    sizes = np.zeros(parts, np.int64)
    for r in stored.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect():  # a row for each partition
        sizes[r.part] = r.n

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = blocks.matrix(b.column("vec"), width, np.float64)
            if not len(v):
                continue
            order, ahead = before(shared.value(v))
            held = sizes[order]
            met = (ahead < mass) | (np.cumsum(held, 1) - held < ENOUGH * k)
            row, at = np.nonzero(met & (held > 0))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(order[row, at].astype(np.int32)), b.column("vec").take(pa.array(row))], names=["id", "part", "vec"])

    routed = queries.mapInArrow(route, f"id long, part int, vec {dict(queries.dtypes)['vec']}")
    as_bytes = _by_part(routed, width, kind)
    asked = blocks.packed(as_bytes, blocks.QUERY_ROWS, partitions=4 * cores)
    pairs = asked.select(F.col("block").alias("query_block"), "part").join(stored.select("block", "part"), "part").select("query_block", "block", F.lit(0.0).alias("ring"))
    n_shards = max(1, -(-int(sizes.max(initial=1)) // (blocks.RUN * blocks.DATA_ROWS)))
    return _best(blocks.scanned(asked, stored, pairs, n_shards, lambda at, b: Scan(at, b, kind, k), _FOUND), k)


def _by_part(routed: DataFrame, width: int, kind: str) -> DataFrame:
    """Routed queries with their vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = blocks.matrix(b.column("vec"), width, kind)
            n = pa.array([None] * b.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(np.zeros(b.num_rows)), b.column("id"), pa.array(np.zeros(b.num_rows, np.int64)), n, n, pa.array([v.tobytes() for v in whole], pa.binary())], names=["part", "far", "id", "label", "lows", "highs", "vec"])

    return routed.mapInArrow(run, "part int, far double, id long, label long, lows array<long>, highs array<long>, vec binary")
