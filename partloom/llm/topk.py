"""Exact top-k search by inner product: a Voronoi join.

1. A bounded sample of the data gives the pivots, far from each other. Queries and data go to the cell of their nearest pivot.
2. Each query is solved against the data of its own cell (and near ones, where that is small) first: its k-th score
   there is a bound that the final one reaches. Each cell of queries is summed up: how many, the least of these bounds, the largest norm and distance to the
   pivot. Cells of near pivots are put into groups of up to QUERY_BLOCK queries.
3. For q in cell i (pivot p, radius r, norms up to m) and x in cell j (pivot s, own distance d) the inner product is at
   most p.s + r|s| + d m. So every pair of a data cell and a group has a distance from which on a vector may serve one
   of the group's queries; only such vectors are sent to the group, and once for all of its cells.
4. What meets in a group is solved locally in blocks of bounded size, and the blocks' top k are merged for each query.

Where no bound can prune (directions spread evenly over many dimensions), this is a grid of blocks: a vector is copied
once for each QUERY_BLOCK queries, a query once for each block of data.

Components are whole numbers; sums are exact as long as they stay under 2^63.

Defined results: null vectors, vectors that hold null or non-finite components, and rows without an id take no part;
an empty vector scores 0 with any other; a query's own row is the rows of its id; fewer than k candidates are all
returned; ties go to the smaller id; a query id that is repeated counts once, with its smallest vector; repeated data
rows are candidates each; vectors of different lengths meet as if the shorter went on with zeros; other columns than id
and vec are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup_join, prepare, written

#: Pivots at most (their number is the square root of that of the data), vectors for each that they are chosen from, and rows of a block of queries and of data.
MOST_PIVOTS, SAMPLE, QUERY_BLOCK, DATA_BLOCK = 256, 16, 16_384, 65_536
FOUND = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null, and all components finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole_numbers(vector: Column, times: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * times).cast("long"))


def _matrix(rows: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of int64, the shorter ones filled with zeros."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    n = np.array([len(x) for x in rows], np.int64)
    flat = np.asarray(rows.flatten(), np.int64)
    out = np.zeros((len(n), width), np.int64)
    of = np.repeat(np.arange(len(n)), n)
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n of a sample's vectors, each the one farthest from those before: far clusters are met, repeats are not."""
    near = ((sample - sample[0]) ** 2).sum(1)
    chosen = [0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def assigned(rows: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """(id, vec, cell, far, norm): vectors packed as numbers of one kind, the cell of the nearest pivot, the distance to it and the norm, both rounded up."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            whole = _matrix(b.column("vec"), p.shape[1])
            x = whole.astype(np.float64)
            cell = ((p**2).sum(1) - 2 * x @ p.T).argmin(1) if len(x) else np.zeros(0, np.int64)
            up = lambda y: np.sqrt((y**2).sum(1)) * (1 + 1e-9) + 1e-9
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([v.tobytes() for v in whole.astype(kind)], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(up(x - p[cell])), pa.array(up(x))], names=["id", "vec", "cell", "far", "norm"])

    return rows.mapInArrow(place, "id long, vec binary, cell int, far double, norm double")


def solve(queries: pa.Table, data: pa.Table, k: int, kind: str) -> pa.Table:
    """The k best of a block of data for each of a block of queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not queries.num_rows or not data.num_rows:
        return schema.empty_table()
    unpack = lambda t: np.frombuffer(b"".join(t["vec"].to_pylist()), kind).reshape(t.num_rows, -1)
    a, b = unpack(queries), unpack(data)
    norm = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0)))
    most = norm(a) * norm(b)  # of any partial sum
    number = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    q, ids = np.asarray(queries["id"]), np.asarray(data["id"])
    out = []
    other = b.T.astype(number)
    for i in range(0, len(q), 128):
        for row, query in zip(a[i : i + 128].astype(number) @ other, q[i : i + 128]):
            open_ = np.flatnonzero(ids != query)  # the query's own rows may be among the best
            if len(open_) > k:
                held = row[open_]
                open_ = open_[held >= np.partition(held, len(held) - k)[len(held) - k]]
            best = open_[np.lexsort((ids[open_], -row[open_]))[:k]]
            out.append((np.full(len(best), query), ids[best], row[best].astype(np.int64)))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)


def met(asked: DataFrame, sent: DataFrame, key: list[str], k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): the k best for each query in each block."""
    return asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(lambda a, b: solve(a, b, k, kind), FOUND)


def homes(pivots: np.ndarray, queries: dict[int, int], data: dict[int, int], k: int) -> list[tuple]:
    """(query_cell, cell, query_blocks, data_blocks): the data cells that a cell of queries is tried against first, its own and near ones with 4 * k rows together."""
    out = []
    for i, m in queries.items():
        held, near = 0, []
        for j in np.argsort(((pivots - pivots[i]) ** 2).sum(1), kind="stable").tolist():
            if held >= 4 * k:
                break
            if j in data:
                near.append(j)
                held += data[j]
        out += [(i, j, max(1, ceil(m / QUERY_BLOCK)), max(1, ceil(held / DATA_BLOCK))) for j in near]
    return out


def reached(q: DataFrame, d: DataFrame, home: list[tuple], k: int, kind: str) -> DataFrame:
    """(id, least): a score that the k-th of each query reaches, by the data of its home cells, in blocks of bounded size."""
    near = d.sparkSession.createDataFrame(home, "query_cell int, cell int, query_blocks int, data_blocks int")  # at most 4 * k rows for each pivot
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col(n)).cast("int")
    sent = d.join(F.broadcast(near), "cell").select("query_cell", own("data_blocks").alias("data_block"), parts("query_blocks").alias("query_block"), "id", "vec")
    asked = q.withColumnRenamed("cell", "query_cell").join(F.broadcast(near.drop("cell").distinct()), "query_cell")
    asked = asked.select("query_cell", own("query_blocks").alias("query_block"), parts("data_blocks").alias("data_block"), "id", "vec")
    found = met(asked, sent, ["query_cell", "query_block", "data_block"], k, kind)
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    return found.select(F.col("query_id").alias("id"), "score", last.alias("n")).filter(F.col("n") == k).select("id", F.col("score").alias("least"))


def grouped(pivots: np.ndarray, queries: dict[int, int]) -> list[list[int]]:
    """Cells with their queries, near ones together, in groups of up to QUERY_BLOCK queries (or one cell)."""
    left, groups, held, at = set(queries), [], 0, None
    while left:
        at = min(left) if at is None else min(left, key=lambda j: (((pivots[j] - pivots[at]) ** 2).sum(), j))
        left.discard(at)
        if not groups or held + queries[at] > QUERY_BLOCK:
            groups.append([])
            held = 0
        groups[-1].append(at)
        held += queries[at]
    return groups


def routes(pivots: np.ndarray, query_cells: list, data_cells: list, groups: list[list[int]]) -> list[tuple]:
    """(cell, group, least_far): from which distance on a vector of a data cell may serve a group. query_cells: cell, radius, norm, bound."""
    size, dots = np.sqrt((pivots**2).sum(1)), pivots @ pivots.T
    held = {i: (r, norm, least) for i, r, norm, least in query_cells}
    out = []
    for g, cells in enumerate(groups):
        for j, farthest in data_cells:
            far = np.inf
            for i in cells:
                r, norm, least = held[i]
                if least is None:
                    far = 0.0
                    break
                # rounding of the pivots' products is left out of the bound
                middle = dots[i, j] + r * size[j]
                far = min(far, (least - middle - 1e-9 * (abs(least) + abs(middle) + 1)) / norm)
            if far <= farthest:
                out.append((int(j), g, float(max(far, 0.0))))
    return out


def routed(queries: DataFrame, data: DataFrame, k: int) -> tuple[DataFrame, DataFrame, str] | None:
    """Queries and data (group, query_block, data_block, id, vec) as they are dealt out, and the kind of their numbers; None without any."""
    spark = prepare(queries.sparkSession)
    queries = queries.filter("id is not null").groupBy("id").agg(F.min("vec").alias("vec"))
    data = data.filter("id is not null").select("id", "vec")
    largest = F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))))
    n, width, most = data.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(largest, F.lit(0.0))).first()
    n_queries, query_width, query_most = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(largest, F.lit(0.0))).first()
    if not n or not n_queries:
        return None
    width, most = max(width, query_width, 1), max(most, query_most)
    kind = "int16" if most < 2**15 else "int32" if most < 2**31 else "int64"
    n_pivots = min(MOST_PIVOTS, max(4, ceil(n**0.5)))
    sample = data.orderBy(F.xxhash64("id"), "id").select("vec").limit(SAMPLE * n_pivots).toArrow()  # bounded
    pivots = spread(_matrix(sample["vec"], width).astype(np.float64), n_pivots)
    d, q = written(assigned(data, pivots, kind)), written(assigned(queries, pivots, kind))
    cells = {r.cell: r for r in d.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row for each pivot
    asked = {r.cell: r.n for r in q.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    q = written(lookup_join(q, reached(q, d, homes(pivots, asked, {c: r.n for c, r in cells.items()}, k), k, kind), ["id"]))
    summed = q.groupBy("cell").agg(F.max("far"), F.max("norm"), F.when(F.count("least") == F.count("*"), F.min("least"))).collect()
    groups = grouped(pivots, asked)
    near = routes(pivots, [tuple(r) for r in summed], [(c, r.far) for c, r in cells.items()], groups)
    plans = []
    for g, members in enumerate(groups):
        sent = sum(cells[j].n for j, h, _ in near if h == g)
        smaller = ceil(2 * spark.sparkContext.defaultParallelism / len(groups))  # few groups: smaller blocks, so that all cores work
        plans.append((g, max(1, ceil(sum(asked[i] for i in members) / QUERY_BLOCK)), max(1, ceil(sent / DATA_BLOCK), min(smaller, ceil(sent / 1024)))))
    by_group = spark.createDataFrame(plans, "group int, query_blocks int, data_blocks int")  # at most MOST_PIVOTS rows
    near = F.broadcast(spark.createDataFrame(near, "cell int, group int, least_far double").join(F.broadcast(by_group), "group"))  # at most MOST_PIVOTS ** 2 rows
    members = F.broadcast(spark.createDataFrame([(i, g) for g, held in enumerate(groups) for i in held], "cell int, group int").join(F.broadcast(by_group), "group"))
    parts = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    sent = d.join(near, "cell").filter(F.col("far") >= F.col("least_far"))
    sent = sent.select("group", parts("query_blocks").alias("query_block"), F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("data_blocks")).cast("int").alias("data_block"), "id", "vec")
    dealt = q.join(members, "cell").select("group", F.pmod(F.xxhash64("id"), F.col("query_blocks")).cast("int").alias("query_block"), parts("data_blocks").alias("data_block"), "id", "vec")
    return dealt, sent, kind


def search(queries: DataFrame, data: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products for each query; both sides hold (id, vec) of whole numbers."""
    if (dealt := routed(queries, data, k)) is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = met(dealt[0], dealt[1], ["group", "query_block", "data_block"], k, dealt[2])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
