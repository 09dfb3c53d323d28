"""MinHash near-duplicates: one-permutation hashing with optimal densification, bands, star-shaped candidate edges.

1. Every text's set of word shingles is hashed once: its size, a 128-bit fingerprint of the set, a one-permutation
   signature of BINS values whose empty bins borrow from filled ones (optimal densification), and BANDS band keys.
2. Texts of one fingerprint are one node, so exact copies cost one row from here on, however many there are.
3. In each bucket every node gets one candidate edge to the bucket's smallest node: a star, so n nodes make n - 1
   pairs. Pairs whose sizes rule the similarity out are dropped, the rest are confirmed on the full sets.
4. Confirmed links are joined to components by alternating large and small stars.
5. A star's centre need not be similar to two members that are similar to each other. So in buckets that still hold
   nodes of several components, the nodes outside the centre's component are tried against those of other components,
   and the components are joined again. Before a pair is made, its similarity is bounded by what both share with the
   bucket's centre (counted in step 3) and by their other shingles less those that no other node of such buckets has.
   That keeps copies of one text with edits of their own from being paired with each other. What is left is tried by
   the signatures' agreement (five deviations under the threshold) and then on the full sets.

Defined results: null texts and texts without words have an empty set, are linked with nothing and kept; a row
without an id is linked with nothing and kept, with a null component; rows that repeat an id and text are one
document; of several rows with one id and different texts each is in its own text's component; columns other than the
id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, keeps, lookup_join, prepare, written

#: 36 bands of 7 rows: two sets of similarity 0.8 miss each other in all of them with a chance of 2 in 10,000, of 0.85 one in a million.
SHINGLE, BINS, BANDS, ROWS = 5, 256, 36, 7
#: Standard deviations by which equal bins of two signatures may stay under the threshold.
DEVIATIONS = 5
#: Words whose hashes a worker keeps (some 20 MB); emptied when full, which changes nothing but time.
CACHE_WORDS = 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_odd = np.random.default_rng(20240501).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()
keeps("neardup", _words.clear)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; the whole sequence is one if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    alone("neardup")
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        return _mix(np.array([(h * _odd[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    total = h[: len(h) - size + 1] * _odd[0]
    for k in range(1, size):
        total = total + h[k : len(h) - size + 1 + k] * _odd[k]
    return np.unique(_mix(total))


def signature(held: np.ndarray) -> np.ndarray:
    """One permutation: the least hash of each bin (its top bits); an empty bin takes that of the first filled bin of its own random sequence."""
    bins = (held >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]] = held[first]
    filled[bins[first]] = True
    empty, t = np.flatnonzero(~filled), 0
    while len(empty):
        to = (_mix(empty.astype(np.uint64) * _odd[40] + np.array([t], np.uint64) * _odd[41]) & np.uint64(BINS - 1)).astype(np.int64)
        met = filled[to]
        out[empty[met]] = out[to[met]]
        empty, t = empty[~met], t + 1
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    parts = signatures[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    return _mix((_mix(parts) * _odd[:ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * _odd[50]).view(np.int64)


def fingerprint(held: np.ndarray) -> bytes:
    both = np.array([_mix(held ^ _odd[60]).sum(), (_mix(held ^ _odd[61])).sum() + np.uint64(len(held))], np.uint64)
    return both.tobytes()


def signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, fp, bands, sig) for each row of (doc_id, text, text_hash)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, prints, sigs = [], [], np.zeros((b.num_rows, BINS), np.uint64)
            for i, t in enumerate(b.column("text")):  # one set at a time
                held = shingles(words_of(t.as_py()), size)
                sizes.append(len(held))
                prints.append(fingerprint(held))
                if len(held):
                    sigs[i] = signature(held)
            keys = band_keys(sigs)
            offsets = pa.array(np.arange(0, (len(sizes) + 1) * BANDS, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array([bytes(x) for x in sigs.astype(np.uint8)], pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "fp", "bands", "sig"],
            )

    return docs.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, fp binary, bands array<long>, sig binary")


def texts_of(needed: DataFrame, docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(fp, text) of the nodes in needed (fp): their documents are fetched by id and held against the fingerprint, since a repeated id may have other texts."""
    wanted = needed.distinct().join(nodes.select("fp", "id"), "fp").select("fp", F.col("id").alias("doc_id"))

    @F.arrow_udf(T.BooleanType())
    def own(texts: pa.Array, prints: pa.Array) -> pa.Array:  # of both sides of the join, so that it runs on its result
        return pa.array([fingerprint(shingles(words_of(t), size)) == p for t, p in zip(texts.to_pylist(), prints.to_pylist())])

    found = lookup_join(docs.filter("doc_id is not null"), wanted, ["doc_id"], "inner").filter(own("text", "fp"))
    return written(found.groupBy("fp").agg(F.first("text").alias("text")))


def lone_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(fp, lone): of each node the number of shingles that no other node of texts has."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(words_of(t), size) for t in b.column("text").to_pylist()]
            node = np.array([int.from_bytes(p[:8], "little", signed=True) for p in b.column("fp").to_pylist()], np.int64)
            h, of = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64), np.repeat(node, [len(s) for s in sets])
            for i in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 200_000]), pa.array(of[i : i + 200_000])], names=["h", "node"])

    held = texts.mapInArrow(spread, "h long, node long").groupBy("h").agg(F.count("*").alias("c"), F.max("node").alias("node")).filter("c = 1")
    lone = held.groupBy("node").agg(F.count("*").alias("lone"))

    @F.arrow_udf(T.LongType())
    def node_of(prints: pa.Array) -> pa.Array:
        return pa.array([int.from_bytes(p[:8], "little", signed=True) for p in prints.to_pylist()], pa.int64())

    return texts.select("fp", node_of("fp").alias("node")).join(lone, "node", "left").select("fp", F.coalesce("lone", F.lit(0)).alias("lone"))


def counted(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """pairs (a, b and more) with `shared`: the size of the intersection of their full sets, of the whole texts."""

    @F.arrow_udf(T.LongType())
    def shared(left: pa.Array, right: pa.Array) -> pa.Array:
        out, before, own = [], None, np.zeros(0, np.uint64)
        for x, y in zip(left, right):
            x = x.as_py()
            if x != before:  # pairs of one star often follow each other
                before, own = x, shingles(words_of(x), size)
            out.append(len(np.intersect1d(own, shingles(words_of(y.as_py()), size), assume_unique=True)))
        return pa.array(out, pa.int64())

    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")
    return written(both.withColumn("shared", shared("ta", "tb")).drop("ta", "tb"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of (a, b): root is the smallest node that is reachable. Alternating stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, component_key, kept) for each row: links have 100 * intersection >= percent * union.

    text_hash is xxhash64 of the text, component_key a hash of the component: they tell an id's different texts apart.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(signed(docs.withColumn("text_hash", F.xxhash64("text")), size))
    nodes = written(
        rows.filter("doc_id is not null and n_shingles > 0")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    member = nodes.select(F.explode("bands").alias("key"), "fp", "id", "n")
    buckets = member.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "fp", "n")).alias("centre")).filter("c > 1").drop("c")
    buckets = written(buckets)
    in_buckets = member.join(buckets, "key")
    star = written(in_buckets.filter("fp <> centre.fp").filter(fits(F.col("n"), F.col("centre.n"))).select(F.col("centre.fp").alias("a"), F.col("fp").alias("b"), F.col("centre.n").alias("na"), F.col("n").alias("nb")).distinct())
    star = counted(star, texts_of(star.select(F.col("a").alias("fp")).union(star.select(F.col("b").alias("fp"))), docs, nodes, size), size)
    linked_by = lambda df: df.filter(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")
    roots = components(linked_by(star))

    # what the stars leave open: nodes outside their centre's component
    rooted = in_buckets.select("key", "fp", "n", F.col("centre.fp").alias("centre")).join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = rooted.join(roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root")), "centre", "left").withColumn("centre_root", F.coalesce("centre_root", "centre"))
    apart = written(rooted.filter("root <> centre_root").select("key", "fp", "n", "root"))
    if not apart.isEmpty():
        in_open = written(rooted.join(apart.select("key").distinct(), "key").select("key", "fp", "n", "root", "centre"))
        open_texts = texts_of(in_open.select("fp"), docs, nodes, size)
        lone = lone_shingles(open_texts, size)
        in_open = in_open.join(lone, "fp").filter(100 * (F.col("n") - F.col("lone")) >= percent * F.col("n"))
        in_open = in_open.join(star.select(F.col("a").alias("centre"), F.col("b").alias("fp"), "shared"), ["centre", "fp"], "left")
        # in common with the centre at most (all, where their sizes kept them from being counted), and elsewhere at most
        in_open = written(in_open.withColumn("there", F.coalesce("shared", "n")).withColumn("off", F.col("n") - F.col("lone") - F.coalesce("shared", F.lit(0))))
        one = in_open.join(apart.select("key", "fp"), ["key", "fp"], "left_semi").select("key", "fp", "n", "root", "there", "off")
        rest = in_open.filter("fp <> centre").select("key", *[F.col(c).alias(f"{c}2") for c in ("fp", "n", "root", "there", "off")])
        most = F.least("there", "there2") + F.least("off", "off2")
        possible = (one["key"] == rest["key"]) & (F.col("root") != F.col("root2")) & fits(F.col("n"), F.col("n2")) & (100 * most >= percent * (F.col("n") + F.col("n2") - most))
        tried = one.join(rest, possible).select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()

        @F.arrow_udf(T.BooleanType())
        def agree(left: pa.Array, right: pa.Array, smaller: pa.Array) -> pa.Array:
            x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, BINS) for s in (left, right))
            p, n = percent / 100, np.minimum(np.asarray(smaller), BINS)
            return pa.array((x == y).mean(axis=1) >= p - DEVIATIONS * np.sqrt(p * (1 - p) / n))

        sig = lambda k: nodes.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
        held = tried.join(sig("a"), "a").join(sig("b"), "b")
        more = written(held.filter(agree("sa", "sb", F.least("na", "nb"))).select("a", "b", "na", "nb"))
        extra = linked_by(counted(more, open_texts, size))
        if not extra.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(extra))

    linked = nodes.select("fp", "id", "copies").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    smallest = linked.filter("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    named = linked.join(smallest, "root", "left").filter("copies > 1 or root is not null").select("fp", F.coalesce("component_id", "id").alias("component_id"), F.xxhash64(F.coalesce("root", "fp")).alias("component_key"))
    out = lookup_join(rows.select("doc_id", "text_hash", "n_shingles", "fp"), named, ["fp"])
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"), F.coalesce("component_key", F.xxhash64("fp")).alias("component_key"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
