"""Language-model scoring by a probabilistic suffix tree.

A text is read as its tokens in their order: words between ASCII white space, A-Z lower-cased, a space after each, then
one end. The symbols are the bytes of this running text; the contexts of a symbol are the up to DEPTH bytes before it,
across the words, so a text's score depends on the order of its words.

1. The tasks count their words, and DEPTH symbols with the next one as one code, over all training texts, and note the
   words and codes of the others with a count of 0; Spark adds the counts up in a table that grows with the corpus.
2. A context is kept as a state only if its next-symbol distribution diverges from its suffix's by more than its counts
   could by chance (likelihood gain against a BIC-like bound), and if it has been seen LEAST_COUNT times, at every size
   of the corpus. Distributions are smoothed toward the suffix's (Witten-Bell). Contexts of up to LOW symbols, whose
   counts are at most 256 ** (LOW + 1), are judged in the driver. Longer ones stay in the table: rows whose contexts
   end in the same LOW + 1 symbols meet in one task, which holds all that a longer context and its suffixes need. Such
   a group differs in DEPTH - LOW symbols only, whatever the size of the corpus.
3. So each code has its log probability in the longest suffix that is a state. Codes and words that make up much of the
   text are looked up in a broadcast table of bounded size, which takes the heat out of the join; the others are joined
   (codes are exact, words go by 63 bits of a hash: among 10^9 words two share one with a chance of 6 in 100).

Beside it stands the add-one unigram score over the same tokens.

Defined results: null texts count as empty (one end token); without training rows every distribution is uniform and
the unigram score is 0; repeated rows are scored alike, each on its own row; null ids are kept; other columns than the
id, the text and those of the training condition are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .neardup import _mix, words_of

#: Symbols before the next one, of 8 bits each: with it they fit into one long. A text's end is a newline, which no word holds; newlines stand before its begin as well.
DEPTH, BITS, LOW = 6, 8, 2
#: Words and codes at most that are looked up in a broadcast table.
HEAVY, HEAVY_CODES = 100_000, 2_000_000
#: Counts that a context needs to be looked at, and the likelihood gain (nats) it needs besides the BIC term.
LEAST_COUNT, LEAST_GAIN = 4, 1.0
#: Sums that a task merges at, and those of them that it keeps on holding rather than sends.
MERGE_AT, HOLD = 3_000_000, 2_000_000
PIECE = 1_000_000  # bytes of texts, or rows of the table, that a task reads at once

#: Texts that are scored at once: with a code, a text's number among them fits into 64 bits.
MOST_TEXTS = 256

_PAD = b"\n" * DEPTH
_MASKS = [(1 << (BITS * d)) - 1 for d in range(DEPTH + 2)]  # of d symbols


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _summed(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(k)
    k = k[order]
    first = _runs(k)
    return k[first], np.add.reduceat(n[order], first) if len(first) else n


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    first = _runs(x)
    return x[first], np.diff(np.append(first, len(x)))


class _Sums:
    """Partial sums of one task: merged when they get long, sent when they stay long."""

    def __init__(self) -> None:
        self.keys, self.counts, self.n = [], [], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        k, n = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts, self.n = [], [], 0
        return _summed(k, n)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)
        if self.n > MERGE_AT:
            k, n = self.merged()
            self.keys, self.counts, self.n = [k], [n], len(k)
            if self.n > HOLD:
                yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            k, n = self.merged()
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["k", "n"])


def running(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts given as words, each after DEPTH newlines; the places of their symbols, and each one's text."""
    parts = [b" ".join([*t, b"\n"]) for t in texts]
    raw = np.frombuffer(b"".join(x for p in parts for x in (_PAD, p)), np.uint8)
    of = np.repeat(np.arange(len(parts)), np.array([len(p) for p in parts], np.int64))
    return raw, np.arange(len(of)) + DEPTH * (of + 1), of


def word_keys(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words and ends at the places of `running`, in their order: below 0, as codes are not; and the number of each one's first place.

    A key sums up hashes of a word's bytes at their places in it.
    """
    body = raw[at]
    solid = np.flatnonzero(body != 32)
    body = body[solid]
    after = np.flatnonzero((np.diff(solid) > 1) | (body[:-1] == 10)) + 1  # a text's begin follows the end before
    first = np.append(0, after) if len(solid) else after
    place = np.arange(len(solid)) - np.repeat(first, np.diff(np.append(first, len(solid))))
    each = _mix(((place << 8 | body) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = _mix(np.add.reduceat(each, first)) if len(first) else each
    return h.view(np.int64) | np.int64(-(2**63)), solid[first]


def pieces(texts: list[str | None], most: int = 2**62) -> Iterator[slice]:
    """Runs of at most so many texts, of about PIECE characters; a longer text is one of its own."""
    first = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > PIECE or i - first == most:
            yield slice(first, i)
            first, held = i, 0
        held += len(t or "")
    if first < len(texts):
        yield slice(first, len(texts))


def codes_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Context of DEPTH symbols and the symbol itself, at each of some rising places."""
    if not len(at):
        return np.zeros(0, np.int64)
    held = np.concatenate([np.zeros(7 - DEPTH, np.uint8), raw[at[0] - DEPTH : at[-1] + 1]])
    eight = np.ndarray(len(held) - 7, ">u8", held, strides=(1,))  # the bytes up to each place, read as one number
    return eight[at - at[0]].astype(np.uint64).view(np.int64) & _MASKS[DEPTH + 1]


def occurrences(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a key (at least 0, of 56 bits) and a text's number (under MOST_TEXTS) in order, and how often each stands."""
    pairs = np.sort(keys.astype(np.uint64) << np.uint64(8) | of.astype(np.uint64))
    first = _runs(pairs)
    own = pairs[first]
    return (own >> np.uint64(8)).astype(np.int64), (own & np.uint64(MOST_TEXTS - 1)).astype(np.int64), np.diff(np.append(first, len(pairs)))


def counts(docs: DataFrame) -> DataFrame:
    """(k, n): all words, and all contexts of DEPTH symbols with their next one, of (text, train), with their counts in the training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for b in batches:
            texts, train = b.column("text").to_pylist(), np.array(b.column("train"), bool)
            for part in pieces(texts):
                for learns in (True, False):
                    held = [words_of(t) for t, mine in zip(texts[part], train[part]) if mine == learns]
                    if not held:
                        continue
                    raw, at, _ = running(held)
                    found = [word_keys(raw, at)[0], *(codes_at(raw, at[i : i + PIECE]) for i in range(0, len(at), PIECE))]
                    for keys in found:
                        k, n = _counted(keys)
                        yield from sums.add(k, n if learns else np.zeros(len(n), np.int64))
        yield from sums.send()

    # the tasks' sums are few: dealt out before Spark adds them up, so that no second table of them is held
    return docs.select("text", "train").mapInArrow(count, "k long, n long").repartition("k").groupBy("k").agg(F.sum("n").alias("n"))


def states(context: np.ndarray, n: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows in the order of their contexts, with counts and the suffix's probabilities: where contexts begin, each row's
    context, which contexts are states, their suffix's weight, and each row's smoothed probability."""
    first = _runs(context)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
    sums = lambda x: np.bincount(of, x, len(first))
    total, kinds = sums(n), sums(n > 0)
    p = (n + kinds[of] * up) / np.maximum(total + kinds, 1)[of]
    gain = sums(np.where(n > 0, n * np.log(np.where(n > 0, p, 1) / up), 0))  # count * divergence from the suffix
    own = (total >= LEAST_COUNT) & (gain >= LEAST_GAIN + 0.5 * np.log(np.maximum(total, 1)))
    return first, of, own, kinds / np.maximum(total + kinds, 1), p


@dataclass
class Tree:
    """The states of up to LOW symbols, by length: codes and probabilities of seen symbols; contexts that are states and their suffix's weight."""

    root: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Of codes' symbols in the longest state of up to LOW symbols."""
        p, todo = np.ones(len(codes)), np.arange(len(codes))
        for d in range(len(self.levels), 0, -1):
            seen, q, contexts, weight = self.levels[d - 1]
            if not len(contexts) or not len(todo):
                continue
            part = codes[todo] & _MASKS[d + 1]
            i = np.minimum(np.searchsorted(seen, part), len(seen) - 1)
            hit = seen[i] == part
            p[todo[hit]] *= q[i[hit]]
            j = np.minimum(np.searchsorted(contexts, part >> BITS), len(contexts) - 1)
            back = ~hit & (contexts[j] == part >> BITS)
            p[todo[back]] *= weight[j[back]]
            todo = todo[~hit]
        p[todo] *= self.root[codes[todo] & _MASKS[1]]
        return p


def grow(codes: np.ndarray, n: np.ndarray) -> Tree:
    """The tree from the counts of LOW symbols and the next one."""
    root = np.full(256, 0.5)
    np.add.at(root, codes & _MASKS[1], n)
    tree = Tree(root / root.sum(), [])
    for d in range(1, LOW + 1):
        code, count = _summed(codes & _MASKS[d + 1], n.astype(np.float64))
        first, of, own, weight, p = states(code >> BITS, count, tree.probabilities(code))
        kept = own[of]
        tree.levels.append((code[kept], p[kept], (code >> BITS)[first][own], weight[own]))
    return tree


def climbed(k: np.ndarray, n: np.ndarray, tree: Tree) -> np.ndarray:
    """log10 probability of codes from the tree of short contexts upward; all codes whose contexts end in the same LOW + 1 symbols are given."""
    p = tree.probabilities(k & _MASKS[LOW + 1])
    for d in range(LOW + 1, DEPTH + 1):
        code, first, inverse = np.unique(k & _MASKS[d + 1], return_index=True, return_inverse=True)
        _, of, own, _, smoothed = states(code >> BITS, np.bincount(inverse, n, len(code)), p[first])
        p = np.where(own[of], smoothed, p[first])[inverse]
    return np.log10(p)


def coded(codes: DataFrame, tree: Tree) -> DataFrame:
    """(k, n, log): each code of (k, n) with its log10 probability."""
    shared = codes.sparkSession.sparkContext.broadcast(tree)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are in the order of their contexts' ends: whole ends are read at once."""
        held, rows = [], 0

        def send(table: pa.Table):
            k, n = np.array(table["k"], np.int64), np.array(table["n"], np.float64)
            log = climbed(k, n, shared.value)
            for i in range(0, len(k), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(n[part].astype(np.int64)), pa.array(log[part].astype(np.float32))], names=["k", "n", "log"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > PIECE // 2:
                table = pa.Table.from_batches(held)
                ends = np.array(table["end"], np.int64)
                cut = int(np.searchsorted(ends, ends[-1]))
                if cut:
                    yield from send(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), len(ends) - cut
        if rows:
            yield from send(pa.Table.from_batches(held))

    end = F.shiftright("k", BITS).bitwiseAND(F.lit(_MASKS[LOW + 1]).cast("long")).alias("end")
    return codes.select("k", "n", end).repartition("end").sortWithinPartitions("end").mapInArrow(climb, "k long, n long, log float")


def fit(docs: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of (text, train) for contexts of up to LOW symbols, and the counts (k, n) of all words (k < 0) and codes."""
    table = written(counts(docs))
    low = F.col("k").bitwiseAND(F.lit(_MASKS[LOW + 1]).cast("long")).alias("k")
    rows = table.filter("k >= 0 and n > 0").groupBy(low).agg(F.sum("n").alias("n")).toArrow()  # at most 256 ** (LOW + 1) rows
    return grow(np.array(rows["k"], np.int64), np.array(rows["n"], np.int64)), table


def heaviest(table: DataFrame, most: int) -> int:
    """A count that at most so many rows of (n) reach."""
    steps = table.filter("n > 0").groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count("*"), F.min("n")).collect()  # a row for each quarter of a power of 2
    least, held = 2**62, 0
    for _, rows, n in sorted(steps, reverse=True):
        held += rows
        if held > most:
            break
        least = n
    return least


def scored(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row; learns from rows where train is true."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    tree, table = fit(docs)
    words = table.filter("k < 0")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, kinds = int(totals[0]), int(totals[1])
    by_code = written(coded(table.filter("k >= 0"), tree))
    # x is what an occurrence adds: to the unigram score for a word, to the score for a code
    tables = [words.select("k", F.log10(F.col("n") + 1).alias("x"), "n"), by_code.select("k", F.col("log").alias("x"), "n")]
    least = [heaviest(words, HEAVY), heaviest(by_code, HEAVY_CODES)]
    heavy = []
    for held, n in zip(tables, least):
        rows = held.filter(F.col("n") >= n).select("k", "x").toArrow()  # at most HEAVY or HEAVY_CODES rows
        k, x = (c.to_numpy() for c in rows.columns)
        order = np.argsort(k)
        heavy.append((k[order], x[order]))
        del rows
    shared = spark.sparkContext.broadcast(heavy)

    def looked_up(of_words: bool, k: np.ndarray, of: np.ndarray, n_texts: int) -> tuple:
        """Over texts: the sum of what heavy keys add, their number; and of the other keys: key, text, occurrences."""
        keys, x = shared.value[0 if of_words else 1]
        if of_words:  # their keys are too long for a pair: the ranks stand for them
            distinct, k = np.unique(k, return_inverse=True)
        k, of, tf = occurrences(k, of)
        k = distinct[k] if of_words else k
        first = _runs(k)
        own = k[first]
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        size = np.diff(np.append(first, len(k)))
        adds = np.repeat(np.where(known, x[at].astype(np.float64), 0) if len(keys) else np.zeros(len(own)), size)
        known = np.repeat(known, size)
        light = ~known
        return np.bincount(of, adds * tf, n_texts), np.bincount(of, known * tf, n_texts), k[light], of[light], tf[light]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of k (a word or code to be joined, or a spare key), row, doc_id, tf, and sums: over a row's rows they are its results."""
        for b in batches:
            every = b.column("text").to_pylist()
            for part in pieces(every, MOST_TEXTS):
                yield from one(every[part], np.array(b.column("row"))[part], b.column("doc_id")[part])

    def one(given: list, row: np.ndarray, doc: pa.Array) -> Iterator[pa.RecordBatch]:
        texts, size = [words_of(t) for t in given], len(given)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        raw, places, text_of = running(texts)
        keys, at = word_keys(raw, places)
        s, known, k, of, tf = looked_up(True, keys, text_of[at], size)
        score, light = np.zeros(size), [(k, of, tf)]
        for i in range(0, len(places), PIECE):
            found = looked_up(False, codes_at(raw, places[i : i + PIECE]), text_of[i : i + PIECE], size)
            score += found[0]
            light.append(found[2:])
        k, of, tf = (np.concatenate(x) for x in zip(*light))
        sums = [pa.array(x) for x in (s, known, score, sizes.astype(np.float64))]
        spare = _mix(row.astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spare), pa.array(row), doc, pa.nulls(size, pa.int32()), *sums], names=names)
        for i in range(0, len(of), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(row[of[part]]), doc.take(pa.array(of[part])), pa.array(tf[part].astype(np.int32)), *[pa.nulls(len(k[part]), pa.float64())] * 4], names=names)

    names = ["k", "row", "doc_id", "tf", "s", "known", "score", "n"]
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).mapInArrow(walk, "k long, row long, doc_id long, tf int, s double, known double, score double, n double")
    rest = [t.filter(F.col("n") < n).select("k", F.col("x").cast("double").alias("x"), (F.col("n") > 0).alias("seen")) for t, n in zip(tables, least)]
    rest = rest[0].unionByName(rest[1])
    met = rows.join(rest, "k", "left")
    added = F.col("tf") * F.col("x")
    plus = lambda extra, name: F.sum(F.coalesce(F.when(F.col("tf").isNull(), F.col(name)).otherwise(extra), F.lit(0.0))).alias(name)
    sums = met.groupBy("row", "doc_id").agg(plus(F.when(F.col("k") < 0, added), "s"), plus(F.when((F.col("k") < 0) & F.col("seen"), F.col("tf").cast("double")), "known"), plus(F.when(F.col("k") >= 0, added), "score"), F.sum("n").alias("n"))
    each = math.log10(tokens + kinds + 1)
    return sums.select("doc_id", F.col("n").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("s") - F.col("n") * each).alias("base_score"), "score")
