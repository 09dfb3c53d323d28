"""Language identification by words first, with backoff to character n-grams.

A known word is scored by its log frequency in each language. A word that no language knows falls back to its longest
known character n-grams (5 to 1 letters, with word ends marked), each step shorter at a fixed penalty, which is the
same for all languages. The model is fitted on a bounded sample of labelled rows; its tables are bounded by their
parameters and broadcast.

Defined results: a null text, or one without a letter, is `und` with score 0; so is everything if no labelled row has
a letter; ties go to the first language in alphabetical order; repeated rows give repeated results; texts are read
whole; other columns are kept, but for those named as the results.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, prepare, without

#: The model's bounds: labelled documents for each language, words and n-grams (of each length) for each language.
DOCS_PER_LANG, WORDS_PER_LANG, GRAMS_PER_LANG, LONGEST = 400, 20_000, 5_000, 5
#: Added count of what a language has not seen, and the penalty (natural log) for each step of backoff.
UNSEEN, STEP = 0.5, 0.7
#: Evidence of more words than this counts as of this many in the score, which else is 1 for any long text.
EVIDENCE_WORDS = 20
CACHE_WORDS = 400_000
WORD = re.compile(r"[^\W\d_]+")


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Tables of log frequencies: words, and n-grams of each length -> a row of the matrix, one column a language."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], tables: dict[int, dict[str, np.ndarray]]):
        self.langs, self.words, self.tables = langs, words, tables

    def vector(self, word: str) -> np.ndarray | None:
        """Log evidence of a lower-cased word for each language; None without a letter."""
        if not (word := letters(word)):
            return None
        if (known := self.words.get(word)) is not None:
            return known
        for step, n in enumerate(range(LONGEST, 0, -1), 1):
            table = self.tables.get(n, {})
            if found := [table[g] for g in grams(word, n) if g in table]:
                return np.mean(found, axis=0) - step * STEP
        return np.zeros(len(self.langs))


def _logs(counts: dict[str, Counter], langs: list[str], most: int) -> dict[str, np.ndarray]:
    kept = {x for k in langs for x, _ in sorted(counts[k].items(), key=lambda p: (-p[1], p[0]))[:most]}
    totals = [sum(counts[k].values()) + UNSEEN * (len(kept) + 1) for k in langs]
    return {x: np.array([np.log((counts[k].get(x, 0) + UNSEEN) / t) for k, t in zip(langs, totals)]) for x in kept}


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Fit on at most docs_per_lang rows of each language, those first by a hash of `order`.

    Counting is done in the tasks: each sends its words and n-grams with their counts, which Spark adds up.
    """
    spark = prepare(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(order).cast("string")).alias("h")).filter("text is not null and lang is not null")
    per = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    # hashes are even over the longs: a share of each language, three deviations under its bound
    limit = F.lit(None).cast("double")
    for k, n in per.items():
        share = min(1.0, max(1.0, docs_per_lang - 3 * docs_per_lang**0.5) / n) if n > docs_per_lang else 1.0
        limit = F.when(F.col("lang") == k, F.lit((share * 2 - 1) * 2.0**63)).otherwise(limit)
    sample = rows.filter(F.col("h").cast("double") <= limit).select("lang", "text")

    def count(batches):
        counts: Counter = Counter()
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in Counter(map(letters, WORD.findall(t.lower()))).items():
                    if w:
                        counts[k, 0, w] += n
                        for size in range(1, LONGEST + 1):
                            for g in grams(w, size):
                                counts[k, size, g] += n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.string()), pa.array([x[1] for x in keys], pa.int32()), pa.array([x[2] for x in keys], pa.string()), pa.array([counts[x] for x in keys], pa.int64())], names=["lang", "size", "item", "n"])

    from pyspark.sql.window import Window

    sums = sample.mapInArrow(count, "lang string, size int, item string, n long").groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "item"))
    top = sums.withColumn("rank", first).filter(F.col("rank") <= F.when(F.col("size") == 0, WORDS_PER_LANG).otherwise(GRAMS_PER_LANG))
    counts: dict[int, dict[str, Counter]] = {size: {k: Counter() for k in per} for size in range(LONGEST + 1)}
    for r in top.select("lang", "size", "item", "n").toArrow().to_pylist():  # bounded by the parameters
        counts[r["size"]][r["lang"]][r["item"]] = r["n"]
    langs = sorted(k for k in per if counts[0][k])
    return Model(langs, _logs(counts[0], langs, WORDS_PER_LANG) if langs else {}, {n: _logs(counts[n], langs, GRAMS_PER_LANG) for n in range(1, LONGEST + 1)} if langs else {})


class _Scorer(dict):
    """word -> its row in a matrix that grows; row 0 is for what has no letter."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.rows = np.zeros((1024, len(self.model.langs)))
        self.n = 1

    def __missing__(self, word: str) -> int:
        v = self.model.vector(word)
        if v is None:
            self[word] = 0
            return 0
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = v
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        langs = self.model.langs
        at = np.fromiter(map(self.__getitem__, WORD.findall((text or "").lower())), dtype=np.int64)
        at = at[at > 0]
        if not len(at) or not langs:
            found = ("und", 0.0)
        else:
            mean = self.rows[at].mean(axis=0)
            e = np.exp((mean - mean.max()) * min(len(at), EVIDENCE_WORDS))
            best = int(mean.argmax())
            found = (langs[best], float(e[best] / e.sum()))
        if len(self) > CACHE_WORDS:
            self.reset()
        return found


_held: dict[int, tuple] = {}


def _scorer(shared) -> _Scorer:
    if id(shared.value) not in _held:
        _held.clear()
        _held[id(shared.value)] = (_Scorer(shared.value), shared.value)
    return _held[id(shared.value)][0]


def predict(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and a score from 0 to 1 (its posterior, over at most EVIDENCE_WORDS words)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def judged(texts: pa.Array) -> pa.Array:
        scorer = _scorer(shared)
        found = [scorer.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang", "score"])

    docs = without(docs, lang_out, score_out)
    held = free_name(docs, "judged")
    return docs.withColumn(held, judged(F.col(text))).withColumn(lang_out, F.col(f"{held}.lang")).withColumn(score_out, F.col(f"{held}.score")).drop(held)
