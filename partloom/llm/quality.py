"""Quality by hierarchical empirical Bayes.

A logistic classifier over a text's character, word and line statistics gives each document's evidence. Grouped
aggregation of the classifier's probabilities gives each host a posterior that is shrunk toward the global rate, and
each path of a host one that is shrunk toward its host's; how strongly follows, for each of the two levels, from the
spread between its groups (method of moments). The final log odds replace the classifier's global prior by the posterior of the document's path.

Defined results: a null text counts as empty; a null host or path is a group of its own; without labels of both
classes every document is kept at probability 0.5; repeated rows get equal results; a labelled id that stands for
several texts teaches with the first of them in order; an id that is labelled twice has its mean label; texts are read
whole; other columns are kept, but for those named as the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, free_name, lookup_join, prepare, without, written

#: The classifier is fitted on at most so many labelled rows of each class, those first by a hash of their id.
LABELS_PER_CLASS = 2_000
#: A document is kept if its final probability of good quality is at least this.
KEEP = 0.5
#: How far a site's posterior may move a document's log odds.
SITE_WEIGHT, SITE_MOST = 0.5, 2.0

_SIGNS = np.zeros((256, 7))
for _c in range(256):
    _ch = chr(_c)
    _SIGNS[_c] = (_ch in "#$%&*<>{}[]\\^_`~|=@", _c < 128 and _ch.isupper(), _c < 128 and _ch.isdigit(), _ch in "!?", _ch in ".,;:'\"()-", _ch in " \t\n\r\x0b\x0c", _c >= 128 or _ch.isalpha())
N_FEATURES = 17


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; every one is bounded."""
    alone("quality")
    raw = (text or "").encode()
    n = len(raw)
    f = np.zeros(N_FEATURES)
    if not n:
        f[0] = 1
        return f
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _SIGNS / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    distinct, total = len(set(words)), max(1, len(words))
    f[1:8] = share
    f[8] = distinct / total  # repeated words
    f[9] = distinct / max(1.0, min(total, 10 * total**0.5))  # the same, allowing for length
    f[10] = len(set(lines)) / max(1, len(lines))
    f[11] = min(n / total, 40) / 40
    f[12] = np.log10(1 + total) / 5
    f[13] = min(1.0, share[0] * 10)
    f[14] = min(1.0, share[1] * 5)
    f[15] = min(1.0, share[3] * 10)
    f[16] = float(total < 10)
    return f


def train(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> dict:
    """Ridge logistic regression by Newton steps on standardised features and their squares; the classes keep their shares."""
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / sd
    z = np.hstack([np.ones((len(z), 1)), z, np.clip(z, -5, 5) ** 2])
    w, eye = np.zeros(z.shape[1]), np.eye(z.shape[1]) * ridge * len(z)
    eye[0, 0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + eye + 1e-9 * np.eye(len(w)), z.T @ (y - p) - eye @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "sd": sd, "w": w}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    z = (x - model["mean"]) / model["sd"]
    return np.hstack([np.ones((len(z), 1)), z, np.clip(z, -5, 5) ** 2]) @ model["w"]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = LABELS_PER_CLASS) -> dict | None:
    """Fit on a bounded sample of the labels; None without both classes. A document labelled twice has its mean label."""
    prepare(docs.sparkSession)
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    sample = [marks.filter("good" if k else "not good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (False, True)]
    chosen = sample[0].unionByName(sample[1])  # at most 2 * per_class rows

    def read(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t).tolist() for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], names=["x", "good"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"))
    rows = texts.select("text", "good").mapInArrow(read, "x array<double>, good boolean").toArrow()  # at most 2 * per_class rows
    y = np.array(rows["good"].to_pylist(), dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    shares = {r[0]: r[1] for r in marks.groupBy("good").count().collect()}
    x = np.array(rows["x"].to_pylist())
    order = np.lexsort(np.vstack([x.T, y]))  # the same fit whatever the order of the rows
    model = train(x[order], y[order])
    # the sample may be balanced: put the classes' true shares back into the intercept
    model["prior"] = float(np.log(shares[True] / shares[False]))
    model["w"][0] += model["prior"] - np.log(y.mean() / (1 - y.mean()))
    return model


def evidence(text: Column, model: dict | None, spark) -> Column:
    """The classifier's log odds of good quality; never null, and named so: else a filter on them is given a null check, for which every text is judged once more by a second Python worker."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def odds(texts: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in texts.to_pylist()]).reshape(-1, N_FEATURES)
        return pa.array(log_odds(shared.value, x))

    return F.coalesce(odds(text), F.lit(0.0))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def strength(variance: float, between: float, chance: float) -> float:
    """Weight m of a beta prior, in rows: spread between groups beyond chance = variance / (m + 1)."""
    return min(max(variance / max(between - chance, 1e-6) - 1, 1.0), 1e4)


def posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, site_p) from (host, path, p): grouped sums, shrunk path -> host -> global."""
    paths = written(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("host_s"), F.sum("n").alias("host_n"), F.count("*").alias("paths"), F.sum(F.pow(F.col("s"), 2) / F.col("n")).alias("path_q"))
    p = F.col("host_s") / F.col("host_n")
    unlike = F.col("host_n") * p * (1 - p)  # host_n times the variance within a host of one rate
    whole = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n"), F.sum(F.pow(F.col("host_s"), 2) / F.col("host_n")).alias("q"), F.count("*").alias("k"), F.sum(unlike).alias("v"), F.sum(unlike / F.col("host_n") * (F.col("paths") - 1)).alias("chance"), F.sum("path_q").alias("path_q")).first()
    if not whole["n"]:
        return paths.select("host", "path", F.lit(0.5).alias("site_p"))
    rate = min(max(whole["s"] / whole["n"], 1e-6), 1 - 1e-6)
    at_hosts = strength(rate * (1 - rate), whole["q"] / whole["n"] - rate**2, rate * (1 - rate) * (whole["k"] - 1) / whole["n"])
    at_paths = strength(whole["v"] / whole["n"], (whole["path_q"] - whole["q"]) / whole["n"], whole["chance"] / whole["n"])
    by_host = hosts.select("host", ((F.col("host_s") + at_hosts * rate) / (F.col("host_n") + at_hosts)).alias("host_p"))
    both = lookup_join(paths, by_host, ["host"])
    return both.select("host", "path", ((F.col("s") + at_paths * F.col("host_p")) / (F.col("n") + at_paths)).alias("site_p"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", keep: float = KEEP) -> DataFrame:
    """docs with doc_logit (classifier), site_p (its path's posterior), quality_p (both) and kept.

    The texts are read twice: once for the sites' sums and once for the decisions; nothing is held between.
    """
    spark = prepare(docs.sparkSession)
    docs = without(docs, "doc_logit", "site_p", "quality_p", "kept")
    model = fit(docs, labels)
    odds = evidence(F.col(text), model, spark)
    group = [F.coalesce(host.cast("string"), F.lit("\0")).alias("host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("path")]
    sites = posteriors(docs.select(*group, odds.alias("o")).select("host", "path", (1 / (1 + F.exp(-F.col("o")))).alias("p")))
    site = free_name(docs, "quality_site")
    held = docs.withColumn(site, F.struct(*group)).withColumn("doc_logit", odds)
    held = lookup_join(held, sites.select(F.struct("host", "path").alias(site), "site_p"), [site]).drop(site)
    shift = _logit(F.col("site_p")) - F.lit(0.0 if model is None else model["prior"])
    final = F.col("doc_logit") + F.greatest(F.least(SITE_WEIGHT * shift, F.lit(SITE_MOST)), F.lit(-SITE_MOST))
    return held.withColumn("quality_p", 1 / (1 + F.exp(-final))).withColumn("kept", F.col("quality_p") >= keep)
