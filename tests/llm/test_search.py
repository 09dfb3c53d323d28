"""Filter audit, hard negatives and learned partitions against brute force."""

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from partloom.llm import annuli, audit, blocks, partitions, topk


def brute_audit(docs, labels):
    first, marks = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        m = (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + 8 * any(c in "#$%&*|" for c in t)
        m += 16 * (i is not None and i > first[t])
        good, toxic = (any(l[0] == i and i is not None and l[k] == 1 for l in labels) for k in (1, 2))
        marks.setdefault(lang or "", []).append((m, good, toxic))
    out = []
    for part, held in marks.items():
        for order in permutations("ABCDE"):
            seen = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [x for x in held if x[0] & bit and not x[0] & seen]
                value = sum(120 // bin(x[0]).count("1") for x in held if x[0] & bit)
                out.append((part, "".join(order), step, sum(not x[0] & (seen | bit) for x in held), len(gone), sum(bool(x[0] & bit and x[0] & seen) for x in held), sum(x[0] == bit for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone), value))
                seen |= bit
    return sorted(out)


def test_audit_follows_brute_force(spark):
    words = " ".join(f"w{i}" for i in range(250))
    docs = [(1, words, "en"), (2, words, "fr"), (3, words + " #", "en"), (4, "A B C", None), (5, None, "en"), (6, "", "en"), (7, "x " * 400, "fr"), (7, "x " * 400, "fr"), (8, "Ä   \x0b\x1c\x85", "en"), (None, words, "en"), (9, "ABC " + "z" * 500_000, ""), (10, words.upper() + "|", "fr"), (11, "x " * 400, "de")]
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, None), (7, 1, 0), (None, 1, 1), (99, 1, 1), (10, None, 1), (11, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("same", F.lit(1)).withColumn("good", F.lit(3))
    got = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1)), F.col("lang")).collect()
    assert sorted(map(tuple, got)) == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(df, labels, F.col("lang")).count() == 0
    assert audit.audit(spark.createDataFrame([(1, "a", None)], df.schema), labels, F.col("lang")).count() == 600


def brute_negatives(rows, every):
    rows = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v is not None]
    width = max(len(v) for _, _, v in rows)
    rows = [(i, l, np.pad(np.array(v), (0, width - len(v)))) for i, l, v in rows]
    anchors = {}
    for i, l, v in rows:
        if i % every == 0 and (i not in anchors or (v.tolist(), l) < (anchors[i][1].tolist(), anchors[i][0])):
            anchors[i] = (l, v)
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted(((-int(q @ v), i, l) for i, l, v in rows if i != a), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            near = [(x, i) for x, i, l in scored if l != label and 50 * -s <= 100 * -x <= 95 * -s][:3]
            out += [(a, p, r, i, -s, -x) for r, (x, i) in enumerate(near, 1)]
    return sorted(out)


def vectors(seed, n, clusters, dims=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    v = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_hard_negatives_follow_brute_force(spark):
    rng = np.random.default_rng(3)
    whole = np.floor(256 * np.concatenate([vectors(1, 500, 6), vectors(2, 300, 300)])).astype(int)
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(whole)]
    rows += [(2000 + i, i % 3, rows[5][2]) for i in range(300)]  # one very common vector
    rows += [(5, 1, rows[5][2]), (10, 2, rows[11][2]), (10, 0, rows[11][2]), (None, 1, rows[0][2]), (3000, None, rows[0][2]), (3010, 1, None), (3020, 2, [0] * 8), (3030, 2, [-5] * 8), (3040, 9, [1, 2]), (3050, 9, [1, 2])]
    df = spark.createDataFrame(rows, "id long, label int, vec array<long>").withColumn("part", F.lit(1))
    got = annuli.hard_negatives(df, F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 10)


def test_hard_negatives_of_little(spark):
    schema = "id long, label int, vec array<long>"
    assert annuli.hard_negatives(spark.createDataFrame([], schema), F.col("id") % 10 == 0).count() == 0
    one = [(10, 1, [3, 4])]
    for rows in (one, [*one, (11, 1, [3, 5])], [*one, (11, 2, [3, 5])], [*one, (11, 1, [30, 50]), (12, 2, [20, 40]), (13, 2, None)], [(11, 1, [1])]):
        assert sorted(map(tuple, annuli.hard_negatives(spark.createDataFrame(rows, schema), F.col("id") % 10 == 0).collect())) == brute_negatives(rows, 10)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [int(x) for x in rng.integers(0, 2**30, 3)]) for i in range(200)]
    got = annuli.hard_negatives(spark.createDataFrame(rows, "id long, label int, vec array<long>"), F.col("id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 20)


def test_annuli_keep_far_blocks_back(spark, monkeypatch):
    """On clustered rows only a part of the blocks meets the block of queries of one cluster."""
    monkeypatch.setattr(blocks, "data_rows", lambda n, cores: 32)
    whole = np.floor(256 * vectors(4, 2000, 40, spread=0.02)).astype(int)
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(whole)], "id long, label long, vec array<long>")
    index = annuli.Index(rows)
    high = int(whole[7] @ whole[7])
    ask = rows.filter("id = 7").select("*", F.array(F.lit(int(0.98 * high)).cast("long")).alias("lows"), F.array(F.lit(2**63 - 1)).alias("highs"))
    held = blocks.packed(blocks.placed(ask, lambda x: (np.zeros(len(x)), np.zeros(len(x))), index.width, index.kind), 64, 1)
    sent = annuli.routes(held, index, 1).count()
    assert 0 < sent < 0.5 * index.n_blocks


def brute_near(rows, every, k):
    """query -> its nearest (distance, id), nearest first."""
    width = max(len(v) for _, v in rows)
    wide = [(i, np.pad(np.array(v, np.float64), (0, width - len(v)))) for i, v in rows]
    ids, all_ = np.array([i for i, _ in wide]), np.array([v for _, v in wide])
    out = {}
    for i, v in wide:
        if i % every == 0:
            d = np.sqrt(((all_ - v) ** 2).sum(1))
            out[i] = [(d[j], ids[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def recall(got, true):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hits = total = 0
    for q, near in true.items():
        mine = sorted(found.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1)), q
        assert [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine)
        hits += len({i for _, i in near} & {i for _, _, i in mine})
        total += len(near)
    return hits / total


def test_learned_partitions_reach_the_recall(spark):
    for seed, clusters, spread in ((1, 30, 0.1), (2, 2000, 1.0)):
        v = vectors(seed, 3000, clusters, 16, spread).astype(np.float32)
        rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000 + i, v[3].tolist()) for i in range(1000)]
        df = spark.createDataFrame(rows, "id long, vec array<float>").withColumn("part", F.lit(1))
        got = partitions.neighbours(df.filter("id % 50 = 0"), df).collect()
        assert recall(got, brute_near(rows, 50, 10)) >= 0.9
        by = dict(rows)
        assert all(r.score == np.sqrt(((np.array(by[r.query_id]) - np.array(by[r.vec_id])) ** 2).sum()) for r in got)


def test_learned_partitions_of_little(spark):
    def asked(rows, kind="double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        df = df.filter(topk.usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        return partitions.neighbours(df.filter("id % 10 = 0"), df, k=3).collect()

    odd = [(None, [1.0]), (10, None), (20, [None, 1.0]), (30, [float("nan")]), (40, [float("inf")]), (50, [0.0, 0.0]), (60, [])]
    assert asked([]) == [] and asked(odd) == []
    rows = [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [1.0]), (101, [3.0, 3.0]), (100, [9.0, 9.0]), (110, [1e300, 1.0])]
    got = asked(rows + odd)
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got)] == [(100, 1, 101), (100, 2, 102), (100, 3, 101), (110, 1, 100), (110, 2, 100), (110, 3, 101)]


def test_partitions_are_balanced_and_follow_the_graph():
    v = vectors(7, 1200, 12, 6)
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    near = np.argsort(d, 1)[:, 1:11]
    part = partitions.balanced(v, near, 8)
    size = np.bincount(part, minlength=8)
    assert size.min() >= 0.9 * 150 - 1 and size.max() <= np.ceil(1.1 * 150)
    assert (part[near] == part[:, None]).mean() > 0.8
