"""The pipeline's stages on a small table, each against a plain version of its decision."""

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from partloom.llm import bpe, neardup, pii, quality
from partloom.llm.common import written

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], FOLDER)))
    assert [d.columns for d in seen[1:-1]] == [columns] * 4
    start, good, unique, clean, masked, tokens = [{r.doc_id: r for r in d.collect()} for d in seen]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum((d in good) == (q == 1) for d, q in labels.items()) / len(labels) > 0.97
    sets = {d: set(neardup.shingles(neardup.words_of(r.text)).tolist()) for d, r in good.items()}
    by_shingle = {}
    for d in unique:  # no two that stay are near copies
        for s in sets[d]:
            by_shingle.setdefault(s, []).append(d)
    close = {(a, b) for ds in by_shingle.values() for a in ds for b in ds if a < b}
    assert not [p for p in close if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    for d in set(good) - set(unique):  # what goes has a near copy
        assert any(len(sets[d] & s) >= 0.8 * len(sets[d] | s) for k, s in sets.items() if k != d and s)
    items = [r.text.lower().split() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holds = lambda t: any(" ".join(w) in " ".join(t.lower().split()) for w in items)
    assert not any(holds(r.text) for r in clean.values()) and len(unique) - len(clean) < 0.1 * len(unique)
    assert set(masked) == set(clean) == set(tokens)
    for d, r in masked.items():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        assert pii.base_spans(clean[d].text) or "<" in r.text or r.text == clean[d].text
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.token_ids == encoding.encode_ordinary(masked[d].text) for d, r in tokens.items())


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, repeats, ids with several texts, extra columns and very long texts go through all stages."""
    same = "the same text twice over again"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "plain words here and there", None, "s", 26), (3, same, "en", "s", 30), (3, same, "en", "s", 30), (4, same.title(), "en", "s", 30), (3, "another text of the same id", "en", "s", 27), (7, "word " * 60_000, None, None, 300_000), (8, "x" * 200_000 + " " + "9" * 50_000 + " Abc" * 20_000, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("extra")).withColumn("stays", F.lit("own")).withColumn("text_hash", F.lit(1))
    spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)))
        if name == "near_duplicates":
            assert sorted(((r.doc_id, len(r.text or "")) for r in docs.collect()), key=str) == sorted([(1, 0), (2, 0), (None, 26), (3, 27), (3, 30), (7, 300_000), (8, 330_001)], key=str)
        if name != "tokens":
            assert {(r.kept, r.stays, r.text_hash) for r in docs.collect()} == {("extra", "own", 1)}
    assert docs.count() == 7
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, FOLDER))
    assert empty.count() == 0


def test_a_worker_drops_the_encoder_before_quality():
    """Workers serve one stage after another; the encoder of an earlier table stayed beside what quality needs."""

    class Shared:
        value = {bytes([b]): b for b in range(256)}

    bpe._encoder(Shared, public_tokenizers.PATTERN)
    assert bpe._held
    quality.features("some text")
    assert not bpe._held


def test_quality_takes_one_python_worker_a_task(spark):
    """The filter on what is kept got a null check of its own, for which each text was judged twice."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made = corpus_pipeline.quality_stage(spark, docs, FOLDER)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    judged = written(quality.classify(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), host=F.col("source"), path=F.col("lang")))
    expected = sorted(r.doc_id for r in judged.filter("kept").collect())
    assert sorted(r.doc_id for r in made.collect()) == expected and 0 < len(expected) < docs.count()


def test_personal_data_takes_one_python_worker_a_task(spark):
    rows = [(1, "write to ann.lee@example.org or call +1 555 010 9999 now"), (2, "nothing here"), (3, None), (4, ""), (5, "from 10.0.0.1 and bob (at) example (dot) com, card 4111 1111 1111 1111"), (5, "again 10.0.0.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    made = corpus_pipeline.personal_data_stage(spark, docs, FOLDER)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    found = pii.detect(docs, out="spans").withColumn("text", pii.masked(F.col("text"), F.col("spans")))
    expected = sorted(map(tuple, found.select("doc_id", "text", F.length("text").cast("long")).collect()), key=str)
    assert sorted(map(tuple, made.collect()), key=str) == expected and any("<EMAIL>" in str(r) for r in expected)
