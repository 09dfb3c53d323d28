"""A training corpus from documents: quality, near duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Rows without an id go through every stage by their text;
extra columns of the documents are carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partloom.llm import bpe, decontam, neardup, pii, quality
from partloom.llm.common import free_name, lookup_join, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the hierarchical classifier rejects; host: source, path: language.

    A null text counts as empty, a null source or language is a group of its own; repeated rows are judged alike;
    without labels of both classes all stay.
    """
    aside = {c: free_name(docs, f"own_{c}") for c in docs.columns if c in ("doc_logit", "site_p", "quality_p", "kept")}
    judged = quality.classify(docs.withColumnsRenamed(aside), table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))
    return judged.filter("kept").select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: that of the smallest id.

    Of rows that repeat an id and a text one stays; an id's different texts are documents of their own, of which one of
    each group stays. Rows without an id, or without words, stay.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    key = ["doc_id", (own := free_name(docs, "text_hash"))]
    stays = free_name(docs, "stays")  # null for a text that stands once and is kept
    texts = found.filter("doc_id is not null").groupBy("doc_id", "component_key", "n_shingles", "kept", F.col("text_hash").alias(own)).agg(F.count("*").alias("n"))
    first = F.when(F.col("n_shingles") == 0, F.col(own)).otherwise(F.min(F.when(F.col("n_shingles") > 0, F.col(own))).over(Window.partitionBy("doc_id", "component_key")))
    ids = written(texts.withColumn(stays, F.col("kept") & (F.col(own) == first)).filter(~F.col(stays) | (F.col("n") > 1)).select(*key, stays))
    kept = lookup_join(docs.withColumn(own, F.xxhash64("text")), ids, key).filter(F.col(stays).isNull() | F.col(stays))
    if ids.filter(stays).isEmpty():
        return kept.select(*docs.columns)
    single = kept.filter(F.col(stays).isNull()).select(*docs.columns)
    repeated = kept.filter(stays).groupBy(*key).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(repeated)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, verbatim or with other parameters.

    Each text of an id is judged on its own; null and empty texts hold nothing; an empty benchmark drops nothing.
    """
    key = free_name(docs, "decontamination_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    leaks = decontam.contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = written(leaks.select(F.col("doc_id").alias(key)).distinct())
    return lookup_join(keyed, leaks, [key], "left_anti").select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in angle brackets; n_chars follows the text. A null text stays null."""
    return pii.replaced(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and what they decode to: doc_id, token_ids, n_tokens, ids_sha256, decoded_sha256. A null text has no tokens."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # written between, so that a task has one Python worker at a time and not one for each direction
    encoded = written(bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_text=False))
    both = bpe.decode(encoded, ranks)
    return both.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("tokens", token_stage),
]

#: SQL can express neither the classifier nor the network nor the merges; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
