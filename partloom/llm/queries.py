"""The queries opN_<name> and pipeline over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(topk.usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), topk.whole_numbers(F.col("embedding")).alias("vec"))
    return topk.search(rows.filter("id % 20 = 0"), rows, k=20)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85).drop("text_hash", "component_key")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    pages = html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = langid.fit(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.classify(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))
    return judged.select("doc_id", "doc_logit", "site_p", "quality_p", "kept")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pst

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pst.scored(docs, ~held_out).withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep_text=False), ranks)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Rules of op10 (action, host, path), and the hosts that its list blocks: labels of spam sites under each domain of the pages' kind.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SPAM_LABELS, SPAM_DOMAINS = "ads-track casino-win cheap-pills spam-farm".split(), "example.com example.net example.org".split()
LISTED_URLS = [(f"{label}.{domain}", "/") for label in SPAM_LABELS for domain in SPAM_DOMAINS]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    listed = spark.createDataFrame(LISTED_URLS, "host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit.audit(docs, table(spark, sf_dir, "labels"), part=F.col("lang"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import annuli, topk

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").filter(topk.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), topk.whole_numbers(F.col("embedding"), 256).alias("vec"))
    return annuli.hard_negatives(rows, F.col("id") % 50 == 0)


def op13_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import partitions, topk

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(topk.usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    return partitions.neighbours(rows.filter("id % 100 = 0"), rows, k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_main_text": op3_main_text,
    "op4_personal_data": op4_personal_data,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_decontamination": op8_decontamination,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_url_filters": op10_url_filters,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_learned_partitions": op13_learned_partitions,
}

ORACLES: dict[str, str] = {}

ORACLES["op10_url_filters"] = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)),
rules(action, rhost, rpath) AS (VALUES
""" + ",\n".join(f"  ('{a}', '{h}', '{x}')" for a, h, x in URL_RULES) + r"""),
listed(lhost, lpath) AS (VALUES
""" + ",\n".join(f"  ('{h}', '{x}')" for h, x in LISTED_URLS) + r"""),
d AS (SELECT DISTINCT host, path FROM p),
best AS (
  SELECT host, path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action DESC) AS n
  FROM d JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
c AS (
  SELECT host, path, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS chost,
         CASE WHEN path = '' THEN '/' ELSE path END AS cpath
  FROM d),
hit AS (
  SELECT DISTINCT host, path FROM c JOIN listed ON (chost = lhost OR ends_with(chost, '.' || lhost)) AND starts_with(cpath, lpath))
SELECT p.page_id, p.host, p.path, best.rule,
       coalesce(best.action, CASE WHEN hit.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p
LEFT JOIN best ON best.host = p.host AND best.path = p.path AND best.n = 1
LEFT JOIN hit ON hit.host = p.host AND hit.path = p.path
"""

ORACLES["op1_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.vec, d.vec) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op2_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, documents.doc_id = c.component_id AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN c ON c.doc_id = documents.doc_id
"""

ORACLES["op11_filter_audit"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic, bit_count(mask) AS fails
  FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
f(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS earlier
  FROM o, range(1, 6) r(step))
SELECT part, filter_order, step,
       CAST(sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN mask & bit <> 0 THEN n * 120 // fails ELSE 0 END) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""

ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, d.vec_id, q.label = d.label AS same, CAST(list_dot_product(q.vec, d.vec) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
