"""Joins: lookups, guards, cascades, upserts, prefixes, rules."""

from pyspark.sql import functions as F

from partloom.functions.exprs import lookup, split_list
from partloom.operators import match

from .catalog import query


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n_orders, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(orders, '') AS orders FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def catalog_join_nested_parts(t):
    parts = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("parts"))
    both = t.customer.join(parts, F.col("c_custkey") == F.col("o_custkey"), "left")
    held = F.coalesce("parts", F.array().cast("array<bigint>"))
    return both.select("c_custkey", F.size(held).cast("bigint").alias("n_orders"), F.array_join(held.cast("array<string>"), ";").alias("orders"))


BOARDS = {"BUILDING": "Uno;Nano", "MACHINERY": "Due", "HOUSEHOLD": "Mega"}


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Uno;Nano' WHEN 'MACHINERY' THEN 'Due' WHEN 'HOUSEHOLD' THEN 'Mega' ELSE '' END AS boards FROM customer")
def dim_lookup_map(t):
    return t.customer.select("c_custkey", F.coalesce(lookup(F.col("c_mktsegment"), BOARDS), F.lit("")).alias("boards"))


@query("""
WITH g AS (SELECT s_nationkey, count(*) AS n, min(s_name) AS s FROM supplier GROUP BY s_nationkey)
SELECT n_nationkey, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN s END AS matched,
  CASE WHEN n IS NULL THEN 'no_exact_match' WHEN n = 1 THEN 'matched' ELSE 'ambiguous_match' END AS outcome
FROM nation LEFT JOIN g ON s_nationkey = n_nationkey""")
def match_exact_guard(t):
    right = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    return match.exact_guard(t.nation.select("n_nationkey"), right, "n_nationkey", F.col("s_name"))


@query("""
WITH s AS (SELECT s_suppkey, upper(s_name) AS a, replace(upper(s_name), 'SUPPLIER', 'CUSTOMER') AS b, CAST(s_nationkey AS VARCHAR) AS c FROM supplier),
h AS (
  SELECT c_custkey, 0 AS n, 'ref_name' AS rule, s_suppkey FROM customer JOIN s ON upper(c_name) = a
  UNION ALL SELECT c_custkey, 1, 'name', s_suppkey FROM customer JOIN s ON upper(c_name) = b
  UNION ALL SELECT c_custkey, 2, 'line', s_suppkey FROM customer JOIN s ON CAST(c_nationkey AS VARCHAR) = c),
g AS (SELECT c_custkey, n, rule, count(*) AS hits, min(s_suppkey) AS hit FROM h GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n) AS r FROM g)
SELECT customer.c_custkey, coalesce(rule, 'unmatched') AS rule, hits, hit FROM customer LEFT JOIN b ON b.c_custkey = customer.c_custkey AND r = 1""")
def match_cascade(t):
    rules = [("ref_name", F.upper("c_name"), F.upper("s_name")), ("name", F.upper("c_name"), F.replace(F.upper("s_name"), F.lit("SUPPLIER"), F.lit("CUSTOMER"))), ("line", F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string"))]
    return match.cascade(t.customer.select("c_custkey", "c_name", "c_nationkey"), "c_custkey", t.supplier, "s_suppkey", rules).select("c_custkey", "rule", "hits", "hit")


@query("""
WITH a AS (SELECT upper('n' || CAST(s_suppkey AS VARCHAR)) AS k FROM supplier), b AS (SELECT 'N' || CAST(c_custkey * 2 AS VARCHAR) AS k FROM customer)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'inserted' WHEN b.k IS NULL THEN 'left_only' ELSE 'matched' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def match_upsert_full_outer(t):
    left = t.supplier.select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("name"))
    right = t.customer.select(F.concat(F.lit("N"), (F.col("c_custkey") * 2).cast("string")).alias("name"))
    return match.upsert(left, right, "name").select("k", "state")


TEMPLATES = [(b, n, i) for b in ("Brand#11", "Brand#12", "Brand#13", "Brand#2") for i, n in enumerate(["Small", "small widget", "COLD rod", "b", "hot gear"])]
_templates_sql = ", ".join(f"('{b}', '{n}', {i})" for b, n, i in TEMPLATES)


@query(f"""
WITH tp(brand, name, ord) AS (VALUES {_templates_sql}),
b AS (SELECT p_partkey, tp.name AS template, ord,
  CASE WHEN tp.name IS NULL THEN NULL ELSE len(list_filter(range(1, CAST(least(length(p_name), length(tp.name)) AS BIGINT) + 1), lambda i: left(upper(p_name), i) = left(upper(tp.name), i))) END AS prefix
  FROM part LEFT JOIN tp ON brand = p_brand),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY prefix DESC, ord) AS n FROM b)
SELECT p_partkey, template, CAST(prefix AS INTEGER) AS prefix FROM r WHERE n = 1""")
def match_longest_prefix(t):
    templates = t.spark.createDataFrame(TEMPLATES, "p_brand string, template string, ord int")
    found = match.longest_prefix(t.part.select("p_partkey", "p_name", "p_brand"), templates, "p_brand", "p_name", "template", "ord", "p_partkey")
    return found.select("p_partkey", "template", F.col("prefix").cast("int").alias("prefix"))


@query("""
WITH t(segment, target) AS (VALUES ('BUILDING', 'esp32'), ('MACHINERY', 'esp32s3'), ('HOUSEHOLD', 'esp99')), m(target, clock) AS (VALUES ('esp32', 240), ('esp32s3', 241))
SELECT c_custkey, clock, CASE WHEN t.target IS NULL THEN 'no_target' WHEN clock IS NULL THEN 'no_header' ELSE 'matched' END AS reason
FROM customer LEFT JOIN t ON segment = c_mktsegment LEFT JOIN m ON m.target = t.target""")
def match_mapped_key_reasons(t):
    targets = t.spark.createDataFrame([("BUILDING", "esp32"), ("MACHINERY", "esp32s3"), ("HOUSEHOLD", "esp99")], "c_mktsegment string, target string")
    macros = t.spark.createDataFrame([("esp32", 240), ("esp32s3", 241)], "target string, clock int")
    both = t.customer.join(F.broadcast(targets), "c_mktsegment", "left").join(F.broadcast(macros), "target", "left")
    return both.select("c_custkey", "clock", F.when(F.col("target").isNull(), "no_target").when(F.col("clock").isNull(), "no_header").otherwise("matched").alias("reason"))


@query("""
WITH e AS (SELECT o_custkey, o_orderkey % 40 AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
h AS (SELECT o_custkey, pos, s_suppkey, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS r FROM e JOIN supplier ON s_suppkey = item WHERE s_acctbal > 0)
SELECT o_custkey, CAST(pos AS INTEGER) AS pos, s_suppkey FROM h WHERE r = 1""")
def match_exploded_first(t):
    lists = t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: (k % 40).cast("string")), ";").alias("items"))
    known = t.supplier.select(F.col("s_suppkey").cast("string").alias("item"), "s_acctbal")
    found = match.exploded_first(lists, "o_custkey", split_list(F.col("items")), known, "item", F.col("s_acctbal") > 0)
    return found.select("o_custkey", "pos", F.col("item").cast("bigint").alias("s_suppkey"))


@query("SELECT count(*) AS n, sum(o_custkey) AS keys FROM orders WHERE o_custkey + 3 IN (SELECT c_custkey FROM customer)")
def semi_selected(t):
    return t.orders.withColumn("k", F.col("o_custkey") + 3).join(t.customer.select(F.col("c_custkey").alias("k")), "k", "left_semi").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey + 3 NOT IN (SELECT c_custkey FROM customer)")
def anti_missing_fk(t):
    return t.orders.withColumn("k", F.col("o_custkey") + 3).join(t.customer.select(F.col("c_custkey").alias("k")), "k", "left_anti").select("o_orderkey", "o_custkey")


@query("""
SELECT c_custkey, arg_max(r_name || '/' || n_name, n_nationkey) AS description, coalesce(nullif(CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE '' END, ''), max(r_name)) AS filled
FROM customer JOIN nation ON n_regionkey = c_nationkey % 5 JOIN region ON r_regionkey = n_regionkey GROUP BY c_custkey, c_nationkey, c_mktsegment""")
def containment_last_wins(t):
    parents = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").alias("k"), F.concat_ws("/", "r_name", "n_name").alias("description"), F.col("n_nationkey").alias("ord"))
    children = t.customer.withColumn("k", F.col("c_nationkey") % 5)
    found = match.last_enclosing(parents, children, "k", "description", "ord")
    own = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment"))
    return found.select("c_custkey", "description", F.coalesce(F.nullif(own, F.lit("")), F.substring_index("description", "/", 1)).alias("filled"))


@query(r"""
WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages),
w AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^[a-z]+://([^?#]*)', 1) ELSE regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) END AS want FROM pages),
t AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda n: array_to_string(list_slice(string_split(path, '/'), -n, -1), '/'))) AS tail FROM p),
u AS (SELECT tail, min(path) AS path FROM t GROUP BY tail HAVING count(DISTINCT path) = 1)
SELECT page_id, want, coalesce(p.path, u.path) AS matched_path, CASE WHEN p.path IS NOT NULL THEN 'exact' WHEN u.path IS NOT NULL THEN 'unique_suffix' ELSE 'none' END AS how
FROM w LEFT JOIN p ON p.path = want LEFT JOIN u ON u.tail = want""")
def path_suffix_match(t):
    path = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    want = F.when(F.col("page_id") % 2 == 0, path).otherwise(F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^?#]*)", 1))
    return match.path_match(t.pages.select("page_id", want.alias("want")), t.pages.select(path.alias("path")).distinct(), "want", "path")


KINDS = [("fast", "p_size", 40.0), ("cheap", "p_retailprice", 1000.0), ("tall", "p_size", 10.0)]


@query("""
WITH m AS (SELECT p_partkey, 'p_size' AS metric, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part),
r(feature, metric, least) AS (VALUES ('fast', 'p_size', 40.0), ('cheap', 'p_retailprice', 1000.0), ('tall', 'p_size', 10.0))
SELECT p_partkey, string_agg(feature, ';' ORDER BY feature) AS features, CAST(count(*) AS BIGINT) AS n FROM m JOIN r ON r.metric = m.metric AND v >= least GROUP BY p_partkey""")
def rule_table_features(t):
    rules = t.spark.createDataFrame(KINDS, "feature string, metric string, least double")
    long = t.part.select("p_partkey", F.explode(F.create_map(F.lit("p_size"), F.col("p_size").cast("double"), F.lit("p_retailprice"), F.col("p_retailprice"))).alias("metric", "v"))
    hit = long.join(F.broadcast(rules), "metric").filter(F.col("v") >= F.col("least"))
    return hit.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("feature")), ";").alias("features"), F.count("*").alias("n"))
