"""Parsers, keys, formats and text helpers."""

from pyspark.sql import functions as F

from partloom.functions import exprs as X

from .catalog import query

TEXTS = ["42", " 7 ", "3.9", "-2", "0x20", "0b101", "0o17", "(1U)", "(0x40UL)", "64K", "1.5 MB", "512", "2*16", "abc", "", "nan", "12 channels", "N/A", "16d", "3F", "1e3", ".5", "5."]
_texts_sql = ", ".join(f"('{x}')" for x in TEXTS)


@query(rf"""
WITH t(x) AS (VALUES {_texts_sql}),
n AS (SELECT x, CASE WHEN isnan(try_cast(x AS DOUBLE)) THEN NULL ELSE CASE WHEN regexp_full_match(trim(x), '[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?') THEN try_cast(trim(x) AS DOUBLE) END END AS number,
  regexp_extract(x, '(-?\d+(?:\.\d+)?)', 1) AS f, lower(trim(x)) AS l, regexp_replace(regexp_replace(trim(x), '^\(+\s*|\s*\)+$', '', 'g'), '(?i)([0-9a-f])[ul]+$', '\1') AS c FROM t),
b AS (SELECT *, list_transform(['0x:16', '0b:2', '0o:8'], lambda p: 1) AS z FROM n)
SELECT x, number, CAST(trunc(number) AS BIGINT) AS whole, CASE WHEN l NOT IN ('', 'n/a', 'na', 'none', '-', 'no') AND f <> '' THEN CAST(f AS DOUBLE) END AS first,
  CASE c WHEN '0x20' THEN 32 WHEN '0b101' THEN 5 WHEN '0o17' THEN 15 WHEN '0x40' THEN 64 WHEN '1' THEN 1 ELSE CASE WHEN regexp_full_match(c, '[+-]?(0|[1-9]\d*)') THEN CAST(c AS BIGINT) END END AS c_int,
  CASE WHEN number >= 0 AND number = floor(number) THEN CAST(number AS BIGINT) END AS counted,
  CASE x WHEN '64K' THEN 65536 WHEN '1.5 MB' THEN 1572864 ELSE CAST(trunc(try_cast(regexp_extract(x, '^\s*(\d+(?:\.\d+)?)', 1) AS DOUBLE)) AS BIGINT) END AS bytes,
  try_cast(nullif(split_part(x, '*', 2), '') AS DOUBLE) AS second
FROM b""")
def num_parsers(t):
    x = F.col("x")
    df = t.spark.createDataFrame([(v,) for v in TEXTS], "x string")
    return df.select("x", X.number(x).alias("number"), X.whole(x).alias("whole"), X.first_number(x).alias("first"), X.c_integer(x).alias("c_int"), X.count_of(x).alias("counted"), X.memory_bytes(x).alias("bytes"), X.pair(x, "*")[1].alias("second"))


@query(r"""
SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_name || ' ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug,
  trim(regexp_replace(lower(p_brand || '. ' || p_type), '[^\p{L}\p{N}]', '-', 'g'), '-') AS slug_each, trim(regexp_replace(lower('#' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug_plain,
  CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS code FROM part""")
def slug_ids(t):
    return t.part.select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), X.slug_each(F.concat_ws(". ", "p_brand", "p_type")).alias("slug_each"), X.slug_plain(F.concat(F.lit("#"), "p_type")).alias("slug_plain"), X.without_prefix(F.col("p_brand"), F.lit("Brand#")).alias("code"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN 'TR' ELSE '' END AS code FROM orders),
b AS (SELECT *, CASE WHEN ends_with(code, 'TR') THEN left(code, length(code) - 2) ELSE code END AS body FROM s)
SELECT o_orderkey, CASE WHEN ends_with(code, 'TR') THEN 'TR' ELSE '' END AS packing, substr(body, 1, 1) AS package, substr(body, 2) AS rest FROM b""")
def suffix_decode(t):
    s = t.orders.select("o_orderkey", F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "TR").otherwise("")).alias("code"))
    reel = F.endswith("code", F.lit("TR"))
    body = F.when(reel, F.substring("code", F.lit(1), F.length("code") - 2)).otherwise(F.col("code"))
    return s.select("o_orderkey", F.when(reel, "TR").otherwise("").alias("packing"), F.substring(body, 1, 1).alias("package"), F.substring(body, F.lit(2), F.length(body)).alias("rest"))


@query(r"""
WITH t AS (SELECT p_partkey, p_size * 1000000 AS hz, p_size * 1024 AS n FROM part)
SELECT p_partkey, regexp_replace(printf('%.3f', hz / 1000000.0), '\.?0+$', '') || ' MHz' AS clock,
  CASE WHEN n >= 1048576 THEN regexp_replace(printf('%.2f', n / 1048576.0), '\.?0+$', '') || ' MB' ELSE regexp_replace(printf('%.2f', n / 1024.0), '\.?0+$', '') || ' KB' END AS memory FROM t WHERE hz >= 1000000""")
def format_units(t):
    return t.part.filter("p_size >= 1").select("p_partkey", X.clock_text((F.col("p_size") * 1000000).cast("double")).alias("clock"), X.memory_text((F.col("p_size") * 1024).cast("double")).alias("memory"))


@query(r"""
WITH w AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS x FROM part)
SELECT p_partkey, regexp_matches(x, '(^|[^a-z0-9])(promo|economy|rod)([^a-z0-9]|$)') AS accelerator, NOT regexp_matches(x, '(^|[^a-z0-9])(promo|economy|rod)([^a-z0-9]|$)') AND contains(x, 'widget') AS special FROM w""")
def feature_split(t):
    x = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    fast = x.rlike(r"(?<![a-z0-9])(promo|economy|rod)(?![a-z0-9])")
    return t.part.select("p_partkey", fast.alias("accelerator"), (~fast & F.contains(x, F.lit("widget"))).alias("special"))


CATEGORIES = {"A": "Timers", "N": "Serial", "R": "Analog"}


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Timers' WHEN 'N' THEN 'Serial' ELSE 'Analog' END AS g, l_returnflag AS r, l_linestatus AS n FROM lineitem WHERE l_quantity <> 0),
d AS (SELECT l_orderkey, g || ':' || n AS label, r, n, min(l_linenumber) AS pos FROM f GROUP BY l_orderkey, g, r, n)
SELECT l_orderkey, string_agg(label, ';' ORDER BY pos, r, n) AS labels FROM d GROUP BY l_orderkey""")
def inventory_labels(t):
    rows = t.lineitem.filter("l_quantity <> 0").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("xs"))
    labels = F.array_distinct(F.transform("xs", lambda x: F.concat_ws(":", X.lookup(x["l_returnflag"], CATEGORIES), x["l_linestatus"])))
    return rows.select("l_orderkey", F.array_join(labels, ";").alias("labels"))


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE c_mktsegment || ';BUILDING' END AS listed,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'tools' WHEN 'BUILDING' THEN 'house' ELSE c_mktsegment END AS alias,
  coalesce(CASE WHEN starts_with(c_mktsegment, 'A') THEN c_mktsegment END, 'last') AS picked, trim('"' || c_name || '"', '"') AS scalar FROM customer""")
def text_helpers(t):
    seg = F.col("c_mktsegment")
    codes = F.array(seg, F.lit("last"))
    picked = F.coalesce(F.try_element_at(F.filter(codes, lambda c: F.startswith(c, F.lit("A"))), F.lit(1)), F.element_at(codes, -1))
    alias = F.coalesce(X.lookup(seg, {"MACHINERY": "tools", "BUILDING": "house"}), seg)
    return t.customer.select("c_custkey", X.joined_once(seg, F.lit("BUILDING")).alias("listed"), alias.alias("alias"), picked.alias("picked"), F.btrim(F.concat(F.lit('"'), "c_name", F.lit('"')), F.lit('"')).alias("scalar"))


@query("""
WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size + 0.5 ELSE -0.25 END AS x, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.75' WHEN 1 THEN '' ELSE 'n/a' END AS s FROM part)
SELECT p_partkey, CASE WHEN x IS NULL THEN '' WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS compact,
  coalesce(CAST(CAST(trunc(try_cast(nullif(s, '') AS DOUBLE)) AS BIGINT) AS VARCHAR), '') AS numeric, coalesce(CAST(CAST(trunc(try_cast(nullif(s, '') AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR), '') AS scaled FROM v""")
def number_texts(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    x = F.when(k % 4 == 1, size.cast("double")).when(k % 4 == 2, size + 0.5).when(k % 4 == 3, -0.25)
    s = F.when(k % 3 == 0, F.concat(size.cast("string"), F.lit(".75"))).when(k % 3 == 1, "").otherwise("n/a")
    return t.part.select("p_partkey", X.compact_number(x).alias("compact"), X.numeric_text(s).alias("numeric"), X.scaled_text(s, 1000).alias("scaled"))


@query("""
SELECT p_partkey, '{"a":"' || p_brand || '","m":"' || CAST(p_size AS VARCHAR) || '","z":"' || p_name || '"}' AS record FROM part""")
def canonical_json(t):
    held = F.create_map(F.lit("z"), F.col("p_name"), F.lit("a"), F.col("p_brand"), F.lit("m"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.to_json(X.canonical_map(held)).alias("record"))
