"""Rollups, array aggregates, scores and validation."""

from pyspark.sql import functions as F

from partloom.functions import features
from partloom.functions.exprs import log_score, summed_roles, weighted_score
from partloom.operators import rollup, score, validate

from .catalog import query


@query("""
WITH c AS (SELECT n_regionkey, count(*) AS n_customers, count(DISTINCT c_nationkey) AS n_nations, count(DISTINCT (c_nationkey, c_mktsegment)) AS n_segments FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey),
o AS (SELECT n_regionkey, count(*) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey)
SELECT r_name, coalesce(n_nations, 0) AS n_nations, coalesce(n_segments, 0) AS n_segments, coalesce(n_customers, 0) AS n_customers, coalesce(n_orders, 0) AS n_orders,
  CASE WHEN n_orders IS NULL THEN 'not_imported' WHEN n_orders >= 10 * n_customers THEN 'complete' ELSE 'partial' END AS status
FROM region LEFT JOIN c ON c.n_regionkey = r_regionkey LEFT JOIN o ON o.n_regionkey = r_regionkey""")
def coverage_summary(t):
    # orders are counted by customer before the hierarchy is joined on: one shuffle of the big table
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    both = t.customer.join(per, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    c = both.groupBy("n_regionkey").agg(F.countDistinct("c_nationkey").alias("n_nations"), F.countDistinct("c_nationkey", "c_mktsegment").alias("n_segments"), F.count("*").alias("n_customers"), F.sum("n").alias("n_orders"))
    out = t.region.join(F.broadcast(c), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    status = F.when(F.col("n_orders").isNull(), "not_imported").when(F.col("n_orders") >= 10 * F.col("n_customers"), "complete").otherwise("partial")
    return out.select("r_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_nations", "n_segments", "n_customers", "n_orders")], status.alias("status"))


@query("""
SELECT c_nationkey, c_mktsegment, arg_min(c_name, c_custkey) AS first_c_name, count(*) AS n,
  array_to_string(list_sort(list(DISTINCT CAST(c_custkey % 10 AS VARCHAR))), ';') AS items FROM customer GROUP BY c_nationkey, c_mktsegment""")
def line_rollup_first_attrs(t):
    return rollup.line_rollup(t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey", ["c_name"], (F.col("c_custkey") % 10).cast("string"))


# the lines of an order as an array of features, exact sources being those shipped late
_FEATURES = """
f AS (SELECT l_orderkey, lower(l_returnflag) AS type, lower(l_linestatus) AS name, l_quantity AS q, l_discount > 0.08 AS exact FROM lineitem),
m AS (SELECT l_orderkey, q, exact, bool_or(exact) OVER (PARTITION BY l_orderkey) AS any_exact FROM f WHERE (type = 'r' OR contains(name, 'o')) AND NOT contains(name, 'x'))"""


def _order_features(t):
    text = lambda c: F.col(c).cast("string")
    entry = F.create_map(F.lit("type"), F.col("l_returnflag"), F.lit("name"), F.col("l_linestatus"), F.lit("count"), text("l_quantity"), F.lit("source_kind"), F.when(F.col("l_discount") > 0.08, "microchip_atdf").otherwise("cmsis"))
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_list(entry).alias("features"))


@query(f"""
WITH {_FEATURES.strip()}, s AS (SELECT l_orderkey, sum(q) AS total FROM m WHERE exact OR NOT any_exact GROUP BY l_orderkey),
d AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT d.l_orderkey, total FROM d LEFT JOIN s ON s.l_orderkey = d.l_orderkey""")
def array_conditional_sum(t):
    return _order_features(t).select("l_orderkey", features.count_of(F.col("features"), ["R"], ["o"], ["x"]).alias("total"))


@query("""
WITH f AS (SELECT l_orderkey, l_returnflag AS t, l_quantity AS q, l_discount > 0.08 AS exact FROM lineitem)
SELECT l_orderkey, coalesce(max(q) FILTER (exact), max(q)) AS top, CASE WHEN count(*) FILTER (t = 'A') = 0 THEN 'unknown' WHEN bool_or(q <> 0) FILTER (t = 'A') THEN 'yes' ELSE 'no' END AS has_a,
  count(*) FILTER (t <> 'A') AS n_after FROM f GROUP BY l_orderkey""")
def array_max_presence(t):
    fs = F.col("features")
    kept = features.replaced(F.filter(fs, lambda f: f["type"] != "A"), "none", F.array().cast(features.FEATURES))
    return _order_features(t).select("l_orderkey", features.max_preferring(fs, "microchip_atdf").alias("top"), features.presence(fs, ["A"]).alias("has_a"), F.size(kept).cast("bigint").alias("n_after"))


@query("""
SELECT lang, CASE WHEN count(quality) = 0 THEN 'unknown' WHEN bool_or(quality = 0) THEN 'yes' ELSE 'no' END AS any_low, count(*) FILTER (quality IS NULL) AS n_unknown
FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id GROUP BY lang""")
def tri_state_presence(t):
    both = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    low = F.when(F.count("quality") == 0, "unknown").when(F.bool_or(F.col("quality") == 0), "yes").otherwise("no")
    return both.groupBy("lang").agg(low.alias("any_low"), F.count_if(F.col("quality").isNull()).alias("n_unknown"))


PROCESSORS = [("a", '[{"Dcore":"Cortex-M4","Dfpu":"SP_FPU","DcoreCount":"2"}]'), ("b", '[{"Dcore":"Cortex-M0","Dfpu":""}]'), ("c", '[{"Dcore":"Cortex-M33","Dfpu":"NO_FPU"},{"Dcore":"Cortex-M7","Dfpu":"unknown"}]'), ("d", "[]"), ("e", "not json"), ("f", '[{"Dcore":"Cortex-M7"}]')]


@query("""
WITH e(i, flag, fpu, n_cores, best) AS (VALUES (0, 'yes', 'yes', 2, 40), (1, 'unknown', 'no', 1, 10), (2, 'no', 'no', 2, 90), (3, 'unknown', 'unknown', 0, NULL), (4, 'unknown', 'unknown', 0, NULL), (5, 'unknown', 'unknown', 1, 90))
SELECT c_custkey, flag, fpu, n_cores, best FROM customer JOIN e ON i = c_custkey % 6""")
def ranked_max_and_counts(t):
    cell = F.element_at(F.array(*[F.lit(c) for _, c in PROCESSORS]), (F.col("c_custkey") % 6 + 1).cast("int"))
    p = t.customer.select("c_custkey", features.decoded(cell).alias("p"))
    ranks = {"cortex-m0": 10, "cortex-m4": 40, "cortex-m33": 70, "cortex-m7": 90}
    return p.select("c_custkey", features.flag(F.col("p"), "Dfpu").alias("flag"), features.fpu(F.col("p"), ["Cortex-M0"]).alias("fpu"), features.core_count(F.col("p")).alias("n_cores"), features.best_rank(F.transform("p", lambda x: x["Dcore"]), ranks).alias("best"))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ';') AS priorities FROM orders GROUP BY o_custkey")
def distinct_sorted_collect(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"))


@query("""
SELECT l_orderkey, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS n_a, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'N') AS n_n, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS n_r, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'Z') AS n_z
FROM lineitem GROUP BY l_orderkey""")
def zero_filled_type_counts(t):
    return rollup.zero_filled(t.lineitem, "l_orderkey", "l_returnflag", "l_suppkey", ["A", "N", "R", "Z"])


@query("""
SELECT lang, CAST(round_even(avg(n_chars), 0) AS BIGINT) AS average, count(*) FILTER (n_chars >= 2000) AS n_long, CAST(round_even(100.0 * count(*) FILTER (n_chars >= 2000) / count(*), 0) AS BIGINT) AS percent
FROM documents GROUP BY lang""")
def avg_and_thresholds(t):
    long = F.count_if(F.col("n_chars") >= 2000)
    return t.documents.groupBy("lang").agg(F.bround(F.avg("n_chars"), 0).cast("bigint").alias("average"), long.alias("n_long"), F.bround(100.0 * long / F.count("*"), 0).cast("bigint").alias("percent"))


@query("""
SELECT l_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_returnflag = 'N') AS DECIMAL(28,2)) AS ram, max(l_quantity) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS flash FROM lineitem GROUP BY l_suppkey""")
def memory_classify_sums(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("decimal(18,2)"))).alias("ram"), F.max(F.when((F.col("l_returnflag") != "N") & (F.col("l_linestatus") == "F"), F.col("l_quantity"))).alias("flash"))


@query("SELECT c_nationkey, count(*) AS count FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def dup_keys(t):
    return rollup.duplicate_keys(t.customer, "c_nationkey")


@query("SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus || chr(10), '' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY o_custkey")
def manifest_digest(t):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"], F.lit("\n")))
    return t.orders.groupBy("o_custkey").agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"))


@query("SELECT l_orderkey, min(l_quantity) AS low, max(l_quantity) AS high, count(*) FILTER (l_tax > 0.04) AS n_taxed FROM lineitem GROUP BY l_orderkey")
def explode_minmax(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count_if(F.col("l_tax") > 0.04).alias("n_taxed"))


@query("SELECT event_type, min(event_id) AS first_seen, count(*) AS n FROM events GROUP BY event_type")
def group_first_seen(t):
    return rollup.first_seen(t.events, "event_type", "event_id")


@query("""
SELECT p_partkey, CASE WHEN p_retailprice > 0 THEN CAST(round_even(least(100, greatest(0, 100 * (log2(p_retailprice) - log2(900.0)) / (log2(2000.0) - log2(900.0)))), 6) AS DECIMAL(12,6)) END AS score FROM part""")
def log_scores(t):
    return t.part.select("p_partkey", F.bround(log_score(F.col("p_retailprice"), 900, 2000), 6).cast("decimal(12,6)").alias("score"))


@query("""
WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN least(100, c_acctbal / 100) END AS a, CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey * 4.0 END AS b, CASE WHEN c_custkey % 2 = 0 THEN 50.0 END AS c FROM customer),
w AS (SELECT *, CASE WHEN a IS NULL THEN 0.0 ELSE 60.0 END + CASE WHEN b IS NULL THEN 0.0 ELSE 25.0 END + CASE WHEN c IS NULL THEN 0.0 ELSE 15.0 END AS known FROM p)
SELECT c_custkey, CASE WHEN known > 0 THEN CAST(round_even((coalesce(a * 60.0, 0) + coalesce(b * 25.0, 0) + coalesce(c * 15.0, 0)) / known, 4) AS DECIMAL(12,4)) END AS score, CAST(round_even(known, 0) AS INTEGER) AS coverage FROM w""")
def weighted_scores(t):
    c = F.col
    parts = [(F.when(c("c_acctbal") > 0, F.least(F.lit(100.0), c("c_acctbal") / 100)), 60), (F.when(c("c_nationkey") % 3 != 0, c("c_nationkey") * 4.0), 25), (F.when(c("c_custkey") % 2 == 0, F.lit(50.0)), 15)]
    value, coverage = weighted_score(parts)
    return t.customer.select("c_custkey", F.bround(value, 4).cast("decimal(12,4)").alias("score"), coverage.alias("coverage"))


@query("""
SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal <= 0 THEN 'balance' END, CASE WHEN c_nationkey % 4 = 0 THEN 'nation' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END) AS missing FROM customer""")
def missing_fields(t):
    known = [("balance", F.when(F.col("c_acctbal") > 0, 1)), ("nation", F.when(F.col("c_nationkey") % 4 != 0, 1)), ("segment", F.when(F.col("c_mktsegment") != "BUILDING", 1))]
    return t.customer.select("c_custkey", features.missing(known).alias("missing"))


@query("""
WITH c AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS timers, sum(l_quantity) FILTER (l_returnflag = 'R') AS serial, max(l_extendedprice) AS price, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, timers, serial, n, CASE WHEN timers IS NULL AND serial IS NULL THEN NULL ELSE CAST(round_even(CASE WHEN timers IS NULL THEN 0 ELSE least(1.0, timers / 12) * 25 END + CASE WHEN serial IS NULL THEN 0 ELSE least(1.0, serial / 12) * 20 END, 0) AS INTEGER) END AS peripheral FROM c""")
def capability_record(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("timers"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("serial"), F.count("*").alias("n"))
    p = score.peripheral_score({"timer": F.col("timers"), "serial": F.col("serial")})
    return per.withColumn("peripheral", F.bround(p, 0).cast("int"))


@query("""
WITH f AS (SELECT l_orderkey, l_returnflag AS t, l_quantity AS q FROM lineitem)
SELECT l_orderkey, sum(q) FILTER (t = 'A') AS units, sum(q) FILTER (t <> 'A') AS channels, CASE WHEN bool_or(t = 'A') AND bool_or(t <> 'A') THEN 'units_and_channels' WHEN bool_or(t = 'A') THEN 'units' ELSE 'channels' END AS semantics
FROM f GROUP BY l_orderkey""")
def adc_semantics(t):
    a, c = features.count_of(F.col("features"), ["A"]), features.count_of(F.col("features"), ["N", "R"])
    rows = _order_features(t).select("l_orderkey", F.transform("features", lambda f: F.map_filter(f, lambda k, v: k != "source_kind")).alias("features"))
    return rows.select("l_orderkey", a.alias("units"), c.alias("channels"), F.when(a.isNotNull() & c.isNotNull(), "units_and_channels").when(a.isNotNull(), "units").otherwise("channels").alias("semantics"))


@query("""
SELECT 'order_customer' AS check, 'error' AS severity, count(*) AS findings FROM orders WHERE o_custkey + 3 NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0
UNION ALL SELECT 'nation_unique', 'error', count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'part_prefix', 'warning', count(*) FROM part WHERE NOT starts_with(p_brand, 'Brand#1') HAVING count(*) > 0""")
def validate_fk_report(t):
    orders = t.orders.select((F.col("o_custkey") + 3).alias("o_custkey"))
    return validate.report(validate.foreign_key(orders, "o_custkey", t.customer, "c_custkey", "order_customer"), validate.unique(t.customer, "c_nationkey", "nation_unique"), validate.holds(t.part, "p_partkey", F.startswith("p_brand", F.lit("Brand#1")), "part_prefix", "warning"))


@query("""
SELECT 'balance' AS check, 'error' AS severity, count(*) AS findings FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0
UNION ALL SELECT 'size', 'error', count(*) FROM part WHERE p_size < 0 OR p_retailprice < 0 HAVING count(*) > 0
UNION ALL SELECT 'whole_price', 'error', count(*) FROM part WHERE p_retailprice >= 0 HAVING count(*) > 0""")
def validate_ranges(t):
    priced = t.part.select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".5")).alias("p"))
    return validate.report(validate.non_negative(t.customer, "c_custkey", ["c_acctbal"], "balance"), validate.non_negative(t.part, "p_partkey", ["p_size", "p_retailprice"], "size"), validate.non_negative(priced, "p_partkey", ["p"], "whole_price", strict=True))


@query("""
WITH c AS (SELECT c_nationkey, count(*) AS actual FROM customer GROUP BY c_nationkey), s AS (SELECT s_nationkey, count(*) * 15 AS stated FROM supplier GROUP BY s_nationkey)
SELECT n_nationkey, coalesce(stated, 0) AS stated, coalesce(actual, 0) AS actual, coalesce(stated, 0) = coalesce(actual, 0) AS agrees
FROM nation LEFT JOIN c ON c_nationkey = n_nationkey LEFT JOIN s ON s_nationkey = n_nationkey""")
def validate_reconcile(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("actual"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg((F.count("*") * 15).alias("stated"))
    both = t.nation.select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").na.fill(0, ["actual", "stated"])
    return both.select("n_nationkey", "stated", "actual", (F.col("stated") == F.col("actual")).alias("agrees"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 7 END AS hosts FROM customer")
def summed_text_roles(t):
    text = F.element_at(F.array(F.lit("2*H+1*D+H"), F.lit("H"), F.lit("3*D"), F.lit("4*H;3*H")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", summed_roles(text, "H").cast("int").alias("hosts"))
