"""Merging sources: precedence, first and last wins, lineage, conflicts, upserts, lists kept as ;-text."""

from pyspark.sql import functions as F

from partloom.functions.exprs import joined_once, split_list
from partloom.operators import merge

from .catalog import query

_UNIQUE_ROWS = """
rows(k, src, pos, v) AS (
  SELECT n_name, 0, n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT n_name, 1, n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey ELSE n_regionkey + 10 END FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_name, 2, n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN n_regionkey ELSE n_regionkey + 20 END FROM nation WHERE n_nationkey % 3 <> 1
  UNION ALL SELECT 'EXTRA_' || n_name, 2, n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 5)"""


@query(f"""
WITH RECURSIVE {_UNIQUE_ROWS.strip()},
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, pos) AS i FROM rows WHERE k <> ''),
f(k, i, v, origin, collisions) AS (
  SELECT k, i, v, src, 0 FROM o WHERE i = 1
  UNION ALL
  SELECT o.k, o.i, CASE WHEN o.v = f.v OR f.origin = 0 THEN o.v ELSE f.v END, CASE WHEN o.v = f.v OR f.origin = 0 THEN o.src ELSE f.origin END,
    f.collisions + CASE WHEN o.v = f.v OR f.origin = 0 THEN 0 ELSE 1 END
  FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1),
l AS (SELECT k, max(i) AS i FROM o GROUP BY k)
SELECT f.k, f.v, CAST(f.origin AS INTEGER) AS origin, CAST(f.collisions AS INTEGER) AS collisions FROM f JOIN l ON l.k = f.k AND l.i = f.i""")
def merge_unique_precedence(t):
    n = t.nation
    row = lambda df, src, v, name=F.col("n_name"): df.select(name.alias("k"), F.lit(src).alias("src"), F.col("n_nationkey").alias("pos"), v.alias("v"))
    r, k = F.col("n_regionkey"), F.col("n_nationkey")
    rows = row(n, 0, r).unionByName(row(n.filter(k % 2 == 0), 1, F.when(k % 3 == 0, r).otherwise(r + 10))).unionByName(row(n.filter(k % 3 != 1), 2, F.when(k % 4 == 0, r).otherwise(r + 20))).unionByName(row(n.filter(k < 5), 2, r, F.concat(F.lit("EXTRA_"), "n_name")))
    return merge.merge_unique(rows, "k", "src", "pos", "v")


@query("""
SELECT event_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY user_id, lower(event_type)) AS copies
FROM events WINDOW w AS (PARTITION BY user_id, lower(event_type) ORDER BY ts, event_id)""")
def dedup_first_wins(t):
    return merge.first_wins(t.events, [F.col("user_id"), F.lower("event_type")], [F.col("ts"), F.col("event_id")]).select("event_id", "kept", "copies")


@query("""
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type""")
def dedup_last_wins(t):
    last = t.events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("x"))
    return last.select("user_id", "event_type", "x.event_id", "x.value")


@query("""
WITH s AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL),
f AS (SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id)
SELECT f.user_id, f.event_id, f.value, string_agg(event_type, ';' ORDER BY first_id, event_type) AS sources FROM f JOIN s ON s.user_id = f.user_id GROUP BY ALL""")
def dedup_lineage(t):
    found = merge.lineage(t.events.withColumn("first_event", F.col("event_id")), ["user_id"], "event_id", "event_type", ["first_event", "value"])
    return found.select("user_id", F.col("first_event").alias("event_id"), "value", "sources")


@query("""
WITH e AS (SELECT user_id % 50 AS k, event_type, first_value(event_type) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS f FROM events)
SELECT k, count(*) FILTER (event_type = f) AS same, count(*) FILTER (event_type <> f) AS errors FROM e GROUP BY k""")
def dedup_conflicts(t):
    return merge.conflicts(t.events.withColumn("k", F.col("user_id") % 50), ["k"], "event_id", "event_type")


@query("""
WITH u AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS l FROM events GROUP BY user_id)
SELECT user_id, array_to_string(CASE WHEN list_contains(l, 'view') THEN l ELSE list_append(l, 'view') END, ';') AS added,
  array_to_string(list_filter(l, lambda x: x IN ('click', 'view')), ';') AS common FROM u""")
def semicolon_set_add(t):
    u = t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("l"))
    return u.select("user_id", joined_once(F.col("l"), F.lit("view")).alias("added"), F.array_join(F.array_intersect(split_list(F.col("l")), F.array(F.lit("click"), F.lit("view"))), ";").alias("common"))


@query("""
WITH o AS (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS name FROM supplier),
n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(s_nationkey % 7 AS VARCHAR) END AS nation, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE s_name END AS name FROM supplier WHERE s_suppkey % 4 <> 0),
l AS (SELECT o.s_suppkey, 'nation' AS field, o.nation AS old, n.nation AS new FROM o LEFT JOIN n USING (s_suppkey) UNION ALL SELECT o.s_suppkey, 'name', o.name, n.name FROM o LEFT JOIN n USING (s_suppkey))
SELECT s_suppkey, field, CASE WHEN coalesce(new, '') = '' THEN old ELSE new END AS value, coalesce(new, '') <> '' AND coalesce(old, '') <> '' AND new <> old AS conflict FROM l""")
def upsert_conflict_log(t):
    k = F.col("s_suppkey")
    old = t.supplier.select(k, F.col("s_nationkey").cast("string").alias("nation"), F.when(k % 5 == 0, "").otherwise(F.col("s_name")).alias("name"))
    new = t.supplier.filter(k % 4 != 0).select(k, F.when(k % 3 == 0, "").otherwise((F.col("s_nationkey") % 7).cast("string")).alias("nation"), F.when(k % 2 == 0, F.lower("s_name")).otherwise(F.col("s_name")).alias("name"))
    return merge.upsert_values(old, new, "s_suppkey", ["nation", "name"]).select("s_suppkey", "field", "value", "conflict")


@query("""
SELECT 'customer' AS pack, c_custkey AS id, 'negative balance' AS error FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'supplier', s_suppkey, 'negative balance' FROM supplier WHERE s_acctbal < 0""")
def errors_union(t):
    tag = lambda df, pack, key, bal: df.select(F.lit(pack).alias("pack"), F.col(key).alias("id"), F.when(F.col(bal) < 0, "negative balance").alias("error")).filter("error is not null")
    return tag(t.customer, "customer", "c_custkey", "c_acctbal").unionByName(tag(t.supplier, "supplier", "s_suppkey", "s_acctbal"))


@query("""
SELECT event_id, event_type, value FROM events WHERE event_type <> 'click'
UNION ALL SELECT event_id, 'click', value * 2 FROM events WHERE event_type = 'click'""")
def idempotent_replace_by_source(t):
    new = t.events.filter("event_type = 'click'").select("event_id", "event_type", (F.col("value") * 2).alias("value"))
    rows = t.events.select("event_id", "event_type", "value")
    once = merge.replace_source(rows, "event_type", "click", new)
    return merge.replace_source(once, "event_type", "click", new)


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS record_id, 's_name' AS field_name, '"' || s_name || '"' AS source_value FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 's_acctbal', '"known"' FROM supplier WHERE s_acctbal >= 0""")
def unpivot_provenance(t):
    values = {"s_name": F.concat(F.lit('"'), "s_name", F.lit('"')), "s_nationkey": F.col("s_nationkey").cast("string"), "s_acctbal": F.when(F.col("s_acctbal") >= 0, '"known"')}
    long = t.supplier.select(F.col("s_suppkey").cast("string").alias("record_id"), F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).alias("field_name", "source_value"))
    return long.filter("source_value is not null")
