"""Search, filters, drill-down, comparison, ordering and paging."""

from pyspark.sql import functions as F

from partloom.functions.exprs import cascade, known_sum, natural_key
from partloom.operators import order, overrides, paging, search, substring
from partloom.sources.tables import loaded, sparse

from .catalog import query

NATURAL = "array_to_string(list_transform(regexp_extract_all(lower(strip_accents({0})), '\\d+|\\D+'), lambda t: CASE WHEN regexp_matches(t, '^\\d') THEN lpad(CAST(length(ltrim(t, '0')) AS VARCHAR), 6, '0') || ltrim(t, '0') ELSE t END), '')"


@query(r"""
WITH f AS (SELECT *, lower(concat_ws(' ', p_name, p_brand, p_type)) AS doc FROM part),
k AS (SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, """ + NATURAL.format("p_name") + r""" AS nk
      FROM f WHERE contains(doc, 'widget') AND p_size >= 8),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY coalesce(p_size, -1) DESC, nk, p_partkey) AS INTEGER) AS rank FROM k)
SELECT p_partkey, p_name, p_brand, p_size, rank FROM r WHERE rank <= 120""")
def search_ranked(t):
    found = search.search(t.part, search.search_text("p_name", "p_brand", "p_type"), " Widget ", {"p_brand": ""}, (F.col("p_size"), 8))
    ranks = search.ranked(F.col("p_size"), F.col("p_name"), F.col("p_partkey"))
    return order.first_page(found, ranks, 120).select("p_partkey", "p_name", "p_brand", "p_size", "rank")


WANTED = [" Widget ", "old", "d w", "#12", "zzz", "GADGET BRAND#3", "e"]


@query(f"""
WITH q(q) AS (VALUES {', '.join(f"('{w}')" for w in WANTED)}), t AS (SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) AS text FROM part)
SELECT q, p_partkey FROM q JOIN t ON contains(text, lower(trim(q)))""")
def search_substring(t):
    """Free-text queries answered by trigram postings; short ones by a scan."""
    rows = t.part.select("p_partkey", search.search_text("p_name", "p_brand", "p_type").alias("text"))
    held = substring.index(rows, "p_partkey", "text")
    each = [substring.find(held, q).select(F.lit(q).alias("q"), "p_partkey") for q in WANTED]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


@query(f"""
WITH r AS (
  SELECT p_partkey, row_number() OVER (ORDER BY coalesce(p_size, -1) DESC, {NATURAL.format("p_name")}, p_partkey) AS rank, count(*) OVER () AS n FROM part WHERE p_size >= 3)
SELECT CASE WHEN rank <= 120 THEN 1 WHEN rank <= 320 THEN 2 WHEN rank <= 520 THEN 3 ELSE 9 END AS page, p_partkey, rank,
       greatest(0, n - CASE WHEN rank <= 120 THEN 120 WHEN rank <= 320 THEN 320 WHEN rank <= 520 THEN 520 ELSE 1720 END) AS remaining
FROM r WHERE rank <= 520 OR rank BETWEEN 1521 AND 1720""")
def search_pages(t):
    """Pages 1, 2, 3 and 9 of a stored search, with what remains after each."""
    found = search.search(t.part.select("p_partkey", "p_name", "p_size"), F.col("p_name"), at_least=(F.col("p_size"), 3))
    held = paging.publish(found, search.ranked(F.col("p_size"), F.col("p_name"), F.col("p_partkey")))
    each = [paging.page(held, *paging.bounds_of(n)).select(F.lit(n).alias("page"), "p_partkey", "rank", "remaining") for n in (1, 2, 3, 9)]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query(f"""
WITH r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY coalesce(p_size, -1) DESC, {NATURAL.format("p_name")}, p_partkey) AS rank FROM part)
SELECT p_partkey, p_size FROM r WHERE rank BETWEEN 121 AND 320""")
def search_following(t):
    """The page after the first one of a search, by the keys of the last row that was seen."""
    keys = t.part.select("p_partkey", "p_size", F.coalesce("p_size", F.lit(-1)).alias("score"), natural_key(F.col("p_name")).alias("natural"))
    ranked = [(F.col("score"), True), (F.col("natural"), False), (F.col("p_partkey"), False)]
    last = keys.orderBy(F.desc("score"), "natural", "p_partkey").limit(paging.FIRST).agg(F.max_by(F.struct("score", "natural", "p_partkey"), F.struct(-F.col("score"), "natural", "p_partkey")).alias("m")).first().m
    return paging.following(keys, ranked, list(last), paging.MORE).select("p_partkey", "p_size")


@query("""
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_returned, bool_or(lower(l_linestatus) = 'o') AS has_open
FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'R') >= 2""")
def filter_min_count_presence(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.bool_or(F.lower("l_linestatus") == "o").alias("has_open"))
    return per.filter(F.coalesce("n_returned", F.lit(0)) >= 2)


RULES = [("glob", "*widg?t", "Brand#12", "confirmed"), ("glob", "*WIDGET", "", "confirmed"), ("glob", "[a-h]*[!t]", "", "pending"), ("prefix", "Cold", "", "pending"), ("prefix", "cold", "", "pending"), ("line", "Brand#21", "", "confirmed"), ("series", "5", "", "proposed"), ("glob", "H*r", "", "verified")]
_rules_sql = ", ".join(f"('{k}', '{v}', '{b}', '{s}')" for k, v, b, s in RULES)


def _of_rules(part, rules, *said):
    """Parts that rules apply to, with what is said of these: found once for each distinct name, brand and size, then joined to its parts."""
    keys = ["p_name", "p_brand", "size"]
    parts = part.select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("string").alias("size"))
    found = overrides.applied(parts.select(*keys).distinct(), rules, "p_name", "p_brand", "size", "p_brand").groupBy(*keys).agg(*said)
    mine = found.withColumnsRenamed({c: f"_{c}" for c in keys})
    # never by a broadcast of its size before the rules were met
    return parts.join(mine.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).drop(*[f"_{c}" for c in keys])


@query(f"""
WITH rules(kind, value, vendor, status) AS (VALUES {_rules_sql})
SELECT p_partkey, count(*) FILTER (status IN ('confirmed', 'verified')) AS n_confirmed, count(*) FILTER (status NOT IN ('confirmed', 'verified')) AS n_pending
FROM part JOIN rules ON (vendor = '' OR vendor = p_brand) AND CASE kind
  WHEN 'glob' THEN p_name GLOB value
  WHEN 'prefix' THEN starts_with(p_name, value) WHEN 'line' THEN p_brand = value ELSE CAST(p_size AS VARCHAR) = value END
GROUP BY p_partkey""")
def filter_override_rules(t):
    rules = t.spark.createDataFrame(RULES, "kind string, value string, vendor string, status string")
    known = F.col("rule.status").isin("confirmed", "verified")
    per = _of_rules(t.part, rules, F.count_if(known).alias("n_confirmed"), F.count_if(~known).alias("n_pending"))
    return per.groupBy("p_partkey").agg(F.sum("n_confirmed").alias("n_confirmed"), F.sum("n_pending").alias("n_pending"))


@query("""
WITH r AS (
  SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'glob' WHEN 1 THEN 'glob' WHEN 2 THEN 'prefix' WHEN 3 THEN 'line' ELSE 'series' END AS kind,
    CASE p_partkey % 5 WHEN 0 THEN substr(p_name, 1, 4) || '*' || right(p_name, 3) WHEN 1 THEN '*' || right(p_name, 5) WHEN 2 THEN substr(p_name, 1, 1 + p_partkey % 7) WHEN 3 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS value,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS vendor
  FROM part WHERE p_partkey % 10 < 5)
SELECT p_partkey, count(*) AS n_rules, min(kind || ' ' || value) AS first_rule, max(kind || ' ' || value) AS last_rule
FROM part JOIN r ON (vendor = '' OR vendor = p_brand) AND CASE kind WHEN 'glob' THEN p_name GLOB value WHEN 'prefix' THEN starts_with(p_name, value) WHEN 'line' THEN p_brand = value ELSE CAST(p_size AS VARCHAR) = value END
GROUP BY p_partkey""")
def override_rules_of_table(t):
    """Rules that come from a table of their own size, found by their literal ends."""
    k = F.col("p_partkey")
    kind = F.when(k % 5 <= 1, "glob").when(k % 5 == 2, "prefix").when(k % 5 == 3, "line").otherwise("series")
    value = (
        F.when(k % 5 == 0, F.concat(F.substring("p_name", 1, 4), F.lit("*"), F.right(F.col("p_name"), F.lit(3))))
        .when(k % 5 == 1, F.concat(F.lit("*"), F.right(F.col("p_name"), F.lit(5))))
        .when(k % 5 == 2, F.substring(F.col("p_name"), F.lit(1), (1 + k % 7).cast("int")))
        .when(k % 5 == 3, F.col("p_brand"))
        .otherwise(F.col("p_size").cast("string"))
    )
    rules = t.part.filter(k % 10 < 5).select(kind.alias("kind"), value.alias("value"), F.when(k % 3 == 0, F.col("p_brand")).otherwise("").alias("vendor")).distinct()
    said = F.concat_ws(" ", "rule.kind", "rule.value")
    per = _of_rules(t.part, rules, F.count("*").alias("n_rules"), F.min(said).alias("first_rule"), F.max(said).alias("last_rule"))
    return per.groupBy("p_partkey").agg(F.sum("n_rules").alias("n_rules"), F.min("first_rule").alias("first_rule"), F.max("last_rule").alias("last_rule"))


@query(r"""
SELECT p_partkey, p_brand, regexp_full_match(p_brand, 'Brand#[1-3]\d') AS in_series,
  NOT regexp_matches(p_brand, '[*?]') AND p_brand <> '' AND NOT contains(p_name, '/') AS orderable
FROM part WHERE starts_with(p_brand, 'Brand#') AND lower(p_type) <> 'standard'""")
def filter_orderable_codes(t):
    own = F.col("p_brand").rlike(r"^Brand#[1-3]\d$")
    fine = ~F.col("p_brand").rlike(r"[*?]") & (F.col("p_brand") != "") & ~F.contains("p_name", F.lit("/"))
    return t.part.filter(F.startswith("p_brand", F.lit("Brand#")) & (F.lower("p_type") != "standard")).select("p_partkey", "p_brand", own.alias("in_series"), fine.alias("orderable"))


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, scheme, host, scheme = 'https' AND (ends_with(host, '.com') OR ends_with(host, '.net')) AS allowed,
  'https://' || host || '/index.xml' AS index_url FROM u""")
def filter_url_allowlist(t):
    u = t.pages.select("page_id", F.regexp_extract("url", r"^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))
    fine = (F.col("scheme") == "https") & (F.endswith("host", F.lit(".com")) | F.endswith("host", F.lit(".net")))
    return u.withColumn("allowed", fine).withColumn("index_url", F.concat(F.lit("https://"), "host", F.lit("/index.xml")))


@query(r"""
SELECT p_partkey, (regexp_matches(lower(p_name || '|' || p_brand || '|' || p_type), '.*brand#1.*') OR regexp_matches(lower(p_name || '|' || p_brand || '|' || p_type), '^red.*[|]small$')) AS selected
FROM part""")
def scope_selection(t):
    joined = F.lower(F.concat_ws("|", "p_name", "p_brand", "p_type"))
    globs = F.array(F.lit("*brand#1*"), F.lit("red*|small"))
    from partloom.functions.exprs import glob_regex

    return t.part.select("p_partkey", F.exists(globs, lambda g: F.call_function("rlike", joined, glob_regex(g))).alias("selected"))


_TREE = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _tree(t):
    # customers are the big side; nations and regions are fixed dimensions
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))


@query(f"""
SELECT r_name, count(DISTINCT n_nationkey) AS n_series, count(DISTINCT (n_nationkey, c_mktsegment)) AS n_lines, count(*) AS n_devices, max(c_acctbal) AS top_balance
{_TREE} GROUP BY r_name""")
def drill_vendors(t):
    return _tree(t).groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("n_series"), F.countDistinct("n_nationkey", "c_mktsegment").alias("n_lines"), F.count("*").alias("n_devices"), F.max("c_acctbal").alias("top_balance"))


@query(f"""
SELECT n_name, count(DISTINCT c_mktsegment) AS n_lines, count(*) AS n_devices, max(c_acctbal) AS top_balance,
  array_to_string(list_sort(list(DISTINCT c_mktsegment)), ' / ') AS segments
{_TREE} WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name""")
def drill_series(t):
    chosen = t.region.agg(F.min("r_name").alias("chosen"))
    inside = _tree(t).join(F.broadcast(chosen), F.col("r_name") == F.col("chosen"), "left_semi")
    return inside.groupBy("n_name").agg(F.countDistinct("c_mktsegment").alias("n_lines"), F.count("*").alias("n_devices"), F.max("c_acctbal").alias("top_balance"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), " / ").alias("segments"))


@query("""
SELECT c_mktsegment, count(DISTINCT c_custkey) AS n_devices, count(o_orderkey) AS n_parts, max(c_acctbal) AS top_balance
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY c_mktsegment""")
def drill_lines(t):
    mine = t.customer.filter("c_nationkey = 3")
    # orders shrink to counts before they meet the customers
    parts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    both = mine.join(parts, F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.groupBy("c_mktsegment").agg(F.count("*").alias("n_devices"), F.sum(F.coalesce("n", F.lit(0))).alias("n_parts"), F.max("c_acctbal").alias("top_balance"))


@query("""
WITH m AS (SELECT min(c_mktsegment) AS s FROM customer),
d AS (SELECT c_custkey, c_name, """ + NATURAL.format("c_name") + """ AS nk FROM customer, m WHERE c_nationkey = 3 AND c_mktsegment = s)
SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY nk, c_custkey) AS BIGINT) AS pos FROM d""")
def drill_devices(t):
    line = t.customer.agg(F.min("c_mktsegment").alias("s"))
    mine = t.customer.filter("c_nationkey = 3").join(F.broadcast(line), F.col("c_mktsegment") == F.col("s"), "left_semi").select("c_custkey", "c_name")
    return order.numbered(mine, [natural_key(F.col("c_name")), F.col("c_custkey")], "pos").select("c_custkey", "c_name", F.col("pos").cast("bigint"))


@query("""
WITH ids(pos, id) AS (VALUES (1, 17), (2, 3), (3, 999999), (4, 8))
SELECT pos, p_partkey, p_name FROM ids JOIN part ON p_partkey = id""")
def point_lookup_ordered(t):
    ids = order.session_ids(t.spark, [17, 3, 999999, 8], "bigint")
    return t.part.join(F.broadcast(ids), F.col("p_partkey") == F.col("id")).select("pos", "p_partkey", "p_name")


@query("""
WITH c AS (SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_partkey IN (2, 5, 7, 11)),
l AS (SELECT 'p_size' AS metric, p_partkey, CAST(p_size AS DOUBLE) AS value FROM c
  UNION ALL SELECT 'p_retailprice', p_partkey, p_retailprice FROM c
  UNION ALL SELECT 'total', p_partkey, coalesce(p_size, 0) + coalesce(p_retailprice, 0) FROM c)
SELECT metric, p_partkey, value, coalesce(count(value) OVER w >= 2 AND max(value) OVER w <> min(value) OVER w AND value = max(value) OVER w, false) AS best
FROM l WINDOW w AS (PARTITION BY metric)""")
def compare_best(t):
    chosen = t.part.filter(F.col("p_partkey").isin(2, 5, 7, 11)).withColumn("total", known_sum(F.col("p_size").cast("double"), F.col("p_retailprice")))
    return search.compare(chosen, "p_partkey", ["p_size", "p_retailprice", "total"])


_NAMES = "CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN 'nátion_' || CAST(n_nationkey AS VARCHAR) WHEN 2 THEN 'Nation_0' || CAST(n_nationkey AS VARCHAR) || '1234567890123' WHEN 3 THEN 'NATION_' || CAST(n_nationkey AS VARCHAR) || '1234567890122x' ELSE 'Zürich ' || n_name END"


@query(f"WITH n AS (SELECT {_NAMES} AS name FROM nation) SELECT name, CAST(row_number() OVER (ORDER BY " + NATURAL.format("name") + ") AS BIGINT) AS rank FROM n")
def natural_sort_rank(t):
    names = t.nation.select(F.expr(_NAMES.replace("VARCHAR", "string")).alias("name"))
    return order.numbered(names, [natural_key(F.col("name"))]).select("name", F.col("rank").cast("bigint"))


@query("""
SELECT c_custkey, CAST(row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_mktsegment, c_name, c_custkey) AS BIGINT) AS rank FROM customer""")
def multi_key_sort_rank(t):
    first = F.when(F.col("c_mktsegment") == "MACHINERY", 1).when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(3)
    return order.numbered(t.customer, [first, F.col("c_mktsegment"), F.col("c_name"), F.col("c_custkey")]).select("c_custkey", F.col("rank").cast("bigint"))


@query("""
SELECT s_suppkey, CASE WHEN row_number() OVER (ORDER BY s_name, s_suppkey) <= 25 THEN 'selected' ELSE 'not_selected_by_limit' END AS status FROM supplier""")
def limit_with_status(t):
    top = t.supplier.orderBy("s_name", "s_suppkey").limit(25).select("s_suppkey", F.lit("selected").alias("status"))
    return t.supplier.select("s_suppkey").join(F.broadcast(top), "s_suppkey", "left").withColumn("status", F.coalesce("status", F.lit("not_selected_by_limit")))


@query("""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)
SELECT CAST(floor((r - 1) / 300) AS BIGINT) AS shard, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM n GROUP BY 1""")
def shard_rows(t):
    return order.shards(t.orders.select("o_orderkey"), [F.col("o_orderkey")]).groupBy("shard").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))


@query("""
WITH k AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, string_agg(c_name, ';' ORDER BY r) AS preview, CAST(max(n) - count(*) AS BIGINT) AS more, max(n) > 4 AS over_limit FROM k WHERE r <= 3 GROUP BY c_nationkey""")
def preview_caps(t):
    from pyspark.sql.window import Window

    w = Window.partitionBy("c_nationkey")
    first = t.customer.select("c_nationkey", "c_name", F.row_number().over(w.orderBy("c_name", "c_custkey")).alias("r")).filter("r <= 3")
    names = first.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c_name"))), lambda x: x["c_name"]), ";").alias("preview"), F.count("*").alias("shown"))
    total = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return names.join(total, "c_nationkey").select("c_nationkey", "preview", (F.col("n") - F.col("shown")).alias("more"), (F.col("n") > 4).alias("over_limit"))


@query("""
SELECT p.p_partkey, p.p_name, p.p_size FROM part p WHERE p.p_partkey IN (1, 4, 6, 123456789) AND (SELECT count(*) FROM part) > 0""")
def catalog_load_session(t):
    parts = loaded(t.part, t.part.count())
    known = order.session_ids(t.spark, [1, 4, 6, 123456789], "bigint")
    return parts.join(F.broadcast(known), F.col("p_partkey") == F.col("id"), "left_semi").select("p_partkey", "p_name", "p_size")


@query("""
SELECT c_custkey AS id, c_name AS n, CASE WHEN c_mktsegment = '' THEN NULL ELSE c_mktsegment END AS s, CAST(trunc(c_acctbal) AS BIGINT) AS b,
  coalesce(nullif(c_mktsegment, ''), c_name) AS label FROM customer""")
def scan_project_short_keys(t):
    from partloom.functions.exprs import blank_to_null, whole

    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("n"), blank_to_null(F.col("c_mktsegment")).alias("s"), whole(F.col("c_acctbal").cast("string")).alias("b"), F.coalesce(blank_to_null(F.col("c_mktsegment")), "c_name").alias("label"))


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(count(l_linenumber) AS BIGINT) AS n_lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity,
  string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY l_linenumber, l_partkey) AS parts
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = (SELECT min(l_orderkey) FROM lineitem) GROUP BY ALL""")
def detail_record(t):
    one = t.lineitem.agg(F.min("l_orderkey").alias("k"))
    lines = t.lineitem.join(F.broadcast(one), F.col("l_orderkey") == F.col("k"), "left_semi")
    per = lines.groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n_lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ";").alias("parts"))
    return t.orders.join(F.broadcast(per), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "n_lines", "quantity", "parts")


@query("""
SELECT p_partkey, '{' || array_to_string(list_filter(['"n":"' || p_name || '"', '"s":' || CAST(p_size AS VARCHAR), CASE WHEN p_size > 25 THEN '"z":0' END,
  CASE WHEN p_size % 3 = 0 THEN '"b":"' || p_brand || '"' END, CASE WHEN p_size % 2 = 0 THEN '"l":["' || p_type || '"]' END], lambda x: x IS NOT NULL), ',') || '}' AS record FROM part""")
def publish_sparse(t):
    third, even = F.col("p_size") % 3 == 0, F.col("p_size") % 2 == 0
    columns = {"n": F.col("p_name"), "s": F.col("p_size"), "z": F.when(F.col("p_size") > 25, F.lit(0)), "b": F.when(third, F.col("p_brand")).otherwise(""), "l": F.when(even, F.array("p_type")).otherwise(F.array().cast("array<string>"))}
    return sparse(t.part, columns, "record").select("p_partkey", "record")


@query("SELECT c_custkey, CASE WHEN c_name LIKE '%1' THEN 'ends_in_1' WHEN c_name LIKE '%0%' THEN 'has_0' ELSE 'other' END AS kind FROM customer")
def classify_rules(t):
    return t.customer.select("c_custkey", cascade(F.col("c_name"), [("1$", "ends_in_1"), ("0", "has_0")], "other").alias("kind"))
