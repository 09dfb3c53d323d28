"""The whole validator over a catalog that is made of the test tables, with faults of every kind."""

from pyspark.sql import functions as F

from partloom.operators import validate

from .catalog import query

_CATALOG = {
    "counted": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey",
    "lines": "SELECT concat('L', CAST(CASE WHEN n_nationkey = 24 THEN 23 ELSE n_nationkey END AS VARCHAR)) AS product_line_id, concat('line ', n_name) AS product_line, CAST(coalesce(n, 0) + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS device_variant_count FROM nation LEFT JOIN counted ON c_nationkey = n_nationkey",
    "devices": """SELECT concat('D', CAST(c_custkey AS VARCHAR)) AS device_id, concat('L', CAST(CASE WHEN c_nationkey = 22 THEN 99 ELSE c_nationkey END AS VARCHAR)) AS product_line_id,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Espressif' ELSE c_mktsegment END AS manufacturer, CAST(c_nationkey % 5 AS VARCHAR) AS family, CAST(c_nationkey % 7 AS VARCHAR) AS series, concat('DN', CAST(c_custkey AS VARCHAR)) AS device_name,
      CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN '-5' ELSE '1.5' END AS max_clock_hz, CAST(c_custkey AS VARCHAR) AS flash_bytes, '' AS ram_bytes,
      CASE WHEN c_custkey % 40 = 0 THEN '' ELSE concat('S', CAST(c_custkey % 15 AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN ';S1' ELSE '' END) END AS source_id, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'v' END AS source_version FROM customer""",
    "parts": """SELECT concat('O', CAST(o_orderkey AS VARCHAR)) AS orderable_part_id, concat(CASE WHEN o_orderkey % 9 = 0 THEN 'XX' ELSE 'DN' END, CAST(o_custkey AS VARCHAR), '-', CAST(o_orderkey % 1000 AS VARCHAR), CASE WHEN o_orderkey % 11 = 0 THEN '*' ELSE '' END) AS part_number,
      concat('DN', CAST(o_custkey AS VARCHAR)) AS device_name, concat('D', CAST(CASE WHEN o_orderkey % 13 = 0 THEN 9999999 ELSE o_custkey END AS VARCHAR)) AS device_id,
      CASE o_orderkey % 3 WHEN 0 THEN 'manufacturer_product_page' WHEN 1 THEN 'manufacturer_device_database' ELSE 'other' END AS verification_status, CASE WHEN o_orderkey % 2 = 0 THEN 'atdf_variant_record' ELSE '' END AS decode_status, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'u' END AS source_url FROM orders""",
    "sources": "SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS source_id FROM supplier",
    "capabilities": """SELECT concat('D', CAST(CASE WHEN c_custkey = 12 THEN 9999999 WHEN c_custkey = 14 THEN 15 ELSE c_custkey END AS VARCHAR)) AS device_id, concat('DN', CAST(c_custkey AS VARCHAR)) AS device_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Espressif' ELSE c_mktsegment END AS manufacturer,
      CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '2' ELSE 'x' END AS uart_count, CASE WHEN c_acctbal < 0 THEN '-1' ELSE '5' END AS gpio_count, CASE WHEN c_custkey % 20 = 1 THEN '[{' ELSE '[]' END AS accelerators_json, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS fpu_present FROM customer WHERE c_custkey % 10 <> 9""",
    "scores": "SELECT concat('D', CAST(c_custkey AS VARCHAR)) AS device_id, concat('DN', CAST(c_custkey AS VARCHAR)) AS device_name, CAST(c_custkey % 120 AS VARCHAR) AS selection_index, CASE WHEN c_custkey % 7 = 0 THEN 'bad' ELSE '50' END AS compute_score, CASE WHEN c_custkey % 30 = 0 THEN '' ELSE CAST(75 + c_custkey % 21 AS VARCHAR) END AS score_coverage_percent FROM customer",
}
_WITH = "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in _CATALOG.items())


def tables(t):
    """The catalog's tables; their definition is the one that the SQL begins with."""
    for name in ("customer", "nation", "orders", "supplier"):
        getattr(t, name).createOrReplaceTempView(f"validated_{name}")
    made = {}
    for name, sql in _CATALOG.items():
        for source in ("customer", "nation", "orders", "supplier", "counted"):
            sql = sql.replace(f"FROM {source}", f"FROM validated_{source}").replace(f"JOIN {source}", f"JOIN validated_{source}")
        made[name] = t.spark.sql(sql.replace("VARCHAR", "string"))
        if name == "counted":
            made[name].createOrReplaceTempView("validated_counted")
    blank = lambda df, columns: df.select("*", *[F.lit("").alias(c) for c in columns if c not in df.columns])
    return made["lines"], made["devices"], made["parts"], made["sources"], blank(made["capabilities"], [*validate.COUNTED, *validate.JSON_COLUMNS]), blank(made["scores"], validate.SCORES)


_twice = lambda table, key: f"SELECT 1 FROM {table} WHERE {key} <> '' GROUP BY {key} HAVING count(*) > 1"
_missing = lambda table, key, to: f"SELECT 1 FROM {table} WHERE {key} NOT IN (SELECT {key} FROM {to})"
_FINDINGS = {
    "line_unique": _twice("lines", "product_line_id"), "device_unique": _twice("devices", "device_id"), "part_unique": _twice("parts", "orderable_part_id"), "number_unique": _twice("parts", "part_number"), "source_unique": _twice("sources", "source_id"), "capability_unique": _twice("capabilities", "device_id"), "score_unique": _twice("scores", "device_id"),
    "device_line": _missing("devices", "product_line_id", "lines"), "part_device": _missing("parts", "device_id", "devices"), "capability_device": _missing("capabilities", "device_id", "devices"), "score_device": _missing("scores", "device_id", "devices"),
    "device_provenance": "SELECT 1 FROM devices WHERE source_id = '' OR source_version = ''",
    "device_sizes": "SELECT 1 FROM devices WHERE max_clock_hz IN ('-5', '1.5')",
    "device_sources": "SELECT 1 FROM (SELECT unnest(string_split(source_id, ';')) AS s FROM devices) WHERE s <> '' AND s NOT IN (SELECT source_id FROM sources)",
    "part_prefix": "SELECT 1 FROM parts WHERE NOT starts_with(part_number, device_name) AND NOT (verification_status = 'manufacturer_device_database' AND decode_status = 'atdf_variant_record')",
    "part_wildcard": "SELECT 1 FROM parts WHERE contains(part_number, '*')", "part_verified": "SELECT 1 FROM parts WHERE verification_status = 'other'", "part_url": "SELECT 1 FROM parts WHERE source_url = ''",
    "capability_counts": "SELECT 1 FROM (SELECT unnest([uart_count, gpio_count]) AS v FROM capabilities) WHERE v IN ('x', '-1')",
    "capability_json": "SELECT 1 FROM capabilities WHERE NOT json_valid(accelerators_json)",
    "capability_rows": "SELECT 1 WHERE (SELECT count(*) FROM capabilities) <> (SELECT count(*) FROM devices)",
    "espressif_uart": "SELECT 1 FROM capabilities WHERE manufacturer = 'Espressif' AND uart_count <> '2'",
    "score_range": "SELECT 1 FROM (SELECT unnest([selection_index, compute_score, score_coverage_percent]) AS v FROM scores) WHERE v <> '' AND coalesce(try_cast(v AS DOUBLE) NOT BETWEEN 0 AND 100, true)",
    "score_rows": "SELECT 1 WHERE (SELECT count(*) FROM scores) <> (SELECT count(*) FROM devices)",
    "score_coverage": "SELECT 1 WHERE (SELECT avg(try_cast(score_coverage_percent AS DOUBLE)) FROM scores) < 90",
    "line_count": "SELECT 1 FROM lines LEFT JOIN (SELECT product_line_id, count(*) AS n FROM devices GROUP BY product_line_id) a ON a.product_line_id = lines.product_line_id WHERE CAST(device_variant_count AS BIGINT) <> coalesce(n, 0)",
}


@query(_WITH + "\n" + "\nUNION ALL ".join(f"SELECT '{check}' AS check, '{'warning' if check == 'part_verified' else 'error'}' AS severity, count(*) AS findings FROM ({sql}) HAVING count(*) > 0" for check, sql in _FINDINGS.items()))
def validate_catalog(t):
    return validate.report(validate.catalog(*tables(t)))


@query(_WITH + """
SELECT (SELECT count(DISTINCT manufacturer) FROM devices) AS manufacturers, (SELECT count(DISTINCT (manufacturer, family)) FROM devices) AS families, (SELECT count(DISTINCT (manufacturer, series)) FROM devices) AS series, (SELECT count(*) FROM devices) AS device_variants,
  (SELECT count(*) FROM lines) AS product_lines, (SELECT count(*) FROM parts) AS orderable_parts, (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM capabilities) AS capability_records, (SELECT count(*) FROM capabilities WHERE fpu_present <> 'unknown') AS fpu_verified_records,
  (SELECT count(*) FROM scores) AS score_records, (SELECT round_even(avg(try_cast(score_coverage_percent AS DOUBLE)), 2) FROM scores) AS average_score_coverage_percent, (SELECT count(*) FROM scores WHERE try_cast(score_coverage_percent AS DOUBLE) >= 90) AS devices_at_or_above_90_percent""")
def validate_summary(t):
    return validate.summary(*tables(t))
