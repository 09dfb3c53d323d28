"""A product selector's rows made from the parts' table: the tables that one pass over them gives."""

from pyspark.sql import functions as F

from partloom.operators import products

from .catalog import query

#: The selector's columns by SQL that both engines read; k and s are the part's key and size.
RAW = {
    "mpn": "CASE WHEN k % 17 = 0 THEN '' ELSE concat('esp32-c', k % 7, '-n', k) END", "name": "CASE WHEN k % 3 = 0 THEN NULL ELSE concat('ESP32-C', k % 7) END", "series": "CASE WHEN k % 4 = 0 THEN '' ELSE ' esp32-c ' END",
    "cpu": "CASE k % 5 WHEN 0 THEN 'Xtensa® dual-core LX7' WHEN 1 THEN 'Xtensa LX6' WHEN 2 THEN 'L106' WHEN 3 THEN 'RISC-V single' ELSE 'ARM® M4' END", "freq": "CASE WHEN k % 6 = 0 THEN '' ELSE concat('up to ', s, ' MHz') END", "core": "'2'",
    "flash": "concat(s % 5, '')", "sram": "'520.5'", "rom": "'N/A'", "package": "concat('QFN', s)", "pins": "concat(s, '')", "status": "CASE k % 4 WHEN 0 THEN 'Mass Production' WHEN 1 THEN 'NRND' WHEN 2 THEN NULL ELSE 'else' END", "temperature_range": "'-40~85'",
    "adc": "CASE WHEN k % 2 = 0 THEN concat('2 * 12-bit ADC, ', s, ' channels') ELSE 'none' END", "dac": "CASE WHEN k % 6 = 0 THEN '0*8bit DAC' WHEN k % 6 = 1 THEN '2*8-bit dac' END", "touch_sensor": "CASE WHEN k % 3 = 0 THEN concat(s, '') ELSE '-' END", "gpio": "concat(s, '')",
    "uart": "CASE WHEN k % 9 = 0 THEN '0' ELSE '3' END", "rmt": "concat('2*', s)", "ledpwm": "'LED 6 \"channels\"'", "camera_interface": "CASE WHEN k % 2 = 0 THEN 'DVP' ELSE 'NO' END", "tof": "CASE WHEN k % 5 = 0 THEN 'yes' END", "wifi": "'802.11 b/g/n'", "psram": "concat(s % 4, '')",
}
_GOOD = "k % 17 <> 0 AND k % 9 <> 0"
_ROWS = "WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), r AS (SELECT k, s, " + ", ".join(f"{e} AS {c}" for c, e in RAW.items()) + "\nFROM p),\n"
_ROWS += f"""d AS (
  SELECT *, upper(mpn) AS m, CASE WHEN k % 3 = 0 THEN upper(mpn) ELSE 'ESP32-C' || (k % 7) END AS nm, 'espressif::' || mpn AS id,
         CASE k % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'nrnd' ELSE 'unknown' END AS life
  FROM r WHERE {_GOOD})
"""


def _tables(t):
    raw = t.part.selectExpr("p_partkey AS k", "p_size AS s").selectExpr("k", *[f"{e} AS {c}" for c, e in RAW.items()])
    return products.emitted(products.records(raw, "wireless_soc", F.col("k")))


@query(
    _ROWS
    + """
, e AS (SELECT *, CASE WHEN k % 4 = 0 THEN nm ELSE 'ESP32-C' END AS se FROM d)
SELECT id AS record_id, id AS device_id, 'espressif::esp::' || lower(se) || '::' || lower(se) AS product_line_id, 'wireless_soc' AS product_type, CASE k % 5 WHEN 3 THEN 'RISC-V' WHEN 4 THEN 'unknown' ELSE 'Xtensa' END AS architecture_class, se AS series, se AS product_line, m AS device_name, nm AS generic_device_name,
       CASE WHEN k % 3 = 0 THEN '' ELSE 'N' || k END AS variant_code, CASE k % 5 WHEN 0 THEN 'Xtensa LX7' WHEN 1 THEN 'Xtensa LX6' WHEN 2 THEN 'Xtensa L106' WHEN 3 THEN 'RISC-V' ELSE 'ARM M4' END AS core, 2::BIGINT AS core_count, CASE WHEN k % 6 <> 0 THEN s * 1000000 END::BIGINT AS max_clock_hz,
       CASE WHEN s % 5 > 0 THEN s % 5 * 1048576 END::BIGINT AS flash_bytes, 532992::BIGINT AS ram_bytes, NULL::BIGINT AS rom_bytes, CASE WHEN s % 4 > 0 THEN s % 4 * 1048576 END::BIGINT AS psram_bytes, package, s::BIGINT AS pins, life AS lifecycle
FROM e"""
)
def product_devices(t):
    """The devices of a product selector, as one of the tables that one pass writes."""
    return products.table_of(t.spark, _tables(t), "device", products.DEVICE)


@query(
    _ROWS
    + """
, f AS (
  SELECT id AS record_id, unnest(list_filter([
    CASE WHEN k % 2 = 0 AND s > 0 THEN 'ADC|' || s || '|ADC channels|12' END, CASE WHEN k % 2 = 0 THEN 'ADCUnits|2|ADC converter units|12' END, CASE WHEN k % 6 = 1 THEN 'DAC|2|DAC converter units|8' END, CASE WHEN k % 3 = 0 THEN 'Touch|' || s || '|Capacitive touch channels|' END,
    'IOs|' || s || '|GPIO|', 'UART|3||', 'RMT|2|Remote control transceiver|2*' || s, 'LEDPWM|6|LED PWM controller|LED 6 "channels"', CASE WHEN k % 2 = 0 THEN 'Camera|1|DVP|' END, CASE WHEN k % 5 = 0 THEN 'TOF|1|Time-of-flight interface|' END, 'WiFi|1|802.11 b/g/n|',
    CASE WHEN s % 4 > 0 THEN 'PSRAM|' || (s % 4) || '|Integrated/in-package PSRAM|MB' END], lambda x: x IS NOT NULL)) AS feature
  FROM d)
SELECT record_id, feature FROM f"""
)
def product_features(t):
    """The features of a product selector's devices by its rule table."""
    f = products.table_of(t.spark, _tables(t), "feature", products.FEATURE)
    return f.select("record_id", F.concat_ws("|", "type", "n", F.coalesce("name", F.lit("")), F.coalesce("m", F.lit(""))).alias("feature"))


@query(
    _ROWS
    + """
, v AS (UNPIVOT (SELECT k, id AS record_id, """ + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in RAW) + """ FROM d) ON """ + ", ".join(RAW) + """ INTO NAME field_name VALUE value)
SELECT record_id, 'provenance' AS kind, field_name, 'tableData[' || k || '].' || field_name AS source_path, '"' || replace(value, '"', '\\"') || '"' AS value FROM v WHERE value <> ''
UNION ALL SELECT 'espressif::' || mpn, 'part', 'espressif::' || mpn, upper(mpn), package || ' -40~85 ' || CASE k % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'nrnd' ELSE 'unknown' END FROM r WHERE k % 17 <> 0 AND k % 9 <> 0
UNION ALL SELECT 'espressif::' || mpn, 'error', upper(mpn), NULL, CASE WHEN mpn = '' THEN 'no part number' ELSE 'official_record_missing_positive_uart_count' END FROM r WHERE k % 17 = 0 OR k % 9 = 0"""
)
def product_records(t):
    """Provenance, parts and errors of the same pass, side by side."""
    path = _tables(t)
    told = products.table_of(t.spark, path, "provenance", products.PROVENANCE).select("record_id", F.lit("provenance").alias("kind"), "field_name", "source_path", F.col("source_value_json").alias("value"))
    parts = products.table_of(t.spark, path, "part", products.PART).select("record_id", F.lit("part").alias("kind"), F.col("orderable_part_id").alias("field_name"), F.col("part_number").alias("source_path"), F.concat_ws(" ", "package", "temperature_range", "lifecycle").alias("value"))
    wrong = products.table_of(t.spark, path, "error", products.ERROR).select("record_id", F.lit("error").alias("kind"), F.col("item").alias("field_name"), F.lit(None).cast("string").alias("source_path"), F.col("error").alias("value"))
    return told.unionByName(parts).unionByName(wrong)
