"""Capability records and scores of devices that are made of orders and their lines."""

from pyspark.sql import functions as F

from partloom.operators import capability, score

from .catalog import query

# type, name, m, widths that the name and m give, inventory category ('' if left out), accelerator points (0: none), whether special
KINDS = [
    ("Timer", "16-bit timer TIM16", "", "16", "timing", 0, False), ("Timer", "watchdog timer", "", "", "timing", 0, False), ("timer", "32Bit counter", "24", "24;32", "timing", 0, False),
    ("PWM", "motor pwm", "", "", "timing", 0, False), ("IOs", "ports", "", "", "gpio", 0, False), ("SPI", "", "", "", "connectivity", 0, False), ("Other", "I2C interface", "", "", "other", 0, False),
    ("USART", "usart", "", "", "connectivity", 0, False), ("UART", "", "", "", "connectivity", 0, False), ("CAN", "CAN FD", "", "", "connectivity", 0, False), ("USBOTG", "usb", "", "", "connectivity", 0, False),
    ("ETH", "mac", "", "", "connectivity", 0, False), ("DMA", "", "", "", "memory_bus", 0, False), ("RNG", "true random", "", "", "security", 0, True), ("ADC", "12-bit ADC channels", "", "12", "analog", 0, False),
    ("A/D", "converter", "10", "10", "analog", 0, False), ("ADCUnits", "adc", "", "", "analog", 0, False), ("DAC", "digital to analog 12bit", "", "12", "analog", 0, False), ("WDT", "iwdg", "", "", "timing", 0, False),
    ("Other", "independent watchdog", "", "", "other", 0, False), ("RTC", "", "", "", "timing", 0, False), ("Crypto", "AES engine", "", "", "security", 50, False), ("NPU", "neural unit", "", "", "accelerator", 100, False),
    ("Other", "CORDIC", "", "", "other", 75, False), ("Other", "DMA2D graphics", "", "", "other", 65, False), ("Other", "CRC32 unit", "", "", "other", 30, False), ("LCD", "lcd controller", "", "", "display_multimedia", 0, True),
    ("Memory", "cache", "", "", "", 0, False), ("LQFP64", "package", "", "", "", 0, False), ("ExtBus", "quad spi", "", "", "memory_bus", 0, False), ("Other", "operational amplifier", "", "", "other", 0, False),
    ("Com", "sercom", "", "", "connectivity", 0, False), ("TempSens", "temperature sensor", "", "", "analog", 0, False), ("Application", "motor control", "", "", "", 0, True), ("COMP", "comparator", "", "", "analog", 0, False),
    ("ExtInt", "external interrupt", "", "", "system", 0, False), ("SDIO", "sdmmc", "", "", "connectivity", 0, False), ("LIN", "lin interface", "", "", "connectivity", 0, False), ("I2S", "", "", "", "connectivity", 0, False), ("Touch", "touch keys", "", "", "analog", 0, True), ("Camera", "dcmi", "", "", "display_multimedia", 0, True),
]
# processors of a device, then core_names, core_count, fpu, mpu, rank
PROCESSORS = [
    ("[{'Dcore':'Cortex-M4','Dfpu':'SP_FPU','Dmpu':'MPU'}]", "Cortex-M4", 1, "yes", "yes", 60),
    ("[{'Dcore':'Cortex-M0'}]", "Cortex-M0", 1, "no", "unknown", 18),
    ("[{'Dcore':'Cortex-M7','Dfpu':'DP_FPU','DcoreCount':'2'},{'Dcore':'Cortex-M4','Dfpu':'NO_FPU','Dmpu':'NO_MPU'}]", "Cortex-M4;Cortex-M7", 2, "yes", "no", 82),
    ("[]", "", None, "unknown", "unknown", None),
    ("[{'Dcore':'RV32','Dfpu':'n/a'}]", "RV32", 1, "unknown", "unknown", None),
]
RULE_FIELDS = "manufacturer match_type match_value feature_id display_name category quantity unit source_url verification_status notes".split()
RULES = [
    ("", "device", "Dev*[17]", "f1", "Neural accelerator", "npu", "1", "", "u", "manufacturer_datasheet", ""),
    ("1-URGENT", "device_prefix", "Dev1", "f2", "maybe", "x", "", "", "u", "proposed", ""),
    ("", "product_line", "F", "f3", "JPEG codec", "graphics", "1", "", "u", "cmsis_pack_metadata", ""),
    ("", "series", "3", "f4", "pending", "y", "", "", "u", "forum", "n"),
    ("", "device", "dev*", "f5", "never", "y", "", "", "u", "manufacturer_datasheet", "case matters"),
]


def devices(t):
    """Orders as devices: their lines are features, what they have of processors follows from the key."""
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    kind, n = (F.col("l_partkey") % len(KINDS)), F.col("l_quantity").cast("int")
    by_n = F.col("l_linenumber") == 2
    entry = F.struct("l_linenumber", at([k[0] for k in KINDS], kind).alias("type"), at([k[1] for k in KINDS], kind).alias("name"), at([k[2] for k in KINDS], kind).alias("m"), F.when(by_n, "").otherwise((n % 4).cast("string")).alias("count"), F.when(by_n, n.cast("string")).otherwise("").alias("n"), F.when(F.col("l_discount") > 0.07, "microchip_atdf").otherwise("cmsis").alias("source_kind"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    as_map = F.transform("lines", lambda x: F.create_map(*[y for c in ("type", "name", "m", "count", "n", "source_kind") for y in (F.lit(c), x[c])]))
    cell = at([p[0].replace("'", '"') for p in PROCESSORS], F.col("o_orderkey") % len(PROCESSORS))
    both = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    clock = F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 400 + 1) * 1e6)
    return both.select(F.col("o_orderkey").alias("device_id"), F.col("o_orderpriority").alias("manufacturer"), F.concat(F.lit("Dev"), F.col("o_orderkey").cast("string")).alias("device_name"), F.col("o_orderstatus").alias("product_line"), (F.col("o_custkey") % 10).cast("string").alias("series"), F.from_json(cell, "array<map<string,string>>").alias("processors"), as_map.alias("features"), clock.alias("max_clock_hz"), (F.col("o_custkey") % 2000 * 1024).alias("flash_bytes"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 900 * 1024).alias("ram_bytes"), F.lit("s").alias("source_id"), F.lit("").alias("verification_status"))


def records(t):
    return capability.records(devices(t), t.spark.createDataFrame(RULES, ", ".join(f"{c} string" for c in RULE_FIELDS)))


def _count_sql(types, tokens, without=()):
    hit = " OR ".join([*([f"lt IN ({', '.join(repr(x.lower()) for x in types)})"] if types else []), *[f"contains(ln, '{x}')" for x in tokens]])
    hit = f"({hit})" + "".join(f" AND NOT contains(ln, '{x}')" for x in without)
    return f"CASE WHEN coalesce(bool_or(exact) FILTER ({hit}), false) THEN sum(q) FILTER (({hit}) AND exact) ELSE sum(q) FILTER ({hit}) END"


def _present_sql(types, tokens):
    hit = "(" + " OR ".join([f"lt IN ({', '.join(repr(x.lower()) for x in types)})", *[f"contains(ln, '{x}')" for x in tokens]]) + ")"
    best = f"CASE WHEN bool_or(exact) FILTER ({hit}) THEN bool_or(q <> 0) FILTER ({hit} AND exact) ELSE bool_or(q <> 0) FILTER ({hit}) END"
    return f"CASE {best} WHEN true THEN 'yes' WHEN false THEN 'no' ELSE 'unknown' END"


_text = lambda v: "NULL" if v is None else repr(v)
_counts = ",\n  ".join(f"{f'coalesce({_count_sql(ty, ())}, {_count_sql((), to)})' if first else _count_sql(ty, to, ex)} AS {c}" for c, (ty, to, ex, first) in capability.COUNTS.items())
_widths = lambda types: f"coalesce(array_to_string(list_sort(list_distinct(CAST(flatten(list(string_split(w, ';')) FILTER (w <> '' AND lt IN ({types}))) AS INTEGER[]))), ';'), '')"
_SOURCE, _UNIT = "(lt IN ('adc', 'a/d') OR contains(ln, 'analog to digital'))", "(lt = 'adcunits' OR contains(ln, 'adc converter unit'))"
_CAPABILITY = f"""
kinds(k, type, name, m, w, category, points, special) AS (VALUES {', '.join(f"({i}, '{a}', '{b}', '{c}', '{w}', '{g}', {x}, {s})" for i, (a, b, c, w, g, x, s) in enumerate(KINDS))}),
processors(k, core_names, core_count, fpu_present, mpu_present, rank) AS (VALUES {', '.join(f"({i}, '{c}', {'NULL' if n is None else n}, '{u}', '{m}', {'NULL' if r is None else r})" for i, (_, c, n, u, m, r) in enumerate(PROCESSORS))}),
f AS (
  SELECT l_orderkey, type, lower(type) AS lt, lower(name) AS ln, w, category, points, special, l_discount > 0.07 AS exact,
    CASE WHEN l_linenumber = 2 THEN CAST(l_quantity AS INTEGER) ELSE CAST(l_quantity AS INTEGER) % 4 END AS q
  FROM lineitem JOIN kinds ON k = l_partkey % {len(KINDS)}),
g AS (SELECT l_orderkey,
  {_counts},
  {_present_sql(*capability.PRESENT['rtc_present'])} AS rtc_present, {_present_sql(*capability.PRESENT['crypto_accelerator_present'])} AS crypto_accelerator_present,
  {_widths("'timer'")} AS timer_width_bits, {_widths("'adc', 'adcunits', 'a/d'")} AS adc_resolution_bits, {_widths("'dac', 'd/a'")} AS dac_resolution_bits,
  sum(q) FILTER ({_SOURCE}) AS adc_source_quantity,
  CASE WHEN count(*) FILTER ({_SOURCE}) = 0 THEN 'unknown' WHEN bool_or(contains(ln, 'channel')) FILTER ({_SOURCE}) THEN 'channels' WHEN bool_or(contains(ln, 'converter') OR type = 'A/D') FILTER ({_SOURCE}) THEN 'converter_units' ELSE 'source_quantity_unspecified' END AS adc_quantity_semantics,
  CASE WHEN bool_or(exact) FILTER ({_UNIT}) THEN sum(q) FILTER ({_UNIT} AND exact) WHEN count(*) FILTER ({_UNIT}) > 0 THEN sum(q) FILTER ({_UNIT}) ELSE sum(q) FILTER (lt = 'a/d') END AS adc_unit_count,
  sum(q) FILTER ({_SOURCE} AND contains(ln, 'channel')) AS adc_channel_count,
  sum(q) FILTER (lt IN ('dac', 'd/a') OR contains(ln, 'digital to analog')) AS dac_source_quantity,
  coalesce(bool_or(type = 'CAN' AND contains(ln, 'fd')), false) AS fd,
  count(*) FILTER (points > 0 AND q <> 0) AS own_accelerators, max(points) FILTER (points > 0 AND q <> 0) AS own_points, count(*) FILTER (special AND q <> 0) AS n_special,
  coalesce(string_agg(category, ';' ORDER BY category) FILTER (category <> '' AND q <> 0), '') AS inventory
  FROM f GROUP BY l_orderkey),
r AS (
  SELECT g.*, o_orderkey AS device_id, o_orderpriority AS manufacturer, 'Dev' || CAST(o_orderkey AS VARCHAR) AS device_name, processors.* EXCLUDE (k),
    CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 400 + 1) * 1e6 END AS max_clock_hz, o_custkey % 2000 * 1024 AS flash_bytes, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 900 * 1024 END AS ram_bytes,
    o_orderkey % 10 IN (1, 7) AS rule_1, o_orderstatus = 'F' AS rule_3, (CASE WHEN o_orderpriority = '1-URGENT' AND starts_with('Dev' || CAST(o_orderkey AS VARCHAR), 'Dev1') THEN 1 ELSE 0 END) + (CASE WHEN o_custkey % 10 = 3 THEN 1 ELSE 0 END) AS n_pending
  FROM g JOIN orders ON o_orderkey = l_orderkey JOIN processors ON processors.k = o_orderkey % {len(PROCESSORS)})"""
_NUMBERS = [*capability.COUNTS, "adc_source_quantity", "adc_unit_count", "adc_channel_count", "dac_source_quantity"]


@query(f"""
WITH {_CAPABILITY}
SELECT device_id, manufacturer, device_name, core_names, replace(core_names, ';', '+') AS primary_core, core_count, max_clock_hz, fpu_present, mpu_present, 'unknown' AS dsp_extension_present, 'unknown' AS trustzone_present,
  {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _NUMBERS)}, timer_width_bits, adc_resolution_bits, dac_resolution_bits, adc_quantity_semantics, rtc_present, crypto_accelerator_present,
  CASE WHEN fd THEN 'yes' WHEN can_count IS NOT NULL THEN 'no' ELSE 'unknown' END AS can_fd_present,
  concat_ws(';', CASE WHEN core_names = '' THEN 'core' END, CASE WHEN max_clock_hz IS NULL THEN 'clock' END, CASE WHEN timer_count IS NULL THEN 'timer_count' END, CASE WHEN gpio_count IS NULL THEN 'gpio_count' END, CASE WHEN coalesce(adc_source_quantity, adc_unit_count, adc_channel_count) IS NULL THEN 'adc' END) AS missing_key_fields,
  's' AS source_id, 'derived_from_source_metadata' AS verification_status,
  inventory, own_accelerators + CAST(rule_1 AS INTEGER) + CAST(rule_3 AS INTEGER) AS n_accelerators, n_special, n_pending
FROM r""")
def device_capabilities(t):
    number = lambda c, name: F.json_array_length(c).cast("bigint").alias(name)
    listed = F.from_json("peripheral_inventory_json", "array<struct<category:string>>")
    inventory = F.array_join(F.array_sort(listed["category"]), ";").alias("inventory")
    held = records(t)
    return held.select(*[c for c in held.columns if not c.endswith("_json")], inventory, number("accelerators_json", "n_accelerators"), number("special_features_json", "n_special"), number("pending_feature_candidates_json", "n_pending"))


_log = lambda v, low, high: f"CASE WHEN {v} > 0 THEN least(100.0, greatest(0.0, 100 * (log2({v}) - log2({low})) / (log2({high}) - log2({low})))) END"
_mean = lambda *parts: "(" + " + ".join(f"coalesce({c} * {w}, 0)" for c, w in parts) + ") / nullif(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0.0 ELSE {w} END" for c, w in parts) + ", 0)"


@query(f"""
WITH {_CAPABILITY},
p AS (
  SELECT *, {_log('max_clock_hz', '8e6', '800e6')} AS clock, {_log('flash_bytes / 1024.0', '16.0', '4096.0')} AS flash, {_log('ram_bytes / 1024.0', '4.0', '1024.0')} AS ram,
    CASE fpu_present WHEN 'yes' THEN 60.0 WHEN 'no' THEN 0.0 END AS fpu, coalesce(spi_count, i2c_count, usart_count, uart_count) IS NOT NULL AS any_serial,
    greatest(own_points, CASE WHEN rule_1 THEN 100 END, CASE WHEN rule_3 THEN 65 END) AS best FROM r),
s AS (
  SELECT device_id, {_mean(('clock', 60.0), ('rank', 40.0))} AS compute, {_mean(('flash', 55.0), ('ram', 45.0))} AS memory, {_mean(('fpu', 35.0), ('best', 65.0))} AS accelerator,
    CASE WHEN coalesce(timer_count, adc_channel_count, dac_source_quantity, CASE WHEN any_serial THEN 1 END, can_count, usb_device_count, usb_host_count, ethernet_count, gpio_count) IS NOT NULL THEN least(100.0,
      CASE WHEN timer_count IS NULL THEN 0 ELSE least(25, timer_count / 12 * 25) END + CASE WHEN adc_channel_count IS NULL THEN 0 ELSE least(12, adc_channel_count / 16 * 12) END + CASE WHEN dac_source_quantity IS NULL THEN 0 ELSE least(5, dac_source_quantity / 2 * 5) END
      + CASE WHEN any_serial THEN least(20, (coalesce(spi_count, 0) + coalesce(i2c_count, 0) + coalesce(usart_count, 0) + coalesce(uart_count, 0)) / 12 * 20) ELSE 0 END
      + CASE WHEN can_count > 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(usb_device_count, 0) + coalesce(usb_host_count, 0) > 0 THEN 10 ELSE 0 END + CASE WHEN ethernet_count > 0 THEN 8 ELSE 0 END + CASE WHEN gpio_count IS NULL THEN 0 ELSE least(10, gpio_count / 100 * 10) END) END AS peripheral
  FROM p),
i AS (SELECT *, {_mean(('compute', 35.0), ('memory', 25.0), ('peripheral', 25.0), ('accelerator', 15.0))} AS index, CASE WHEN compute IS NULL THEN 0 ELSE 35 END + CASE WHEN memory IS NULL THEN 0 ELSE 25 END + CASE WHEN peripheral IS NULL THEN 0 ELSE 25 END + CASE WHEN accelerator IS NULL THEN 0 ELSE 15 END AS coverage FROM s)
SELECT device_id, {', '.join(f"CAST(round_even({c}, 0) AS INTEGER) AS {c}_score" for c in ('compute', 'memory', 'peripheral', 'accelerator'))}, CAST(round_even(index, 0) AS INTEGER) AS selection_index, coverage AS score_coverage_percent, 'not_imported' AS benchmark_status
FROM i""")
def device_scores(t):
    found = score.of_records(records(t), devices(t), capability.CORE_RANKS)
    return found.select("device_id", "compute_score", "memory_score", "peripheral_score", "accelerator_score", "selection_index", "score_coverage_percent", "benchmark_status")
