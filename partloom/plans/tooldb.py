"""A tool database written as XML files from the parts' table, one for 40 parts, read again and matched."""

import uuid

from pyspark.sql import functions as F

from partloom.session import shared_dir
from partloom.sources import archives, tooldb

from .catalog import query

_PIN = "concat('<Pin Name=\"P', k, '\"', if(k % 40 = 3, '', concat(' Position=\"', k % 40, '\"')), ' Type=\"', if(s % 2 = 0, 'I/O', 'Power'), '\"><Signal Name=\"', element_at(array('adc1_IN5', 'ADC_VINP', 'TIM1_CH1', 'ADC12_INP3', 'ADC_X'), cast(k % 5 + 1 as int)), '\"/><Signal Name=\"GPIO\"/></Pin>')"
_IP = "concat('<IP Name=\"', element_at(array('ADC', 'TIM', 'SPI', 'USART', 'FREERTOS', 'GPIO', 'USB', 'LTDC', 'XYZ', 'CAN'), cast(k % 10 + 1 as int)), '\" InstanceName=\"', element_at(array('ADC1', concat('TIM', k % 40), 'SPI1', concat('USART', k % 3), 'FREERTOS', 'GPIO', 'USB_OTG_FS', 'LTDC', '', 'FDCAN1'), cast(k % 10 + 1 as int)), '\"/>')"


def _written(t):
    folder = f"{shared_dir(t.spark).rstrip('/')}/tooldb-{uuid.uuid4().hex}"
    rows = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")).withColumn("d", F.expr("k div 40"))
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.expr(f"concat({_PIN}, {_IP})").alias("x")))), lambda p: p["x"]), "")
    files = rows.groupBy("d").agg(inside.alias("x"), F.sum("s").alias("io"))
    archives.write_files(files.filter("d % 7 <> 0").select(F.concat(F.lit("MCU"), "d", F.lit(".xml")).alias("name"), F.concat(F.lit('<Mcu RefName="x">'), "x", F.lit("</Mcu>")).alias("text")), f"{folder}/mcu")
    entry = F.expr("concat('<Mcu RefName=\"REF', d, '\" RPN=\"RPN', d, '\" Name=\"MCU', d, '\" PackageName=\"LQFP', d, '\"><Frequency>', if(d % 3 = 0, '', '72.5'), '</Frequency><Flash>64</Flash>', if(d % 2 = 0, '<Flash>128</Flash>', ''), '<Ram>20</Ram><IONb>', io, '</IONb></Mcu>')")
    twice = F.expr("if(d % 5 = 0, concat('<Mcu RefName=\"REF', d, '\" Name=\"OTHER\"/>'), '')")
    families = files.select(F.concat(F.lit("f"), (F.col("d") % 4).cast("string")).alias("f"), F.concat(entry, twice).alias("x"), "d")
    index = families.groupBy("f").agg(F.concat(F.lit("<Families><Family><SubFamily>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]), ""), F.lit("</SubFamily></Family></Families>")).alias("text"))
    archives.write_files(index.select(F.concat("f", F.lit(".xml")).alias("name"), "text"), f"{folder}/families")
    return folder


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey // 40 AS d FROM part),
g AS (
  SELECT d, count(*) AS pins, sum(s) AS io, count(DISTINCT CASE WHEN s % 2 = 0 AND k % 5 IN (0, 1, 3) THEN k END) AS adc,
         bool_or(k % 10 = 0) AS i0, bool_or(k % 10 = 2) AS i2, bool_or(k % 10 = 6) AS i6, bool_or(k % 10 = 7) AS i7, bool_or(k % 10 = 8) AS i8, bool_or(k % 10 = 9) AS i9,
         count(*) FILTER (k % 10 = 1) AS timers, string_agg('TIM' || (k % 40), ', ' ORDER BY 'TIM' || (k % 40)) FILTER (k % 10 = 1) AS timer_names,
         count(DISTINCT k % 3) FILTER (k % 10 = 3) AS usarts, array_to_string(list_sort(list(DISTINCT 'USART' || (k % 3)) FILTER (k % 10 = 3)), ', ') AS usart_names
  FROM p GROUP BY d),
n AS (
  SELECT *, CASE d % 4 WHEN 0 THEN 'REF' || d WHEN 1 THEN 'RPN' || d WHEN 2 THEN 'MCU' || d ELSE 'REF' || d || 'TR' END AS name,
         CASE WHEN d % 11 = 10 THEN 'no_exact_identifier_match' WHEN d % 5 = 0 AND d % 4 IN (0, 3) THEN 'ambiguous_exact_identifier' WHEN d % 7 = 0 THEN 'matched_families_entry_missing_device_xml' END AS reason
  FROM g)
SELECT d, CASE WHEN d % 11 = 10 THEN 'none' ELSE name END AS name, CASE WHEN reason IS NULL THEN CASE d % 4 WHEN 0 THEN 'exact_refname' WHEN 1 THEN 'exact_rpn' WHEN 2 THEN 'exact_name' ELSE 'packing_suffix_removed:TR' END END AS rule, reason,
       CASE WHEN reason <> 'no_exact_identifier_match' THEN 'REF' || d END AS candidate_refs, CASE WHEN reason IS NULL AND d % 3 <> 0 THEN 72500000 END::BIGINT AS max_clock_hz, CASE WHEN reason IS NULL AND d % 2 = 1 THEN 65536 END::BIGINT AS flash_bytes, CASE WHEN reason IS NULL THEN 20480 END::BIGINT AS ram_bytes,
       CASE WHEN reason IS NULL THEN 'LQFP' || d END AS package, CASE WHEN reason IS NULL THEN pins END::INTEGER AS n_pins,
       CASE WHEN reason IS NULL THEN concat_ws(';', CASE WHEN timers > 0 THEN 'Timer:' || timer_names || ':' || timers END, CASE WHEN i0 THEN 'ADCUnits:ADC1:1' END, 'IOs:' || io || ' selectable I/O pins:' || io, CASE WHEN i2 THEN 'SPI:SPI1:1' END, CASE WHEN usarts > 0 THEN 'USART:' || usart_names || ':' || usarts END,
         CASE WHEN i9 THEN 'CAN:FDCAN1:1' END, CASE WHEN i6 THEN 'USBOTG:USB_OTG_FS:1' END, CASE WHEN i7 THEN 'GLCD:LTDC:1' END, 'ADCExternalPins:External package pins with ADC input signals:' || adc, CASE WHEN i8 THEN 'XYZ:XYZ:1' END) END AS features
FROM n""")
def tool_database(t):
    """Devices matched with a tool database's entries and files; counts of 0 are left out here."""
    folder = _written(t)
    name = F.expr("CASE WHEN d % 11 = 10 THEN 'none' WHEN d % 4 = 0 THEN concat('REF', d) WHEN d % 4 = 1 THEN concat('RPN', d) WHEN d % 4 = 2 THEN concat('MCU', d) ELSE concat('REF', d, 'TR') END")
    devices = t.part.select(F.expr("p_partkey div 40 AS d")).distinct().withColumn("name", name)
    r = tooldb.matched(devices, tooldb.read_entries(t.spark, f"{folder}/families"), tooldb.read_devices(t.spark, f"{folder}/mcu"), "d", "name")
    shown = F.filter("features", lambda f: (f["count"] != "0") | (f["type"] == "IOs") | (f["type"] == "ADCExternalPins"))
    return r.withColumn("features", F.array_join(F.transform(shown, lambda f: F.concat_ws(":", f["type"], f["name"], f["count"])), ";"))
