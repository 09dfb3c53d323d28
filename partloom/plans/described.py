"""Device descriptions as XML, written from the parts' table and read again: records, parts, features and an overlay."""

from pyspark.sql import functions as F

from partloom.sources import descriptions

from .catalog import query

_EACH = "array_join(transform(sequence(0, {n} - 1), i -> concat({what})), '')"


def _repeat(n: str, *what: str) -> str:
    return f"if({n} < 1, '', {_EACH.format(n=f'greatest({n}, 1)', what=', '.join(what))})"


#: A description of part k of size s: broken for k % 13 = 0, without a device for k % 11 = 0.
XML = f"""concat('<avr-tools-device-file><variants>',
 '<variant ordercode="', name, '-AU" package="TQFP', 32 + k % 2 * 12, '" pinout="A" speedmax="16000000" tempmin="-40" tempmax="85"/>',
 '<variant ordercode="', upper(name), '-au" package="', if(k % 5 = 0, '', 'QFN28'), '" pinout="B" speedmax="', element_at(array('16000000', '0x1312D00', '0x989680'), cast(k % 3 + 1 as int)), '"/>',
 '<variant ordercode="', name, '-MU/SS" pinout="gone"/><variant ordercode=" ', name, '-P', s, '" package="', if(k % 5 = 0, '', 'PDIP'), '" tempmin="-40"/>',
 '<variant ordercode="standard"/><variant ordercode="X', k, '"/></variants><pinouts><pinout name="A">',
 {_repeat("s % 8 + 1", "'<pin position=\"1\" pad=\"PA'", "i", "'\"/>'")}, '<pin pad="VCC"/><pin position="9"/><pin pad="PB0"/><pin pad="PB0"/></pinout>',
 if(k % 7 = 0, '', '<pinout name="B"><pin pad="PA0"/><pin pad="PC1"/><pin pad="RESET"/></pinout>'), '<pinout name="C"><pin pad="PZ9"/></pinout></pinouts><devices>',
 if(k % 11 = 0, '', concat('<device name="', name, '" family="', if(k % 8 = 1, 'tinyAVR 2', 'AVR'), '"', if(k % 3 = 0, ' architecture="AVR8X"', ''), '><address-spaces><address-space>',
  '<memory-segment name="PROGMEM" type="flash" start="0x0" size="', s * 1024, '"/><memory-segment name="APP_SECTION" type="flash" size="', s * 512, '"/><memory-segment name="BOOT_SECTION_1" type="FLASH" size="0x100000"/><memory-segment name="USER_ROW" type="flash" size="64"/></address-space>',
  '<address-space><memory-segment name="IRAM" type="ram" size="2048"/><memory-segment name="SRAM2" type="ram" size="0x100"/><memory-segment name="CMCC_X" type="ram" size="128"/><memory-segment name="FRAM" type="ram" size="1000.5"/><memory-segment name="XRAM" type="ram" size="4096" external="True"/><memory-segment name="EE" type="eeprom" size="512"/><memory-segment name="BAD" type="ram" size="abc"/></address-space></address-spaces><peripherals>',
  '<module name="TC">', {_repeat("s % 3 + 1", "'<instance name=\"TC'", "i", "'\"><signals><signal group=\"TIO\" index=\"'", "i * 2", "'\"/><signal group=\"TIO\" index=\"'", "i * 2 + 1", "'\"/></signals></instance>'")}, '</module>',
  '<module name="ADC"><instance name="ADC0"><signals>', {_repeat("s % 10 + 1", "'<signal group=\"ADC\" function=\"ADC'", "i", "'\"'", "if(k % 2 = 0, concat(' index=\"', i, '\"'), '')", "' pad=\"PA'", "i", "'\"/>'")},
  '<signal group="x" function="ain5" pad="PZ9"/><signal group="REF" function="AREF" index="77" pad="PA0"/><signal group="AD" index="', k % 5, '" pad="PB0"/><signal group="AD" index="', k % 3, '"/></signals></instance></module>',
  '<module name="SERCOM">', if(k % 2 = 1, '<instance name="SERCOM0"/>', ''), '</module><module name="USART">', {_repeat("k % 3", "'<instance name=\"USART'", "i", "'\"/>'")}, '</module>',
  '<module name="ccl"><instance name="CCL0"/></module><module name="EVSYS"/><module name="PORT"><instance name="PORTA"/></module><module name="WDT"><instance/></module><module name="ZCD"><instance name="ZCD1"/><instance name="ZCD0"/></module></peripherals></device>')),
 '</devices></avr-tools-device-file>')"""
NAME = "element_at(array(concat('ATmega', k), concat('ATtiny', k), concat('AVR', k, 'DA', k % 64 + 1), concat('ATA', k)), cast(k % 4 + 1 as int))"


def _files(t):
    named = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")).selectExpr("k", "s", f"{NAME} AS name")
    return named.selectExpr("k AS p_partkey", f"if(k % 13 = 0, '<devices><', {XML}) AS xml")


def _said(features):
    return F.array_join(F.transform(features, lambda f: F.concat_ws(":", f["type"], f["name"], f["count"])), ";")


_BASE = """
WITH b AS (
  SELECT p_partkey, p_partkey AS k, p_size AS s,
         CASE p_partkey % 4 WHEN 0 THEN 'ATmega' || p_partkey WHEN 1 THEN 'ATtiny' || p_partkey WHEN 2 THEN 'AVR' || p_partkey || 'DA' || (p_partkey % 64 + 1) ELSE 'ATA' || p_partkey END AS name,
         p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AS good
  FROM part),
r AS (
  SELECT *,
         CASE k % 4 WHEN 0 THEN CASE WHEN k % 3 = 0 THEN 'megaAVR 0-series' ELSE 'Classic ATmega' END
                    WHEN 1 THEN CASE WHEN k % 8 = 1 THEN 'tinyAVR 2-series' WHEN k % 3 = 0 THEN 'tinyAVR 0/1-series' ELSE 'Classic ATtiny' END
                    WHEN 2 THEN 'AVR DA' ELSE 'Automotive AVR' END AS line,
         CASE k % 4 WHEN 0 THEN '' || k WHEN 1 THEN '' || k WHEN 2 THEN k || 'DA' || (k % 64 + 1) ELSE name END AS code,
         CASE WHEN k % 5 = 0 THEN 'TQFP' || (32 + k % 2 * 12) ELSE 'PDIP;QFN28;TQFP' || (32 + k % 2 * 12) END AS packages,
         array_to_string(list_transform(range(0, s % 3 + 1), lambda i: 'TC' || i), ', ') || ':' || (s % 3 + 1) AS timers,
         coalesce(nullif(array_to_string(list_transform(range(0, k % 3), lambda i: 'USART' || i), ', '), ''), 'ATDF exact instance count') || ':' || (k % 3) AS usarts,
         s % 8 + 2 + CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS ports,
         least(s % 10, s % 8) + 1 AS pads
  FROM b)
"""
_NONE = lambda *kinds: ";".join(f"{k}:ATDF exact instance count:0" for k in kinds)

AVR_SQL = _BASE + f"""
SELECT p_partkey, CASE WHEN NOT good THEN 'no devices/device name' END AS error,
       CASE WHEN good THEN name END AS device_name, CASE WHEN good THEN line END AS product_line, CASE WHEN good THEN code END AS variant_code,
       CASE WHEN good THEN CASE WHEN k % 3 = 0 THEN 'AVR8X' ELSE 'AVR8' END END AS architecture,
       CASE WHEN good THEN CASE WHEN k % 3 = 1 THEN 20000000 ELSE 16000000 END END::BIGINT AS max_clock_hz,
       CASE WHEN good THEN s * 1024 END::BIGINT AS flash_bytes, CASE WHEN good THEN 2432 END::BIGINT AS ram_bytes,
       CASE WHEN good THEN packages END AS packages,
       CASE WHEN good THEN CASE WHEN k % 7 = 0 THEN '' ELSE '3;' END || (s % 8 + 5) END AS pin_counts,
       CASE WHEN good THEN '[{{"name":"PROGMEM","size":"' || s * 1024 || '","start":"0x0","type":"flash"}},{{"name":"APP_SECTION","size":"' || s * 512 || '","type":"flash"}},{{"name":"BOOT_SECTION_1","size":"0x100000","type":"flash"}},{{"name":"USER_ROW","size":"64","type":"flash"}},{{"name":"IRAM","size":"2048","type":"ram"}},{{"name":"SRAM2","size":"0x100","type":"ram"}},{{"name":"CMCC_X","size":"128","type":"ram"}},{{"external":"True","name":"XRAM","size":"4096","type":"ram"}},{{"name":"EE","size":"512","type":"eeprom"}}]' END AS memory_regions_json,
       CASE WHEN good THEN 'Timer:' || timers || ';ADCUnits:ADC0:1;{_NONE("DAC", "SPI", "I2C")};USART:' || usarts || ';{_NONE("UART", "CAN", "USBD")};WDT:WDT:1;{_NONE("RTC", "COMP", "OPAMP")}'
         || ';IOs:GPIO pads present in official package pinouts:' || ports || ';ADC:ADC external signal channels:' || (s % 10 + 2) || ';ADCExternalPins:External package pads with ADC input signals:' || pads
         || CASE WHEN k % 2 = 1 THEN ';SERCOM:SERCOM0:1' ELSE '' END || ';VendorCapability:CCL configurable custom logic:1;VendorCapability:Zero-Cross Detector (ZCD):1;ZCD:ZCD0:1;ZCD:ZCD1:1;ccl:CCL0:1' END AS features
FROM r"""


@query(AVR_SQL)
def avr_descriptions(t):
    """Records of 8-bit descriptions: pads of the variants' pinouts, converter channels by index, the largest flash segment."""
    r = descriptions.avr_records(_files(t))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ";").alias(c)
    return r.select("p_partkey", "error", "device_name", "product_line", "variant_code", "architecture", "max_clock_hz", "flash_bytes", "ram_bytes", joined("packages"), joined("pin_counts"), "memory_regions_json", _said(F.col("features")).alias("features"))


@query(
    _BASE
    + """
, p AS (
  SELECT name, line, unnest([name || '-AU', name || '-P' || s]) AS part_number, unnest(['TQFP' || (32 + k % 2 * 12), CASE WHEN k % 5 = 0 THEN '' ELSE 'PDIP' END]) AS package, unnest(['-40..85 °C', '']) AS temperature
  FROM r WHERE good)
SELECT 'microchip::' || trim(regexp_replace(lower(part_number), '[^a-z0-9]+', '-', 'g'), '-') AS orderable_part_id, 'microchip::' || lower(name) AS device_id, line AS product_line, name AS device_name, part_number, substr(part_number, length(name) + 1) AS suffix, package, temperature FROM p"""
)
def avr_parts(t):
    """Orderable parts of the descriptions: own order codes, no selectors, the first of codes that differ by case."""
    return descriptions.part_rows(descriptions.avr_records(_files(t)))


_SAM_FEATURES = f"""'Timer:' || timers || ';ADCUnits:ADC0:1;{_NONE("DAC")};IOs:' || array_to_string(list_transform(range(0, s % 8 + 1), lambda i: 'PA' || i), ', ') || ', PB0' || CASE WHEN k % 7 = 0 THEN '' ELSE ', PC1' END || ':' || ports
  || CASE WHEN k % 2 = 1 THEN ';{_NONE("I2S")}' ELSE ';{_NONE("SPI", "I2C", "I2S")};USART:' || usarts || ';{_NONE("UART")}' END
  || ';{_NONE("CAN", "ETH", "SDIO", "DMA", "RNG", "RTC")};WDT:WDT:1;{_NONE("COMP", "OPAMP", "Touch", "Camera", "GLCD", "ExtBus", "ExtInt")};Com:' || CASE WHEN k % 2 = 1 THEN 'SERCOM0:1' ELSE 'ATDF exact instance count:0' END
  || ';ADCExternalPins:External package pads with ADC input signals:' || (pads + 2) || ';ZCD:ZCD0:1;ZCD:ZCD1:1;ccl:CCL0:1'"""


@query(
    _BASE
    + f"""
SELECT p_partkey, CASE WHEN NOT good THEN 'no devices/device name' END AS error, CASE WHEN good THEN name END AS device_name,
       CASE WHEN good AND k % 3 = 0 THEN 16000000 END::BIGINT AS max_clock_hz, CASE WHEN good THEN s * 1536 + 1048576 END::BIGINT AS flash_bytes, CASE WHEN good THEN 3304 END::BIGINT AS ram_bytes,
       CASE WHEN good AND k % 5 = 0 THEN packages END AS package, CASE WHEN good AND k % 7 = 0 THEN s % 8 + 5 END::INTEGER AS pin_count, CASE WHEN good THEN {_SAM_FEATURES} END AS features
FROM r"""
)
def sam_descriptions(t):
    """Records of 32-bit descriptions: single-valued facts, summed memories, serial kinds unknown beside configurable blocks."""
    r = descriptions.sam_records(_files(t))
    return r.select("p_partkey", "error", "device_name", "max_clock_hz", "flash_bytes", "ram_bytes", "package", "pin_count", _said(F.col("features")).alias("features"))


@query(
    _BASE
    + f"""
, f AS (SELECT *, {_SAM_FEATURES} AS features FROM r WHERE good)
SELECT p_partkey, packages, CASE WHEN k % 5 = 0 THEN '' ELSE '28;' END || (32 + k % 2 * 12) AS pin_counts,
       array_to_string(list_filter(string_split(features, ';'), lambda x: NOT regexp_matches(x, '^(Timer|IOs|ADCExternalPins|DAC|ComOther|DACC):')), ';')
         || ';Timer:TC channel indices:' || (s % 3 + 1) * 2 || ';PWM:PWM controller:1;ADC:ADC external signal channels:' || CASE WHEN k % 5 = k % 3 THEN 1 ELSE 2 END
         || ';ADCExternalPins:External pads with ADC input signals:1;DAC:DACC controller:1;USBOTG:UOTGHS USB OTG controller:1' AS features
FROM f"""
)
def sam3x_overlay(t):
    """The overlay of one family: kinds dropped, timers and channels counted again by signal index, all packages."""
    r = descriptions.sam3x_overlay(descriptions.sam_records(_files(t)).filter("error is null"))
    return r.select("p_partkey", F.array_join("packages", ";").alias("packages"), F.array_join(F.col("pin_counts").cast("array<string>"), ";").alias("pin_counts"), _said(F.col("features")).alias("features"))
