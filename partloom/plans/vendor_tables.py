"""Rows of a vendor's product table made from the parts' table, and their features."""

from pyspark.sql import functions as F

from partloom.operators import vendor_tables

from .catalog import query

#: Columns by SQL that both engines read; k and s are the part's key and size.
RAW = {
    "ADC": "CASE k % 5 WHEN 0 THEN concat('2/', s) WHEN 1 THEN concat(s, '*10b') WHEN 2 THEN '-' WHEN 3 THEN concat(s, ' ch') ELSE '' END", "TouchKey/ADC": "CASE k % 3 WHEN 0 THEN concat(s, '/8') WHEN 1 THEN '-/7' ELSE '' END", "IIC": "CASE k % 2 WHEN 0 THEN '2' ELSE '-' END", "SPI": "'x3.5'", "CAN": "'0'",
    "UART": "concat(k % 10, '')", "Advanced TM": "CASE WHEN k % 4 = 0 THEN '2/3' ELSE '' END", "Timer": "CASE k % 4 WHEN 1 THEN '4*26b' WHEN 2 THEN '5' ELSE 'none' END", "OPA": "CASE k % 3 WHEN 0 THEN '0' WHEN 1 THEN '2' END", "GPIO": "concat(s, '')", "WDOG": "'2'", "RTC": "CASE k % 2 WHEN 0 THEN 'Y' ELSE '-' END",
    "USB_20": "CASE k % 4 WHEN 0 THEN '2*H+D' WHEN 1 THEN 'OTG 1*h' WHEN 2 THEN 'no' ELSE 'HS device' END", "USB_20H": "CASE WHEN k % 8 = 0 THEN 'D' END", "Ethernet": "CASE k % 3 WHEN 0 THEN '100Mb' WHEN 1 THEN 'MAC' ELSE 'none' END", "BLE": "CASE WHEN k % 5 = 0 THEN '5.1' END", "PWM": "'8 ch'", "DataFlash": "CASE WHEN k % 7 = 0 THEN '32K' ELSE 'NO' END",
    "Other Features": "CASE k % 4 WHEN 0 THEN 'dvp<br>OPA, zig' WHEN 1 THEN '-' ELSE '' END", "SERDES/HSPI/DVP": "CASE WHEN k % 6 = 0 THEN '1.2GB' ELSE 'yes' END", "ETH/SATA": "CASE k % 6 WHEN 0 THEN '-/SATA2' WHEN 1 THEN '1000Mb/SATA' END", "CAP": "CASE WHEN k % 9 = 0 THEN '3.3' END", "Encrypt": "CASE WHEN k % 10 = 0 THEN 'AES' END", "VDD": "'3.3'", "Core": "CASE WHEN k % 3 = 0 THEN '3.3' ELSE 'V4' END",
}
PART = "CASE k % 4 WHEN 0 THEN 'ch32v307x' WHEN 1 THEN 'CH582' ELSE 'CH32V103' END"
_usart = "CASE k % 4 WHEN 0 THEN CASE WHEN k % 10 >= 8 THEN 3 ELSE 0 END WHEN 1 THEN 0 ELSE k % 10 END"


@query(f"""
WITH p AS (SELECT p_partkey AS k, p_size AS s, {_usart.replace('k', 'p_partkey')} AS usart FROM part),
c AS (
  SELECT *, CASE k % 5 WHEN 1 THEN '10-bit' ELSE '12-bit' END AS w, CASE k % 5 WHEN 0 THEN s WHEN 1 THEN s WHEN 3 THEN s ELSE CASE k % 3 WHEN 0 THEN 8 WHEN 1 THEN 7 END END AS ch FROM p)
SELECT k AS p_partkey, concat_ws(';', CASE WHEN ch IS NOT NULL THEN 'ADC|' || w || ' ADC channels|' || ch || '|' || w END, CASE WHEN k % 5 = 0 THEN 'ADCUnits|ADC converter units|2|12-bit' END, CASE WHEN k % 3 = 0 THEN 'Touch|TouchKey channels|' || s || '|' END,
  CASE WHEN k % 2 = 0 THEN 'I2C|I²C|2|' END, 'SPI|SPI|3|', CASE WHEN usart > 0 THEN 'USART|USART|' || usart || '|' END, CASE WHEN k % 10 > usart THEN 'UART|UART|' || (k % 10 - usart) || '|' END,
  CASE k % 4 WHEN 0 THEN 'Timer|Advanced/general timer groups|5|2/3' WHEN 1 THEN 'Timer|Advanced/general timer groups|4|26' WHEN 2 THEN 'Timer|Advanced/general timer groups|5|5/0' END, CASE WHEN k % 3 = 1 THEN 'OPAMP|OPA / comparator|2|' END, 'IOs|GPIO|' || s || '|', 'WDT|Watchdog timers|2|', CASE WHEN k % 2 = 0 THEN 'RTC|RTC|1|' END,
  CASE k % 4 WHEN 0 THEN 'USBH|USB Host|2|;USBD|USB Device|' || CASE WHEN k % 8 = 0 THEN 2 ELSE 1 END || '|' WHEN 1 THEN 'USBOTG|USB OTG: OTG 1*h|1|;USBH|USB Host|1|' END,
  CASE WHEN k % 3 = 0 THEN 'ETH|Ethernet: 100Mb|1|' END, CASE WHEN k % 5 = 0 THEN 'Bluetooth|Bluetooth LE 5.1|1|' END, 'PWM|PWM channels|8|', CASE WHEN k % 7 = 0 THEN 'DataFlash|Data Flash / EEPROM (32K)|1|32K' END, CASE WHEN k % 4 = 0 THEN 'Camera|WCH DVP|1|;VendorCapability|WCH ZIG|1|' END,
  CASE WHEN k % 6 = 0 THEN 'VendorCapability|SERDES / HSPI / DVP (1.2GB)|1|1.2GB' END, CASE k % 6 WHEN 0 THEN 'VendorCapability|Ethernet / SATA (-/SATA2)|1|-/SATA2' WHEN 1 THEN 'ETH|Ethernet / SATA (1000Mb/SATA)|1|1000Mb/SATA' END,
  CASE WHEN k % 9 = 0 THEN 'VendorCapability|WCH CAP raw parameter (3.3)|1|3.3' END, CASE WHEN k % 10 = 0 THEN 'Crypto|WCH encryption (AES)|1|AES' END, CASE WHEN k % 9 <> 0 THEN 'VendorCapability|WCH VDD: 3.3|1|3.3' END, CASE WHEN k % 3 <> 0 THEN 'VendorCapability|WCH Core: V4|1|V4' END) AS features
FROM c""")
def vendor_table_features(t):
    """The features of a vendor's product table, column by column."""
    cells = F.map_filter(F.create_map(*[x for c, e in RAW.items() for x in (F.lit(c), F.expr(e))]), lambda k, v: v.isNotNull())
    rows = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")).select("k", F.explode(F.array(F.struct(cells.alias("raw"), F.expr(PART).alias("part")))).alias("g"))
    found = rows.select("k", F.explode(F.array(vendor_tables.table_features(F.col("g.raw"), F.col("g.part")))).alias("f"))
    shown = F.transform("f", lambda f: F.concat_ws("|", f["type"], f["name"], f["count"].cast("string"), F.coalesce(f["m"], F.lit(""))))
    return found.select(F.col("k").alias("p_partkey"), F.array_join(shown, ";").alias("features"))
