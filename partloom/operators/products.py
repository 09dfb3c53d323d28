"""Rows of a product selector as several tables in one pass: device, part, features and provenance as tagged records.

A row becomes one array of (kind, record_id, body) records, bodies as JSON; the array is exploded and written by kind
once, and each table is a folder of that. The selector is read once, whatever the number of tables.

Defined results: a row without a part number, or without a positive count of UARTs, gives one error record and nothing
else; blanks and the words for none give no feature and blanks no provenance; a count of 0 gives no feature.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions.exprs import number, slug_each
from partloom.session import shared_dir

from .rules import cpu_name, lifecycle

# Words for none, and the features by their kind: how the count is found, in which column, the name, and the detail.
NONE, NO_NUMBER = ["", "N/A", "NA", "-", "0", "NO"], ["", "N/A", "NA", "-"]
FEATURES = [
    ("ADC", "adc3", "adc", "ADC channels", "adc2"), ("ADCUnits", "adc1", "adc", "ADC converter units", "adc2"), ("DAC", "dac1", "dac", "DAC converter units", "dac2"), ("Touch", "value", "touch_sensor", "Capacitive touch channels", ""), ("TempSens", "value", "temperature_sensor", "Temperature sensor", ""),
    ("IOs", "value", "gpio", "GPIO", ""), ("UART", "value", "uart", "", ""), ("SPI", "value", "spi", "", ""), ("SDIOHost", "value", "sdio_host", "", ""), ("SDIOSlave", "value", "sdio_slave", "", ""), ("I2S", "value", "i2s", "", ""), ("I2C", "value", "i2c", "", ""), ("I3C", "value", "i3c", "", ""),
    ("RMT", "quantity", "rmt", "Remote control transceiver", "own"), ("LEDPWM", "quantity", "ledpwm", "LED PWM controller", "own"), ("MCPWM", "quantity", "mcpwm", "Motor-control PWM", "own"), ("USBOTG", "value", "usb_otg", "", ""), ("ETH", "value", "ethernet_mac", "Ethernet MAC", ""), ("CAN", "value", "can", "TWAI controller", ""),
    ("Camera", "one", "camera_interface", "own", ""), ("Hall", "value", "hall_sensor", "Hall sensor", ""), ("TOF", "one", "tof", "Time-of-flight interface", ""), ("JTAG", "one", "jtag", "", ""), ("WiFi", "one", "wifi", "own", ""), ("WiFi6", "one", "wifi6", "own", ""), ("Bluetooth", "one", "bluetooth", "own", ""),
    ("IEEE802154", "one", "thread_802_15_4", "IEEE 802.15.4 / Thread / Zigbee", ""), ("PSRAM", "value", "psram", "Integrated/in-package PSRAM", "MB"), ("RTC_RAM", "value", "rtc_sram", "RTC SRAM", "KB"),
]
OTHERS = "mpn name series cpu freq core flash sram rom package pins status temperature_range".split()
COLUMNS = list(dict.fromkeys([*OTHERS, *[f[2] for f in FEATURES]]))
MB, KB = 1024 * 1024, 1024
DEVICE = "device_id string, product_line_id string, product_type string, architecture_class string, series string, product_line string, device_name string, generic_device_name string, variant_code string, core string, core_count bigint, max_clock_hz bigint, flash_bytes bigint, ram_bytes bigint, rom_bytes bigint, psram_bytes bigint, package string, pins bigint, lifecycle string"
PART = "orderable_part_id string, device_id string, part_number string, suffix string, package string, temperature_range string, lifecycle string"
FEATURE = "position int, type string, n string, name string, m string"
PROVENANCE = "field_name string, source_path string, source_value_json string"
ERROR = "item string, error string"


def available(x: Column) -> Column:
    return x.isNotNull() & ~x.isin(*NONE)


def any_number(x: Column) -> Column:
    """A number, or the first one inside a text; null for blanks and the words for none."""
    return F.when(~x.isin(*NO_NUMBER), F.coalesce(number(x), number(F.nullif(F.regexp_extract(x, r"\d+(?:\.\d+)?", 0), F.lit("")))))


def integer(x: Column) -> Column:
    return any_number(x).cast("bigint")


def quantity_of(x: Column) -> Column:
    """The number of controllers in a text such as 2*8; never that of their channels."""
    t = F.trim(F.coalesce(x, F.lit("")))
    return F.when(t != "", F.coalesce(F.regexp_extract(t, r"^(\d+)\s*\*", 1).try_cast("bigint"), integer(x)))


def architecture(cpu: Column) -> Column:
    low = F.lower(F.coalesce(cpu, F.lit("")))
    return F.when(F.contains(low, F.lit("risc-v")), "RISC-V").when(low.rlike("xtensa|lx6|lx7|l106"), "Xtensa").otherwise("unknown")


def converter(x: Column, kind: str, part: int) -> Column:
    """Units (1), bits (2) or channels (3) of a converter such as `2*12-bit ADC, 20 channels`; null for 0."""
    pattern = r"(?i)(\d+)\s*\*\s*(\d+)\s*-?bit\s+ADC,\s*(\d+)\s+channels?" if kind == "adc" else r"(?i)(\d+)\s*\*\s*(\d+)\s*-?bit\s+DAC"
    return F.nullif(F.regexp_extract(x, pattern, part).try_cast("bigint"), F.lit(0).cast("bigint"))


def features(columns: list[str]) -> Column:
    """The features of a row, in their order; a column that the selector does not have is blank."""
    held = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    each = []
    for kind, how, column, name, detail in FEATURES:
        raw = held(column)
        if how[:3] in ("adc", "dac"):
            n, m = converter(raw, how[:3], int(how[3])).cast("string"), converter(raw, detail[:3], int(detail[3])).cast("string")
        else:
            n = {"value": raw, "quantity": quantity_of(raw).cast("string"), "one": F.when(available(raw), "1")}[how]
            m = raw if detail == "own" else F.lit(detail)
        label = raw if name == "own" else F.lit(name)
        each.append(F.when(available(n), F.struct(F.lit(kind).alias("type"), n.alias("n"), F.nullif(label, F.lit("")).alias("name"), F.when(available(m), m).alias("m"))))
    return F.array_compact(F.array(*each))


def records(rows: DataFrame, product_type: str, index: Column) -> DataFrame:
    """(kind, record_id, body) of every row: device, part, features, provenance, or an error. `index`: the row's place in its source."""
    names = [c for c in COLUMNS if c in rows.columns]
    clean = lambda c, other: F.upper(F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), other)))
    r = rows.select(index.alias("_at"), *names)
    for c in OTHERS:
        if c not in names:
            r = r.withColumn(c, F.lit(None).cast("string"))
    r = r.withColumn("_mpn", F.upper(F.trim(F.coalesce("mpn", F.lit("")))))
    r = r.withColumn("_name", clean("name", F.col("_mpn"))).withColumn("_series", clean("series", F.col("_name")))
    line = F.col("_series") if product_type == "wireless_soc" else F.col("_name")
    device_id = F.concat(F.lit("espressif::"), slug_each(F.col("_mpn")))
    cpu = F.trim(F.coalesce("cpu", F.lit("")))
    state = lifecycle(F.col("status"))
    suffix = F.when(F.startswith("_mpn", F.col("_name")), F.regexp_replace(F.substring(F.col("_mpn"), F.length("_name") + 1, F.lit(1 << 20)), "^-+", "")).otherwise(F.col("_mpn"))
    size = lambda c, unit: F.when(any_number(F.col(c)) > 0, (any_number(F.col(c)) * unit).cast("bigint"))
    has = lambda c: F.col(c) if c in names else F.lit(None).cast("string")
    psram = F.when(any_number(has("psram")) > 0, (any_number(has("psram")) * MB).cast("bigint"))
    values = dict(zip([x.split()[0] for x in DEVICE.split(", ")], [
        device_id, F.concat(F.lit("espressif::esp::"), slug_each(F.col("_series")), F.lit("::"), slug_each(line)), F.lit(product_type), architecture(cpu), F.col("_series"), line, F.col("_mpn"), F.col("_name"), suffix, cpu_name(cpu), integer(F.col("core")), integer(F.col("freq")) * 1_000_000,
        size("flash", MB), size("sram", KB), size("rom", KB), psram, F.col("package"), integer(F.col("pins")), state,
    ]))
    body = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))
    record = lambda kind, text: F.struct(F.lit(kind).alias("kind"), device_id.alias("record_id"), text.alias("body"))
    part = body(orderable_part_id=device_id, device_id=device_id, part_number=F.col("_mpn"), suffix=suffix, package=F.col("package"), temperature_range=F.col("temperature_range"), lifecycle=state)
    numbered = F.transform(F.col("_features"), lambda f, i: record("feature", F.to_json(F.struct((i + 1).alias("position"), f["type"].alias("type"), f["n"].alias("n"), f["name"].alias("name"), f["m"].alias("m")))))
    json_text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    told = F.array_compact(F.array(*[F.when(F.col(c) != "", F.struct(F.lit(c).alias("field_name"), F.concat(F.lit("tableData["), F.col("_at").cast("string"), F.lit(f"].{c}")).alias("source_path"), json_text(F.col(c)).alias("source_value_json"))) for c in names]))
    proven = F.transform(told, lambda p: record("provenance", F.to_json(p)))
    error = F.when(F.col("_mpn") == "", "no part number").when(F.coalesce(integer(has("uart")), F.lit(0)) == 0, "official_record_missing_positive_uart_count")
    good = F.concat(F.array(record("device", body(**values)), record("part", part)), numbered, proven)
    each = F.when(error.isNull(), good).otherwise(F.array(record("error", body(item=F.col("_mpn"), error=error))))
    return r.withColumn("_features", features(names)).select(F.explode(each).alias("r")).select("r.*")


def emitted(found: DataFrame) -> str:
    """Write records by kind in one pass; the folder."""
    path = f"{shared_dir(found.sparkSession).rstrip('/')}/records-{uuid.uuid4().hex}"
    found.write.partitionBy("kind").parquet(path)
    return path


def table_of(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """(record_id, columns of the bodies) of one kind; without rows if none was written."""
    held = spark.read.schema("record_id string, body string, kind string").parquet(path).filter(F.col("kind") == kind)
    return held.select("record_id", F.from_json("body", schema).alias("b")).select("record_id", "b.*")
