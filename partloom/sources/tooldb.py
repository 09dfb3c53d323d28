"""A tool database: an index of devices and a file for each, read by Spark's XML source, and devices matched with it.

The index and the files are read by row tag, so a file is split into rows by Spark and never held as one text. Entries
meet files by the file's stem, devices meet entries by a cascade of identifiers.

Defined results: a device without any identifier, with several entries, or with an entry that has no file, keeps its
reason and no values; of two files with one stem the first by path counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions.exprs import number

ENTRY = "_RefName string, _RPN string, _Name string, _PackageName string, Frequency string, Flash array<string>, Ram array<string>, IONb string"
DEVICE = "_RefName string, IP array<struct<_Name string, _InstanceName string>>, Pin array<struct<_Name string, _Position string, _Type string, Signal array<struct<_Name string>>>>"
# Software that is no peripheral, kinds by instance name (first match wins), and kinds that are counted even at 0.
SOFTWARE = "ADV_TRACE COMMON_BLE COMMON_WPAN EXTMEM_LOADER EXTMEM_MANAGER EXTMEM_MANAGER_APPLI FATFS FILEX FREERTOS GUI_INTERFACE KMS LEVELX LIBJPEG LORAWAN LWIP MBEDTLS NETXDUO OPENAMP PDM2PCM RESMGR_UTILITY SIGFOX STM32_BLE STM32_WPAN SUBGHZ_PHY THREADX TINY_LPM TRACER_EMB TRUSTED-FIRMWARE-M USBX USB_DEVICE USB_HOST WMBUS".split()
INSTANCES = [
    ("ADCUnits", r"ADC\d*"), ("DAC", r"DAC\d*"), ("COMP", r"COMP\d*"), ("OPAMP", r"OPAMP\d*"), ("Timer", r"TIM\d+|LPTIM\d+|HRTIM\d*|IRTIM\d*"), ("SPI", r"(?:SPI|HSPI)\d*"), ("I2S", r"I2S\d*"), ("I2C", r"(?:I2C|FMPI2C)\d*"), ("I3C", r"I3C\d*"), ("USART", r"USART\d*"), ("UART", r"(?:UART|LPUART)\d*"),
    ("CAN", r"(?:CAN|FDCAN)\d*"), ("USBD", r"USB\d*"), ("USBOTG", r"(?:USB_OTG|USB_DRD|USB3DR).*"), ("USBH", r"USBH_.*"), ("ETH", r"ETH.*"), ("SDIO", r"(?:SDIO|SDMMC).*"), ("DMA", r"(?:DMA|BDMA|GPDMA|HPDMA|LPDMA|MDMA)\d*"), ("RNG", r"RNG\d*"), ("RTC", "RTC"), ("WDT", "IWDG|WWDG"), ("Touch", "TSC|TOUCHSENSING"),
    ("Camera", r"(?:DCMI|DCMIPP|CSI|PSSI).*"), ("GLCD", r"(?:LCD|LTDC|DSIHOST|GFXMMU|GPU).*"), ("ExtBus", r"(?:FMC|FSMC|OCTOSPI|QUADSPI|XSPI).*"), ("IOs", "GPIO"), ("Crypto", "AES|CRYP|SAES|HASH|PKA|MCE|OTFDEC"),
]
COUNTED = "Timer ADCUnits DAC IOs SPI I2C I2S I3C USART UART CAN USBD USBH USBOTG ETH SDIO DMA RNG RTC WDT COMP OPAMP Touch Camera GLCD ExtBus".split()
ADC_INPUT = r"(?i)^ADC\d*_(?:IN\d+|IN[PN]\d+|VIN[MP]\d*)$"
SOURCE_KIND = "cubemx_device_db"

_blank = lambda c: F.coalesce(c, F.lit(""))


def classify_ip(name: Column, instance: Column) -> Column:
    """The kind of a block by its instance name; software has none, an unknown block is a kind of its own."""
    upper = F.upper(instance)
    out = F.coalesce(F.nullif(name, F.lit("")), F.nullif(instance, F.lit("")))
    for kind, pattern in reversed(INSTANCES):
        out = F.when(upper.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return F.when(~F.upper(name).isin(*SOFTWARE) & ~upper.isin(*SOFTWARE), out)


def _item(kind: Column | str, name: Column, n: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("type"), name.alias("name"), lit(n).cast("string").alias("count"), F.lit(SOURCE_KIND).alias("source_kind"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of an index file."""
    e = spark.read.format("xml").option("rowTag", "Mcu").schema(ENTRY).load(path)
    return e.select(F.col("_RefName").alias("ref"), F.col("_RPN").alias("rpn"), F.col("_Name").alias("stem"), F.col("_PackageName").alias("package"), "Frequency", "Flash", "Ram", "IONb")


def read_devices(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, n_pins, n_adc_pins, blocks) of each device file of a folder."""
    d = spark.read.format("xml").option("rowTag", "Mcu").schema(DEVICE).load(folder).withColumn("_path", F.input_file_name())
    pins = F.coalesce("Pin", F.array())
    analog = F.filter(pins, lambda p: (F.upper(_blank(p["_Type"])) == "I/O") & F.exists(F.coalesce(p["Signal"], F.array()), lambda s: F.coalesce(s["_Name"].rlike(ADC_INPUT), F.lit(False))))
    named = F.filter(F.array_distinct(F.transform(analog, lambda p: F.coalesce(F.nullif(p["_Position"], F.lit("")), p["_Name"], F.lit("")))), lambda x: x != "")
    clean = lambda c: F.trim(_blank(c))
    blocks = F.transform(F.coalesce("IP", F.array()), lambda i: F.struct(classify_ip(clean(i["_Name"]), clean(i["_InstanceName"])).alias("type"), F.coalesce(F.nullif(clean(i["_InstanceName"]), F.lit("")), clean(i["_Name"])).alias("instance")))
    kept = F.array_sort(F.array_distinct(F.filter(blocks, lambda b: b["type"].isNotNull())))
    each = d.select(F.regexp_extract("_path", r"([^/]+)\.xml$", 1).alias("stem"), "_path", F.struct(F.size(pins).alias("n_pins"), F.size(named).alias("n_adc_pins"), kept.alias("blocks")).alias("d"))
    return each.groupBy("stem").agg(F.min_by("d", "_path").alias("d")).select("stem", "d.*")


def features(blocks: Column, n_io: Column, n_adc_pins: Column) -> Column:
    """Features of a device's blocks: counted kinds with the names of their instances, analog pins, and each other block."""
    pins = F.filter(blocks, lambda b: b["type"] != "IOs")

    def one(kind: Column) -> Column:
        names = F.transform(F.filter(pins, lambda b: b["type"] == kind), lambda b: b["instance"])
        io = kind == "IOs"
        return _item(kind, F.when(io, F.concat(n_io.cast("string"), F.lit(" selectable I/O pins"))).otherwise(F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("CubeMX exact instance count"))), F.when(io, n_io).otherwise(F.size(names)))

    counted = F.transform(F.array(*map(F.lit, COUNTED)), one)
    others = F.transform(F.filter(pins, lambda b: ~b["type"].isin(*COUNTED)), lambda b: _item(b["type"], b["instance"], 1))
    return F.concat(counted, F.array(_item("ADCExternalPins", F.lit("External package pins with ADC input signals"), n_adc_pins)), others)


def matched(devices: DataFrame, entries: DataFrame, files: DataFrame, device_id: str, name: str) -> DataFrame:
    """devices with rule, reason, and the values of their entry and file.

    The identifiers RefName, RPN and Name are tried in this order, then the name without TR; the first with any entry
    decides. All entries are indexed once by identifier, a device probes its identifiers in one join.
    """
    whole = lambda x, times: F.when(_blank(x) != "", (number(x) * times).cast("bigint"))
    flash = F.filter("Flash", lambda x: F.trim(_blank(x)) != "")
    ram = F.filter("Ram", lambda x: F.trim(_blank(x)) != "")
    known = entries.select("ref", "rpn", "stem", "package", whole(F.col("Frequency"), 1_000_000).alias("max_clock_hz"), F.when(F.size(flash) == 1, whole(F.get(flash, 0), 1024)).alias("flash_bytes"), whole(F.get(ram, 0), 1024).alias("ram_bytes"), F.coalesce(number(F.col("IONb")), F.lit(0.0)).cast("int").alias("n_io"))
    value = F.struct(*known.columns)
    by = F.array(*[F.struct(F.lit(k).alias("way"), F.col(c).alias("key")) for k, c in enumerate(("ref", "rpn", "stem"))])
    index = known.select(value.alias("e"), F.explode(by).alias("k")).filter("k.key <> ''").groupBy("k.way", "k.key").agg(F.count("*").alias("n"), F.min("e").alias("e"), F.array_join(F.array_sort(F.collect_set("e.ref")), ";").alias("refs"))
    ways = [("exact_refname", 0, F.col(name)), ("exact_rpn", 1, F.col(name)), ("exact_name", 2, F.col(name)), ("packing_suffix_removed:TR", 0, F.when(F.endswith(name, F.lit("TR")), F.expr(f"left({name}, length({name}) - 2)")))]
    probes = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(rule).alias("rule"), F.lit(way).alias("way"), key.alias("key")) for i, (rule, way, key) in enumerate(ways)])
    asked = devices.select(device_id, F.explode(probes).alias("p")).select(device_id, "p.*").filter("key is not null")
    first = asked.join(index, ["way", "key"]).groupBy(device_id).agg(F.min_by(F.struct("rule", "n", "e", "refs"), "order").alias("m")).select(device_id, "m.*")
    with_file = first.withColumn("stem", F.when(F.col("n") == 1, F.col("e.stem"))).join(files, "stem", "left")
    out = devices.join(with_file, device_id, "left")
    reason = F.when(F.col("n").isNull(), "no_exact_identifier_match").when(F.col("n") > 1, "ambiguous_exact_identifier").when(F.col("n_pins").isNull(), "matched_families_entry_missing_device_xml")
    good = lambda c: F.when(reason.isNull(), c)
    values = [good(F.col(f"e.{c}")).alias(c) for c in ("max_clock_hz", "flash_bytes", "ram_bytes", "package")]
    return out.select(*devices.columns, good(F.col("rule")).alias("rule"), reason.alias("reason"), F.when(reason.isNotNull(), F.coalesce(F.when(F.col("n") == 1, F.col("e.ref")), F.col("refs"))).alias("candidate_refs"), *values, good(F.col("n_pins")).alias("n_pins"), good(features(F.col("blocks"), F.col("e.n_io"), F.col("n_adc_pins"))).alias("features"))
