"""Device description files: variants, pinouts, pads, modules, signals and memory segments of one document a row.

Everything inside a document is joined inside its row: pinouts are looked up by the variants that name them, a signal's
pad is looked up among the pads of these pinouts, so no row of a document is shuffled. Two dialects share the reading
(8-bit and 32-bit devices); an overlay patches the features of a record by kind.

Defined results: a document without a named device, or one that is not read as XML, gives an error and nothing else;
numbers that cannot be read are left out; of two pinouts with one name the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.exprs import int_any_base, number, slug_plain
from partloom.operators.rules import avr_line

_SEGMENT = "struct<_name string, _type string, _start string, _size string, _external string>"
_INSTANCE = "struct<_name string, signals struct<signal array<struct<_group string, _function string, _index string, _pad string>>>>"
DESCRIPTION = (
    "variants struct<variant array<struct<_ordercode string, _package string, _pinout string, _speedmax string, _tempmin string, _tempmax string>>>, "
    "pinouts struct<pinout array<struct<_name string, pin array<struct<_position string, _pad string>>>>>, "
    f"devices struct<device array<struct<_name string, _architecture string, _family string, `address-spaces` struct<`address-space` array<struct<`memory-segment` array<{_SEGMENT}>>>>, "
    f"peripherals struct<module array<struct<_name string, instance array<{_INSTANCE}>>>>>>>"
)
FEATURE = "struct<type string, name string, count string, source_kind string>"

# Kinds of modules by name (left out: ports), kinds that are counted even at 0, and vendor features, for 8-bit devices.
AVR_MODULES = {
    "Timer": "TC TC8 TC8_ASYNC TC16 TCA TCB TCD TCE TIMER", "ADCUnits": "ADC", "DAC": "DAC", "COMP": "AC ACC CMP COMP", "OPAMP": "OPAMP", "SPI": "SPI", "I2C": "TWI I2C", "USART": "USART", "UART": "UART", "CAN": "CAN CANCTRL",
    "USBD": "USB USB_DEVICE", "WDT": "WDT WDTCSR", "RTC": "RTC", "": "PORT VPORT GPIO",
}
AVR_COUNTED = "Timer ADCUnits DAC SPI I2C USART UART CAN USBD WDT RTC COMP OPAMP".split()
AVR_VENDOR = {
    "CCL": "CCL configurable custom logic", "EVSYS": "Event System", "MVIO": "Multi-Voltage I/O (MVIO)", "ZCD": "Zero-Cross Detector (ZCD)", "CRCSCAN": "CRC memory scanner", "PTC": "Peripheral Touch Controller (PTC)",
}
# The same for 32-bit devices, and the serial kinds that stay unknown beside configurable blocks.
SAM_MODULES = {
    "ADCUnits": "ADC AFEC", "DAC": "DAC", "COMP": "AC ACC CMP COMP", "OPAMP": "OPAMP", "Timer": "TC TCC TIMER RTT PIT PWM MCPWM CCT", "Com": "SERCOM FLEXCOM", "UART": "UART", "USART": "USART", "SPI": "SPI QSPI OSPI", "I2C": "I2C TWI TWIHS", "I2S": "I2S SSC",
    "CAN": "CAN MCAN", "ETH": "GMAC EMAC ETH", "SDIO": "SDHC HSMCI SDMMC", "DMA": "DMAC DMA XDMAC PDC", "RNG": "TRNG RNG", "RTC": "RTC", "WDT": "WDT WDT0 WDT1 RSWDT", "Touch": "PTC QTOUCH", "Camera": "ISI CSI DCMI", "GLCD": "LCDC SLCDC LCD",
    "ExtBus": "EBI SMC SDRAMC HEFC", "Crypto": "AES ICM SHA PUKCC CRYPTO HSM", "ExtInt": "EIC AIC", "ComOther": "USB UOTGHS UDP UDPHS", "": "PORT PIO",
}
SAM_COUNTED = "Timer ADCUnits DAC IOs SPI I2C I2S USART UART CAN ETH SDIO DMA RNG RTC WDT COMP OPAMP Touch Camera GLCD ExtBus ExtInt Com".split()
SERIAL = "SPI I2C USART UART".split()
# Segments that are no program memory or no working memory, by a part of their name.
AVR_NO_FLASH, SAM_NO_FLASH, SAM_NO_RAM = "BOOT_SECTION|FUSE|USER|SIGNATURE", "FUSE|OTP|USER|CFG|CAL|BACKUP", "CACHE|CMCC_|TAGRAM|VALIDRAM"
SOURCE_KIND = "microchip_atdf"
# Kinds that the overlay drops, and what it adds beside the counts.
OVERLAY_DROPS = "Timer IOs ADCExternalPins DAC ComOther DACC".split()

_blank = lambda c: F.coalesce(c, F.lit(""))
_list = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _item(kind: Column | str, name: Column | str, n: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("type"), lit(name).alias("name"), lit(n).cast("string").alias("count"), F.lit(SOURCE_KIND).alias("source_kind"))


def module_kind(module: Column, kinds: dict[str, str]) -> Column:
    """The kind of a module: by its name in upper case, an unknown name is a kind of its own; null for ports."""
    flat = {m: k for k, names in kinds.items() for m in names.split()}
    table = F.create_map(*[F.lit(x) for pair in flat.items() for x in pair])
    return F.nullif(F.coalesce(F.try_element_at(table, F.replace(F.upper(module), F.lit("-"), F.lit("_"))), module), F.lit(""))


def _integer(x: Column, fraction: bool) -> Column:
    """An integer literal of any base; where the dialect takes fractions, a number cut to a whole one."""
    return F.coalesce(int_any_base(x), number(x).cast("bigint")) if fraction else int_any_base(x)


def _once(df: DataFrame, column: str) -> DataFrame:
    """df with a column that is computed once for a row: as it comes out of a generator, it is not copied into the lambdas that read it."""
    return df.select(*[c for c in df.columns if c != column], F.explode(F.array(column)).alias(column))


def opened(files: DataFrame, xml: str = "xml", fraction: bool = False) -> DataFrame:
    """The files' columns with the parsed parts: device, variants, pads (of the pinouts that variants name), pin_counts, modules, segments, error."""
    read = _once(files.select(*files.columns, F.from_xml(F.col(xml), DESCRIPTION).alias("_d")), "_d")
    device = F.get(F.col("_d.devices.device"), 0)
    named = _blank(device["_name"]) != ""
    held = read.select(*files.columns, device.alias("device"), F.when(~F.coalesce(named, F.lit(False)), "no devices/device name").alias("error"), F.coalesce(F.col("_d.variants.variant"), F.array()).alias("variants"), F.col("_d.pinouts.pinout").alias("_p"))
    names = F.array_distinct(F.filter(F.transform("variants", lambda v: v["_pinout"]), lambda n: _blank(n) != ""))
    chosen = F.array_compact(F.transform(names, lambda n: F.try_element_at(F.filter("_p", lambda p: p["_name"] == n), F.lit(-1))))
    held = held.withColumn("_chosen", F.coalesce(chosen, F.array()))
    pads = F.array_distinct(F.flatten(F.transform("_chosen", lambda p: F.transform(F.coalesce(p["pin"], F.array()), lambda x: _blank(x["_pad"])))))
    pins = F.array_sort(F.array_distinct(F.transform("_chosen", lambda p: F.size(F.coalesce(p["pin"], F.array())))))
    modules = F.flatten(F.transform(F.coalesce(F.col("device.peripherals.module"), F.array()), lambda m: F.transform(F.coalesce(m["instance"], F.array()), lambda i: F.struct(_blank(m["_name"]).alias("module"), _blank(i["_name"]).alias("instance"), F.coalesce(i["signals"]["signal"], F.array()).alias("signals")))))
    segments = F.flatten(F.transform(F.coalesce(F.col("device.address-spaces.address-space"), F.array()), lambda s: F.coalesce(s["memory-segment"], F.array())))
    sized = F.filter(F.transform(segments, lambda s: F.struct(_blank(s["_name"]).alias("name"), _blank(s["_start"]).alias("start"), _blank(s["_size"]).alias("size"), F.lower(_blank(s["_type"])).alias("type"), _blank(s["_external"]).alias("external"), _integer(s["_size"], fraction).alias("bytes"))), lambda s: s["bytes"].isNotNull())
    parts = held.select(*files.columns, F.struct("error", "device", "variants", pads.alias("pads"), pins.alias("pin_counts"), modules.alias("modules"), sized.alias("segments")).alias("_o"))
    return _once(parts, "_o").select(*files.columns, "_o.*")


def _grouped(kinds: dict[str, str], by_instance: bool = False) -> Column:
    """Distinct (type, instance), sorted; by_instance: an instance of a nameless module is a kind of its own."""
    named = lambda m: F.coalesce(F.nullif(m["module"], F.lit("")), m["instance"]) if by_instance else m["module"]
    each = F.transform("modules", lambda m: F.struct(module_kind(named(m), kinds).alias("type"), F.coalesce(F.nullif(m["instance"], F.lit("")), m["module"]).alias("instance")))
    return F.array_sort(F.array_distinct(F.filter(each, lambda g: g["type"].isNotNull())))


def _counted(kinds: list[str], grouped: Column) -> Column:
    """One feature for each kind, the names of its instances joined; a count of 0 stands for none."""

    def one(kind: Column) -> Column:
        names = F.transform(F.filter(grouped, lambda g: g["type"] == kind), lambda g: g["instance"])
        return _item(kind, F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("ATDF exact instance count")), F.size(names))

    return F.transform(F.array(*map(F.lit, kinds)), one)


def _others(kinds: list[str], grouped: Column) -> Column:
    """A feature of count 1 for each instance of the other kinds."""
    return F.transform(F.filter(grouped, lambda g: ~g["type"].isin(*kinds)), lambda g: _item(g["type"], g["instance"], 1))


def _signals(met) -> Column:
    """The signals of the instances whose module `met` takes."""
    return F.flatten(F.transform(F.filter("modules", lambda m: met(m["module"])), lambda m: m["signals"]))


def _distinct(signals: Column, met, value) -> Column:
    return F.array_distinct(F.transform(F.filter(signals, met), value))


_PORT_PAD = r"(?i)^P[A-Z]+\d+$"


def _speeds(fraction: bool) -> Column:
    return F.array_distinct(F.array_compact(F.transform("variants", lambda v: _integer(v["_speedmax"], fraction))))


def _packages() -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform("variants", lambda v: v["_package"]), lambda p: _blank(p) != "")))


def _regions(kinds: list[str], external: bool) -> Column:
    """The memory regions as JSON, blank attributes left out."""
    names = ["name", "start", "size", "type", *(["external"] if external else [])]
    kept = F.filter("segments", lambda s: s["type"].isin(*kinds))
    return F.to_json(F.transform(kept, lambda s: F.struct(*[F.nullif(s[n], F.lit("")).alias(n) for n in sorted(names)])))


def avr_records(files: DataFrame, xml: str = "xml") -> DataFrame:
    """The device record of each 8-bit description, with its features, memory regions and orderable parts as arrays."""
    port = F.size(F.filter("pads", lambda p: p.rlike(_PORT_PAD)))
    adc = _signals(lambda m: F.upper(m) == "ADC")
    analog = lambda s: F.upper(_blank(s["_group"])).rlike("^(ADC|AIN)") | F.upper(_blank(s["_function"])).rlike("^(ADC|AIN)")
    channel = lambda s: F.coalesce(F.nullif(s["_index"], F.lit("")), F.upper(_blank(s["_function"])))
    channels = F.size(F.filter(_distinct(adc, analog, channel), lambda c: c != ""))
    pads = F.size(F.filter(_distinct(adc, analog, lambda s: _blank(s["_pad"])), lambda p: (p != "") & F.array_contains("pads", p)))
    vendor = F.create_map(*[F.lit(x) for pair in AVR_VENDOR.items() for x in pair])
    own = F.filter(F.transform("modules", lambda m: F.struct(F.lit("VendorCapability").alias("type"), F.try_element_at(vendor, F.upper(m["module"])).alias("instance"))), lambda g: g["instance"].isNotNull())
    flash = F.filter("segments", lambda s: (s["type"] == "flash") & ~F.upper(s["name"]).rlike(AVR_NO_FLASH))
    ram = F.filter("segments", lambda s: (s["type"] == "ram") & (F.lower(s["external"]) != "true"))
    total = lambda of: F.aggregate(of, F.lit(0).cast("bigint"), lambda a, s: a + s["bytes"])
    architecture = F.coalesce(F.col("device._architecture"), F.lit("AVR8"))
    read = opened(files, xml).withColumn("grouped", F.array_sort(F.array_distinct(F.concat(_grouped(AVR_MODULES), own))))
    counts = F.array(_item("IOs", "GPIO pads present in official package pinouts", port), _item("ADC", "ADC external signal channels", channels), _item("ADCExternalPins", "External package pads with ADC input signals", pads))
    features = F.concat(_counted(AVR_COUNTED, F.col("grouped")), counts, _others(AVR_COUNTED, F.col("grouped")))
    largest = F.array_max(F.transform(flash, lambda s: s["bytes"]))
    kept = [c for c in files.columns if c != xml]
    record = read.select(*kept, "error", F.col("device._name").alias("device_name"), avr_line(F.col("device._name"), _blank(F.col("device._family")), architecture).alias("product_line"), architecture.alias("architecture"), F.array_max(_speeds(False)).alias("max_clock_hz"), F.when(largest != 0, largest).alias("flash_bytes"), F.when(total(ram) != 0, total(ram)).alias("ram_bytes"), _packages().alias("packages"), "pin_counts", _regions(["flash", "ram", "eeprom"], True).alias("memory_regions_json"), features.alias("features"), "variants")
    record = _once(record.select(F.struct(*record.columns).alias("_r")), "_r").select("_r.*")
    return _only_good(record.select("*", _variant_code(F.col("device_name"), F.col("product_line")).alias("variant_code"), _parts().alias("parts")).drop("variants"), kept)


def _only_good(records: DataFrame, kept: list[str]) -> DataFrame:
    """A record with an error keeps its own columns and the error alone."""
    return records.select(*kept, "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in records.columns if c not in kept and c != "error"])


def _variant_code(name: Column, line: Column) -> Column:
    mega = line.isin("Classic ATmega", "megaAVR 0-series", "AT90 specialty AVR")
    tiny = F.contains(line, F.lit("tinyAVR")) | (line == "Classic ATtiny")
    return F.when(mega, F.regexp_replace(name, "(?i)^(?:ATmega|AT90)", "")).when(tiny, F.regexp_replace(name, "(?i)^ATtiny", "")).when(F.startswith(F.upper(name), F.lit("AVR")), F.substring(name, 4, 1 << 20)).otherwise(name)


def _parts() -> Column:
    """(part_number, suffix, package, temperature) of the variants with an order code of their own; the first of codes that differ by case alone."""
    code = lambda v: F.trim(_blank(v["_ordercode"]))
    fits = lambda v: F.startswith(F.upper(code(v)), F.upper("device_name")) & ~F.contains(code(v), F.lit("/")) & (F.lower(code(v)) != "standard")
    own = F.filter("variants", fits)
    codes = F.transform(own, lambda v: F.upper(code(v)))
    first = F.filter(own, lambda v, i: F.array_position(codes, F.upper(code(v))) == i + 1)
    degrees = lambda v: F.when((_blank(v["_tempmin"]) != "") & (_blank(v["_tempmax"]) != ""), F.concat(v["_tempmin"], F.lit(".."), v["_tempmax"], F.lit(" °C"))).otherwise("")
    return F.transform(first, lambda v: F.struct(code(v).alias("part_number"), F.substring(code(v), F.length("device_name") + 1, F.lit(1 << 20)).alias("suffix"), _blank(v["_package"]).alias("package"), degrees(v).alias("temperature")))


def sam_records(files: DataFrame, xml: str = "xml") -> DataFrame:
    """The record of each 32-bit description: single-valued clock, package and pin count, summed memories, features.

    `modules` and `variants` stay for overlays.
    """
    only = lambda values: F.when(F.size(values) == 1, F.get(values, 0))
    kind = lambda s, k, gone: (s["type"] == k) & (F.lower(s["external"]) != "true") & ~F.upper(s["name"]).rlike(gone)
    total = lambda k, gone: F.aggregate(F.filter("segments", lambda s: kind(s, k, gone)), F.lit(0).cast("bigint"), lambda a, s: a + s["bytes"])
    ports = F.array_sort(F.filter("pads", lambda p: p.rlike(_PORT_PAD)))
    adc = _signals(lambda m: F.upper(m).isin("ADC", "AFEC"))
    pads = F.size(_distinct(adc, lambda s: F.upper(_blank(s["_group"])).rlike("^(AIN|AD|VINP|VINM)") & F.array_contains("pads", _blank(s["_pad"])), lambda s: _blank(s["_pad"])))
    read = opened(files, xml, True).withColumn("grouped", F.array_sort(F.concat(_grouped(SAM_MODULES, True), F.transform(ports, lambda p: F.struct(F.lit("IOs").alias("type"), p.alias("instance"))))))
    blocks = F.exists("grouped", lambda g: g["type"] == "Com")
    known = F.filter(_counted(SAM_COUNTED, F.col("grouped")), lambda f: ~(f["type"].isin(*SERIAL) & blocks))
    features = F.concat(known, F.array(_item("ADCExternalPins", "External package pads with ADC input signals", pads)), _others(SAM_COUNTED, F.col("grouped")))
    nonzero = lambda n: F.when(n != 0, n)
    kept = [c for c in files.columns if c != xml]
    record = read.select(*kept, "error", F.col("device._name").alias("device_name"), only(_speeds(True)).alias("max_clock_hz"), nonzero(total("flash", SAM_NO_FLASH)).alias("flash_bytes"), nonzero(total("ram", SAM_NO_RAM)).alias("ram_bytes"), only(_packages()).alias("package"), only(F.col("pin_counts")).alias("pin_count"), _regions(["flash", "ram"], False).alias("memory_regions_json"), features.alias("features"), "modules", "variants")
    return _only_good(record, kept)


def patched(features: Column, drop: list[str], add: list[Column]) -> Column:
    """A typed patch of an array of features: kinds are dropped, others keep their place, new ones follow."""
    return F.concat(F.filter(features, lambda f: ~F.coalesce(f["type"], F.lit("")).isin(*drop)), F.array(*add))


def sam3x_overlay(records: DataFrame) -> DataFrame:
    """Records of one family with timers and converter channels counted by the indices of their signals, and all packages.

    A timer channel is a distinct index of a TC signal, a converter channel a distinct index of the ADC's AD group.
    """
    index = lambda s: _blank(s["_index"])
    timers = F.size(_distinct(_signals(lambda m: m == "TC"), lambda s: index(s) != "", index))
    adc, ad = _signals(lambda m: m == "ADC"), lambda s: F.upper(_blank(s["_group"])) == "AD"
    channels = F.size(_distinct(adc, lambda s: ad(s) & (index(s) != ""), index))
    pads = F.size(_distinct(adc, lambda s: ad(s) & (_blank(s["_pad"]) != ""), lambda s: s["_pad"]))
    add = [_item("Timer", "TC channel indices", timers), _item("PWM", "PWM controller", 1), _item("ADC", "ADC external signal channels", channels), _item("ADCExternalPins", "External pads with ADC input signals", pads), _item("DAC", "DACC controller", 1), _item("USBOTG", "UOTGHS USB OTG controller", 1)]
    pins = F.array_sort(F.array_distinct(F.array_compact(F.transform(_packages(), lambda p: F.regexp_extract(p, r"(\d+)$", 1).try_cast("int")))))
    return records.withColumns({"features": patched(F.col("features"), OVERLAY_DROPS, add), "packages": _packages(), "pin_counts": pins})


def part_rows(records: DataFrame) -> DataFrame:
    """The orderable parts of device records, a row each."""
    each = records.select("device_name", "product_line", F.explode("parts").alias("p"))
    return each.select(F.concat(F.lit("microchip::"), slug_plain(F.col("p.part_number"))).alias("orderable_part_id"), F.concat(F.lit("microchip::"), slug_plain(F.col("device_name"))).alias("device_id"), "product_line", "device_name", "p.part_number", "p.suffix", "p.package", "p.temperature")

