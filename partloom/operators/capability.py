"""The capability record of a device: what its features and processors say, in some fifty columns.

Devices carry `processors` and `features`, arrays of maps. Everything is computed inside the row: no feature is
exploded, nothing is shuffled. Each feature is read once, into bits of what it counts for; a device then has the bits of
all its features, and only columns whose bit is set look into the features again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions import features as V
from partloom.functions.exprs import canonical_map, compact_number, quantity

from .overrides import applied

# Of each count its feature types, tokens of names, tokens that exclude, and whether types come before names.
COUNTS = {
    "timer_count": (["Timer"], [], ["watchdog", "wdg", "rtc"], False),
    "pwm_source_quantity": (["PWM"], ["pwm"], [], False),
    "gpio_count": (["IOs", "I/O"], ["input and output ports", "general purpose i/o"], [], False),
    "spi_count": (["SPI"], ["spi interface"], [], False),
    "i2c_count": (["I2C"], ["i2c interface"], [], False),
    "usart_count": (["USART"], ["usart interface"], [], False),
    "uart_count": (["UART"], ["uart interface"], [], False),
    "can_count": (["CAN"], ["can interface"], [], False),
    "usb_device_count": (["USBD", "USBOTG"], [], [], False),
    "usb_host_count": (["USBH", "USBOTG"], [], [], False),
    "ethernet_count": (["ETH"], [], [], False),
    "dma_source_quantity": (["DMA"], ["direct memory access"], [], False),
    "rng_count": (["RNG"], [], [], False),
    "i2s_count": (["I2S"], ["i2s interface"], [], False),
    "lin_count": (["LIN"], ["lin interface"], [], False),
    "configurable_serial_count": (["Com"], ["sercom", "flexcom", "configurable serial"], [], False),
    "usb_otg_count": (["USBOTG"], [], [], False),
    "sdio_count": (["SDIO"], ["sdio", "sdmmc"], [], False),
    "watchdog_count": (["WDT"], ["watchdog", "iwdg", "wwdg"], [], True),
    "comparator_count": (["COMP"], ["comparator"], [], True),
    "opamp_count": ([], ["operational amplifier", "op amp", "opamp"], [], False),
    "touch_source_quantity": (["Touch"], ["touch"], [], True),
    "camera_interface_count": (["Camera"], ["camera", "dcmi"], [], True),
    "display_controller_count": (["LCD", "GLCD"], ["lcd controller"], [], False),
    "external_bus_count": (["ExtBus"], ["octo spi", "octospi", "quad spi", "qspi", "external bus", "fmc", "fsmc"], [], True),
    "external_interrupt_count": (["ExtInt"], ["external interrupt"], [], False),
    "temperature_sensor_count": (["TempSens", "TS"], ["temperature sensor"], [], True),
}
#: Presence columns; types and words of accelerators and special features; categories of the inventory and what it leaves out.
PRESENT = {"rtc_present": (["RTC"], ["real time clock", "rtc"]), "crypto_accelerator_present": (["Crypto"], ["aes", "hash", "crypto", "pka", "encryption"])}
ACCELERATOR_TYPES = "npu crypto".split()
ACCELERATOR_PHRASES = ["accelerator", "neural", "chrom-art", "dma2d", "graphics", "trigonometric", "math unit", "jpeg codec"]
ACCELERATOR_WORDS = r"(?i)(?<![a-z0-9])(?:npu|tmu|cordic|fmac|crc|aes|sha|hash|pka)\d*(?![a-z0-9])"
SPECIAL_TYPES = "rng touch camera lcd glcd application security vendorcapability".split()
CATEGORIES = {
    "analog": "adc adcunits adc12 adc16 a/d dac d/a comp analogother tempsens touch ts hall",
    "timing": "timer timerother pwm wdt rtc rmt ledpwm mcpwm",
    "connectivity": "i2c spi i2s uart usart lin can usbd usbh usbotg eth sdio sdiohost sdioslave i3c mipi mpserial com comother tof spiperipheraltotal",
    "wireless": "wifi wifi6 bluetooth ieee802154",
    "display_multimedia": "camera lcd glcd",
    "memory_bus": "extbus dma psram rtc_ram",
    "security": "crypto security rng",
    "accelerator": "npu coreother",
    "system": "nvic extint",
    "clock": "pll xtal intrc clockother",
    "power": "powermode powerother consumption",
    "gpio": "ios i/o gpiopadcount",
}
LEFT_OUT = "vcc temp memory memoryother application".split()
PACKAGES = r"(?i)^(?:l?qfp\d*|qfn\d*|bga|csp|sop|dip|lga|packageother)$"
CONFIRMED = ["manufacturer_datasheet", "manufacturer_product_page", "cmsis_pack_metadata"]
CORE_RANKS = {"avr8l": 8, "avr8": 12, "avr8x": 16, "cortex-m0": 18, "cortex-m0+": 24, "cortex-m1": 20, "cortex-m3": 44, "cortex-m4": 60, "cortex-m7": 82, "cortex-m23": 34, "cortex-m33": 66, "cortex-m35p": 72, "cortex-m52": 82, "cortex-m55": 90, "cortex-m85": 100}
CORES_WITHOUT_FPU = ["Cortex-M0", "Cortex-M0+", "Cortex-M1", "Cortex-M3", "Cortex-M23"]

_text = lambda f, k: F.coalesce(f[k], F.lit(""))


#: Each way to be counted has a bit: (column, types, tokens, excluded tokens); columns that prefer types have a way by types and one by names.
WAYS = [way for c, (types, tokens, without, preferred) in COUNTS.items() for way in ([(c, types, [], []), (c, [], tokens, [])] if preferred else [(c, types, tokens, without)])] + [(c, types, tokens, []) for c, (types, tokens) in PRESENT.items()]
_names = "timer_width adc_width dac_width adc_source adc_unit dac can_fd".split()
MARKS = {name: 1 << (len(WAYS) + n) for n, name in enumerate(_names)}
WIDTHS = {"timer_width": ["timer"], "adc_width": ["adc", "adcunits", "a/d"], "dac_width": ["dac", "d/a"]}


def bits(column: str) -> list[int]:
    return [1 << n for n, way in enumerate(WAYS) if way[0] == column]


def _hits(f: Column) -> Column:
    """The bits of a feature by its lowered type `lt` and name `ln`."""
    by_type, by_token = {}, {}
    marked = [("adc_source", ["adc", "a/d"], ["analog to digital"]), ("adc_unit", ["adcunits"], ["adc converter unit"]), ("dac", ["dac", "d/a"], ["digital to analog"]), *((c, types, []) for c, types in WIDTHS.items())]
    for bit, types, tokens in [*((1 << n, types, tokens) for n, (_, types, tokens, _) in enumerate(WAYS)), *((MARKS[c], types, tokens) for c, types, tokens in marked)]:
        for held, keys in ((by_type, [x.lower() for x in types]), (by_token, tokens)):
            for key in keys:
                held[key] = held.get(key, 0) | bit
    long = lambda v: F.lit(v).cast("bigint")
    found = F.coalesce(F.element_at(F.create_map(*[x for k, v in by_type.items() for x in (F.lit(k), long(v))]), f["lt"]), long(0))
    named = long(0)
    for token, mask in by_token.items():
        named = named.bitwiseOR(F.when(F.contains(f["ln"], F.lit(token)), long(mask)).otherwise(long(0)))
    found = found.bitwiseOR(F.when(f["ln"] == "", long(0)).otherwise(named))
    for n, (_, _, _, without) in enumerate(WAYS):
        for token in without:
            found = found.bitwiseAND(F.when(F.contains(f["ln"], F.lit(token)), long(~(1 << n))).otherwise(long(-1)))
    return found.bitwiseOR(F.when((_text(f, "type") == "CAN") & F.contains(f["ln"], F.lit("fd")), long(MARKS["can_fd"])).otherwise(long(0)))


def described(feature: Column) -> Column:
    """Name, n and m of a feature in one text."""
    return F.array_join(F.filter(F.array(*[_text(feature, k) for k in ("name", "n", "m")]), lambda x: x != ""), " ")


def _widths(f: Column) -> Column:
    """Widths that a feature of a type with widths names, or gives as m."""
    named = F.regexp_extract_all(_text(f, "name"), F.lit(r"(?<!\d)(8|10|12|14|16|24|32)(?:-?[Bb]it)?"), F.lit(1)).cast("array<int>")
    given = F.regexp_extract_all(_text(f, "m"), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)).cast("array<double>")
    return F.when(f["lt"].isin([t for types in WIDTHS.values() for t in types]), F.concat(named, F.filter(given, lambda v: v <= 32).cast("array<int>")))


def _accelerates(f: Column) -> Column:
    hit = f["lt"].isin(*ACCELERATOR_TYPES) | f["described"].rlike(ACCELERATOR_WORDS)
    for phrase in ACCELERATOR_PHRASES:
        hit = hit | F.contains(f["ld"], F.lit(phrase))
    return hit


def _recorded(f: Column, status: Column) -> Column:
    """An accelerator or special feature as a record in JSON."""
    kind = _text(f, "type")
    return F.to_json(F.struct(F.when(kind == "", "Other").otherwise(kind).alias("category"), F.when(f["described"] == "", kind).otherwise(f["described"]).alias("name"), F.to_json(canonical_map(f["all"])).alias("source_feature"), status.alias("verification_status")))


def _listed(f: Column, status: Column) -> Column:
    """A peripheral as a record in JSON with its category; null for excluded types, packages and counts of 0."""
    pairs = [F.lit(x) for category, types in CATEGORIES.items() for t in types.split() for x in (t, category)]
    kind = F.trim(_text(f, "type"))
    given = lambda k: F.when(_text(f, k) != "", f[k])
    shown = (kind != "") & ~F.lower(kind).isin(*LEFT_OUT) & ~kind.rlike(PACKAGES) & (F.trim(F.coalesce(given("count"), _text(f, "n"))) != "0")
    category = F.coalesce(F.element_at(F.create_map(*pairs), F.lower(kind)), F.lit("other"))
    return F.when(shown, F.to_json(F.struct(category.alias("category"), given("count").alias("count"), given("m").alias("m"), given("n").alias("n"), _text(f, "name").alias("name"), kind.alias("type"), status.alias("verification_status"))))


def classified(features: Column, status: Column) -> Column:
    """Features as structs of what the record needs of them: type, lt, ln, exact, q, zero, hits, widths and their JSON records, null where they have none.

    Each step is an array of its own, since an expression in a lambda is evaluated as often as it is written.
    """
    keys = ("type", "name", "m", "n", "count", "source_kind")
    plain = F.transform(features, lambda f: F.struct(f.alias("all"), *[f[k].alias(k) for k in keys]))
    read = F.transform(plain, lambda f: F.struct(*[f[k].alias(k) for k in ("all", *keys)], V.lowered(f, "type").alias("lt"), V.lowered(f, "name").alias("ln"), described(f).alias("described"), quantity(f).alias("q")))
    lowered = F.transform(read, lambda f: F.struct(f.alias("f"), F.lower(f["described"]).alias("ld"), f["lt"].alias("lt"), f["described"].alias("described")))
    judged = F.transform(lowered, lambda g: F.struct(g["f"].alias("f"), _accelerates(g).alias("accelerates"), (~F.coalesce(g["f"]["q"] == 0, F.lit(False))).alias("present")))

    def final(j: Column) -> Column:
        f = j["f"]
        text = F.coalesce(F.when(f["count"] != "", f["count"]), f["n"], F.lit(""))
        return F.struct(
            f["type"].alias("type"), f["lt"].alias("lt"), f["ln"].alias("ln"), f["q"].alias("q"), (text == "0").alias("zero"), _text(f, "source_kind").isin(*V.EXACT_SOURCES).alias("exact"), _hits(f).alias("hits"), _widths(f).alias("widths"),
            _listed(f, status).alias("listed"),
            F.when(j["present"] & j["accelerates"], _recorded(f, status)).alias("accelerator"),
            F.when(j["present"] & ~j["accelerates"] & f["lt"].isin(*SPECIAL_TYPES), _recorded(f, status)).alias("special"),
        )

    return F.transform(judged, final)


def adc(found: Column) -> dict[str, Column]:
    """Sources, units and channels of converters, and what the source quantity means; found: classified features."""
    name, kind = (lambda f: f["ln"]), (lambda f: f["lt"])
    has = lambda f, word: F.contains(name(f), F.lit(word))
    marked = lambda f, mark: f["hits"].bitwiseAND(F.lit(MARKS[mark])) != 0
    sources = F.filter(found, lambda f: marked(f, "adc_source"))
    units = F.filter(found, lambda f: marked(f, "adc_unit"))
    exact = F.filter(units, lambda f: f["exact"])
    unit_input = F.when(F.size(exact) > 0, exact).otherwise(units)
    inputs = F.when(F.size(exact) > 0, F.concat(unit_input, F.filter(sources, lambda f: has(f, "channel")))).otherwise(F.concat(sources, unit_input))
    no_units = F.size(unit_input) == 0
    is_unit = lambda f: (kind(f) == "adcunits") | has(f, "converter unit")
    by_name = lambda f: no_units & (has(f, "converter") | (kind(f) == "a/d"))
    channels = F.filter(inputs, lambda f: ~is_unit(f) & has(f, "channel"))
    counted = F.filter(inputs, lambda f: is_unit(f) | ~has(f, "channel") & by_name(f))
    semantics = (
        F.when(F.size(sources) == 0, "unknown")
        .when(F.exists(sources, lambda f: has(f, "channel")), "channels")
        .when(F.exists(sources, lambda f: has(f, "converter") | (_text(f, "type") == "A/D")), "converter_units")
        .otherwise("source_quantity_unspecified")
    )
    return {"adc_source_quantity": total(sources), "adc_quantity_semantics": semantics, "adc_unit_count": total(counted), "adc_channel_count": total(channels)}


def total(found: Column, fits=lambda f: F.lit(True)) -> Column:
    """Sum of the quantities of features that fit; null if none is a number."""
    return F.aggregate(found, F.lit(None).cast("double"), lambda a, f: F.when(fits(f) & f["q"].isNotNull(), F.coalesce(a, F.lit(0.0)) + f["q"]).otherwise(a))


def overridden(devices: DataFrame, rules: DataFrame) -> DataFrame:
    """devices with `rule_records`: those of the override rules that apply, in the order of the rules (of their `position`, if they have one).

    Rules are found once for each distinct name, line, series and vendor; a device holds only the rules that apply to it.
    """
    fields = ["category", "feature_id", "notes", "quantity", "source_url", "unit", "verification_status"]
    keys = ["device_name", "product_line", "series", "manufacturer"]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("device", "glob", "device_prefix", "prefix", "product_line", "line", "series", "series")]), text("match_type"))
    record = F.struct(text("display_name").alias("name"), text("verification_status").alias("verification_status"), F.to_json(F.struct(*[text(c).alias(c) for c in fields[:2]], text("display_name").alias("name"), *[text(c).alias(c) for c in fields[2:]])).alias("record"))
    position = F.col("position") if "position" in rules.columns else F.monotonically_increasing_id()
    listed = rules.select(position.alias("position"), kind.alias("kind"), text("match_value").alias("value"), text("manufacturer").alias("vendor"), record.alias("record"))
    subjects = devices.select(*[text(c).alias(c) for c in keys]).distinct()
    found = applied(subjects, listed).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rule.position", "rule.record"))), lambda r: r["record"]).alias("rule_records"))
    renamed = found.select(*[F.col(c).alias(f"_{c}") for c in keys], "rule_records")
    both = devices.join(renamed, [text(c) == F.col(f"_{c}") for c in keys], "left").drop(*[f"_{c}" for c in keys])
    return both.withColumn("rule_records", F.coalesce("rule_records", F.array().cast("array<struct<name:string,verification_status:string,record:string>>")))


def records(devices: DataFrame, rules: DataFrame) -> DataFrame:
    """The capability record of each device, in 56 columns, counts as numbers."""
    d = overridden(devices, rules)
    status = F.coalesce(F.when(F.col("verification_status") != "", F.col("verification_status")), F.lit("cmsis_pack_metadata"))
    kept = ["device_id", "manufacturer", "device_name", "processors", "max_clock_hz", "rule_records", "source_id"]
    f, long = F.col("_features"), F.lit(0).cast("bigint")
    either = lambda of: F.aggregate(f, long, lambda a, x: a.bitwiseOR(of(x)))
    # only features of exact sources count in a way in which any such feature is counted
    own = lambda x: F.when(x["exact"], x["hits"]).otherwise(x["hits"].bitwiseAND(F.bitwise_not("_exact")))
    d = d.select(*kept, classified(F.col("features"), status).alias("_features"))
    d = d.select(*kept, "_features", either(lambda x: x["hits"]).alias("_any"), either(lambda x: F.when(x["exact"], x["hits"]).otherwise(long)).alias("_exact"))
    d = d.select(*kept, "_features", "_any", "_exact", either(lambda x: F.when(x["q"].isNotNull(), own(x)).otherwise(long)).alias("_numbered"), either(lambda x: F.when(x["zero"], long).otherwise(own(x))).alias("_there"))
    has = lambda held, bit: F.col(held).bitwiseAND(F.lit(bit).cast("bigint")) != 0
    p = F.col("processors")
    cores = F.array_sort(F.array_distinct(F.filter(F.transform(p, lambda x: _text(x, "Dcore")), lambda c: c != "")))
    confirmed = lambda wanted: F.transform(F.filter("rule_records", lambda r: r["verification_status"].isin(*CONFIRMED) == wanted), lambda r: r["record"])
    array = lambda xs: F.concat(F.lit("["), F.array_join(xs, ","), F.lit("]"))
    of_bit = lambda bit: F.when(has("_numbered", bit), total(f, lambda x: own(x).bitwiseAND(F.lit(bit).cast("bigint")) != 0))
    counts = {c: F.coalesce(*map(of_bit, bits(c))) for c in COUNTS}
    presence = {c: F.when(~has("_any", bit), "unknown").when(has("_there", bit), "yes").otherwise("no") for c in PRESENT for bit in bits(c)}
    width = lambda c: F.when(~has("_any", MARKS[c]), "").otherwise(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(f, lambda x: x["lt"].isin(*WIDTHS[c])), lambda x: x["widths"])))), ";"))
    converts = has("_any", MARKS["adc_source"] | MARKS["adc_unit"])
    converters = {c: F.when(~converts, "unknown").otherwise(v) if c == "adc_quantity_semantics" else F.when(converts, v) for c, v in adc(f).items()}
    dac = F.when(has("_any", MARKS["dac"]), total(f, lambda x: x["hits"].bitwiseAND(F.lit(MARKS["dac"])) != 0))
    any_adc = F.coalesce(converters["adc_source_quantity"], converters["adc_unit_count"], converters["adc_channel_count"])
    columns = {
        "core_names": F.array_join(cores, ";"), "primary_core": F.array_join(cores, "+"), "core_count": F.when(F.size(p) > 0, V.core_count(p)), "max_clock_hz": F.col("max_clock_hz"),
        "fpu_present": V.fpu(p, CORES_WITHOUT_FPU), "mpu_present": V.flag(p, "Dmpu"), "dsp_extension_present": V.flag(p, "Ddsp"), "trustzone_present": V.flag(p, "Dtz"),
        "timer_width_bits": width("timer_width"), "adc_resolution_bits": width("adc_width"), "dac_resolution_bits": width("dac_width"),
        **converters, "dac_source_quantity": dac, **counts,
        "can_fd_present": F.when(has("_any", MARKS["can_fd"]), "yes").when(counts["can_count"].isNotNull(), "no").otherwise("unknown"),
        **presence,
        "peripheral_inventory_json": array(f["listed"]), "accelerators_json": array(F.concat(f["accelerator"], confirmed(True))), "special_features_json": array(f["special"]), "pending_feature_candidates_json": array(confirmed(False)),
        "missing_key_fields": V.missing([("core", F.when(F.size(cores) > 0, 1)), ("clock", F.col("max_clock_hz")), ("timer_count", counts["timer_count"]), ("gpio_count", counts["gpio_count"]), ("adc", any_adc)]),
        "source_id": F.col("source_id"), "verification_status": F.lit("derived_from_source_metadata"),
    }
    return d.select("device_id", "manufacturer", "device_name", *[c.alias(n) for n, c in columns.items()])


def as_text(record: DataFrame) -> DataFrame:
    """Numbers as text without needless fractions, unknown ones blank: the form in which records are published."""
    kinds = dict(record.dtypes)
    return record.select(*[compact_number(F.col(c).cast("double")).alias(c) if kinds[c] in ("double", "int", "bigint") and c != "device_id" else F.col(c) for c in record.columns])
