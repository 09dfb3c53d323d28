"""Rule tables: parameters, macros and descriptions of a device turned into features, by data rather than by code.

A rule gives at most one feature (type, name, count, source_parameter) of a row. All rules are evaluated inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions.exprs import c_integer, count_of

# Words for a feature that is there, and for a value that is none.
YES, NONE = "Y YES TRUE 1 PRESENT SUPPORTED".split(), ["", "NA", "N"]

# Of each feature its name and the ways to count it, the first that gives a number wins:
# first:A,B the first of the parameters that is a count; sum:A,B the sum of those that are; yes:A 1 for a word for yes;
# flag:A 1 or 0 if the parameter is there at all; given:A,x,y 1 for a value other than none, x and y; type:A 1 or, for none, 0;
# absent:A 0 for none; sensed:A,B,c the count B or 1 if A or the capability c says so, else 0; cap:a 1 for a capability;
# able:a a feature without a count for a capability. In a name, {} is the parameter's value; what follows | is the name for 0.
PARAMETER_RULES = [
    ("Timer", "Timer/counter/PWM blocks", "first:TimerCounterPWM_Count sum:16Bit_TimerPWM_Count,32Bit_TimerPWM_Count sum:CCU4_Count,CCU8_Count"),
    ("ADCUnits", "ADC converter units", "first:SAR12_Count,ADC_Count"),
    ("ADC", "ADC source channel count; not external ADC package pins", "first:ADCCH_Count,ADC_CH_Count"),
    ("DAC", "DAC converter blocks", "first:DAC_Count sum:DAC8_Count,DAC12_Count,AudioDAC_Count"),
    ("IOs", "Selectable general-purpose I/O", "first:IO_Count"),
    ("Com", "Configurable serial communication blocks (SCB/USIC)", "first:SCB_Count,USIC_Count"),
    ("UART", "UART supported by configurable serial blocks; simultaneous block count unknown", "able:uart"),
    ("I2C", "I2C supported by configurable serial blocks; simultaneous block count unknown", "able:i2c"),
    ("SPI", "SPI supported by configurable serial blocks; simultaneous block count unknown", "able:spi"),
    ("UART", "Dedicated UART-capable SCB channels", "first:SCB_uart_Count"),
    ("I2C", "Dedicated I2C-capable SCB channels", "first:SCB_I2C_Count"),
    ("SPI", "Dedicated SPI-capable SCB channels", "first:SCB_SPI_Count"),
    ("I2S", "I2S blocks", "first:I2S_Count,I2S_tx_Count,I2S_rx_Count"),
    ("I3C", "I3C blocks", "first:I3C_Count"),
    ("LIN", "LIN channels", "first:LIN_CH_Count,LIN_Count"),
    ("ETH", "Ethernet controllers", "first:ETH_Count"),
    ("SDIO", "SDHC/SDMMC controllers", "first:SDHC_COUNT,SDMMC_Count"),
    ("USBPD", "USB Power Delivery blocks", "first:USBPD_Count"),
    ("CAN", "CAN/CAN FD channels", "sum:CAN20B_Count,CANFD_CH_Count first:CAN_Count"),
    ("CANFD", "CAN FD supported", "yes:CAN_FD"),
    ("COMP", "Analog comparators", "sum:LPComp_Count,Comp_Count,ACMP_Count"),
    ("OPAMP", "Operational amplifiers", "first:OpAmp_Count"),
    ("DMAChannels", "DMA channels; not DMA controller count", "sum:DMAchannels_count,DMACchannels_count,AXI_DMACchannels_count"),
    ("USB", "USB {}|No USB controller", "type:USB_Type"),
    ("USBD", "No USB device controller", "absent:USB_Type"),
    ("USBH", "No USB host controller", "absent:USB_Type"),
    ("USBD", "USB device capability", "cap:usb_device"),
    ("USBH", "USB host capability", "cap:usb_host"),
    ("RTC", "Real-time clock", "cap:rtc"),
    ("RNG", "Hardware random number generator", "cap:rng"),
    ("NPU", "Neural processing unit", "cap:npu"),
    ("JPEG", "JPEG codec", "cap:jpeg"),
    ("USB", "USB controllers", "first:USB_Count"),
    ("ExtBus", "External memory/bus interfaces", "sum:SMIF_Count,EBU_Count"),
    ("ETH", "EtherCAT controllers", "first:ECAT_Count"),
    ("Camera", "Video input interfaces", "first:Video-In_Count"),
    ("GLCD", "Video output interfaces", "first:Video-Out_Count"),
    ("Crypto", "Hardware cryptography|No hardware cryptography", "flag:Crypto"),
    ("Security", "Infineon security subsystem: {}", "given:Security,None"),
    ("Touch", "Infineon CAPSENSE|No CAPSENSE", "flag:CapSense cap:capsense"),
    ("Touch", "Infineon inductive sensing|No inductive sensing", "sensed:IndSense,IndSense_Sensors,inductive"),
    ("GLCD", "Direct-drive LCD|No direct-drive LCD", "flag:DirDriveLCD"),
    ("ExtBus", "Serial memory interface (SMIF)|No SMIF", "flag:SMIF"),
    ("Math", "Hardware math units", "first:MATH_Count yes:MATH_Count"),
    ("CORDIC", "CORDIC accelerator", "first:CORDIC yes:CORDIC"),
    ("JPEG", "JPEG codec blocks", "first:JPEG_Count yes:JPEG_Count"),
    ("CXPI", "CXPI channels", "first:CXPI_Count yes:CXPI_Count"),
    ("MIPI", "MIPI interfaces", "first:MIPI_Count yes:MIPI_Count"),
    ("UDB", "Universal Digital Blocks", "first:UDB_Count yes:UDB_Count"),
    ("FlexRay", "FlexRay supported", "given:FLEXRAY,0"),
    ("Bluetooth", "Bluetooth {}", "given:Bluetooth,0"),
]
# Capabilities that the rules know, or that begin so, are no vendor capabilities of their own.
KNOWN_CAPABILITIES = "adc capsense comp dma i2c i2s i3c lin spi uart can ethernet rtc rng usb_device usb_host sdhc sdio qspi std_crypto npu jpeg opamp lptimer low_power mcu_gp multi_core hal smart_io flash sram".split()
KNOWN_BEGINNINGS = "flash_|sram_|cat|psoc|xmc"
# Macros of a target's header; macro:A its value as an integer, on:A 1 for a macro other than 0, mark:A,B a feature without a count.
MACRO_COUNTS = [
    ("GPIOPadCount", "SoC GPIO pad total; not module-exposed usable GPIO", "macro:SOC_GPIO_PIN_COUNT"),
    ("UART", "UART controllers", "macro:SOC_UART_NUM"),
    ("SPIPeripheralTotal", "Internal SPI peripheral total; Product Selector SPI count uses different semantics", "macro:SOC_SPI_PERIPH_NUM"),
    ("I2C", "I2C controllers including HP/LP domains", "macro:SOC_I2C_NUM"),
    ("I2S", "I2S controllers including HP/LP domains", "macro:SOC_I2S_NUM"),
    ("CAN", "TWAI/CAN controllers", "macro:SOC_TWAI_CONTROLLER_NUM"),
    ("USBOTG", "USB OTG controllers", "macro:SOC_USB_OTG_PERIPH_NUM"),
    ("ADCUnits", "ADC converter units", "macro:SOC_ADC_PERIPH_NUM"),
    ("LEDPWM", "LEDC PWM timers", "macro:SOC_LEDC_TIMER_NUM"),
    ("MCPWM", "Motor-control PWM groups", "macro:SOC_MCPWM_GROUPS"),
]
MACRO_ENGINES = [
    ("SysTimer", "System timer", "on:SOC_SYSTIMER_SUPPORTED"),
    ("DMA", "DMA engine present; controller/channel count not exposed by soc_caps.h", "mark:SOC_GDMA_SUPPORTED,SOC_AHB_GDMA_SUPPORTED,SOC_AXI_GDMA_SUPPORTED,SOC_DW_GDMA_SUPPORTED,SOC_CP_DMA_SUPPORTED"),
    ("DMA2D", "2D DMA accelerator", "on:SOC_DMA2D_SUPPORTED"),
]
MACRO_BLOCKS = [
    ("RNG", "Hardware random number generator", "on:SOC_RNG_SUPPORTED"),
    ("USB", "USB Serial/JTAG controller", "on:SOC_USB_SERIAL_JTAG_SUPPORTED"),
    ("SDIO", "SD/MMC host", "on:SOC_SDMMC_HOST_SUPPORTED"),
    ("Camera", "LCD_CAM camera input", "on:SOC_LCDCAM_CAM_SUPPORTED"),
    ("GLCD", "RGB LCD controller", "on:SOC_LCD_RGB_SUPPORTED"),
    ("MIPI", "MIPI DSI", "on:SOC_MIPI_DSI_SUPPORTED"),
    ("RMT", "Remote control transceiver", "on:SOC_RMT_SUPPORTED"),
    ("LEDPWM", "LEDC PWM controller", "on:SOC_LEDC_SUPPORTED"),
    ("MCPWM", "Motor-control PWM controller", "on:SOC_MCPWM_SUPPORTED"),
]
# Hardware timers by target, with their source; what stands for them elsewhere; the parts of cryptography.
TIMER_COUNTS = {"esp32": 4, "esp32c2": 1, "esp32c3": 2, "esp32c5": 2, "esp32c6": 2, "esp32c61": 2, "esp32h2": 2, "esp32h21": 2, "esp32h4": 2, "esp32s2": 4, "esp32s3": 4, "esp32s31": 4}
TIMERS, TIMER_SOURCE = "General-purpose hardware timers from timer-group register instances", "timer_group_struct.h:instances*hw_timer[]"
TIMER_MARK = ("TimerOther", "General-purpose timer supported; comparable timer count is not exposed by soc_caps.h", "mark:SOC_GPTIMER_SUPPORTED")
CRYPTO = [("SOC_AES_SUPPORTED", "AES"), ("SOC_SHA_SUPPORTED", "SHA"), ("SOC_RSA_SUPPORTED", "RSA"), ("SOC_HMAC_SUPPORTED", "HMAC"), ("SOC_ECDSA_SUPPORTED", "ECDSA"), ("SOC_DS_SUPPORTED", "Digital Signature")]
CRYPTO_SOURCE = "soc_caps crypto support macros"
NO_FPU_TARGETS = "esp32c2 esp32c3 esp32c5 esp32c6 esp32c61 esp32h2 esp32h21 esp32s2".split()
# What a description says: count before the label (N x UART), 1 if a pattern is met, or a mark without a count.
DESCRIPTION_COUNTS = ["UART", "SPI", "I2C", "I2S"]
DESCRIPTION_COUNT_OR_ONE = ["CAN", "SDIO"]
DESCRIPTION_ONES = [("ETH", r"Ethernet\s+MAC"), ("RTC", r"\bRTC\b"), ("Crypto", r"\bAES\b"), ("CoreOther", r"\b(?:HWDIV|DIV)\b")]
ANALOG_MARKS = [("ADC", r"\bADC\b"), ("DAC", r"\bDAC\b"), ("COMP", r"\b(?:ACMP|COMP)\b"), ("OPAMP", r"\bOPAMP\b")]
# Names of peripherals by their prefixes, product types, families, cores, lines and states, first match wins.
PERIPHERALS = [
    ("ADCUnits", "ADC SARADC"), ("DAC", "DAC"), ("USART", "USART SERCOMUSART"), ("UART", "UART LPUART"), ("I3C", "I3C"), ("I2C", "I2C IIC TWI"), ("I2S", "I2S SAI"), ("SPI", "SPI QSPI OSPI OCTOSPI"), ("CAN", "CAN FDCAN MCAN"),
    ("USBOTG", "USBOTG OTGFS OTGHS"), ("USBD", "USB"), ("ETH", "ETH GMAC EMAC"), ("SDIO", "SDIO SDMMC SDHC"), ("DMA", "DMA GPDMA BDMA MDMA XDMA"), ("RNG", "RNG TRNG"), ("Crypto", "CRYP AES HASH PKA HSM"), ("Camera", "DCMI CSI PSSI"),
    ("LCD", "LTDC LCD TFT"), ("COMP", "COMP ACMP"), ("OPAMP", "OPAMP"), ("WDT", "WDT IWDG WWDG WATCHDOG"), ("RTC", "RTC"),
]
PRODUCT_TYPES = [("STM32WB|STM32WL", "wireless_mcu"), ("STM32L|STM32U", "low_power_mcu"), ("STM32H|STM32N", "high_performance_mcu")]
FAMILIES = "STM32 STM8 EFM32 EFR32 LPC MCX KINETIS MSPM0 TM4C MAX32 nRF GD32 APM32 AT32".split()
CORES = {"M0": "Cortex-M0", "M0P": "Cortex-M0+", "M0+": "Cortex-M0+", "M3": "Cortex-M3", "M4": "Cortex-M4", "M7": "Cortex-M7", "M33": "Cortex-M33", "R4": "Cortex-R4"}
WCH_CORES = [
    ("CH32F103|CH32F20", "Cortex-M3"), ("CH32H41", "QingKe V3F + QingKe V5F"), ("CH32V30[357]", "QingKe V4F"), ("CH32V208", "QingKe V4C"), ("CH32V203", "QingKe V4B"), ("CH32L103", "QingKe V4C"), ("CH32V103", "QingKe V3A"),
    ("CH32[VXM]0|CH641", "QingKe V2A/V2C"), ("CH32X|CH64[35]", "QingKe V4C"), ("CH57[13]", "QingKe V3A"), ("CH58[123]", "QingKe V4A"), ("CH59[12]", "QingKe V4C"),
]
WCH_FPU, WCH_WHOLE = "CH32H41|CH32V30[357]", "CH561 CH563 CH567 CH568 CH569 CH641 CH643 CH645".split()
AVR_LINES = {"DA": "AVR DA", "DB": "AVR DB", "DD": "AVR DD", "DU": "AVR DU", "EA": "AVR EA", "EB": "AVR EB", "LA": "AVR LA", "SD": "AVR SD"}
LIFECYCLES = {"mass production": "active", "sample": "sampling", "nrnd": "nrnd", "eol": "eol", "replaced": "replaced"}
VENDORS = {"STMicroelectronics International N.V.": "STMicroelectronics", "TexasInstruments": "Texas Instruments"}


def yes(x: Column) -> Column:
    return F.coalesce(F.upper(F.trim(x)).isin(*YES), F.lit(False))


def first_count(parameters: Column, names: list[str]) -> Column:
    """(n, source): the first of the parameters that is a count."""
    held = [F.when(count_of(parameters[n]).isNotNull(), F.struct(count_of(parameters[n]).alias("n"), F.lit(n).alias("source"))) for n in names]
    return F.coalesce(*held)


def sum_counts(parameters: Column, names: list[str]) -> Column:
    """(n, source): the sum of the parameters that are counts, and their names."""
    held = F.array_compact(F.array(*[F.when(count_of(parameters[n]).isNotNull(), F.struct(count_of(parameters[n]).alias("n"), F.lit(n).alias("source"))) for n in names]))
    return F.when(F.size(held) > 0, F.struct(F.aggregate(held, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n"), F.array_join(F.transform(held, lambda x: x["source"]), "+").alias("source")))


def _way(how: str, parameters: Column, capabilities: Column) -> Column:
    kind, names = how.split(":")[0], how.split(":")[1].split(",")
    value = parameters[names[0]]
    none = F.coalesce(value, F.lit("")).isin(*NONE)
    found = lambda n, source=None: F.struct((n if isinstance(n, Column) else F.lit(n)).cast("bigint").alias("n"), (F.lit(names[0]) if source is None else source).alias("source"))
    one = lambda hit, n=1, source=None: F.when(F.coalesce(hit, F.lit(False)), found(n, source))
    capable = lambda c: F.array_contains(capabilities, c)
    if kind == "first":
        return first_count(parameters, names)
    if kind == "sum":
        return sum_counts(parameters, names)
    if kind == "macro":
        return one(c_integer(value).isNotNull(), c_integer(value))
    if kind == "yes":
        return one(yes(value))
    if kind == "flag":
        return F.coalesce(one(yes(value)), one(value.isNotNull(), 0))
    if kind == "given":
        return one(~F.coalesce(value, F.lit("")).isin(*NONE, *names[1:]))
    if kind == "type":
        return one(value.isNotNull(), F.when(none, 0).otherwise(1))
    if kind == "absent":
        return one(value.isNotNull() & none, 0)
    if kind == "sensed":
        held = F.coalesce(F.nullif(count_of(parameters[names[1]]), F.lit(0).cast("bigint")), F.lit(1))
        return one(value.isNotNull() | capable(names[2]), F.when(yes(value) | capable(names[2]), held).otherwise(0))
    if kind in ("cap", "able"):
        return one(capable(names[0]), 1 if kind == "cap" else None, F.lit(f"DeviceCapabilities:{names[0]}"))
    on = F.filter(F.array(*map(F.lit, names)), lambda n: enabled(parameters[n]))
    return one(F.size(on) > 0, None if kind == "mark" else 1, F.array_join(on, "+"))


def enabled(macro: Column) -> Column:
    return ~F.coalesce(macro, F.lit("0")).isin("", "0")


def _feature(kind: Column | str, name: Column, n: Column, source: Column) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), name.alias("name"), n.cast("bigint").alias("count"), source.alias("source_parameter"))


def features_of(parameters: Column, capabilities: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The features (type, name, count, source_parameter) that a map of parameters and a list of capabilities give by a rule table."""
    labels = [(name.split("|") + [None])[:2] for _, name, _ in rules]
    texts = lambda given: F.array(*[F.lit(x).cast("string") for x in given])
    kinds, some, none = texts([kind for kind, _, _ in rules]), texts([x.removesuffix("{}") for x, _ in labels]), texts([x for _, x in labels])
    values = F.array(*[parameters[ways.split(":")[1].split(",")[0]] if x.endswith("{}") else F.lit(None).cast("string") for (x, _), (_, _, ways) in zip(labels, rules)])
    found = F.array(*[F.coalesce(*[_way(how, parameters, capabilities) for how in ways.split()]) for _, _, ways in rules])
    label = lambda x, i: F.when((x["n"] == 0) & F.get(none, i).isNotNull(), F.get(none, i)).otherwise(F.concat(F.get(some, i), F.coalesce(F.get(values, i), F.lit(""))))
    return F.array_compact(F.transform(found, lambda x, i: F.when(x.isNotNull(), _feature(F.get(kinds, i), label(x, i), x["n"], x["source"]))))


def parameter_features(parameters: Column, capabilities: Column) -> Column:
    """All features of a device's parameters and capabilities; capabilities that no rule knows follow, sorted."""
    own = F.filter(F.array_sort(F.array_distinct(capabilities)), lambda c: ~c.isin(*KNOWN_CAPABILITIES) & ~c.rlike(f"^(?:{KNOWN_BEGINNINGS})"))
    vendor = F.transform(own, lambda c: _feature("VendorCapability", F.concat(F.lit("Infineon capability: "), c), F.lit(1), F.concat(F.lit("DeviceCapabilities:"), c)))
    return F.concat(features_of(parameters, capabilities, PARAMETER_RULES), vendor)


def macro_features(macros: Column, target: Column) -> Column:
    """All features of a target's header macros: a known timer count of the target excludes the mark for timers."""
    by_table = lambda rules: features_of(macros, F.array().cast("array<string>"), rules)
    timers = F.try_element_at(F.create_map(*[F.lit(x) for pair in TIMER_COUNTS.items() for x in pair]), target)
    timer = F.when(timers.isNotNull(), F.array(_feature("Timer", F.lit(TIMERS), timers, F.lit(TIMER_SOURCE)))).otherwise(by_table([TIMER_MARK]))
    parts = F.array_compact(F.array(*[F.when(enabled(macros[m]), F.lit(label)) for m, label in CRYPTO]))
    crypto = F.array_compact(F.array(F.when(F.size(parts) > 0, _feature("Crypto", F.concat(F.lit("Hardware cryptography: "), F.array_join(parts, ", ")), F.lit(1), F.lit(CRYPTO_SOURCE)))))
    vendor = F.array(_feature("VendorCapability", F.concat(F.lit("ESP-IDF target: "), target), F.lit(1), F.concat(F.lit("IDF_TARGET_"), F.upper(target))))
    return F.concat(by_table(MACRO_COUNTS), timer, by_table(MACRO_ENGINES), crypto, by_table(MACRO_BLOCKS), vendor)


def described(text: Column) -> Column:
    """The features (type, count) that a family's description names: `N x UART`, words, and an analog section."""
    n = lambda label: F.regexp_extract(text, rf"(?i)(\d+)\s*x\s*{label}\b", 1).try_cast("bigint")
    met = lambda pattern, x=text: F.coalesce(x.rlike(rf"(?i){pattern}"), F.lit(False))
    item = lambda kind, there, count: F.when(there, F.struct(F.lit(kind).alias("type"), count.cast("bigint").alias("count")))
    one, analog = F.lit(1), F.regexp_extract(text, r"(?is)Analog\s*:\s*(.*?)(?:power saving|Other\s*:|$)", 1)
    otg, usb = r"USB[_ ]OTG", r"USB(?:\(FS\))?"
    each = [item(k, n(k).isNotNull(), n(k)) for k in DESCRIPTION_COUNTS]
    each += [item(k, n(k).isNotNull() | met(k), F.coalesce(n(k), one)) for k in DESCRIPTION_COUNT_OR_ONE]
    each += [item("USBOTG", met(otg), F.coalesce(n(otg), one)), item("USBD", ~met(otg) & met(usb), F.coalesce(n(usb), one))]
    each += [item(k, met(p), one) for k, p in DESCRIPTION_ONES] + [item(k, met(p, analog), F.lit(None)) for k, p in ANALOG_MARKS]
    return F.array_compact(F.array(*each))


def fpu_of_target(macros: Column, target: Column) -> Column:
    on = ~F.coalesce(macros["SOC_CPU_HAS_FPU"], F.lit("0")).isin("", "0")
    return F.when(on, "FPU").when(target.isin(*NO_FPU_TARGETS), "NO_FPU").otherwise("")


def peripheral_type(name: Column, group: Column) -> Column:
    """The kind of a peripheral by its name, or its name and group together; null for others."""
    first, both = F.regexp_replace(F.upper(name), "[^A-Z0-9]", ""), F.regexp_replace(F.upper(F.concat_ws(" ", name, group)), "[^A-Z0-9]", "")
    out = F.when(first.rlike(r"^(?:TIM|TIMER|TMR|GPT|GPTM|LPTIM|HRTIM)\d"), "Timer").when(first.rlike("^(?:GPIO|PORT)[A-Z0-9]"), "GPIOPort")
    for kind, prefixes in reversed(PERIPHERALS):
        out = F.when(both.rlike(f"^(?:{'|'.join(prefixes.split())})"), kind).otherwise(out)
    return out


def product_type(series: Column, name: Column) -> Column:
    key = F.upper(F.concat_ws(" ", series, name))
    out = F.lit("general_purpose_mcu")
    for pattern, label in reversed(PRODUCT_TYPES):
        out = F.when(key.rlike(pattern), label).otherwise(out)
    return out


def family(name: Column, given: Column) -> Column:
    out = F.trim(F.regexp_replace(given, " Series$", ""))
    out = F.when(out == "", name).otherwise(out)
    for prefix in reversed(FAMILIES):
        out = F.when(F.startswith(F.upper(name), F.lit(prefix.upper())), prefix).otherwise(out)
    return out


def vendor(value: Column, default: Column) -> Column:
    own = F.trim(F.element_at(F.split(F.coalesce(value, F.lit("")), ":"), 1))
    pairs = [F.lit(x) for kv in VENDORS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), own), F.when(own != "", own), default)


def normalized_core(value: Column) -> Column:
    """Cortex-M4 for CM4, ARM Cortex-M4 and the like; other names as they are."""
    compact = F.regexp_replace(F.upper(F.regexp_replace(value, "[^A-Za-z0-9+]", "")), "^ARM", "")
    kind = F.regexp_extract(compact, r"^(?:CORTEX|C)([MR]\d+[P+]?)$", 1)
    pairs = [F.lit(x) for kv in CORES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.trim(value))


def package_pins(package: Column) -> Column:
    return F.regexp_extract(package, r"(?<!\d)(\d{2,4})(?!\d)", 1)


def wch_core(part: Column) -> Column:
    out = F.lit("QingKe RISC-V")
    for pattern, label in reversed(WCH_CORES):
        out = F.when(F.upper(part).rlike(f"^(?:{pattern})"), label).otherwise(out)
    return out


def wch_architecture(part: Column) -> Column:
    return F.when(F.upper(part).rlike("^(?:CH32F103|CH32F20)"), "Cortex-M3").otherwise("RISC-V")


def wch_fpu(part: Column) -> Column:
    """Whether the part's core has a floating-point unit."""
    return F.upper(part).rlike(f"^(?:{WCH_FPU})")


def wch_family(part: Column) -> Column:
    return F.when(F.startswith(F.upper(part), F.lit("CH32")), "CH32").otherwise("CH")


def wch_variant(part: Column) -> Column:
    """The device's name: the part number without its last two characters, where it is that much longer than its series."""
    whole = F.upper(part).isin(*WCH_WHOLE)
    return F.when(whole, F.upper(part)).when(F.length(part) > F.length(wch_series(part)) + 2, F.substring(part, F.lit(1), F.length(part) - 2)).otherwise(part)


def wch_series(part: Column) -> Column:
    up = F.upper(part)
    return F.coalesce(*[F.nullif(F.regexp_extract(up, p, 1), F.lit("")) for p in (r"^(CH32[A-Z]+\d{3})", r"^(CH\d{3})")], up)


def cpu_name(value: Column) -> Column:
    low = F.lower(value)
    return F.when(F.contains(low, F.lit("lx7")), "Xtensa LX7").when(F.contains(low, F.lit("lx6")), "Xtensa LX6").when(F.contains(low, F.lit("l106")), "Xtensa L106").when(F.contains(low, F.lit("risc-v")), "RISC-V").otherwise(F.trim(F.replace(value, F.lit("®"), F.lit(""))))


def lifecycle(status: Column) -> Column:
    pairs = [F.lit(x) for kv in LIFECYCLES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.coalesce(status, F.lit("")))), F.lit("unknown"))


def avr_line(name: Column, given: Column, architecture: Column) -> Column:
    up, new = F.upper(name), F.upper(architecture) == "AVR8X"
    code = F.regexp_extract(up, r"^AVR\d+([A-Z]{2})\d", 1)
    pairs = [F.lit(x) for kv in AVR_LINES.items() for x in kv]
    tiny = F.when(F.contains(F.upper(given), F.lit("TINYAVR 2")), "tinyAVR 2-series").when(new, "tinyAVR 0/1-series").otherwise("Classic ATtiny")
    return (
        F.when(F.startswith(up, F.lit("AT90")), "AT90 specialty AVR")
        .when(F.startswith(up, F.lit("ATMEGA")), F.when(new, "megaAVR 0-series").otherwise("Classic ATmega"))
        .when(F.startswith(up, F.lit("ATTINY")), tiny)
        .otherwise(F.coalesce(F.element_at(F.create_map(*pairs), code), F.when(F.startswith(up, F.lit("ATA")), "Automotive AVR"), F.lit("Other AVR")))
    )


def hierarchy(domain: Column, database_family: Column, series: Column, die: Column) -> Column:
    """(family, series, line) of a device of the tool database."""
    own = F.coalesce(F.nullif(series, F.lit("")), F.nullif(die, F.lit("")), database_family)
    wireless = (domain == "Connectivity-BT-WIFI") | database_family.rlike("^(?:CYW|20|30|43|55)")
    psc = database_family.rlike("^PSC3") | (database_family == "BOY2")
    top = F.when(wireless, "AIROC Connectivity").when(database_family == "FX3G2", "EZ-USB").when(database_family.rlike("^TVII"), "TRAVEO T2G").when(psc, "PSC3").otherwise(own)
    middle = F.when(psc & ~wireless, "PSC3").otherwise(own)
    return F.struct(top.alias("family"), middle.alias("series"), own.alias("line"))
