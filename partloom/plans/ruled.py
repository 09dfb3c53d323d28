"""Rule tables over parts: parameters, macros, descriptions and names."""

from pyspark.sql import functions as F

from partloom.operators import rules

from .catalog import query

_shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws("=", x["type"], F.coalesce(x["count"].cast("string"), F.lit("?")))), ";")
_whole = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws("|", x["type"], x["name"], F.coalesce(x["count"].cast("string"), F.lit("?")), x["source_parameter"])), ";")
_PARAMETERS = {
    "IO_Count": "CAST(p_size AS VARCHAR)",
    "SAR12_Count": "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN '2.5' ELSE '3' END",
    "ADC_Count": "'1'",
    "16Bit_TimerPWM_Count": "CASE WHEN p_partkey % 3 = 0 THEN '4' ELSE 'NA' END",
    "32Bit_TimerPWM_Count": "CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '' END",
    "CCU4_Count": "'7'",
    "CAN20B_Count": "CASE WHEN p_partkey % 5 = 0 THEN '2' ELSE '-1' END",
    "CAN_Count": "'9'",
    "Crypto": "CASE p_partkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END",
    "CORDIC": "CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '2' WHEN 2 THEN 'no' ELSE '' END",
    "Bluetooth": "CASE p_partkey % 6 WHEN 0 THEN '5' WHEN 1 THEN '0' WHEN 2 THEN 'None' ELSE 'NA' END",
    "FLEXRAY": "CASE p_partkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN '0' END",
    "Security": "CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'None' WHEN 2 THEN 'SHE' END",
    "USB_Type": "CASE p_partkey % 3 WHEN 0 THEN 'NA' WHEN 1 THEN 'HS' END",
    "CapSense": "CASE p_partkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN '' END",
    "IndSense": "CASE p_partkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END",
    "IndSense_Sensors": "CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '6' END",
    "SMIF": "'N'",
}
_map = lambda given: F.map_filter(F.create_map(*[x for k, sql in given.items() for x in (F.lit(k), F.expr(sql.replace("VARCHAR", "string")))]), lambda k, v: v.isNotNull())


_CAPABILITIES = {"rtc": 2, "npu": 7, "uart": 3, "capsense": 6, "inductive": 11, "zeta": 5, "alpha": 4, "cat1a": 2, "sram_64": 2}


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k AS p_partkey, concat_ws(';',
  CASE WHEN k % 6 = 0 THEN 'Timer|Timer/counter/PWM blocks|6|16Bit_TimerPWM_Count+32Bit_TimerPWM_Count' WHEN k % 3 = 0 THEN 'Timer|Timer/counter/PWM blocks|4|16Bit_TimerPWM_Count' WHEN k % 2 = 0 THEN 'Timer|Timer/counter/PWM blocks|2|32Bit_TimerPWM_Count' ELSE 'Timer|Timer/counter/PWM blocks|7|CCU4_Count' END,
  'ADCUnits|ADC converter units|' || CASE WHEN k % 4 = 3 THEN '3|SAR12_Count' ELSE '1|ADC_Count' END, 'IOs|Selectable general-purpose I/O|' || s || '|IO_Count',
  CASE WHEN k % 3 = 0 THEN 'UART|UART supported by configurable serial blocks; simultaneous block count unknown|?|DeviceCapabilities:uart' END,
  'CAN|CAN/CAN FD channels|' || CASE WHEN k % 5 = 0 THEN '2|CAN20B_Count' ELSE '9|CAN_Count' END,
  CASE k % 3 WHEN 0 THEN 'USB|No USB controller|0|USB_Type;USBD|No USB device controller|0|USB_Type;USBH|No USB host controller|0|USB_Type' WHEN 1 THEN 'USB|USB HS|1|USB_Type' END,
  CASE WHEN k % 2 = 0 THEN 'RTC|Real-time clock|1|DeviceCapabilities:rtc' END, CASE WHEN k % 7 = 0 THEN 'NPU|Neural processing unit|1|DeviceCapabilities:npu' END,
  CASE k % 3 WHEN 0 THEN 'Crypto|Hardware cryptography|1|Crypto' WHEN 1 THEN 'Crypto|No hardware cryptography|0|Crypto' END,
  CASE k % 4 WHEN 0 THEN 'Security|Infineon security subsystem: 0|1|Security' WHEN 2 THEN 'Security|Infineon security subsystem: SHE|1|Security' END,
  CASE WHEN k % 4 = 0 THEN 'Touch|Infineon CAPSENSE|1|CapSense' WHEN k % 4 = 1 THEN 'Touch|No CAPSENSE|0|CapSense' WHEN k % 6 = 0 THEN 'Touch|Infineon CAPSENSE|1|DeviceCapabilities:capsense' END,
  CASE WHEN k % 5 = 0 OR k % 11 = 0 THEN 'Touch|Infineon inductive sensing|' || CASE WHEN k % 2 = 0 THEN '1' ELSE '6' END || '|IndSense' WHEN k % 5 = 1 THEN 'Touch|No inductive sensing|0|IndSense' END,
  'ExtBus|No SMIF|0|SMIF', CASE k % 4 WHEN 0 THEN 'CORDIC|CORDIC accelerator|1|CORDIC' WHEN 1 THEN 'CORDIC|CORDIC accelerator|2|CORDIC' END,
  CASE WHEN k % 4 = 0 THEN 'FlexRay|FlexRay supported|1|FLEXRAY' END, CASE k % 6 WHEN 0 THEN 'Bluetooth|Bluetooth 5|1|Bluetooth' WHEN 2 THEN 'Bluetooth|Bluetooth None|1|Bluetooth' END,
  CASE WHEN k % 4 = 0 THEN 'VendorCapability|Infineon capability: alpha|1|DeviceCapabilities:alpha' END, CASE WHEN k % 11 = 0 THEN 'VendorCapability|Infineon capability: inductive|1|DeviceCapabilities:inductive' END,
  CASE WHEN k % 5 = 0 THEN 'VendorCapability|Infineon capability: zeta|1|DeviceCapabilities:zeta' END) AS features
FROM p""")
def parameter_features(t):
    capabilities = F.array_compact(F.array(*[F.when(F.col("p_partkey") % n == 0, F.lit(c)) for c, n in _CAPABILITIES.items()]))
    # out of a generator the map is made once for a row, not once for each rule that reads it
    given = t.part.select("p_partkey", F.explode(F.array(F.struct(_map(_PARAMETERS).alias("parameters"), capabilities.alias("capabilities")))).alias("g"))
    found = given.select("p_partkey", rules.parameter_features(F.col("g.parameters"), F.col("g.capabilities")).alias("f"))
    return found.select("p_partkey", _whole(F.col("f")).alias("features"))


_MACROS = {
    "SOC_UART_NUM": "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 4 AS VARCHAR) ELSE '(0x3U)' END",
    "SOC_GPTIMER_SUPPORTED": "'1'",
    "SOC_DS_SUPPORTED": "CASE WHEN p_partkey % 7 = 0 THEN '1' END",
    "SOC_GDMA_SUPPORTED": "CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '0' END",
    "SOC_CP_DMA_SUPPORTED": "CASE WHEN p_partkey % 3 = 0 THEN '1' END",
    "SOC_AES_SUPPORTED": "CASE WHEN p_partkey % 5 = 0 THEN '1' END",
    "SOC_SHA_SUPPORTED": "'0'",
    "SOC_RMT_SUPPORTED": "'1'",
    "SOC_CPU_HAS_FPU": "CASE WHEN p_partkey % 4 = 0 THEN '1' END",
}


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS s, ['esp32c3', 'esp32', 'esp32s2', 'esp32p4'][p_partkey % 4 + 1] AS target FROM part)
SELECT k AS p_partkey, concat_ws(';', 'UART|UART controllers|' || CASE WHEN k % 2 = 0 THEN s % 4 ELSE 3 END || '|SOC_UART_NUM',
  CASE WHEN k % 4 = 3 THEN 'TimerOther|General-purpose timer supported; comparable timer count is not exposed by soc_caps.h|?|SOC_GPTIMER_SUPPORTED'
       ELSE 'Timer|General-purpose hardware timers from timer-group register instances|' || CASE WHEN k % 4 = 0 THEN 2 ELSE 4 END || '|timer_group_struct.h:instances*hw_timer[]' END,
  CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 'DMA|DMA engine present; controller/channel count not exposed by soc_caps.h|?|' || CASE WHEN k % 6 = 0 THEN 'SOC_GDMA_SUPPORTED+SOC_CP_DMA_SUPPORTED' WHEN k % 2 = 0 THEN 'SOC_GDMA_SUPPORTED' ELSE 'SOC_CP_DMA_SUPPORTED' END END,
  CASE WHEN k % 35 = 0 THEN 'Crypto|Hardware cryptography: AES, Digital Signature|1|soc_caps crypto support macros' WHEN k % 5 = 0 THEN 'Crypto|Hardware cryptography: AES|1|soc_caps crypto support macros' WHEN k % 7 = 0 THEN 'Crypto|Hardware cryptography: Digital Signature|1|soc_caps crypto support macros' END,
  'RMT|Remote control transceiver|1|SOC_RMT_SUPPORTED', 'VendorCapability|ESP-IDF target: ' || target || '|1|IDF_TARGET_' || upper(target)) AS features,
  CASE WHEN k % 4 = 0 THEN 'FPU' WHEN k % 4 = 2 THEN 'NO_FPU' ELSE '' END AS fpu FROM p""")
def macro_features(t):
    target = F.element_at(F.array(*map(F.lit, ("esp32c3", "esp32", "esp32s2", "esp32p4"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    given = t.part.select("p_partkey", F.explode(F.array(F.struct(_map(_MACROS).alias("macros"), target.alias("target")))).alias("g"))
    macros, target = F.col("g.macros"), F.col("g.target")
    return given.select("p_partkey", _whole(rules.macro_features(macros, target)).alias("features"), rules.fpu_of_target(macros, target).alias("fpu"))


@query("""
SELECT p_partkey, concat_ws(';', 'UART=' || CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN 'CAN=' || CASE WHEN p_partkey % 4 = 0 THEN '2' ELSE '1' END END,
  CASE p_partkey % 3 WHEN 0 THEN 'USBOTG=1' WHEN 1 THEN 'USBD=1' END, CASE WHEN p_partkey % 5 = 0 THEN 'ETH=1' END, 'RTC=1', 'ADC=?', CASE WHEN p_partkey % 7 = 0 THEN 'COMP=?' END) AS features FROM part""")
def description_features(t):
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("Up to "), F.col("p_size").cast("string"), F.lit(" x UART, SPI, "), F.when(k % 4 == 0, "2 x CAN, ").when(k % 2 == 0, "CAN, ").otherwise(""), F.when(k % 3 == 0, "USB_OTG, ").when(k % 3 == 1, "USB(FS), ").otherwise(""),
        F.when(k % 5 == 0, "Ethernet  MAC, ").otherwise(""), F.lit("RTC. Analog: 12-bit ADC"), F.when(k % 7 == 0, ", 2 ACMP").otherwise(""), F.lit(". Other: OPAMP design notes"),
    )
    return t.part.select("p_partkey", _shown(rules.described(text)).alias("features"))


# name, group, what follows from them: peripheral, product type, family, core, WCH core and series, AVR line, CPU, lifecycle
NAMES = [
    ("LPUART1", "x", "UART", "general_purpose_mcu", "x", "LPUART1", "QingKe RISC-V", "LPUART1", "Other AVR", "LPUART1", "unknown"),
    ("TIM16", "x Series", "Timer", "general_purpose_mcu", "x", "TIM16", "QingKe RISC-V", "TIM16", "Other AVR", "TIM16", "unknown"),
    ("STM32WBA5", "x", None, "wireless_mcu", "STM32", "STM32WBA5", "QingKe RISC-V", "STM32WBA5", "Other AVR", "STM32WBA5", "unknown"),
    ("nrf52", " Series", None, "general_purpose_mcu", "nRF", "nrf52", "QingKe RISC-V", "NRF52", "Other AVR", "nrf52", "unknown"),
    ("CH32V305RB", "x", None, "general_purpose_mcu", "x", "CH32V305RB", "QingKe V4F", "CH32V305", "Other AVR", "CH32V305RB", "unknown"),
    ("ch582m", "x", None, "general_purpose_mcu", "x", "ch582m", "QingKe V4A", "CH582", "Other AVR", "ch582m", "unknown"),
    ("CM0P", "x", None, "general_purpose_mcu", "x", "Cortex-M0+", "QingKe RISC-V", "CM0P", "Other AVR", "CM0P", "unknown"),
    ("ARM Cortex-M33", "x", None, "general_purpose_mcu", "x", "Cortex-M33", "QingKe RISC-V", "ARM CORTEX-M33", "Other AVR", "ARM Cortex-M33", "unknown"),
    ("AVR128DA48", "x", None, "general_purpose_mcu", "x", "AVR128DA48", "QingKe RISC-V", "AVR128DA48", "AVR DA", "AVR128DA48", "unknown"),
    ("ATtiny1616", "tinyAVR 2", None, "general_purpose_mcu", "tinyAVR 2", "ATtiny1616", "QingKe RISC-V", "ATTINY1616", "tinyAVR 2-series", "ATtiny1616", "unknown"),
    ("Xtensa® LX7 dual", "x", None, "general_purpose_mcu", "x", "Xtensa® LX7 dual", "QingKe RISC-V", "XTENSA® LX7 DUAL", "Other AVR", "Xtensa LX7", "unknown"),
    ("Mass Production", "x", None, "general_purpose_mcu", "x", "Mass Production", "QingKe RISC-V", "MASS PRODUCTION", "Other AVR", "Mass Production", "active"),
]
_OUT = "peripheral product_type family core wch_core wch_series avr_line cpu lifecycle".split()
_values = ", ".join("(" + ", ".join(str(i) if x is i else "NULL" if x is None else f"'{x}'" for x in (i, r[0], *r[2:])) + ")" for i, r in enumerate(NAMES))


@query(f"""
WITH named(i, name, {', '.join(_OUT)}) AS (VALUES {_values})
SELECT p_partkey, named.* EXCLUDE (i), CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size + 10 AS VARCHAR) ELSE '' END AS pins,
  CASE WHEN p_partkey % 3 = 0 THEN 'AIROC Connectivity' WHEN p_partkey % 3 = 1 THEN 'PSC3' ELSE 'dev' END AS top, CASE WHEN p_partkey % 3 = 1 THEN 'PSC3' ELSE 'dev' END AS middle
FROM part JOIN named ON i = p_partkey % {len(NAMES)}""")
def naming_rules(t):
    at = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in NAMES]), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    rows = t.part.select("p_partkey", "p_size", at(0).alias("name"), at(1).alias("group"))
    n, g = F.col("name"), F.col("group")
    package = F.concat(F.lit("LQFP-"), F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") + 10).cast("string")).otherwise("x"))
    database = F.when(F.col("p_partkey") % 3 == 0, "CYW43").when(F.col("p_partkey") % 3 == 1, "PSC3A").otherwise("CAT1")
    tree = rules.hierarchy(F.lit("mcu"), database, F.lit(""), F.lit("dev"))
    found = [rules.peripheral_type(n, F.lit("")), rules.product_type(F.lit(""), n), rules.family(n, g), rules.normalized_core(n), rules.wch_core(n), rules.wch_series(n), rules.avr_line(n, g, F.lit("AVR8")), rules.cpu_name(n), rules.lifecycle(n)]
    return rows.select("p_partkey", "name", *[c.alias(name) for name, c in zip(_OUT, found)], rules.package_pins(package).alias("pins"), tree["family"].alias("top"), tree["series"].alias("middle"))


# part number, core, architecture, with an FPU, series, family, device name
WCH = [
    ("CH32F103C8T6", "Cortex-M3", "Cortex-M3", "no", "CH32F103", "CH32", "CH32F103C8"), ("ch32f203", "Cortex-M3", "Cortex-M3", "no", "CH32F203", "CH32", "ch32f203"), ("CH32H417", "QingKe V3F + QingKe V5F", "RISC-V", "yes", "CH32H417", "CH32", "CH32H417"), ("CH32V307VCT6", "QingKe V4F", "RISC-V", "yes", "CH32V307", "CH32", "CH32V307VC"),
    ("CH32V208WB", "QingKe V4C", "RISC-V", "no", "CH32V208", "CH32", "CH32V208WB"), ("CH32V203C8T6", "QingKe V4B", "RISC-V", "no", "CH32V203", "CH32", "CH32V203C8"), ("CH32V003F4P6", "QingKe V2A/V2C", "RISC-V", "no", "CH32V003", "CH32", "CH32V003F4"), ("CH32X035G8", "QingKe V2A/V2C", "RISC-V", "no", "CH32X035", "CH32", "CH32X035G8"),
    ("ch641", "QingKe V2A/V2C", "RISC-V", "no", "CH641", "CH", "CH641"), ("CH582M", "QingKe V4A", "RISC-V", "no", "CH582", "CH", "CH582M"), ("CH592FX9", "QingKe V4C", "RISC-V", "no", "CH592", "CH", "CH592F"), ("X1", "QingKe RISC-V", "RISC-V", "no", "X1", "CH", "X1"),
]
_wch_values = ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in r) + ")" for i, r in enumerate(WCH))


@query(f"""
WITH w(i, part_number, core, architecture, fpu, series, family, device_name) AS (VALUES {_wch_values})
SELECT p_partkey, w.* EXCLUDE (i) FROM part JOIN w ON i = p_partkey % {len(WCH)}""")
def wch_names(t):
    """What follows from a part number of one vendor: core, architecture, FPU, series, family and device name."""
    part = F.element_at(F.array(*[F.lit(r[0]) for r in WCH]), (F.col("p_partkey") % len(WCH) + 1).cast("int"))
    rows, p = t.part.select("p_partkey", part.alias("part_number")), F.col("part_number")
    return rows.select("p_partkey", "part_number", rules.wch_core(p).alias("core"), rules.wch_architecture(p).alias("architecture"), F.when(rules.wch_fpu(p), "yes").otherwise("no").alias("fpu"), rules.wch_series(p).alias("series"), rules.wch_family(p).alias("family"), rules.wch_variant(p).alias("device_name"))
