"""A vendor's structured product table: each row's columns, which hold texts such as 16*12b or 2*H+1*D, as features.

Features (type, name, count, m) come in the order of the columns; a column that is missing, blank or a word for none
gives nothing. All of a row is read inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for none; plain counts by column, with kind and name; parts whose serial ports are split or plain; kinds of other features.
NONE = ["", "-", "0", "no", "none", "n/a"]
COUNTS = [("IIC", "I2C", "I²C"), ("SPI", "SPI", "SPI"), ("CAN", "CAN", "CAN"), ("SDIO", "SDIO", "SDIO")]
SPLIT_SERIAL = "CH32V307|CH32V305"
PLAIN_SERIAL = "CH32V203|CH32V208|CH32X|CH32F20|CH561|CH563|CH567|CH568|CH569|CH571|CH573|CH581|CH582|CH583|CH591|CH592|CH641|CH643|CH645"
OTHER_KINDS = {"DVP": "Camera", "FSMC": "ExtBus", "HSPI": "SPI", "QSPI": "ExtBus", "LEDC": "LEDPWM", "LCD": "LCD", "PARA": "ExtBus", "PIOC": "CoreOther", "USB": "USBD", "PD": "PowerOther"}
OTHER_SKIPPED = ["", "-", "OPA", "TRNG"]
KEPT_WHOLE = ["VDD", "Core", "LCD"]


def first_count(x: Column) -> Column:
    """The first number of a text, cut to a whole one; null for none."""
    return F.regexp_extract(x, r"\d+(?:\.\d+)?", 0).try_cast("double").cast("bigint")


def counts_of(x: Column) -> tuple[Column, Column]:
    """The first numbers of the first two parts of a text such as 2/16 or 2|16."""
    parts = F.split(x, r"[/|]")
    return first_count(F.coalesce(F.get(parts, 0), F.lit(""))), first_count(F.coalesce(F.get(parts, 1), F.lit("")))


def starred(x: Column) -> tuple[Column, Column]:
    """Count and width of a text such as 16*12b; without a star its first number and no width."""
    at = lambda k: F.regexp_extract(x, r"(\d+)\s*\*\s*(\d+)", k).try_cast("bigint")
    return F.coalesce(at(1), first_count(x)), at(2)


def yes(x: Column) -> Column:
    return ~F.lower(x).isin(*NONE)


def roles(x: Column, role: str) -> Column:
    """Sum of the counts before a role letter that no letter follows; a role without a count is one."""
    found = F.regexp_extract_all(x, F.lit(rf"(?i)(?:(\d+)\s*\*\s*)?{role}(?![A-Z])"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v.try_cast("bigint"), F.lit(1)))


def _item(there: Column, name: Column | str, kind: Column | str, n: Column | int, m: Column | str = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(lit(kind).alias("type"), lit(name).alias("name"), lit(n).cast("bigint").alias("count"), F.nullif(lit(m).cast("string"), F.lit("")).alias("m"))
    return F.when(F.coalesce(there, F.lit(False)), made)


def table_features(raw: Column, part: Column) -> Column:
    """The features of a row given as a map of its columns; `part`: the part number."""
    text = lambda c: F.trim(F.coalesce(F.try_element_at(raw, F.lit(c)), F.lit("")))
    plain = lambda c: ~text(c).isin("-", "0")
    zero = F.lit(0).cast("bigint")
    adc, shared = text("ADC"), text("TouchKey/ADC")
    there, paired = ~adc.isin("", "-"), F.contains(adc, F.lit("/"))
    units, both = F.when(there & paired, counts_of(adc)[0]), F.when(there, F.when(paired, counts_of(adc)[1]).otherwise(starred(adc)[0]))
    bits = F.coalesce(F.nullif(F.when(there & ~paired, starred(adc)[1]), zero), F.lit(12).cast("bigint"))
    width = F.concat(bits.cast("string"), F.lit("-bit"))
    channels = F.when(units.isNull() & both.isNull() & (shared != ""), counts_of(shared)[1]).otherwise(both)
    touched = F.contains(shared, F.lit("/")) & ~F.trim(F.substring_index(shared, "/", 1)).isin("", "-")
    items = [
        _item(channels.isNotNull(), F.concat(width, F.lit(" ADC channels")), "ADC", channels, width),
        _item(units.isNotNull(), "ADC converter units", "ADCUnits", units, width),
        _item(touched & counts_of(shared)[0].isNotNull(), "TouchKey channels", "Touch", counts_of(shared)[0]),
    ]
    items += [_item(first_count(text(c)).isNotNull() & plain(c), name, kind, first_count(text(c))) for c, kind, name in COUNTS]
    serial, upper = first_count(text("UART")), F.upper(part)
    usart = F.when(upper.rlike(f"^(?:{SPLIT_SERIAL})"), F.when(serial >= 8, 3).otherwise(0)).when(upper.rlike(f"^(?:{PLAIN_SERIAL})"), 0).otherwise(serial)
    items += [_item(usart > 0, "USART", "USART", usart), _item(serial - usart > 0, "UART", "UART", serial - usart)]
    timers = F.coalesce(F.nullif(text("Advanced TM"), F.lit("")), text("Timer"))
    star = F.contains(timers, F.lit("*"))
    a, b, wide = F.when(star, starred(timers)[0]).otherwise(counts_of(timers)[0]), F.when(star, zero).otherwise(counts_of(timers)[1]), F.when(star, starred(timers)[1])
    known = lambda x: F.coalesce(x, zero)
    items.append(_item(a.isNotNull() | b.isNotNull(), "Advanced/general timer groups", "Timer", known(a) + known(b), F.coalesce(wide.cast("string"), F.concat_ws("/", known(a).cast("string"), known(b).cast("string")))))
    items += [_item(first_count(text(c)).isNotNull() & plain(c), name, kind, first_count(text(c))) for c, kind, name in (("OPA", "OPAMP", "OPA / comparator"), ("Touchkey", "Touch", "TouchKey channels"))]
    items += [_item(first_count(text(c)).isNotNull(), name, kind, first_count(text(c))) for c, kind, name in (("GPIO", "IOs", "GPIO"), ("WDOG", "WDT", "Watchdog timers"))]
    items += [_item(~text(c).isin("", "-", "0"), name, kind, 1) for c, kind, name in (("RTC", "RTC", "RTC"), ("TRNG", "RNG", "True random number generator"))]
    usb = F.trim(F.concat_ws(" ", text("USB_20"), text("USB_20H")))
    otg, rest = F.contains(F.upper(usb), F.lit("OTG")), F.regexp_replace(usb, "(?i)OTG", "")
    items += [_item(yes(usb) & otg, F.concat(F.lit("USB OTG: "), usb), "USBOTG", 1), _item(yes(usb) & (roles(rest, "H") > 0), "USB Host", "USBH", roles(rest, "H")), _item(yes(usb) & (roles(rest, "D") > 0), "USB Device", "USBD", roles(rest, "D"))]
    eth, ble = text("Ethernet"), text("BLE")
    items += [_item(yes(eth) & eth.rlike(r"(?i)\d|mb|gb|eth"), F.concat(F.lit("Ethernet: "), eth), "ETH", 1), _item(~ble.isin("", "-", "0"), F.concat(F.lit("Bluetooth LE "), ble), "Bluetooth", 1)]
    items += [_item(first_count(text(c)).isNotNull() & yes(text(c)), name, kind, first_count(text(c))) for c, kind, name in (("PWM", "PWM", "PWM channels"), ("LEDC", "LEDPWM", "LEDC controller"))]
    flash = text("DataFlash")
    items.append(_item(yes(flash), F.concat(F.lit("Data Flash / EEPROM ("), flash, F.lit(")")), "DataFlash", 1, flash))
    kinds = F.create_map(*[F.lit(x) for pair in OTHER_KINDS.items() for x in pair])
    tokens = F.transform(F.split(F.replace(text("Other Features"), F.lit("<br>"), F.lit("/")), r"[/,;<>]+|\s+"), lambda t: F.upper(F.trim(t)))
    others = F.transform(F.filter(tokens, lambda t: ~t.isin(*OTHER_SKIPPED)), lambda t: _item(F.lit(True), F.concat(F.lit("WCH "), t), F.coalesce(F.try_element_at(kinds, t), F.lit("VendorCapability")), 1))
    bus, wired, cap, secret = text("SERDES/HSPI/DVP"), text("ETH/SATA"), text("CAP"), text("Encrypt")
    bus_there, wired_there = yes(bus) & bus.rlike(r"(?i)[1-9]|mhz|gb|uhs"), yes(wired) & wired.rlike(r"(?i)\d|mb|gb")
    is_eth = wired.rlike(r"(?i)^\s*(?:\d|[^/]*(?:mb|gb))")
    named = lambda label, x: F.concat(F.lit(f"{label} ("), x, F.lit(")"))
    tail = [
        _item(bus_there, named("SERDES / HSPI / DVP", bus), "VendorCapability", 1, bus),
        _item(wired_there, named("Ethernet / SATA", wired), F.when(is_eth, "ETH").otherwise("VendorCapability"), 1, wired),
        _item(yes(cap), named("WCH CAP raw parameter", cap), "VendorCapability", 1, cap),
        _item(yes(secret), named("WCH encryption", secret), "Crypto", 1, secret),
    ]
    said = [(bus_there, bus), (wired_there & ~is_eth, wired), (yes(cap), cap)]  # what a vendor capability holds already
    for c in KEPT_WHOLE:
        x = text(c)
        new = yes(x)
        for there_, other in said:
            new = new & ~(there_ & (other == x))
        tail.append(_item(new, F.concat(F.lit(f"WCH {c}: "), x), "VendorCapability", 1, x))
        said = [*said, (yes(x), x)]
    return F.concat(F.array_compact(F.array(*items)), others, F.array_compact(F.array(*tail)))
