"""Checks of a catalog: each gives rows of (check, severity, key, message); an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(rows: DataFrame, check: str, severity: str, key: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), message.alias("message"))


def unique(rows: DataFrame, key: str, check: str) -> DataFrame:
    many = rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).count().filter("count > 1")
    return _found(many, check, "error", F.col(key), F.concat(F.lit("occurs "), F.col("count").cast("string"), F.lit(" times")))


def foreign_key(rows: DataFrame, key: str, to: DataFrame, to_key: str, check: str) -> DataFrame:
    gone = rows.join(to.select(F.col(to_key).alias(key)), key, "left_anti")
    return _found(gone, check, "error", F.col(key), F.lit("has no counterpart"))


def holds(rows: DataFrame, key: str, condition: Column, check: str, severity: str = "error") -> DataFrame:
    """Rows for which the condition is false or unknown."""
    return _found(rows.filter(~F.coalesce(condition, F.lit(False))), check, severity, F.col(key), F.lit("does not hold"))


def non_negative(rows: DataFrame, key: str, fields: list[str], check: str, strict: bool = False) -> DataFrame:
    """Fields that are neither blank nor a number of at least 0 (strict: a whole one as written)."""
    long = rows.select(F.col(key).alias("k"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", "value"))
    kind = "bigint" if strict else "double"
    fine = F.col("value").try_cast(kind) >= 0
    if strict:
        fine = fine & F.col("value").rlike(r"^\s*[+-]?\d+\s*$")
    bad = long.filter((F.coalesce("value", F.lit("")) != "") & ~F.coalesce(fine, F.lit(False)))
    return _found(bad, check, "error", F.col("k"), F.concat_ws(" ", "field", "value"))


def listed(rows: DataFrame, key: str, items: Column, to: DataFrame, to_key: str, check: str) -> DataFrame:
    """Items of a list that have no counterpart."""
    each = rows.select(F.col(key).alias("k"), F.explode(items).alias("item")).filter("item <> ''")
    gone = each.join(to.select(F.col(to_key).alias("item")), "item", "left_anti")
    return _found(gone, check, "error", F.col("k"), F.concat_ws(" ", F.lit("references"), "item"))


def between(rows: DataFrame, key: str, fields: list[str], low: float, high: float, check: str) -> DataFrame:
    """Fields that are neither blank nor a number within bounds."""
    long = rows.select(F.col(key).alias("k"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", "value"))
    bad = long.filter((F.coalesce("value", F.lit("")) != "") & ~F.coalesce(F.col("value").try_cast("double").between(low, high), F.lit(False)))
    return _found(bad, check, "error", F.col("k"), F.concat_ws(" ", "field", "value"))


def parses(rows: DataFrame, key: str, fields: list[str], check: str) -> DataFrame:
    """Fields that are neither blank nor JSON."""
    long = rows.select(F.col(key).alias("k"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.coalesce(F.col(f), F.lit("")))])).alias("field", "value"))
    bad = long.filter((F.col("value") != "") & F.try_parse_json("value").isNull())
    return _found(bad, check, "error", F.col("k"), F.concat_ws(" ", "field", F.lit("is no JSON")))


def as_many(rows: DataFrame, others: DataFrame, check: str) -> DataFrame:
    """A finding if a table that is not empty has another number of rows than the other one."""
    both = rows.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(others.select(F.lit(0), F.lit(1)))
    sums = both.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a > 0 and a <> coalesce(b, 0)")
    return _found(sums, check, "error", F.lit(check), F.concat_ws(" ", F.col("a").cast("string"), F.lit("rows for"), F.col("b").cast("string")))


# The states of a verified part, the capability counts, the JSON columns and the scores that are checked.
VERIFIED = ["manufacturer_product_page", "manufacturer_product_selector_api", "manufacturer_catalog_api", "manufacturer_device_database"]
COUNTED = "core_count max_clock_hz timer_count pwm_source_quantity adc_source_quantity adc_unit_count adc_channel_count dac_source_quantity gpio_count spi_count i2c_count usart_count uart_count can_count usb_device_count usb_host_count ethernet_count dma_source_quantity rng_count i2s_count lin_count configurable_serial_count usb_otg_count sdio_count watchdog_count comparator_count opamp_count touch_source_quantity camera_interface_count display_controller_count external_bus_count external_interrupt_count temperature_sensor_count".split()
JSON_COLUMNS = "peripheral_inventory_json accelerators_json special_features_json pending_feature_candidates_json".split()
SCORES = "selection_index compute_score memory_score peripheral_score accelerator_score score_coverage_percent".split()


def catalog(lines: DataFrame, devices: DataFrame, parts: DataFrame, sources: DataFrame, capabilities: DataFrame, scores: DataFrame, least_coverage: float = 90.0) -> DataFrame:
    """All findings in a published catalog, whose cells are texts."""
    c = F.col
    filled = lambda name: F.coalesce(c(name), F.lit("")) != ""
    exempt = (c("verification_status") == "manufacturer_device_database") & (c("decode_status") == "atdf_variant_record")
    uart = (c("manufacturer") != "Espressif") | (F.coalesce(c("uart_count").try_cast("double"), F.lit(0.0)) > 0)
    coverage = scores.agg(F.avg(F.when(filled("score_coverage_percent"), c("score_coverage_percent").try_cast("double"))).alias("mean"), F.count("*").alias("n")).filter((c("n") > 0) & (F.coalesce(c("mean"), F.lit(0.0)) < least_coverage))
    actual = devices.groupBy("product_line_id").agg(F.count("*").alias("actual"))
    stated = lines.join(actual, "product_line_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    checks = [
        *[unique(df, key, check) for df, key, check in ((lines, "product_line_id", "line_unique"), (devices, "device_id", "device_unique"), (parts, "orderable_part_id", "part_unique"), (parts, "part_number", "number_unique"), (sources, "source_id", "source_unique"), (capabilities, "device_id", "capability_unique"), (scores, "device_id", "score_unique"))],
        foreign_key(devices, "product_line_id", lines, "product_line_id", "device_line"),
        holds(devices, "device_name", filled("source_id") & filled("source_version"), "device_provenance"),
        non_negative(devices, "device_name", ["max_clock_hz", "flash_bytes", "ram_bytes"], "device_sizes", strict=True),
        listed(devices, "device_name", F.split(F.coalesce("source_id", F.lit("")), ";"), sources, "source_id", "device_sources"),
        foreign_key(parts, "device_id", devices, "device_id", "part_device"),
        holds(parts, "part_number", F.startswith("part_number", c("device_name")) | exempt, "part_prefix"),
        holds(parts, "part_number", ~c("part_number").rlike(r"[*?]"), "part_wildcard"),
        holds(parts, "part_number", c("verification_status").isin(*VERIFIED), "part_verified", "warning"),
        holds(parts, "part_number", filled("source_url"), "part_url"),
        foreign_key(capabilities, "device_id", devices, "device_id", "capability_device"),
        non_negative(capabilities, "device_name", COUNTED, "capability_counts"),
        parses(capabilities, "device_name", JSON_COLUMNS, "capability_json"),
        as_many(capabilities, devices, "capability_rows"),
        holds(capabilities, "device_name", uart, "espressif_uart"),
        foreign_key(scores, "device_id", devices, "device_id", "score_device"),
        between(scores, "device_name", SCORES, 0, 100, "score_range"),
        as_many(scores, devices, "score_rows"),
        _found(coverage, "score_coverage", "error", F.lit("average"), F.format_string("%.2f", F.coalesce("mean", F.lit(0.0)))),
        _found(stated.filter(~c("device_variant_count").try_cast("bigint").eqNullSafe(c("actual"))), "line_count", "error", c("product_line"), F.concat_ws(" ", F.lit("states"), "device_variant_count", F.lit("has"), c("actual").cast("string"))),
    ]
    out = checks[0]
    for found in checks[1:]:
        out = out.unionByName(found)
    return out


def summary(lines: DataFrame, devices: DataFrame, parts: DataFrame, sources: DataFrame, capabilities: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of counts: what a validation report says beside its findings."""
    number = lambda df, *aggregates: df.agg(*aggregates).withColumn("_one", F.lit(1))
    value = F.when(F.coalesce("score_coverage_percent", F.lit("")) != "", F.col("score_coverage_percent").try_cast("double"))
    parts_of = [
        number(devices, F.countDistinct("manufacturer").alias("manufacturers"), F.countDistinct("manufacturer", "family").alias("families"), F.countDistinct("manufacturer", "series").alias("series"), F.count("*").alias("device_variants")),
        number(lines, F.count("*").alias("product_lines")),
        number(parts, F.count("*").alias("orderable_parts")),
        number(sources, F.count("*").alias("sources")),
        number(capabilities, F.count("*").alias("capability_records"), F.count_if(F.col("fpu_present").isin("yes", "no")).alias("fpu_verified_records")),
        number(scores, F.count("*").alias("score_records"), F.bround(F.coalesce(F.avg(value), F.lit(0.0)), 2).alias("average_score_coverage_percent"), F.count_if(value >= 90).alias("devices_at_or_above_90_percent")),
    ]
    out = parts_of[0]
    for df in parts_of[1:]:
        out = out.join(df, "_one")  # rows of one: an equality join
    return out.drop("_one")


def report(*checks: DataFrame) -> DataFrame:
    """Findings of each check, counted."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.groupBy("check", "severity").agg(F.count("*").alias("findings"))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, whose evaluation fails where the condition is not true."""
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
