"""The selection score: four dimensions, each a weighted mean of what is known, and a coverage beside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.exprs import log_score, weighted_score
from partloom.functions.features import best_rank

# Weights of the dimensions and ranges of the log scales (Hz, KiB).
WEIGHTS = {"compute": 35, "memory": 25, "peripheral": 25, "accelerator": 15}
CLOCK, FLASH, RAM = (8e6, 800e6), (16.0, 4096.0), (4.0, 1024.0)
#: Peripheral pieces: points at most and the count that earns them; presence pieces earn their points with one.
PIECES = {"timer": (25, 12), "adc_channels": (12, 16), "dac": (5, 2), "serial": (20, 12), "can": (10, 1), "usb": (10, 1), "eth": (8, 1), "gpio": (10, 100)}
ACCELERATORS = [("npu neural", 100), ("cordic fmac tmu math trigonometric", 75), ("chrom-art dma2d graphics jpeg", 65), ("aes hash crypto", 50)]


def peripheral_score(counts: dict[str, Column]) -> Column:
    """Points are summed, not renormalised; null only if no piece is known."""
    points = [F.when(c.isNotNull(), F.least(F.lit(1.0), c / PIECES[k][1]) * PIECES[k][0]) for k, c in counts.items()]
    known = F.coalesce(*points)
    return F.when(known.isNotNull(), F.least(F.lit(100.0), sum((F.coalesce(p, F.lit(0.0)) for p in points), F.lit(0.0))))


def accelerator_score(fpu: Column, labels: Column) -> Column:
    """FPU (yes 60, no 0, unknown left out) and the best kind of accelerator named (30 for another kind), 35 to 65."""
    own = F.when(fpu == "yes", 60.0).when(fpu == "no", 0.0)
    text = F.lower(F.coalesce(labels, F.lit("")))
    best = F.lit(30.0)
    for words, points in reversed(ACCELERATORS):
        best = F.when(text.rlike("|".join(words.split())), float(points)).otherwise(best)
    return weighted_score([(own, 35), (F.when(text != "", best), 65)])[0]


def scores(df: DataFrame, clock: Column, rank: Column, flash: Column, ram: Column, pieces: dict[str, Column], fpu: Column, labels: Column) -> DataFrame:
    """df with the four dimension scores, the index and its coverage, rounded half to even. A size or clock of 0 is unknown."""
    compute = weighted_score([(log_score(clock, *CLOCK), 60), (rank.cast("double"), 40)])[0]
    memory = weighted_score([(log_score(flash / 1024, *FLASH), 55), (log_score(ram / 1024, *RAM), 45)])[0]
    parts = {"compute": compute, "memory": memory, "peripheral": peripheral_score(pieces), "accelerator": accelerator_score(fpu, labels)}
    for name, c in parts.items():
        df = df.withColumn(f"{name}_score", c)
    index, coverage = weighted_score([(F.col(f"{n}_score"), w) for n, w in WEIGHTS.items()])
    df = df.withColumn("selection_index", index).withColumn("score_coverage_percent", coverage)
    for name in [*(f"{n}_score" for n in parts), "selection_index"]:
        df = df.withColumn(name, F.bround(F.col(name), 0).cast("int"))
    return df


def of_records(records: DataFrame, sizes: DataFrame, core_ranks: dict[str, int], version: str = "1") -> DataFrame:
    """The score record of each capability record; sizes: device_id, flash_bytes, ram_bytes."""
    c = F.col
    some = lambda *xs: F.when(F.coalesce(*xs).isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)))
    named = F.from_json("accelerators_json", "array<struct<name:string>>")
    pieces = {"timer": c("timer_count"), "adc_channels": c("adc_channel_count"), "dac": c("dac_source_quantity"), "serial": some(*map(c, ("spi_count", "i2c_count", "usart_count", "uart_count"))), "can": c("can_count"), "usb": some(c("usb_device_count"), c("usb_host_count")), "eth": c("ethernet_count"), "gpio": c("gpio_count")}
    pieces |= {k: F.when(pieces[k].isNotNull(), (pieces[k] > 0).cast("double")) for k in ("can", "usb", "eth")}
    both = records.join(sizes.select("device_id", "flash_bytes", "ram_bytes"), "device_id", "left")
    found = scores(both, c("max_clock_hz").cast("double"), best_rank(F.split("core_names", ";"), core_ranks), c("flash_bytes").cast("double"), c("ram_bytes").cast("double"), pieces, c("fpu_present"), F.array_join(F.transform(named, lambda x: x["name"]), " "))
    blank = {k: F.lit("").alias(k) for k in ("benchmark_coremark", "benchmark_dmips", "benchmark_source_url")}
    return found.select("device_id", "manufacturer", "device_name", "selection_index", "compute_score", "memory_score", "peripheral_score", "accelerator_score", "score_coverage_percent", *blank.values(), F.lit("not_imported").alias("benchmark_status"), F.lit(version).alias("scoring_model_version"), F.lit("derived_selection_index_not_benchmark").alias("score_status"))
