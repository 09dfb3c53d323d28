"""Expressions over a device's feature and processor arrays (array<map<string,string>>), without exploding them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import number, quantity

# Sources whose counts are for the very device, words for no and for unknown, cores without an FPU, core ranks.
EXACT_SOURCES = ["cubemx_device_db", "microchip_atdf", "puya_device_header", "infineon_device_db", "espressif_idf_soc_caps"]
FALSE_WORDS = ["0", "false", "none", "no", "disabled", "not_present"]
UNKNOWN_WORDS = ["unknown", "unspecified", "na", "n/a"]

FEATURES = "array<map<string,string>>"


def decoded(cell: Column, strict: bool = False) -> Column:
    """The array in a JSON cell. Blank is empty; what is no array fails if strict and else is empty."""
    text = F.coalesce(F.when(F.trim(cell) != "", cell), F.lit("[]"))
    if strict:
        return F.from_json(text, FEATURES, {"mode": "FAILFAST"})
    return F.coalesce(F.from_json(text, FEATURES), F.array().cast(FEATURES))


def lowered(feature: Column, key: str) -> Column:
    return F.lower(F.coalesce(feature[key], F.lit("")))


def matching(features: Column, types=(), tokens=(), exclude=()) -> Column:
    """Features of a type or with a token in their name, but without an excluded token; only exact ones if any is."""

    def fits(f: Column) -> Column:
        name = lowered(f, "name")
        hit = lowered(f, "type").isin(*[t.lower() for t in types]) if types else F.lit(False)
        for t in tokens:
            hit = hit | F.contains(name, F.lit(t))
        for t in exclude:
            hit = hit & ~F.contains(name, F.lit(t))
        return hit

    found = F.filter(features, fits)
    exact = F.filter(found, lambda f: F.coalesce(f["source_kind"], F.lit("")).isin(*EXACT_SOURCES))
    return F.when(F.size(exact) > 0, exact).otherwise(found)


def summed(found: Column) -> Column:
    """Sum of quantities; null if none is a number."""
    values = F.filter(F.transform(found, quantity), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v))


def count_of(features: Column, types=(), tokens=(), exclude=()) -> Column:
    return summed(matching(features, types, tokens, exclude))


def preferred_count(features: Column, types, tokens) -> Column:
    """By type if that gives a number, else by name."""
    return F.coalesce(count_of(features, types), count_of(features, (), tokens))


def presence(features: Column, types=(), tokens=()) -> Column:
    """yes if a matching feature has a quantity other than the text 0 (or none), no if all have 0, unknown without any."""
    found = matching(features, types, tokens)
    text = lambda f: F.coalesce(F.when(f["count"] != "", f["count"]), f["n"], F.lit(""))
    return F.when(F.size(found) == 0, "unknown").when(F.exists(found, lambda f: text(f) != "0"), "yes").otherwise("no")


def flag(processors: Column, key: str) -> Column:
    """Three-state value of a processor attribute over all processors."""
    held = F.filter(F.transform(processors, lambda p: p[key]), lambda v: v.isNotNull() & (v != ""))
    plain = F.transform(held, lambda v: F.translate(F.lower(F.trim(v)), "- ", "__"))
    known = F.filter(plain, lambda v: ~v.isin(*UNKNOWN_WORDS))
    return F.when(F.size(known) == 0, "unknown").when(F.exists(known, lambda v: ~v.isin(*FALSE_WORDS) & ~F.startswith(v, F.lit("no_"))), "yes").otherwise("no")


def fpu(processors: Column, cores_without: list[str]) -> Column:
    """As flag; but no if nothing is known and every core is of a kind without an FPU."""
    cores = F.filter(F.transform(processors, lambda p: p["Dcore"]), lambda c: c.isNotNull() & (c != ""))
    none = (F.size(cores) > 0) & F.forall(cores, lambda c: F.lower(c).isin(*[x.lower() for x in cores_without]))
    state = flag(processors, "Dfpu")
    return F.when((state == "unknown") & none, "no").otherwise(state)


def core_count(processors: Column) -> Column:
    """Sum of the explicit positive counts, else the number of processors."""
    counts = F.filter(F.transform(processors, lambda p: number(p["DcoreCount"])), lambda v: v > 0)
    return F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0.0), lambda a, v: a + v).cast("int")).otherwise(F.size(processors))


def best_rank(names: Column, ranks: dict[str, int]) -> Column:
    pairs = [F.lit(v) for kv in ranks.items() for v in kv]
    return F.array_max(F.transform(names, lambda c: F.element_at(F.create_map(*pairs), F.lower(c))))


def max_preferring(features: Column, kind: str) -> Column:
    """The largest quantity, among those of one source kind if it has any."""
    best = lambda fs: F.array_max(F.transform(fs, quantity))
    return F.coalesce(best(F.filter(features, lambda f: f["source_kind"] == kind)), best(features))


def missing(labels: list[tuple[str, Column]]) -> Column:
    """Labels of unknown values, joined by ;"""
    return F.array_join(F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in labels])), ";")


def replaced(features: Column, kind: str, new: Column) -> Column:
    """Items of one source dropped and its new ones put at the end: running it twice is as running it once."""
    return F.concat(F.filter(features, lambda f: F.coalesce(f["source_kind"], F.lit("")) != kind), new)
