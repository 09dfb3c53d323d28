"""Scalar expressions: parsing, keys, scores, sort keys and formats. All are pure Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(x: Column) -> Column:
    """Blank means unknown, never zero."""
    return F.when(F.trim(x) != "", x)


def number(x: Column) -> Column:
    """A decimal number, or null for anything else (not-a-number included)."""
    # a cast alone would take suffixes of literals such as 16d or 3F
    return F.when(x.cast("string").rlike(r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"), F.trim(x.cast("string")).try_cast("double"))


def whole(x: Column) -> Column:
    """A number cut to a whole one."""
    d = number(x)
    return F.when(F.abs(d) < 9.2e18, d.cast("bigint"))


def first_number(x: Column) -> Column:
    """The first number inside a text; null for none or for the usual words for none."""
    gone = F.lower(F.trim(x)).isin("", "n/a", "na", "none", "-", "no")
    return F.when(~gone, number(F.regexp_extract(x, r"(-?\d+(?:\.\d+)?)", 1)))


def quantity(feature: Column) -> Column:
    """A feature's count if that is a number, else its n."""
    return F.coalesce(number(feature["count"]), number(feature["n"]))


def int_any_base(x: Column) -> Column:
    """Integer literals in base 16 (0x), 8 (0o), 2 (0b) or 10; null for anything else."""
    t = F.lower(F.trim(x))
    sized = lambda prefix, digits, base: F.when(t.rlike(rf"^{prefix}[{digits}]+$"), F.conv(F.substring(t, 3, 64), base, 10).try_cast("bigint"))
    return F.coalesce(sized("0x", "0-9a-f", 16), sized("0o", "0-7", 8), sized("0b", "01", 2), F.when(t.rlike(r"^[+-]?(0|[1-9]\d*)$"), t.try_cast("bigint")))


def c_integer(x: Column) -> Column:
    """A C integer literal: outer parentheses and the suffixes u and l are dropped."""
    inner = F.regexp_replace(F.trim(x), r"^\(+\s*|\s*\)+$", "")
    return int_any_base(F.regexp_replace(inner, r"(?i)(?<=[0-9a-f])[ul]+$", ""))


def count_of(x: Column) -> Column:
    """A count: whole and not negative."""
    d = number(x)
    return F.when((d >= 0) & (d == F.floor(d)), d.cast("bigint"))


def memory_bytes(x: Column) -> Column:
    """Bytes of a size such as 64K, 1.5 MB or 512."""
    n = number(F.regexp_extract(x, r"^\s*(\d+(?:\.\d+)?)", 1))
    unit = F.upper(F.regexp_extract(x, r"(?i)^\s*\d+(?:\.\d+)?\s*([kmg])", 1))
    return (n * F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)).cast("bigint")


def pair(x: Column, mark: str) -> tuple[Column, Column]:
    """Both sides of a text such as 2*16; the second is null without the mark."""
    parts = F.split(x, f"\\{mark}")
    return number(F.get(parts, 0)), number(F.get(parts, 1))


def summed_roles(x: Column, role: str) -> Column:
    """Sum of the counts before a role in a text such as 2*H+1*D; a role without a count is one."""
    found = F.regexp_extract_all(x, F.lit(rf"(?:(\d+)\*)?{role}"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v.try_cast("bigint"), F.lit(1)))


def slug(x: Column, default: str = "unknown") -> Column:
    """Runs of other characters than a-z and 0-9 become one dash; the default for nothing left."""
    s = F.btrim(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", default).otherwise(s)


def slug_each(x: Column) -> Column:
    """Every character that is no letter or digit becomes a dash of its own."""
    return F.btrim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "-"), F.lit("-"))


def slug_plain(x: Column) -> Column:
    """As slug, without a default."""
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def without_prefix(x: Column, prefix: Column) -> Column:
    return F.when(F.startswith(x, prefix), F.substring(x, F.length(prefix) + 1, F.length(x))).otherwise(x)


def log_score(v: Column, low: float, high: float) -> Column:
    """Where a value lies between two others on a log scale, 0 to 100; null for unknown or non-positive values."""
    at = 100 * (F.log2(v) - F.log2(F.lit(float(low)))) / (F.log2(F.lit(float(high))) - F.log2(F.lit(float(low))))
    return F.when(v > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), at)))


def weighted_score(parts: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """Mean of the known parts by weight (null without any), and the share of the weight that is known, in percent."""
    known = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in parts), F.lit(0.0))
    total = sum((F.coalesce(v * float(w), F.lit(0.0)) for v, w in parts), F.lit(0.0))
    return F.when(known > 0, total / known), F.bround(100 * known / sum(w for _, w in parts), 0).cast("int")


#: Accented letters of Latin scripts, and the letters that they sort as.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśşšţťūůűźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorssssttuuuzzz"


def natural_key(x: Column) -> Column:
    """A sort key by which digits compare as numbers, of any length, and case and accents do not matter."""
    parts = F.regexp_extract_all(F.translate(F.lower(x), ACCENTED, PLAIN), F.lit(r"(\d+|\D+)"), F.lit(0))
    # a number is preceded by its length without leading zeros
    digits = lambda t: F.regexp_replace(t, "^0+", "")
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(t)).cast("string"), 6, "0"), digits(t))).otherwise(t)), "")


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many leading characters agree, case aside."""
    a, b = F.upper(a), F.upper(b)
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(n <= 0, 0).otherwise(F.coalesce(F.get(at, F.lit(0)) - 1, n)))


def glob_regex(pattern: Column) -> Column:
    """A shell pattern (*, ?, [..] and [!..]) as an anchored regular expression; case matters."""
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)\[!?\]?[^\]]*\]|."), F.lit(0))
    inside = lambda t: F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"([\\\[\]^&])", r"\\$1")
    several = lambda t: F.concat(F.lit("["), F.regexp_replace(inside(t), "^!", "^"), F.lit("]"))
    one = lambda t: F.when(t == "*", ".*").when(t == "?", ".").otherwise(F.regexp_replace(t, r"([\\.^$|()\[\]{}+])", r"\\$1"))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(parts, lambda t: F.when(F.length(t) > 1, several(t)).otherwise(one(t))), ""), F.lit("\\z"))


def compact_number(x: Column) -> Column:
    """A number as text without a needless fraction; blank for an unknown one."""
    return F.when(x.isNull(), "").when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def numeric_text(x: Column) -> Column:
    """A number in a text, cut to a whole one; blank for anything else."""
    return F.coalesce(whole(x).cast("string"), F.lit(""))


def scaled_text(x: Column, factor: float) -> Column:
    """As numeric_text, of the number times a factor (MHz to Hz, KB to bytes)."""
    return F.coalesce((number(x) * factor).cast("bigint").cast("string"), F.lit(""))


def canonical_map(x: Column) -> Column:
    """A map with its keys in order, so that its JSON text is always the same."""
    return F.map_from_entries(F.sort_array(F.map_entries(x)))  # keys differ and are never null


def clock_text(hz: Column) -> Column:
    """48 MHz, 32.768 kHz, 500 Hz."""
    short = lambda d, unit: F.concat(F.regexp_replace(F.format_string("%.3f", hz / d), r"\.?0+$", ""), F.lit(f" {unit}"))
    return F.when(hz.isNull(), None).when(hz >= 1e6, short(1e6, "MHz")).when(hz >= 1e3, short(1e3, "kHz")).otherwise(F.concat(hz.cast("bigint").cast("string"), F.lit(" Hz")))


def memory_text(n: Column) -> Column:
    """2 MB, 64 KB, 100 B."""
    text = lambda d, unit: F.concat(F.regexp_replace(F.format_string("%.2f", n / d), r"\.?0+$", ""), F.lit(f" {unit}"))
    return F.when(n.isNull(), None).when(n >= 1048576, text(1048576.0, "MB")).when(n >= 1024, text(1024.0, "KB")).otherwise(F.concat(n.cast("bigint").cast("string"), F.lit(" B")))


def known_sum(*xs: Column) -> Column:
    """Sum in which unknowns count as zero; null only if all are unknown."""
    return F.when(F.coalesce(*xs).isNotNull(), sum((F.coalesce(x, F.lit(0)) for x in xs), F.lit(0)))


def cascade(x: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that the text meets."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(x.rlike(pattern), label).otherwise(out)
    return F.coalesce(out, F.lit(default)) if default is not None else out


def lookup(x: Column, table: dict[str, str]) -> Column:
    """A fixed mapping as a literal."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.element_at(F.create_map(*pairs), x)


def joined_once(items: Column, item: Column) -> Column:
    """A ;-list with an item appended unless it is there."""
    held = F.filter(F.split(F.coalesce(items, F.lit("")), ";"), lambda x: x != "")
    return F.array_join(F.array_union(held, F.filter(F.array(item), lambda x: x.isNotNull() & (x != ""))), ";")


def split_list(items: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(items, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
