"""Override rules found by equality joins: each rule is indexed by a literal end of its pattern, devices probe the lengths that exist.

A glob stands under the literal text before its first wildcard, or else under that after its last one; a prefix under
itself; rules on lines and series under their value; each together with its vendor, so that a device meets those of its
own and those of none. Only what meets by such a key is verified. Patterns without any literal end have no key: they are
dealt over SPREAD keys, and each is verified against each device, as it must be. There is no cap on rules, nothing is
collected but the distinct lengths of the keys, and no join is by condition alone. Rules are broadcast where they were
counted to be few; more of them are shuffled. Devices never are broadcast: Spark takes their probes for as small as the
devices that they are made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import rule_hits

#: Keys that rules without a literal end, and their devices, are dealt over where rules are shuffled.
SPREAD = 64
#: Rules are broadcast up to so many, and so many bytes of their JSON text; more are shuffled.
BROADCAST_RULES, BROADCAST_BYTES = 10_000, 8 << 20


def index_key(kind: Column, value: Column) -> Column:
    """(way, key): where a rule stands; null for an unknown kind of rule, which never applies."""
    head, tail = F.regexp_extract(value, r"^[^*?\[]*", 0), F.regexp_extract(value, r"[^*?\]]*$", 0)
    at = lambda way, key: F.struct(F.lit(way).alias("way"), key.alias("key"))
    by_name = F.when(head != "", at("head", head)).when((kind == "glob") & (tail != ""), at("tail", tail)).otherwise(at("any", F.lit("")))
    return F.when(kind == "prefix", F.when(value != "", at("head", value)).otherwise(at("any", F.lit("")))).when(kind == "glob", by_name).when(kind.isin("line", "series"), at("kind", F.concat_ws(":", kind, value)))


def _sizes(indexed: DataFrame) -> tuple[dict[str, list[int]], bool]:
    """The distinct lengths of heads and tails (at most as many as the longest has characters), and whether the rules are few."""
    rows = indexed.groupBy("way", F.length("key").alias("n")).agg(F.count("*").alias("rules"), F.sum(F.octet_length(F.to_json("rule"))).alias("bytes")).collect()
    few = sum(r.rules for r in rows) <= BROADCAST_RULES and sum(r.bytes for r in rows) <= BROADCAST_BYTES
    return {way: sorted(r.n for r in rows if r.way == way) for way in ("head", "tail")}, few


def applied(devices: DataFrame, rules: DataFrame, name: str = "device_name", line: str = "product_line", series: str = "series", vendor: str = "manufacturer") -> DataFrame:
    """devices x the rules (kind, value, vendor, ...) that apply to them, each as a struct `rule`; a rule without a vendor applies to all.

    Rules of one key that many devices share meet them in a join that Spark may split by device.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    vendor_of, at = F.coalesce("vendor", F.lit("")), lambda way, key: F.struct(F.lit(way).alias("way"), key.alias("key"))
    indexed = rules.select(F.struct(*rules.columns).alias("rule"), index_key(F.col("kind"), F.col("value")).alias("_k"), vendor_of.alias("owner")).filter("_k is not null").select("rule", "owner", "_k.way", "_k.key")
    lengths, few = _sizes(indexed)
    spread = 1 if few else SPREAD
    numbers = F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda i: i.cast("string"))
    held = indexed.select("rule", "owner", "way", F.explode(F.when(F.col("way") == "any", numbers).otherwise(F.array("key"))).alias("key"))
    n = F.length(text(name))
    probes = [F.when(n >= k, at("head", F.substring(text(name), 1, k))) for k in lengths["head"]] + [F.when(n >= k, at("tail", F.right(text(name), F.lit(k)))) for k in lengths["tail"]]
    probes += [at("kind", F.concat_ws(":", F.lit(kind), text(c))) for kind, c in (("line", line), ("series", series))]
    probes.append(at("any", F.pmod(F.xxhash64(*[text(c) for c in (name, line, series, vendor)]), F.lit(spread)).cast("string")))
    asked = devices.select(*devices.columns, F.explode(F.array_compact(F.array(*probes))).alias("_p")).select(*devices.columns, F.col("_p.way").alias("way"), F.col("_p.key").alias("key"), F.explode(F.array_distinct(F.array(F.lit(""), text(vendor)))).alias("owner"))
    met = asked.join(F.broadcast(held) if few else held.hint("merge"), ["way", "key", "owner"])
    return met.filter(rule_hits(F.col("rule.kind"), F.col("rule.value"), text(name), text(line), text(series))).select(*devices.columns, "rule")
