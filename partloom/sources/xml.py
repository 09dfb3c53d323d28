"""XML sources, read by Spark's own XML functions and put in relational form.

Inheritance in a device tree is no walk here: every level's values are exploded with their depth, and for each leaf the
deepest value of an attribute wins. Depth is bounded by the format (family, subFamily, device, variant).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.session import written

# Attributes of the elements that are read.
PROCESSOR = "Pname Dcore Dclock DcoreCount Dfpu Dmpu Ddsp Dtz Darchitecture".split()
MEMORY = "id name start size access default startup".split()
FEATURE = "type name count n m".split()

_attrs = lambda names: ", ".join(f"_{a} string" for a in names)
_OWN = f"processor array<struct<{_attrs(PROCESSOR)}>>, memory array<struct<{_attrs(MEMORY)}>>, feature array<struct<{_attrs(FEATURE)}>>"
_VARIANT = f"struct<_Dvariant string, {_OWN}>"
_DEVICE = f"struct<_Dname string, {_OWN}, variant array<{_VARIANT}>>"
_SUB = f"struct<_DsubFamily string, {_OWN}, device array<{_DEVICE}>>"
FAMILY = f"_Dfamily string, _Dvendor string, {_OWN}, subFamily array<{_SUB}>, device array<{_DEVICE}>"


def device_leaves(families: DataFrame, xml: str = "xml") -> DataFrame:
    """(vendor, family, sub_family, device, leaf, levels) for each variant, or device without any; levels: its ancestors' own values, outermost first."""
    own = lambda c: F.struct(c["processor"].alias("processor"), c["memory"].alias("memory"), c["feature"].alias("feature"))
    top = families.select(F.from_xml(F.col(xml), FAMILY).alias("f"))
    under = top.select("f", F.explode(F.concat(F.coalesce(F.transform("f.subFamily", lambda s: F.struct(s["_DsubFamily"].alias("name"), own(s).alias("own"), s["device"].alias("device"))), F.array()), F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast(f"struct<{_OWN}>").alias("own"), F.col("f.device").alias("device"))))).alias("s"))
    devices = under.select("f", "s", F.explode("s.device").alias("d"))
    leaves = devices.select("f", "s", "d", F.explode_outer("d.variant").alias("v"))
    leaf = F.coalesce("v._Dvariant", "d._Dname")
    return leaves.select(F.col("f._Dvendor").alias("vendor"), F.col("f._Dfamily").alias("family"), F.col("s.name").alias("sub_family"), F.col("d._Dname").alias("device"), leaf.alias("leaf"), F.array(own(F.col("f")), F.col("s.own"), own(F.col("d")), own(F.col("v"))).alias("levels"))


def inherited(leaves: DataFrame, kind: str, names: list[str], item: Column) -> DataFrame:
    """(leaf, item, attribute, value): for each item of a leaf the deepest level's value of each attribute."""
    each = leaves.select("leaf", F.posexplode("levels").alias("depth", "level")).select("leaf", "depth", F.explode(F.col(f"level.{kind}")).alias("x"))
    long = each.select("leaf", "depth", item.alias("item"), F.explode(F.create_map(*[y for a in names for y in (F.lit(a), F.col(f"x._{a}"))])).alias("attribute", "value")).filter("value is not null")
    return long.groupBy("leaf", "item", "attribute").agg(F.max_by("value", "depth").alias("value"))


PERIPHERAL = "name string, groupName string, dim int, _derivedFrom string"


def peripheral_counts(peripherals: DataFrame, rules: list[tuple[str, str]], xml: str = "xml") -> DataFrame:
    """(type, instances, n) over peripheral elements: names with %s are spread over their dimension."""
    from partloom.functions.exprs import cascade

    p = peripherals.select(F.from_xml(F.col(xml), PERIPHERAL).alias("p")).select("p.*")
    n = F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("dim", F.lit(1)), F.lit(1)) - 1)).alias("i")
    names = p.select("name", n).select(F.regexp_replace("name", r"\[?%[sd]\]?", F.col("i").cast("string")).alias("name"))
    typed = names.withColumn("type", cascade(F.upper("name"), rules)).filter("type is not null")
    return typed.groupBy("type").agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("instances"), F.countDistinct("name").alias("n"))


ATDF = "_name string, modules struct<module array<struct<_name string, instance array<struct<_name string, signals struct<signal array<struct<_group string, _pad string, _index string>>>>>>>>, `address-spaces` struct<`address-space` array<struct<_name string, `memory-segment` array<struct<_name string, _type string, _size string, _external string>>>>>"


def device_modules(devices: DataFrame, rules: list[tuple[str, str]], xml: str = "xml") -> DataFrame:
    """(device, type, n): distinct instances of each classified module of a device description."""
    from partloom.functions.exprs import cascade

    d = devices.select(F.from_xml(F.col(xml), ATDF).alias("d")).select(F.col("d._name").alias("device"), F.explode("d.modules.module").alias("m"))
    each = d.select("device", cascade(F.upper("m._name"), rules).alias("type"), F.explode("m.instance._name").alias("instance")).filter("type is not null")
    return each.groupBy("device", "type").agg(F.countDistinct("instance").alias("n"))


def device_memory(devices: DataFrame, xml: str = "xml") -> DataFrame:
    """(device, flash_bytes, ram_bytes): the largest flash segment and the sum of the internal RAM segments."""
    from partloom.functions.exprs import int_any_base

    d = devices.select(F.from_xml(F.col(xml), ATDF).alias("d")).select(F.col("d._name").alias("device"), F.explode(F.col("d.`address-spaces`.`address-space`")).alias("s"))
    m = d.select("device", F.explode("s.memory-segment").alias("m")).select("device", F.lower("m._type").alias("type"), int_any_base(F.col("m._size")).alias("size"), F.coalesce("m._external", F.lit("false")).alias("external"))
    return m.filter("external <> 'true'").groupBy("device").agg(F.max(F.when(F.col("type") == "flash", F.col("size"))).alias("flash_bytes"), F.sum(F.when(F.col("type") == "ram", F.col("size"))).alias("ram_bytes"))


MCU = "_RefName string, Core string, Frequency string, Flash array<string>, Ram array<string>, IP array<struct<_Name string, _InstanceName string>>, Pin array<struct<_Name string, _Type string>>"


def device_pins(mcus: DataFrame, xml: str = "xml") -> DataFrame:
    """(device, n_pins, n_io, n_ips) of device database entries."""
    m = mcus.select(F.from_xml(F.col(xml), MCU).alias("m")).select("m.*")
    return m.select(F.col("_RefName").alias("device"), F.size("Pin").alias("n_pins"), F.size(F.filter("Pin", lambda p: p["_Type"] == "I/O")).alias("n_io"), F.size(F.array_distinct(F.transform("IP", lambda i: i["_InstanceName"]))).alias("n_ips"))


def pack_index(index: DataFrame, suffix: str, xml: str = "xml") -> DataFrame:
    """(vendor, name, version, url) of an index's packs whose name ends with a suffix."""
    p = index.select(F.explode(F.from_xml(F.col(xml), "pindex struct<pdsc array<struct<_vendor string, _name string, _version string, _url string>>>")["pindex"]["pdsc"]).alias("p"))
    return p.select(F.col("p._vendor").alias("vendor"), F.col("p._name").alias("name"), F.col("p._version").alias("version"), F.col("p._url").alias("url")).filter(F.endswith(F.lower("name"), F.lit(suffix)))


REGISTERS = "peripherals struct<peripheral array<struct<_derivedFrom string, name string, groupName string, dim string, dimIndex string>>>"


def register_peripherals(files: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, at, name, ref, group_name, dim, dim_index) of every peripheral of register descriptions, as written."""
    each = files.select(key, F.posexplode(F.from_xml(F.col(xml), REGISTERS)["peripherals"]["peripheral"]).alias("at", "p"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return each.select(key, "at", blank(F.col("p.name")).alias("name"), blank(F.col("p._derivedFrom")).alias("ref"), blank(F.col("p.groupName")).alias("group_name"), blank(F.col("p.dim")).alias("dim"), blank(F.col("p.dimIndex")).alias("dim_index")).filter("name is not null")


def derived(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """rows (key, at, name, ref, values) with what they lack taken from the rows they refer to, nearest first, and an error.

    Pointer jumping: in each round a row takes the values of its target and the target's own reference, so chains of
    length n end after log2(n) joins. Of rows with one name in a document the first is the target. A reference to no row
    gives `unknown reference` and the values up to there; rows on a circle, or leading to one, are still open when every
    chain without a circle has ended: they keep their own values, with `circular reference`.
    """
    own = written(rows.select("*", F.lit(None).cast("string").alias("error")))
    longest = own.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    held = own
    for _ in range(longest.bit_length() + 1):
        if held.filter("ref is not null").isEmpty():
            return held.drop("ref")
        targets = held.groupBy(key, F.col("name").alias("ref")).agg(F.min_by(F.struct(F.lit(1).alias("there"), F.col("ref").alias("next"), "error", *values), "at").alias("t"))
        met = held.filter("ref is not null").join(targets, [key, "ref"], "left")
        error = F.coalesce("error", "t.error", F.when(F.col("t").isNull(), "unknown reference"))
        moved = met.select(*[c for c in own.columns if c not in (*values, "ref", "error")], F.col("t.next").alias("ref"), *[F.coalesce(v, f"t.{v}").alias(v) for v in values], error.alias("error"))
        held = written(held.filter("ref is null").unionByName(moved))
    open_ = held.filter("ref is not null").select(key, "at", F.lit("circular reference").alias("circle"))
    back = own.drop("ref", "error").join(open_, [key, "at"]).withColumnRenamed("circle", "error")
    return held.filter("ref is null").drop("ref").unionByName(back)


def register_features(peripherals: DataFrame, key: str) -> DataFrame:
    """(key, type, n, instances) of classified peripherals; %s and %d stand for the entries of dimIndex, or for 0 .. dim - 1."""
    from partloom.functions.exprs import int_any_base, natural_key
    from partloom.operators.rules import peripheral_type

    dim = F.greatest(F.coalesce(int_any_base(F.col("dim")), F.lit(1)), F.lit(1))
    numbers = F.transform(F.sequence(F.lit(0), dim - 1), lambda i: i.cast("string"))
    listed = F.transform(F.split("dim_index", ","), lambda x: F.trim(x))
    ends = F.regexp_extract("dim_index", r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract("dim_index", r"^(\d+)-(\d+)$", 2).try_cast("int")
    spanned = F.when(ends[0] <= ends[1], F.transform(F.sequence(ends[0], ends[1]), lambda i: i.cast("string")))
    given = F.coalesce(spanned, listed)
    index = F.when(F.size(given) == dim, given).otherwise(numbers)
    marked = F.col("name").rlike("%[sd]")
    names = F.when(marked, F.transform(index, lambda i: F.replace(F.replace("name", F.lit("%s"), i), F.lit("%d"), i))).otherwise(F.array("name"))
    typed = peripherals.select(key, peripheral_type(F.col("name"), F.col("group_name")).alias("type"), names.alias("names")).filter("type is not null")
    each = typed.select(key, "type", F.explode("names").alias("instance")).groupBy(key, "type", "instance").agg(F.lit(1).alias("_"))
    ordered = F.array_sort(F.collect_list(F.struct(natural_key(F.col("instance")), "instance")))  # the instances of one document
    return each.groupBy(key, "type").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["instance"]), ", ").alias("instances"))
