"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question keeps its template when its parameters change.
Windows of the template's words are hashed and joined by hash with the benchmark's windows. A document that holds at
least half of an item's windows is a candidate for that item. For items with slots, the slot check then pairs the
document's values with the item's at every joined window: each item value must stand for one document value, in one
aligned occurrence that holds half of the windows or throughout the document, else the match is a chance meeting of
placeholders and is dropped. Windows of the case-folded words are joined beside the templates': a document that holds
all of an item's is reported whatever else it holds, and one that holds half if templates miss it.

Names are capitalised words wherever they stand, runs of them one name whose value is the last word. In items shorter
than a window, where a placeholder for the first word would leave little, only those after a lower-case word are.

Defined results: null or empty texts hold no windows; documents without an id take part and are reported with a null
id; each text of an id that is repeated is judged on its own, and the id gets one row for each item, of the text that
holds most of it; an item shorter than a window is one window of its own length; windows of placeholders alone are no
evidence; an empty benchmark finds nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, lookup_join, prepare, written

#: Words of a window, and the share of an item's windows that makes a document a candidate.
WINDOW, COVERAGE = 8, 0.5

# no repeated groups: Java matches them by recursion, which long runs overflow
NUMBER = r"\d[\d.,:/]*(?<=\d)"
CAPITALISED = r"\p{Lu}[\p{L}'’-]*+"
#: What stands before a name: anywhere, or after a lower-case word. Looked at only where a capital follows: Java would
#: else look behind every character.
ANYWHERE, INSIDE = r"(?=\p{Lu})(?<![\p{L}\p{N}'’-])", r"(?=\p{Lu})(?<=\p{Ll}[,;:]? )"
#: What stands between words; the ranges are part of the classes after them and tell most characters sooner.
BETWEEN = r"[^a-z0-9\p{L}\p{N}]+"
#: Units that follow a number.
UNITS = "km cm mm m kg g mg lb lbs oz l ml s ms min mins minutes minute h hr hrs hour hours day days week weeks month months year years km/h mph m/s kmh % percent usd eur gbp dollars dollar euros euro cents cent pounds pound miles mile feet foot ft inches inch yards yard meters meter metres metre liters liter litres litre gallons gallon degrees degree".split()
NUM, NAMED, UNIT = "<n>", "<p>", "<u>"


def named(text: Column, before: str) -> Column:
    """The text with the last word alone of each run of capitalised words that is a name."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"{before}{CAPITALISED} (?=\p{{Lu}})", "")


def template(text: Column, before: str = ANYWHERE) -> Column:
    """The words of a text's template, lower-cased, with placeholders for numbers, names and units."""
    held = F.regexp_replace(named(text, before), before + CAPITALISED, NAMED)
    held = F.regexp_replace(held, NUMBER, f" {NUM} ")
    units = "|".join(sorted((u.replace("%", "%(?!%)") for u in UNITS), key=len, reverse=True))
    held = F.regexp_replace(held, rf"(?i){NUM} +(?:{units})(?![\p{{L}}\p{{N}}])", f"{NUM} {UNIT} ")
    return F.filter(F.split(F.lower(held), BETWEEN.replace("[^", "[^<>")), lambda w: w != "")


def slots(text: Column, before: str = ANYWHERE) -> Column:
    """The numbers and then the names of a text in order: two arrays in a struct."""
    held = named(text, before)
    numbers = F.regexp_extract_all(F.regexp_replace(held, before + CAPITALISED, NAMED), F.lit(f"({NUMBER})"))
    names = F.regexp_extract_all(held, F.lit(f"({before}{CAPITALISED})"))
    return F.struct(numbers.alias("n"), names.alias("p"))


def folded(text: Column) -> Column:
    """The words of a text, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def solid(words: Column, at: Column, length: int) -> Column:
    """Whether the window of `length` words after `at` others is not of placeholders alone."""
    return F.exists(F.slice(words, at + 1, length), lambda w: ~w.isin(NUM, NAMED, UNIT))


def windows_of(df: DataFrame, words: str, length: int, *columns: str) -> DataFrame:
    """columns, at, hash: a row for each window of `length` words, with the place of its first word and one hash for all.

    Rows and not an array of hashes: that takes a lambda, which copies each window and is not compiled.
    """
    last = F.size(words) - length
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    one = F.xxhash64(*[F.get(words, F.col("at") + k) for k in range(length)])
    return df.withColumn("at", F.explode(places)).select(*columns, "at", one.alias("hash"))


def one_row(found: DataFrame) -> DataFrame:
    """Of each (doc_id, item_id) the row with most of the item, then with fewest changes."""
    best = F.max(F.struct("coverage", (-F.col("n_changed")).alias("c"), "n_windows", "n_hits", "n_slots", "n_changed"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_windows", "b.n_hits", "b.coverage", "b.n_slots", "b.n_changed")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_hits, coverage, n_slots, n_changed) for each document that holds an item.

    n_windows: distinct windows of the item; n_hits: those that the document holds; n_slots: distinct slot values of
    the item at joined windows; n_changed: those for which the document has another value (0: a verbatim copy). Where
    templates miss the document, the first two count windows of the words themselves.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    readings = {"names": lambda t: template(t), "inside": lambda t: template(t, INSIDE), "folded": folded}
    items = items.withColumn("words", template(F.col("text")))
    items = items.withColumn("reading", F.when(F.size("words") >= window, "names").otherwise("inside"))
    items = items.withColumn("words", F.when(F.col("reading") == "names", F.col("words")).otherwise(template(F.col("text"), INSIDE))).filter(F.size("words") > 0)
    # where there are placeholders, the words themselves are looked for as well
    plain = items.filter(F.exists("words", lambda w: w.isin(NUM, NAMED, UNIT))).select("item_id", "text", folded(F.col("text")).alias("words"), F.lit("folded").alias("reading"))
    asked = items.select("item_id", "text", "words", "reading").unionByName(plain.filter(F.size("words") > 0)).withColumn("len", F.least(F.size("words"), F.lit(window)))
    kinds = sorted(tuple(r) for r in asked.select("reading", "len").distinct().collect())  # at most 3 * `window` values
    if not kinds:
        nothing = [F.lit(0).cast(kind).alias(c) for c, kind in (("n_windows", "long"), ("n_hits", "long"), ("coverage", "double"), ("n_slots", "long"), ("n_changed", "long"))]
        return d.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), *nothing).limit(0)
    parts = [
        windows_of(asked.filter((F.col("reading") == kind) & (F.col("len") == n)), "words", n, "item_id", "reading", "words")
        .filter(solid(F.col("words"), F.col("at"), n))
        .select("item_id", "reading", F.lit(n).alias("len"), "hash")
        for kind, n in kinds
    ]
    windows = parts[0]
    for p in parts[1:]:
        windows = windows.unionByName(p)
    windows = written(windows)
    sizes = windows.groupBy("item_id", "reading").agg(F.countDistinct("len", "hash").alias("n_windows"))
    # one row per hash: what meets in the join with the documents does not depend on how many items share a window
    by_hash = windows.groupBy("reading", "len", "hash").agg(F.collect_set("item_id").alias("items"))
    small = is_small(by_hash)  # by rows and by bytes, as a hash may have many items

    raw = d.withColumn("key", F.xxhash64("doc_id", "text"))
    found = None
    for kind, n in kinds:
        hits = windows_of(raw.select("key", "doc_id", readings[kind](F.col("text")).alias("words")), "words", n, "key", "doc_id")
        mine = by_hash.filter((F.col("reading") == kind) & (F.col("len") == n)).select("hash", "items")
        hits = hits.join(F.broadcast(mine) if small else mine, "hash").select("key", "doc_id", F.lit(kind).alias("reading"), F.lit(n).alias("len"), "hash", F.explode("items").alias("item_id"))
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("key", "doc_id", "item_id", "reading", "len", "hash").agg(F.lit(1).alias("one")).groupBy("key", "doc_id", "item_id", "reading").agg(F.count("*").alias("n_hits"))
    tiny = F.broadcast(sizes) if is_small(sizes) else sizes
    both = found.join(tiny, ["item_id", "reading"]).withColumn("coverage", F.col("n_hits") / F.col("n_windows")).filter(F.col("coverage") >= coverage)
    # one row a pair: what the template gave, else what the words gave
    is_plain = F.col("reading") == "folded"
    best = F.max_by(F.struct("n_windows", "n_hits", "coverage"), (~is_plain).cast("int"))
    held = both.groupBy("key", "doc_id", "item_id").agg(best.alias("b"), F.max(~is_plain).alias("by_template"), F.coalesce(F.max(F.when(is_plain, F.col("n_hits") == F.col("n_windows"))), F.lit(False)).alias("whole"))
    held = held.select("key", "doc_id", "item_id", "b.*", "by_template", "whole")

    # slots: only for items that have any, and only in their candidates
    theirs = items.filter(F.exists("words", lambda w: w.isin(NUM, NAMED))).withColumn("len", F.least(F.size("words"), F.lit(window)))
    columns = ["doc_id", "item_id", "n_windows", "n_hits", "coverage"]
    if theirs.isEmpty():
        return one_row(held.select(*columns, F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_changed")))
    held = written(held)
    slotted = theirs.select("item_id")
    checked = held.filter("by_template").join(F.broadcast(slotted) if is_small(slotted) else slotted, "item_id", "left_semi").select("key", "item_id").distinct()
    texts = written(lookup_join(raw, checked.select("key").distinct(), ["key"], "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    met = occurs = None
    for reading, before in (("names", ANYWHERE), ("inside", INSIDE)):
        item_side = theirs.filter(F.col("reading") == reading).select("item_id", "len", F.col("words").alias("item_words"), slots(F.col("text"), before).alias("item_slots"))
        pairs = checked.join(item_side, "item_id").join(texts.select("key", template(F.col("text"), before).alias("words"), slots(F.col("text"), before).alias("doc_slots")), "key")
        for n in sorted({n for kind, n in kinds if kind == reading}):
            mine = pairs.filter(F.col("len") == n)
            left = windows_of(mine, "words", n, "key", "item_id").withColumnRenamed("at", "doc_at")
            right = windows_of(mine, "item_words", n, "key", "item_id", "item_words").withColumnsRenamed({"key": "k2", "item_id": "i2", "at": "item_at", "hash": "h2"})
            right = right.filter(solid(F.col("item_words"), F.col("item_at"), n)).drop("item_words")
            meet = left.join(right, (F.col("key") == F.col("k2")) & (F.col("item_id") == F.col("i2")) & (F.col("hash") == F.col("h2"))).withColumn("aligned", F.col("doc_at") - F.col("item_at"))
            here = meet.select("key", "item_id", "aligned", "hash")
            occurs = here if occurs is None else occurs.unionByName(here)
            # the texts come back once a pair, so that no window carries them through a shuffle
            full = meet.select("key", "item_id", "aligned", "doc_at", "item_at").join(mine, ["key", "item_id"])
            for kind, mark in (("n", NUM), ("p", NAMED)):
                ahead = lambda words, at: F.size(F.filter(F.slice(words, 1, at), lambda w: w == mark))  # noqa: E731, B023
                inside = F.size(F.filter(F.slice("words", F.col("doc_at") + 1, n), lambda w: w == mark))  # noqa: B023
                value = lambda held, words, at, k: F.lower(F.get(F.col(f"{held}.{kind}"), ahead(words, at) + k))  # noqa: E731, B023
                rows = full.filter(inside > 0).select("key", "item_id", "aligned", F.explode(F.sequence(F.lit(0), inside - 1)).alias("k"), "words", "doc_at", "doc_slots", "item_words", "item_at", "item_slots")
                rows = rows.select("key", "item_id", "aligned", F.concat(F.lit(kind), value("item_slots", "item_words", F.col("item_at"), F.col("k"))).alias("item_value"), F.concat(F.lit(kind), value("doc_slots", "words", F.col("doc_at"), F.col("k"))).alias("doc_value"))
                met = rows if met is None else met.unionByName(rows)
    met = written(met.distinct())
    counted = [F.countDistinct("item_value", "doc_value").alias("pairs"), F.countDistinct("item_value").alias("n_slots"), F.countDistinct(F.when(F.col("item_value") != F.col("doc_value"), F.col("item_value"))).alias("n_changed")]
    verdict = met.groupBy("key", "item_id").agg(*counted)
    # an occurrence: the windows at one distance between the places in the document and in the item
    n_windows = held.filter("by_template").select("key", "item_id", "n_windows").distinct()
    large = occurs.groupBy("key", "item_id", "aligned").agg(F.countDistinct("hash").alias("n")).join(n_windows, ["key", "item_id"]).filter(F.col("n") >= F.lit(coverage) * F.col("n_windows"))
    one = large.select("key", "item_id", "aligned").join(met.groupBy("key", "item_id", "aligned").agg(*counted), ["key", "item_id", "aligned"], "left")
    one = one.filter("pairs is null or pairs = n_slots").groupBy("key", "item_id").agg(F.min(F.coalesce("n_changed", F.lit(0))).alias("least"))
    out = held.join(verdict, ["key", "item_id"], "left").join(one, ["key", "item_id"], "left")
    out = out.filter("whole or not by_template or pairs is null or pairs = n_slots or least is not null")
    changed = F.when(F.col("whole") | ~F.col("by_template"), 0).otherwise(F.coalesce("least", "n_changed", F.lit(0)))
    return one_row(out.select(*columns, F.coalesce("n_slots", F.lit(0)).alias("n_slots"), changed.cast("long").alias("n_changed")))
