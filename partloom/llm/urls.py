"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

An entry (of the rules or of the list) is a host and a path prefix. A rule fits a URL if the URL's host is the rule's
or a subdomain of it and the URL's path starts with the rule's. A listed entry fits in the same way, after both have
been made canonical: no user, port or dot at the end of the host, upper-case escapes, dot segments resolved.

1. A URL's host suffixes are tried against a blocked Bloom filter of the entries' hosts. Few pass; an exact hash join
   with the hosts leaves those that have entries, with the lengths of their paths.
2. Prefixes of those lengths, with their host, are tried against the filter of whole entries, and an exact hash join
   removes its false positives.

Distinct URLs are judged once. DataFrame functions only.

Defined results: a null URL, or one without "://", has an empty host and path, fits nothing and is allowed; repeated
rows are judged alike; of several fitting rules the longest (host and path) wins, then the longer host, then block
before allow; rules and entries without a host or path are ignored; columns of the input other than those added are
kept, whatever their names.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lookup_join, prepare, without

#: Bits of a block (one 64-bit word), bits set per key, and keys per block on average.
BLOCK_BITS, BITS_PER_KEY, KEYS_PER_BLOCK = 64, 4, 4
#: Blocks at most: 8 MiB of filter. A longer list fills it more and the exact join sees more false positives.
MOST_BLOCKS = 1 << 20


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    rest = F.when(F.instr(url, "://") > 0, _rest(url)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, _rest(url)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """The bits that a key sets within its block."""
    h = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("long")
    for k in range(BITS_PER_KEY):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(block, bits) rows of a blocked Bloom filter over a key column, and its number of blocks."""
    blocks = min(MOST_BLOCKS, max(1, ceil(keys.count() / KEYS_PER_BLOCK)))
    return keys.groupBy(_block(F.col(column), blocks).alias("block")).agg(F.bit_or(_mask(F.col(column))).alias("bits")), blocks


def canonical_host(host: Column) -> Column:
    """A host without user, port and dots at the end, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", ""))


def canonical_path(path: Column) -> Column:
    """A path with upper-case escapes and without dot segments; an empty one is /."""
    parts = F.split(path, "%", -1)
    raised = F.array_join(F.transform(parts, lambda x, i: F.when(i > 0, F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 30))).otherwise(x)), "%")
    whole = F.when(raised == "", "/").otherwise(raised)
    segments = F.split(whole, "/", -1)
    up = lambda held: F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda held, x: F.when(x == "..", up(held)).when(x == ".", held).otherwise(F.array_append(held, x)))
    last = F.element_at(segments, -1)
    made = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(F.contains(whole, F.lit("/.")), made).otherwise(whole)


def might_hold(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key a blocked Bloom filter of keys (key) may hold."""
    held, blocks = bloom(keys, "key")
    block, bits = free_name(rows, "block"), free_name(rows, "bits")
    mask = _mask(F.col(key))
    # the filter has at most MOST_BLOCKS rows, whatever the number of keys
    tried = rows.withColumn(block, _block(F.col(key), blocks)).join(F.broadcast(held.withColumnsRenamed({"block": block, "bits": bits})), block)
    return tried.filter(F.col(bits).bitwiseAND(mask) == mask).drop(block, bits)


def fitting(distinct: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, path, key) of the entries (host, path, key) that fit each of (host, path)."""
    hosts = entries.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))  # as many as its longest path has characters, at most
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    tried = might_hold(distinct.select("host", "path", F.explode(suffixes).alias("suffix")), "suffix", hosts.select(F.col("host").alias("key")))
    known = lookup_join(tried, hosts.withColumnRenamed("host", "suffix"), ["suffix"], "inner")
    lengths = F.filter("lengths", lambda n: n <= F.length("path"))
    keys = known.select("host", "path", "suffix", F.explode(lengths).alias("length")).select("host", "path", entry_key(F.col("suffix"), F.expr("substring(path, 1, length)")).alias("key"))
    return lookup_join(might_hold(keys, "key", entries.select("key")), entries.drop("host", "path"), ["key"], "inner")


def entry_key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(" "), path)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    rules: action (allow or block), host, path. listed: host, path of URLs to block. The longest fitting rule gives
    rule and verdict; where none fits, a listed entry blocks and anything else is allowed.
    """
    prepare(pages.sparkSession)
    address = F.col(f"`{url}`")
    host, path, row, best, on_list = (free_name(pages, x) for x in ("url_host", "url_path", "url_row", "url_best", "url_listed"))
    pages = pages.withColumn(host, host_of(address)).withColumn(path, path_of(address))
    pages = without(pages, "host", "path", "rule", "verdict").withColumnsRenamed({host: "host", path: "path"})
    given = lambda df: df.filter("host is not null and path is not null")
    # one row per rule: block before allow
    ruled = given(rules).select(F.lower("host").alias("host"), "path", "action").groupBy("host", "path").agg(F.max("action").alias("action")).withColumn("key", entry_key(F.col("host"), F.col("path")))
    entries = given(listed).select(canonical_host(F.col("host")).alias("host"), canonical_path(F.col("path")).alias("path")).distinct().withColumn("key", entry_key(F.col("host"), F.col("path")))

    distinct = pages.filter("host <> ''").select("host", "path").distinct()  # a hot URL is judged once
    order = F.struct(F.length("key").alias("n"), F.instr("key", " ").alias("h"), F.col("action").alias("a"), F.replace(F.col("key"), F.lit(" "), F.lit("")).alias("rule"))
    fits = fitting(distinct, ruled).groupBy("host", "path").agg(F.max(order).alias(best))
    plain = distinct.select("host", "path", canonical_host(F.col("host")).alias("plain_host"), canonical_path(F.col("path")).alias("plain_path"))
    hits = fitting(plain.select(F.col("plain_host").alias("host"), F.col("plain_path").alias("path")).distinct(), entries).select(F.col("host").alias("plain_host"), F.col("path").alias("plain_path")).distinct()
    hit = lookup_join(plain, hits, ["plain_host", "plain_path"], "inner").select("host", "path", F.lit(True).alias(on_list))
    judged = fits.join(hit, ["host", "path"], "full").select(F.struct("host", "path").alias(row), best, on_list)
    out = lookup_join(pages.withColumn(row, F.struct("host", "path")), judged, [row]).drop(row)
    return out.withColumn("rule", F.col(f"{best}.rule")).withColumn("verdict", F.coalesce(F.col(f"{best}.a"), F.when(F.col(on_list), "block"), F.lit("allow"))).drop(best, on_list)
