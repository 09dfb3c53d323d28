"""Headers, pages, YAML-like and prose sources by regular expressions, and members of archives."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.session import ship


def macros(lines: DataFrame, line: str, number: str, prefix: str = "SOC_") -> DataFrame:
    """(name, value) of #define lines; comments are cut, a name alone is 1, the last definition wins."""
    bare = F.trim(F.regexp_replace(F.col(line), r"//.*$|/\*.*?\*/", ""))
    name = F.regexp_extract(bare, rf"^#\s*define\s+({prefix}\w+)", 1)
    value = F.trim(F.regexp_extract(bare, rf"^#\s*define\s+{prefix}\w+\s+(.*)$", 1))
    found = lines.select(name.alias("name"), F.when(value == "", "1").otherwise(value).alias("value"), number).filter("name <> ''")
    return found.groupBy("name").agg(F.max_by("value", number).alias("value"))


def instances_by_base(header: Column, prefer: str = "USART") -> Column:
    """Peripheral instances of a header, one for each base address; of aliases the preferred kind stays."""
    found = F.regexp_extract_all(header, F.lit(r"#define\s+([A-Z]+\d*)\s+\(\([A-Za-z_]+ \*\)\s*(\w+_BASE)"), F.lit(0))
    pairs = F.transform(found, lambda t: F.struct(F.regexp_extract(t, r"(\w+_BASE)$", 1).alias("base"), (~F.startswith(F.regexp_extract(t, r"#define\s+(\w+)", 1), F.lit(prefer))).alias("other"), F.regexp_extract(t, r"#define\s+(\w+)", 1).alias("name")))
    ordered = F.array_sort(pairs)
    firsts = F.filter(ordered, lambda p, i: (i == 0) | (F.get(ordered, i - 1)["base"] != p["base"]))
    return F.transform(firsts, lambda p: p["name"])


def timer_instances(header: Column) -> Column:
    """Hardware timers of a header: the length of the timer array times its distinct instances; 0 without either."""
    length = F.regexp_extract(header, r"hw_timer\s*\[(\d+)\]", 1).try_cast("int")
    return F.coalesce(length * F.size(F.array_distinct(F.regexp_extract_all(header, F.lit(r"extern\s+timg_dev_t\s+(TIMERG\d+)"), F.lit(1)))), F.lit(0))


def names_model(page: Column, model: Column) -> Column:
    """Whether a page names a model, case aside: what a static model must hold before it is taken."""
    return F.contains(F.upper(F.coalesce(page, F.lit(""))), F.upper(model))


def page_codes(html: Column, pattern: str) -> Column:
    """Distinct codes in a page, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))))


def yaml_scalar(text: Column, key: str) -> Column:
    """The value of `key: value`, without quotes; null without the key."""
    value = F.regexp_extract(text, rf"(?m)^\s*{key}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.btrim(value, F.lit("'\"")), F.lit(""))


def yaml_map(text: Column, key: str) -> Column:
    """The indented `name: value` lines under `key:`."""
    body = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*\n((?:[ \t]+\S.*\n?)+)", 1)
    pairs = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]+(\w+: *\S.*)$"), F.lit(1))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.trim(F.regexp_replace(p, r"^\w+: *", "")).alias("v"))))


def described_features(text: Column, kinds: list[str]) -> list[Column]:
    """Counts named in prose as `3 x UART` or `two UARTs`."""
    words = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
    out = []
    for k in kinds:
        n = F.regexp_extract(text, rf"(?i)\b(\d+|{'|'.join(words)}) *x? *{k}s?\b", 1)
        spelled = F.lit(None).cast("int")
        for w, v in words.items():
            spelled = F.when(F.lower(n) == w, v).otherwise(spelled)
        out.append(F.coalesce(n.try_cast("int"), spelled).alias(k.lower()))
    return out


def members(archives: DataFrame, extensions: list[str]) -> DataFrame:
    """(path, member, bytes) of zip and tar.gz archives (path, content), members by extension; a broken archive gives its error."""
    ship(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows: list[tuple] = []
                try:
                    if zipfile.is_zipfile(io.BytesIO(content)):
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            rows = [(n, z.read(n), None) for n in sorted(z.namelist()) if n.lower().endswith(tuple(extensions))]
                    else:
                        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                            rows = [(m.name, t.extractfile(m).read(), None) for m in sorted(t.getmembers(), key=lambda m: m.name) if m.isfile() and m.name.lower().endswith(tuple(extensions))]
                except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError) as e:
                    rows = [(None, None, f"{type(e).__name__}: not readable")]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.string())))], names=["path", "member", "bytes", "error"])

    return archives.select("path", "content").mapInArrow(read, "path string, member string, bytes binary, error string")


def siblings(found: DataFrame, left: str, right: str) -> DataFrame:
    """Members of one archive folder paired by the folder's parent: left file, and right file or an error."""
    parent = F.regexp_replace("member", r"/[^/]+/[^/]+$", "")
    a = found.filter(F.endswith("member", F.lit(left))).select("path", parent.alias("dir"), F.col("member").alias("left_member"))
    b = found.filter(F.endswith("member", F.lit(right))).select("path", parent.alias("dir"), F.col("member").alias("right_member"))
    return a.join(b, ["path", "dir"], "left").withColumn("error", F.when(F.col("right_member").isNull(), "no sibling"))
