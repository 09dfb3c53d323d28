"""Archives as a Spark source: zip and tar members as rows, planned by archive or by runs of members, and written back.

`spark.read.format("archive_members")` lists a folder (any file system that Arrow opens), plans a partition for each run
of small archives, for each run of members of a large zip (its directory says where they are), and for each large tar,
which is read as a stream: a task holds a batch of members at a time, never an archive.

Defined results: members come in the order of the archive; a file that is no archive, or an archive that breaks off,
gives what was read before and then a row with an error and no bytes; a member that cannot be read gives an error row of
its own; an empty or missing folder gives no rows.
"""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from partloom.session import ship

SCHEMA = "path string, member string, bytes binary, error string"
#: Bytes that one partition reads, about.
RUN_BYTES = 64 << 20
#: Runs of fewer bytes than these are made longer where there would be more of them: a partition costs more than it reads then.
MOST_RUNS = 512
#: Rows and bytes of the batches that a task hands over.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: What names of tars end in. They are not cut.
_STREAMS = (".tar", ".gz", ".tgz", ".bz2", ".tbz2", ".xz", ".txz")
_BROKEN = (tarfile.TarError, zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "member": pa.string(), "bytes": pa.binary(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds.values())], names=[*kinds])


class Run(InputPartition):
    """Archives, each with the numbers of its members from and to (to is None: all that follow)."""

    def __init__(self, parts: list[tuple[str, int, int | None]]):
        self.parts = parts


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.run_bytes = options["path"], int(options.get("runbytes") or RUN_BYTES)
        self.extensions = tuple(json.loads(options.get("extensions") or "[]"))

    def partitions(self) -> list[Run]:
        system, where = _opened(self.path)
        info = system.get_file_info(where)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where, allow_not_found=True, recursive=True))
        files = sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)
        together, cut = self._run_of(files), self._run_of([f for f in files if not f.path.lower().endswith(_STREAMS)])
        runs, small, held = [], [], 0
        for f in files:
            if f.size > cut and (cuts := self._cuts(system, f.path, cut)):
                runs += [Run([(f.path, a, b)]) for a, b in zip(cuts, cuts[1:])]
                continue
            if small and held + f.size > together:
                runs.append(Run(small))
                small, held = [], 0
            small, held = [*small, (f.path, 0, None)], held + f.size
        return runs + [Run(small)] if small or not runs else runs

    def _run_of(self, files: list[fs.FileInfo]) -> int:
        """Bytes of a run, such that runs of fewer bytes than RUN_BYTES are about MOST_RUNS at most."""
        return max(self.run_bytes, min(RUN_BYTES, sum(f.size for f in files) // MOST_RUNS))

    def _cuts(self, system: fs.FileSystem, path: str, run_bytes: int) -> list[int]:
        """Where runs of members begin, and the number of members; empty for what is no zip."""
        try:
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                cuts, held, members = [0], 0, z.infolist()
                for i, m in enumerate(members):
                    if held and held + m.compress_size > run_bytes:
                        cuts.append(i)
                        held = 0
                    held += m.compress_size
                return [*cuts, len(members)]
        except _BROKEN:
            return []

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[2] or b"")
            if len(rows) == BATCH_ROWS or held > BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, partition: Run) -> Iterator[tuple]:
        system = _opened(self.path)[0]
        for path, first, last in partition.parts:
            try:
                with system.open_input_file(path) as f:
                    magic = f.read(4)
                if magic[:2] == b"PK":
                    yield from self._zip(system, path, first, last)
                else:
                    yield from self._tar(system, path)
            except _BROKEN as e:
                yield path, None, None, f"{type(e).__name__}: not readable"

    def _wanted(self, name: str) -> bool:
        return not self.extensions or name.lower().endswith(self.extensions)

    def _zip(self, system: fs.FileSystem, path: str, first: int, last: int | None) -> Iterator[tuple]:
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            for m in z.infolist()[first:last]:
                if not m.is_dir() and self._wanted(m.filename):
                    try:
                        yield path, m.filename, z.read(m), None
                    except _BROKEN as e:
                        yield path, m.filename, None, f"{type(e).__name__}: not readable"

    def _tar(self, system: fs.FileSystem, path: str) -> Iterator[tuple]:
        with system.open_input_file(path) as f, tarfile.open(fileobj=f, mode="r|*") as t:
            for m in t:
                if m.isfile() and self._wanted(m.name):
                    yield path, m.name, t.extractfile(m).read(), None


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, extensions: list[str] | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(path, member, bytes, error) of the archives in a folder, members by extension (case aside)."""
    ship(spark)
    spark.dataSource.register(Archives)
    return spark.read.format("archive_members").option("path", path).option("extensions", json.dumps([e.lower() for e in extensions or []])).option("runbytes", str(run_bytes)).load()


def write_archives(members: DataFrame, folder: str) -> DataFrame:
    """(path, n): archives (archive, member, bytes) written into a folder, a zip or a tar.gz by their name; an archive is one file and so one task's work.

    A file is written beside its place and then moved there, so a task that is run again leaves the same file.
    """
    ship(members.sparkSession)

    def write(rows: pa.Table) -> pa.Table:
        system, where = _opened(folder)
        system.create_dir(where, recursive=True)
        name, held = rows["archive"][0].as_py(), io.BytesIO()
        each = sorted(zip(rows["member"].to_pylist(), rows["bytes"].to_pylist()), key=lambda m: m[0])
        if name.endswith(".zip"):
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                for member, content in each:
                    z.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
        else:
            with tarfile.open(fileobj=held, mode="w:gz", compresslevel=6) as t:
                for member, content in each:
                    info = tarfile.TarInfo(member)
                    info.size = len(content)
                    t.addfile(info, io.BytesIO(content))
        with system.open_output_stream(f"{where}/.{name}.part") as f:
            f.write(held.getvalue())
        system.move(f"{where}/.{name}.part", f"{where}/{name}")
        return pa.table({"path": [f"{where}/{name}"], "n": pa.array([rows.num_rows], pa.int64())})

    return members.select("archive", "member", "bytes").groupBy("archive").applyInArrow(write, "path string, n long")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of a start tag, references of XML decoded; blank without it."""
    value = F.regexp_extract(tag, rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    value = F.when(value != "", value).otherwise(F.regexp_extract(tag, rf"\s{name}\s*=\s*'([^']*)'", 1))
    for reference, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(reference), F.lit(mark))
    return value


def _tags(xml: Column, name: str) -> Column:
    """The start tags of an element anywhere in a document, comments aside."""
    return F.regexp_extract_all(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), F.lit(rf"""(?s)<(?:[\w.-]+:)?{name}(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))


def _last_of_name(pairs: Column) -> Column:
    """A map of (name, value) pairs in which the last of a name counts."""
    names = F.transform(pairs, lambda p: p["name"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["name"]))
    return F.map_from_entries(last)


def device_database(members: DataFrame) -> DataFrame:
    """Records of a device database in archives: of each `devices/<domain>/<family>/<part>/studio_5.0/view.xml`, seven segments deep, that is an mcu.

    (path, version, part_number, domain, database_family, source_path, base_path, parameters, capabilities, base, error):
    parameters and capabilities come from the view, base from the leaf elements of the sibling base/view.xml. A view that
    is not well-formed, or has no sibling, gives an error. version: the archive's version.dat.
    """
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    pieces = F.split("member", "/")
    # the check of the form reads the document as XML once; the tags are read as text, since they may stand at any depth
    broken = F.from_xml(F.col("xml"), "_corrupt_record string, x string", {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()
    fits = F.endswith("member", F.lit("/studio_5.0/view.xml")) & (F.size(pieces) == 7) & (F.get(pieces, 1) == "devices")
    views = members.filter(F.col("bytes").isNotNull() & fits).select("path", F.col("member").alias("source_path"), pieces.alias("p"), text.alias("xml"))
    attributes = lambda tags, *names: F.transform(tags, lambda t: F.struct(*[_attribute(t, n).alias(n) for n in names]))
    named = lambda tag: F.transform(_tags(F.col("xml"), tag), lambda t: _attribute(t, "name"))
    read = views.select("path", "source_path", "p", broken.alias("broken"), _last_of_name(attributes(_tags(F.col("xml"), "Param"), "name", "value")).alias("parameters"), named("type").alias("types"), F.array_sort(F.array_distinct(F.filter(named("DevCap"), lambda n: n != ""))).alias("capabilities"))
    number = F.try_element_at("parameters", F.lit("PartNumber"))
    kept = read.filter(F.col("broken") | ((F.coalesce(number, F.lit("")) != "") & F.array_contains("types", "mcu")))
    kept = kept.withColumn("base_path", F.concat(F.array_join(F.slice("p", 1, 5), "/"), F.lit("/base/view.xml")))
    leaf = lambda t: F.struct(F.regexp_extract(t, r"^<(?:[\w.-]+:)?([\w.-]+)", 1).alias("name"), F.regexp_replace(F.regexp_extract(t, r"(?s)>([^<]*)<", 1), r"^\s+|\s+$", "").alias("value"))
    leaves = F.regexp_extract_all(text, F.lit(r"(?s)<([\w.:-]+)(?:\s[^>]*)?>[^<]*</\1\s*>"), F.lit(0))
    bases = members.filter(F.col("bytes").isNotNull() & F.endswith("member", F.lit("/base/view.xml"))).groupBy("path", F.col("member").alias("base_path")).agg(F.first("bytes").alias("bytes"))
    bases = bases.select("path", "base_path", _last_of_name(F.transform(leaves, leaf)).alias("base"))
    versions = members.filter(F.col("bytes").isNotNull() & F.endswith("member", F.lit("/version.dat"))).groupBy("path").agg(F.regexp_replace(F.min(text), r"^\s+|\s+$", "").alias("version"))
    met = kept.join(bases, ["path", "base_path"], "left").join(versions, "path", "left")
    error = F.when(F.col("broken"), "not well-formed").when(F.col("base").isNull(), "missing exact part base/view.xml")
    good = lambda c: F.when(error.isNull(), c)
    return met.select("path", "version", good(number).alias("part_number"), F.get("p", 2).alias("domain"), F.get("p", 3).alias("database_family"), "source_path", "base_path", good(F.col("parameters")).alias("parameters"), good(F.col("capabilities")).alias("capabilities"), "base", error.alias("error"))


def write_files(rows: DataFrame, folder: str) -> int:
    """Write (name, text) rows as files of these names into a folder; the number of files. A task that runs again writes the same."""
    ship(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = _opened(folder)
        system.create_dir(where, recursive=True)
        for b in batches:
            for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist()):
                with system.open_output_stream(f"{where}/{name}") as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.select("name", "text").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
