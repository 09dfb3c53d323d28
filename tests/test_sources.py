"""Descriptions, register references, archives, overrides and product selectors: odd inputs, and plain versions of them."""

import fnmatch
import io
import random
import tarfile
import zipfile

from pyspark.sql import functions as F

from partloom.operators import overrides, products
from partloom.sources import archives, descriptions, tooldb, xml


def test_descriptions_of_odd_documents(spark):
    device = "<x><variants><variant ordercode='ATtiny1-A' pinout='p'/><variant/></variants><pinouts><pinout name='p'><pin pad='PZ1'/></pinout><pinout name='p'><pin pad='pa1'/><pin/></pinout></pinouts><devices><device name='ATtiny1'/></devices></x>"
    rows = [(1, None), (2, ""), (3, "<a>"), (4, "<x><devices/></x>"), (5, "<x><devices><device/></devices></x>"), (6, "<x><devices><device name='ATA1'/></devices></x>"), (7, device), (7, device)]
    files = spark.createDataFrame(rows, "id int, xml string").withColumn("features", F.lit("own")).drop("features")
    got = descriptions.avr_records(files).orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 3, 4, 5, 6, 7, 7]
    assert all(r.error == "no devices/device name" and r.features is None and r.parts is None for r in got[:5])
    bare, full, again = got[5:]
    assert (bare.device_name, bare.architecture, bare.flash_bytes, bare.pin_counts, bare.parts) == ("ATA1", "AVR8", None, [], [])
    assert all(f["count"] == "0" for f in bare.features) and len(bare.features) == 16
    counts = {f["type"]: f["count"] for f in full.features}
    assert full == again and counts["IOs"] == "1" and full.pin_counts == [2] and [p.part_number for p in full.parts] == ["ATtiny1-A"]
    assert [r.error for r in descriptions.sam_records(files).orderBy("id").collect()] == ["no devices/device name"] * 5 + [None] * 3
    assert descriptions.avr_records(files.limit(0)).count() == 0


def test_a_patch_keeps_order_and_drops_kinds(spark):
    row = spark.range(1).select(F.expr("array(named_struct('type', 'A', 'n', 1), named_struct('type', null, 'n', 2), named_struct('type', 'B', 'n', 3))").alias("f"))
    new = F.struct(F.lit("C").alias("type"), F.lit(4).alias("n"))
    assert [x.n for x in row.select(descriptions.patched(F.col("f"), ["A", "X"], [new]).alias("f")).first().f] == [2, 3, 4]


def test_references_follow_a_plain_loop(spark):
    rnd = random.Random(3)
    rows = []
    for doc in range(8):
        n = rnd.choice((1, 2, 9, 40))
        for at in range(n):
            chain = f"p{at - 1}" if doc == 0 and at else rnd.choice((None, None, f"p{rnd.randrange(n)}", "gone"))
            rows.append((doc, at, f"p{at}" if rnd.random() < 0.95 else "p0", chain, rnd.choice((None, None, str(rnd.randrange(9))))))
    first = {}
    for r in rows:
        first.setdefault((r[0], r[2]), r)

    def plain(r):
        value, seen, at = r[4], set(), r
        while at[3] is not None:
            at = first.get((r[0], at[3]))
            if at is None:
                return value, "unknown reference"
            if at[1] in seen:
                return r[4], "circular reference"
            seen.add(at[1])
            value = value or at[4]
        return value, None

    got = xml.derived(spark.createDataFrame(rows, "doc int, at int, name string, ref string, value string"), "doc", ["value"]).collect()
    assert sorted((r.doc, r.at, r.value or "", r.error or "") for r in got) == sorted((r[0], r[1], plain(r)[0] or "", plain(r)[1] or "") for r in rows)
    assert xml.derived(spark.createDataFrame([], "doc int, at int, name string, ref string, value string"), "doc", ["value"]).count() == 0


def test_dimensions_of_registers(spark):
    each = "<name>{}</name><groupName>g</groupName><dim>{}</dim><dimIndex>{}</dimIndex>"
    body = "".join(f"<peripheral>{each.format(*p)}</peripheral>" for p in (("UART%s", "3", "1-3"), ("SPI%d", "2", "A,B"), ("CAN%s", "2", "A,B,C"), ("ADC", "x", ""), ("", "1", ""), ("odd", "1", "")))
    rows = spark.createDataFrame([(1, f"<device><peripherals>{body}</peripherals></device>"), (2, None), (3, "<device/>")], "file int, xml string")
    got = xml.register_features(xml.derived(xml.register_peripherals(rows, "file"), "file", ["group_name", "dim", "dim_index"]), "file").collect()
    assert sorted((r.type, r.n, r.instances) for r in got) == [("ADCUnits", 1, "ADC"), ("CAN", 2, "CAN0, CAN1"), ("SPI", 2, "SPIA, SPIB"), ("UART", 3, "UART1, UART2, UART3")]


def tarred(names):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w:gz") as t:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = 50_000
            t.addfile(info, io.BytesIO(random.Random(n).randbytes(50_000)))
    return held.getvalue()


def test_archives_that_break_off(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(10):
            z.writestr(f"d/{i}.XML", f"<x{i}/>")
        z.writestr("d/readme.txt", "no")
    broken = bytearray((tmp_path / "a.zip").read_bytes())
    at = broken.index(b"<x3/>")
    broken[at : at + 5] = b"<y3/>"  # its checksum fails
    (tmp_path / "b.zip").write_bytes(broken)
    whole = tarred([f"t/{i}.xml" for i in range(6)])
    (tmp_path / "c.tar.gz").write_bytes(whole)
    (tmp_path / "d.tar.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "e.zip").write_bytes(b"")
    (tmp_path / "f.txt").write_bytes(b"nothing")
    read = archives.read_archives(spark, str(tmp_path), [".xml"], run_bytes=30)
    assert read.rdd.getNumPartitions() >= 6
    got = {}
    for r in read.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.member, None if r.bytes is None else bytes(r.bytes), r.error is not None))
    assert [(m, b) for m, b, _ in sorted(got["a.zip"])] == [(f"d/{i}.XML", f"<x{i}/>".encode()) for i in range(10)]
    assert [m for m, b, e in got["b.zip"] if e and b is None] == ["d/3.XML"] and len(got["b.zip"]) == 10
    assert [m for m, _, _ in got["c.tar.gz"]] == [f"t/{i}.xml" for i in range(6)] and not any(e for _, _, e in got["c.tar.gz"])
    half = got["d.tar.gz"]
    assert half[-1] == (None, None, True) and [m for m, _, e in half if not e] == [f"t/{i}.xml" for i in range(len(half) - 1)] and 1 < len(half) < 6
    assert got["e.zip"] == [(None, None, True)] and got["f.txt"] == [(None, None, True)]
    assert archives.read_archives(spark, str(tmp_path / "none")).count() == 0
    assert len(archives.read_archives(spark, str(tmp_path / "a.zip")).collect()) == 11


def test_many_small_archives_are_read_in_few_runs(tmp_path):
    for i in range(1500):
        if i % 3:
            with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
                for k in range(5):
                    z.writestr(f"d/{k}.xml", f"<x{k} of='{i}'/>")
        else:
            (tmp_path / f"{i}.tar").write_bytes(b"nothing")
    reader = archives.ArchiveReader({"path": str(tmp_path), "extensions": '[".xml"]', "runbytes": "30"})
    planned = reader.partitions()
    assert 400 < len(planned) < 1200  # 2,000 runs of 30 bytes and more, but longer ones are enough
    got = [r for p in planned for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted((r["path"].rsplit("/", 1)[1], r["member"]) for r in got if r["bytes"] is not None) == sorted((f"{i}.zip", f"d/{k}.xml") for i in range(1500) if i % 3 for k in range(5))
    assert sum(r["error"] is not None for r in got) == 500


def test_shards_beyond_a_thousand_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from partloom.plans.catalog import ORACLES, QUERIES

    spark.range(301_000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = QUERIES["shards_roundtrip"](spark, str(tmp_path)).toArrow()
    assert got.num_rows == 301_000
    columns = "p_partkey, p_name, shard"
    assert con.execute(f"SELECT count(*) FROM (SELECT {columns} FROM ({ORACLES['shards_roundtrip']}) EXCEPT ALL SELECT {columns} FROM got)").fetchone() == (0,)


def test_overrides_follow_every_rule_against_every_device(spark):
    rnd = random.Random(8)
    word = lambda lo, hi: "".join(rnd.choice("ab1]") for _ in range(rnd.randrange(lo, hi)))
    devices = [(i, word(0, 7), rnd.choice(("l1", "l2", None)), rnd.choice(("s1", "")), rnd.choice(("v", "w", None))) for i in range(150)] + [(150, None, "l1", "s1", "v"), (151, "aab", "l2", "s1", "w")] * 2
    patterns = ["*", "a*", "*b", "a*b", "?b*", "[ab]*", "*[!a]", "a", "*a*", "", "b?1", "*]", "[a", "aa*"]
    rules = [(k, v, o) for k in ("glob", "prefix", "line", "series", "other") for v in [*patterns, "l1", "s1"] for o in ("", "v", None)]
    df = spark.createDataFrame(devices, "id int, device_name string, product_line string, series string, manufacturer string").withColumn("way", F.lit("own")).withColumn("rule_n", F.lit(1)).drop("way")
    rule_df = spark.createDataFrame(rules, "kind string, value string, vendor string")
    got = sorted((r.id, r.rule.kind, r.rule.value, r.rule.vendor or "") for r in overrides.applied(df, rule_df).collect())

    def glob(name, pattern):
        return fnmatch.fnmatchcase(name, pattern)

    expected = []
    for i, name, line, series, vendor in devices:
        for kind, value, owner in rules:
            hit = {"glob": lambda: glob(name or "", value), "prefix": lambda: (name or "").startswith(value), "line": lambda: (line or "") == value, "series": lambda: (series or "") == value, "other": lambda: False}[kind]()
            if hit and (owner or "") in ("", vendor or ""):
                expected.append((i, kind, value, owner or ""))
    assert got == sorted(expected)
    assert overrides.applied(df, rule_df.limit(0)).count() == 0 and overrides.applied(df.limit(0), rule_df).count() == 0


def test_override_rules_are_broadcast_if_few_and_devices_never(spark, monkeypatch):
    named = F.concat(F.lit("n"), (F.col("id") % 50).cast("string"))
    devices = spark.range(1000).select("id", named.alias("device_name"), F.lit("l").alias("product_line"), F.lit("s").alias("series"), F.when(F.col("id") % 2 == 0, "v").alias("manufacturer"))
    rules = spark.createDataFrame([("glob", "n1*", ""), ("glob", "n*8", "v"), ("glob", "*", "v"), ("glob", "n?", None), ("prefix", "n4", "w"), ("line", "l", "")], "kind string, value string, vendor string")
    rows = lambda df: sorted((r.id, r.rule.kind, r.rule.value) for r in df.collect())
    few = overrides.applied(devices, rules)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan  # devices stand on the left
    monkeypatch.setattr(overrides, "BROADCAST_RULES", 0)
    many = overrides.applied(devices, rules)
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
    assert rows(few) == rows(many) and len(rows(few)) == 220 + 100 + 500 + 200 + 1000


def test_queries_of_override_rules_never_broadcast_parts(spark):
    from partloom.plans.catalog import QUERIES

    for name in ("filter_override_rules", "override_rules_of_table"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" in plan, name


def test_a_selector_with_odd_rows(spark):
    rows = [("x1", "2", "N/A"), ("", "2", "7"), (None, "2", "7"), ("x2", "NO", "7"), ("x3", "4 ports", "-"), ("x1", "2", "N/A")]
    raw = spark.createDataFrame(rows, "mpn string, uart string, gpio string").withColumn("kind", F.lit("own")).withColumn("body", F.lit(1))
    path = products.emitted(products.records(raw, "wireless_soc", F.lit(7)))
    of = lambda kind, schema: products.table_of(spark, path, kind, schema).collect()
    assert sorted(r.device_id for r in of("device", products.DEVICE)) == ["espressif::x1", "espressif::x1", "espressif::x3"]
    assert sorted((r.item, r.error) for r in of("error", products.ERROR)) == [("", "no part number"), ("", "no part number"), ("X2", "official_record_missing_positive_uart_count")]
    assert {(r.type, r.n) for r in of("feature", products.FEATURE)} == {("UART", "2"), ("UART", "4 ports")}
    assert {r.source_path for r in of("provenance", products.PROVENANCE)} == {"tableData[7].mpn", "tableData[7].uart", "tableData[7].gpio"}
    assert products.records(raw.limit(0), "x", F.lit(1)).count() == 0


def test_blocks_of_a_tool_database(spark):
    named = [("ADC", "ADC12", "ADCUnits"), ("", "lptim1", "Timer"), ("FREERTOS", "x", None), ("x", "usb_device", None), ("USB", "USB", "USBD"), ("USB", "USB_OTG_HS", "USBOTG"), ("ETH", "ETH2", "ETH"), ("NEW", "", "NEW"), ("", "own", "own"), ("", "", None), ("ADC", "ADC1X", "ADC")]
    df = spark.createDataFrame(named, "name string, instance string, kind string").withColumn("got", tooldb.classify_ip(F.col("name"), F.col("instance")))
    assert all(r.got == r.kind for r in df.collect())


def test_a_refresh_is_whole_or_absent(spark, tmp_path, monkeypatch):
    from partloom.streaming import refresh as R

    schema, target = "id long, source string", str(tmp_path / "t")
    of = lambda rows: spark.createDataFrame(rows, schema)
    now = lambda: sorted(((r.id, r.source) for r in R.latest(spark, target, schema).collect()), key=str)
    assert R.latest(spark, target, schema) is None and R.vacuum(spark, target) == 0
    first = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "x/y=z")]
    R.replace_sources(of(first), target, "source", 0)
    assert now() == sorted(first, key=str)
    with monkeypatch.context() as m:  # the driver dies before the commit
        m.setattr(R, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        try:
            R.replace_sources(of([(9, "a"), (9, None)]), target, "source", 1)
        except OSError:
            pass
    assert now() == sorted(first, key=str)
    R.replace_sources(of([(6, "a"), (7, None)]), target, "source", 1)
    second = [(6, "a"), (3, ""), (7, None), (5, "x/y=z")]
    assert now() == sorted(second, key=str)
    R.replace_sources(of([(8, "a")]), target, "source", 1)  # run again after its commit
    R.replace_sources(of([]), target, "source", 2)
    assert now() == sorted(second, key=str)
    R.replace_sources(of([(10, "")]), target, "source", 3)
    third = [(6, "a"), (10, ""), (7, None), (5, "x/y=z")]
    assert now() == sorted(third, key=str)
    assert R.vacuum(spark, target, keep=1) > 0 and now() == sorted(third, key=str)
    assert not (tmp_path / "t/manifest/version=0").exists() and (tmp_path / "t/data/_batch=0").exists()  # x/y=z lives there
    assert len(list((tmp_path / "t/data/_batch=0").glob("_key=*"))) == 1


def test_substrings_by_trigrams_are_those_of_a_scan(spark):
    from partloom.operators import substring

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abé ") for _ in range(rnd.randrange(0, 12))) for _ in range(200)] + [None, "", "ab", "aaaa", "a" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    held = substring.index(rows, "key", "text")
    for q in ("", " ", "a", "ab", "aab", "AAA", "é b", "bbbb", "abéa", "zzz"):
        expected = [i for i, t in enumerate(texts) if not q.strip() or (t is not None and q.strip().lower() in t)]
        assert sorted(r.key for r in substring.find(held, q).collect()) == expected, q


def test_pages_of_nothing_and_past_the_end(spark):
    from partloom.operators import paging

    held = paging.publish(spark.range(0), [F.col("id")])
    assert paging.page(held, 0, 5).count() == 0
    held = paging.publish(spark.range(7), [F.desc("id")])
    assert [(r.id, r.rank, r.remaining) for r in paging.page(held, 4, 5).orderBy("rank").collect()] == [(2, 5, 0), (1, 6, 0), (0, 7, 0)]
    assert paging.page(held, 9, 5).count() == 0
