"""Edge vectors of the expressions and operators."""

import itertools
import zipfile

import pytest
from pyspark.sql import functions as F

from partloom.functions import exprs as X
from partloom.functions import features
from partloom.operators import merge, order, score, search, validate
from partloom.sources import tables, text, xml


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value,expected", [("16;32", None), ("nan", None), ("", None), (None, None), ("0", 0.0), (" 4 ", 4.0), ("16d", None), ("3F", None), ("1e3", 1000.0), (".5", 0.5), ("0x10", None)])
def test_number(spark, value, expected):
    assert one(spark, X.number(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize("value,expected", [("0x20", 32), ("(1U)", 1), ("abc", None), ("010", None), ("(0x10UL)", 16)])
def test_c_integer(spark, value, expected):
    assert one(spark, X.c_integer(F.lit(value))) == expected


@pytest.mark.parametrize("value,expected", [("64K", 65536), ("2 MB", 2097152), ("x", None)])
def test_memory_bytes(spark, value, expected):
    assert one(spark, X.memory_bytes(F.lit(value))) == expected


def test_roles_slugs_and_keys(spark):
    assert one(spark, X.summed_roles(F.lit("2*H+H"), "H")) == 3
    assert one(spark, X.slug(F.lit(" --- "))) == "unknown"
    assert one(spark, X.slug_plain(F.lit("A  b#c"))) == "a-b-c"
    assert one(spark, X.slug_each(F.lit("a. b"))) == "a--b"
    names = ["x10", "x2", "X1", "y"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(X.natural_key(F.col("n"))).collect()] == ["X1", "x2", "x10", "y"]
    assert one(spark, X.common_prefix_length(F.lit("STM32F1"), F.lit("stm32g"))) == 5
    assert one(spark, X.common_prefix_length(F.lit(""), F.lit("a"))) == 0


def test_scores(spark):
    assert one(spark, X.log_score(F.lit(0.0), 8, 800)) is None
    assert one(spark, X.log_score(F.lit(1e9), 8, 800)) == 100
    value, coverage = X.weighted_score([(F.lit(None).cast("double"), 60), (F.lit(50.0), 40)])
    assert one(spark, value) == 50 and one(spark, coverage) == 40
    value, coverage = X.weighted_score([(F.lit(None).cast("double"), 60)])
    assert one(spark, value) is None and one(spark, coverage) == 0


@pytest.mark.parametrize("labels,points", [("Neural unit", 100), ("CORDIC CRC", 75), ("DMA2D", 65), ("AES engine", 50), ("CRC", 30)])
def test_accelerators_score_by_their_kind(spark, labels, points):
    assert one(spark, score.accelerator_score(F.lit("unknown"), F.lit(labels))) == points


@pytest.mark.parametrize("pattern,value,hit", [("stm32*", "STM32F1", False), ("STM32*", "STM32F1", True), ("S[!A-M]*", "STM", True), ("S[A-M]*", "STM", False), ("a?c", "abc", True), ("a.c", "abc", False), ("[]]x", "]x", True), ("a[", "a[", True), ("a*", "a\n", True), ("a", "a\n", False)])
def test_globs(spark, pattern, value, hit):
    assert one(spark, F.call_function("rlike", F.lit(value), X.glob_regex(F.lit(pattern)))) == hit


def test_natural_order_of_long_numbers_and_accents(spark):
    names = ["a1234567890123", "a1234567890122", "a99", "a0100", "Ä1", "b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(X.natural_key(F.col("n"))).collect()] == ["Ä1", "a99", "a0100", "a1234567890122", "a1234567890123", "b"]


def test_sparse_leaves_blanks_and_empty_arrays_out(spark):
    columns = {"a": F.lit(""), "b": F.array().cast("array<string>"), "c": F.lit(0), "d": F.lit(None).cast("int"), "e": F.lit("x")}
    assert tables.sparse(spark.range(1), columns, "r").first().r == '{"c":0,"e":"x"}'


def test_a_csv_file_that_is_there_but_broken_is_no_empty_table(spark, tmp_path):
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).columns == ["a"]
    (tmp_path / "one.csv").write_text('a,b\n1,"x ""y"""\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "one.csv"), spans_lines=False).collect()] == [("1", 'x "y"')]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_csv(spark, str(tmp_path / "none.csv"), ["a"], missing_ok=False)


def test_selection_score_of_unknowns(spark):
    unknown = F.lit(None).cast("double")
    row = score.scores(spark.range(1), unknown, unknown, unknown, unknown, {"timer": unknown}, F.lit("no"), F.lit(None).cast("string")).first()
    assert (row.selection_index, row.score_coverage_percent, row.compute_score, row.accelerator_score) == (0, 15, None, 0)


def test_features(spark):
    cell = '[{"type":"CAN","name":"a","count":"0"},{"type":"can","name":"b","n":"2"},{"type":"SPI","name":"wdg x","count":"7","source_kind":"microchip_atdf"}]'
    df = spark.createDataFrame([(cell,)], "c string").select(features.decoded(F.col("c")).alias("f"))
    at = lambda c: df.select(c.alias("x")).first()["x"]
    f = F.col("f")
    assert at(features.count_of(f, ["CAN"])) == 2
    assert at(features.count_of(f, ["CAN", "SPI"])) == 7  # an exact source stands alone
    assert at(features.count_of(f, ["SPI"], exclude=["wdg"])) is None
    assert at(features.presence(f, ["CAN"])) == "yes" and at(features.presence(f, ["USB"])) == "unknown"
    assert spark.range(1).select(F.size(features.decoded(F.lit("not json"))).alias("n")).first().n == 0


def test_merge_unique_follows_a_plain_loop(spark):
    rows, plain = [], {}
    for key, values in enumerate(itertools.product([None, 1, 2], repeat=3)):
        for src, v in enumerate(values):
            if v is None:
                continue
            rows.append((f"k{key}", src, 0, v))
            held = plain.get(f"k{key}")
            if held is None:
                plain[f"k{key}"] = [v, src, 0]
            elif held[0] == v or held[1] == 0:
                held[:2] = [v, src]
            else:
                held[2] += 1
    df = spark.createDataFrame([*rows, ("", 0, 0, 9)], "k string, src int, pos int, v int")
    assert {r.k: [r.v, r.origin, r.collisions] for r in merge.merge_unique(df, "k", "src", "pos", "v").collect()} == plain


def test_replace_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, source string")
    new = spark.createDataFrame([(9, "b")], "id int, source string")
    once = merge.replace_source(rows, "source", "b", new)
    assert sorted(r.id for r in merge.replace_source(once, "source", "b", new).collect()) == [1, 3, 9]


def test_numbered_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = order.numbered(df, [F.col("v")]).collect()
    assert {r.v: r.rank for r in rows} == {v: v + 1 for v in range(1000)}


def test_compare_needs_two_known_and_different_values(spark):
    df = spark.createDataFrame([("a", 1, 5, None), ("b", 2, 5, 3)], "k string, x int, y int, z int")
    assert {(r.metric, r.k) for r in search.compare(df, "k", ["x", "y", "z"]).collect() if r.best} == {("x", "b")}


def test_require_and_loaded_fail(spark):
    with pytest.raises(Exception, match="too small"):
        validate.require(spark.range(3), F.col("id") > 1, "too small").collect()
    with pytest.raises(ValueError):
        tables.loaded(spark.range(3), 4)


def test_strict_numbers(spark):
    df = spark.createDataFrame([("a", "1.0"), ("b", "2"), ("c", ""), ("d", "-1")], "k string, v string")
    assert {r.key for r in validate.non_negative(df, "k", ["v"], "c", strict=True).collect()} == {"a", "d"}
    assert {r.key for r in validate.non_negative(df, "k", ["v"], "c").collect()} == {"d"}


def test_csv_keeps_quotes_and_blanks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c\nd'), ("2", None)], "id string, v string")
    tables.write_csv(df.coalesce(1), f"{tmp_path}/x", ["id", "v", "w"])
    assert sorted(tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/x").collect()) == [("1", 'a "b", c\nd', ""), ("2", "", "")]
    assert tables.read_csv(spark, f"{tmp_path}/none", ["a"]).count() == 0
    with pytest.raises(Exception):
        tables.read_csv(spark, f"{tmp_path}/none", missing_ok=False)


def test_wrapped_json_rejects_another_shape(spark):
    with pytest.raises(Exception, match="unexpected wrapper"):
        spark.range(1).select(tables.wrapped_json(F.lit("var x"), "w=", ";", "struct<a int>")).collect()


def test_inheritance(spark):
    from partloom.plans.ingest import FAMILY_XML

    leaves = xml.device_leaves(spark.createDataFrame([(FAMILY_XML,)], "xml string"))
    got = {(r.leaf, r.attribute): r.value for r in xml.inherited(leaves, "processor", xml.PROCESSOR, F.col("x._Pname")).collect()}
    assert got[("D1A", "Dclock")] == "120" and got[("D1A", "Dfpu")] == "1" and ("D1B", "Dfpu") not in got and got[("D2", "Dclock")] == "100"
    sizes = {r.leaf: r.value for r in xml.inherited(leaves, "memory", xml.MEMORY, F.col("x._id")).collect() if r.attribute == "size"}
    assert sizes == {"D1A": "0x200", "D1B": "0x200", "D2": "0x100"}


def test_peripherals_and_devices(spark):
    rules = [("^(USART|UART)", "uart"), ("^TIM", "timer")]
    df = spark.createDataFrame([("<peripheral><name>UART%s</name><dim>3</dim></peripheral>",), ("<peripheral><name>USART1</name></peripheral>",), ("<peripheral><name>GPIO</name></peripheral>",)], "xml string")
    assert {(r.type, r.n) for r in xml.peripheral_counts(df, rules).collect()} == {("uart", 4)}
    atdf = '<device name="D"><address-spaces><address-space name="p"><memory-segment name="f" type="flash" size="0x100"/><memory-segment name="g" type="flash" size="0x80"/><memory-segment name="r" type="ram" size="16"/><memory-segment name="e" type="ram" size="99" external="true"/></address-space></address-spaces><modules><module name="TIMER"><instance name="TIM1"/><instance name="TIM2"/></module></modules></device>'
    df = spark.createDataFrame([(atdf,)], "xml string")
    row = xml.device_memory(df).first()
    assert (row.flash_bytes, row.ram_bytes) == (256, 16)
    assert [(r.type, r.n) for r in xml.device_modules(df, rules).collect()] == [("timer", 2)]
    mcu = '<Mcu RefName="M"><IP Name="U" InstanceName="U1"/><IP Name="U" InstanceName="U2"/><Pin Name="A" Type="I/O"/><Pin Name="V" Type="Power"/></Mcu>'
    row = xml.device_pins(spark.createDataFrame([(mcu,)], "xml string")).first()
    assert (row.n_pins, row.n_io, row.n_ips) == (2, 1, 2)
    index = '<index><pindex><pdsc vendor="V" name="A_DFP" version="1" url="u"/><pdsc vendor="V" name="B" version="1" url="u"/></pindex></index>'
    assert [r.name for r in xml.pack_index(spark.createDataFrame([(index,)], "xml string"), "_dfp").collect()] == ["A_DFP"]


def test_header_aliases(spark):
    header = "#define USART1 ((T_Type *) A_BASE)\n#define UART1 ((T_Type *) A_BASE)\n#define SPI1 ((T_Type *) B_BASE)\n"
    assert one(spark, text.instances_by_base(F.lit(header))) == ["USART1", "SPI1"]


def test_archive_siblings(spark, tmp_path):
    path = f"{tmp_path}/a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name in ("d/x/studio_5.0/view.xml", "d/x/base/view.xml", "d/y/studio_5.0/view.xml"):
            z.writestr(name, "<a/>")
    found = text.members(spark.read.format("binaryFile").load(path), [".xml"])
    assert {(r.dir, r.error) for r in text.siblings(found, "/studio_5.0/view.xml", "/base/view.xml").collect()} == {("d/x", None), ("d/y", "no sibling")}


def test_a_capability_record_reads_each_feature_once(spark):
    from partloom.operators import capability
    from partloom.plans.enrich import RULE_FIELDS

    features = [{"type": "Timer", "name": "watchdog timer", "count": "1"}, {"type": "SPI", "count": "3"}, {"type": "spi", "count": "5", "source_kind": "microchip_atdf"}, {"type": "CAN", "name": "CAN FD", "n": "2"}, {"type": "RTC", "count": "0"}, None]
    schema = "device_id int, manufacturer string, device_name string, product_line string, series string, processors array<map<string,string>>, features array<map<string,string>>, max_clock_hz double, source_id string, verification_status string"
    devices = spark.createDataFrame([(n, "v", "d", "l", "s", [], fs, None, "s", "") for n, fs in enumerate((features, []))], schema)
    found = capability.records(devices, spark.createDataFrame([], ", ".join(f"{c} string" for c in RULE_FIELDS)))
    full, bare = found.orderBy("device_id").collect()
    assert (full.timer_count, full.watchdog_count, full.spi_count, full.can_count, full.can_fd_present, full.rtc_present, full.adc_quantity_semantics) == (None, 1, 5, 2, "yes", "no", "unknown")
    assert full.peripheral_inventory_json.count('"category"') == 4 and full.accelerators_json == "[]" and bare.rtc_present == "unknown"
    spark.conf.set("spark.sql.debug.maxToStringFields", 2000)
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("inf(inity)?") < 12  # the form of a number, in counts of features and of processors


def test_what_was_written_can_be_cleared(spark):
    from pathlib import Path

    from partloom import session

    held = session.written(spark.range(3))
    path = Path(held.inputFiles()[0].removeprefix("file://")).parent
    assert held.count() == 3 and path.exists() and session.clear_written(spark) > 0 and not path.exists() and session.clear_written(spark) == 0
