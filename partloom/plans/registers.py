"""Register descriptions written from the parts' table: references between peripherals, and features by kind."""

from pyspark.sql import functions as F

from partloom.sources import xml

from .catalog import query

#: Peripheral j of a file: its element; a chain of four references (broken in some files), a circle, and a name that no one has.
#: `TIM%s` is no kind by the rules, which see names as written.
ELEMENTS = [
    "concat('<peripheral><name>TIM%s</name><dim>', file % 3 + 1, '</dim></peripheral>')",
    "concat('<peripheral derivedFrom=\"', if(file % 7 = 3, 'GONE', 'TIM%s'), '\"><name>SPI%s</name></peripheral>')",
    "'<peripheral derivedFrom=\"SPI%s\"><name>I2C%s</name></peripheral>'",
    "'<peripheral derivedFrom=\"I2C%s\"><name>CAN%s</name><dim>0x2</dim><dimIndex>A, B</dimIndex></peripheral>'",
    "'<peripheral derivedFrom=\"CAN%s\"><name>QSPI[%s]</name></peripheral>'",
    "'<peripheral derivedFrom=\"ADC2\"><name>ADC1</name></peripheral>'",
    "'<peripheral derivedFrom=\"ADC1\"><name>ADC2</name><dim>4</dim></peripheral>'",
    "'<peripheral derivedFrom=\"NOPE\"><name>DAC1</name></peripheral>'",
]


def _files(t):
    rows = t.part.selectExpr("p_partkey div 16 AS file", "cast(p_partkey % 16 AS int) AS j")
    element = F.expr("CASE j " + " ".join(f"WHEN {j} THEN {e}" for j, e in enumerate(ELEMENTS)) + " ELSE concat('<peripheral><name>UART', j, '</name></peripheral>') END")
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", element.alias("x")))), lambda p: p["x"]), "")
    return rows.groupBy("file").agg(F.concat(F.lit("<device><peripherals>"), held, F.lit("</peripherals></device>")).alias("xml"))


_ROWS = """
WITH p AS (SELECT p_partkey // 16 AS file, CAST(p_partkey % 16 AS INTEGER) AS j FROM part),
d AS (
  SELECT file, j,
         CASE WHEN j < 8 THEN ['TIM%s', 'SPI%s', 'I2C%s', 'CAN%s', 'QSPI[%s]', 'ADC1', 'ADC2', 'DAC1'][j + 1] ELSE 'UART' || j END AS name,
         CASE WHEN j = 0 OR (j <= 2 AND file % 7 <> 3) THEN '' || (file % 3 + 1) WHEN j IN (3, 4) THEN '0x2' WHEN j = 6 THEN '4' END AS dim,
         CASE WHEN j IN (3, 4) THEN 'A, B' END AS dim_index,
         CASE WHEN j BETWEEN 1 AND 4 AND file % 7 = 3 THEN 'unknown reference' WHEN j IN (5, 6) THEN 'circular reference' WHEN j = 7 THEN 'unknown reference' END AS error
  FROM p)
"""


@query(_ROWS + "SELECT file, name, dim, dim_index, error FROM d")
def register_references(t):
    """What each peripheral has once its references are followed, circles and unknown names told."""
    rows = xml.derived(xml.register_peripherals(_files(t), "file"), "file", ["group_name", "dim", "dim_index"])
    return rows.select("file", "name", "dim", "dim_index", "error")


@query(
    _ROWS
    + """
, i AS (
  SELECT file, j, CASE WHEN j IN (1, 4) THEN 'SPI' WHEN j = 2 THEN 'I2C' WHEN j = 3 THEN 'CAN' WHEN j IN (5, 6) THEN 'ADCUnits' WHEN j = 7 THEN 'DAC' ELSE 'UART' END AS type,
         unnest(CASE WHEN j <= 2 THEN list_transform(range(0, coalesce(TRY_CAST(dim AS INTEGER), 1)), lambda x: replace(name, '%s', '' || x)) WHEN j IN (3, 4) THEN [replace(name, '%s', 'A'), replace(name, '%s', 'B')] ELSE [name] END) AS instance
  FROM d WHERE j > 0)
SELECT file, type, count(*) AS n, string_agg(instance, ', ' ORDER BY CASE WHEN j = 4 THEN 0 ELSE j END, instance) AS instances FROM i GROUP BY file, type"""
)
def register_features(t):
    """Instances of each kind in register descriptions, dimensions inherited by reference."""
    rows = xml.derived(xml.register_peripherals(_files(t), "file"), "file", ["group_name", "dim", "dim_index"])
    return xml.register_features(rows, "file")
