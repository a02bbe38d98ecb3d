"""Queries of the passes that tick one of several options."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choices as C
from ..operators import lookup as L
from ..functions import text as T
from .base import query, table


def _sheet(spark, d, field: str, value: str):
    """A sheet with a row for each supplier."""
    raw = table(spark, d, "supplier").selectExpr("s_suppkey AS row_no", "'' AS Section", "CAST(NULL AS STRING) AS Page", f"{field} AS Field", "CAST(NULL AS STRING) AS Index", f"{value} AS Value", "'' AS Choices")
    return L.with_keys(L.clean(raw), T.normalize)


def _forms(spark, d):
    """Orders as forms, each about one of nine suppliers (k)."""
    return table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", "o_orderkey % 9 + 1 AS k")


def _row(rows, *texts: str, row: int = 0):
    """Cells of a table row of each form."""
    cells = ", ".join(f"CAST({i} AS BIGINT), {t}" for i, t in enumerate(texts))
    return rows.selectExpr("doc_id", "0L AS table_no", f"CAST({row} AS BIGINT) AS row_no", f"stack({len(texts)}, {cells}) AS (col_no, text)")


def _placed(offers):
    return offers.select("target.doc_id", "target.row", "target.col", F.col("value").alias("text"))


FORMS = "(SELECT o_orderkey AS doc_id, o_orderkey % 9 + 1 AS k FROM orders)"


@query(
    "option_groups",
    f"""SELECT doc_id, CAST(1 AS BIGINT) AS row, n AS col, CASE WHEN n = 2 AND yes THEN 'box ☒ ☐' WHEN n = 2 THEN 'box ☐ ☐' WHEN yes THEN '☒' ELSE '☐' END AS text
    FROM (SELECT doc_id, n, n = k % 5 AS yes FROM {FORMS}, (SELECT unnest([1, 2, 3])::BIGINT AS n) WHERE k % 5 <> 4)""".replace("box ", ""),
)
def option_groups(spark, d):
    """Three options in a row over three cells, of which the sheet names one, or none."""
    forms = _forms(spark, d)
    cells = _row(forms, "'which of the plans ' || k || ':'", "'Alpha a'", "'Beta b:'", "'Gamma c'").unionByName(_row(forms, "''", "''", "'☐ ☐'", "'12'", row=1))
    sheet = _sheet(spark, d, "'Which of the plans ' || s_suppkey", "CASE s_suppkey % 5 WHEN 0 THEN 'Delta' WHEN 1 THEN 'Alpha a' WHEN 2 THEN 'BETA b' WHEN 3 THEN ' gamma c ' ELSE '-' END")
    sheet = sheet.withColumn("Value", F.when(F.col("Value") == "-", "").otherwise(F.col("Value")))
    return _placed(C.option_groups(cells, sheet))


@query(
    "inline_groups",
    f"SELECT doc_id, CASE WHEN k % 3 = 0 THEN '☒' ELSE '☐' END || ' Alpha ' || k || '  ☐ Beta ' || k || '  ☐ Gamma ' || k AS text FROM {FORMS} WHERE k % 3 <> 2",
)
def inline_groups(spark, d):
    """Options of a line, of which the sheet answers one with yes or no, or with neither."""
    lines = _forms(spark, d).selectExpr("doc_id", "0L AS place", "0L AS row", "0L AS col", "'[ ] Alpha ' || k || '     Beta ' || k || ' OR Gamma ' || k AS text")
    sheet = _sheet(spark, d, "'Alpha ' || s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'maybe' END")
    return _placed(C.inline_groups(lines, sheet)).drop("row", "col")


@query(
    "two_column_boxes",
    f"""SELECT doc_id, CAST(0 AS BIGINT) AS row, CASE WHEN doc_id % 8 < 4 THEN 0 ELSE 1 END::BIGINT AS col, CASE doc_id % 4 WHEN 0 THEN CASE WHEN yes THEN '[x] here' ELSE '[ ] here' END WHEN 1 THEN CASE WHEN yes THEN 'a ☒' ELSE 'a ☐' END ELSE CASE WHEN yes THEN '☒' ELSE '☐' END END AS text
    FROM (SELECT *, k % 2 = 0 AS yes FROM {FORMS})""",
)
def two_column_boxes(spark, d):
    """A box, a filler or nothing, on either side of a sentence that the sheet answers."""
    box, says = "CASE doc_id % 4 WHEN 0 THEN '[ ] here' WHEN 1 THEN 'a ☑' WHEN 2 THEN '--' ELSE '' END", "'(a) the fund is a plan of number ' || k"
    forms = _forms(spark, d)
    cells = _row(forms.filter("doc_id % 8 < 4"), box, says).unionByName(_row(forms.filter("doc_id % 8 >= 4"), says, box))
    sheet = _sheet(spark, d, "'The fund is a plan of number ' || s_suppkey", "CASE s_suppkey % 2 WHEN 0 THEN 'Yes' ELSE 'no' END")
    return _placed(C.two_column_boxes(cells, sheet))


@query(
    "tick_similar",
    """SELECT o_orderkey AS line_no, CASE o_orderkey % 4 WHEN 0 THEN 'Fruit: □ Red apple  ☑ Green pear   □ Blue plum' WHEN 1 THEN 'Fruit: □ Red apple  □ Green pear   ☑ Blue plum' WHEN 2 THEN 'Fruit: ☑ Red apple  □ Green pear   □ Blue plum' ELSE 'Fruit: ☐ Red apple  ☑ Green pear   □ Blue plum' END AS text FROM orders""",
)
def tick_similar(spark, d):
    """The box whose option is most like a value by its words; other values leave the line."""
    lines = table(spark, d, "orders").selectExpr("o_orderkey AS line_no", "'Fruit: ☐ Red apple  ☑ Green pear   □ Blue plum' AS text", "CASE o_orderkey % 4 WHEN 0 THEN 'pear Green' WHEN 1 THEN 'Blue plums' WHEN 2 THEN 'Red apple' ELSE 'something else' END AS value")
    return C.tick_similar(lines.withColumn("text", F.when(F.col("value") == "something else", F.col("text")).otherwise(F.replace("text", F.lit("☐"), F.lit("□"))))).drop("value")
