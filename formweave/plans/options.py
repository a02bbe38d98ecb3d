"""Queries of the operators that split labels and tables into rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import options as P
from ..operators import scans
from .base import collapse, given, query, sql_of, table

CHOICES = "(SELECT c_custkey AS row_no, CASE WHEN c_custkey % 4 = 0 THEN 'Recipient ' || c_nationkey || ' notices' ELSE c_mktsegment END AS \"Section\", c_name AS \"Field\", CAST(c_custkey % 3 AS BIGINT) AS \"Index\", '' AS \"Choices\" FROM customer)"


def _choices(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey AS row_no", "CASE WHEN c_custkey % 4 = 0 THEN 'Recipient ' || c_nationkey || ' notices' ELSE c_mktsegment END AS Section", "c_name AS Field", "CAST(c_custkey % 3 AS BIGINT) AS Index", "'' AS Choices")


@query(
    "choice_explode",
    f"""SELECT row_no, "Section", x AS "Field", CASE WHEN row_no % 4 = 0 THEN CAST(regexp_extract("Section", '(\\d+)', 1) AS BIGINT) ELSE 1 END AS "Index", 'checkbox' AS "Choices"
    FROM (SELECT *, unnest(['Yes ' || row_no, 'No ' || row_no]) AS x FROM {CHOICES} WHERE row_no % 3 = 0) UNION ALL SELECT row_no, "Section", "Field", "Index", '' FROM {CHOICES} WHERE row_no % 3 <> 0""",
)
def choice_explode(spark, d):
    """A row for each choice of a field."""
    rows = _choices(spark, d).withColumn("options", F.when(F.col("row_no") % 3 == 0, F.array(F.concat(F.lit("Yes "), "row_no"), F.concat(F.lit("No "), "row_no"))))
    return P.choice_rows(rows)


LINE = "CASE p_partkey % 4 WHEN 0 THEN 'Alpha ' || p_size || ' ; Beta side;alpha ' || p_size WHEN 1 THEN p_brand || '  ' || p_type || ' OR Gamma' WHEN 2 THEN 'one; two:' ELSE p_name END"


@query(
    "inline_split",
    f"""SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN ['Alpha ' || p_size, 'Beta side'] WHEN 1 THEN [p_brand, p_type, 'Gamma'] WHEN 2 THEN ['one; two:'] ELSE [p_name] END) AS "Field" FROM part""",
)
def inline_split(spark, d):
    """Options that share a line."""
    return P.inline_rows(table(spark, d, "part").selectExpr("p_partkey", f"{LINE} AS Field"))


@query("compound_split", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Initial Subscription|Additional Subscription' WHEN 1 THEN 'Bank State|USA Branch Office' ELSE '' END AS parts FROM part")
def compound_split(spark, d):
    """Title words in pairs."""
    x = table(spark, d, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 'Initial Subscription  Additional Subscription' WHEN 1 THEN 'Bank State USA Branch Office' ELSE 'Not title case here' END AS x")
    return x.select("p_partkey", F.array_join(P.compound_options("x"), "|").alias("parts"))


@query("label_splits", "SELECT p_partkey, p_brand || '|' || p_type AS gap, p_brand || '|' || p_brand AS halves, 'Commitment (x)|Capital (y)' AS fused, 'Yes|No' AS glyphs, 'Yes,true|No,true' AS boxes FROM part")
def label_splits(spark, d):
    """Two labels on a line, fused options, glyphs, and labels with their boxes."""
    x = table(spark, d, "part")
    pair = F.concat("p_brand", F.lit("     "), "p_type")
    boxes = F.transform(P.label_boxes(F.lit("[ ] Yes [x] No")), lambda p: F.concat_ws(",", p["label"], p["box_first"].cast("string")))
    join = lambda c: F.array_join(c, "|")
    return x.select("p_partkey", join(P.two_labels(pair)).alias("gap"), join(P.two_labels(F.concat("p_brand", F.lit(" "), "p_brand"))).alias("halves"), join(P.fused_options(F.lit("Commitment (x) Capital (y)"))).alias("fused"), join(P.glyph_options(F.lit("Pick ☐ Yes ☐ No"))).alias("glyphs"), join(boxes).alias("boxes"))


@query(
    "group_split",
    """SELECT row_no, CASE WHEN row_no % 10 = 0 THEN x ELSE f END AS "Field" FROM (SELECT c_custkey AS row_no, c_name AS f, unnest(CASE WHEN c_custkey % 10 = 0 THEN ['Annual report', 'Tax form'] ELSE [''] END) AS x FROM customer)""",
)
def group_split(spark, d):
    """A field that names a group's options is replaced by them."""
    rows = table(spark, d, "customer").selectExpr("c_custkey AS row_no", "CASE WHEN c_custkey % 10 = 0 THEN 'Send: annual report, and tax form ' || c_custkey ELSE c_name END AS Field")
    groups = spark.createDataFrame([(["Annual report", "Tax form"],), (["Never there", "Nor this"],)], "labels array<string>")
    return P.group_rows(rows, groups)


@query(
    "context_block",
    """WITH l AS (SELECT doc_id, block_no AS line_no, CASE kind WHEN 'error' THEN 'Please tick one:' WHEN 'click' THEN '(a) first OR second' WHEN 'purchase' THEN repeat('long ', 41) ELSE '- ' || text END AS text FROM {stream} q),
    o AS (SELECT *, CASE WHEN text LIKE 'long%' THEN [] WHEN text LIKE '(a)%' THEN ['first', 'second'] WHEN text LIKE 'Please%' THEN ['Please tick one:'] ELSE [substr(text, 3)] END AS opts FROM l),
    j AS (SELECT t.doc_id, t.line_no, x.line_no AS option_line, x.opts, length(x.text) > 200 AS big, sum(len(x.opts)) OVER w AS upto FROM (SELECT doc_id, line_no FROM l WHERE text LIKE 'Please%') t JOIN o x ON x.doc_id = t.doc_id AND x.line_no > t.line_no WINDOW w AS (PARTITION BY t.doc_id, t.line_no ORDER BY x.line_no)),
    g AS (SELECT *, coalesce(bool_or(big AND upto > 0) OVER (PARTITION BY doc_id, line_no ORDER BY option_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ended FROM j WHERE upto - len(opts) < 6),
    u AS (SELECT doc_id, line_no, option_line, p, opts[p] AS option FROM (SELECT *, unnest(range(1, len(opts) + 1)) AS p FROM g WHERE NOT ended)),
    f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, line_no, lower(option) ORDER BY option_line, p) = 1)
    SELECT doc_id, line_no, option_line, option FROM f QUALIFY count(*) OVER (PARTITION BY doc_id, line_no) >= 2 AND row_number() OVER (PARTITION BY doc_id, line_no ORDER BY option_line, p) <= 6""",
)
def context_block(spark, d):
    """Options after ``please tick one``: bulleted ones, two on a line, and long lines between."""
    x = given(spark, d, "stream").selectExpr("doc_id", "block_no AS line_no", "CASE kind WHEN 'error' THEN 'Please tick one:' WHEN 'click' THEN '(a) first OR second' WHEN 'purchase' THEN repeat('long ', 41) ELSE '- ' || text END AS text")
    return P.context_options(x)


@query("append_missing", """SELECT row_no, "Field" FROM (SELECT c_custkey AS row_no, 'f' || c_nationkey AS "Field" FROM customer) UNION ALL SELECT 0, 'f' || n FROM range(40) t(n) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n)""")
def append_missing(spark, d):
    """Rows whose key no field has."""
    rows = table(spark, d, "customer").selectExpr("c_custkey AS row_no", "'f' || c_nationkey AS Field")
    return P.append_missing(rows, spark.range(40).selectExpr("CAST(0 AS BIGINT) AS row_no", "'f' || id AS Field"))


MATRIX = "(SELECT l_orderkey * 10 + l_linenumber AS row_no, CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS \"Section\", 'head ' || l_orderkey AS \"Field\", CAST(l_linenumber AS BIGINT) AS \"Index\" FROM lineitem)"


@query(
    "matrix_expand",
    f"""SELECT row_no, "Section", "Field", "Index" FROM {MATRIX} UNION ALL
    SELECT f.r, f.s, w."Field", w.i FROM (SELECT 'head ' || o_orderkey AS "Field", unnest(range(2, 2 + CAST(o_orderkey % 9 AS BIGINT))) AS i FROM orders) w
    JOIN (SELECT "Field", arg_min("Section", row_no) AS s, min(row_no) AS r FROM {MATRIX} GROUP BY 1) f USING ("Field")
    WHERE NOT EXISTS (SELECT 1 FROM {MATRIX} m WHERE m."Field" = w."Field" AND m."Index" = w.i)""",
)
def matrix_expand(spark, d):
    """Headers of tables get the row indexes that they lack."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS row_no", "CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS Section", "'head ' || l_orderkey AS Field", "CAST(l_linenumber AS BIGINT) AS Index")
    return P.matrix_rows(rows, table(spark, d, "orders").selectExpr("'head ' || o_orderkey AS Field", "o_orderkey % 9 + 1 AS n"))


@query("grid_unpivot", "SELECT b.doc_id, b.table_no, h.text AS field, b.row_no AS \"index\", b.text AS value FROM {cells} b JOIN {cells} h ON h.doc_id = b.doc_id AND h.table_no = b.table_no AND h.col_no = b.col_no AND h.row_no = 0 AND h.text <> '' WHERE b.row_no > 0")
def grid_unpivot(spark, d):
    """Cells of a table under its headers."""
    return P.grid_rows(given(spark, d, "cells"))


@query("measure_unpivot", "SELECT l_orderkey, l_linenumber, field, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME field VALUE value)")
def measure_unpivot(spark, d):
    """Columns as rows."""
    return table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "field", "value")


@query("pair_unpivot", "SELECT a.doc_id, a.table_no, a.row_no, a.text AS field, CASE WHEN a.text = '' THEN CAST(a.col_no / 2 AS BIGINT) + 1 ELSE CAST(regexp_extract(a.text, '(\\d+)', 1) AS BIGINT) END AS \"index\", b.text AS value FROM {cells} a JOIN {cells} b ON a.doc_id = b.doc_id AND a.table_no = b.table_no AND a.row_no = b.row_no AND b.col_no = a.col_no + 1 WHERE a.col_no % 2 = 0")
def pair_unpivot(spark, d):
    """Label and value cells side by side."""
    return P.pair_rows(given(spark, d, "cells"))


@query("placeholders", "SELECT c_custkey AS id, 'Dear ' || c_name || ', ' || n_name || ' and [[unknown]]' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def placeholders(spark, d):
    """Placeholders in text, of three forms; unknown ones stay."""
    texts = table(spark, d, "customer").selectExpr("c_custkey AS id", "'Dear {{Customer ' || c_custkey || '}}, ${nation ' || c_nationkey || '} and [[unknown]]' AS text")
    values = table(spark, d, "customer").selectExpr("'customer ' || c_custkey AS field_norm", "c_name AS value").unionByName(table(spark, d, "nation").selectExpr("'nation ' || n_nationkey AS field_norm", "n_name AS value"))
    return P.fill_placeholders(texts, values)


@query("samecell", "SELECT o_orderkey AS doc_id, CAST(0 AS BIGINT) AS cell_no, CASE o_orderkey % 3 WHEN 0 THEN 'Name ' || o_orderkey WHEN 1 THEN 'Date ' || o_orderkey ELSE 'Plain text' END AS label FROM orders")
def samecell(spark, d):
    """Labels of cells that hold label and blank."""
    x = table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", "CAST(0 AS BIGINT) AS cell_no", "posexplode(CASE o_orderkey % 3 WHEN 0 THEN array('Name ' || o_orderkey || ':', '______') WHEN 1 THEN array('', 'Date ' || o_orderkey || ': ____') ELSE array('--', 'Plain text') END) AS (par_no, text)")
    return P.samecell_labels(x)


RECIPIENTS = "(SELECT l_orderkey * 10 + l_linenumber AS row_no, CASE WHEN l_orderkey % 2 = 0 THEN 'Recipient ' || l_orderkey ELSE 'Other' END AS s, CAST(l_orderkey % 3 AS BIGINT) AS p, CASE WHEN l_linenumber = 1 THEN 'Name' ELSE 'option ' || l_linenumber END AS f, CAST(l_linenumber AS BIGINT) AS i FROM lineitem)"


@query(
    "recipient_collapse",
    f"""SELECT row_no, s AS "Section", p AS "Page", CASE WHEN o AND n >= 2 THEN s || ' – item ' || k ELSE f END AS "Field", CASE WHEN o AND n >= 2 THEN CAST(substr(s, 11) AS BIGINT) ELSE i END AS "Index", CASE WHEN o AND n >= 2 THEN 'checkbox' ELSE '' END AS "Choices"
    FROM (SELECT *, row_number() OVER (PARTITION BY s, p, o ORDER BY row_no) AS k, count(*) OVER (PARTITION BY s, p, o) AS n FROM (SELECT *, s LIKE 'Recipient%' AND f <> 'Name' AS o FROM {RECIPIENTS}))""",
)
def recipient_collapse(spark, d):
    """Short options of a recipient's section are numbered."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS row_no", "CASE WHEN l_orderkey % 2 = 0 THEN 'Recipient ' || l_orderkey ELSE 'Other' END AS Section", "CAST(l_orderkey % 3 AS BIGINT) AS Page", "CASE WHEN l_linenumber = 1 THEN 'Name' ELSE 'option ' || l_linenumber END AS Field", "CAST(l_linenumber AS BIGINT) AS Index", "'' AS Choices")
    return P.collapse_recipients(rows)


def _numbered(by):
    # a sheet is exported form by form: the order is that within a customer's rows
    return F.row_number().over(Window.partitionBy("part").orderBy(*P.export_keys(by))).cast("long").alias(f"by_{by}")


EXPORT = "(SELECT o_orderkey AS row_no, o_custkey AS part, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS BIGINT) END AS p, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS s, o_orderpriority AS f, CAST(o_orderkey % 5 AS BIGINT) AS i FROM orders)"


@query("export_sort", f"SELECT row_no, row_number() OVER (PARTITION BY part ORDER BY coalesce(p, 999999), s, f, i, row_no) AS by_page, row_number() OVER (PARTITION BY part ORDER BY coalesce(p, 999999), lower(s), lower(f), i, row_no) AS by_folded, row_number() OVER (PARTITION BY part ORDER BY s, f, i, coalesce(p, 999999), row_no) AS by_section FROM {EXPORT}")
def export_sort(spark, d):
    """The three orders of the exported sheet, as row numbers of each form."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS row_no", "o_custkey AS part", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS BIGINT) END AS Page", "CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS Section", "o_orderpriority AS Field", "CAST(o_orderkey % 5 AS BIGINT) AS Index")
    return rows.select("row_no", *[_numbered(by) for by in ("page", "folded", "section")])


@query(
    "row_matrix",
    """WITH b AS (SELECT *, max(CASE WHEN col_no = 0 THEN text END) OVER w AS l, count(*) FILTER (text = '' AND col_no > 0) OVER w AS n FROM {cells} q WHERE row_no > 0 WINDOW w AS (PARTITION BY doc_id, table_no, row_no))
    SELECT b.doc_id, b.table_no, b.row_no, CASE WHEN n >= 2 THEN h.text ELSE l END AS label, CASE WHEN n >= 2 THEN l ELSE '' END AS section FROM b JOIN (SELECT * FROM {cells} q WHERE row_no = 0 AND col_no > 0) h ON b.doc_id = h.doc_id AND b.table_no = h.table_no AND b.col_no = h.col_no WHERE b.text = '' AND b.col_no > 0""",
)
def row_matrix(spark, d):
    """Rows of checkboxes under a header."""
    return scans.row_matrix(given(spark, d, "cells"))


@query(
    "matrices",
    """WITH p AS MATERIALIZED (SELECT doc_id, table_no, row_no, count(*) FILTER (text <> '') AS labels, bool_and(text = '') AS blank FROM {cells} q GROUP BY 1, 2, 3)
    SELECT h.doc_id, h.table_no, h.row_no, count(*) AS n_rows FROM p h JOIN p r ON r.doc_id = h.doc_id AND r.table_no = h.table_no AND r.row_no > h.row_no
    WHERE h.labels >= 2 AND (SELECT count(*) FROM p x WHERE x.doc_id = h.doc_id AND x.table_no = h.table_no AND x.row_no > h.row_no AND x.row_no <= r.row_no AND x.blank) = r.row_no - h.row_no GROUP BY 1, 2, 3""",
)
def matrices(spark, d):
    """Tables under a row of short labels, with their blank rows."""
    return scans.matrices(given(spark, d, "cells"))
