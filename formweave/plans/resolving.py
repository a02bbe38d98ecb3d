"""Queries of the resolvers, and the flagship fill plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import occurrence as O
from ..operators import resolve as R
from . import fill_plan, passes
from .base import given, query, sql_of, table


def _inputs(spark, d):
    return given(spark, d, "fields"), given(spark, d, "sheet")


def _sql(strict: bool, page: bool, section: bool, weights=(8, 6, 3)) -> str:
    """The resolver in SQL: preferences in order, then the best score."""
    hit_s, hit_p = "(f.section_norm = '' OR f.section_norm = l.section_norm)", "(f.page IS NULL OR coalesce(f.page = l.Page, FALSE))"
    s_ok = "hs" if section else "hs = ms"
    p_ok = "hp" if page else "hp = mp"
    i_ok = "(NOT ai OR coalesce(li = occ, FALSE))" if strict else "TRUE"
    return f"""SELECT field_no, row_no, value FROM (
    SELECT *, bool_or(li IS NOT NULL) OVER (PARTITION BY field_no) AS ai FROM (
    SELECT *, bool_or(hp) OVER (PARTITION BY field_no) AS mp FROM (
    SELECT *, bool_or(hs) OVER (PARTITION BY field_no) AS ms FROM (
    SELECT f.field_no, f.occ, l.row_no, l.Value AS value, l.Index AS li, {hit_s} AS hs, {hit_p} AS hp,
    CASE WHEN f.page = l.Page THEN {weights[0]} ELSE 0 END + CASE WHEN f.section_norm <> '' AND f.section_norm = l.section_norm THEN {weights[1]} ELSE 0 END + CASE WHEN f.occ = l.Index THEN {weights[2]} ELSE 0 END AS score
    FROM {sql_of('fields')} f JOIN {sql_of('sheet')} l ON f.label_norm = l.field_norm)) WHERE {s_ok}) WHERE {p_ok}) WHERE {i_ok}
    QUALIFY row_number() OVER (PARTITION BY field_no ORDER BY score DESC, row_no) = 1"""


@query("resolve_exact", _sql(True, False, False))
def resolve_exact(spark, d):
    """Exact labels, preferring section and page, strict on index."""
    return R.resolve(*_inputs(spark, d)).drop("rule")


@query("resolve_require", _sql(False, True, True))
def resolve_require(spark, d):
    """Section and page required."""
    return R.resolve(*_inputs(spark, d), strict_index=False, require_page=True, require_section=True).drop("rule")


@query("resolve_checkbox", _sql(True, False, False, (4, 5, 2)))
def resolve_checkbox(spark, d):
    """Checkboxes: exact labels and their own weights."""
    return R.resolve_checkbox(*_inputs(spark, d)).drop("rule")


@query("resolve_agent_exact", _sql(True, False, False, (3, 6, 0)))
def resolve_agent_exact(spark, d):
    """The document agent's weights, exact labels only."""
    return R.resolve_agent(*_inputs(spark, d), exact_only=True).drop("rule")


def _taken(fields: str, sheet: str, doc: str = "0") -> str:
    """Phase 1 in SQL, from fields (field_no, emit_no, page, section_norm, label_norm) and the
    sheet: row by row, the picked row and the index that each visit takes."""
    return f"""r AS (SELECT row_no, field_norm AS f, section_norm AS s, Page AS p, Index AS i, Value AS v FROM {sheet}),
    x AS (SELECT *, {doc} AS doc, section_norm AS sec, label_norm AS f FROM {fields}),
    c1 AS (SELECT x.*, r.row_no, r.s, r.p, r.i, (x.sec = '' OR r.s = x.sec) AS hs, (x.page IS NULL OR coalesce(r.p = x.page, FALSE)) AS hp FROM x JOIN r USING (f)),
    c2 AS (SELECT *, bool_or(hs) OVER (PARTITION BY field_no) AS ms FROM c1),
    c3 AS (SELECT *, bool_or(hp) OVER (PARTITION BY field_no) AS mp FROM c2 WHERE hs = ms),
    pick AS (SELECT *, CASE WHEN s <> '' THEN s ELSE sec END AS eff FROM c3 WHERE hp = mp
      QUALIFY row_number() OVER (PARTITION BY field_no ORDER BY CASE WHEN p = page THEN 8 ELSE 0 END + CASE WHEN sec <> '' AND s = sec THEN 6 ELSE 0 END + CASE WHEN i = 1 THEN 3 ELSE 0 END DESC, row_no) = 1),
    e AS (SELECT page, eff, f, list_sort(list(DISTINCT i)) AS known FROM (SELECT DISTINCT page, eff, f FROM pick) d JOIN (SELECT f, s, p, i FROM r WHERE i IS NOT NULL) q USING (f) WHERE (page IS NULL OR p = page) AND (eff = '' OR s = eff) GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc, page, eff, f ORDER BY emit_no) AS n FROM pick),
    a AS (SELECT k.*, CASE WHEN n <= coalesce(len(known), 0) THEN known[n] ELSE n - coalesce(len(known), 0) END AS idx FROM k LEFT JOIN e ON k.f = e.f AND k.eff = e.eff AND k.page IS NOT DISTINCT FROM e.page),
    m AS (SELECT a.field_no, a.page, a.eff, a.idx, r.row_no, r.v, r.i, r.p, r.s, (a.eff = '' OR r.s = a.eff) AS hs, (a.page IS NULL OR coalesce(r.p = a.page, FALSE)) AS hp FROM a JOIN r USING (f))"""


def _scope(page: bool, section: bool, strict: bool = True) -> str:
    """The best row of each field's candidates in ``m`` under these requirements."""
    hs, hp = "hs" if section else "hs = ms", "hp" if page else "hp = mp"
    index = "(NOT ai OR coalesce(i = idx, FALSE))" if strict else "TRUE"
    return f"""(SELECT field_no, row_no, v FROM (SELECT *, bool_or(i IS NOT NULL) OVER (PARTITION BY field_no) AS ai FROM (SELECT *, bool_or(hp) OVER (PARTITION BY field_no) AS mp FROM (SELECT *, bool_or(hs) OVER (PARTITION BY field_no) AS ms FROM m) WHERE {hs}) WHERE {hp}) WHERE {index}
    QUALIFY row_number() OVER (PARTITION BY field_no ORDER BY CASE WHEN p = page THEN 8 ELSE 0 END + CASE WHEN eff <> '' AND s = eff THEN 6 ELSE 0 END + CASE WHEN i = idx THEN 3 ELSE 0 END DESC, row_no) = 1)"""


VISITS = "(SELECT *, field_no AS emit_no FROM {fields} y)"


@query(
    "resolve_cascade",
    f"WITH {_taken(VISITS, '{sheet} z')} SELECT a.field_no, a.eff AS section_norm, a.idx, coalesce(t.row_no, u.row_no) AS row_no, coalesce(t.v, u.v) AS value, CAST(CASE WHEN t.row_no IS NULL THEN 2 ELSE 1 END AS BIGINT) AS phase FROM a LEFT JOIN {_scope(False, False)} t USING (field_no) LEFT JOIN {_scope(False, False, False)} u USING (field_no)",
)
def resolve_cascade(spark, d):
    """Widgets in two phases: the label's row and index, then the value by index or without."""
    fields, sheet = _inputs(spark, d)
    return R.resolve_phases(fields.withColumn("emit_no", F.col("field_no")), sheet)


@query(
    "resolve_levels",
    """SELECT field_no, arg_min(Value, k) AS value FROM (SELECT f.field_no, l.Value, CASE WHEN i = occ THEN 1 WHEN i BETWEEN 1 AND 4 THEN 2 + i ELSE 100 END AS place, row(CASE WHEN i = occ THEN 1 WHEN i BETWEEN 1 AND 4 THEN 2 + i ELSE 100 END, CASE WHEN l.section_norm = f.section_norm THEN 0 ELSE 1 END, CASE WHEN i = occ OR i BETWEEN 1 AND 4 THEN 0 ELSE i END, -l.row_no) AS k
    FROM {fields} f JOIN (SELECT *, CASE WHEN coalesce(Index, 0) = 0 THEN 1 ELSE Index END AS i FROM {sheet}) l ON f.label_norm = l.field_norm WHERE l.Value <> '') GROUP BY 1""",
)
def resolve_levels(spark, d):
    """The field's own index, then 1 to 4, by section, without, by label."""
    return R.resolve_levels(*_inputs(spark, d))


CONTACTS = "(SELECT field_no, label_norm, page, 'contact ' || (field_no % 5 + 1) AS section_norm, CAST(field_no % 5 + 1 AS BIGINT) AS contact, occ FROM {fields} x)"


@query(
    "resolve_contact",
    "SELECT field_no, row_no, value FROM (SELECT f.field_no, l.row_no, l.Value AS value, CASE WHEN coalesce(l.Index = f.occ, FALSE) THEN 0 WHEN coalesce(l.Index = f.contact, FALSE) THEN 1 WHEN l.Index = 1 THEN 2 WHEN l.Index IS NULL THEN 3 END AS k FROM " + CONTACTS + " f JOIN {sheet} l ON f.label_norm = l.field_norm WHERE l.Index IN (f.contact, f.occ)) WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field_no ORDER BY k, row_no) = 1",
)
def resolve_contact(spark, d):
    """Contact N: that index or the field's own."""
    fields, sheet = _inputs(spark, d)
    return R.resolve_contact(fields.withColumn("section_norm", F.concat(F.lit("contact "), F.col("field_no") % 5 + 1)), sheet)


# Every row of the sheet with a label of its own, or its neighbour's, and every other without an index.
OWN = "(SELECT row_no, 'account field ' || (row_no - CASE WHEN row_no % 7 = 0 THEN 1 ELSE 0 END) AS field_norm, CASE WHEN row_no % 2 = 0 THEN NULL ELSE Index END AS Index, Value FROM {sheet} q)"


@query("only_value", "SELECT field_no, row_no, value FROM {fields} f JOIN (SELECT field_norm, min(row_no) AS row_no, min(Value) AS value FROM " + OWN + " GROUP BY 1 HAVING count(*) = 1 AND max(Index) IS NULL) l ON f.label_norm = l.field_norm")
def only_value(spark, d):
    """Labels with a single row and no index."""
    fields, sheet = _inputs(spark, d)
    own = sheet.withColumns({"field_norm": F.expr("'account field ' || (row_no - CASE WHEN row_no % 7 = 0 THEN 1 ELSE 0 END)"), "Index": F.expr("CASE WHEN row_no % 2 = 0 THEN NULL ELSE Index END")})
    return R.only_value(fields, own)


@query(
    "resolve_structured",
    """SELECT f.field_no, coalesce(a.v, b.v, c.v) AS value, 'key' AS rule FROM {fields} f
    LEFT JOIN (SELECT section_norm AS s, field_norm, CASE WHEN coalesce(Index, 0) = 0 THEN 1 ELSE Index END AS i, arg_max(Value, row_no) AS v FROM {sheet} GROUP BY 1, 2, 3) a ON a.s = f.section_norm AND a.field_norm = f.label_norm AND a.i = f.occ
    LEFT JOIN (SELECT section_norm AS s, field_norm, CASE WHEN coalesce(Index, 0) = 0 THEN 1 ELSE Index END AS i, arg_max(Value, row_no) AS v FROM {sheet} GROUP BY 1, 2, 3) b ON b.s = f.section_norm AND b.field_norm = f.label_norm AND b.i = 1
    LEFT JOIN (SELECT field_norm, row_number() OVER (PARTITION BY field_norm ORDER BY row_no) AS i, nullif(Value, '') AS v FROM {sheet}) c ON c.field_norm = f.label_norm AND c.i = f.occ
    WHERE coalesce(a.v, b.v, c.v) IS NOT NULL""",
)
def resolve_structured(spark, d):
    """By section, label and occurrence, then the n-th row of the label."""
    return R.resolve_structured(*_inputs(spark, d), fuzzy=False)


# Fuzzy steps whose outcome can be said beforehand: a label is misspelt in one place, and of
# all names of the sheet its own is the nearest, since any other has another number.
@query(
    "resolve_structured_similar",
    """SELECT f.field_no, coalesce(a.v, b.v, c.v, s.v) AS value, CASE WHEN coalesce(a.v, b.v, c.v) IS NULL THEN 'similar' ELSE 'key' END AS rule FROM {fields} f
    LEFT JOIN (SELECT section_norm AS s, field_norm, CASE WHEN coalesce(Index, 0) = 0 THEN 1 ELSE Index END AS i, arg_max(Value, row_no) AS v FROM {sheet} GROUP BY 1, 2, 3) a ON a.s = f.section_norm AND a.field_norm = f.label_norm AND a.i = f.occ
    LEFT JOIN (SELECT section_norm AS s, field_norm, CASE WHEN coalesce(Index, 0) = 0 THEN 1 ELSE Index END AS i, arg_max(Value, row_no) AS v FROM {sheet} GROUP BY 1, 2, 3) b ON b.s = f.section_norm AND b.field_norm = f.label_norm AND b.i = 1
    LEFT JOIN (SELECT field_norm, row_number() OVER (PARTITION BY field_norm ORDER BY row_no) AS i, nullif(Value, '') AS v FROM {sheet}) c ON c.field_norm = f.label_norm AND c.i = f.occ
    LEFT JOIN (SELECT field_norm, arg_min(Value, row_no) AS v FROM {sheet} WHERE Value <> '' GROUP BY 1) s ON s.field_norm = f.label_norm
    WHERE coalesce(a.v, b.v, c.v, s.v) IS NOT NULL""",
)
def resolve_structured_similar(spark, d):
    """All steps: the keys, then the first value of the best label by token sets."""
    return R.resolve_structured(*_inputs(spark, d))


def _misspelt(spark, d, words: bool = False):
    """The inputs, each label misspelt; with ``words`` every third has its words in another
    order instead."""
    fields, sheet = _inputs(spark, d)
    number = F.substring_index("label_norm", " ", -1)
    typo = F.when(F.col("field_no") % 2 == 0, F.concat(F.lit("acount field "), number)).otherwise(F.concat(F.lit("account feild "), number))
    turned = F.when(F.col("field_no") % 3 == 0, F.concat(F.lit("field "), number, F.lit(" account"))).otherwise(typo)
    return fields.withColumn("label_norm", turned if words else typo), sheet


@query("resolve_fuzzy", f"SELECT *, 'fuzzy' AS rule FROM ({_sql(True, False, False)})")
def resolve_fuzzy(spark, d):
    """The most similar label where the sheet has no equal one."""
    return R.resolve(*_misspelt(spark, d), fuzzy=R.SIMILAR)


@query("resolve_agent", f"SELECT *, 'fuzzy' AS rule FROM ({_sql(True, False, False, (3, 6, 0))})")
def resolve_agent(spark, d):
    """Similar labels that share a significant word."""
    return R.resolve_agent(*_misspelt(spark, d))


@query(
    "resolve_token_sets",
    """SELECT f.label_norm, l.value FROM (SELECT DISTINCT CASE WHEN field_no % 3 = 0 THEN 'field ' || n || ' account' WHEN field_no % 2 = 0 THEN 'acount field ' || n ELSE 'account feild ' || n END AS label_norm, 'account field ' || n AS own
    FROM (SELECT field_no, split_part(label_norm, ' ', 3) AS n FROM {fields} x)) f JOIN (SELECT field_norm, arg_max(Value, row_no) AS value FROM {sheet} y GROUP BY 1) l ON l.field_norm = f.own""",
)
def resolve_token_sets(spark, d):
    """Labels whose words are those of the sheet in another order, or nearly."""
    fields, sheet = _misspelt(spark, d, words=True)
    return R.resolve_simple(fields.select("label_norm"), sheet)


TEMPLATE = "(SELECT *, field_no AS emit_no FROM {fields} y)"
TRIES = f"""CASE WHEN a.s <> '' AND a.p IS NOT NULL THEN 3 WHEN a.s <> '' THEN 2 ELSE 1 END AS has, b.row_no AS b_no, b.v AS b_v, s1.row_no AS s_no, s1.v AS s_v, p1.row_no AS p_no, p1.v AS p_v
    FROM a LEFT JOIN {_scope(True, True)} b USING (field_no) LEFT JOIN {_scope(False, True)} s1 USING (field_no) LEFT JOIN {_scope(True, False)} p1 USING (field_no)"""
FIRST = "CASE has WHEN 3 THEN coalesce(b_{0}, s_{0}, p_{0}) WHEN 2 THEN coalesce(s_{0}, p_{0}) ELSE coalesce(p_{0}, s_{0}) END"


def _template(spark, d):
    """Fields whose label is found by what stands before its colon."""
    fields = given(spark, d, "fields")
    label = F.concat(F.initcap("label_norm"), F.lit(": amount"))
    return fields.select("field_no", F.col("field_no").alias("emit_no"), "page", "section_norm", label.alias("label"), F.lit("").alias("label_short"), F.lit("").alias("placement"))


@query("resolve_keys", f"WITH {_taken(TEMPLATE, '{sheet} z')} SELECT field_no, page, section_norm, field_norm, idx, {FIRST.format('no')} AS row_no, {FIRST.format('v')} AS value, CAST(0 AS BIGINT) AS key_no, 'exact' AS match FROM (SELECT a.field_no, a.page, a.eff AS section_norm, a.f AS field_norm, a.idx, {TRIES})")
def resolve_keys(spark, d):
    """Several search keys of a field, and the two phases within the scope of its row."""
    return R.resolve_keys(_template(spark, d), given(spark, d, "sheet"), None).drop("scope")


@query("resolve_keys_similar", f"WITH {_taken(TEMPLATE, '{sheet} z')} SELECT field_no, page, section_norm, field_norm, idx, {FIRST.format('no')} AS row_no, {FIRST.format('v')} AS value, CAST(0 AS BIGINT) AS key_no, CASE WHEN field_no % 2 = 0 THEN 'similar' ELSE 'exact' END AS match FROM (SELECT a.field_no, a.page, a.eff AS section_norm, a.f AS field_norm, a.idx, {TRIES})")
def resolve_keys_similar(spark, d):
    """The same where a key that the sheet lacks goes by the most similar label."""
    fields = _template(spark, d).withColumn("label", F.replace("label", F.lit("Account"), F.when(F.col("field_no") % 2 == 0, "Acount").otherwise("Account")))
    return R.resolve_keys(fields, given(spark, d, "sheet")).drop("scope")


# What a form's owner writes in: names, answers, blanks; and the fields of fifteen forms.
FLAG_SHEET = """(SELECT c_custkey AS row_no, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(c_mktsegment) END AS section_norm, 'account field ' || c_custkey // 6 AS field_norm, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey % 4 AS BIGINT) END AS Page,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS BIGINT) END AS Index, CASE c_custkey % 4 WHEN 1 THEN 'Yes' WHEN 2 THEN 'no' ELSE c_name END AS Value FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0)"""
FLAG_FIELDS = """(SELECT o_orderkey AS field_no, o_orderkey AS emit_no, o_orderkey // 4000 AS doc_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS BIGINT) END AS page, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) END AS section_norm,
    'account field ' || o_custkey // 6 AS label_norm, o_orderkey % 5 = 0 AS is_box FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _flagship(spark, d):
    """A raw sheet and the fields of forms."""
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    raw = customer.selectExpr(
        "c_custkey AS row_no", "CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE '  ' || c_mktsegment END AS Section", "CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE c_nationkey % 4 || '.0' END AS Page",
        "'Account  Field ' || c_custkey div 6 || CASE WHEN c_custkey % 2 = 0 THEN ':' ELSE ' (optional)' END AS Field", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '#' || c_custkey % 4 END AS Index",
        "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'NaN' WHEN c_custkey % 4 = 1 THEN ' Yes' WHEN c_custkey % 4 = 2 THEN 'no' ELSE c_name END AS Value",
    )
    fields = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS field_no", "o_orderkey AS emit_no", "o_orderkey div 4000 AS doc_id", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS BIGINT) END AS page", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE c_mktsegment END AS section",
        "'Account Field ' || o_custkey div 6 || CASE WHEN o_orderkey % 2 = 0 THEN ': details' ELSE '' END AS label", "CASE WHEN o_orderkey % 5 = 0 THEN 'checkbox' ELSE 'start' END AS placement",
        "CAST(o_orderkey * 4 AS DOUBLE) AS x0", "0D AS y0", "CAST(o_orderkey * 4 + 3 AS DOUBLE) AS x1", "3D AS y1",
    )
    return raw, fields


FLAG_SQL = f"""WITH {_taken(FLAG_FIELDS, FLAG_SHEET, "doc_id")},
    t AS (SELECT a.*, {TRIES}), v AS (SELECT *, {FIRST.format('v')} AS val FROM t),
    w AS (SELECT *, CASE WHEN val IS NULL THEN 'no value' WHEN is_box AND val NOT IN ('Yes', 'no') THEN 'unclear' END AS why FROM v),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc, page, eff, f, idx, why IS NULL ORDER BY emit_no) AS nth FROM w)
    SELECT x.field_no, x.page, coalesce(o.eff, x.sec) AS section, x.f AS label, o.idx, CASE WHEN why IS NULL AND nth = 1 THEN val END AS value,
    CASE WHEN o.field_no IS NULL THEN 'no match' WHEN why IS NOT NULL THEN why WHEN nth > 1 THEN 'written before' ELSE 'written' END AS rule FROM x LEFT JOIN o USING (field_no)"""


@query("flagship_fill_plan", FLAG_SQL)
def flagship_fill_plan(spark, d):
    """From a raw sheet and field definitions to the fill plan: cleaning, search keys, the two
    phases with explicit indexes, answers of checkboxes, and writing once.  The scope in
    the rule is shortened to ``written``."""
    raw, fields = _flagship(spark, d)
    plan = fill_plan.fill_plan(raw, fields, None)
    return plan.withColumns({"label": F.regexp_replace("label", " details$", ""), "rule": F.when(F.col("value").isNotNull(), "written").otherwise(F.col("rule"))})


PLAIN_SHEET = "(SELECT c_custkey AS row_no, lower(c_mktsegment) AS section_norm, 'account field ' || c_custkey // 6 AS field_norm, CAST(NULL AS BIGINT) AS Page, CAST(c_custkey % 4 AS BIGINT) AS Index, c_name AS Value FROM customer)"
PLAIN_FIELDS = "(SELECT o_orderkey AS field_no, o_orderkey AS emit_no, o_orderkey // 4000 AS doc_id, CAST(NULL AS BIGINT) AS page, '' AS section_norm, 'account field ' || o_custkey // 6 AS label_norm FROM orders)"


@query(
    "fill_plan_similar",
    f"""WITH {_taken(PLAIN_FIELDS, PLAIN_SHEET, "doc_id")}, v AS (SELECT *, {FIRST.format('v')} AS val FROM (SELECT a.*, {TRIES})),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc, eff, f, idx, val IS NULL ORDER BY emit_no) AS nth FROM v)
    SELECT field_no, page, eff AS section, f AS label, idx, CASE WHEN nth = 1 THEN val END AS value, CASE WHEN val IS NULL THEN 'no value' WHEN nth > 1 THEN 'written before' WHEN field_no % 2 = 0 THEN 'similar' ELSE 'exact' END AS rule FROM o""",
)
def fill_plan_similar(spark, d):
    """The plan where every other label is misspelt; of a rule that wrote, the match."""
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    raw = customer.selectExpr("c_custkey AS row_no", "c_mktsegment AS Section", "CAST(NULL AS STRING) AS Page", "'Account Field ' || c_custkey div 6 AS Field", "CAST(c_custkey % 4 AS STRING) AS Index", "c_name AS Value")
    fields = orders.selectExpr("o_orderkey AS field_no", "o_orderkey div 4000 AS doc_id", "'' AS section", "CASE WHEN o_orderkey % 2 = 0 THEN 'Acount' ELSE 'Account' END || ' Field ' || o_custkey div 6 AS label")
    return fill_plan.fill_plan(raw, fields).withColumn("rule", F.when(F.col("value").isNotNull(), F.substring_index("rule", " ", 1)).otherwise(F.col("rule")))


# Spellings of the plain labels that Unicode's composed form makes equal again.
WIDE, LIGATURE, SPACED = "Ａccount Ｆield", "Account ﬁeld", "Account\u2003Field\u00a0"


@query(
    "fill_plan_folded",
    f"""WITH {_taken(PLAIN_FIELDS, PLAIN_SHEET, "doc_id")}, v AS (SELECT *, {FIRST.format('v')} AS val FROM (SELECT a.*, {TRIES})),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc, eff, f, idx, val IS NULL ORDER BY emit_no) AS nth FROM v)
    SELECT field_no, page, eff AS section, f AS label, idx, CASE WHEN nth = 1 THEN val END AS value, CASE WHEN val IS NULL THEN 'no value' WHEN nth > 1 THEN 'written before' ELSE 'exact' END AS rule FROM o""",
)
def fill_plan_folded(spark, d):
    """The plan where sheet and fields spell labels in full width, with ligatures and with
    other spaces: all are the plain label, in the SQL a constant."""
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    spelt = lambda key: f"CASE {key} % 4 WHEN 0 THEN '{WIDE}' WHEN 1 THEN '{LIGATURE}' WHEN 2 THEN '{SPACED}' ELSE 'Account Field' END || ' '"
    raw = customer.selectExpr("c_custkey AS row_no", "replace(c_mktsegment, 'A', 'Ａ') AS Section", "CAST(NULL AS STRING) AS Page", f"{spelt('c_custkey')} || c_custkey div 6 AS Field", "CAST(c_custkey % 4 AS STRING) AS Index", "c_name AS Value")
    fields = orders.selectExpr("o_orderkey AS field_no", "o_orderkey div 4000 AS doc_id", "'' AS section", f"{spelt('o_orderkey')} || o_custkey div 6 AS label")
    return fill_plan.fill_plan(raw, fields, None).withColumn("rule", F.when(F.col("value").isNotNull(), F.substring_index("rule", " ", 1)).otherwise(F.col("rule")))


@query("fill_plan_status", f"SELECT rule AS action, count(*) AS fields, count(value) AS filled FROM ({FLAG_SQL}) GROUP BY 1")
def fill_plan_status(spark, d):
    """The dry run in figures: how many fields are written, and why others are not."""
    raw, fields = _flagship(spark, d)
    dry = fill_plan.report(fill_plan.fill_plan(raw, fields, None), fields)
    action = F.when(F.col("action").startswith("write "), "written").otherwise(F.col("action"))
    return dry.groupBy(action.alias("action")).agg(F.count("*").alias("fields"), F.count("value").alias("filled"))


@query("fill_passes", "SELECT o_custkey AS target, arg_min(p, row(r, o_orderkey)) AS pass, arg_min(v, row(r, o_orderkey)) AS value FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'placeholders' WHEN 1 THEN 'underlines' ELSE 'tables' END AS p, o_orderkey % 3 AS r, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS v FROM orders) WHERE v <> '' GROUP BY 1")
def fill_passes(spark, d):
    """The first pass that has a value for a target."""
    x = table(spark, d, "orders").selectExpr("o_custkey AS target", "o_orderkey AS emit_no", "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS value")
    offers = {n: x.filter(F.col("emit_no") % 3 == i) for i, n in enumerate(("placeholders", "underlines", "tables"))}
    return passes.first_pass(offers)


# Paragraphs of forms: a blank after a label, a box beside one, a placeholder, a bare label.
PARAS = """(SELECT user_id AS doc_id, event_id AS block_no, CASE event_type WHEN 'click' THEN 'Name ' || event_id % 7 || ': ______' WHEN 'view' THEN '[ ] agree ' || event_id % 5 WHEN 'error' THEN 'dear {{ city }} of ' || event_id ELSE 'Town ' || event_id % 3 END AS text, event_type AS kind FROM events)"""


@query(
    "document_fill",
    f"""WITH p AS (SELECT *, CASE kind WHEN 'click' THEN 'name ' || block_no % 7 WHEN 'view' THEN 'agree ' || block_no % 5 WHEN 'error' THEN '' ELSE 'town ' || block_no % 3 END AS label FROM {PARAS}),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY block_no) AS n FROM p)
    SELECT doc_id, block_no AS place, CASE kind WHEN 'click' THEN 'underlines' WHEN 'view' THEN 'checkboxes' WHEN 'error' THEN 'placeholders' ELSE 'last_chance' END AS pass,
    CASE kind WHEN 'click' THEN 'Name ' || block_no % 7 || ': N' || block_no % 7 WHEN 'view' THEN (CASE WHEN block_no % 5 % 2 = 0 THEN '☑' ELSE '☐' END) || ' agree ' || block_no % 5 WHEN 'error' THEN 'dear Rome of ' || block_no ELSE 'Town ' || block_no % 3 || ' T' || block_no % 3 END AS text
    FROM k WHERE kind IN ('click', 'view', 'error') OR n = 1""",
)
def document_fill(spark, d):
    """A document's paragraphs filled pass by pass, and the last chance after them."""
    blocks = table(spark, d, "events").selectExpr("user_id AS doc_id", "event_id AS block_no", "'para' AS kind", "CASE event_type WHEN 'click' THEN 'Name ' || event_id % 7 || ': ______' WHEN 'view' THEN '[ ] agree ' || event_id % 5 WHEN 'error' THEN 'dear {{ city }} of ' || event_id ELSE 'Town ' || event_id % 3 END AS text")
    cells = spark.createDataFrame([], "doc_id long, table_no long, row_no long, col_no long, text string")
    rows = [(f"Name {i}", f"N{i}") for i in range(7)] + [(f"agree {i}", "yes" if i % 2 == 0 else "no") for i in range(5)] + [("city", "Rome")] + [(f"Town {i}", f"T{i}") for i in range(3)]
    sheet = spark.createDataFrame([(n, f, f.lower(), "", None, None, v) for n, (f, v) in enumerate(rows)], "row_no long, Field string, field_norm string, section_norm string, Page long, Index long, Value string")
    return passes.document_plan(blocks, cells, sheet).select("doc_id", "place", "pass", "text")
