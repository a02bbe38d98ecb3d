"""Queries of the lookup, text and numbering operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import lookup as L
from ..operators import occurrence as O

from .base import collapse, given, no_parens, no_punct, query, sql_of, table

LABEL = "'  ' || p_name || ' (' || p_brand || ')  -  ' || p_type || CASE WHEN p_size % 3 = 0 THEN ' :' WHEN p_size % 3 = 1 THEN ':' ELSE '' END"
PUNCT_END = "regexp_replace(trim(x), ':\\s*$', '')"


@query(
    "normalizers",
    f"""SELECT p_partkey, {no_punct('lower(' + collapse(no_parens('x')) + ')')} AS normalized, {no_punct('lower(' + collapse('x') + ')')} AS key,
    regexp_replace({collapse('lower(x)')}, '[^\\w\\s]', '', 'g') AS section_key, lower({collapse(PUNCT_END)}) AS strict,
    lower({collapse("regexp_replace(trim(" + no_parens('x') + "), ':\\s*$', '')")}) AS strict_match,
    {no_punct("lower(" + collapse("regexp_replace(trim(" + no_parens('x') + "), ':\\s*$', '')") + ")")} AS loose,
    trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS ascii, {collapse("lower(regexp_replace(x, '[^\\w\\s\\-/()]', '', 'g'))")} AS basic,
    lower(trim(regexp_replace({collapse('x')}, ':\\s*$', ''))) AS dash_key, {collapse('x')} AS inline
    FROM (SELECT p_partkey, {LABEL} AS x FROM part)""",
)
def normalizers(spark, d):
    """All label normalisers side by side."""
    x = table(spark, d, "part").selectExpr("p_partkey", f"{LABEL} AS x").withColumn("x", S.nfkc("x"))
    forms = {"normalized": T.normalize, "key": T.norm_key, "section_key": T.section_key, "strict": T.strict, "strict_match": T.strict_match, "loose": T.loose, "ascii": T.ascii_norm, "basic": T.basic_norm, "dash_key": T.dash_key, "inline": T.inline_norm}
    return x.select("p_partkey", *[f("x").alias(k) for k, f in forms.items()])


@query(
    "suffixes",
    """SELECT p_partkey, trim(regexp_replace(x, '[\\s:]+$', '')) AS no_colons, regexp_replace(x, ':\\s*$', '') AS no_colon,
    regexp_replace(p_name || ' (' || p_brand || ')', '\\s*\\([^()]*\\)\\s*$', '') AS no_paren, p_brand AS one_phrase,
    CASE WHEN p_size % 2 = 0 THEN 'name of investor' ELSE 'investor ' || p_brand END AS aliased
    FROM (SELECT *, p_type || CASE p_size % 3 WHEN 0 THEN ' : :' WHEN 1 THEN ':' ELSE '' END AS x FROM part)""",
)
def suffixes(spark, d):
    """Colons, parentheses, doubled phrases and aliases."""
    x = table(spark, d, "part").selectExpr("*", "p_type || CASE p_size % 3 WHEN 0 THEN ' : :' WHEN 1 THEN ':' ELSE '' END AS x")
    named = F.when(F.col("p_size") % 2 == 0, F.lit("investor name")).otherwise(F.concat(F.lit("investor "), "p_brand"))
    return x.select("p_partkey", T.strip_colons("x").alias("no_colons"), T.strip_one_colon("x").alias("no_colon"), T.strip_trailing_paren(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("no_paren"), T.dedupe_phrase(F.concat("p_brand", F.lit(" "), "p_brand")).alias("one_phrase"), T.alias(named).alias("aliased"))


@query(
    "value_text",
    """SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS whole, CAST(c_custkey AS VARCHAR) || '.25' AS trimmed, 'x' || c_custkey AS other, '' AS blank FROM customer""",
)
def value_text(spark, d):
    """Canonical text of values."""
    key = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select("c_custkey", T.value_text(F.concat(F.lit(" "), key, F.lit(".00"))).alias("whole"), T.value_text(F.concat(key, F.lit(".2500"))).alias("trimmed"), T.value_text(F.concat(F.lit("x"), key)).alias("other"), T.value_text(F.lit(None).cast("string")).alias("blank"))


@query(
    "number_text",
    """SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS whole, CAST(c_custkey AS VARCHAR) || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS quarter FROM customer""",
)
def number_text(spark, d):
    """Text of numbers, with up to 12 and up to 6 decimals."""
    c = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", T.number_text(c.cast("double")).alias("whole"), T.number_text(c + (c % 4) / 4, 6).alias("quarter"))


@query(
    "truthy",
    """SELECT o_orderkey, CASE x WHEN 'Yes' THEN TRUE WHEN 'x' THEN TRUE WHEN 'unchecked' THEN FALSE WHEN '0' THEN FALSE END AS wide,
    CASE x WHEN 'Yes' THEN TRUE WHEN 'unchecked' THEN FALSE WHEN '0' THEN FALSE END AS narrow
    FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'x' WHEN 2 THEN 'unchecked' WHEN 3 THEN '0' ELSE o_orderstatus END AS x FROM orders)""",
)
def truthy(spark, d):
    """Words that mean yes or no."""
    x = table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'X' WHEN 2 THEN 'Unchecked' WHEN 3 THEN '0' ELSE o_orderstatus END AS x")
    return x.select("o_orderkey", T.truthy("x").alias("wide"), T.truthy("x", T.YES_NARROW, T.NO_NARROW).alias("narrow"))


@query(
    "index_and_page",
    """SELECT emit_no, CASE emit_no % 4 WHEN 0 THEN label WHEN 1 THEN -label WHEN 2 THEN NULL ELSE NULL END AS idx,
    CASE WHEN emit_no % 4 = 3 THEN NULL ELSE page END AS page, CASE WHEN emit_no % 4 = 3 OR page = 0 THEN NULL ELSE page END AS shown, CASE WHEN page = 0 THEN 1 ELSE page END AS at_least_one FROM {visits} v""",
)
def index_and_page(spark, d):
    """Index and page from text."""
    x = given(spark, d, "visits").selectExpr("emit_no", "page AS p", "CASE emit_no % 4 WHEN 0 THEN '#' || label WHEN 1 THEN ' - ' || label WHEN 2 THEN label || '-' ELSE 'none' END AS i", "CASE emit_no % 4 WHEN 3 THEN 'n/a' ELSE page || '.0' END AS page")
    return x.select("emit_no", T.clean_index("i").alias("idx"), T.clean_page("page").alias("page"), T.positive_page(T.clean_page("page")).alias("shown"), T.index_or_one("p").alias("at_least_one"))


@query(
    "titles_and_names",
    """SELECT row_no, CASE WHEN length(trim(string_split(x, ':')[1])) >= 6 AND contains(x, ':') THEN trim(string_split(x, ':')[1]) ELSE x END AS title,
    CASE WHEN length(trim(string_split(x, ':')[1])) >= 20 AND contains(x, ':') THEN trim(string_split(x, ':')[1]) ELSE x END AS title_long,
    CASE WHEN row_no % 4 = 0 THEN 'Field #' || row_no || ' (Sec: ' || CASE WHEN section_norm = '' THEN 'No Section' ELSE section_norm END || ', Idx: ' || coalesce(Index, 1) || ')' ELSE x END AS name,
    'A | ' || field_norm AS choices
    FROM (SELECT *, CASE WHEN row_no % 3 = 0 THEN 'No: ' || row_no ELSE field_norm || ': fill in' END AS x FROM {sheet})""",
)
def titles_and_names(spark, d):
    """Titles cut at a colon, fallback names, and choices as text."""
    x = given(spark, d, "sheet").selectExpr("*", "CASE WHEN row_no % 3 = 0 THEN 'No: ' || row_no ELSE field_norm || ': fill in' END AS x")
    label = F.when(F.col("row_no") % 4 == 0, F.when(F.col("row_no") % 8 == 0, F.lit("unknown_7")).otherwise(F.lit(" "))).otherwise(F.col("x"))
    return x.select("row_no", T.title(F.lit(""), F.col("x")).alias("title"), T.title(F.lit(None).cast("string"), F.col("x"), 20).alias("title_long"), T.fallback_name(label, F.col("section_norm"), F.col("row_no"), F.coalesce("Index", F.lit(1))).alias("name"), T.choices_text(F.array(F.lit("A"), "field_norm")).alias("choices"))


@query(
    "field_filters",
    """SELECT p_partkey, p_partkey % 7 = 1 OR p_partkey % 7 = 2 OR p_partkey % 7 = 3 AS narrative, p_partkey % 7 IN (3, 4) AS placeholder, CAST(length(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS BIGINT) AS letters,
    CAST(len(string_split(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ' ')) AS BIGINT) AS words FROM part""",
)
def field_filters(spark, d):
    """Running text, placeholder labels, and lengths."""
    x = table(spark, d, "part").selectExpr("*", "CASE p_partkey % 7 WHEN 1 THEN repeat('word ', 21) WHEN 2 THEN 'See Page 4' WHEN 3 THEN '' WHEN 4 THEN 'unknown_3' WHEN 5 THEN 'x page' ELSE p_name END AS f", "CASE WHEN p_partkey % 7 = 6 THEN 'Checkbox' ELSE '' END AS c")
    return x.select("p_partkey", T.is_narrative("f", "c").alias("narrative"), T.is_placeholder_label("f").alias("placeholder"), T.token_length("p_name").cast("long").alias("letters"), T.n_words("p_name").cast("long").alias("words"))


CAPS = "length(regexp_replace(x, '[^A-Z]', '', 'g')) / greatest(length(regexp_replace(x, '[^A-Za-z]', '', 'g')), 1)"
N = "len(string_split(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' '))"
SHAPED = "CASE p_partkey % 8 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ':' WHEN 2 THEN 'Section ' || p_size WHEN 3 THEN 'Wire Information ' || p_brand WHEN 4 THEN 'INVESTOR FORM ' || p_brand WHEN 5 THEN 'Fax' WHEN 6 THEN 'All Applicants' ELSE lower(p_type) END"


@query(
    "section_titles",
    f"""SELECT p_partkey, (length(x) > 5 AND x LIKE '%:') OR contains(lower(x), 'wire information') OR ({CAPS} >= 0.45 AND {N} <= 15) AS relaxed,
    x LIKE '%:' OR ({CAPS} >= 0.45 AND {N} <= 15) AS plain, x LIKE '%:' OR lower(x) LIKE 'section %' OR ({CAPS} >= 0.45 AND {N} <= 15) AS section,
    len(list_filter(string_split(x, ' '), lambda w: upper(w) = w AND lower(w) <> w)) >= 2 OR regexp_matches(upper(x), '(FORM|APPLICATION|SIGNATURE|REGISTRATION)\\b') AS caps,
    x LIKE '%:' OR x = 'All Applicants' OR (x <> 'Fax' AND {CAPS} >= 0.85 AND {N} <= 15) AS known
    FROM (SELECT p_partkey, {SHAPED} AS x FROM part)""",
)
def section_titles(spark, d):
    """Five readings of what a section heading is."""
    x = table(spark, d, "part").selectExpr("p_partkey", f"{SHAPED} AS x")
    return x.select("p_partkey", T.is_heading_relaxed("x").alias("relaxed"), T.is_heading("x").alias("plain"), T.is_heading_section("x").alias("section"), T.is_heading_caps("x").alias("caps"), T.is_heading_known("x").alias("known"))


@query(
    "label_shapes",
    f"""SELECT p_partkey, {N} <= 10 AND length(x) <= 140 AS short_label, {N} <= 2 AS short_option, x NOT LIKE '%:' AND lower(x) <> 'fax' AS option_label,
    {CAPS} < 0.70 AND {N} <= 7 AND length(x) <= 48 AS label_like, p_partkey % 2 = 0 AS box, p_partkey % 2 = 1 AS blank,
    CASE p_partkey % 4 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'dropdown' WHEN 2 THEN 'underline' ELSE '' END AS type
    FROM (SELECT p_partkey, {SHAPED} AS x FROM part)""",
)
def label_shapes(spark, d):
    """Shapes of labels and options, and what can be filled in."""
    x = table(spark, d, "part").selectExpr("p_partkey", f"{SHAPED} AS x", "CASE p_partkey % 4 WHEN 1 THEN 'acro_choice' WHEN 2 THEN 'underline' ELSE '' END AS p", "CASE p_partkey % 4 WHEN 0 THEN 'CheckBox' ELSE '' END AS k")
    box = F.when(F.col("p_partkey") % 2 == 0, F.lit("[ ] yes")).otherwise(F.lit("____"))
    return x.select("p_partkey", T.is_short_label("x").alias("short_label"), T.is_short_option("x", 2).alias("short_option"), T.is_option_label("x").alias("option_label"), T.is_label_like("x").alias("label_like"), T.has_checkbox(box).alias("box"), T.is_placeholder_text(box).alias("blank"), T.field_type(F.col("p"), F.col("k"), F.lit("label"), F.array()).alias("type"))


@query(
    "shared_words",
    """SELECT p_partkey, CAST(len(a) AS BIGINT) AS n_words, len(list_intersect(a, b)) > 0 AS overlap FROM (SELECT p_partkey,
    list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\\W+'), lambda w: length(w) >= 3 AND w <> 'the')) AS a,
    list_distinct(list_filter(regexp_split_to_array(lower(p_type), '\\W+'), lambda w: length(w) >= 3 AND w <> 'the')) AS b FROM part)""",
)
def shared_words(spark, d):
    """Significant words and whether two labels share one."""
    return table(spark, d, "part").select("p_partkey", F.size(T.significant_words("p_name", ("the",))).cast("long").alias("n_words"), T.overlaps("p_name", "p_type", ("the",)).alias("overlap"))


CLEAN = f"""SELECT row_no, trim(Section) AS "Section", CASE WHEN row_no % 7 = 0 THEN NULL ELSE CAST(CAST(Page AS DOUBLE) AS BIGINT) END AS "Page", Field, CASE WHEN Index = '' THEN NULL ELSE CAST(substr(Index, 2) AS BIGINT) END AS "Index", Value, Choices FROM {sql_of('raw_sheet')} WHERE Value <> '' AND Value <> 'NaN'"""
KEYED = f"""(SELECT *, {no_punct("lower(" + collapse('Field') + ")")} AS field_norm, lower("Section") AS section_norm, CASE WHEN coalesce("Index", 0) = 0 THEN 1 ELSE "Index" END AS idx FROM ({CLEAN}))"""


def _clean(spark, d):
    return L.with_keys(L.clean(given(spark, d, "raw_sheet")))


@query("lookup_clean", CLEAN)
def lookup_clean(spark, d):
    """Typed lookup rows from a sheet of strings."""
    return L.clean(given(spark, d, "raw_sheet"))


@query("lookup_defaults", f"SELECT row_no, Field, Value FROM ({CLEAN}) UNION ALL SELECT n_nationkey + (SELECT max(row_no) FROM ({CLEAN})), 'Default ' || n_nationkey, n_name FROM nation")
def lookup_defaults(spark, d):
    """Defaults behind the rows of the sheet."""
    more = table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS row_no", "'Default ' || n_nationkey AS Field", "n_name AS Value")
    return L.with_defaults(L.clean(given(spark, d, "raw_sheet")), more).select("row_no", "Field", "Value")


@query("lookup_sections", f"SELECT DISTINCT section_norm FROM {KEYED} WHERE section_norm <> ''")
def lookup_sections(spark, d):
    return L.sections(_clean(spark, d))


@query("lookup_dedup", f"SELECT row_no, section_norm, field_norm, idx, Value FROM {KEYED} QUALIFY row_number() OVER (PARTITION BY section_norm, field_norm, idx ORDER BY row_no) = 1")
def lookup_dedup(spark, d):
    """The first row by section, field and index."""
    return L.dedupe(_clean(spark, d)).select("row_no", "section_norm", "field_norm", T.index_or_one("Index").alias("idx"), "Value")


GROUPS = """(SELECT l_suppkey % 5 AS s, l_partkey AS f, l_linenumber AS i, l_orderkey * 10 + l_linenumber AS row_no, l_shipdate AS v, l_returnflag AS flag FROM lineitem)"""


def _groups(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select((F.col("l_suppkey") % 5).alias("section_norm"), F.col("l_partkey").alias("field_norm"), F.col("l_linenumber").cast("long").alias("Index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("Value"), F.col("l_linestatus").alias("Choices"))


LINES = """(SELECT l_suppkey % 5 AS section_norm, l_partkey AS field_norm, CAST(l_linenumber AS BIGINT) AS idx, l_orderkey * 10 + l_linenumber AS row_no, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || l_linestatus END AS value, l_linestatus AS choices FROM lineitem)"""


@query("dedup_conflicts", f"SELECT section_norm, field_norm, idx, arg_min(value, row_no) AS kept, count(DISTINCT nullif(value, '')) AS n_values FROM {LINES} GROUP BY ALL HAVING count(DISTINCT nullif(value, '')) > 1")
def dedup_conflicts(spark, d):
    """Keys whose rows have different values."""
    return L.conflicts(_groups(spark, d))


@query("dedup_report", f"SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS kept_rows, CAST(sum(n - 1) AS BIGINT) AS deduped, count(*) FILTER (v > 1) AS conflicts FROM (SELECT count(*) AS n, count(DISTINCT nullif(value, '')) AS v FROM {LINES} GROUP BY section_norm, field_norm, idx)")
def dedup_report(spark, d):
    """Rows, kept rows and conflicts."""
    return L.report(_groups(spark, d))


@query(
    "lookup_sanitize",
    f"""SELECT section_norm, field_norm, idx, coalesce(arg_min(value, row_no) FILTER (value <> ''), '') AS value, count(*) AS n,
    array_to_string(list_transform(list_sort(list(row(r, choices)) FILTER (f = 1)), lambda x: x[2]), ' | ') AS choices
    FROM (SELECT *, min(row_no) OVER (PARTITION BY section_norm, field_norm, idx, choices) AS r, row_number() OVER (PARTITION BY section_norm, field_norm, idx, choices ORDER BY row_no) AS f FROM {LINES}) GROUP BY 1, 2, 3""",
)
def lookup_sanitize(spark, d):
    """First value that is not blank, and all choices."""
    return L.sanitize(_groups(spark, d)).select("section_norm", "field_norm", "idx", "value", "n", "choices")


@query(
    "value_maps",
    f"""SELECT 'exact' AS map, section_norm, field_norm, idx, arg_max(Value, row_no) AS value FROM {KEYED} GROUP BY 2, 3, 4
    UNION ALL SELECT 'sectionless', NULL, field_norm, idx, arg_max(Value, row_no) FROM {KEYED} GROUP BY 3, 4 UNION ALL SELECT 'by_field', NULL, field_norm, idx, arg_min(Value, row_no) FROM {KEYED} GROUP BY 3, 4""",
)
def value_maps(spark, d):
    """The three value maps, row by row."""
    maps = zip(("exact", "sectionless", "by_field"), L.value_maps(_clean(spark, d)))
    return reduce(DataFrame.unionByName, [m.withColumn("map", F.lit(n)).select("map", "section_norm" if n == "exact" else F.lit(None).cast("string").alias("section_norm"), "field_norm", "idx", "value") for n, m in maps])


@query("value_map_exact", f"SELECT section_norm, field_norm, idx, arg_max(Value, row_no) AS value FROM {KEYED} GROUP BY 1, 2, 3")
def value_map_exact(spark, d):
    return L.value_maps(_clean(spark, d))[0]


@query("value_map_by_field", f"SELECT field_norm, idx, arg_min(Value, row_no) AS value FROM {KEYED} GROUP BY 1, 2")
def value_map_by_field(spark, d):
    return L.value_maps(_clean(spark, d))[2]


@query("values_by_field", f"SELECT field_norm, array_to_string(list(Value ORDER BY row_no), ';') AS value_list FROM {KEYED} GROUP BY 1")
def values_by_field(spark, d):
    """Values of a field in order."""
    return L.values_by_field(_clean(spark, d)).select("field_norm", F.array_join("values", ";").alias("value_list"))


@query("multi_index", f"SELECT section_norm, field_norm, count(DISTINCT \"Index\") + max(CAST(\"Index\" IS NULL AS INT)) AS n_index FROM {KEYED} GROUP BY 1, 2 HAVING count(DISTINCT \"Index\") + max(CAST(\"Index\" IS NULL AS INT)) > 1")
def multi_index(spark, d):
    """Fields with more than one index."""
    return L.multi_index(_clean(spark, d))


@query("simple_sheet", "SELECT * FROM (UNPIVOT (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 5) ON c_custkey, c_name, c_mktsegment INTO NAME field VALUE value)")
def simple_sheet(spark, d):
    """The sheet of one header for each field: one row of it."""
    sheet = table(spark, d, "customer").select(F.col("c_custkey").alias("row_no"), "c_custkey", "c_name", "c_mktsegment")
    return L.simple_rows(sheet, 5)


@query("page_counts", "SELECT page, count(*) AS n, count(DISTINCT section) AS sections FROM {visits} v GROUP BY 1")
def page_counts(spark, d):
    """Fields and sections by page."""
    return L.page_counts(given(spark, d, "visits"))


@query("sections_by_page", "SELECT page, array_to_string(list(section ORDER BY first), ',') AS sections FROM (SELECT page, section, min(emit_no) AS first FROM {visits} v GROUP BY 1, 2) GROUP BY 1")
def sections_by_page(spark, d):
    """Sections of a page in order of their first field."""
    return L.sections_by_page(given(spark, d, "visits")).withColumn("sections", F.array_join("sections", ","))


@query("occurrence_idx", "SELECT emit_no, row_number() OVER (PARTITION BY page, section, label ORDER BY emit_no) AS idx FROM {visits} v")
def occurrence_idx(spark, d):
    """The n-th appearance of a label in its page and section."""
    return O.occurrence(given(spark, d, "visits"), ["page", "section", "label"]).select("emit_no", "idx")


@query("occurrence_any_page", "SELECT emit_no, row_number() OVER (PARTITION BY section, label ORDER BY emit_no) AS idx FROM {visits} v")
def occurrence_any_page(spark, d):
    return O.occurrence(given(spark, d, "visits"), ["section", "label"]).select("emit_no", "idx")


@query(
    "occurrence_forced",
    """WITH RECURSIVE v AS MATERIALIZED (SELECT emit_no, label, CASE WHEN emit_no % 7 = 0 THEN emit_no % 5 + 1 END AS f, row_number() OVER (PARTITION BY label ORDER BY emit_no) AS n FROM {visits} x),
    g AS (SELECT label, n, emit_no, coalesce(f, 1) AS cur, coalesce(f, 1) AS idx FROM v WHERE n = 1
      UNION ALL SELECT g.label, v.n, v.emit_no, CASE WHEN v.f IS NULL THEN cur + 1 ELSE greatest(cur, v.f) END, CASE WHEN v.f IS NULL THEN cur + 1 ELSE v.f END FROM g JOIN (SELECT * FROM v) v ON v.label = g.label AND v.n = g.n + 1)
    SELECT emit_no, label, CAST(idx AS BIGINT) AS idx FROM g""",
)
def occurrence_forced(spark, d):
    """Occurrences where some rows force their index."""
    rows = given(spark, d, "visits").select("emit_no", "label", F.when(F.col("emit_no") % 7 == 0, F.col("emit_no") % 5 + 1).alias("forced"))
    return O.forced_occurrence(rows, ["label"]).select("emit_no", "label", "idx")


@query(
    "explicit_index",
    """SELECT v.emit_no, CASE WHEN n <= len(coalesce(k, [])) THEN k[n] ELSE n - len(coalesce(k, [])) END AS idx
    FROM (SELECT emit_no, label, row_number() OVER (PARTITION BY label ORDER BY emit_no) AS n FROM {visits} v) v
    LEFT JOIN (SELECT o_custkey AS label, list_sort(list(DISTINCT CAST(o_orderkey % 7 + 2 AS BIGINT))) AS k FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) e USING (label)""",
)
def explicit_index(spark, d):
    """Explicit indexes first, then 1, 2, 3."""
    known = table(spark, d, "orders").selectExpr("o_custkey AS label", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 7 + 2 AS BIGINT) END AS Index")
    return O.explicit_index(given(spark, d, "visits"), known, ["label"]).select("emit_no", "idx")


@query("write_once", "SELECT emit_no, page, section, label FROM {visits} v WHERE value_flag = 'F' QUALIFY row_number() OVER (PARTITION BY page, section, label ORDER BY emit_no) = 1")
def write_once(spark, d):
    """The first row of a key with something to write."""
    rows = given(spark, d, "visits").withColumn("value", F.when(F.col("value_flag") == "F", "x").otherwise(""))
    return O.write_once(rows, ["page", "section", "label"]).select("emit_no", "page", "section", "label")


@query(
    "write_once_boxes",
    """WITH RECURSIVE v AS (SELECT DISTINCT doc_id, page, field_no, field_no % 11 AS label, field_no % 3 = 0 AS box, concat_ws(':', round_even(x0 / 2, 0), round_even(y / 2, 0), round_even((x0 + 5) / 2, 0), round_even((y + 5) / 2, 0)) AS place FROM {slots} q),
    n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY field_no) AS n FROM v),
    g AS (SELECT doc_id, page, 0::BIGINT AS n, []::BIGINT[] AS labels, []::VARCHAR[] AS places, NULL::BIGINT AS field_no FROM (SELECT DISTINCT doc_id, page FROM n)
      UNION ALL SELECT g.doc_id, g.page, n.n, CASE WHEN k THEN list_append(labels, n.label) ELSE labels END, CASE WHEN k AND n.box THEN list_append(places, n.place) ELSE places END, CASE WHEN k THEN n.field_no END
      FROM g JOIN (SELECT * FROM n) n ON n.doc_id = g.doc_id AND n.page = g.page AND n.n = g.n + 1, LATERAL (SELECT NOT list_contains(labels, n.label) AND NOT (n.box AND list_contains(places, n.place)) AS k))
    SELECT doc_id, page, field_no FROM g WHERE field_no IS NOT NULL""",
)
def write_once_boxes(spark, d):
    """The same where checkboxes are also written once a place."""
    rows = given(spark, d, "slots").select("doc_id", "page", "field_no", "x0", F.col("y").alias("y0"), (F.col("x0") + 5).alias("x1"), (F.col("y") + 5).alias("y1"), (F.col("field_no") % 3 == 0).alias("is_checkbox"), (F.col("field_no") % 11).alias("label"), F.lit("v").alias("value"))
    return O.write_once_boxes(rows, ["doc_id", "page"], ["label"], "field_no").select("doc_id", "page", "field_no")


@query("template_round_trip", f"SELECT row_no AS emit_no, field_norm AS label, Index AS \"index\" FROM {sql_of('sheet')}")
def template_round_trip(spark, d):
    """Fields written as template JSON and read back."""
    fields = given(spark, d, "sheet").select(F.col("row_no").alias("emit_no"), F.col("field_norm").alias("label"), F.col("Index").alias("index"))
    # one template for each hundred fields, as a form would have
    text = fields.withColumn("form", F.floor(F.col("emit_no") / 100)).groupBy("form").agg(F.to_json(F.array_sort(F.collect_list(F.struct("emit_no", "label", "index")))).alias("json"))
    kind = "array<struct<emit_no:bigint,label:string,index:bigint>>"
    return text.select(F.inline(F.from_json("json", kind)))
